"""Schemas of landed files; nothing is inferred."""

from __future__ import annotations

REPLY = "struct<ts:string,text:string>"
FILE = "struct<id:string,name:string,url_private:string,url_private_download:string,mimetype:string,size:bigint>"
MESSAGE = f"struct<ts:string,text:string,thread_ts:string,reply_count:bigint,files:array<{FILE}>,thread_replies:array<{REPLY}>>"
RAW_CHANNEL = f"channel_info struct<id:string,name:string,is_im:boolean,is_mpim:boolean>, members array<string>, message_count bigint, messages array<{MESSAGE}>"
CLEAN_REPLY = "struct<message_id:string,timestamp:string,text:string>"
CLEAN_CHANNEL = f"channel_id string, messages array<struct<message_id:string,timestamp:string,text:string,thread:array<{CLEAN_REPLY}>>>"
CHUNK = "chunk_id string, chunk_type string, channel_id string, channel_name string, content string, token_count bigint, metadata map<string,string>"
PAIR = "query string, chunk_id string, chunk_content string, persona string, metadata map<string,string>, validation_reason string"
USERS = "ok boolean, members array<struct<id:string,name:string,real_name:string>>"
CHANNELS = "id string, name string, is_im boolean, is_mpim boolean"
