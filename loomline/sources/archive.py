"""Scans of a chat workspace through the paged source, as typed tables.

``scan`` reads one kind of thing: one page chain, or one per channel. A chain that failed
has its error in a row of its own, with all other columns null.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .rest import RestSource

# Per kind the public API's method, where its items stand, their fields, and parameters.
KINDS = {
    "users": ("users.list", "members", "id string, name string, real_name string, deleted boolean", {"limit": 200}),
    "channels": ("conversations.list", "channels", schemas.CHANNELS, {"limit": 200, "types": "public_channel,private_channel,mpim,im"}),
    "history": ("conversations.history", "messages", f"ts string, text string, user string, thread_ts string, reply_count bigint, files array<{schemas.FILE}>", {"limit": 200}),
    "replies": ("conversations.replies", "messages", "ts string, text string, user string, thread_ts string", {"limit": 200}),
    "members": ("conversations.members", "members", "id string", {"limit": 200}),
    "pins": ("pins.list", "items", "type string, created bigint, created_by string", {}),
    "bookmarks": ("bookmarks.list", "bookmarks", "id string, title string, link string, type string", {}),
    "team": ("team.info", "team", "id string, name string, domain string", {}),
    "emoji": ("emoji.list", "emoji", "name string, url string", {}),
}
#: Kinds of which only the first page is read.
FIRST_PAGE = {"replies", "pins", "bookmarks", "team", "emoji"}


def scan(spark: SparkSession, client: str, kind: str, chains: list[dict] | None = None) -> DataFrame:
    """One kind as rows: chain (the number of its parameters in ``chains``), its fields, error."""
    endpoint, items, ddl, params = KINDS[kind]
    spark.dataSource.register(RestSource)
    options = {"client": client, "endpoint": endpoint, "items": items, "first_page": str(kind in FIRST_PAGE).lower()}
    rows = spark.read.format("loomline_rest").options(**options, chains=json.dumps([params | c for c in chains or [{}]])).load()
    plain = kind == "members"  # items are ids, not objects
    item = F.struct(F.from_json(F.concat(F.lit("["), "item", F.lit("]")), "array<string>")[0].alias("id")) if plain else F.from_json("item", f"struct<{_struct(ddl)}>")
    return rows.select("chain", F.when(F.col("item").isNotNull(), item).alias("i"), "error").select("chain", "i.*", "error")


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))
