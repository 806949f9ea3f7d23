"""Registered queries on archives, chat calls and batches; catalog.py has the others.

As there, a conversation is a channel or a thread; texts and fields that an archive may
lack are taken out by number, so that every branch has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BM25, BM25_RUN, BUDGET, CALLS, MESSAGES, SPACES, TERMS, WINDOWS, _asked, _bm25_run, _calls, _docs, _messages, _parents, _searchable, _table, query
from .functions import ids, text, vectors
from .functions.tokenizer import Tokenizer
from .operators import chunk, clean, metrics, retrieval, search
from .plans import prompts, providers

HOLED = "holed AS (SELECT conv_id, turn, role, CASE WHEN turn = 3 OR turn = 0 AND conv_id % 10 = 7 THEN NULL ELSE text END AS text FROM conversations), " + MESSAGES.replace(
    "FROM conversations", "FROM holed"
)
FILES = "fl AS (SELECT conv_id, unnest(range(1, conv_id % 4 + 1)) AS i FROM conversations WHERE turn = 0)"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Channels as an archive has them: one message each, whose replies begin with itself, and files; some texts are null."""
    ts = F.concat((F.lit(1690000000) + F.col("conv_id") * 1000 + F.col("turn")).cast("string"), F.lit(".000000"))
    hole = (F.col("turn") == 3) | ((F.col("turn") == 0) & (F.col("conv_id") % 10 == 7))
    rows = _table(spark, d, "conversations").select("conv_id", "turn", ts.alias("ts"), F.when(~hole, F.col("text")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ts", "text"))).alias("all"))
    name = F.col("conv_id").cast("string")
    # sequence counts down where its end is below its start
    numbers = F.when(F.col("conv_id") % 4 > 0, F.sequence(F.lit(1).cast("bigint"), F.col("conv_id") % 4)).otherwise(F.array().cast("array<bigint>"))
    file = lambda i: F.struct(
        F.concat_ws("-", name, i).alias("id"), F.concat(F.lit("f"), i).alias("name"), F.concat(F.lit("u"), i).alias("url_private"),
        F.concat(F.lit("d"), i).alias("url_private_download"), F.lit("text/plain").alias("mimetype"), (i * 10).alias("size"),
    )
    head = F.element_at("all", 1)
    message = F.struct(head["ts"].alias("ts"), head["text"].alias("text"), F.transform(numbers, file).alias("files"), F.transform("all", lambda m: F.struct(m["ts"].alias("ts"), m["text"].alias("text"))).alias("thread_replies"))
    return grouped.select(name.alias("channel_id"), F.array(message).alias("messages"))


@query(f"""WITH {HOLED}, p AS (SELECT * FROM m WHERE turn = 0), r AS (SELECT conv_id, message_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS reply_pos FROM m WHERE turn > 0)
  SELECT p.conv_id::VARCHAR AS channel_id, p.message_id, r.reply_pos, r.message_id AS reply_id FROM p LEFT JOIN r USING (conv_id)""")
def clean_threads(spark, d):
    """Messages without text go with their threads, thread heads and null replies go."""
    rows = clean.cleaned(_raw(spark, d))
    return rows.select("channel_id", "message_id", F.posexplode_outer("thread").alias("reply_pos", "r")).select("channel_id", "message_id", F.col("reply_pos").cast("bigint").alias("reply_pos"), F.col("r.message_id").alias("reply_id"))


@query(f"""WITH {HOLED} SELECT conv_id::VARCHAR AS channel_id, CASE WHEN turn = 0 THEN -1 ELSE row_number() OVER (PARTITION BY conv_id, turn = 0 ORDER BY turn) - 1 END AS reply_pos, message_id, ts AS timestamp, text
  FROM m WHERE conv_id IN (SELECT conv_id FROM m WHERE turn = 0)""")
def flattened_messages(spark, d):
    """Parents and replies in one list."""
    out = clean.flattened(clean.cleaned(_raw(spark, d)))
    return out.select("channel_id", F.col("reply_pos").cast("bigint").alias("reply_pos"), "message_id", "timestamp", "text")


@query(f"WITH {FILES} SELECT conv_id::VARCHAR AS channel_id, conv_id || '-' || i AS id, 'f' || i AS name, 'u' || i AS url, 'd' || i AS url_download, 'text/plain' AS mimetype, i * 10 AS size FROM fl")
def extracted_files(spark, d):
    """Attachments of top-level messages."""
    return clean.files_of(_raw(spark, d)).drop("timestamp")


@query("""SELECT conv_id, turn FROM (SELECT *, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN turn::VARCHAR ELSE '0' END AS thread_ts FROM conversations) WHERE thread_ts <> '' AND turn % 4 > 0 AND turn::VARCHAR = thread_ts""")
def thread_parents(spark, d):
    """Messages that begin a thread."""
    rows = _table(spark, d, "conversations").withColumn("ts", F.col("turn").cast("string"))
    thread_ts = F.when(F.col("conv_id") % 3 == 1, F.col("ts")).when(F.col("conv_id") % 3 == 2, F.lit("0"))
    return rows.where(clean.is_thread_parent(thread_ts, F.col("turn") % 4, F.col("ts"))).select("conv_id", "turn")


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'dm_' || page_id WHEN page_id % 5 = 1 THEN 'group_dm_' || page_id WHEN page_id % 5 = 2 THEN page_id::VARCHAR ELSE url END AS name FROM pages")
def channel_names(spark, d):
    """Display names; direct and group messages by id, nameless channels too."""
    kind = F.col("page_id") % 5
    name = text.channel_name(F.when(kind != 2, F.col("url")), F.col("page_id").cast("string"), F.when(kind < 3, kind == 0), F.when(kind < 4, kind == 1))
    return _table(spark, d, "pages").select("page_id", name.alias("name"))


@query(f"SELECT conv_id, turn, substr(CASE WHEN regexp_matches(t, '[^{SPACES}]') THEN t ELSE ' ' END, 1, 64) AS body FROM (SELECT *, CASE WHEN turn % 4 = 2 THEN chr(10) || chr(9) ELSE text END AS t FROM conversations) WHERE text IS NOT NULL")
def embedding_texts(spark, d):
    """C17: a blank becomes one space, long texts are cut."""
    rows = _table(spark, d, "conversations").where("text is not null")
    body = F.when(F.col("turn") % 4 == 2, F.lit("\n\t")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", text.for_embedding(body, 64).alias("body"))


@query("SELECT page_id, url FROM pages")
def url_decoded(spark, d):
    """Percent-encoded names as they were."""
    rows = _table(spark, d, "pages").select("page_id", F.url_encode("url").alias("safe"))
    return rows.select("page_id", F.url_decode("safe").alias("url"))


@query(f"""WITH RECURSIVE {WINDOWS}, b AS (SELECT o.conv_id, w.win, o.turn, w.truncated,
    CASE WHEN w.truncated THEN substr(text, 1, floor({float(BUDGET)}::DOUBLE * (length(text)::DOUBLE / tok::DOUBLE) * 0.9::DOUBLE)::INT) || '...' ELSE '[Message by ' || role || ' at ' || ts || ']' || chr(10) || text END AS line FROM w JOIN o USING (conv_id, i)),
  g AS (SELECT conv_id, win, string_agg(line, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS content FROM b GROUP BY ALL)
  SELECT conv_id || '_' || message_id || '_msg' AS chunk_id, 'individual_message' AS chunk_type, text AS content, length(text) // 4 AS token_count FROM m
  UNION ALL SELECT conv_id || '_' || message_id || '_standalone', 'thread', text, length(text) // 4 FROM m
  UNION ALL SELECT conv_id || '_window_' || win, 'sliding_window', content, length(content) // 4 FROM g""")
def chunk_all(spark, d):
    """A channel's chunks of all three kinds."""
    return chunk.chunk_channel(_parents(spark, d), BUDGET).select("chunk_id", "chunk_type", "content", "token_count")


@query(f"""WITH RECURSIVE {WINDOWS}, g AS (SELECT DISTINCT conv_id, win FROM w),
  c AS (SELECT conv_id || '_' || message_id || '_msg' AS chunk_id, 'individual_message' AS chunk_type FROM m UNION ALL SELECT conv_id || '_' || message_id || '_standalone', 'thread' FROM m UNION ALL SELECT conv_id || '_window_' || win, 'sliding_window' FROM g)
  SELECT chunk_id, chunk_type FROM c QUALIFY row_number() OVER (PARTITION BY chunk_type ORDER BY chunk_id) <= 100""")
def head_per_type(spark, d):
    """H5: the first hundred chunks of each kind."""
    return chunk.head_per_type(chunk.chunk_channel(_parents(spark, d), BUDGET), 100).select("chunk_id", "chunk_type")


TURNS = "tu AS (SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN 'system' WHEN turn = 1 AND conv_id % 2 = 0 THEN 'assistant' ELSE role END AS role, text FROM conversations)"


@query(f"""WITH {TURNS}, hd AS (SELECT conv_id, min(turn) AS beg, arg_min(role, turn) AS role, arg_min(text, turn) AS text FROM tu GROUP BY conv_id),
  rest AS (SELECT tu.* FROM tu JOIN hd USING (conv_id) WHERE NOT (hd.role = 'system' AND tu.turn = hd.beg)),
  bg AS (SELECT conv_id, min(turn) AS beg, arg_min(role, turn) AS role FROM rest GROUP BY conv_id),
  al AS (SELECT conv_id, turn, role, text FROM rest UNION ALL SELECT conv_id, beg - 1, 'user', 'Begin.' FROM bg WHERE role <> 'user'),
  c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR lag(turn) OVER w IS NULL THEN 1 ELSE 0 END AS ch FROM al WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  r AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM c)
  SELECT r.conv_id, run, r.role, string_agg(r.text, chr(10) ORDER BY turn) AS content, any_value(CASE WHEN hd.role = 'system' THEN hd.text END) AS system FROM r JOIN hd USING (conv_id) GROUP BY r.conv_id, run, r.role""")
def provider_messages(spark, d):
    """The system turn pulled out, a user's turn put first, neighbours of one role joined."""
    role = F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), "system").when((F.col("turn") == 1) & (F.col("conv_id") % 2 == 0), "assistant").otherwise(F.col("role"))
    return chunk.provider_messages(_table(spark, d, "conversations").withColumn("role", role), "Begin.")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (props->>'k')::BIGINT ELSE -1 END AS k FROM events")
def structured_replies(spark, d):
    """C14: fenced replies that fit the schema, as values; a missing field or broken text gives none."""
    other = F.when(F.col("event_id") % 3 == 1, F.lit('{"other": 1}')).otherwise(F.lit('{"k": '))
    reply = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(other), F.lit("\n```"))
    return _table(spark, d, "events").select("event_id", F.coalesce(text.structured(reply, "k bigint")["k"], F.lit(-1)).alias("k"))


@query("""SELECT doc_id, 'You write one search query as a person of this kind: vague.' || chr(10) || 'The answer stands in this excerpt of the channel ' || source || ':' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Reply with the query alone.' AS prompt FROM documents""")
def prompt_assembly(spark, d):
    """What a model is asked."""
    return _table(spark, d, "documents").select("doc_id", prompts.question_prompt(F.lit("vague"), F.col("source"), F.col("text")).alias("prompt"))


@query(f"""WITH {TERMS}, {BM25}, {BM25_RUN} SELECT query_id, doc_id, '<|im_start|>system' || chr(10) || trim(b.text) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || trim(t.text) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS body
  FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents t USING (doc_id) WHERE bm.rank <= 5""")
def chat_template(spark, d):
    """Query and document as a reranker's chat text."""
    run = retrieval.with_texts(_bm25_run(spark, d).where("rank <= 5"), _asked(spark, d), _docs(spark, d))
    return run.select("query_id", "doc_id", prompts.chat_text(F.col("query"), F.col("content")).alias("body"))


@query("SELECT vec_id, embedding::FLOAT[] AS vector FROM embeddings".replace("embedding::FLOAT[] AS vector", "len(embedding) AS dims, round(embedding[1]::DOUBLE, 6) AS head, round(list_sum(embedding::DOUBLE[]), 5) AS total"))
def decoded_vectors(spark, d):
    """Vectors as providers send them, read back."""
    rows = _table(spark, d, "embeddings").select("vec_id", vectors.decoded(vectors.encoded(F.col("embedding"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", F.size("v").cast("bigint").alias("dims"), F.round(F.col("v")[0].cast("double"), 6).alias("head"), F.round(total, 5).alias("total"))


@query("""WITH RECURSIVE t AS (SELECT doc_id, doc_id // 300 AS req, length(text) // 4 AS tok, row_number() OVER (PARTITION BY doc_id // 300 ORDER BY doc_id) - 1 AS i FROM documents),
  s AS (SELECT req, i // 96 AS slice, min(i) AS lo, max(i) + 1 AS hi FROM t GROUP BY ALL),
  p AS (SELECT req, i + 1 AS i, sum(tok) OVER (PARTITION BY req ORDER BY i) AS upto FROM t UNION ALL SELECT DISTINCT req, 0, 0 FROM t),
  seg AS (SELECT s.req, lo, hi, b.upto - a.upto AS tok FROM s JOIN p a ON a.req = s.req AND a.i = lo JOIN p b ON b.req = s.req AND b.i = hi
    UNION ALL SELECT x.req, x.lo, x.hi, b.upto - a.upto FROM (SELECT req, nlo AS lo, least(nlo + size, top) AS hi FROM (SELECT req, unnest(range(lo, hi, (hi - lo) // 2)) AS nlo, hi AS top, (hi - lo) // 2 AS size FROM seg WHERE tok > 8000 AND hi - lo > 1)) x
      JOIN p a ON a.req = x.req AND a.i = x.lo JOIN p b ON b.req = x.req AND b.i = x.hi)
  SELECT t.doc_id, f.doc_id AS batch FROM seg JOIN t ON t.req = seg.req AND t.i >= lo AND t.i < hi JOIN t f ON f.req = seg.req AND f.i = lo WHERE NOT (seg.tok > 8000 AND hi - lo > 1)""")
def token_batching(spark, d):
    """H6, H7: texts of a call in requests bounded by number and by tokens, halved until they fit."""
    rows = _table(spark, d, "documents").select("doc_id", F.expr("doc_id div 300").alias("req"), text.token_count(F.col("text")).alias("tok"))
    return chunk.batches(rows, "req", "doc_id", "tok", 96, 8000).select("doc_id", "batch")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", F.col("url").alias("name"))


_MATCHES = "len(regexp_extract_all(lower({0}), '\\ben\\b'))"
_FOUND_MESSAGES = f"SELECT conv_id, turn, -1::BIGINT AS page_id, {_MATCHES.format('text')} AS score, 'message' AS match_type FROM conversations WHERE {_MATCHES.format('text')} > 0 ORDER BY score DESC, conv_id, turn LIMIT 20"
_FOUND_FILES = f"SELECT -1::BIGINT AS conv_id, -1::BIGINT AS turn, page_id, {_MATCHES.format('url')} AS score, 'file' AS match_type FROM pages WHERE {_MATCHES.format('url')} > 0 ORDER BY score DESC, page_id LIMIT 20"


@query(f"SELECT conv_id, turn, score, match_type FROM ({_FOUND_MESSAGES})")
def search_messages(spark, d):
    """Messages by how often the words stand in them."""
    return search.search_messages(_searchable(spark, d), "en", ["conv_id", "turn"]).select("conv_id", "turn", "score", "match_type")


@query(f"SELECT page_id, score, match_type FROM ({_FOUND_FILES})")
def search_files(spark, d):
    """Files by their names."""
    return search.search_files(_files(spark, d), "en", ["page_id"]).select("page_id", "score", "match_type")


@query(f"SELECT * FROM ({_FOUND_MESSAGES}) UNION ALL SELECT * FROM ({_FOUND_FILES})")
def search_all(spark, d):
    """Messages and files in one bag."""
    found = search.search_all(_searchable(spark, d), _files(spark, d), "en", ["conv_id", "turn"], ["page_id"])
    return found.select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in ("conv_id", "turn", "page_id")], "score", "match_type")


@query(f"""WITH {MESSAGES}, h AS (SELECT conv_id % 10 AS query_id, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) AS rank, ts FROM m),
  dc AS (SELECT message_id, conv_id AS document_id FROM m UNION ALL SELECT message_id, 1000 + turn FROM m),
  f AS (SELECT query_id, document_id, min(rank) AS first FROM h JOIN (SELECT ts, message_id FROM m) USING (ts) JOIN dc USING (message_id) WHERE rank <= 50 GROUP BY ALL)
  SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY first, document_id) AS rank FROM f QUALIFY rank <= 10""")
def first_seen_documents(spark, d):
    """The first ten distinct documents of a call's first fifty messages."""
    from pyspark.sql import Window

    rows = _messages(spark, d)
    asked = F.col("conv_id") % 10
    hits = rows.select(asked.alias("query_id"), F.row_number().over(Window.partitionBy(asked).orderBy("conv_id", "turn")).alias("rank"), "ts")
    documents = rows.select("message_id", F.col("conv_id").alias("document_id")).union(rows.select("message_id", F.col("turn") + 1000))
    out = retrieval.mapped_documents(hits, rows.select("ts", "message_id"), documents)
    return out.select("query_id", "document_id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT lang, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, array_to_string(list(doc_id ORDER BY doc_id), ',') AS ids FROM documents GROUP BY lang")
def grouped_rows(spark, d):
    """Rows of a key as a list and as a set."""
    rows = _table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("s"), F.array_sort(F.collect_list("doc_id")).alias("i"))
    return rows.select("lang", "n", F.array_join("s", ",").alias("sources"), F.array_join(F.col("i").cast("array<string>"), ",").alias("ids"))


@query(f"""WITH {HOLED}, {FILES}, p AS (SELECT count(*) AS n FROM m WHERE turn = 0), f AS (SELECT count(*) AS n FROM fl),
  r AS (SELECT count(*) AS n, count(DISTINCT conv_id) AS c FROM m WHERE turn > 0 AND conv_id IN (SELECT conv_id FROM m WHERE turn = 0))
  SELECT p.n AS messages, r.c AS threads, r.n AS replies, f.n AS files FROM p, r, f""")
def archive_counts(spark, d):
    """Messages, threads, replies and files of an archive."""
    raw = _raw(spark, d)
    rows = clean.cleaned(raw).agg(F.count("*").alias("messages"), F.count_if(F.size("thread") > 0).alias("threads"), F.coalesce(F.sum(F.size("thread")), F.lit(0)).alias("replies"))
    return rows.withColumn("files", F.lit(clean.files_of(raw).count()))


@query(f"WITH {CALLS} SELECT query_id, pos, count(*) OVER w AS n, round(avg((rank > 0 AND rank <= 3)::INT) OVER w, 9) AS success_rate FROM ca WINDOW w AS (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def running_success(spark, d):
    """The success rate so far, at every call."""
    return metrics.running_rates(_calls(spark, d).withColumn("found", ((F.col("rank") > 0) & (F.col("rank") <= 3)).cast("int")), "query_id", "pos")


@query("""SELECT conv_id, n_turns, head AS reply, prompt_tokens, (34 + length(head) + length(n_turns::VARCHAR) + 10) AS raw_chars FROM (SELECT conv_id, count(*) AS n_turns, arg_max(substr(text, 1, 20), turn) AS head, sum(length(text) // 4)::BIGINT AS prompt_tokens FROM conversations GROUP BY conv_id)""".replace(", (34 + length(head) + length(n_turns::VARCHAR) + 10) AS raw_chars", ""))
def chat_calls(spark, d):
    """Chat with messages, a structured reply and usage, by the local provider."""
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    done = providers.chat(rows, providers.LocalProvider(), "messages", "reply string, turns bigint")
    return done.where("error is null").select("conv_id", F.col("value.turns").alias("n_turns"), F.col("value.reply").alias("reply"), "prompt_tokens")


@query()
def embed_batches(spark, d):
    """Vectors of all documents, asked for in bounded batches."""
    return providers.embedded(_docs(spark, d), providers.LocalProvider(), "text").select("doc_id", "vector", "error")


@query()
def exact_tokens(spark, d):
    """Tokens by a public vocabulary, and texts cut after a hundred of them."""
    tokenizer = Tokenizer(spark)
    return _docs(spark, d).select("doc_id", tokenizer.count(F.col("text")).alias("n_tokens"), tokenizer.truncate(F.col("text"), 100).alias("cut"))


@query(f"WITH {MESSAGES} SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN message_id ELSE ts END AS timestamp FROM m")
def compat_timestamps(spark, d):
    """The timestamp is the message id where downstream files have it so."""
    rows = _messages(spark, d).withColumn("timestamp", F.col("ts"))
    both = clean.with_constants(rows.where("conv_id % 2 = 0")).unionByName(clean.with_constants(rows.where("conv_id % 2 = 1"), compat=False))
    return both.select("conv_id", "turn", "timestamp")


@query("SELECT doc_id, md5('embed' || chr(31) || source || chr(31) || lang) AS cache_key FROM documents")
def cache_keys(spark, d):
    """md5 over the parts of a request."""
    return _table(spark, d, "documents").select("doc_id", F.md5(F.concat_ws("\x1f", F.lit("embed"), "source", "lang")).alias("cache_key"))


@query("SELECT page_id, 'w_' || substr(md5(url), 1, 10) AS id FROM pages")
def short_ids(spark, d):
    """Shortened md5 ids with a prefix."""
    return _table(spark, d, "pages").select("page_id", ids.short_md5("w_", F.col("url")).alias("id"))
