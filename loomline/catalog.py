"""Every registered query of the library proper, by name, with its SQL.

The tables stand in for an archive: a conversation is a channel and its turns the
messages (or a thread, turn 0 its parent), documents are the corpus, labels the
judgements, embeddings the vectors, benchmark texts the search queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, text
from .operators import chunk, clean, export, metrics, retrieval, search
from .plans import dataset, providers

FLAGSHIP = "hybrid_recall"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUDGET = 400


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ messages

EPOCH = 1690000000
SPACES = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as messages: an epoch string per turn, the message id from text and time."""
    ts = F.concat((F.lit(EPOCH) + F.col("conv_id") * 1000 + F.col("turn")).cast("string"), F.lit(".000000"))
    rows = _table(spark, d, "conversations").where("text is not null")
    rows = rows.select("conv_id", "turn", "role", "text", ts.alias("ts"))
    return rows.withColumn("message_id", ids.message_id(F.col("text"), F.col("ts")))


MESSAGES = f"""m AS (
  SELECT conv_id, turn, role, text, ts,
    substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'
      ||substr('89ab', (position(substr(h,17,1) IN '0123456789abcdef')::INT - 1) % 4 + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS message_id
  FROM (SELECT *, sha1(unhex('{ids.NAMESPACE_DNS}') || encode(text || ':' || regexp_replace(ts, '\\.000000$', '.0'))) AS h
        FROM (SELECT conv_id, turn, role, text, ({EPOCH} + conv_id*1000 + turn)::VARCHAR || '.000000' AS ts
              FROM conversations WHERE text IS NOT NULL)))"""


def _parents(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a parent without replies, the conversation as its channel."""
    empty = F.array().cast("array<struct<message_id:string,user:string,timestamp:string,text:string>>")
    return _messages(spark, d).select(
        F.col("conv_id").cast("string").alias("channel_id"), F.concat(F.lit("c"), "conv_id").alias("channel_name"), F.col("turn").alias("pos"),
        "message_id", F.col("role").alias("user"), F.col("ts").alias("timestamp"), "text", empty.alias("thread"),
    )


def _threads(spark: SparkSession, d: str) -> DataFrame:
    """Turn 0 as a parent and the later turns as its replies."""
    rows = _messages(spark, d)
    reply = F.struct("turn", "message_id", F.col("role").alias("user"), F.col("ts").alias("timestamp"), "text")
    replies = rows.where("turn > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(reply)).alias("thread"))
    none = F.array().cast("array<struct<turn:bigint,message_id:string,user:string,timestamp:string,text:string>>")
    parents = rows.where("turn = 0").join(replies, "conv_id", "left")
    return parents.select(
        F.col("conv_id").cast("string").alias("channel_id"), F.concat(F.lit("c"), "conv_id").alias("channel_name"), F.col("turn").alias("pos"),
        "message_id", F.col("role").alias("user"), F.col("ts").alias("timestamp"), "text", F.coalesce("thread", none).alias("thread"),
    )


@query("SELECT conv_id, turn, 'unknown' AS \"user\", length(text) AS n_chars FROM conversations WHERE text IS NOT NULL")
def clean_messages(spark, d):
    """Messages with text, constant user."""
    return clean.with_constants(_messages(spark, d)).select("conv_id", "turn", "user", F.length("text").cast("bigint").alias("n_chars"))


@query(f"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '[^{SPACES}]')")
def blank_filter(spark, d):
    """C4: messages that are not white space alone."""
    return clean.without_blanks(_messages(spark, d)).select("conv_id", "turn")


@query(f"WITH {MESSAGES} SELECT conv_id, turn, ts, message_id FROM m")
def message_uuid5(spark, d):
    """Identity of messages by uuid5."""
    return _messages(spark, d).select("conv_id", "turn", "ts", "message_id")


@query("SELECT doc_id, 'd_' || substr(md5('doc_' || doc_id), 1, 10) AS id FROM documents")
def doc_md5_id(spark, d):
    """Shortened md5 ids."""
    return _table(spark, d, "documents").select("doc_id", ids.short_md5("d_", F.concat(F.lit("doc_"), "doc_id")).alias("id"))


@query("SELECT md5_id AS id, count(DISTINCT doc_id) AS n_texts FROM (SELECT doc_id, 'd_' || substr(md5(doc_id::VARCHAR), 1, 3) AS md5_id FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def id_collisions(spark, d):
    """T-21: shortened ids that stand for several texts; three digits here, so that some do."""
    rows = _table(spark, d, "documents").select(F.col("doc_id"), ids.short_md5("d_", F.col("doc_id").cast("string"), 3).alias("id"))
    return export.collisions(rows, "doc_id")


@query("SELECT conv_id, turn, ts FROM (SELECT conv_id, turn, make_timestamp((1690000000 + conv_id*1000 + turn) * 1000000) AS ts FROM conversations WHERE text IS NOT NULL)")
def epoch_timestamps(spark, d):
    """Epoch strings as exact timestamps."""
    return _messages(spark, d).select("conv_id", "turn", ids.ts_micros(F.col("ts")).alias("ts"))


@query("SELECT date_trunc('minute', ts) AS ts, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def fd_check_ts(spark, d):
    """Times, in minutes, that stand with more than one value."""
    return clean.dependency_breaks(_table(spark, d, "events").withColumn("ts", F.date_trunc("minute", "ts")), "ts", "event_type")


@query(f"""WITH {MESSAGES}, n AS (SELECT conv_id, count(*) FILTER (WHERE turn > 0) AS n_replies, any_value(message_id) FILTER (WHERE turn = 0) AS parent FROM m GROUP BY conv_id)
  SELECT conv_id || '_' || message_id || CASE WHEN turn = 0 THEN '_msg' ELSE '_reply' END AS chunk_id, text AS content, length(text) // 4 AS token_count, CASE WHEN turn = 0 THEN n_replies ELSE 0 END AS reply_count,
    CASE WHEN turn > 0 THEN parent END AS parent_message_id, message_id, role AS "user", ts AS "timestamp", turn = 0 AND n_replies > 0 AS is_thread_parent, turn > 0 AS is_thread_reply FROM m JOIN n USING (conv_id) WHERE turn = 0 OR parent IS NOT NULL""")
def chunk_individual(spark, d):
    """A chunk per parent and per reply."""
    return chunk.individual(_threads(spark, d)).select(
        "chunk_id", "content", "token_count", "reply_count", "parent_message_id", "message_id", "user", "timestamp", "is_thread_parent", "is_thread_reply"
    )


@query(f"""WITH {MESSAGES}, p AS (SELECT * FROM m WHERE turn = 0),
  r AS (SELECT conv_id, string_agg('[Reply by ' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS body, count(*) AS n, list(DISTINCT role) AS roles, string_agg(message_id, ',' ORDER BY turn) AS reply_ids FROM m WHERE turn > 0 GROUP BY conv_id),
  j AS (SELECT p.conv_id, p.message_id, p.role, p.ts, p.text, r.body, r.reply_ids, coalesce(r.n, 0) AS reply_count, list_sort(list_distinct(list_concat([p.role], coalesce(r.roles, [])))) AS people FROM p LEFT JOIN r USING (conv_id)),
  c AS (SELECT *, CASE WHEN reply_count > 0 THEN '[Original Message by ' || role || ']' || chr(10) || text || chr(10) || chr(10) || body ELSE text END AS content FROM j)
  SELECT conv_id || '_' || message_id || CASE WHEN reply_count > 0 THEN '_thread' ELSE '_standalone' END AS chunk_id, content, length(content) // 4 AS token_count, reply_count, array_to_string(people, ',') AS participants,
    CASE WHEN reply_count > 0 THEN message_id END AS parent_message_id, reply_ids AS reply_message_ids, reply_count = 0 AS is_standalone, CASE WHEN reply_count = 0 THEN message_id END AS message_id, CASE WHEN reply_count = 0 THEN role END AS "user", CASE WHEN reply_count = 0 THEN ts END AS "timestamp" FROM c""")
def chunk_thread(spark, d):
    """D3: a parent with its replies as one text."""
    return chunk.threads(_threads(spark, d)).select(
        "chunk_id", "content", "token_count", "reply_count", "participants", "parent_message_id", "reply_message_ids", "is_standalone", "message_id", "user", "timestamp"
    )


WINDOWS = f"""{MESSAGES}, o AS (SELECT *, length(text) // 4 AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM m),
  w AS (
    SELECT conv_id, i, tok > {BUDGET} AS truncated, 0::BIGINT AS win, CASE WHEN tok > {BUDGET} THEN 1 ELSE 0 END::BIGINT AS nxt, CASE WHEN tok > {BUDGET} THEN 0 ELSE tok END::BIGINT AS used, tok <= {BUDGET} AS is_open FROM o WHERE i = 1
    UNION ALL
    SELECT o.conv_id, o.i, o.tok > {BUDGET},
      CASE WHEN o.tok > {BUDGET} THEN w.nxt + w.is_open::INT WHEN w.is_open AND w.used + o.tok > {BUDGET} THEN w.nxt + 1 ELSE w.nxt END,
      CASE WHEN o.tok > {BUDGET} THEN w.nxt + w.is_open::INT + 1 WHEN w.is_open AND w.used + o.tok > {BUDGET} THEN w.nxt + 1 ELSE w.nxt END,
      CASE WHEN o.tok > {BUDGET} THEN 0 WHEN w.is_open AND w.used + o.tok > {BUDGET} THEN o.tok ELSE w.used + o.tok END,
      o.tok <= {BUDGET}
    FROM w JOIN o ON o.conv_id = w.conv_id AND o.i = w.i + 1)"""


@query(f"WITH RECURSIVE {WINDOWS} SELECT o.conv_id::VARCHAR AS channel_id, o.turn AS pos, w.win AS \"window\", w.truncated FROM w JOIN o USING (conv_id, i)")
def chunk_token_windows(spark, d):
    """Greedy packing under a token budget, as a stream per channel."""
    return chunk.window_numbers(_parents(spark, d), BUDGET).select("channel_id", "pos", "window", "truncated")


@query(f"WITH RECURSIVE {WINDOWS} SELECT o.conv_id::VARCHAR AS channel_id, o.turn AS pos, w.win AS \"window\", w.truncated FROM w JOIN o USING (conv_id, i)")
def chunk_token_windows_fold(spark, d):
    """The same packing as a fold without Python."""
    return chunk.folded_window_numbers(_parents(spark, d), BUDGET)


@query(f"""WITH RECURSIVE {WINDOWS}, b AS (SELECT o.conv_id, w.win, o.turn, o.ts, w.truncated,
    CASE WHEN w.truncated THEN substr(text, 1, floor({float(BUDGET)}::DOUBLE * (length(text)::DOUBLE / tok::DOUBLE) * 0.9::DOUBLE)::INT) || '...' ELSE '[Message by ' || role || ' at ' || ts || ']' || chr(10) || text END AS line FROM w JOIN o USING (conv_id, i)),
  g AS (SELECT conv_id, win, string_agg(line, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS content, count(*) AS message_count, arg_min(ts, turn) AS start_timestamp, arg_max(ts, turn) AS end_timestamp, bool_or(truncated) AS truncated, bool_or(turn % 7 = 3) AS has_threaded_messages FROM b GROUP BY ALL)
  SELECT conv_id || '_window_' || win AS chunk_id, content, length(content) // 4 AS token_count, message_count, start_timestamp, end_timestamp, truncated, has_threaded_messages FROM g""")
def window_render(spark, d):
    """Windows as texts, messages over the budget cut; every seventh message stands as one with a thread."""
    reply = F.array(F.struct("message_id", "timestamp", "text"))
    rows = _parents(spark, d).withColumn("thread", F.when(F.col("pos") % 7 == 3, reply).otherwise(F.slice(reply, 1, 0)))
    return chunk.windows(rows, BUDGET).select("chunk_id", "content", "token_count", "message_count", "start_timestamp", "end_timestamp", "truncated", "has_threaded_messages")


@query("SELECT doc_id, CASE WHEN length(text) // 4 > 100 THEN substr(text, 1, floor(100.0::DOUBLE * (length(text)::DOUBLE / (length(text) // 4)::DOUBLE) * 0.9::DOUBLE)::INT) || '...' ELSE text END AS cut FROM documents")
def window_truncated(spark, d):
    """Texts over a budget of 100 tokens cut."""
    return _table(spark, d, "documents").select("doc_id", text.truncate_to_tokens(F.col("text"), 100).alias("cut"))


@query("""WITH c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR lag(turn) OVER w IS NULL THEN 1 ELSE 0 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  r AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
  SELECT conv_id, run::BIGINT AS run, role, string_agg(text, chr(10) ORDER BY turn) AS content, count(*) AS n_turns FROM r GROUP BY conv_id, run, role""")
def merge_consecutive_roles(spark, d):
    """Runs of turns of one role as one."""
    return chunk.merged_turns(_table(spark, d, "conversations")).select("conv_id", "run", "role", "content", "n_turns")


@query("SELECT source, count(*) AS n_docs, sum(length(text) // 4)::BIGINT AS n_tokens, sum(strlen(text) + 150)::BIGINT AS n_billed FROM documents GROUP BY source")
def token_counts(spark, d):
    """Estimated tokens and billed bytes per source."""
    rows = _table(spark, d, "documents")
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(text.token_count(F.col("text"))).alias("n_tokens"), F.sum(F.octet_length("text") + 150).cast("bigint").alias("n_billed"))


@query("SELECT doc_id, replace(substr(text, 1, 100), chr(10), ' ') || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview FROM documents")
def text_previews(spark, d):
    """The first characters on one line."""
    return _table(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("SELECT event_id, regexp_extract('reply: ' || props || ' end', '(?s)\\{.*\\}') AS body FROM events")
def json_extract_action(spark, d):
    """The JSON object in free text."""
    reply = F.concat(F.lit("reply: "), "props", F.lit(" end"))
    return _table(spark, d, "events").select("event_id", text.json_object_text(reply).alias("body"))


@query("SELECT event_id, props AS body FROM events")
def strip_code_fences(spark, d):
    """C14: a fenced reply without its fences."""
    reply = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return _table(spark, d, "events").select("event_id", text.strip_fences(reply).alias("body"))


@query("SELECT page_id, translate(url, '/\\', '__') AS safe FROM pages")
def sanitised_names(spark, d):
    """Names that are safe as paths."""
    return _table(spark, d, "pages").select("page_id", text.sanitised(F.col("url")).alias("safe"))


@query("SELECT vec_id, round(1.0 / (1.0 + exp(-(embedding[1]::DOUBLE) / 5.0)), 9) AS score FROM embeddings")
def score_squash(spark, d):
    """scores into 0..1."""
    return _table(spark, d, "embeddings").select("vec_id", F.round(text.squashed(F.col("embedding")[0].cast("double")), 9).alias("score"))


# ------------------------------------------------------------------ export

PERSONA_SQL = "['technical_expert','beginner','typo_prone','vague','precise','casual_manager','international_esl']"
PAIRS = f"""pairs AS (SELECT doc_id AS pos, 'chunk_' || (doc_id % 97) AS chunk_id, substr(text, 1, 40) AS query,
  {PERSONA_SQL}[('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::INT % 7 + 1] AS persona FROM documents)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as query and chunk pairs with a hashed persona."""
    pick = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("int") % 7 + 1
    return _table(spark, d, "documents").select(
        F.col("doc_id").alias("pos"), F.concat(F.lit("chunk_"), F.col("doc_id") % 97).alias("chunk_id"), F.substring("text", 1, 40).alias("query"),
        F.element_at(F.array(*map(F.lit, providers.PERSONAS)), pick).alias("persona"), F.col("text").alias("content"),
    )


@query("SELECT 'd_' || substr(md5(chunk_id), 1, 10) AS id, chunk_id, arg_max(text, doc_id) AS content FROM (SELECT doc_id, text, 'chunk_' || (doc_id % 97) AS chunk_id FROM documents) GROUP BY chunk_id")
def export_documents(spark, d):
    """Documents by chunk id, the last repeat counts."""
    return export.documents(_pairs(spark, d))


@query(f"WITH {PAIRS} SELECT 'q_' || substr(md5(query), 1, 10) AS id, query, arg_min(persona, pos) AS persona FROM pairs GROUP BY query")
def export_queries(spark, d):
    """One row per query text, the first persona wins."""
    return export.queries(_pairs(spark, d))


@query(f"WITH {PAIRS} SELECT 'q_' || substr(md5(query), 1, 10) AS query_id, 'd_' || substr(md5(chunk_id), 1, 10) AS document_id, 1.0::DOUBLE AS score FROM pairs")
def export_qrels(spark, d):
    """Judgements of the export."""
    return export.qrels(_pairs(spark, d))


@query(f"""WITH {PAIRS}, q AS (SELECT DISTINCT query FROM pairs), dd AS (SELECT DISTINCT chunk_id FROM pairs WHERE pos % 2 = 0)
  SELECT (SELECT count(*) FROM q) AS n_queries, (SELECT count(*) FROM dd) AS n_documents, (SELECT count(*) FROM pairs) AS n_qrels, 0::BIGINT AS missing_queries,
    (SELECT count(*) FROM pairs WHERE chunk_id NOT IN (SELECT chunk_id FROM dd)) AS missing_documents""")
def export_integrity(spark, d):
    """Judgements against queries and a document table that lacks some."""
    pairs = _pairs(spark, d)
    return export.integrity(export.qrels(pairs), export.queries(pairs), export.documents(pairs.where("pos % 2 = 0")))


@query(f"WITH {PAIRS} SELECT persona, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM pairs), 6) AS percent FROM pairs GROUP BY persona")
def persona_distribution(spark, d):
    """Personas by share."""
    return export.persona_distribution(_pairs(spark, d))


@query(f"WITH {PAIRS} SELECT round(count(*)::DOUBLE / count(DISTINCT query), 6) AS per_query, round(count(*)::DOUBLE / count(DISTINCT chunk_id), 6) AS per_document FROM pairs")
def export_density(spark, d):
    """Judgements per query and per document."""
    pairs = _pairs(spark, d)
    return export.density(export.qrels(pairs), export.queries(pairs), export.documents(pairs))


@query("""SELECT pos, chunk_id, CASE WHEN n % 3 = 0 THEN 'sliding_window' WHEN n % 3 = 1 THEN 'individual_message' ELSE 'thread' END AS chunk_type
  FROM (SELECT doc_id AS pos, 'chunk_' || (doc_id % 97) AS chunk_id, doc_id % 97 AS n FROM documents) WHERE n < 60""")
def pair_strategy(spark, d):
    """E5: each pair's chunk in the first strategy that has it; every strategy after it has it too."""
    pairs = _pairs(spark, d).select("pos", "chunk_id")
    ids_ = spark.range(60).withColumn("k", F.explode(F.sequence(F.col("id") % 3, F.lit(2))))
    kind = F.element_at(F.array(*map(F.lit, export.STRATEGIES)), F.col("k").cast("int") + 1)
    chunks = ids_.select(F.concat(F.lit("chunk_"), "id").alias("chunk_id"), kind.alias("chunk_type"), F.lit("x").alias("content"))
    return export.with_strategy(pairs, chunks).select("pos", "chunk_id", "chunk_type")


# ------------------------------------------------------------------ joins and resume


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F' AND o_orderkey % 3 = 0)")
def resume_anti_join(spark, d):
    """Rows without a stored result; a part of the orders stands for results."""
    done = _table(spark, d, "orders").where("o_custkey is not null and o_orderstatus = 'F' and o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return export.not_done(_table(spark, d, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey, coalesce(c_mktsegment, '') AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def hash_lookup_left(spark, d):
    """A lookup with an empty default."""
    side = _table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return _table(spark, d, "orders").join(side, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("")).alias("segment"))


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def hash_lookup_inner(spark, d):
    """A lookup that drops what it does not find."""
    side = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return _table(spark, d, "lineitem").join(side, "l_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_membership(spark, d):
    """Membership tests as a semi join."""
    return _table(spark, d, "documents").join(_table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id, round(avg(CASE WHEN quality IS NULL THEN 0.0 ELSE 1.0 END) OVER (), 9) AS rate FROM documents LEFT JOIN labels USING (doc_id)".replace("SELECT doc_id, round(avg(CASE WHEN quality IS NULL THEN 0.0 ELSE 1.0 END) OVER (), 9)", "SELECT round(avg(CASE WHEN quality IS NULL THEN 0.0 ELSE 1.0 END), 9)"))
def mapping_hit_rate(spark, d):
    """The share of rows that a mapping finds."""
    rows = _table(spark, d, "documents").join(_table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return metrics.mapping_rate(rows, "quality")


# ------------------------------------------------------------------ retrieval


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
TERMS = "qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(substr(text, 1, 1024)), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark)"
BM25 = f"""dw AS (SELECT doc_id, {WORDS} AS w FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM dw),
  tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dw) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  wt AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM tf JOIN df USING (term), st)"""
KEYS = "ky AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS pos, term FROM qt JOIN df USING (term) WHERE length(term) > 2 QUALIFY pos <= 3)"
LISTS = """ls AS (SELECT query_id, pos AS list_id, rank, doc_id FROM ky JOIN (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY round(weight, 6) DESC, doc_id) AS rank FROM wt WHERE term IN (SELECT term FROM ky)) USING (term) WHERE rank <= 100)"""
FUSED = """fu AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f.l, f.r) AS rank
  FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / ({k} + rank)), 9) AS score, min({{'l': list_id, 'r': rank}}) AS f FROM ls GROUP BY query_id, doc_id))"""
GOOD = "qr AS (SELECT item_id AS query_id, doc_id, 1.0::DOUBLE AS score FROM benchmark, labels WHERE quality = 1)"


@query(f"WITH {TERMS}, {BM25} SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, round(sum(weight), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(weight), 6) DESC, doc_id) AS rank FROM wt JOIN qt USING (term) GROUP BY query_id, doc_id) WHERE rank <= 100")
def bm25_topk(spark, d):
    """the 100 best documents per benchmark text."""
    out = retrieval.bm25_top_k(_docs(spark, d), _asked(spark, d), 100)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {TERMS}, {BM25}, {KEYS} SELECT query_id, pos, term FROM ky")
def keyword_extract(spark, d):
    """the rarest words of each query."""
    return retrieval.keywords(_docs(spark, d), _asked(spark, d)).select("query_id", F.col("pos").cast("bigint").alias("pos"), "term")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return retrieval.keyword_lists(docs, retrieval.keywords(docs, _asked(spark, d)))


@query(f"WITH {TERMS}, {BM25}, {KEYS}, {LISTS} SELECT query_id, list_id, rank, doc_id FROM ls")
def keyword_fanout(spark, d):
    """a ranked list per keyword."""
    return _lists(spark, d).select("query_id", F.col("list_id").cast("bigint").alias("list_id"), F.col("rank").cast("bigint").alias("rank"), "doc_id")


def _fusion(k: int) -> str:
    return f"WITH {TERMS}, {BM25}, {KEYS}, {LISTS}, {FUSED.format(k=k)} SELECT query_id, doc_id, score, rank FROM fu"


def _ranked(run: DataFrame) -> DataFrame:
    return run.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(_fusion(60))
def rrf_k60(spark, d):
    """fusion of keyword lists, k 60."""
    return _ranked(retrieval.fused(_lists(spark, d), 60))


@query(_fusion(9))
def rrf_offset10(spark, d):
    """fusion with offset 10 from rank 0, that is k 9."""
    return _ranked(retrieval.fused(_lists(spark, d), 9))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


DOTS = """vs AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, q.label = v.label AS same, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
  vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= 100)"""


def _vector_run(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return retrieval.vector_top_k(rows, rows.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 100)


@query(f"WITH {DOTS} SELECT query_id, doc_id, score, rank FROM vt")
def vector_topk(spark, d):
    """exact nearest vectors of every hundredth vector, among all."""
    return _ranked(_vector_run(spark, d))


BM25_RUN = "bm AS (SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(weight), 6) DESC, doc_id) AS rank FROM wt JOIN qt USING (term) GROUP BY query_id, doc_id) WHERE rank <= 100)"
OVERLAP = """ov AS (SELECT bm.query_id, bm.doc_id, bm.rank AS old_rank, round(len(list_intersect(qw, dd))::DOUBLE / len(qw), 6) AS share FROM bm
    JOIN (SELECT query_id, list(term) AS qw FROM (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY query_id) USING (query_id)
    JOIN (SELECT doc_id, list_distinct(w) AS dd FROM dw) USING (doc_id))"""


def _bm25_run(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_top_k(_docs(spark, d), _asked(spark, d), 100)


@query(f"WITH {TERMS}, {BM25}, {BM25_RUN}, {OVERLAP} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY squash DESC, old_rank) AS rank, squash AS score FROM (SELECT *, round(1.0 / (1.0 + exp(-share * 10 / 5.0)), 6) AS squash FROM ov)")
def rerank_sigmoid(spark, d):
    """a BM25 run reranked by squashed scores of its texts, ties in their old order."""
    run = retrieval.with_texts(_bm25_run(spark, d), _asked(spark, d), _docs(spark, d))
    score = F.round(text.squashed(retrieval.shared_words(F.col("query"), F.col("content")) * 10), 6)
    return _ranked(retrieval.reranked(run.select("query_id", "doc_id", "rank"), run.select("query_id", "doc_id", score.alias("score"))))


@query(f"WITH {TERMS}, {BM25}, {BM25_RUN}, {OVERLAP}, rr AS (SELECT query_id, doc_id, old_rank, share AS score, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, old_rank) AS rank FROM ov QUALIFY rank <= 10) SELECT query_id, doc_id, score, rank, row_number() OVER (PARTITION BY query_id ORDER BY old_rank) - 1 AS \"index\" FROM rr")
def rerank_run(spark, d):
    """A run's texts fetched and scored, the ten best kept, numbered as they went in."""
    run = retrieval.with_texts(_bm25_run(spark, d), _asked(spark, d), _docs(spark, d))
    scores = run.select("query_id", "doc_id", retrieval.shared_words(F.col("query"), F.col("content")).alias("score"))
    out = retrieval.in_input_order(retrieval.reranked(run.select("query_id", "doc_id", "rank"), scores, top_k=10))
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"), "index")


@query(f"""WITH {TERMS}, {BM25}, {BM25_RUN}, sc AS (SELECT query_id, doc_id, bm.rank AS old_rank, coalesce(round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6), 0) AS score
    FROM bm LEFT JOIN embeddings q ON q.vec_id = query_id LEFT JOIN embeddings v ON v.vec_id = doc_id)
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank FROM sc""")
def rerank_by_embedding(spark, d):
    """a BM25 run reranked by dot products; a document without a vector counts 0."""
    run, rows = _bm25_run(spark, d).select("query_id", "doc_id", "rank"), _vectors(spark, d).select("doc_id", "vector")
    met = run.join(rows, "doc_id").join(rows.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("asked")), "query_id")
    scores = met.select("query_id", "doc_id", F.round(retrieval.dot(F.col("vector"), F.col("asked")), 6).alias("score"))
    return _ranked(retrieval.reranked(run, scores))


PAIRED = """pv AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT item_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v) QUALIFY rank <= 100),
  ls AS (SELECT query_id, 1 AS list_id, rank, doc_id FROM pv UNION ALL SELECT query_id, 2, rank, doc_id FROM bm)"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Each query's vector list and BM25 list, fused; a document's vector has its number, a query's its item's."""
    rows, asked = _vectors(spark, d), _asked(spark, d)
    near = retrieval.vector_top_k(rows, asked.join(rows.select(F.col("doc_id").alias("query_id"), "vector"), "query_id").select("query_id", "vector"), 100)
    lists = [run.select("query_id", F.lit(i).alias("list_id"), "rank", "doc_id") for i, run in ((1, near), (2, _bm25_run(spark, d)))]
    return retrieval.fused(lists[0].union(lists[1]), 60)


@query(f"WITH {TERMS}, {BM25}, {BM25_RUN}, {PAIRED}, {FUSED.format(k=60)} SELECT query_id, doc_id, score, rank FROM fu")
def hybrid_rrf(spark, d):
    """100 nearest vectors and 100 BM25 hits of each query, fused."""
    return _ranked(_hybrid(spark, d))


@query(f"WITH {TERMS}, {BM25}, {BM25_RUN}, {PAIRED}, {FUSED.format(k=60)}, {GOOD} SELECT query_id, round(sum(CASE WHEN rank <= 20 THEN qr.score ELSE 0 END) / sum(qr.score), 9) AS recall FROM qr LEFT JOIN fu USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM fu) GROUP BY query_id")
def hybrid_rrf_recall(spark, d):
    """L2, G1: recall at 20 of the fused vector and BM25 lists."""
    return metrics.recall_at_k(_hybrid(spark, d), _judged(spark, d), 20)


# ------------------------------------------------------------------ metrics


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Documents of good quality, judged relevant to every query: without a query_id."""
    return _table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(1.0).alias("score"))


@query(f"WITH {TERMS}, {BM25}, {KEYS}, {LISTS}, {FUSED.format(k=60)}, {GOOD} SELECT query_id, round(sum(CASE WHEN rank <= 20 THEN qr.score ELSE 0 END) / sum(qr.score), 9) AS recall FROM qr LEFT JOIN fu USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM fu) GROUP BY query_id")
def hybrid_recall(spark, d):
    """L2, G1: keyword lists fused, then recall at 20 against the labels."""
    run = retrieval.fused(_lists(spark, d))
    return metrics.recall_at_k(run, _judged(spark, d), 20)


RELEVANT = "SELECT query_id, coalesce(min(CASE WHEN same AND query_id <> doc_id THEN rank END), 0) AS first_rank FROM vt GROUP BY query_id"


def _same_label(spark: SparkSession, d: str, run: DataFrame) -> DataFrame:
    """Of a run's rows those whose query and document share a label: judgements, without all pairs of a label."""
    labels = _vectors(spark, d).select("doc_id", "label")
    met = run.select("query_id", "doc_id").join(labels, "doc_id").join(labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("asked")), "query_id")
    return met.where("label = asked and query_id != doc_id").select("query_id", "doc_id", F.lit(1.0).alias("score"))


def _label_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select("doc_id", "label")
    sizes = rows.groupBy("label").agg((F.count("*") - 1).cast("double").alias("total"))
    return rows.where("doc_id % 100 = 0").join(sizes, "label").select(F.col("doc_id").alias("query_id"), "total")


@query(f"WITH {DOTS}, n AS (SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1) SELECT query_id, round(count(*) FILTER (same AND query_id <> doc_id AND rank <= 20)::DOUBLE / n, 9) AS recall FROM vt JOIN n USING (query_id) GROUP BY query_id, n")
def recall_at_k(spark, d):
    """G1: share of a vector's label found in the first 20."""
    run = _vector_run(spark, d)
    return metrics.recall_at_k(run, _same_label(spark, d, run), 20, _label_totals(spark, d))


@query(f"WITH {DOTS} SELECT query_id, first_rank, CASE WHEN first_rank BETWEEN 1 AND 20 THEN 1 ELSE 0 END::BIGINT AS hit_20 FROM ({RELEVANT})")
def first_relevant_rank(spark, d):
    """Rank of the first relevant vector, and whether within 20."""
    run = _vector_run(spark, d)
    return metrics.first_relevant_rank(run, _same_label(spark, d, run))


@query(f"WITH {TERMS}, {BM25}, {KEYS}, {LISTS} SELECT query_id, list_id, coalesce(min(CASE WHEN quality = 1 THEN rank END), 0) AS first_rank FROM ls LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def per_call_rank(spark, d):
    """First relevant rank of every single list."""
    lists = _lists(spark, d)
    out = metrics.per_call_rank(lists, _judged(spark, d))
    return out.select("query_id", F.col("list_id").cast("bigint").alias("list_id"), "first_rank")


@query("SELECT user_id, max(event_id % 21) AS best FROM events GROUP BY user_id")
def best_over_attempts(spark, d):
    """The best of each key's attempts."""
    return metrics.best_over_attempts(_table(spark, d, "events").withColumn("r", F.col("event_id") % 21), "user_id", "r")


@query(f"WITH {DOTS}, o AS ({RELEVANT}) SELECT count(*) AS n, round(avg((first_rank = 1)::INT), 9) AS success_rate, round(avg((first_rank BETWEEN 1 AND 20)::INT), 9) AS recall_rate, round(avg(first_rank), 9) AS mean_steps FROM o")
def success_rate(spark, d):
    """Rates over all queries."""
    run = _vector_run(spark, d)
    first = metrics.first_relevant_rank(run, _same_label(spark, d, run))
    return metrics.success_rates(first.select((F.col("first_rank") == 1).cast("int").alias("found"), F.col("hit_20").alias("hit"), F.col("first_rank").alias("steps")))


CALLS = "ca AS (SELECT user_id AS query_id, event_id AS pos, event_type || (event_id % 3) AS call, event_id % 7 AS rank FROM events)"
BEST = "be AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY b.r, b.p) AS place, call, b.r AS rank FROM (SELECT query_id, call, min({'r': rank, 'p': pos}) AS b FROM ca WHERE rank > 0 GROUP BY ALL) QUALIFY place <= 5)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), F.concat("event_type", F.col("event_id") % 3).alias("call"), (F.col("event_id") % 7).alias("rank"))


@query(f"WITH {CALLS}, {BEST} SELECT query_id, place, call, rank FROM be")
def best_calls_top5(spark, d):
    """Each query's best distinct calls."""
    return metrics.best_calls(_calls(spark, d))


@query(f"WITH {CALLS}, {BEST} SELECT n_calls, count(*) AS n_queries FROM (SELECT query_id, count(*) AS n_calls FROM be GROUP BY query_id) GROUP BY n_calls")
def calls_histogram(spark, d):
    """How many calls queries keep."""
    return metrics.calls_histogram(metrics.best_calls(_calls(spark, d)))


# ------------------------------------------------------------------ search language


def _searchable(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", "text", F.concat(F.lit("c"), "conv_id").alias("channel"), F.col("role").alias("user"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 366).cast("int")).alias("date"))


def _has(word: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^a-z0-9_])({word})($|[^a-z0-9_])')"


_FOUND = "SELECT conv_id, turn FROM (SELECT *, 'c' || conv_id AS channel, DATE '2024-01-01' + (conv_id % 366)::INT AS date FROM conversations) WHERE text IS NOT NULL AND "


@query(_FOUND + f"({_has('the')} AND NOT {_has('und')} OR {_has('die')} AND {_has('und')})")
def search_boolean(spark, d):
    """F8: words, exclusion, either, grouping."""
    return search.search(_searchable(spark, d), "(the -und) OR (die AND und)").select("conv_id", "turn")


@query(_FOUND + f"({_has('the')} <> {_has('of')})")
def search_xor(spark, d):
    """F8: exactly one of two words."""
    return search.search(_searchable(spark, d), "the XOR of").select("conv_id", "turn")


@query(_FOUND + _has("of[^a-z0-9_]+the"))
def search_phrase(spark, d):
    """F8: a phrase."""
    return search.search(_searchable(spark, d), '"of the"').select("conv_id", "turn")


@query(_FOUND + _has("th[a-z0-9_]*"))
def search_wildcard(spark, d):
    """F8: a word with a wildcard."""
    return search.search(_searchable(spark, d), "th*").select("conv_id", "turn")


@query(_FOUND + "role = 'assistant' AND date >= DATE '2024-02-01' AND date < DATE '2024-03-01' AND channel NOT IN ('c40', 'c41')")
def search_date_range(spark, d):
    """F8: user, month and channel filters."""
    return search.search(_searchable(spark, d), "from:@assistant during:2024-02 -in:#c40,#c41").select("conv_id", "turn")


@query("SELECT conv_id, turn FROM (SELECT *, length(text) AS n FROM conversations WHERE role = 'user') ORDER BY n DESC, conv_id, turn LIMIT 20 OFFSET 20")
def search_paged(spark, d):
    """the second page of a sorted result."""
    found = search.search(_searchable(spark, d), "from:user")
    return search.page(found, [F.length("text").desc(), F.col("conv_id"), F.col("turn")], 20, 2).select("conv_id", "turn")


@query("SELECT role AS \"user\", conv_id, turn, row_number() OVER w AS place, (row_number() OVER w - 1) // 100 + 1 AS page FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def search_all_pages(spark, d):
    """Every result of a key with its page."""
    return search.pages(_searchable(spark, d), "conv_id", [F.col("turn")]).select("user", "conv_id", "turn", "place", "page")


# ------------------------------------------------------------------ providers (rows only)


@query()
def llm_generate(spark, d):
    """Queries per chunk in seeded personas, by the local provider."""
    return dataset.synthetic_queries(_pairs(spark, d).select(F.concat("chunk_id", F.lit("_"), "pos").alias("chunk_id"), "content"), providers.LocalProvider()).drop("content")


@query()
def llm_validate(spark, d):
    """Generated queries that their chunk answers."""
    chunks = _pairs(spark, d).select(F.concat("chunk_id", F.lit("_"), "pos").alias("chunk_id"), "content")
    return dataset.build(chunks, spark.createDataFrame([], "chunk_id string"), providers.LocalProvider()).drop("content")


@query()
def embed_stub(spark, d):
    """F16: hashed vectors of all documents."""
    done = providers.call(_docs(spark, d), providers.LocalProvider(), "embed", ["text"])
    return done.select("doc_id", F.from_json("value", "array<double>").alias("vector"))


@query()
def agent_loop(spark, d):
    """rounds of proposed searches until rank 1, at most ten."""
    asked = _asked(spark, d)
    return dataset.agent_loop(spark, _docs(spark, d), asked, _judged(spark, d), providers.LocalProvider())


from . import catalog_archive, catalog_index, catalog_stream  # noqa: E402, F401  register the rest of the queries
