"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, jaccard_join, latent, lines, media, packing, phrases, repair, secrets, sharding, tokens, urls, whitening
from .common import Scratch, scratch_path, table


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles reach a Jaccard similarity of 0.9."""
    found = jaccard_join.similarity_components(table(spark, sf_dir, "documents"), 3, (90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards under the law ``rows``."""
    out = sharding.feistel_shards(table(spark, sf_dir, "documents"), 16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per source, language and tokenizer version, built by signed batches.

    All documents come in with provisional counts, a second batch revises those to the
    tokenizer's, a third takes blank documents out and a fourth puts them back, so that the
    totals cover all documents.
    """
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"))
    scratch = Scratch(spark)
    counted = scratch.cut(counted.withColumn("provisional", F.ceil(F.col("n_bytes") / 4)), "counted")
    store = tokens.RollupStore(spark, scratch_path(spark, "rollup"))
    words = tokens.as_changes("insert", counted, "words-1", "n_words")
    store.commit("load-1", tokens.as_changes("insert", counted, "byte_bpe_50k", "provisional").union(words))
    store.commit("recount-1", tokens.as_changes("revise", counted, "byte_bpe_50k", "n_tokens", "provisional"))
    blank = counted.where("n_words = 0")
    gone = tokens.as_changes("delete", blank, "byte_bpe_50k", "n_tokens").union(tokens.as_changes("delete", blank, "words-1", "n_words"))
    store.commit("withdraw-1", gone)
    back = tokens.as_changes("insert", blank, "byte_bpe_50k", "n_tokens").union(tokens.as_changes("insert", blank, "words-1", "n_words"))
    store.commit("restore-1", back)
    scratch.drop("counted")
    return store.totals()


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed patterns and guess-cost spans of every document."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as FLAC, read back and digested."""
    return media.media_features(media.encode_media(table(spark, sf_dir, "documents")))


def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of good quality by text, by metadata and by both."""
    docs = table(spark, sf_dir, "documents")
    return cotraining.score_documents(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def op5_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair where the document holds the item or a paraphrase of it."""
    return latent.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line at a Jaccard similarity of 0.8 over 5-word shingles."""
    return lines.line_report(table(spark, sf_dir, "documents"))


#: The rules of the url query: host and path, the longest fitting one wins.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url, by rule or by its redirect component."""
    return urls.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in tokens, into bins of five permitted lengths."""
    return packing.pack_tokens(table(spark, sf_dir, "documents"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with a fifth of each kind of damage, by a checksum of their place."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind_")).where("kind_ != 0")
    text = F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind_") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("kind_") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy_")).drop("copy_")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every conversation, after damage."""
    turns = table(spark, sf_dir, "conversations")
    report = repair.Repair(damaged(turns)).report.withColumnRenamed("conv", "conv_")
    met = turns.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("conv_")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return met.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 16 leading components, whitened."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that occur earlier."""
    kept = phrases.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_token_rollup": op1_token_rollup,
    "op2_secret_scan": op2_secret_scan,
    "op3_flac_media": op3_flac_media,
    "op4_quality_cotraining": op4_quality_cotraining,
    "op5_benchmark_contamination": op5_benchmark_contamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_feistel_sharding": op9_feistel_sharding,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_substring_dedup": op13_substring_dedup,
}

def _round(i: int, inner: str, mask: str) -> str:
    """One round of the network over (row_no, n, lm, rm, rw, s, l, r) rows."""
    t = f"((r + {sharding.ROUND_KEYS[i]}) % {sharding.PRIME})"
    return f"SELECT row_no, n, lm, rm, rw, s, r AS l, xor(l, ({t} * {t} % {sharding.PRIME} * {sharding.MULTIPLIER} % {sharding.PRIME}) & {mask}) AS r FROM ({inner})"


def _feistel_sql(shards: int = 16) -> str:
    step = "SELECT row_no, n, lm, rm, rw, s, x >> rw AS l, x & rm AS r FROM k WHERE s = 0 OR x >= n"
    for i in range(len(sharding.ROUND_KEYS)):
        step = _round(i, step, ("lm", "rm")[i % 2])
    return f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], range(8)::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
  d AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
  c AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
  b AS (SELECT n, bits // 2 AS lw, bits - bits // 2 AS rw FROM (SELECT count(*) AS n, greatest(2, length(bin(count(*) - 1))) AS bits FROM documents)),
  o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_no FROM c),
  k AS (SELECT row_no, n, (1::BIGINT << lw) - 1 AS lm, (1::BIGINT << rw) - 1 AS rm, rw, 0 AS s, row_no AS x FROM o, b
    UNION ALL SELECT row_no, n, lm, rm, rw, s + 1, (l << rw) | r FROM ({step}))
  SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {shards})::INT AS shard, x // {shards} AS slot, NULL::INT AS grown_shard FROM k JOIN o USING (row_no) WHERE s > 0 AND x < n"""


_FEISTEL_SQL = _feistel_sql()

_SHINGLED = """WITH w AS (SELECT {keys}, list_filter(regexp_split_to_array({lowered}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {source}),
  g AS (SELECT {keys}, unnest(list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w WHERE len(w) >= {least}),
  n AS (SELECT {keys}, count(*) AS n FROM g GROUP BY ALL)"""

_CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], range(8)::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"

#: States are the last initial ('' at first); ``ins`` are turns put in before a row; ``x`` is all that can become of a row.
_REPAIR_SQL = f"""WITH RECURSIVE tab AS ({_CRC_TABLE}),
  h AS (SELECT *, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
  d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM h, tab),
  m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM d, (VALUES (1), (2)) AS c(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
  n AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS ini, lag(left(role, 1)) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS n, regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS worded, regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS ended FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
  o AS (SELECT *, CASE WHEN NOT worded THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT ended THEN 'truncated' ELSE '' END AS fault FROM n),
  stats AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate, count_if(fault = 'truncated')::BIGINT AS truncated, count_if(before || ini NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM o GROUP BY conv_id),
  ins(st, ins, mid) AS (VALUES ('', '', ''), ('', 'I', 'u'), ('', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'), ('u', '', 'u'), ('u', 'I', 'a'), ('u', 'II', 'u'), ('a', '', 'a'), ('a', 'I', 'u'), ('a', 'II', 'a')),
  gram(mid, nxt) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
  x AS (SELECT st, ins || 'D' AS edits, 'D' AS letter, NULL AS ini, mid AS nxt, 3 * length(ins) + 4 AS cost FROM ins
    UNION ALL SELECT st, ins || 'K', 'K', nxt, nxt, 3 * length(ins) FROM ins JOIN gram USING (mid)
    UNION ALL SELECT st, ins || 'R', 'R', NULL, nxt, 3 * length(ins) + 3 FROM ins JOIN gram USING (mid) WHERE nxt <> 's'),
  b AS (SELECT conv_id, n + 1 AS i, st, cost::BIGINT AS cost, audit FROM (SELECT DISTINCT conv_id, n FROM o), (VALUES ('', 0, ''), ('a', 0, ''), ('u', 3, 'I'), ('s', 6, 'II')) AS e(st, cost, audit)
    UNION ALL SELECT conv_id, i, st, best.cost, best.audit FROM (SELECT b.conv_id, o.i, x.st, min(struct_pack(cost := b.cost + x.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END, audit := x.edits || b.audit)) AS best
      FROM b JOIN o ON o.conv_id = b.conv_id AND o.i = b.i - 1 JOIN x ON x.nxt = b.st WHERE (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (x.ini IS NULL OR x.ini = o.ini) GROUP BY ALL)),
  best AS (SELECT conv_id, cost, audit FROM b WHERE i = 1 AND st = ''),
  l AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS j, unnest(string_split(audit, '')) AS letter FROM best WHERE audit <> ''),
  p AS (SELECT *, count_if(letter <> 'I') OVER w AS i, count_if(letter <> 'D') OVER w AS place FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
  q AS (SELECT p.conv_id, j, place, letter, CASE WHEN letter = 'K' THEN role END AS role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, max(CASE WHEN place = 1 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS lead FROM p LEFT JOIN o ON o.conv_id = p.conv_id AND o.i = p.i WHERE letter <> 'D'),
  z AS (SELECT conv_id, string_agg(coalesce(role, CASE WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j) AS t FROM q GROUP BY conv_id)
  SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN stats USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN z USING (conv_id)"""

ORACLES: dict[str, str] = {
    "op6_line_dedup": _SHINGLED.format(keys="doc_id, i", lowered="lower(line)", k=5, least=1, source="(SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)")
    + """, h AS (SELECT b.doc_id, b.i FROM g a JOIN g b ON a.g = b.g AND (a.doc_id, a.i) < (b.doc_id, b.i) JOIN n na ON (na.doc_id, na.i) = (a.doc_id, a.i) JOIN n nb ON (nb.doc_id, nb.i) = (b.doc_id, b.i)
      GROUP BY a.doc_id, a.i, b.doc_id, b.i, na.n, nb.n HAVING 10 * count(*) >= 8 * (na.n + nb.n - count(*))),
  r AS (SELECT doc_id, count(DISTINCT i) AS n_removed, array_to_string(list_sort(list(DISTINCT i)), ',') AS removed_lines FROM h GROUP BY doc_id)
  SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines FROM documents LEFT JOIN r USING (doc_id)""",
    # No page of these tables holds a canonical link or a refresh, so rules decide all; tests cover links.
    "op7_url_filter": """WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(act, h, p)),
  m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(act, length(h || p)) AS act FROM u JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
  SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict, NULL::VARCHAR AS component FROM u LEFT JOIN m USING (page_id)""",
    "op8_ngram_jaccard": "WITH RECURSIVE" + _SHINGLED.format(keys="doc_id", lowered="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", k=3, least=0, source="documents").removeprefix("WITH")
    + """, l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
  reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON l.x = reach.other)
  SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op9_feistel_sharding": _FEISTEL_SQL,
    "op11_conversation_repair": _REPAIR_SQL,
    "op13_substring_dedup": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
  g AS (SELECT doc_id, unnest(range(len(w) - 19)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS g FROM w WHERE len(w) >= 20),
  r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g),
  c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
  x AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM w),
  k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
}
