"""Registered queries on persisted indices, each built from the whole table in several commits, and on channels of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BM25, BUDGET, DOTS, TERMS, WINDOWS, _asked, _docs, _FOUND, _has, _parents, _ranked, _searchable, _vector_run, _vectors, query
from .index.text import TextIndex
from .index.vectors import VectorIndex
from .operators.packing import parallel_window_numbers
from .operators.search import Fields
from .sources.scratch import shared_folder


def _text_index(spark: SparkSession, docs: DataFrame, **options) -> TextIndex:
    """The documents by two commits: the first has old texts of some and strangers, which the second replaces and deletes."""
    index = TextIndex(spark, shared_folder(spark, "text-index"), **options)
    revised = F.pmod(F.xxhash64("doc_id"), F.lit(100)) == 0
    other = F.when(revised, F.concat(F.lit("the of und die "), F.reverse("text"))).otherwise(F.col("text"))
    strange = docs.where(revised).select(F.concat(F.lit("-"), "doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")
    index.commit(docs.withColumn("text", other).unionByName(strange), sequence=1)
    index.commit(docs.where(revised), strange.select("doc_id"), sequence=2)
    return index


@query(f"WITH {TERMS}, {BM25} SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, round(sum(weight), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(weight), 6) DESC, doc_id) AS rank FROM wt JOIN qt USING (term) GROUP BY query_id, doc_id) WHERE rank <= 100")
def indexed_bm25(spark, d):
    """The 100 best documents per benchmark text, by postings with bounds, after an upsert and deletes."""
    index = _text_index(spark, _docs(spark, d).where("doc_id is not null"), positions=False)
    out = index.search(_asked(spark, d), 100)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


#: Queries of the language and what they find, as a condition on lower(text).
INDEXED = [
    ("the -und", f"{_has('the')} AND NOT {_has('und')}"),
    ("(die AND und) OR (the XOR of)", f"({_has('die')} AND {_has('und')} OR {_has('the')} <> {_has('of')})"),
    ('"of the"', _has("of[^a-z0-9_]+the")),
    ('th* "i? th*"', f"{_has('th[a-z0-9_]*')} AND {_has('i[a-z0-9_][^a-z0-9_]+th[a-z0-9_]*')}"),
    ("*tion from:@assistant", f"{_has('[a-z0-9_]*tion')} AND role = 'assistant'"),
    ('NOT "the of" a?d in:#c1,#c2,#c3,#c4,#c5,#c6,#c7', f"NOT {_has('the[^a-z0-9_]+of')} AND {_has('a[a-z0-9_]d')} AND conv_id BETWEEN 1 AND 7"),
]


@query(" UNION ALL ".join(f"SELECT {i} AS query_no, conv_id, turn FROM ({_FOUND}{where})" for i, (_, where) in enumerate(INDEXED)))
def indexed_search(spark, d):
    """F8: words, wildcards and phrases of the search language by postings with positions and a table of grams."""
    rows = _searchable(spark, d).withColumn("doc_id", F.concat_ws(":", "conv_id", "turn"))
    index = _text_index(spark, rows.select("doc_id", "text"), word_break="[^a-z0-9_]+")
    out = None
    for i, (asked, _) in enumerate(INDEXED):
        found = index.matching(rows.where("text is not null"), asked, Fields()).select(F.lit(i).alias("query_no"), "conv_id", "turn")
        out = found if out is None else out.union(found)
    return out


def _vector_index(spark: SparkSession, d: str) -> tuple[VectorIndex, DataFrame]:
    """All vectors by two commits: the first has others in the place of some and strangers; and every hundredth as a query."""
    rows = _vectors(spark, d).select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    index = VectorIndex(spark, shared_folder(spark, "vector-index"))
    index.train(rows)
    revised = F.pmod(F.xxhash64("doc_id"), F.lit(100)) == 0
    other = F.when(revised, F.transform("vector", lambda x: -x)).otherwise(F.col("vector"))
    strange = rows.where(revised).withColumn("doc_id", -F.col("doc_id") - 1)
    index.commit(rows.withColumn("vector", other).unionByName(strange), sequence=1)
    index.commit(rows.where(revised), strange.select("doc_id"), sequence=2)
    return index, rows.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")


@query(f"WITH {DOTS} SELECT query_id, doc_id, score, rank FROM vt")
def indexed_vector_topk(spark, d):
    """Every hundredth vector against all, by the cells of the index; all cells are probed, so the result is exact."""
    index, queries = _vector_index(spark, d)
    return _ranked(index.search(queries, 100))


@query()
def indexed_vector_recall(spark, d):
    """for each query, how many of its true 100 nearest the calibrated index finds, and how many cells it probes."""
    index, queries = _vector_index(spark, d)
    probes = index.calibrate(queries, 100, 0.96)
    found = index.search(queries, 100).select("query_id", "doc_id", F.lit(1).alias("hit"))
    met = _vector_run(spark, d).join(found, ["query_id", "doc_id"], "left")
    counts = met.groupBy("query_id").agg(F.count("hit").alias("n_found"), F.count("*").alias("n_true"))
    return counts.select("query_id", "n_found", "n_true", F.lit(probes).cast("bigint").alias("n_probes"))


@query(f"WITH RECURSIVE {WINDOWS} SELECT o.conv_id::VARCHAR AS channel_id, o.turn AS pos, w.win AS \"window\", w.truncated FROM w JOIN o USING (conv_id, i)")
def chunk_token_windows_pieces(spark, d):
    """Greedy packing by pieces of channels, by pointers between windows instead of a stream per channel."""
    return parallel_window_numbers(_parents(spark, d), BUDGET)


#: All turns as one channel, in order of conversation and turn.
_ONE = "m AS (SELECT 0 AS conv_id, row_number() OVER (ORDER BY conv_id, turn) AS turn, role, text, '' AS ts FROM conversations WHERE text IS NOT NULL), "


@query(f"WITH RECURSIVE {_ONE}{WINDOWS[WINDOWS.index('o AS (SELECT'):]} SELECT c.conv_id, c.turn AS pos, w.win AS \"window\", w.truncated FROM w JOIN o USING (conv_id, i) JOIN (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations WHERE text IS NOT NULL) c USING (i)")
def chunk_one_channel(spark, d):
    """All conversations, one after the other, as one channel over many tasks."""
    rows = _parents(spark, d).withColumn("pos", F.col("channel_id").cast("long") * 1_000_000 + F.col("pos")).withColumn("channel_id", F.lit("all"))
    out = parallel_window_numbers(rows, BUDGET, parts=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out.select(F.expr("pos div 1000000").alias("conv_id"), F.expr("pos % 1000000").alias("pos"), "window", "truncated")
