"""Persisted indices against scans of the same texts and vectors."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.index import text as text_index
from loomline.index.text import TextIndex
from loomline.operators import retrieval, search
from loomline.sources import sinks

WORDS = [f"w{i}" for i in range(40)] + ["the", "of", "under_score", "Ünder", "c++", "a.b"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(i, rng.choice([" ", ", "]).join(rng.choices(WORDS, weights, k=rng.randint(0, 30)))) for i in range(n)] + [(n, None), (n + 1, "")]


def same_as_scan(spark, index, docs, asked, k):
    terms = retrieval.query_terms(spark.createDataFrame(asked, "query_id long, query string"))
    want = retrieval.bm25_lists(spark.createDataFrame(docs, "doc_id long, text string"), terms, k).select("query_id", "doc_id", "score", "rank").collect()
    got = index.search_terms(terms, k).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


@pytest.fixture(params=["held", "joined"])
def small_cells(monkeypatch, request):
    """Cells are ruled out by bounds; and the queries' terms are held by tasks, or joined."""
    monkeypatch.setattr(text_index, "UNPRUNED", 0)
    if request.param == "joined":
        monkeypatch.setattr(TextIndex, "search_terms", few_terms(TextIndex.search_terms, monkeypatch))


def few_terms(search_terms, monkeypatch):
    def run(*args, **options):
        with monkeypatch.context() as m:
            m.setattr(retrieval, "MOST_TERMS", 0)
            return search_terms(*args, **options)

    return run


def test_many_queries_pass_on_k_rows_each(spark):
    """Common words, more queries than a batch has rows: a task keeps its best of each query alone."""
    docs = spark.createDataFrame([(i, f"the of w{i % 7} w{i % 3}") for i in range(500)], "doc_id long, text string").repartition(2)
    terms = spark.range(2000).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id") % 7))).alias("term"))
    got = retrieval.bm25_lists(docs, terms, 5)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 10_000 and "MapInPandas" in plan
    running = retrieval.Running(5, 2000)
    for start in range(0, 500, 100):
        query, doc = (x.ravel() for x in np.meshgrid(np.arange(2000), np.arange(start, start + 100), indexing="ij"))
        running.add(query, doc, np.ones(len(doc)))
    query, doc, _ = running.best()
    assert len(query) == 10_000 and set(doc) == set(range(5))


ASKED = [(1, "w1 w2 the"), (2, "w39"), (3, "w0 of under"), (4, "nothing here"), (5, ""), (6, "w38 w0")]


def test_search_equals_a_scan_through_commits_and_compaction(spark, tmp_path, small_cells):
    index, docs = TextIndex(spark, str(tmp_path), buckets=4, cell=8), dict(corpus(300))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.commit(frame(list(docs.items())), sequence=1)
    same_as_scan(spark, index, list(docs.items()), ASKED, 5)
    old = {p: os.stat(p).st_mtime_ns for p in files(tmp_path) if "segment=0" in p}
    changed = {i: f"{t or ''} w38 new" for i, t in docs.items() if i % 30 == 0} | {900: "w39 w39 of"}
    index.commit(frame(list(changed.items())), frame([(i, None) for i in (1, 2, 3, 77, 5000)]), sequence=2)
    docs = {i: t for i, t in (docs | changed).items() if i not in (1, 2, 3, 77)}
    assert {p: os.stat(p).st_mtime_ns for p in files(tmp_path) if "segment=0" in p} == old  # older segments stay as they are
    same_as_scan(spark, index, list(docs.items()), ASKED, 5)
    index.commit(frame([(4, "ignored: this number came before")]), sequence=2)
    again = {i: "w1 w1 w1 back" for i in (2, 30, 60)}
    index.commit(frame(list(again.items()) + [(2, "greatest text counts w1")]), sequence=3)
    docs |= again | {2: max("w1 w1 w1 back", "greatest text counts w1")}
    same_as_scan(spark, index, list(docs.items()), ASKED, 5)
    index.compact()
    assert index.store.manifest()["segments"] == [3]
    same_as_scan(spark, index, list(docs.items()), ASKED, 5)
    assert {r["doc_id"]: r["text"] for r in index.documents().collect()} == docs


def files(path):
    return [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")]


def bytes_read(df):
    """What the plan's scans have read, by Spark's own count, once it has run."""
    df.collect()
    plan, found, seen = df._jdf.queryExecution().executedPlan(), 0, [df._jdf.queryExecution().executedPlan()]
    while seen:
        node = seen.pop()
        name = node.nodeName()
        if "Adaptive" in name:
            seen.append(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in name:
            seen.append(node.plan())
        metric = node.metrics().get("filesSize")
        found += metric.get().value() if metric.isDefined() else 0
        children = node.children()
        seen += [children.apply(i) for i in range(children.size())]
    assert plan is not None
    return found


def test_rare_terms_read_less(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), buckets=16)
    rows = [(i, f"common words of all texts in row u{i} v{i}") for i in range(3000)]
    index.commit(spark.createDataFrame(rows, "doc_id long, text string"))
    ask = lambda q: bytes_read(index.search(spark.createDataFrame([(1, q)], "query_id long, query string"), 10))
    rare, many = ask("u17"), ask("common words of all texts in row u1 u2 u3 u4 v5 v6 v7 v8")
    assert 0 < rare < many / 2


def test_bounds_rule_out_cells_that_cannot_reach_the_best(spark, tmp_path, small_cells):
    """One cell's documents say the word often; the others are not scored."""
    index = TextIndex(spark, str(tmp_path), buckets=1, cell=16)
    rows = [(i, "word " * (20 if i < 16 else 1) + "filler " * (0 if i < 16 else 19)) for i in range(1600)]
    index.commit(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    found = index.search(spark.createDataFrame([(1, "word")], "query_id long, query string"), 10)
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(10))


def test_an_empty_index_and_an_empty_commit(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/x")
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert index.search(asked).count() == 0 and index.with_words(["a"]).count() == 0
    index.commit(spark.createDataFrame([], "doc_id long, text string"))
    assert index.search(asked).count() == 0 and index.documents().count() == 0


QUERIES = ["w1 -w2", "w3 OR w4 w5", '"the of"', '"w1, w2"', "w1*", "w?1", "*2", "w*", "?", "*", '"w1 * w2"', "under_score", "under*", "a.b", "c++", '"a.b w1"', "nder", "(w1 XOR w2) !w3", 'NOT "w0 w0"', "of & the | w7", "w1 from:@u1", "-from:@u1 in:#c1,#c2", "after:2024-01-02 the", '""']


@pytest.mark.parametrize("query", QUERIES)
def test_matching_equals_regular_expressions(spark, messages, query):
    rows, index = messages
    want = sorted(r["doc_id"] for r in search.search(rows, query).collect())
    assert sorted(r["doc_id"] for r in index.matching(rows, query).collect()) == want


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    docs = spark.createDataFrame(corpus(150, 5), "doc_id long, text string")
    rows = docs.withColumns({"channel": F.concat(F.lit("c"), F.col("doc_id") % 4), "user": F.concat(F.lit("u"), F.col("doc_id") % 3), "date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int"))}).cache()
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index")), word_break="[^a-z0-9_]+", buckets=3, cell=16)
    index.commit(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, "w1 old text the of").otherwise(F.col("text"))))
    index.commit(docs.where("doc_id % 7 = 0"))
    return rows, index


def test_a_pointer_is_replaced_whole(spark, tmp_path):
    assert sinks.read_pointer(spark, str(tmp_path)) is None
    for text in ("one", "two ünd"):
        sinks.write_pointer(spark, str(tmp_path), text)
        assert sinks.read_pointer(spark, str(tmp_path)) == text
    assert np.all([n.startswith("CURRENT") or n.endswith(".crc") for n in os.listdir(tmp_path)])


# ------------------------------------------------------------------ vectors


def some_vectors(n, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = np.round(rng.standard_normal((n, dims)) + 3 * rng.integers(0, 4, (n, 1)) * np.eye(dims)[0], 3)
    rows[n // 2 : n // 2 + n // 10] = rows[0]  # one vector, many times
    return [(i, row.tolist()) for i, row in enumerate(rows)]


def nearest(vectors, queries, k):
    out = []
    for q, a in queries:
        scored = sorted((-round(float(np.dot(a, v)), 6), i) for i, v in vectors)[:k]
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in df.collect())


def close(a, b):
    return [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=2e-6)


VECTOR = "doc_id long, vector array<double>"


def test_top_k_in_blocks_equals_a_sort(spark, monkeypatch):
    vectors, queries = some_vectors(400), [(i, v) for i, v in some_vectors(13, seed=2)]
    frames = spark.createDataFrame(vectors + [(None, [1.0] * 8), (9000, None)], VECTOR), spark.createDataFrame(queries, "query_id long, vector array<double>")
    for block, cells in ((4096, 2_000_000), (4, 40)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        monkeypatch.setattr(retrieval, "PART_ROWS", 150)
        assert close(found(retrieval.vector_top_k(*frames, 7)), nearest(vectors, queries, 7))
    assert retrieval.vector_top_k(frames[0], frames[1].where("false"), 7).count() == 0
    assert retrieval.vector_top_k(frames[0].where("false"), frames[1], 7).count() == 0


def test_vector_index_with_all_cells_equals_a_scan(spark, tmp_path, monkeypatch):
    from loomline.index import vectors as vector_index

    monkeypatch.setattr(vector_index, "PART_ROWS", 20)  # cells are searched by several tasks
    vectors, queries = dict(some_vectors(300)), [(i, v) for i, v in some_vectors(9, seed=3)]
    asked, index = spark.createDataFrame(queries, "query_id long, vector array<double>"), vector_index.VectorIndex(spark, str(tmp_path))
    frame = lambda rows: spark.createDataFrame(rows, VECTOR)
    index.train(frame(list(vectors.items())), cells=6)
    index.commit(frame([*vectors.items(), (None, [0.0] * 8), (7777, None)]), sequence=1)
    assert close(found(index.search(asked, 10)), nearest(vectors.items(), queries, 10))
    before = {p: os.stat(p).st_mtime_ns for p in files(tmp_path) if "segment=0" in p}
    moved = {i: [-x for x in vectors[i]] for i in range(0, 300, 25)} | {500: [9.0] * 8}
    index.commit(frame(list(moved.items())), frame([(i, None) for i in (1, 2, 3)]), sequence=2)
    index.commit(frame([(4, [50.0] * 8)]), sequence=2)  # this number came before
    vectors = {i: v for i, v in (vectors | moved).items() if i not in (1, 2, 3)}
    assert {p: os.stat(p).st_mtime_ns for p in files(tmp_path) if "segment=0" in p} == before
    assert close(found(index.search(asked, 10)), nearest(vectors.items(), queries, 10))
    assert {r["doc_id"]: list(r["vector"]) for r in index.vectors().collect()} == vectors


def test_calibrated_probes_find_the_share_and_read_fewer_cells(spark, tmp_path):
    from loomline.index.vectors import VectorIndex

    vectors = [(i, v) for i, v in some_vectors(2000, seed=4)]
    queries = [(i, v) for i, v in vectors if i % 100 == 0]
    asked, index = spark.createDataFrame(queries, "query_id long, vector array<double>"), VectorIndex(spark, str(tmp_path))
    index.train(spark.createDataFrame(vectors, VECTOR), cells=16)
    index.commit(spark.createDataFrame(vectors, VECTOR))
    probes = index.calibrate(asked, 50, 0.95)
    want, got = ({x[:2] for x in rows} for rows in (nearest(vectors, queries, 50), found(index.search(asked, 50))))
    assert probes < 16 and len(want & got) >= 0.95 * len(want)
    one = spark.createDataFrame(queries[:1], "query_id long, vector array<double>")
    assert bytes_read(index.search(one, 50, probes=1)) < bytes_read(index.search(one, 50, probes=16)) / 2
