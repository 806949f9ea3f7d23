"""Fusion, metrics, search language, providers and the stream against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import metrics, retrieval, search
from loomline.plans import dataset, providers
from loomline.sources import rest
from loomline.streaming import ingest


def test_fusion_equals_insertion_order(spark):
    rng = random.Random(3)
    lists = [(q, i, [rng.randrange(12) for _ in range(rng.randrange(9))]) for q in range(20) for i in range(3)]
    rows = [(q, i, r, d) for q, i, ds in lists for r, d in enumerate(ds, 1)]
    got = retrieval.fused(spark.createDataFrame(rows, "query_id long, list_id int, rank int, doc_id long")).collect()
    for q in range(20):
        scores: dict = {}
        for _, _, ds in [x for x in lists if x[0] == q]:
            for r, d in enumerate(ds, 1):
                scores[d] = scores.get(d, 0) + 1 / (60 + r)
        expected = sorted(scores, key=lambda d: -round(scores[d], 9))
        assert [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == expected


def test_recall_and_ranks(spark):
    run = spark.createDataFrame([("a", "d1", 1), ("a", "d2", 21), ("b", "d9", 1)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("a", "d1", 1.0), ("a", "d1", 1.0), ("a", "d2", 2.0), ("b", "d0", 1.0), ("c", "d0", 1.0)], "query_id string, doc_id string, score double")
    assert {r["query_id"]: r["recall"] for r in metrics.recall_at_k(run, qrels).collect()} == {"a": 0.5, "b": 0.0}
    assert {r["query_id"]: (r["first_rank"], r["hit_20"]) for r in metrics.first_relevant_rank(run, qrels).collect()} == {"a": (1, 1), "b": (0, 0)}


def test_empty_vector_search(spark):
    empty = spark.createDataFrame([], "doc_id long, vector array<float>")
    assert retrieval.vector_top_k(empty, empty.withColumnRenamed("doc_id", "query_id"), 3).count() == 0


BATTERY = [
    ("alpha", {1, 2, 4}), ("alpha -beta", {1, 4}), ("alpha NOT beta", {1, 4}), ("alpha !beta", {1, 4}), ("alpha AND beta", {2}), ("alpha && beta", {2}), ("alpha + beta", {2}),
    ("alpha OR beta", {1, 2, 3, 4}), ("alpha | gamma", {1, 2, 4}), ("alpha XOR beta", {1, 3, 4}), ("alpha ^ beta", {1, 3, 4}), ("(alpha OR beta) -gamma", {1, 2, 3}), ('"beta alpha"', {2}), ('-"beta alpha" alpha', {1, 4}),
    ("alph*", {1, 2, 4, 5}), ("alph?", {1, 2, 4}), ("ALPHA", {1, 2, 4}), ("in:#x", {1, 2}), ("in:#x,#y alpha", {1, 2, 4}), ("-in:#x", {3, 4, 5}), ("from:@ann", {1, 3}), ("has:link", {3}),
    ("before:2024-02-01", {1, 2}), ("after:2024-02-01", {4, 5}), ("on:2024-02-01", {3}), ("during:2024", {1, 2, 3, 4, 5}), ("during:2024-03", {5}), ("", {1, 2, 3, 4, 5}),
]


@pytest.mark.parametrize("query, expected", BATTERY)
def test_search_language(spark, query, expected):
    rows = [(1, "Alpha", "x", "ann", "2024-01-01"), (2, "beta alpha", "x", "bob", "2024-01-31"), (3, "beta http://a.b", "z", "ann", "2024-02-01"), (4, "alpha, gamma", "y", "bob", "2024-02-02"), (5, "alphabet", "y", None, "2024-03-09"), (6, None, "x", "cy", None)]
    df = spark.createDataFrame(rows, "n int, text string, channel string, user string, date string").withColumn("date", F.col("date").cast("date")).where("n < 6")
    assert {r["n"] for r in search.search(df, query).collect()} == expected


@pytest.mark.parametrize("query", ["(alpha", "alpha )", "AND", "NOT", "alpha OR"])
def test_bad_searches_are_refused(spark, query):
    with pytest.raises(ValueError):
        search.parse(query)


def test_failures_stay_in_their_row(spark):
    class Flaky(providers.LocalProvider):
        def generate(self, row):
            if row["chunk_id"] == "bad":
                raise OSError("no answer")
            return super().generate(row)

    chunks = spark.createDataFrame([("bad", "some words here today"), ("good", "some words here today")], "chunk_id string, content string")
    rows = chunks.withColumn("persona", F.lit("vague")).withColumn("n", F.lit(0))
    done = {r["chunk_id"]: r for r in providers.call(rows, Flaky(), "generate", ["chunk_id", "content", "persona", "n"], tries=1).collect()}
    assert done["bad"]["value"] is None and "no answer" in done["bad"]["error"] and done["good"]["error"] is None
    stored = spark.createDataFrame([("good",)], "chunk_id string")
    assert dataset.build(chunks.where("chunk_id = 'good'"), stored, providers.LocalProvider()).count() == 0


def test_cache_asks_once(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "n int, text string")
    store = spark.createDataFrame([], "key string, value string")
    out, new = providers.cached(rows, store, providers.LocalProvider(), "embed", ["text"])
    assert new.count() == 2 and out.where("value is null").count() == 0
    _, again = providers.cached(rows, new, providers.LocalProvider(), "embed", ["text"])
    assert again.count() == 0


def test_limits_and_retries():
    now, slept = [0.0], []
    wait = lambda s: (slept.append(s), now.__setitem__(0, now[0] + s))
    bucket = providers.TokenBucket(4 / 0.95 * 1.001, 1e9, clock=lambda: now[0], sleep=wait)
    for _ in range(3):
        bucket.take(1)
    assert slept == [15.0, 15.0]
    tries = []

    def fails():
        tries.append(1)
        raise OSError

    waits = []
    with pytest.raises(OSError):
        providers.with_retries(fails, 4, waits.append)
    assert len(tries) == 4 and waits == [1.0, 2.0, 4.0]


def test_paged_source():
    pages = {"": {"ok": True, "items": [{"a": 1}], "response_metadata": {"next_cursor": "x"}}, "x": {"ok": True, "items": [{"a": 2}]}}
    assert list(rest.paged(lambda e, p: pages[p.get("cursor", "")], "list", {}, "items")) == [{"a": 1}, {"a": 2}]
    calls, waits = [], []
    reply = rest.call_with_retries(lambda e, p: calls.append(1) or {"ok": False, "error": "ratelimited", "retry_after": 3}, "x", {}, waits.append)
    assert not reply["ok"] and len(calls) == 4 and waits == [3.0, 3.0, 3.0]
    assert len([1 for _ in range(1) if rest.call_with_retries(lambda e, p: {"ok": False, "error": "invalid_auth"}, "x", {}, waits.append)]) == 1


def test_stream_takes_each_row_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for day, keys in (("1", ["a", "b", "a"]), ("2", ["b", "c"])):
        spark.createDataFrame([(k, "text") for k in keys], "message_id string, text string").coalesce(1).write.mode("append").json(source)
        ingest.ingest_messages(spark, source, "message_id string, text string", target, checkpoint).start().awaitTermination()
    assert sorted(r["message_id"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_stream_keeps_rows_without_a_key_apart(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([(None, "x"), (None, "y"), (None, "x"), ("a", "x")], [(None, "y"), (None, "z"), (None, None), ("a", "y")]):
        spark.createDataFrame(rows, "message_id string, text string").coalesce(1).write.mode("append").json(source)
        ingest.ingest_messages(spark, source, "message_id string, text string", target, checkpoint).start().awaitTermination()
    assert sorted((r["message_id"] or "", r["text"] or "") for r in spark.read.parquet(target).collect()) == [("", ""), ("", "x"), ("", "y"), ("", "z"), ("a", "x")]
