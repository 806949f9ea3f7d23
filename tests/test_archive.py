"""Archive scans, sinks, exact tokens, vectors and batches, on small files."""

import base64
import json
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import text, tokenizer, vectors
from loomline.operators import chunk, search
from loomline.plans import providers
from loomline.sources import archive, readers, schemas, sinks


def client(endpoint, params):
    """A workspace in memory: two pages of users, a channel whose second page fails."""
    if endpoint == "users.list":
        more = not params.get("cursor")
        return {"ok": True, "members": [{"id": "U1" if more else "U2", "name": "n"}], "response_metadata": {"next_cursor": "x" if more else ""}}
    if endpoint == "conversations.history":
        if params.get("cursor"):
            return {"ok": False, "error": "invalid_auth"}
        return {"ok": True, "messages": [{"ts": "1.0", "text": params["channel"], "files": [{"id": "f"}]}], "response_metadata": {"next_cursor": "y" if params["channel"] == "C2" else ""}}
    if endpoint == "conversations.members":
        return {"ok": True, "members": ["U1", "U2"]}
    if endpoint == "conversations.replies":
        return {"ok": True, "messages": [{"ts": "1.0"}], "response_metadata": {"next_cursor": "never read"}}
    if endpoint == "emoji.list":
        return {"ok": True, "emoji": {"a": "https://x/a.png", "b": "https://x/b.png"}}
    return {"ok": True, "team": {"id": "T1", "name": "team", "domain": "d"}, "items": [], "bookmarks": []}


def test_workspace_scans(spark):
    at = "tests.test_archive:client"
    assert {r["id"] for r in archive.scan(spark, at, "users").collect()} == {"U1", "U2"}
    rows = archive.scan(spark, at, "history", [{"channel": "C1"}, {"channel": "C2"}]).collect()
    assert {(r["chain"], r["text"], r["error"]) for r in rows} == {(0, "C1", None), (1, "C2", None), (1, None, "invalid_auth")}
    assert [r["files"][0]["id"] for r in rows if r["text"]] == ["f", "f"]
    assert {r["id"] for r in archive.scan(spark, at, "members", [{"channel": "C1"}]).collect()} == {"U1", "U2"}
    assert archive.scan(spark, at, "replies", [{"channel": "C1", "ts": "1.0"}]).count() == 1
    assert {(r["name"], r["url"]) for r in archive.scan(spark, at, "emoji").collect()} == {("a", "https://x/a.png"), ("b", "https://x/b.png")}
    assert [r["name"] for r in archive.scan(spark, at, "team").collect()] == ["team"]
    assert archive.scan(spark, at, "pins").count() == archive.scan(spark, at, "bookmarks").count() == 0


def test_landed_files(spark, tmp_path):
    chunks = tmp_path / "chunks.jsonl"
    line = lambda i, c: json.dumps({"chunk_id": i, "chunk_type": "thread", "content": c})
    chunks.write_text("\n".join([line("a", "old"), line("b", "x"), line("a", "new")]))
    assert {(r["chunk_id"], r["content"]) for r in readers.chunk_lines(spark, str(chunks)).collect()} == {("a", "new"), ("b", "x")}
    assert readers.chunk_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    pairs = tmp_path / "pairs.jsonl"
    pairs.write_text('{"query": "q", "chunk_id": "a", "persona": "vague"}\n{"query": \n')
    assert [r["query"] for r in readers.pair_lines(spark, str(pairs)).collect()] == ["q"]
    assert readers.pair_lines(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        readers.pair_lines(spark, str(pairs), strict=True).collect()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"\x00\x01")
    assert [(r["length"], bytes(r["content"])) for r in readers.attachments(spark, str(tmp_path / "f")).collect()] == [(2, b"\x00\x01")]
    for name in ("w1", "w2"):
        (tmp_path / "root" / name / "chunks").mkdir(parents=True)
    (tmp_path / "root" / "w2" / "validated_query_chunk_pairs.jsonl").write_text("")
    assert readers.workspaces(spark, str(tmp_path / "root")) == ["w2"] and readers.workspaces(spark, str(tmp_path / "no")) == []
    assert readers.exists(spark, str(pairs)) and not readers.exists(spark, str(tmp_path / "no"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("w", "a/b", "x"), ("w", "c", "y")], "workspace string, channel_name string, text string")
    sinks.per_channel(rows, str(tmp_path / "ch"))
    assert sorted(os.listdir(tmp_path / "ch" / "workspace=w"))[-2:] == ["channel_dir=a_b", "channel_dir=c"]
    for _ in range(2):
        sinks.jsonl(rows, str(tmp_path / "a"), "append")
        sinks.jsonl(rows, str(tmp_path / "o"))
        sinks.usage_log(spark.createDataFrame([(1, 2, 3)], "prompt long, completion long, reasoning long"), str(tmp_path / "u"))
    assert spark.read.json(str(tmp_path / "a")).count() == 4 and spark.read.json(str(tmp_path / "o")).count() == 2
    assert [tuple(r) for r in spark.read.schema("p long, c long, r long").csv(str(tmp_path / "u")).collect()] == [(1, 2, 3)] * 2
    sinks.run_metadata(spark, str(tmp_path / "m"), "w", messages=3)
    assert spark.read.json(str(tmp_path / "m")).first()["messages"] == 3
    run = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2)], "query_id string, doc_id string, rank int")
    docs = spark.createDataFrame([("d1", "one\ntwo"), ("d2", "z" * 600)], "doc_id string, text string")
    good = spark.createDataFrame([("q", "d2")], "query_id string, doc_id string")
    out = {r["rank"]: r["value"] for r in sinks.inspection(run, docs, good).collect()}
    assert out[1] == "1   d1 one two" and out[2] == "2 * d2 " + "z" * 500 + "..."
    found = spark.createDataFrame([("t", "u", "c", "2024-01-01", "l")], "text string, user string, channel string, date string, permalink string")
    assert tuple(sinks.search_export(found).first()) == ("t", "u", "c", "2024-01-01", "l")
    assert sinks.search_export(found.drop("permalink")).first()["permalink"] is None


def test_names_and_blanks(spark):
    rows = spark.createDataFrame([("n", "C", None, None), ("n", "D", True, False), (None, "G", False, True), (None, "X", False, False)], "name string, id string, im boolean, mpim boolean")
    assert [r[0] for r in rows.select(text.channel_name(F.col("name"), F.col("id"), F.col("im"), F.col("mpim"))).collect()] == ["n", "dm_D", "group_dm_G", "X"]
    some = spark.createDataFrame([("  \n",), ("",), ("abcdef",), (None,)], "t string")
    assert [r[0] for r in some.select(text.for_embedding(F.col("t"), 3)).collect()] == [" ", " ", "abc", None]


def test_structured_replies(spark):
    replies = ['```json\n{"a": 1, "b": "x"}\n```', '{"a": 2, "b": "y"}', '{"a": 1}', '{"a": "no", "b": "x"}', "[1]", "not json", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", text.structured(F.col("r"), "a bigint, b string").alias("v")).orderBy("i").collect()
    assert [None if r["v"] is None else tuple(r["v"]) for r in got] == [(1, "x"), (2, "y"), None, None, None, None, None]


def test_exact_tokens(spark):
    own = tokenizer.encoder(open(tokenizer.VOCABULARY, "rb").read())
    texts = ["some words é and more of them", "", None, "x" * 3000, "a b"]
    t = tokenizer.Tokenizer(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", t.count(F.col("t")).alias("n"), t.truncate(F.col("t"), 4).alias("cut")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [None if x is None else len(own.encode_ordinary(x)) for x in texts]
    assert [r["cut"] for r in rows] == [x if x is None or len(own.encode_ordinary(x)) <= 4 else own.decode(own.encode_ordinary(x)[:4]) + "..." for x in texts]
    with pytest.raises(ValueError):
        tokenizer.MOST_BYTES, most = 10, tokenizer.MOST_BYTES
        try:
            tokenizer.Tokenizer(spark)
        finally:
            tokenizer.MOST_BYTES = most


def test_vectors_are_read_back(spark):
    v = np.array([0.5, -1.25, 3.0])
    rows = [(k, base64.b64encode(v.astype(d).tobytes()).decode()) for k, d in (("float16", "<f2"), ("float32", "<f4"))]
    for kind, sent in rows:
        df = spark.createDataFrame([(sent,), (None,), ("AAA",), ("!",)], "s string")
        assert [r[0] for r in df.select(vectors.decoded(F.col("s"), kind)).collect()] == [[0.5, -1.25, 3.0], None, None, None]


@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 12), st.integers(1, 80))
@settings(deadline=None)
def test_slices_keep_order_and_bounds(tokens, most_rows, most_tokens):
    got = list(chunk.token_slices(tokens, most_rows, most_tokens))
    assert [x for a, b in got for x in range(a, b)] == list(range(len(tokens)))
    assert all(b - a <= most_rows and (b - a == 1 or sum(tokens[a:b]) <= most_tokens) for a, b in got)


def test_batched_embedding_keeps_failures_in_their_batch(spark):
    class Provider(providers.LocalProvider):
        def embed_many(self, texts):
            if len(texts) > 2 or "bad" in texts:
                raise OSError("refused")
            return super().embed_many(texts)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "bad", "c", "d", None])], "i int, t string").coalesce(1)
    got = {r["i"]: r for r in providers.embedded(rows, Provider(), "t", most_rows=2, tries=1).collect()}
    assert [got[i]["error"] for i in range(6)] == [None, None, "refused", "refused", None, None]
    assert np.allclose(got[0]["vector"], providers.hashed_vector("a")) and got[2]["vector"] is None


def test_limits_are_shared_by_tasks(spark, monkeypatch):
    rows = spark.range(40).withColumn("text", F.lit("x"))
    assert providers.call(rows, providers.LocalProvider(), "embed", ["text"], limits=(1e9, 1e9), tasks=3).rdd.getNumPartitions() == 3


def test_search_options(spark):
    rows = spark.createDataFrame([(1, "a b a", 3), (2, "a", 9), (3, "b", 1)], "id int, text string, timestamp int")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(search.search_messages(rows, "a", ["id"])) == [1, 2] and ids(search.search_messages(rows, "a", ["id"], sort_dir="asc")) == [2, 1]
    assert ids(search.search_messages(rows, "a", ["id"], sort="timestamp")) == [2, 1] and ids(search.search_messages(rows, "", ["id"], count=1, number=2)) == [2]
    for wrong in ({"sort": "name"}, {"count": 101}, {"number": 0}):
        with pytest.raises(ValueError):
            search.search_messages(rows, "a", ["id"], **wrong)


def test_provider_messages_cases(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (2, 0, "user", "u"), (3, 0, "system", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in chunk.provider_messages(df, "go").select("conv_id", "run", "role", "content", "system").collect())
    assert got == [(1, 1, "user", "go", "s"), (1, 2, "assistant", "a\nb", "s"), (2, 1, "user", "u", None)]
    assert sorted(r["role"] for r in chunk.provider_messages(df).collect()) == ["assistant", "user"]


def test_schema_names_are_fields():
    assert all(ddl.split()[0] for _, _, ddl, _ in archive.KINDS.values()) and schemas.CHANNELS
