"""Identity, cleaning and chunking against plain Python, on invented messages."""

import json
import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import ids, text
from loomline.operators import chunk, clean
from loomline.sources import readers, schemas, sinks

TEXTS = ["plain", "ünïcode ☃", "", "line\nbreak", "a" * 50]
STAMPS = ["1690000000.123456", "1690000000.120000", "1690000000.000000", "1699999999.000010"]


def test_uuid5_equals_pythons(spark):
    rows = [(t, s) for t in TEXTS for s in STAMPS]
    got = spark.createDataFrame(rows, "t string, s string").select("t", "s", ids.message_id(F.col("t"), F.col("s")).alias("i")).collect()
    for r in got:
        assert r["i"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{r['t']}:{float(r['s'])}"))


def test_blank_is_pythons_strip(spark):
    chars = [chr(c) for c in (*range(0x20), 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0x41)] + ["", " 　\x1c", " a "]
    for r in spark.createDataFrame([(c,) for c in chars], "t string").select("t", text.is_blank(F.col("t")).alias("b")).collect():
        assert r["b"] == (r["t"].strip() == ""), repr(r["t"])


def archive(tmp_path):
    message = lambda t, ts, **more: {"text": t, "ts": ts, **more}
    channels = {
        "general": {"channel_info": {"id": "C1", "name": "general"}, "messages": [
            message("hello", "1.000000", thread_ts="1.000000", reply_count=2, thread_replies=[message("hello", "1.000000"), message("reply", "2.500000"), message(None, "3.000000"), message("  ", "4.000000")]),
            message(None, "5.000000", thread_replies=[message("x", "5.000000"), message("lost", "6.000000")]),
            message(" 　", "7.000000"), message("lone", "8.120000", thread_replies=[message("lone", "8.120000")], files=[{"id": "F1", "name": "a.txt", "size": 3}]),
        ]},
        "empty": {"channel_info": {"id": "C2"}, "messages": []},
    }
    for name, body in channels.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text("{not json")
    return str(tmp_path)


def test_archive_is_read_and_cleaned(spark, tmp_path):
    path = archive(tmp_path)
    raw = readers.raw_channels(spark, path)
    assert {r["channel_name"] for r in raw.collect()} == {"general", "empty"}
    assert [r[0] for r in readers.broken_files(spark, path).collect()] == ["broken.json"]
    messages = clean.cleaned(raw)
    got = {r["text"]: [x["text"] for x in r["thread"]] for r in messages.collect()}
    assert got == {"hello": ["reply", "  "], " 　": [], "lone": []}
    kept = {r["text"]: [x["text"] for x in r["thread"]] for r in clean.without_blanks(messages).collect()}
    assert kept == {"hello": ["reply"], "lone": []}
    assert clean.flattened(messages).count() == 5
    assert [r["name"] for r in clean.files_of(raw).collect()] == ["a.txt"]
    is_parent = clean.is_thread_parent(F.col("m.thread_ts"), F.col("m.reply_count"), F.col("m.ts"))
    assert raw.select(F.explode("messages").alias("m")).where(is_parent).count() == 1


def test_lenient_and_strict_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"query_id": "a", "keywords": ["k"]}\n\nnot a line\n{"query_id": \n{"query_id": "b"}\n')
    ddl = "query_id string, keywords array<string>"
    assert [r["query_id"] for r in readers.jsonl_lenient(spark, str(path), ddl).collect()] == ["a", "b"]
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(path), ddl).collect()
    (tmp_path / "m.json").write_text('{"1.0": "x", "2.0": "y"}')
    assert {tuple(r) for r in readers.json_map(spark, str(tmp_path / "m.json")).collect()} == {("1.0", "x"), ("2.0", "y")}


def test_replaced_and_upserted(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (1, 2):
        sinks.replace_atomically(spark.range(n).withColumnRenamed("id", "v"), path)
        assert sinks.current(spark, path, "v long").count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    with pytest.raises(Exception):
        sinks.replace_atomically(spark.range(1).select(F.raise_error(F.lit("stop")).alias("v")), path)
    assert sinks.current(spark, path, "v long").count() == 2 and sinks.current(spark, str(tmp_path / "none"), "v long").count() == 0
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "id string, version int, content string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 4, "w"), ("c", 1, "v")], old.schema)
    assert {tuple(r) for r in sinks.upserted(old, new).collect()} == {("a", 1, "z"), ("b", 5, "y"), ("c", 1, "v")}


def twin(tokens, budget):
    w, used, is_open, out = 0, 0, False, []
    for t in tokens:
        if t > budget:
            w += is_open
            out.append((w, True))
            w, used, is_open = w + 1, 0, False
        else:
            if is_open and used + t > budget:
                w, used = w + 1, 0
            used, is_open = used + t, True
            out.append((w, False))
    return out


@pytest.mark.parametrize("lengths", [[], [0, 0], [40, 41, 3], [500, 8, 500, 500, 4], [8, 8, 500], [400, 4, 396, 400]])
def test_packing_equals_its_twin(spark, lengths):
    rows = [("c", "n", i, f"m{i}", "u", str(i), "x" * n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "channel_id string, channel_name string, pos long, message_id string, user string, timestamp string, text string")
    expected = {i: x for i, x in enumerate(twin([n // 4 for n in lengths], 100))}
    assert {r["pos"]: (r["window"], r["truncated"]) for r in chunk.window_numbers(df, 100).collect()} == expected
    assert {r["pos"]: (r["window"], r["truncated"]) for r in chunk.folded_window_numbers(df, 100).collect()} == expected


@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 25))
def test_twin_keeps_order_and_budget(tokens, budget):
    out = twin(tokens, budget)
    assert [w for w, _ in out] == sorted(w for w, _ in out)
    for w in {w for w, cut in out if not cut}:
        assert sum(t for t, (v, _) in zip(tokens, out, strict=True) if v == w) <= budget


def test_schemas_parse(spark):
    for ddl in (schemas.RAW_CHANNEL, schemas.CLEAN_CHANNEL, schemas.CHUNK, schemas.PAIR, schemas.USERS, schemas.CHANNELS):
        assert spark.createDataFrame([], ddl).columns
