"""The archive as a stream, killed and started again, and ingest by keyed state."""

import json
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from loomline.sources import archive_stream, integrity
from loomline.streaming import ingest

CLIENT = "tests.test_streams:client"


def client(endpoint, params):
    """A workspace in a file: pages of two messages, newest first; a channel named in ``broken`` fails on its second page."""
    with open(params["workspace"]) as f:
        state = json.load(f)
    if endpoint == "conversations.list":
        return {"ok": True, "channels": [{"id": c} | ({"created": 1000} if c != "old" else {}) for c in state["channels"]]}
    at = int(params.get("cursor") or 0)
    if params["channel"] == state.get("broken") and at:
        return {"ok": False, "error": "invalid_auth"}
    low, high = float(params.get("oldest", -2)), float(params.get("latest", 1e12))
    found = [m for m in sorted(state["channels"][params["channel"]], key=lambda m: -float(m["ts"])) if low <= float(m["ts"]) <= high]
    size = min(2, params["limit"])
    return {"ok": True, "messages": found[at : at + size], "response_metadata": {"next_cursor": str(at + size) if at + size < len(found) else ""}}


def message(channel, second):
    return {"ts": f"{second}.000000", "text": f"{channel} at {second}", "user": "U1"}


def put(path, channels, **more):
    path.write_text(json.dumps({"channels": channels} | more))


def start(spark, path, target, state, write=None):
    rows = archive_stream.message_stream(spark, CLIENT, params=json.dumps({"workspace": str(path)}), piece_seconds="50")
    out = rows.writeStream.foreachBatch(write or (lambda b, n: b.write.mode("overwrite").parquet(f"{target}/batch={n}")))
    return out.option("checkpointLocation", state).trigger(availableNow=True).start()


def seen(spark, target):
    return sorted((r["channel"], r["ts"], r["text"]) for r in spark.read.parquet(target).collect())


def expected(channels):
    return sorted((c, m["ts"], m["text"]) for c, ms in channels.items() for m in ms)


def test_archive_stream_is_whole_after_failures(spark, tmp_path):
    path, target, state = tmp_path / "workspace.json", str(tmp_path / "out"), str(tmp_path / "state")
    channels = {"a": [message("a", 1000 + 7 * i) for i in range(40)], "b": [message("b", 1500)], "old": [message("old", 5)], "empty": []}
    put(path, channels)
    start(spark, path, target, state).awaitTermination()
    assert seen(spark, target) == expected(channels)

    # A call fails half-way: no cursor moves, and the next start reads the same range.
    channels["a"] += [message("a", 1300 + i) for i in range(5)]
    channels["empty"] = [message("empty", 1200)]
    put(path, channels, broken="a")
    with pytest.raises(Exception, match="invalid_auth"):
        start(spark, path, target, state).awaitTermination()

    # The sink dies after it wrote: the batch runs again into its own folder. What came meanwhile comes next.
    channels["b"].append(message("b", 1600))
    put(path, channels)

    def dies(batch, number):
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        raise OSError("killed")

    with pytest.raises(Exception, match="killed"):
        start(spark, path, target, state, dies).awaitTermination()
    channels["new"] = [message("new", 2000)]
    put(path, channels)
    for _ in range(2):
        start(spark, path, target, state).awaitTermination()
    assert seen(spark, target) == expected(channels)


def test_pieces_cover_a_range_once():
    reader = archive_stream.ArchiveStreamReader({"client": CLIENT, "piece_seconds": "50"})
    end = {"a": {"to": "1120.5", "begin": "1000"}, "b": {"to": "7", "begin": "0"}, "import": {"to": "3", "begin": "900"}, "same": {"to": "9.0", "begin": "1"}}
    got = [p.value for p in reader.partitions({"same": {"to": "9.0", "begin": "1"}}, end)]
    assert [p[1:] for p in got if p[0] == "a"] == [("999", "1049"), ("1049", "1099"), ("1099", "1120.5")]
    assert [p for p in got if p[0] != "a"] == [("b", "-1", "7"), ("import", "-1", "3")]
    with pytest.raises(ValueError):
        archive_stream.ArchiveStreamReader({"client": CLIENT, "piece_seconds": "0"})


def land(spark, folder, rows):
    spark.createDataFrame(rows, "message_id string, text string").coalesce(1).write.mode("append").json(folder)


def test_keyed_state_needs_no_earlier_output(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "message_id string, text string"
    land(spark, source, [("a", "x"), ("b", "x"), (None, "x"), (None, "x")])
    ingest.ingest_messages(spark, source, schema, target, state).start().awaitTermination()
    shutil.rmtree(target)  # were it read, the rows would come again
    land(spark, source, [("a", "y"), ("c", "x"), (None, "x"), (None, None), (None, None)])
    query = ingest.ingest_messages(spark, source, schema, target, state).start()
    query.awaitTermination()
    assert query.lastProgress["numInputRows"] in (0, 5)
    assert sorted((r["message_id"] or "", r["text"] or "") for r in spark.read.parquet(target).collect()) == [("", ""), ("c", "x")]


def test_keys_expire(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda expiry: ingest.ingest_messages(spark, source, "message_id string, text string", target, state, expiry=expiry).start().awaitTermination()
    for text in ("first", "again"):
        land(spark, source, [("a", text), ("b" if text == "first" else "c", text)])
        run("1 second")
    # The state forgets at a batch's end what expired before that batch: this one moves the time on.
    time.sleep(2.5)
    land(spark, source, [("d", "between")])
    run("1 second")
    land(spark, source, [("a", "late"), ("d", "late")])
    run("1 second")
    got = sorted((r["message_id"], r["text"]) for r in spark.read.parquet(target).select("message_id", "text").collect())
    assert ("a", "late") in got and {k for k, _ in got} == {"a", "b", "c", "d"}
    assert spark.read.parquet(target).where(F.col("length") != F.length("text")).isEmpty()


def test_line_numbers_over_splits(spark, tmp_path):
    rng = random.Random(5)
    faults = {"": "blank", " \t": "blank", '{"a": 1': "broken", "[1]": "broken", "no": "broken", '{"a": 1} x': "broken", '{"a": 1}, {"b": 2}': "broken", '{"a": 1}] [': "broken", '{"a": 1}}': "broken"}
    expected, totals = set(), {}
    for name, n in (("a", 3000), ("b", 1), ("c", 700)):
        lines = [rng.choice(list(faults)) if rng.random() < 0.1 else json.dumps({"i": i, "t": "é" * rng.randrange(60)}, ensure_ascii=False) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + ("\n" if name != "c" else ""))
        if name == "c" and lines[-1] == "":
            lines.pop()
        expected |= {(name, i, faults[x], x) for i, x in enumerate(lines, 1) if x in faults}
        kinds = [faults.get(x) for x in lines]
        totals[name] = (len(lines), kinds.count("blank"), kinds.count("broken"))
    (tmp_path / "none.jsonl").write_text("")
    base = lambda uri: uri.rsplit("/", 1)[1].removesuffix(".jsonl")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert {(base(r["file"]), r["line"], r["fault"], r["value"]) for r in integrity.bad_lines(spark, str(tmp_path)).collect()} == expected
        assert {base(r["file"]): (r["n_lines"], r["n_blank"], r["n_broken"]) for r in integrity.line_report(spark, str(tmp_path)).collect()} == totals
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
