"""Packing of long channels in parallel against one loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import packing
from loomline.operators.chunk import window_numbers


def one_loop(tokens, budget):
    out, w, used, is_open = [], 0, 0, False
    for t in tokens:
        if t > budget:
            w += is_open
            out.append(w)
            w, used, is_open = w + 1, 0, False
            continue
        if is_open and used + t > budget:
            w, used = w + 1, 0
        used, is_open = used + t, True
        out.append(w)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pieces_in_a_row_number_like_one_loop(seed):
    rng = random.Random(seed)
    budget = rng.choice([1, 5, 20, 100])
    tokens = np.array([rng.choice([0, 0, 1, 2, budget // 2, budget, budget + 1, 3 * budget, rng.randint(0, budget)]) for _ in range(400)])
    for size in (1, 3, 17, 400):
        state, got = (0, packing.CLOSED), []
        for a in range(0, 400, size):
            piece = packing.Piece(tokens[a : a + size], budget)
            got += piece.numbers(*state).tolist()
            assert len(piece.table()["low"]) <= min(size, budget + 1) + 1
            state = packing.after(piece.table(), *state)
        assert got == one_loop(tokens.tolist(), budget)


def test_many_channels_and_a_hot_one(spark):
    rng = random.Random(1)
    rows = [(f"c{c}", p, "x" * (4 * rng.choice([0, 1, 3, 9, 40])) if rng.random() < 0.97 else None) for c, n in [(0, 3000), *((c, rng.randint(1, 9)) for c in range(1, 200))] for p in range(n)]
    rows += [(None, 0, "abc"), (None, 1, "x" * 4000)]
    df = spark.createDataFrame(rows, "channel_id string, pos long, text string")
    got = {(r["channel_id"], r["pos"]): (r["window"], r["truncated"]) for r in packing.parallel_window_numbers(df, 30, parts=9).collect()}
    by = {}
    for c, p, t in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        by.setdefault(c, []).append((p, len(t or "") // 4))
    want = {(c, p): (w, t > 30) for c, items in by.items() for (p, t), w in zip(items, one_loop([t for _, t in items], 30), strict=True)}
    assert got == want
    assert packing.parallel_window_numbers(df.where("false"), 30).count() == 0


def test_one_channel_of_a_million_messages_is_many_tasks(spark):
    rows = spark.range(1_000_000).select(F.lit("all").alias("channel_id"), F.col("id").alias("pos"), F.repeat(F.lit("word"), (F.pmod(F.xxhash64("id"), F.lit(60))).cast("int")).alias("text"))
    got = packing.parallel_window_numbers(rows, 4096, parts=16)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == 16
    whole = window_numbers(rows, 4096).select("pos", F.col("window").alias("w"))
    both = got.join(whole, "pos")
    assert both.count() == 1_000_000 and both.where("window != w").count() == 0
