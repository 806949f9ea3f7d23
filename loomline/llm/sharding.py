"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Every row gets its rank in (doc_id, crc, size) order, nulls first; a keyed Feistel
network permutes 0..N-1, and the permuted position p gives shard p mod S and slot
p div S. So shards differ by one row at most, slots have no gaps, and anyone who knows
(rank, N, key) can compute the place of a row, or the row of a place, without the data.

The Feistel domain is the smallest power of two that holds N. A value that falls
outside 0..N-1 is put through the network again until it falls inside (cycle walking),
which keeps the mapping a bijection.

Defined cases: a null text has no bytes (size 1, crc 0); a null id ranks first and
stays null; rows equal in id, size and crc are interchangeable; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Round function: x -> ((x + key)^2 mod P) * MULTIPLIER mod P, all within 63 bits.
PRIME = 2147483647
MULTIPLIER = 48271
ROUND_KEYS = (1640531527, 1013904223, 374761393, 668265263)
#: Walks beyond this many are as likely as 2^-127 for a row; one more raises an error.
MOST_WALKS = 128


def domain_bits(n: int) -> int:
    return max(2, (n - 1).bit_length())


def permute(x: int, n: int, keys=ROUND_KEYS) -> int:
    """The position of row number x among n rows, computed without Spark."""
    x = _network(x, domain_bits(n), keys)
    while x >= n:
        x = _network(x, domain_bits(n), keys)
    return x


def place(row: int, n: int, shards: int, keys=ROUND_KEYS) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = permute(row, n, keys)
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, keys=ROUND_KEYS) -> int:
    """The row number at a place: the network run backwards."""
    x = slot * shards + shard
    if not 0 <= x < n:
        raise ValueError("no such slot")
    x = _network_back(x, domain_bits(n), keys)
    while x >= n:
        x = _network_back(x, domain_bits(n), keys)
    return x


def _mix(v: int, key: int) -> int:
    return ((v + key) % PRIME) ** 2 % PRIME * MULTIPLIER % PRIME


def _widths(bits: int) -> tuple[int, int]:
    return bits // 2, bits - bits // 2


def _network(x: int, bits: int, keys) -> int:
    lw, rw = _widths(bits)
    left, right = x >> rw, x & ((1 << rw) - 1)
    for key in keys:
        left, right = right, left ^ (_mix(right, key) & ((1 << lw) - 1))
        lw, rw = rw, lw
    return left << rw | right


def _network_back(x: int, bits: int, keys) -> int:
    lw, rw = _widths(bits)
    if len(keys) % 2:
        lw, rw = rw, lw
    left, right = x >> rw, x & ((1 << rw) - 1)
    for key in reversed(keys):
        lw, rw = rw, lw
        left, right = right ^ (_mix(left, key) & ((1 << lw) - 1)), left
    return left << rw | right


def network_expr(x: Column, bits: int, keys=ROUND_KEYS) -> Column:
    """The same network as a column: a fold over the keys, so that no round repeats its input."""
    lw, rw = _widths(bits)
    prime, even = F.lit(PRIME).cast("long"), len(keys) % 2 == 0
    steps, wide, narrow = [], lw, rw
    for key in keys:
        steps.append(F.struct(F.lit(key).cast("long").alias("key"), F.lit((1 << wide) - 1).cast("long").alias("mask")))
        wide, narrow = narrow, wide

    def one_round(state: Column, step: Column) -> Column:
        t = F.pmod(state["r"] + step["key"], prime)
        mixed = F.pmod(F.pmod(t * t, prime) * F.lit(MULTIPLIER).cast("long"), prime)
        return F.struct(state["r"].alias("l"), state["l"].bitwiseXOR(mixed.bitwiseAND(step["mask"])).alias("r"))

    start = F.struct(F.shiftright(x, rw).alias("l"), x.bitwiseAND(F.lit((1 << rw) - 1).cast("long")).alias("r"))
    end_width = rw if even else lw
    return F.aggregate(
        F.array(*steps), start, one_round, lambda s: F.shiftleft(s["l"], end_width).bitwiseOR(s["r"])
    )


def with_position(df: DataFrame, row: str, n: int, keys=ROUND_KEYS) -> DataFrame:
    """df with ``position_``: one pass of the network, and a walk only for what fell outside."""
    bits, limit = domain_bits(n), F.lit(n).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(MOST_WALKS)),
        F.col("position_"),
        lambda acc, _: F.when(acc < limit, acc).otherwise(network_expr(acc, bits, keys)),
    )
    inside = F.col("position_") < limit
    return (
        df.withColumn("position_", network_expr(F.col(row), bits, keys))
        .withColumn("position_", F.when(inside, F.col("position_")).otherwise(walked))
        .withColumn("position_", F.when(inside, F.col("position_")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))
    )


def global_row_numbers(df: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """df with ``row_number_`` 0..N-1 in the given order, and N; no global window.

    A range shuffle deals the rows, the position within a partition is read off
    monotonically_increasing_id, and one count per partition gives the offsets. The
    dealt rows are written first, so that counts and positions are of the same deal.
    The salt lets rows equal in every order column be split over partitions.
    """
    position = F.monotonically_increasing_id()
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = (
        df.withColumn("salt_", F.pmod(position, F.lit(1024)))
        .repartitionByRange(*keys, F.col("salt_").asc())
        .sortWithinPartitions(*keys)
        .drop("salt_")
        .withColumn("at_", position)
        .withColumn("part_", F.shiftright("at_", 33))
        .withColumn("at_", F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    dealt = scratch.cut(dealt, "ranged")
    # One row per shuffle partition: its size is bounded by the partition count.
    counts = {r["part_"]: r["n"] for r in dealt.groupBy("part_").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    table = df.sparkSession.createDataFrame(offsets, "part_ long, base_ long")
    numbered = dealt.join(F.broadcast(table), "part_").withColumn("row_number_", F.col("at_") + F.col("base_"))
    return numbered.drop("at_", "part_", "base_"), total


def feistel_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keys=ROUND_KEYS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    numbered, n = global_row_numbers(rows, ["doc_id", "text_crc32", "size"], Scratch(df.sparkSession))
    return with_position(numbered, "row_number_", n, keys).select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("row_number_").alias("row_number"),
        F.pmod(F.col("position_"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"position_ div {int(shards)}").alias("slot"),
    )
