"""Best-fit packing into several permitted sequence lengths at once.

A document longer than the largest capacity gives full bins of its own and one rest; all
rests are packed. Rows are ranked globally and dealt by rank into groups of at most
``group_size`` rests, whatever their keys are, and each group is packed by itself:

* pieces in order of falling length; each goes to the open bin with the least room left
  that still holds it (best fit), of equal ones the bin that came to that room last;
* where none does, a bin is opened at the capacity with the least cost per filled unit,
  judged by filling each permitted capacity from the pieces still to come;
* at the end each bin shrinks to the smallest permitted capacity that holds its contents.

A length is a quarter of the text's UTF-8 bytes, rounded up, plus one end mark, unless
a length column is given; ``pack_tokens`` gives the tokenizer's count plus one end mark. A bin's cost is its capacity plus a fixed cost per sequence.

Defined cases: a null or empty text has the length 1 (its end mark); a null length
counts as 1, lengths under 1 too; ids may be null or repeat; every row is placed
exactly once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .sharding import global_row_numbers
from .tokens import count_tokens

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SEQUENCE_COST = 32
GROUP_SIZE = 4096
PLACED = "doc_id long, piece long, piece_start long, piece_length long, bin_id string, bin_capacity long, bin_used long, bin_offset long"


def text_length(text_col: str = "text") -> Column:
    return (F.ceil(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) / 4) + 1).cast("long")


def _filled(capacity: int, first: int, left: dict[int, int], lengths: list[int]) -> int:
    """Units a bin would hold if it took the first piece and then the largest of the rest that fit."""
    room, taken = capacity - first, {}
    at = bisect_left(lengths, room + 1)
    while at > 0 and room > 0:
        n = lengths[at - 1]
        free = left[n] - taken.get(n, 0)
        if n > room or free <= 0:
            at = min(at - 1, bisect_left(lengths, room + 1))
            continue
        use = min(free, room // n)
        taken[n] = taken.get(n, 0) + use
        room -= use * n
    return capacity - room


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, sequence_cost: float = SEQUENCE_COST) -> list[tuple[int, int, int, int]]:
    """(bin, capacity, used, offset) for each length; bins are numbered from 0.

    Equal lengths keep their order, so the result depends on the list alone.
    """
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left: dict[int, int] = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    waiting = sorted(left)
    opened: list[int] = []  # capacity of each bin
    used: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if an open bin has r units left
    at: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in order:
        n = lengths[i]
        left[n] -= 1
        if not left[n]:
            del left[n]
            waiting.pop(bisect_left(waiting, n))
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms &= ~(1 << room)
        else:
            able = [c for c in sizes if c >= n]
            price = lambda c, n=n: ((c + sequence_cost) / _filled(c, n, left, waiting), c)
            capacity = min(able, key=price)
            b, room = len(opened), capacity
            opened.append(capacity)
            used.append(0)
        at[i] = (b, used[b])
        used[b] += n
        room -= n
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return [(b, final[b], used[b], offset) for b, offset in at]


def pack_documents(
    df: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = None,
    group_size: int = GROUP_SIZE,
    sequence_cost: float = SEQUENCE_COST,
) -> DataFrame:
    """One row per piece: where it lies in its document, and where in which bin."""
    most = max(capacities)
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(1)), F.lit(1)) if length_col else text_length(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("length_"))
    numbered, n = global_row_numbers(rows, ["doc_id", "length_"], Scratch(df.sparkSession))
    groups = max(1, -(-n // group_size))
    numbered = numbered.withColumn("full_", F.expr(f"length_ div {most}")).withColumn("rest_", F.expr(f"length_ % {most}"))

    whole = numbered.where("full_ > 0").select("doc_id", "row_number_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full_") - 1)).alias("piece"))
    whole = whole.select(
        "doc_id", "piece", (F.col("piece") * most).alias("piece_start"), F.lit(most).cast("long").alias("piece_length"),
        F.concat(F.lit("f"), F.col("row_number_"), F.lit("-"), F.col("piece")).alias("bin_id"),
        F.lit(most).cast("long").alias("bin_capacity"), F.lit(most).cast("long").alias("bin_used"), F.lit(0).cast("long").alias("bin_offset"),
    )

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        # A group comes in no set order; the rank gives it one.
        pdf = pdf.sort_values("row_number_", kind="stable")
        lengths = pdf["rest_"].tolist()
        placed = pd.DataFrame(pack(lengths, capacities, sequence_cost), columns=["b", "bin_capacity", "bin_used", "bin_offset"], index=pdf.index)
        group = pdf["group_"].iloc[0] if len(pdf) else 0
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["full_"], "piece_start": pdf["full_"] * most, "piece_length": pdf["rest_"],
                "bin_id": [f"g{group}-{b}" for b in placed["b"]], "bin_capacity": placed["bin_capacity"], "bin_used": placed["bin_used"], "bin_offset": placed["bin_offset"],
            }
        )

    rests = numbered.where("rest_ > 0").select("doc_id", "row_number_", "full_", "rest_", F.pmod(F.col("row_number_"), F.lit(groups)).alias("group_"))
    return whole.union(rests.groupBy("group_").applyInPandas(pack_group, PLACED))



def pack_tokens(df: DataFrame, **options) -> DataFrame:
    """``pack_documents`` by the tokens that a trainer sees; df has the columns of ``count_tokens``."""
    counted = count_tokens(df).select("doc_id", (F.col("n_tokens") + 1).alias("length"))
    # Packing reads its rows more than once, until they are ranked; texts are tokenized once.
    scratch = Scratch(df.sparkSession)
    packed = pack_documents(scratch.cut(counted, "lengths"), length_col="length", **options)
    scratch.drop("lengths")
    return packed
