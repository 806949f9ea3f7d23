"""Packing of messages into windows of a token budget, one channel in parallel.

Greedy packing looks sequential, but what a piece of a channel does to the packing depends on its
past by one number alone: the tokens in the window that is open when it begins. Messages are dealt by
range, so that a channel's pieces lie in a row of partitions. Within a piece every message points to
the one that would open the next window, found by binary search on prefix sums; pointer doubling
gives for each message, if a window opened there, how many windows follow and what the last one
holds. So a piece is a short table from tokens in the open window to windows added and tokens in the
window open at its end. These tables are applied in order, one number of state, and
then every piece numbers its own messages.

The result is that of ``chunk.window_numbers``. A piece's table has no more rows than the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..sources.scratch import checkpointed
from .chunk import BUDGET

#: No window is open; the open window goes on through a whole piece.
CLOSED, THROUGH = -1, -2


class Piece:
    """Consecutive messages of one channel, by their tokens."""

    def __init__(self, tokens: np.ndarray, budget: int):
        self.n, self.budget, self.tokens = len(tokens), budget, tokens
        self.sums = np.concatenate([[0], np.cumsum(tokens)])
        at = np.arange(self.n)
        # The message that opens the next window, if one opened here; n: none in this piece.
        self.next = np.append(np.maximum(at + 1, np.searchsorted(self.sums[1:], self.sums[:-1] + budget, "right")), self.n)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """For a window opened at each message: windows by the piece's end, and tokens in the one then open."""
        jump, hops = self.next.copy(), (self.next < self.n).astype(np.int64)
        last = np.where(jump < self.n, jump, np.arange(self.n + 1))
        while (jump < self.n).any():
            hops, last, jump = hops + hops[jump], np.where(jump < self.n, last[jump], last), jump[jump]
        hops, last = hops[: self.n], last[: self.n]
        alone = self.tokens[last] > self.budget
        return hops + alone, np.where(alone, CLOSED, self.sums[self.n] - self.sums[last])

    def opens_at(self, used: int) -> int:
        """The first message that opens a window here, when so many tokens are in the open one."""
        return 0 if used == CLOSED else int(np.searchsorted(self.sums[1:], self.budget - used, "right"))

    def table(self) -> dict:
        """``low``: least tokens used on entry, in falling order; ``windows`` added and tokens ``used`` at the end for each."""
        windows, used = self.ends()
        breaks = np.flatnonzero((self.sums[1:] > self.sums[:-1]) & (self.sums[:-1] <= self.budget))
        low = np.maximum(0, self.budget - self.sums[breaks + 1] + 1)
        rest = int(self.budget - self.sums[self.n])
        return {
            "closed": [int(windows[0]), int(used[0])], "total": int(self.sums[self.n]),
            "low": low.tolist() + [0] * (rest >= 0), "windows": (windows[breaks] + 1).tolist() + [0] * (rest >= 0), "used": used[breaks].tolist() + [THROUGH] * (rest >= 0),
        }

    def numbers(self, window: int, used: int) -> np.ndarray:
        """Each message's window, when ``window`` is the open one's number, or the next one's if none is open."""
        opens, at = np.zeros(self.n, np.int64), self.opens_at(used)
        while at < self.n:
            opens[at], at = 1, self.next[at]
        return window + np.cumsum(opens) - (used == CLOSED)


def after(table, window: int, used: int) -> tuple[int, int]:
    """(window, used) behind a piece, by its table."""
    if used == CLOSED:
        return window + table["closed"][0], table["closed"][1]
    # Rows are in falling order of the least tokens they hold for.
    row = int(np.argmax(np.asarray(table["low"]) <= used))
    end = table["used"][row]
    return window + table["windows"][row], used + table["total"] if end == THROUGH else end


TABLE = "struct<closed:array<bigint>,total:bigint,low:array<bigint>,windows:array<bigint>,used:array<bigint>>"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's rows as one frame per channel."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for _, part in pdf.groupby((pdf["channel_id"] != pdf["channel_id"].shift()).cumsum(), sort=False):
            if held and held[-1]["channel_id"].iloc[-1] != part["channel_id"].iloc[0]:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def parallel_window_numbers(messages: DataFrame, budget: int = BUDGET, parts: int | None = None) -> DataFrame:
    """(channel_id, pos, window, truncated) of every message; a channel may be any number of tasks.

    channel_id is a string, pos a whole number that does not repeat in a channel. Null tokens count as none.
    """
    rows = messages.select("channel_id", F.col("pos").cast("long").alias("pos"), F.coalesce(token_count(F.col("text")), F.lit(0).cast("long")).alias("tokens"))
    deal = (rows.repartitionByRange("channel_id", "pos") if parts is None else rows.repartitionByRange(parts, "channel_id", "pos")).sortWithinPartitions("channel_id", "pos")
    dealt = checkpointed(deal.withColumn("part", F.spark_partition_id()))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A channel that lies within the partition needs no table; only the first and the last may go on elsewhere.
        first = last = None
        for run in _runs(batches):
            first, last = first if first is not None else run, run
        for run in [first] if first is last else [first, last]:
            if run is not None:
                table = Piece(run["tokens"].to_numpy(), budget).table()
                yield pd.DataFrame({"channel_id": [run["channel_id"].iloc[0]], "part": [run["part"].iloc[0]], "piece": [table]})

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, state = None, (0, CLOSED)
        for pdf in batches:
            entered = []
            for c, table in zip(pdf["channel_id"], pdf["piece"], strict=True):
                if c != channel:
                    channel, state = c, (0, CLOSED)
                entered.append(state)
                state = after(table, *state)
            yield pdf[["channel_id", "part"]].assign(window=[s[0] for s in entered], used=[s[1] for s in entered])

    pieces = dealt.mapInPandas(summarise, f"channel_id string, part int, piece {TABLE}")
    ordered = pieces.repartition("channel_id").sortWithinPartitions("channel_id", "part")
    entries = ordered.mapInPandas(enter, "channel_id string, part int, window long, used long").where(f"window > 0 or used != {CLOSED}")
    # A partition is entered by one channel at most: no more rows than partitions.
    known = {r["part"]: (r["channel_id"], r["window"], r["used"]) for r in entries.collect()}

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(batches):
            channel, window, used = known.get(int(run["part"].iloc[0]), (None, 0, CLOSED))
            state = (window, used) if channel == run["channel_id"].iloc[0] else (0, CLOSED)
            tokens = run["tokens"].to_numpy()
            yield pd.DataFrame({"channel_id": run["channel_id"], "pos": run["pos"], "window": Piece(tokens, budget).numbers(*state), "truncated": tokens > budget})

    return dealt.mapInPandas(number, "channel_id string, pos long, window long, truncated boolean")
