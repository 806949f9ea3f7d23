"""Repair of conversations at the least cost, by a recursive query over batches of whole conversations.

A conversation's rows, by turn (nulls first; equal turns by role, then text), are edited until their
roles' initials read ``(s?(ua)+)?``. Keep is free; Rerole, to user or assistant, costs 3; Insert,
of an empty user or assistant turn anywhere, 3; Delete 4. A row's first fault counts: a blank one (white
space 0x20, 0x09-0x0D alone) and a duplicate (role and text seen earlier in the conversation) must go, a
truncated one (its last character that is not white space is none of ``.!?``) costs 3 more if it stays. Of
equally cheap edits the ASCII-least string of initials (K, R, D, I) counts.

1. *Batches.* Rows are hash-partitioned by conversation. A task reads its partition as batches of
   whole conversations and asks DuckDB a recursive query about each batch: a step of the recursion takes
   every conversation of the batch one turn back, and keeps for each grammar state the least cost
   and, of that, the least audit from there to the end. Going back, a common letter comes before audits
   that are compared already, so the least audit of the rest is part of the least audit of all;
   going forward, an inserted letter could make a longer audit the lesser one later.
2. *Long conversations*, of over ``MOST_ROWS`` rows, are not one task: their rows are numbered by a range
   shuffle and cut into pieces. The same query, started from each grammar state, gives a piece's cheapest way
   from any state to any other. Pieces are joined, ``FAN`` at a time, by the same recursion over
   pieces in place of turns, until each conversation is one. Whether a row was seen in an earlier
   piece is a join with the first place of its role and text.
3. *Texts.* The audit is applied to the rows in order. A digest is sequential by nature: for a
   long conversation one task reads its rows as a stream and holds the state of the hash.

Defined cases: a null role or text is one space, and an empty role has no initial and is none of the three; a
null id is a conversation of its own; null turns come first; rows may repeat; all rows are used,
however long their texts; a conversation that loses all rows has an empty audit, no turns and
the hash of nothing; an empty table gives empty results; other columns are not read. Role and
text of rows of different pieces are compared by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, record_batch
from .sharding import global_row_numbers

#: Rows of a conversation that is solved whole, and of a piece; rows and bytes of a batch; pieces joined at a time.
MOST_ROWS, BATCH_ROWS, BATCH_BYTES, FAN = 512, 20_000, 1 << 25, 32
KEEP, REROLE, INSERT, DELETE, CUT = 0, 3, 3, 4, 3

#: Grammar states by the last initial: nothing yet, s, u, a; and what each initial leads to.
START, S, U, A = range(4)
STEPS = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
FINAL = (START, A)

STATS = ["n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]
PIECE = "conv {kind}, piece long, n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, moves string"
REPORT = "conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv {kind}, place long, edit string, role string, text string"


def _inserted() -> dict[tuple[int, int], int]:
    """(from, to): the fewest inserted turns that lead from one state to another."""
    found = {(p, p): 0 for p in range(4)}
    for _ in range(4):
        for (p, q), n in list(found.items()):
            for (s, initial), r in STEPS.items():
                if s == q and initial != "s" and n + 1 < found.get((p, r), 9):
                    found[p, r] = n + 1
    return found


INSERTED = _inserted()


def _moves() -> list[tuple]:
    """(class, from, to, letter, audit, cost) of a row's edits, turns inserted before it included."""
    out = []
    for (p, q), n in INSERTED.items():
        for kind in "suax":
            steps = [("D", q, DELETE)]
            steps += [("K", STEPS[q, kind], KEEP)] if (q, kind) in STEPS else []
            steps += [("R", STEPS[q, to], REROLE) for to in "ua" if (q, to) in STEPS]
            out += [(kind, p, r, letter, "I" * n + letter, INSERT * n + cost) for letter, r, cost in steps]
    return out


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows) + ")"


#: What a conversation still costs when its rows are used up, by state.
ENDS = [(p, min((INSERT * INSERTED[p, q], "I" * INSERTED[p, q]) for q in FINAL if (p, q) in INSERTED)) for p in range(4)]

ROWS_SQL = """CREATE OR REPLACE TEMP TABLE r AS SELECT *, worded AND NOT duplicate AND NOT ended AS truncated,
    prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au') AS illegal, if(ini IN ('s', 'u', 'a'), ini, 'x') AS class
  FROM (SELECT piece, row, turn, worded, ended, left(role, 1) AS ini, lag(left(role, 1)) OVER w AS prev, row_number() OVER w - 1 AS i,
      worded AND (seen OR row_number() OVER (PARTITION BY piece, role, text ORDER BY turn NULLS FIRST, row) > 1) AS duplicate
    FROM t WINDOW w AS (PARTITION BY piece ORDER BY turn NULLS FIRST, role, text, row))"""
EDITS_SQL = f"""CREATE OR REPLACE TEMP TABLE e AS SELECT r.piece, r.i, m.p, m.r, m.cost + if(r.truncated AND m.letter <> 'D', {CUT}, 0) AS cost, m.audit
  FROM r JOIN {_values(_moves())} AS m(class, p, r, letter, audit, cost) ON m.class = r.class AND (m.letter = 'D' OR (r.worded AND NOT r.duplicate))"""
STATS_SQL = """SELECT piece, count(*), count_if(NOT worded), count_if(duplicate), count_if(truncated), count_if(illegal), count(DISTINCT turn), min(turn), max(turn), arg_min(ini, i), arg_max(ini, i)
  FROM r GROUP BY piece ORDER BY piece"""
#: From the last element of each piece to its first: the cheapest way from state p to the seed.
BACK_SQL = """WITH RECURSIVE f AS (
    SELECT n.piece, n.n AS i, s.seed, s.p, s.cost::BIGINT AS cost, s.audit FROM (SELECT piece, max(i) + 1 AS n FROM e GROUP BY piece) AS n, {seeds} AS s(seed, p, cost, audit)
    UNION ALL
    SELECT piece, i, seed, p, best.cost, best.audit FROM (
      SELECT f.piece, f.i - 1 AS i, f.seed, e.p, min(struct_pack(cost := f.cost + e.cost, audit := e.audit || f.audit)) AS best
      FROM f JOIN e ON e.piece = f.piece AND e.i = f.i - 1 AND e.r = f.p GROUP BY ALL))
  SELECT piece, p, seed, cost, audit FROM f WHERE i = 0 AND {wanted} ORDER BY ALL"""
WHOLE_SQL = BACK_SQL.format(seeds=_values([(0, p, *end) for p, end in ENDS]), wanted=f"p = {START}")
PARTS_SQL = BACK_SQL.format(seeds=_values([(p, p, 0, "") for p in range(4)]), wanted="true")


def _duck():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted batches as tables of whole groups, of about BATCH_ROWS rows, and each row's group in the table."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> list[int]:
        rows = list(zip(*[table.column(k).to_pylist() for k in keys], strict=True))
        number, out = -1, []
        for i, row in enumerate(rows):
            number += i == 0 or row != rows[i - 1]
            out.append(number)
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < BATCH_ROWS and sum(b.nbytes for b in held) < BATCH_BYTES:
            continue
        table = pa.Table.from_batches(held)
        numbers = cut(table)
        stop = numbers.index(numbers[-1])  # the last group may go on
        if stop:
            yield table.slice(0, stop).combine_chunks(), numbers[:stop]
            held = table.slice(stop).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def _solve(duck, table: pa.Table, numbers: list[int], whole: bool):
    """Each group's statistics, its rows in order, and (from, to, cost, audit) of its cheapest ways."""
    t = table.append_column("piece", pa.array(numbers, pa.int64())).append_column("row", pa.array(range(len(numbers)), pa.int64()))
    duck.register("t", t)
    duck.execute(ROWS_SQL)
    stats = duck.execute(STATS_SQL).fetchall()
    order: list[list[int]] = [[] for _ in stats]
    for piece, row in duck.execute("SELECT piece, row FROM r ORDER BY piece, i").fetchall():
        order[piece].append(row)
    duck.execute(EDITS_SQL)
    ways: list[list[tuple]] = [[] for _ in stats]
    for piece, *way in duck.execute(WHOLE_SQL if whole else PARTS_SQL).fetchall():
        ways[piece].append(tuple(way))
    duck.unregister("t")
    return stats, order, ways


class _Edited:
    """Applies an audit to rows in order: (edit, role, text) of the turns that stay, whatever pieces they come in."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _next(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        if edit != "K":
            role = "assistant" if self.state == U else "user"
        self.state = STEPS[self.state, role[:1]]
        return edit, role, text

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._next("I", "", "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._next(edit, role, text)


class _Digest:
    """SHA-256 of ``role:text`` joined by line feeds, a turn at a time."""

    def __init__(self):
        self.hash, self.mark = hashlib.sha256(), b""

    def add(self, role: str, text: str) -> None:
        self.hash.update(self.mark + f"{role}:{text}".encode())
        self.mark = b"\n"


def _gaps(stats) -> int:
    _, _, _, _, _, turns, low, high = stats
    return 0 if low is None else high - low + 1 - turns


def _whole(batches: Iterator[pa.RecordBatch], kind: str, turns: bool) -> Iterator[pa.RecordBatch]:
    duck, schema = _duck(), arrow_schema((TURNS if turns else REPORT).format(kind=kind))
    for table, numbers in _groups(batches, ["conv"]):
        out = []
        conv, role, text = (table.column(c).to_pylist() for c in ("conv", "role", "text"))
        for (_, *stats, _, _), order, ways in zip(*_solve(duck, table, numbers, True), strict=True):
            (_, _, cost, audit) = ways[0]
            edited, digest, place = _Edited(audit), _Digest(), 0
            stays = [t for i in order for t in edited.row(role[i], text[i])] + list(edited.inserted())
            if turns:
                out += [(conv[order[0]], place, *t) for place, t in enumerate(stays)]
                continue
            for _, r, x in stays:
                digest.add(r, x)
            out.append((conv[order[0]], _gaps(stats), *stats[1:5], cost, audit, digest.hash.hexdigest()))
        yield record_batch(out, schema)


def _parts(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    duck, schema = _duck(), arrow_schema(PIECE.format(kind=kind))
    for table, numbers in _groups(batches, ["conv", "piece"]):
        conv, piece = table.column("conv").to_pylist(), table.column("piece").to_pylist()
        found = zip(*_solve(duck, table.drop_columns(["piece"]), numbers, False), strict=True)
        yield record_batch([(conv[order[0]], piece[order[0]], *stats, json.dumps(ways)) for (_, *stats), order, ways in found], schema)


def _joined(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Neighbouring pieces of a conversation as one."""
    duck, schema = _duck(), arrow_schema(PIECE.format(kind=kind))
    for table, numbers in _groups(batches, ["conv", "group"]):
        rows, firsts = table.to_pylist(), {}
        edits = []
        for i, (row, g) in enumerate(zip(rows, numbers, strict=True)):
            firsts.setdefault(g, i)
            edits += [(g, i - firsts[g], *way) for way in json.loads(row["moves"])]
        duck.register("t", pa.table({n: pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(("piece", "i", "p", "r", "cost", "audit"), zip(*edits, strict=True), strict=True)}))
        duck.execute("CREATE OR REPLACE TEMP TABLE e AS SELECT * FROM t")
        ways: list[list] = [[] for _ in firsts]
        for g, *way in duck.execute(PARTS_SQL).fetchall():
            ways[g].append(way)
        duck.unregister("t")
        out, ends = [], [*firsts.values(), len(rows)]
        for g, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            total = dict(rows[a])
            for row in rows[a + 1 : b]:
                for c in STATS[:6]:
                    total[c] += row[c]
                total["illegal"] += total["last"] + row["first"] not in ("su", "ua", "au")
                total["turns"] -= row["low"] is not None and row["low"] == total["high"]
                total["high"], total["last"] = row["high"], row["last"]
                total["low"] = row["low"] if total["low"] is None else total["low"]
            out.append((total["conv"], total["group"], *[total[c] for c in STATS], total["first"], total["last"], json.dumps(ways[g])))
        yield record_batch(out, schema)


def _streamed(batches: Iterator[pa.RecordBatch], kind: str, turns: bool) -> Iterator[pa.RecordBatch]:
    """A conversation's row with its audit comes first, then its rows in order."""
    schema = arrow_schema((TURNS if turns else REPORT).format(kind=kind))
    edited, digest, place, head = None, None, 0, None

    def ended() -> list[tuple]:
        if edited is None:
            return []
        rest = [put(t) for t in edited.inserted()]
        return rest if turns else [(*head, digest.hash.hexdigest())]

    def put(turn: tuple) -> tuple:
        nonlocal place
        digest.add(*turn[1:])
        place += 1
        return (conv, place - 1, *turn)

    conv = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["row_number_"] < 0:
                out += ended()
                found = json.loads(row["text"])
                conv, head = row["conv"], (row["conv"], *found)
                edited, digest, place = _Edited(found[-1]), _Digest(), 0
            else:
                got = [put(t) for t in edited.row(row["role"], row["text"])]
                out += got if turns else []
        yield record_batch(out, schema)
    yield record_batch(ended(), schema)


def _final(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """A conversation that is one piece: what its report holds but for the digest, as JSON."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ends = dict(ENDS)
            cost, audit = min((cost + ends[r][0], audit + ends[r][1]) for p, r, cost, audit in json.loads(row["moves"]) if p == START)
            out.append((row["conv"], -1, "", json.dumps([_gaps([row[c] for c in STATS]), *[row[c] for c in STATS[1:5]], cost, audit])))
        yield record_batch(out, arrow_schema(f"conv {kind}, row_number_ long, role string, text string"))


def _worded(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def _ended(text: Column) -> Column:
    return text.rlike(r"[.!?][\x20\x09-\x0D]*+\z")


class Repair:
    """``report``, a row for each conversation, and ``turns``, a row for each turn of the repaired ones.

    report: conv, gaps (turn numbers that are missing), blank, duplicate, truncated and illegal (neighbours)
    counts, cost, audit, repaired_sha256. turns: conv, place, edit, role, text.
    """

    def __init__(self, df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = MOST_ROWS):
        self.most, self.kind = most_rows, df.schema[id_col].dataType.simpleString().replace("bigint", "long")
        self.scratch = Scratch(df.sparkSession)
        filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = df.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
        counts = rows.groupBy("conv").agg(F.count("*").alias("n_")).where(F.col("n_") > most_rows).select(F.col("conv").alias("conv_"))
        self.long_ids = self.scratch.cut(counts, "long")
        self.any_long = not self.long_ids.isEmpty()
        self.rows = rows.withColumn("worded", _worded(F.col("text"))).withColumn("ended", _ended(F.col("text")))
        self.ranked = self.audits = None

    def _met(self, how: str) -> DataFrame:
        return self.rows.join(self.long_ids, F.col("conv").eqNullSafe(F.col("conv_")), how)

    def _whole(self, turns: bool) -> DataFrame:
        rows = (self._met("left_anti") if self.any_long else self.rows).withColumn("seen", F.lit(False))
        kind = self.kind
        return rows.repartition("conv").sortWithinPartitions("conv").mapInArrow(lambda b: _whole(b, kind, turns), (TURNS if turns else REPORT).format(kind=kind))

    def _long(self, turns: bool) -> DataFrame:
        if self.audits is None:
            self._solve_long()
        kind = self.kind
        stream = self.audits.unionByName(self.ranked.select("conv", "row_number_", "role", "text"))
        return stream.repartition("conv").sortWithinPartitions("conv", "row_number_").mapInArrow(lambda b: _streamed(b, kind, turns), (TURNS if turns else REPORT).format(kind=kind))

    def _solve_long(self) -> None:
        scratch, kind = self.scratch, self.kind
        ranked, _ = global_row_numbers(self._met("left_semi"), ["conv", "turn", "role", "text"], scratch)
        keys = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(0x5EED), "text", "role").alias("k2")]
        firsts = ranked.groupBy("conv", *keys).agg(F.min("row_number_").alias("first_"), F.count("*").alias("n_")).where("n_ > 1")
        firsts = firsts.select(F.col("conv").alias("conv_"), F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), "first_")
        same = F.col("conv").eqNullSafe(F.col("conv_")) & (keys[0] == F.col("k1_")) & (keys[1] == F.col("k2_"))
        seen = F.coalesce(F.col("first_") < F.col("row_number_"), F.lit(False))
        self.ranked = scratch.cut(ranked.join(firsts, same, "left").withColumn("seen", seen).drop("conv_", "k1_", "k2_", "first_"), "ranked")
        rows = self.ranked.withColumn("piece", F.expr(f"row_number_ div {self.most}")).drop("row_number_")
        ddl, label, level = PIECE.format(kind=kind), "pieces-0", 0
        pieces = scratch.cut(rows.repartition("conv", "piece").sortWithinPartitions("conv", "piece").mapInArrow(lambda b: _parts(b, kind), ddl), label)
        while not pieces.groupBy("conv").agg(F.count("*").alias("n_")).where("n_ > 1").isEmpty():
            level += 1
            grouped = pieces.withColumn("group", F.expr(f"piece div {FAN}")).repartition("conv", "group").sortWithinPartitions("conv", "group", "piece")
            pieces = scratch.cut(grouped.mapInArrow(lambda b: _joined(b, kind), ddl), f"pieces-{level}")
            scratch.drop(label)
            label = f"pieces-{level}"
        self.audits = pieces.mapInArrow(lambda b: _final(b, kind), f"conv {kind}, row_number_ long, role string, text string")
        scratch.drop("ranged")

    @property
    def report(self) -> DataFrame:
        return self._whole(False).unionByName(self._long(False)) if self.any_long else self._whole(False)

    @property
    def turns(self) -> DataFrame:
        return self._whole(True).unionByName(self._long(True)) if self.any_long else self._whole(True)
