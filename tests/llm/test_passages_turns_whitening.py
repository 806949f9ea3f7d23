"""Conversation repair, whitening and substring removal against plain versions and their defined cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from loomline.llm import phrases, queries, repair, whitening
from loomline.llm.common import Scratch

TURN = "conv_id long, turn long, role string, text string, conv string, row_number_ string"


# ------------------------------------------------------------------ repair


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        worded = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not worded else "duplicate" if (role, text) in seen else "truncated" if worded[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def try_every_edit(rows):
    """The least (cost, audit) over every string of edits, with up to two turns inserted in each gap."""
    flaws, best = faults(rows), None
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any(x in ("blank", "duplicate") and e != "D" for x, e in zip(flaws, letters, strict=True)):
            continue
        for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
            audit = gaps[0] + "".join(e + g for e, g in zip(letters, gaps[1:], strict=True))
            cost = 3 * audit.count("I") + 4 * audit.count("D") + 3 * audit.count("R") + 3 * sum(x == "truncated" and e != "D" for x, e in zip(flaws, letters, strict=True))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            kept, out = iter(rows), []
            for e in audit:
                row = ("", "") if e == "I" else next(kept)
                if e != "D":
                    last = out[-1][0][:1] if out else ""
                    out.append((row[0] if e == "K" else "assistant" if last == "u" else "user", row[1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def random_conversations(n, most, seed=3):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "usher"], ["Yes.", "No", " ", "", None, "Why?", "ok!  ", "a b\n"]
    out = []
    for c in range(n):
        turns = sorted((rng.choice([None, *range(6)]) for _ in range(rng.randint(1, most))), key=lambda t: (t is not None, t))
        out += [(c if c else None, t, rng.choices(roles, [5, 5, 2, 1, 1, 1, 1])[0], rng.choice(texts), "x", "y") for t in turns]
    return out


def plain_report(rows):
    filled = sorted(((t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x, *_ in rows), key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode()))
    pairs = [(r, x) for _, r, x in filled]
    turns, flaws = [t for t, *_ in filled if t is not None], faults(pairs)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(pairs))
    return pairs, (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(flaws.count(k) for k in ("blank", "duplicate", "truncated")), illegal)


@pytest.mark.parametrize("most_rows", [512, 2])
def test_repair_equals_trying_every_edit(spark, most_rows):
    """With pieces of two rows, every longer conversation goes through the joining of pieces."""
    rows = random_conversations(60, 4)
    fixed = repair.Repair(spark.createDataFrame(rows, TURN), most_rows=most_rows)
    got = {r["conv"]: tuple(r)[1:] for r in fixed.report.collect()}
    turns = {}
    for r in sorted(fixed.turns.collect(), key=lambda r: r["place"]):
        turns.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    ids = {r[0] for r in rows}
    assert set(got) == ids
    for c in ids:
        pairs, stats = plain_report([r for r in rows if r[0] == c])
        cost, audit, text = try_every_edit(pairs)
        assert got[c] == (*stats, cost, audit, hashlib.sha256(text.encode()).hexdigest())
        assert "\n".join(turns.get(c, [])) == text


def test_pieces_of_long_conversations_join_to_what_one_piece_gives(spark):
    rng = random.Random(7)
    text = ["Yes.", "No", "", "Well.", "Why?"]
    rows = [(c, None if rng.random() < 0.02 else rng.randrange(400), rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(text) + (str(rng.randrange(90)) + "." if rng.random() < 0.7 else ""), "", "") for c, n in ((1, 700), (2, 5), (3, 150), (4, 701)) for _ in range(n)]
    df = spark.createDataFrame(rows, TURN).repartition(5)
    whole = sorted(map(tuple, repair.Repair(df, most_rows=1000).report.collect()))
    for most in (64, 7):
        assert sorted(map(tuple, repair.Repair(df, most_rows=most).report.collect())) == whole
    assert len(whole) == 4 and min(len(r[7]) for r in whole) >= 5


def test_repair_of_nothing_and_of_a_very_long_text(spark):
    empty = repair.Repair(spark.createDataFrame([], TURN))
    assert empty.report.count() == 0 and empty.turns.count() == 0
    big = "word " * 400_000 + "end."
    r = repair.Repair(spark.createDataFrame([(1, 0, "user", big, "", ""), (1, 1, "assistant", big, "", "")], TURN)).report.collect()
    assert [tuple(x)[1:8] for x in r] == [(0, 0, 0, 0, 0, 0, "KK")]
    assert r[0]["repaired_sha256"] == hashlib.sha256(f"user:{big}\nassistant:{big}".encode()).hexdigest()


def test_op11_reports_conversations_that_lost_every_row(spark, tmp_path):
    import zlib

    gone = [t for t in range(400) if zlib.crc32(f"7:{t}".encode()) % 20 == 0][:2]
    rows = [(7, t, "user", "Hm.", "", "") for t in gone] + [(None, None, None, None, "", "")]
    spark.createDataFrame(rows, TURN).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    kind = zlib.crc32(b" : ") % 20
    assert set(got) == {7, None} and (kind == 0 or got[None][-2].strip("D") == "")


# ------------------------------------------------------------------ whitening


def plain_whitening(vectors, most=16):
    x = np.floor(64 * np.array(vectors, np.float64)) + 1_000_000
    fit = np.unique(x, axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    total = [sum(int(c) for c in col) for col in fit.T]
    deviation = [sum((len(fit) * int(c) - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
    return (x - fit.mean(axis=0)) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), deviation, len(fit)


@pytest.mark.parametrize("tile", [3, 32])
def test_whitening_equals_numpy(spark, tile):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20))).tolist()
    vectors += vectors[:40] + [vectors[0]] * 100  # rows that repeat count once
    rows = [(i % 400, v, None, "s", -1) for i, v in enumerate(vectors)]
    bad = [(1, None), (2, [1.0, None] + [0.0] * 18), (3, [float("nan")] + [0.0] * 19), (4, [float("-inf")] + [0.0] * 19), (5, []), (6, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, x binary, d string, i long"
    df = spark.createDataFrame(rows + [(*b, None, "s", 1) for b in bad], schema).repartition(6)
    got = whitening.whitened(df, tile=tile).toPandas()
    w, share, deviation, n = plain_whitening(vectors)
    assert len(got) == len(vectors) * 16 and set(got.n) == {n} and got.identity_error.max() < 1e-9
    for i, (row, dev) in enumerate(zip(w, deviation, strict=True)):
        mine = got[got.vec_id == i % 400].sort_values("component")
        assert set(mine.deviation) == {dev} or len(mine) > 16
        if len(mine) == 16:
            assert np.allclose(np.abs(mine.whitened), np.abs(row), rtol=0, atol=1e-9)
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-9)


def test_whitening_keeps_signs_together_and_leaves_out_what_does_not_vary(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((80, 3))
    vectors = np.concatenate([base, base[:, :1] * 0 + 5], axis=1)  # a dimension without variance
    got = whitening.whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).toPandas()
    m = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert m.shape == (80, 3) and np.allclose(m.T @ m / 80, np.eye(3), atol=1e-9)


def test_whitening_of_few_vectors_and_of_great_numbers(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0
    two = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0]), (2, [3.0, 4.0])], schema)).collect()
    assert sorted(r["vec_id"] is None for r in two) == [False, True] and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in two)
    great = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e12, 1.0])], schema)).collect()
    assert len(great) == 2 and all(r["deviation"] is None for r in great)


# ------------------------------------------------------------------ substrings


def plain_removal(rows, window=20):
    """Windows in order of (id, start); what rows of one id share at one place is not earlier."""
    first, words = {}, [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    place = lambda i, s: (rows[i][0] is not None, rows[i][0] or 0, s)
    for i, w in enumerate(words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, place(i, s)), place(i, s))
    out = []
    for i, w in enumerate(words):
        gone = {j for s in range(len(w) - window + 1) if place(i, s) > first[tuple(w[s : s + window])] for j in range(s, s + window)}
        out.append((rows[i][0], b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), len(w), len(gone)))
    return sorted(out, key=str)


def passages(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "naïve", "x.y,", " ", "WORD", "word"]
    text = lambda n: rng.choice([" ", "  ", "\n", "\t "]).join(rng.choice(words) for _ in range(n))
    shared = [text(n) for n in (19, 20, 21, 30, 55, 120)]
    rows = [(i, " ".join(rng.choice([text(rng.randint(1, 40)), rng.choice(shared)]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(i, rows[3][1]) for i in range(200, 230)]  # exact copies
    rows += [(i, shared[5] + " " + text(5)) for i in range(300, 340)]
    rows += [(None, shared[4]), (None, None), (400, ""), (401, " \n "), (402, None), (5, shared[5]), (5, text(30) + " " + shared[5]), (6, rows[6][1]), (403, "la " * 300), (404, "la la lu " * 40)]
    return rows


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("window,anchor", [(20, 8), (5, 5), (6, 1)])
def test_removal_equals_brute_force(spark, monkeypatch, hot, window, anchor):
    """Hot: every anchor of more than three segments goes the way of hot ones."""
    if hot:
        monkeypatch.setattr(phrases, "_most_segments", lambda total: 3)
    rows = passages()
    df = spark.createDataFrame([(*r, "n", 7, 1.5) for r in rows], "doc_id long, text string, words string, anchor int, text_key double").repartition(7)
    got = phrases.without_repeats(df, window=window, anchor=anchor).collect()
    assert sorted(map(tuple, got), key=str) == plain_removal(rows, window)


def test_runs_of_windows_do_not_depend_on_the_chunk(monkeypatch):
    rng = np.random.default_rng(2)
    hashes, doc = rng.integers(0, 40, 3000).astype(np.uint64), np.sort(rng.integers(0, 30, 3000))
    spread = lambda runs: [(int(a), s) for a, lo, hi in zip(*runs, strict=True) for s in range(lo, hi + 1)]
    whole = spread(phrases.anchor_runs(hashes, doc, 20, 8))
    assert [s for _, s in whole] == [s for s in range(2981) if doc[s] == doc[s + 19]]
    monkeypatch.setattr(phrases, "CHUNK", 64)
    assert [s for _, s in spread(phrases.anchor_runs(hashes, doc, 20, 8))] == [s for _, s in whole]


def test_spans_are_given_for_a_very_long_text(spark):
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(500_000)}" for _ in range(300_000))
    part = " ".join(long.split()[250_000:250_060])
    df = spark.createDataFrame([(1, long), (2, "so " + part + " it goes")], "doc_id long, text string")
    spans = phrases.repeated_spans(df, Scratch(spark)).collect()
    assert {r["doc_id"] for r in spans} == {2} and (min(r["from_word"] for r in spans), max(r["to_word"] for r in spans)) == (1, 61)
    kept = {r["doc_id"]: r for r in phrases.without_repeats(df).collect()}
    assert kept[2]["text"] == "so it goes" and kept[1]["n_removed"] == 0


def test_removal_from_nothing(spark):
    assert phrases.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
