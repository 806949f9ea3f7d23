"""Replies of providers: nested fields, the path of the first fault, and short or long answers to batches."""

import json

import pytest

from loomline.functions.text import reply_fault, structured
from loomline.plans import providers

DDL = "name string, price decimal(10,2), tags array<string>, owner struct<id: bigint, mail: string COMMENT 'optional'>, lines array<struct<kind: string, n: int>>"
GOOD = {"name": "a", "price": 1.25, "tags": ["x"], "owner": {"id": 1}, "lines": [{"kind": "in", "n": 1}, {"kind": "out", "n": 2}]}
ALLOWED = {"$.lines[].kind": ["in", "out"], "$.name": ["a", "b"]}


def changed(**fields):
    return json.dumps({k: v for k, v in (GOOD | fields).items() if v != "gone"})


CASES = [
    (changed(), None), ("```json\n" + changed(owner={"id": 2, "mail": "m"}, extra=1) + "\n```", None), (changed(tags=[], lines=[]), None),
    (None, "$"), ("", "$"), ("no object", "$"), ("[1]", "$"), (changed() + " and more", "$"), (changed(price="dear"), "$"), (changed(owner=3), "$"), (changed(lines=[{"kind": "in", "n": "x"}]), "$"),
    (changed(name="gone"), "$.name"), (changed(name=None), "$.name"), (changed(name="c"), "$.name"), (changed(price="gone"), "$.price"), (changed(tags=["x", None]), "$.tags[1]"),
    (changed(owner={"mail": "m"}), "$.owner.id"), (changed(owner="gone"), "$.owner"), (changed(lines=[{"kind": "in", "n": 1}, {"kind": "up", "n": 1}]), "$.lines[1].kind"), (changed(lines=[{"kind": "in"}]), "$.lines[0].n"),
    (changed(lines=[None]), "$.lines[0]"),
]


def test_the_first_fault_is_named(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(CASES)], "i int, reply string")
    got = {r["i"]: (r["fault"], r["value"]) for r in rows.select("i", reply_fault(rows.reply, DDL, ALLOWED).alias("fault"), structured(rows.reply, DDL, ALLOWED).alias("value")).collect()}
    assert [got[i][0] for i in range(len(CASES))] == [fault for _, fault in CASES]
    assert all((got[i][1] is None) == (fault is not None) for i, (_, fault) in enumerate(CASES))
    assert got[0][1]["lines"][1]["kind"] == "out" and str(got[0][1]["price"]) == "1.25"


@pytest.mark.parametrize("by", [-1, 1])
def test_a_reply_with_other_than_as_many_vectors_is_an_error_in_its_rows(spark, by):
    class Uneven(providers.LocalProvider):
        def __init__(self, by):
            self.by = by

        def embed_many(self, texts):
            got = providers.LocalProvider.embed_many(self, texts)
            return got[: self.by] if self.by < 0 else got + got[: self.by]

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "i int, text string").coalesce(1)
    got = providers.embedded(rows, Uneven(by), "text", most_rows=3, tries=1).collect()
    assert len(got) == 6 and all(r["vector"] is None and r["error"] == f"{3 + by} vectors for 3 texts" for r in got)
    fine = providers.embedded(rows, providers.LocalProvider(), "text", most_rows=3).collect()
    assert all(r["error"] is None and len(r["vector"]) == providers.DIMS for r in fine)
