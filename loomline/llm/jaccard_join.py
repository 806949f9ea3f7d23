"""Exact Jaccard self-join of documents by a token-group matrix, and its components.

A document's set is its distinct k-word shingles. Documents with equal sets are one
class; classes link when the Jaccard similarity of their sets reaches the threshold.

1. *Order.* Shingles are ordered by rarity: the count of their hash bucket (2^18 counts
   over the whole corpus, a fixed size), then the hash. In any such order two linked sets
   share a shingle within the first few (prefix filter), and the first one they share
   has enough of both sets behind it (positional filter).
2. *Groups.* Classes with two equal min-hashes meet in a bucket. Each is compared with
   one leader (the member whose rarest shingle is commonest, so the least edited one):
   verified pairs form groups of similar classes, each connected already. This costs one
   pair per class and bucket, however large a bucket is.
3. *Matrix.* For each group the union of its members' leading shingles is stored, one
   row per (shingle, group), with the sizes and the most that can follow the shingle in a
   member: a query class meets the groups that it may link into. Of each group of two
   or more the union of all its members' shingles is stored too, as bits; the query's overlap
   with that whole union is bounded, and only groups whose bound reaches the threshold are
   opened, and within them only members that reach it themselves. Classes that are
   in one component already need no comparison.
4. *Verify.* A pair's overlap is bounded again by bits that stand for the whole sets (two
   a shingle); what may still link is verified on the whole texts' sets.

Steps 2 to 4 lose no link between classes of different components, so the components
are exact. Texts of compared classes are picked out of the corpus by a bitmap of fixed
size (2^26 bits), which only spares shuffling the others; a full one spares nothing.

Sets are of 64-bit hashes; that two different shingles of a pair agree has a
probability of about 2^-64 per pair of shingles.

Defined cases: null or empty texts, and texts of white space, have no shingle, link
with nothing and are their own component; a text with fewer than k words is one shingle;
ids may be null or repeat: every row is a document of its own, a component's id is the
least id in it that is not null; equal texts are one class however many; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, record_batch
from .components import connected_components
from .textkernel import mixed, shingle_sets

COUNT_BITS, COUNT_BLOCK = 18, 4096
MINHASHES, BUCKET_KEYS = 6, ((0, 1), (2, 3), (4, 5), (0, 3))
BITMAP_BITS = 26
#: Spark's bitmap aggregates hold this many bits a row.
BITMAP_ROW = 32768

SIGNATURE = "doc_id long, text_key binary, set_key binary, n long, prefix binary, leads long, keys binary, bits binary"


def bucket_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many (document, distinct shingle) pairs fall in each of 2^COUNT_BITS hash buckets."""
    ddl = "block long, counts binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), k):
                joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                total += np.bincount((joined >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        blocks = total.reshape(-1, COUNT_BLOCK)
        yield record_batch([(i, b.tobytes()) for i, b in enumerate(blocks) if b.any()], arrow_schema(ddl))

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNT_BLOCK, np.int64)
        for b in pdf["counts"]:
            total += np.frombuffer(b, np.int64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [total.tobytes()]})

    # Each task adds at most 2 MB of blocks; the sum is 2 MB, whatever the corpus.
    blocks = docs.select("text").mapInArrow(partial, ddl).groupBy("block").applyInPandas(add_up, ddl)
    out = np.zeros((1 << COUNT_BITS) // COUNT_BLOCK * COUNT_BLOCK, np.int64).reshape(-1, COUNT_BLOCK)
    for row in blocks.collect():
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def needed(n: int | np.ndarray, num: int, den: int):
    """Least overlap of a set of n with any set that links to it: ceil(t n)."""
    return -(-num * n // den)


def prefix_lengths(n: int, num: int, den: int) -> tuple[int, int]:
    """Leading shingles to look up with, and to be found by from sets at least as large."""
    probe = n - needed(n, num, den) + 1
    index = n - -(-2 * num * n // (num + den)) + 1
    return probe, index


def signatures(docs: DataFrame, k: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """One row per document: keys of its text and set, its size, its leading shingles in order, and bucket keys."""
    import hashlib

    ranks = counts.astype(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SIGNATURE)
        for batch in batches:
            for rows, sets in shingle_sets(batch.column(1), k):
                ids = batch.column(0)[rows].to_pylist()
                keys = batch.column(2)[rows].to_pylist()
                out = []
                for doc_id, text_key, s in zip(ids, keys, sets, strict=True):
                    n = len(s)
                    if not n:
                        out.append((doc_id, text_key, None, 0, None, None, None, None))
                        continue
                    probe, _ = prefix_lengths(n, num, den)
                    rank = ranks[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                    lead = np.lexsort((s, rank))[:probe]
                    spread = mixed(s)
                    bins = (spread >> np.uint64(32)).astype(np.int64) % MINHASHES
                    mins = np.full(MINHASHES, spread.min(), np.uint64) + np.arange(MINHASHES, dtype=np.uint64)
                    low = np.full(MINHASHES, ~np.uint64(0), np.uint64)
                    np.minimum.at(low, bins, spread)
                    mins = np.where(np.bincount(bins, minlength=MINHASHES) > 0, low, mins)
                    pairs = np.array([mixed(mins[a : a + 1] * np.uint64(3) + mixed(mins[b : b + 1] + np.uint64(i)))[0] for i, (a, b) in enumerate(BUCKET_KEYS)], np.uint64)
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    out.append((doc_id, text_key, digest, n, s[lead].tobytes(), int(rank[lead[0]]), pairs.tobytes(), union_bits(spread)))
                yield record_batch(out, schema)

    return docs.select("doc_id", "text", "text_key").mapInArrow(sign, SIGNATURE)


def _folded(x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two sets' bits at the size of the smaller one."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return a, b


def group_unions(members: DataFrame) -> DataFrame:
    """(g, least_n, union): of each group's members (g, n, bits), the least size and all their shingles as bits.

    Members of a batch are joined before the shuffle, so a hot group costs one row a batch.
    """
    ddl = "g long, least_n long, union binary"

    def joined(g: list, n: list, bits: list) -> list[tuple]:
        found: dict[int, tuple[int, bytes]] = {}
        for key, size, x in zip(g, n, bits, strict=True):
            if key in found:
                a, b = _folded(found[key][1], x)
                size, x = min(size, found[key][0]), (a | b).tobytes()
            found[key] = (size, x)
        return [(key, *rest) for key, rest in found.items()]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(joined(*[c.to_pylist() for c in batch.columns]), arrow_schema(ddl))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(joined(pdf["g"].tolist(), pdf["least_n"].tolist(), pdf["union"].tolist()), columns=["g", "least_n", "union"])

    return members.select("g", "n", "bits").mapInArrow(partial, ddl).groupBy("g").applyInPandas(whole, ddl)


def open_groups(asked: DataFrame, heavy: DataFrame, unions: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (q, g) whose query can share enough shingles with the group's union to link with a member."""
    ddl = "q long, g long"

    def able(n: int, least: int, x: bytes, y: bytes) -> bool:
        a, b = _folded(x, y)
        overlap = n - int(np.bitwise_count(a & ~b).sum())
        return (num + den) * overlap >= num * (n + max(least, needed(n, num, den)))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            yield record_batch([(q, g) for q, g, n, least, x, y in rows if able(n, least, x, y)], arrow_schema(ddl))

    query = heavy.select(F.col("c").alias("q"), "n", "bits")
    return asked.join(query, "q").join(unions, "g").select("q", "g", "n", "least_n", "bits", "union").mapInArrow(bound, ddl)


def union_bits(spread: np.ndarray) -> bytes:
    """A set as bits: a power of two of them, twice the set's size at least; a hash sets the bit it is modulo that."""
    m = max(64, 1 << int(2 * len(spread) - 1).bit_length())
    bits = np.zeros(m, bool)
    bits[(spread & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_overlap(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """No less than the overlap of two sets: whatever sets a bit that the other lacks is in one of them alone."""
    a, b = _folded(x, y)
    return min(nx - int(np.bitwise_count(a & ~b).sum()), ny - int(np.bitwise_count(b & ~a).sum()))


def within_bounds(pairs: DataFrame, heavy: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose overlap can still reach the threshold, by their sets' bits."""
    ddl = "a long, b long"

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            yield record_batch([(a, b) for a, b, na, nb, x, y in rows if (num + den) * most_overlap(x, na, y, nb) >= num * (na + nb)], schema)

    left = heavy.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = heavy.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(bound, ddl)


def _exploded(ddl: str, column: str, positions: bool):
    """A map from rows with a binary of 64-bit values to one row per value."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            arrays = [np.frombuffer(v.as_py(), np.int64) for v in values]
            counts = np.array([len(a) for a in arrays], np.int64)
            which = np.repeat(np.arange(len(arrays)), counts)
            token = np.concatenate(arrays) if len(arrays) else np.zeros(0, np.int64)
            columns = {column: token}
            if positions:
                ends = np.cumsum(counts)
                columns["pos"] = np.arange(len(token)) - np.repeat(ends - counts, counts)
            cols = [pa.array(columns[f.name], f.type) if f.name in columns else batch.column(batch.schema.get_field_index(f.name)).take(pa.array(which)) for f in schema]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return explode


def class_texts(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, text) of every class that stands in a pair; documents are met through a fixed-size bitmap first."""
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = wanted.join(classes.select("c", "rep_id", "text_key"), "c")
    spot = lambda i, key: F.pmod(F.xxhash64(i, key), F.lit(1 << BITMAP_BITS))
    spots = wanted.select(spot(F.col("rep_id"), F.col("text_key")).alias("s"))
    bits = spots.groupBy(F.expr(f"s div {BITMAP_ROW}").alias("row_")).agg(F.bitmap_construct_agg(F.pmod("s", F.lit(BITMAP_ROW))).alias("bits"))
    rows = docs.withColumn("s", spot(F.col("doc_id"), F.col("text_key"))).withColumn("row_", F.expr(f"s div {BITMAP_ROW}"))
    # At most 2^26 / 32768 = 2048 rows of 4 KB: 8 MB, whatever the number of pairs.
    met = rows.join(F.broadcast(bits), "row_")
    byte = f"conv(hex(substring(bits, cast(s % {BITMAP_ROW} div 8 as int) + 1, 1)), 16, 10)"
    met = met.where(f"(shiftright(cast({byte} as int), cast(s % 8 as int)) & 1) = 1")
    same = [met["doc_id"].eqNullSafe(wanted["rep_id"]), met["text_key"] == wanted["text_key"]]
    return met.join(wanted, same).select("c", "text").dropDuplicates(["c"])


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    ddl = "a long, b long"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, memo = [], {}
            # Texts of a pair are of about one size; a leader's set is kept while it repeats.
            for start in range(0, len(a), 64):
                fresh: dict[int, object] = {}
                for i in range(start, min(start + 64, len(a))):
                    for c, column in ((a[i], 2), (b[i], 3)):
                        if c not in memo and c not in fresh:
                            fresh[c] = batch.column(column)[i].as_py()
                got = [s for _, part in shingle_sets(pa.array(fresh.values(), pa.string()), k) for s in part]
                sets = memo | dict(zip(fresh, got, strict=True))
                for i in range(start, min(start + 64, len(a))):
                    x, y = sets[a[i]], sets[b[i]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        out.append((a[i], b[i]))
                memo = {c: sets[c] for c in a[start + 63 : start + 64]}
            yield record_batch(out, schema)

    left = texts.select(F.col("c").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("c").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, ddl)


def similarity_components(
    df: DataFrame, k: int = 5, threshold: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text", with_text_key: bool = False
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, class_size (documents with its very set), class_key.

    with_text_key adds the text's digest and ``component_key``, which no two components share.

    threshold: the least Jaccard similarity as a fraction, so that it is met exactly.
    """
    num, den = threshold
    spark = df.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("text_key", F.unhex(F.md5("text")))

    counts = bucket_counts(docs, k)
    signed = scratch.cut(signatures(docs, k, num, den, counts), "signed")

    light = signed.where("n > 0").select("doc_id", "text_key", "set_key", "n")
    rep = F.min(F.struct("doc_id", "text_key"))
    classes = light.groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.min("n").alias("n"), rep.alias("rep"), F.count("*").alias("class_size"))
    classes = classes.select(F.monotonically_increasing_id().alias("c"), "set_key", "n", "least_id", "class_size", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("text_key"))
    # Written, so that every reader sees the same class numbers.
    classes = scratch.cut(classes, "classes")

    heavy = signed.where("n > 0").select("doc_id", "text_key", "set_key", "prefix", "leads", "keys", "bits")
    same = [heavy["set_key"] == classes["set_key"], heavy["doc_id"].eqNullSafe(classes["rep_id"]), heavy["text_key"] == classes["text_key"]]
    heavy = scratch.cut(heavy.join(classes, same).select("c", "n", "prefix", "leads", "keys", "bits"), "heavy")

    # Groups: one leader per bucket, one pair per class and bucket.
    at_keys = heavy.select("c", "n", "leads", "keys").mapInArrow(_exploded("c long, n long, leads long, keys long", "keys", False), "c long, n long, leads long, keys long")
    at_keys = scratch.cut(at_keys, "buckets")
    leaders = at_keys.groupBy("keys").agg(F.max(F.struct("leads", "c", "n")).alias("top"), F.count("*").alias("met")).where("met > 1")
    stars = at_keys.join(leaders, "keys").where("c != top.c").select("c", "n", F.col("top.c").alias("leader"), F.col("top.n").alias("leader_n"))
    stars = stars.where(f"{den} * least(n, leader_n) >= {num} * greatest(n, leader_n)")
    stars = stars.select(F.col("leader").alias("a"), F.col("c").alias("b")).distinct()
    stars = scratch.cut(within_bounds(stars, heavy, num, den), "stars")
    links = scratch.cut(verified(stars, scratch.cut(class_texts(stars, classes, docs), "star-texts"), k, num, den), "star-links")
    scratch.drop("star-texts", "buckets")
    grouped = connected_components(links, "a", "b", scratch)

    # The matrix, and the queries against it. Singles are groups of one.
    group = grouped.select(F.col("node").alias("c"), F.col("component").alias("g"))
    unions = scratch.cut(group_unions(heavy.select("c", "n", "bits").join(group, "c")), "unions")
    leading = heavy.select("c", "n", "prefix").join(group, "c", "left")
    leading = leading.select("prefix", "c", "n", F.coalesce("g", "c").alias("g"), F.col("g").isNotNull().cast("long").alias("many"))
    ddl = "prefix long, c long, n long, g long, many long, pos long"
    postings = scratch.cut(leading.mapInArrow(_exploded(ddl, "prefix", True), ddl).withColumnRenamed("prefix", "token"), "postings")
    index_length = F.expr(f"n - ((2 * {num} * n + {num + den - 1}) div {num + den}) + 1")
    index = postings.where(F.col("pos") < index_length)
    follow = F.max(F.col("n") - F.col("pos"))
    matrix = index.groupBy("token", "g").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("many").alias("many"), follow.alias("follow"))
    query = postings.select("token", F.col("c").alias("q"), F.col("n").alias("q_n"), F.col("pos").alias("q_pos"), F.col("g").alias("q_g"))
    least = F.expr(f"({num} * (q_n + greatest(n_lo, ({num} * q_n + {den - 1}) div {den})) + {num + den - 1}) div {num + den}")
    bound = F.least(F.col("q_n") - F.col("q_pos"), F.col("follow"))
    qualify = query.join(matrix, "token").where("g != q_g and n_lo <= q_n").where(f"{den} * n_hi >= {num} * q_n").where(bound >= least)
    qualify = scratch.cut(qualify.select("token", "q", "q_n", "q_pos", "g", "many"), "qualify")
    able = open_groups(qualify.where("many = 1").select("q", "g").distinct(), heavy, unions, num, den)
    qualify = qualify.where("many = 0").unionByName(qualify.where("many = 1").join(able, ["q", "g"], "left_semi"))
    opened = qualify.join(index.select("token", "g", "c", "n", "pos"), ["token", "g"]).where("n <= q_n").where(f"{den} * n >= {num} * q_n")
    exact = F.expr(f"({num} * (q_n + n) + {num + den - 1}) div {num + den}")
    opened = opened.where(F.least(F.expr("q_n - q_pos"), F.expr("n - pos")) >= exact)
    opened = opened.select(F.col("q").alias("a"), F.col("c").alias("b")).distinct()
    opened = scratch.cut(within_bounds(opened, heavy, num, den), "opened")
    scratch.drop("postings", "qualify", "heavy")
    more = scratch.cut(verified(opened, scratch.cut(class_texts(opened, classes, docs), "open-texts"), k, num, den), "open-links")
    scratch.drop("open-texts")

    whole = connected_components(links.union(more), "a", "b", scratch)
    named = classes.join(whole.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least_ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least_ids, "component").select("set_key", "component", "component_id", "class_size")
    rows = signed.select("doc_id", "text_key", "n", "set_key").join(named, "set_key", "left")
    alone = F.concat_ws(":", F.lit("row"), "doc_id", F.hex("text_key"))
    more = ["text_key", F.coalesce(F.col("component").cast("string"), alone).alias("component_key")] if with_text_key else []
    rows = rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.hex("set_key").alias("class_key"),
        *more,
    )
    return scratch.last(rows, "components")


def one_of_each(df: DataFrame, k: int = 5, threshold: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: least id first (nulls last), then least text digest.

    Rows without a shingle link with nothing and all stay, except repeats of a whole (id, text).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = similarity_components(df, k, threshold, id_col, text_col, with_text_key=True)
    # The component's key is its least class, so that rows with null ids have one as well.
    best = found.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("b_id"), F.col("best.text_key").alias("b_key")).distinct()
    # The row goes along as one column, so that no name of it can clash.
    keyed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text)).alias("key"), F.col(text_col).isNull().alias("no_text"))
    met = keyed.join(best, [F.col("id").eqNullSafe(F.col("b_id")), F.col("key") == F.col("b_key")], "left_semi")
    return met.dropDuplicates(["id", "key", "no_text"]).select("row.*")
