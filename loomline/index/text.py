"""A persisted inverted index: BM25 with cells pruned by their bounds, and words, phrases and wildcards by position.

Documents are dealt into cells of up to ``CELL``. A posting row is a term in a cell: the documents that
have it, how often, at which positions, and the greatest count and least length among them, from which a
bound on the term's score in that cell follows whatever the corpus averages become. Rows are partitioned
by a hash of the term and sorted by it, so that a query reads the partitions of its own terms alone.

An upsert writes one new segment: the batch's postings; which documents of older segments are dead from
now on; and signed document frequencies, in which the dead documents' terms count minus one. Older
segments stay as they are. ``compact`` writes the live documents as one segment.

Search. Cells are ranked by the sum of a query's bounds in them; the best cells that hold k documents
are scored first, and the k-th score found there rules out every cell whose bound is below it. What is
left is scored in full, so that the result is that of a scan.

The search language (operators/search.py) runs on postings too: a word is a term, ``th*`` and ``a?b`` become terms
by a table of two-letter grams, and a phrase is a run of positions. Only parts with other characters than
word characters and wildcards, or of ``*`` alone, are checked on texts, and only on those of documents that have the
words in them.

Document ids are of any one type and not null; of rows with one id in a batch the one of the greatest text
counts; null texts have no words. Without ``positions`` there are no phrases and no wildcards, and the index is a third
smaller. Terms are runs of a-z and 0-9 (of word characters with ``word_break`` ``[^a-z0-9_]+``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import search as language
from ..operators import retrieval
from ..operators.retrieval import K1, WORD_BREAK, Asked, B, Running, query_terms, top_k
from ..sources.scratch import checkpointed
from .segments import Segments

CELL, BUCKETS = 1024, 32
#: Tasks that a bucket of terms is written by.
SPREAD = 8
#: Cells that are scored without a look at their bounds.
UNPRUNED = 1024
POSTINGS = "term string, cell long, n int, max_tf int, min_dl int, docs array<{key}>, tfs array<int>, dls array<int>, positions array<int>, bucket int"
DICTIONARY = "term string, df long, bucket int"
GRAMS = "gram string, term string, bucket int"
DOCS = "cell long, doc_id {key}, dl int, text string"
DEAD = "dead_segment int, cell long, doc_id {key}"
#: Scores are rounded to 6 places before they are compared.
SLACK = 2e-6


def _bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


class TextIndex:
    """``commit`` batches of (doc_id, text); ``search`` (query_id, query); ``matching`` a query of the search language."""

    def __init__(self, spark: SparkSession, path: str, word_break: str = WORD_BREAK, buckets: int = BUCKETS, cell: int = CELL, positions: bool = True):
        self.spark, self.store = spark, Segments(spark, path)
        self.word_break, self.buckets, self.cell, self.positions = word_break, buckets, cell, positions

    # ---------------------------------------------------------------- writing

    def commit(self, docs: DataFrame, deleted: DataFrame | None = None, sequence: int | None = None) -> None:
        """Documents (doc_id, text) come in, in place of older ones of the same id; those of ``deleted`` (doc_id) go."""
        now = self.store.manifest()
        if not self.store.repeated(now, sequence):
            self._commit(docs, deleted, now, now, sequence)

    def compact(self) -> None:
        """The live documents as one segment; the files of the others go with the commit after."""
        now = self.store.manifest()
        self._commit(self.documents(), None, now | {"segments": [], "n": 0, "words": 0}, now, None)

    def _commit(self, docs: DataFrame, deleted: DataFrame | None, now: dict, published: dict, sequence: int | None) -> None:
        """A segment beside those of ``now``, in place of what is published."""
        key, segment = docs.schema["doc_id"].dataType.simpleString(), now["next"]
        now = {"n": 0, "words": 0, "buckets": self.buckets, "key": key} | now
        self.buckets = now["buckets"]
        # A document's cell follows from its id, so that one deal serves both to make ids unique and to cut cells.
        cells = F.pmod(F.xxhash64("doc_id"), F.lit(-(-docs.count() // self.cell) or 1))
        batch = docs.select(cells.alias("cell"), "doc_id", "text").repartition("cell").groupBy("cell", "doc_id").agg(F.max("text").alias("text"))
        batch = batch.select("cell", "doc_id", F.size(self._words("text")).alias("dl"), "text").sortWithinPartitions("cell", "doc_id")
        self.store.write(batch, "docs", segment)
        written = self.spark.read.schema(DOCS.format(key=key)).parquet(f"{self.store.path}/docs/segment={segment}")
        gone = written.select("doc_id") if deleted is None else written.select("doc_id").union(deleted.select("doc_id"))
        # Ids first: only documents that are replaced are looked at as texts.
        older = self._live(now).join(gone.distinct(), "doc_id", "left_semi")
        self.store.write(older.select(F.col("segment").alias("dead_segment"), "cell", "doc_id"), "dead", segment)
        dead = self.spark.read.schema(DEAD.format(key=key)).parquet(f"{self.store.path}/dead/segment={segment}").drop("cell")
        texts = self.store.read("docs", DOCS.format(key=key), now).join(dead.withColumnRenamed("dead_segment", "segment"), ["segment", "doc_id"], "left_semi")
        self._write_postings(written, segment, key)
        postings = self.spark.read.schema(POSTINGS.format(key=key)).parquet(f"{self.store.path}/postings/segment={segment}")
        fresh = postings.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        lost = texts.select(F.explode(F.array_distinct(self._words("text"))).alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        lost = lost.withColumn("bucket", _bucket("term", self.buckets)).select("bucket", "term", "df")
        self.store.write(fresh.unionByName(lost).repartition("bucket").sortWithinPartitions("bucket", "term"), "dictionary", segment, "bucket")
        if self.positions:
            edged = F.concat(F.lit("$"), "term", F.lit("$"))
            pairs = F.transform(F.sequence(F.lit(1), F.length(edged) - 1), lambda i: F.substring(edged, i, F.lit(2)))
            grams = fresh.select(F.explode(F.array_distinct(pairs)).alias("gram"), "term").withColumn("bucket", _bucket("gram", self.buckets))
            self.store.write(grams.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(SPREAD))).sortWithinPartitions("bucket", "gram"), "grams", segment, "bucket")
        sums = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        more, less = sums(written), sums(texts)
        self.store.publish(published, [*now["segments"], segment], sequence, key=key, buckets=self.buckets, n=now["n"] + more["n"] - less["n"], words=now["words"] + more["words"] - less["words"])

    def _words(self, text: str) -> Column:
        return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), self.word_break), lambda w: w != "")

    def _write_postings(self, docs: DataFrame, segment: int, key: str) -> None:
        positions = self.positions
        ddl = f"term string, cell long, docs array<{key}>, tfs array<int>, dls array<int>" + ", positions array<int>" * positions
        word = re.compile(self.word_break.replace("[^", "["))

        def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column(0).to_numpy()
                ends = np.append(np.flatnonzero(cells[1:] != cells[:-1]) + 1, len(cells))
                for a, b in zip(np.append(0, ends), ends, strict=False) if len(cells) else ():
                    yield _cell_postings(batch.slice(a, b - a), word, int(cells[a]), positions)

        rows = docs.select("cell", "doc_id", "dl", "text").mapInArrow(invert, ddl).withColumn("bucket", _bucket("term", self.buckets))
        # A term that most documents have is spread over several tasks, by its cells.
        dealt = rows.repartition("bucket", F.pmod("cell", F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "cell")
        # What follows from a row's lists is not shuffled.
        dealt = dealt.withColumns({"n": F.size("docs"), "max_tf": F.array_max("tfs"), "min_dl": F.array_min("dls")})
        dealt = dealt if positions else dealt.withColumn("positions", F.lit(None).cast("array<int>"))
        self.store.write(dealt, "postings", segment, "bucket")

    # ---------------------------------------------------------------- reading

    def _dead(self, now: dict) -> DataFrame:
        rows = self.store.read("dead", DEAD.format(key=now.get("key", "bigint")), now)
        return rows.select(F.col("dead_segment").alias("segment"), "cell", "doc_id")

    def _live(self, now: dict) -> DataFrame:
        docs = self.store.read("docs", DOCS.format(key=now.get("key", "bigint")), now).select("segment", "cell", "doc_id")
        return docs.join(self._dead(now), ["segment", "doc_id"], "left_anti")

    def documents(self) -> DataFrame:
        """The live documents: doc_id, text."""
        now = self.store.manifest()
        docs = self.store.read("docs", DOCS.format(key=now.get("key", "bigint")), now)
        return docs.join(self._dead(now), ["segment", "doc_id"], "left_anti").select("doc_id", "text")

    def _postings(self, now: dict, buckets: list[int] | None) -> DataFrame:
        where = None if buckets is None else F.col("bucket").isin(buckets)
        return self.store.read("postings", POSTINGS.format(key=now["key"]), now, where)

    def search(self, queries: DataFrame, k: int = 100) -> DataFrame:
        """query_id, doc_id, score, rank: the k best documents by BM25 of each (query_id, query)."""
        return self.search_terms(query_terms(queries), k)

    def search_terms(self, terms: DataFrame, k: int = 100) -> DataFrame:
        """The same for queries as (query_id, term) rows."""
        now = self.store.manifest()
        kind = terms.schema["query_id"].dataType.simpleString()
        if not now["segments"]:
            return self.spark.createDataFrame([], f"query_id {kind}, doc_id long, score double, rank int")
        asked = terms.select("query_id", "term").distinct().withColumn("bucket", _bucket("term", now["buckets"]))
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # no more than there are
        n, avgdl = float(now["n"]), now["words"] / now["n"] if now["words"] else 1.0
        known = self.store.read("dictionary", DICTIONARY, now, F.col("bucket").isin(buckets))
        wanted = asked.select("bucket", "term").distinct()
        df = known.join(wanted, ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log(1.0 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = asked.join(df, ["bucket", "term"]).select("query_id", "bucket", "term", idf.alias("idf"))
        weight = lambda tf, dl: F.col("idf") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / avgdl))
        postings = self._postings(now, buckets)

        pairs = weighted.limit(retrieval.MOST_TERMS + 1).collect()
        held = Asked([(r["query_id"], r["term"]) for r in pairs]) if len(pairs) <= retrieval.MOST_TERMS else None
        met = postings.join(weighted, ["bucket", "term"])
        if held is not None:
            idfs = np.zeros(len(held.words))
            for r in pairs:
                idfs[held.words[r["term"]]] = r["idf"]
            shared = self.spark.sparkContext.broadcast((held, idfs))
            # MOST_TERMS rows at most, and read once from the dictionary.
            weighted = self.spark.createDataFrame(pairs, weighted.schema)
            met = postings.join(F.broadcast(weighted), ["bucket", "term"])
            wanted = postings.join(F.broadcast(weighted.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")

        def scored(chosen: DataFrame | None) -> DataFrame:
            if held is None:
                return joined(chosen)
            rows = wanted if chosen is None else wanted.join(chosen.select("segment", "cell").distinct(), ["segment", "cell"], "left_semi")
            # Every term's rows of a cell meet, and the documents of it that a later segment has replaced come first.
            dead = self._dead(now)
            dead = dead if chosen is None else dead.join(chosen.select("segment", "cell").distinct(), ["segment", "cell"], "left_semi")
            dead = dead.groupBy("segment", "cell").agg(F.collect_list("doc_id").alias("docs")).withColumn("kind", F.lit(0))  # no more than a cell's
            rows = rows.select("segment", "cell", "term", "docs", "tfs", "dls").withColumn("kind", F.lit(1)).unionByName(dead, allowMissingColumns=True)
            rows = rows.repartition("segment", "cell").sortWithinPartitions("segment", "cell", "kind")
            found = rows.mapInPandas(lambda batches: _best_of_cells(batches, *shared.value, k, avgdl), f"query_id {kind}, doc_id {now['key']}, score double")
            return found

        def joined(chosen: DataFrame | None) -> DataFrame:
            rows = met if chosen is None else met.join(chosen.select("query_id", "segment", "cell"), ["query_id", "segment", "cell"], "left_semi")
            rows = rows.select("query_id", "segment", "idf", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
            rows = rows.select("query_id", "segment", F.col("p.docs").alias("doc_id"), "idf", F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
            # A document's terms are in one segment, so that the dead are taken out of sums, not of postings.
            sums = rows.groupBy("query_id", "segment", "doc_id").agg(F.round(F.sum(weight("tf", "dl")), 6).alias("score"))
            return sums.join(self._dead(now), ["segment", "doc_id"], "left_anti").select("query_id", "doc_id", "score")

        if now["n"] <= UNPRUNED * self.cell:  # bounds would cost more than they spare
            return top_k(scored(None), k).select("query_id", "doc_id", "score", "rank")
        # Bounds need four small columns of the postings.
        cells = met.groupBy("query_id", "segment", "cell").agg(F.sum(weight("max_tf", "min_dl")).alias("bound"), F.max("n").alias("most"))
        before = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment", "cell").rowsBetween(Window.unboundedPreceding, -1)
        # A row for each query and cell, read three times below.
        cells = checkpointed(cells.withColumn("before", F.coalesce(F.sum("most").over(before), F.lit(0))))

        first = top_k(scored(cells.where(F.col("before") < k)), k)
        least = checkpointed(first.where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("least")))
        chosen = cells.join(least, "query_id", "left").where((F.col("before") < k) | F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        return top_k(scored(chosen), k).select("query_id", "doc_id", "score", "rank")

    # ---------------------------------------------------------------- the search language

    def matching(self, messages: DataFrame, query: str, fields: language.Fields = language.Fields(), key: str = "doc_id") -> DataFrame:
        """Rows of messages that a query finds; words come from the index, by ``key``, filters from the other columns."""
        leaves: list[list[str]] = []
        predicate = language.parse(query, _Indexed(fields.text, fields.channel, fields.user, fields.date, leaves))
        if not leaves:
            return messages.where(predicate)
        hits = None
        for i, parts in enumerate(leaves):
            found = self.with_words(parts).select(F.col("doc_id").alias(key), F.lit(i).alias("leaf_"))
            hits = found if hits is None else hits.union(found)
        hits = hits.groupBy(key).agg(F.collect_set("leaf_").alias(LEAVES))
        met = messages.join(hits, key, "left").withColumn(LEAVES, F.coalesce(LEAVES, F.array().cast("array<int>")))
        return met.where(predicate).select(*messages.columns)

    def with_words(self, parts: list[str]) -> DataFrame:
        """doc_id of the live documents that have these words, which may hold wildcards, in a row."""
        now = self.store.manifest()
        if not now["segments"]:
            return self.spark.createDataFrame([], "doc_id long")
        parts = [p.lower() for p in parts]
        plain = [re.fullmatch(r"[a-z0-9_*?]+", p) is not None and p.strip("*") != "" for p in parts]
        if all(plain):
            return self._in_a_row(parts, now)
        # Words between other characters are words of the index too; the texts that have them are then read.
        sure = [[w for w in re.findall(r"[a-z0-9_*?]+", p) if w.strip("*")] for p in parts]
        docs = self.documents()
        for words in sure:
            if words:
                docs = docs.join(self._in_a_row(words, now), "doc_id", "left_semi")
        return docs.where(F.lower("text").rlike(language.pattern(parts))).select("doc_id")

    def _in_a_row(self, parts: list[str], now: dict) -> DataFrame:
        rows = None
        for i, part in enumerate(parts):
            terms = self._terms(part, now)
            buckets = None if "*" in part or "?" in part else [r[0] for r in terms.select("bucket").collect()]  # one term, one bucket
            some = self._postings(now, buckets).join(terms, ["bucket", "term"], "left_semi")
            columns = ["segment", "docs"] if len(parts) == 1 else ["segment", "docs", "tfs", "positions"]
            some = some.select(*columns, F.lit(i).alias("part"))
            rows = some if rows is None else rows.union(some)
        if len(parts) == 1:
            found = rows.select("segment", F.explode("docs").alias("doc_id")).distinct()
        else:
            ends = F.aggregate("tfs", F.array(F.lit(0)), lambda s, n: F.array_append(s, F.element_at(s, -1) + n))
            rows = rows.withColumn("ends", ends).select("segment", "part", "positions", "ends", F.posexplode("docs").alias("at", "doc_id"))
            own = F.slice("positions", F.element_at("ends", F.col("at") + 1) + 1, F.element_at("ends", F.col("at") + 2) - F.element_at("ends", F.col("at") + 1))
            places = rows.select("segment", "doc_id", "part", F.explode(own).alias("position"))
            starts = places.groupBy("segment", "doc_id", (F.col("position") - F.col("part")).alias("start")).agg(F.count_distinct("part").alias("n"))
            found = starts.where(F.col("n") == len(parts)).select("segment", "doc_id").distinct()
        return found.join(self._dead(now), ["segment", "doc_id"], "left_anti").select("doc_id")

    def _terms(self, part: str, now: dict) -> DataFrame:
        """(bucket, term) that a word with wildcards stands for."""
        if "*" not in part and "?" not in part:
            return self.spark.range(1).select(F.lit(part).alias("term")).withColumn("bucket", _bucket("term", now["buckets"]))
        grams = sorted({run[i : i + 2] for run in re.split(r"[*?]+", f"${part}$") for i in range(len(run) - 1)})
        if grams:
            asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").withColumn("bucket", _bucket("gram", now["buckets"]))
            buckets = [r[0] for r in asked.select("bucket").distinct().collect()]
            rows = self.store.read("grams", GRAMS, now, F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
            terms = rows.groupBy("term").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("term")
        else:
            terms = self.store.read("dictionary", DICTIONARY, now).select("term").distinct()
        exact = "".join({"*": r"\w*", "?": r"\w"}.get(c, re.escape(c)) for c in part)
        return terms.where(F.col("term").rlike(f"^{exact}$")).withColumn("bucket", _bucket("term", now["buckets"]))


def _best_of_cells(batches: Iterator[pd.DataFrame], asked: Asked, idfs: np.ndarray, k: int, avgdl: float) -> Iterator[pd.DataFrame]:
    """A task's best documents of each query; a cell's rows come together, its dead documents first."""
    running, width = Running(k, len(asked.ids)), len(asked.ids)
    held: list[pd.DataFrame] = []

    def score(cell: pd.DataFrame) -> None:
        is_dead = (cell["kind"] == 0).to_numpy()
        posted = cell[~is_dead]
        if not len(posted):
            return
        docs = np.concatenate(posted["docs"].to_list())
        sizes = posted["docs"].str.len().to_numpy()
        known, doc = np.unique(docs, return_inverse=True)
        word = np.repeat(np.array([asked.words[t] for t in posted["term"]], np.int64), sizes)
        tf, dl = np.concatenate(posted["tfs"].to_list()), np.concatenate(posted["dls"].to_list())
        weight = idfs[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        gone = np.concatenate(cell.loc[is_dead, "docs"].to_list()) if is_dead.any() else docs[:0]
        live = ~np.isin(known, gone)
        step = max(1, retrieval.CELLS // width)
        for a in range(0, len(known), step):
            some = (doc >= a) & (doc < a + step) & live[doc]
            i, j, scores = asked.scores(doc[some] - a, word[some], weight[some], min(step, len(known) - a))
            running.add(j, known[i + a], scores)

    for pdf in batches:
        for _, part in pdf.groupby(["segment", "cell"], sort=False):
            if held and tuple(held[-1][["segment", "cell"]].iloc[0]) != tuple(part[["segment", "cell"]].iloc[0]):
                score(pd.concat(held))
                held = []
            held.append(part)
    if held:
        score(pd.concat(held))
    query, docs, scores = running.best()
    yield pd.DataFrame({"query_id": [asked.ids[q] for q in query], "doc_id": docs, "score": scores})


LEAVES = "leaves_"


@dataclass(frozen=True)
class _Indexed(language.Fields):
    """Columns whose words are looked up: each leaf of a query gets a number, and hits carry these."""

    leaves: list = field(default_factory=list)

    def words(self, parts: list[str]) -> Column:
        if parts not in self.leaves:
            self.leaves.append(parts)
        return F.array_contains(LEAVES, self.leaves.index(parts))


def _cell_postings(batch: pa.RecordBatch, word: re.Pattern, number: int, positions: bool) -> pa.RecordBatch:
    """A cell's documents by term: one row per term, terms in order of their first use."""
    ids, dls, texts = batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_pylist()
    numbers: dict[str, int] = {}
    lists = [[numbers.setdefault(w, len(numbers)) for w in word.findall((t or "").lower())] for t in texts]
    lengths = np.array([len(x) for x in lists], np.int64)
    term = np.array([t for x in lists for t in x], np.int64)
    doc = np.repeat(np.arange(len(lists)), lengths)
    position = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(term, kind="stable")
    term, doc, position = term[order], doc[order], position[order]
    heads = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(term) else np.zeros(0, np.int64)
    tfs, owner, of = np.diff(np.append(heads, len(term))), doc[heads], term[heads]
    firsts = np.searchsorted(of, np.arange(len(numbers) + 1))
    by_token = np.searchsorted(term, np.arange(len(numbers) + 1))
    offsets = lambda x: pa.array(x, pa.int32())
    lists_of = lambda values: pa.ListArray.from_arrays(offsets(firsts), values)
    columns = {
        "term": pa.array(list(numbers), pa.string()), "cell": pa.array([number] * len(numbers), pa.int64()), "docs": lists_of(ids.take(pa.array(owner))),
        "tfs": lists_of(pa.array(tfs, pa.int32())), "dls": lists_of(pa.array(dls[owner], pa.int32())),
    }
    if positions:
        columns["positions"] = pa.ListArray.from_arrays(offsets(by_token), pa.array(position, pa.int32()))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
