"""Ranked retrieval: BM25, vectors, fusion, reranking. Ranked lists are long: query_id, doc_id, rank."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
WORD_BREAK = "[^a-z0-9]+"
_WORD = re.compile("[a-z0-9]+")
#: (query, term) pairs that executors hold at once; more are joined instead.
MOST_TERMS = 500_000
#: Cells of a score matrix, and query vectors, that a task holds at once; vectors that are searched together.
CELLS, QUERY_BLOCK, PART_ROWS = 2_000_000, 4096, 8192


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def top_k(scored: DataFrame, k: int, by: str = "score", tie: str = "doc_id") -> DataFrame:
    """query_id, doc_id, rank, score: the k best per query, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.col(by).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, most_chars: int = 1024) -> DataFrame:
    """(query_id, term): the distinct words of each query's first characters."""
    cut = F.substring(F.col("query"), 1, most_chars)
    return queries.select("query_id", F.explode(F.array_distinct(words(cut))).alias("term"))


def bm25_scores(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score rounded to 6 places) of documents that share a term with the query, by joins.

    Documents keep only words that some query has before anything is shuffled; document
    frequencies come from those rows, lengths from the whole texts. For any number of terms.
    """
    wanted = terms.select("term").distinct()
    all_words = docs.select("doc_id", words(F.col("text")).alias("w"))
    one = all_words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl")).first()
    rows = all_words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(wanted, "term")
    tf = rows.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = F.lit(float(one["n"])), F.lit(float(one["avgdl"] or 1.0))
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    weighted = tf.join(df, "term").select("term", "doc_id", weight.alias("weight"))
    scored = weighted.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))
    return scored.withColumn("score", F.round("score", 6))


class Asked:
    """Queries as lists of terms: words by number, and of each word the queries that have it."""

    def __init__(self, pairs: list[tuple]):
        self.ids = list(dict.fromkeys(q for q, _ in pairs))
        number = {q: i for i, q in enumerate(self.ids)}
        self.words = {w: i for i, w in enumerate(dict.fromkeys(t for _, t in pairs))}
        at = np.array([(self.words[t], number[q]) for q, t in pairs], np.int64).reshape(-1, 2)
        at = at[np.argsort(at[:, 0], kind="stable")]
        self.queries = at[:, 1]
        self.starts = np.searchsorted(at[:, 0], np.arange(len(self.words) + 1))

    def counts(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: document, word and count of each asked word in them; and all words of each."""
        doc, word, tf, lengths = [], [], [], []
        for i, text in enumerate(texts):
            found = _WORD.findall((text or "").lower())
            lengths.append(len(found))
            hits = Counter(map(self.words.get, found))
            hits.pop(None, None)
            doc += [i] * len(hits)
            word += hits.keys()
            tf += hits.values()
        return *(np.array(x, np.int64) for x in (doc, word, tf)), np.array(lengths, np.int64)

    def scores(self, doc: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, query, score) of n documents and every query that shares a word with them, from the words' weights."""
        width = len(self.ids)
        fan = self.starts[word + 1] - self.starts[word]
        place = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        cell = np.repeat(doc, fan) * width + self.queries[np.repeat(self.starts[word], fan) + place]
        dense = np.round(np.bincount(cell, np.repeat(weight, fan), n * width), 6).reshape(-1, width)
        i, j = np.nonzero(dense > 0)
        return i, j, dense[i, j]


class Running:
    """The k best documents of each query among all that a task has met, equal scores by id.

    It holds a few times k rows a query: once a query has k documents, only what reaches its last one is taken in.
    """

    def __init__(self, k: int, width: int):
        self.k, self.width = k, width
        self.least = np.full(width, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, query: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        some = scores >= self.least[query]
        self.held.append((query[some], docs[some], scores[some]))
        self.size += int(some.sum())
        if self.size > max(1 << 16, 4 * self.k * self.width):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of what is best so far."""
        query, docs, scores = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ranks = docs if docs.dtype != object else pd.factorize(docs, sort=True)[0]
        order = np.lexsort((ranks, -scores, query))
        starts = np.searchsorted(query[order], np.arange(self.width))
        place = np.arange(len(order)) - starts[query[order]]
        kept, last = order[place < self.k], order[place == self.k - 1]
        self.least[query[last]] = scores[last]
        self.held, self.size = [(query[kept], docs[kept], scores[kept])], len(kept)
        return self.held[0]


def bm25_lists(docs: DataFrame, terms: DataFrame, k: int = 100) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents (by unique doc_id) for each query's terms.

    Two maps over the corpus: one sums document frequencies and lengths, the other scores
    batches for all queries and keeps the best of each, so that the shuffle carries k rows
    per query and task, however common a term is and however many queries there are. The queries are held by executors
    while they have at most MOST_TERMS terms together; beyond it joins do the same.
    """
    spark = docs.sparkSession
    pairs = [tuple(r) for r in terms.select("query_id", "term").limit(MOST_TERMS + 1).collect()]
    if len(pairs) > MOST_TERMS:
        return top_k(bm25_scores(docs, terms), k)
    asked = spark.sparkContext.broadcast(Asked(pairs))
    rows = docs.select("doc_id", "text").limit(0) if not pairs else docs.select("doc_id", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, total = np.zeros(len(asked.value.words), np.int64), 0, 0
        for pdf in batches:
            _, word, _, lengths = asked.value.counts(pdf["text"])
            df += np.bincount(word, minlength=len(df))
            n, total = n + len(pdf), total + int(lengths.sum())
        some = np.flatnonzero(df)
        yield pd.DataFrame({"word": [-2, -1, *some.tolist()], "n": [n, total, *df[some].tolist()]})

    sums = {r["word"]: r["n"] for r in rows.mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n, total = sums.pop(-2, 0), sums.pop(-1, 0)
    frequency = np.array([sums.get(i, 0) for i in range(len(asked.value.words))], np.float64)
    idf = spark.sparkContext.broadcast(np.log(1.0 + (n - frequency + 0.5) / (frequency + 0.5)))
    avgdl = total / n if total else 1.0

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, width = asked.value, len(asked.value.ids)
        running, step = Running(k, width), max(1, CELLS // max(1, width))
        for pdf in batches:
            for a in range(0, len(pdf) if width else 0, step):
                part = pdf.iloc[a : a + step]
                doc, word, tf, lengths = q.counts(part["text"])
                weight = idf.value[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / avgdl))
                i, j, scores = q.scores(doc, word, weight, len(part))
                running.add(j, part["doc_id"].to_numpy()[i], scores)
        query, found, scores = running.best()
        if len(query):  # columns without a row have no type
            yield pd.DataFrame({"query_id": [q.ids[x] for x in query], "doc_id": found, "score": scores})

    kinds = [terms.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()]
    found = rows.mapInPandas(search, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return top_k(found, k)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    return bm25_lists(docs, query_terms(queries), k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """Exact top k by dot product of (query_id, vector) among all (doc_id, vector).

    Vectors are dealt to tasks by id, once for each block of QUERY_BLOCK queries; blocks go to every task.
    Rows without an id or a vector are left out.
    """
    blocks, parts = -(-queries.count() // QUERY_BLOCK) or 1, -(-vectors.count() // PART_ROWS) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part", each(parts))
    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).withColumn("block", each(blocks))
    group = (F.col("block") * parts + F.col("part")).cast("long").alias("group")
    return top_k(grouped_top_k(dealt.select(group, "doc_id", "vector"), asked.select(group, "query_id", "vector"), k), k)


def grouped_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, group: each group's k best of its vectors (group, doc_id, vector) for each of its queries (group, query_id, vector).

    A task reads a group's queries first and then streams its vectors, so that it holds the queries, one
    batch, and k rows for each query, however many vectors there are. Ids are whole numbers.
    """
    rows = queries.select("group", F.lit(0).alias("kind"), F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.unionByName(vectors.select("group", F.lit(1).alias("kind"), F.col("doc_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")))
    rows = rows.where("id is not null and vector is not null").repartition("group").sortWithinPartitions("group", "kind")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            for group, part in pdf.groupby("group", sort=False):
                if best is None or best.group != group:
                    if best is not None:
                        yield best.rows()
                    best = _Best(group, k)
                is_query = (part["kind"] == 0).to_numpy()
                ids, matrix = part["id"].to_numpy(), np.stack(part["vector"].to_numpy())
                if is_query.any():
                    best.ask(ids[is_query], matrix[is_query])
                if not is_query.all():
                    best.offer(ids[~is_query], matrix[~is_query])
        if best is not None:
            yield best.rows()

    return rows.mapInPandas(search, "query_id long, doc_id long, score double, group long")


class _Best:
    """The k best of what has been offered to a group's queries."""

    def __init__(self, group: int, k: int):
        self.group, self.k = group, k
        self.ids, self.matrix = np.zeros(0, np.int64), None
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def ask(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.matrix = matrix if self.matrix is None else np.concatenate([self.matrix, matrix])
        self.found += [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def offer(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(self.ids)))
        for a in range(0, len(ids) if len(self.ids) else 0, step):
            scores = np.round(matrix[a : a + step] @ self.matrix.T, 6)
            for q, (docs, kept) in enumerate(self.found):
                column = scores[:, q]
                some = np.flatnonzero(column >= kept[-1]) if len(kept) == self.k else np.arange(len(column))
                if len(kept) < self.k < len(some):
                    some = some[column[some] >= np.partition(column[some], -self.k)[-self.k]]
                if len(some):
                    docs, kept = np.concatenate([docs, ids[a : a + step][some]]), np.concatenate([kept, column[some]])
                    order = np.lexsort((docs, -kept))[: self.k]
                    self.found[q] = docs[order], kept[order]

    def rows(self) -> pd.DataFrame:
        n = [len(docs) for docs, _ in self.found]
        parts = list(zip(*self.found, strict=True)) or [[np.zeros(0, np.int64)], [np.zeros(0)]]
        return pd.DataFrame({"query_id": np.repeat(self.ids, n), "doc_id": np.concatenate(parts[0]), "score": np.concatenate(parts[1]), "group": self.group})


def dot(a: Column, b: Column) -> Column:
    """Dot product as a fold; for pairs that stand in one row."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def fused(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_id, rank, doc_id): query_id, doc_id, score, rank.

    Ties go to the document met first, by list and rank. Repeats in a list add up.
    """
    part = 1.0 / (F.lit(float(k)) + F.col("rank"))
    first = F.min(F.struct("list_id", "rank")).alias("first")
    scores = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"), first)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first.list_id", "first.rank")
    return scores.withColumn("rank", F.row_number().over(w)).select("query_id", "doc_id", "score", "rank")


def reranked(run: DataFrame, scores: DataFrame, fail_soft: bool = True, top_k: int | None = None) -> DataFrame:
    """A run by falling score, equal scores in their old order; missing scores count 0 if fail_soft."""
    met = run.join(scores.select("query_id", "doc_id", F.col("score").alias("new_")), ["query_id", "doc_id"], "left" if fail_soft else "inner")
    w = Window.partitionBy("query_id").orderBy(F.coalesce("new_", F.lit(0.0)).desc(), "rank")
    out = met.select("query_id", "doc_id", F.row_number().over(w).alias("rank"), F.coalesce("new_", F.lit(0.0)).alias("score"), F.col("rank").alias("old_rank"))
    out = out if top_k is None else out.where(F.col("rank") <= top_k)
    return out.select("query_id", "doc_id", "rank", "score", "old_rank")


def in_input_order(run: DataFrame) -> DataFrame:
    """A reranked run's rows numbered as the texts went in."""
    w = Window.partitionBy("query_id").orderBy("old_rank")
    return run.withColumn("index", (F.row_number().over(w) - 1).cast("bigint"))


def with_texts(run: DataFrame, queries: DataFrame, docs: DataFrame, fail_soft: bool = True) -> DataFrame:
    """A run with the texts of its queries and documents; an unknown document's is empty, or drops the row."""
    met = run.join(queries.select("query_id", "query"), "query_id")
    met = met.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id", "left" if fail_soft else "inner")
    return met.withColumn("content", F.coalesce("content", F.lit("")))


def shared_words(query: Column, content: Column) -> Column:
    """The share of a query's distinct words that a text has: the local stand-in for a cross-encoder."""
    asked, there = F.array_distinct(words(query)), F.array_distinct(words(content))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, there)).cast("double"), F.size(asked)), F.lit(0.0)), 6)


def keywords(docs: DataFrame, queries: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, pos, term): each query's rarest words in the corpus; the stand-in for a model's keywords."""
    terms = query_terms(queries).where(F.length("term") > 2)
    wanted = terms.select("term").distinct()
    df = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(wanted, "term")
    df = df.groupBy("term").agg(F.count("*").alias("df"))
    w = Window.partitionBy("query_id").orderBy("df", "term")
    return terms.join(df, "term").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("query_id", "pos", "term")


def keyword_lists(docs: DataFrame, keys: DataFrame, k: int = 100) -> DataFrame:
    """One BM25 list per keyword: (query_id, list_id, rank, doc_id), each distinct term searched once."""
    terms = keys.select("term").distinct().select(F.col("term").alias("query_id"), "term")
    lists = bm25_lists(docs, terms, k).select(F.col("query_id").alias("term"), "doc_id", "rank")
    return lists.join(keys, "term").select("query_id", F.col("pos").alias("list_id"), "rank", "doc_id")


def mapped_documents(hits: DataFrame, message_of: DataFrame, documents_of: DataFrame, most_hits: int = 50, most_docs: int = 10) -> DataFrame:
    """First hits (query_id, rank, ts) to their documents, each once, at most so many per query."""
    rows = hits.where(F.col("rank") <= most_hits).join(message_of, "ts").join(documents_of, "message_id")
    firsts = rows.groupBy("query_id", "document_id").agg(F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy("first", "document_id")
    return firsts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_docs).select("query_id", "document_id", "rank")
