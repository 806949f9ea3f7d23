"""A persisted vector index: k-means cells as partitions, of which a search reads the nearest to each query.

``train`` fits the cells' centres on a bounded sample (``SAMPLE`` vectors, by a hash of their ids); every
vector is indexed, in the partition of its nearest centre. A search ranks the cells for each query, reads
the partitions that some query probes, and multiplies each one's vectors with its queries alone, exactly.
With all cells probed the result is that of a scan. How many cells a query must probe depends on the
vectors: ``calibrate`` measures, on a sample of queries against all vectors, the least number of probes
that finds a share of the true neighbours, and keeps it in the manifest.

An upsert writes one new segment, a partition per cell that the batch falls into, and says which older
vectors are dead; other files stay as they are. A cell of over ``PART_ROWS`` vectors is searched by several
tasks. Ids are whole numbers; rows without an id or vector are left out; of rows of one id in
a batch the one of the greatest vector counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieval import QUERY_BLOCK, grouped_top_k, top_k
from .segments import Segments

SAMPLE, CELLS, PART_ROWS = 20_000, 64, 100_000
VECTORS, DEAD = "doc_id long, vector array<double>, cell int", "dead_segment int, doc_id long"


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Segments(spark, path)

    def train(self, vectors: DataFrame, cells: int = CELLS, seed: int = 0) -> None:
        """Centres from a sample of (doc_id, vector); before the first commit."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        usable = vectors.where("doc_id is not null and vector is not null")
        sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        centres = []
        if not sample.isEmpty():
            centres = [c.tolist() for c in KMeans(k=max(2, cells), seed=seed, maxIter=15).fit(sample).clusterCenters()]
        rows = self.spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.store.path}/centres")

    def centres(self) -> np.ndarray:
        """One row per cell; a table whose size is a parameter."""
        rows = self.spark.read.parquet(f"{self.store.path}/centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows])

    def ranked_cells(self, vectors: DataFrame, most: int) -> DataFrame:
        """vectors with ``cell`` and ``nearness`` (from 1) of the nearest centres."""
        centres = self.centres()
        schema = vectors.selectExpr("*", "cast(null as int) as cell", "cast(null as int) as nearness").schema

        def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf) and len(centres):
                    x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
                    distance = (centres**2).sum(axis=1) - 2 * x @ centres.T
                    cells = np.argsort(distance, axis=1, kind="stable")[:, :most]
                    out = pdf.loc[pdf.index.repeat(cells.shape[1])].reset_index(drop=True)
                    yield out.assign(cell=cells.ravel().astype(np.int32), nearness=np.tile(np.arange(1, cells.shape[1] + 1, dtype=np.int32), len(pdf)))

        return vectors.mapInPandas(rank, schema)

    def commit(self, vectors: DataFrame, deleted: DataFrame | None = None, sequence: int | None = None) -> None:
        """(doc_id, vector) come in, in place of older ones of the same id; those of ``deleted`` (doc_id) go."""
        now = self.store.manifest()
        if self.store.repeated(now, sequence):
            return
        segment = now["next"]
        batch = vectors.where("doc_id is not null and vector is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
        batch = batch.groupBy("doc_id").agg(F.max("vector").alias("vector"))
        placed = self.ranked_cells(batch, 1).drop("nearness")
        # By range of cell and id, so that a large cell is several files.
        self.store.write(placed.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id"), "vectors", segment, "cell")
        written = self.spark.read.schema(VECTORS).parquet(f"{self.store.path}/vectors/segment={segment}")
        gone = written.select("doc_id") if deleted is None else written.select("doc_id").union(deleted.select(F.col("doc_id").cast("long").alias("doc_id")))
        older = self._rows(now).select("segment", "doc_id").join(gone.distinct(), "doc_id", "left_semi")
        self.store.write(older.select(F.col("segment").alias("dead_segment"), "doc_id"), "dead", segment)
        counts = {r["cell"]: r["n"] for r in written.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        sizes = {c: counts.get(int(c), 0) + now.get("sizes", {}).get(c, 0) for c in {*map(str, counts), *now.get("sizes", {})}}
        self.store.publish(now, [*now["segments"], segment], sequence, sizes=sizes)

    def _rows(self, now: dict, cells: list[int] | None = None) -> DataFrame:
        """Live vectors with segment and cell; of given cells, these partitions alone are read."""
        where = None if cells is None else F.col("cell").isin(cells)
        rows = self.store.read("vectors", VECTORS, now, where)
        dead = self.store.read("dead", DEAD, now).select(F.col("dead_segment").alias("segment"), "doc_id")
        return rows.join(dead, ["segment", "doc_id"], "left_anti")

    def vectors(self) -> DataFrame:
        return self._rows(self.store.manifest()).select("doc_id", "vector")

    def _search(self, queries: DataFrame, k: int, probes: int | None) -> DataFrame:
        """query_id, doc_id, score, cell: the k best of each probed cell and more."""
        now = self.store.manifest()
        asked = queries.where("query_id is not null and vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        probed = self.ranked_cells(asked, probes if probes is not None else len(self.centres()))
        cells = [r[0] for r in probed.select("cell").distinct().collect()]  # no more than there are
        sizes, width = now.get("sizes", {}), 1 << 20
        plan = [(c, -(-sizes.get(str(c), 0) // PART_ROWS) or 1, n) for c, n in ((r["cell"], r["n"]) for r in probed.groupBy("cell").agg(F.count("*").alias("n")).collect())]
        shape = self.spark.createDataFrame([(c, parts, -(-n // QUERY_BLOCK)) for c, parts, n in plan], "cell int, parts int, blocks int")
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        number = (F.col("cell").cast("long") * width + F.col("block")) * width + F.col("part")
        left = probed.join(F.broadcast(shape), "cell").withColumn("block", F.expr("pmod(xxhash64(query_id), blocks)")).withColumn("part", upto("parts"))
        right = self._rows(now, cells).join(F.broadcast(shape), "cell").withColumn("part", F.expr("pmod(xxhash64(doc_id), parts)")).withColumn("block", upto("blocks"))
        found = grouped_top_k(right.select(number.alias("group"), "doc_id", "vector"), left.select(number.alias("group"), "query_id", "vector"), k)
        return found.withColumn("cell", F.expr(f"cast(group div {width * width} as int)")).drop("group")

    def search(self, queries: DataFrame, k: int = 100, probes: int | None = None) -> DataFrame:
        """query_id, doc_id, score, rank of the k best by dot product; probes: cells for each query, else the calibrated number, else all."""
        found = self._search(queries, k, probes if probes is not None else self.store.manifest().get("probes"))
        return top_k(found.drop("cell"), k)

    def calibrate(self, queries: DataFrame, k: int = 100, share: float = 0.95) -> int:
        """The least number of probes by which the queries find that share of their k true neighbours, on average."""
        found = self._search(queries, k, None)
        best = top_k(found, k).select("query_id", "cell")
        asked = queries.where("query_id is not null and vector is not null").select(F.col("query_id").cast("long").alias("query_id"), "vector")
        ranks = self.ranked_cells(asked, len(self.centres())).select("query_id", "cell", "nearness")
        needed = best.join(ranks, ["query_id", "cell"]).groupBy("nearness").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy("nearness").rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("n").over(Window.partitionBy())
        enough = needed.select("nearness", (upto / total).alias("found")).where(F.col("found") >= share)
        probes = enough.agg(F.min("nearness").alias("p")).first()["p"] or len(self.centres())
        now = self.store.manifest()
        self.store.publish(now, now["segments"], None, probes=probes)
        return probes
