"""Whitening of embeddings by a covariance that is computed in tiles.

A vector's entries c become whole numbers x = floor(64 * c) + 1000000. The fit list is each
distinct x vector once; from it come the sums, the covariance and the components.

1. *Fit list.* Rows become x vectors, packed as bytes; one shuffle of them makes them distinct.
2. *Blocks.* The fit list is cut into row-blocks of bounded size, and each of these into column
   blocks of ``TILE`` dimensions, less each dimension's whole mean.
3. *Tiles.* Column blocks are shuffled by row-block, where each pair of them meets once. A pair
   of dimensions belongs to one tile key; a task centres and multiplies tile pairs and passes on
   one sum per tile key, and these are summed per tile. Only a task's own blocks are in memory.
4. *Components.* The tiles (a matrix as wide as a vector, whatever the number of rows) are
   assembled and eigendecomposed, and a map projects all rows.
5. *Proof.* The covariance of the whitened fit list is computed from its rows again; the largest
   distance of an entry from the identity's is in every row of the result.

Whole numbers are subtracted before anything is rounded, so that a mean of a million costs no digits.

Defined cases: rows whose vector is null, or holds null, NaN or an infinite entry, are left out;
of vectors of several lengths only those of the length that most of the fit list has (of equals
the greater) take part, the others are left out; entries beyond 2^53 / 64 count as that; rows may
repeat, have equal or null ids, and get a result each; components whose variance is zero, or not
told apart from zero, are left out, so that one vector alone, empty vectors and an empty table give no
rows; ``deviation`` is null where it does not fit a long; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Dimensions of a tile's side, and numbers in a row-block.
TILE, BLOCK_CELLS = 32, 1 << 18
#: Beyond this, 64 * c is not a whole number that doubles tell from its neighbours.
MOST = float(1 << 53)

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors of one length as rows."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (packed whole numbers) and d, their number, of every row whose vector is whole and finite."""
    ddl = "vec_id long, x binary, d long"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
            ends = np.cumsum(np.maximum(lengths, 0))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            starts = ends - np.maximum(lengths, 0)
            keep = np.flatnonzero((lengths >= 0) & (bad[ends] == bad[starts]))
            with np.errstate(invalid="ignore"):
                x = np.floor(np.clip(np.nan_to_num(SCALE * flat), -MOST, MOST)).astype("<i8") + SHIFT
            packed = [x[starts[i] : ends[i]].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(packed, pa.binary()), pa.array(lengths[keep], pa.int64())], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(convert, ddl)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors, and each dimension's exact sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):  # 512 numbers of 2^53 fit a long
                x = _matrix(batch.column(0).slice(a, 512))
                n, total = n + len(x), total + x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *total)], pa.string())], names=["dim", "total"])

    rows = fit.select("x").mapInArrow(add, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    got = {r["dim"]: int(r["total"]) for r in rows}
    return got.get(-1, 0), [got.get(i, 0) for i in range(d)]


class _Centre:
    """Subtracts the exact mean: its whole part from whole numbers, its fraction from doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], object)
        self.fraction = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.fraction

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of (n * x - S)^2; null where it does not fit a long."""
        d = x - self.whole
        if len(d) and (int(np.abs(d).max()) + 1) ** 2 * self.n**2 * d.shape[1] < 1 << 63:
            gap = d * self.n - self.rest.astype(np.int64)
            return (gap * gap).sum(axis=1).tolist()
        exact = ((d.astype(object) * self.n - self.rest) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def column_blocks(fit: DataFrame, centre: _Centre, tile: int = TILE) -> DataFrame:
    """row_block, tile, block: a bounded number of vectors, the dimensions of one tile, less the whole means."""
    ddl = "row_block long, tile int, block binary"
    step = max(1, BLOCK_CELLS // len(centre.whole))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, number = arrow_schema(ddl), TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                x = _matrix(batch.column(0).slice(a, step)) - centre.whole
                tiles = range(0, x.shape[1], tile)
                blocks = [np.ascontiguousarray(x[:, c : c + tile]).tobytes() for c in tiles]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], schema=schema)
                number += 1

    return fit.select("x").mapInArrow(cut, ddl)


def tiled_products(blocks: DataFrame, centre: _Centre, tile: int = TILE) -> np.ndarray:
    """The sum over all vectors of the products of their centred entries, as a matrix."""
    d, ddl = len(centre.whole), "i int, j int, product binary"
    width = lambda t: min(tile, d - t * tile)

    def centred(block: bytes, t: int) -> np.ndarray:
        x = np.frombuffer(block, "<i8").reshape(-1, width(t))
        return x.astype(np.float64) - centre.fraction[t * tile : t * tile + width(t)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i, j, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                product = centred(a, i).T @ centred(b, j)
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
        yield tiles_batch(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i, j, p in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                product = np.frombuffer(p).reshape(width(i), width(j))
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
        yield tiles_batch(sums)

    def tiles_batch(sums: dict) -> pa.RecordBatch:
        keys = list(sums)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([np.ascontiguousarray(sums[k]).tobytes() for k in keys], pa.binary())], schema=arrow_schema(ddl))

    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(b, (F.col("a.row_block") == F.col("b.row_block")) & (F.col("a.tile") <= F.col("b.tile")))
    pairs = pairs.select(F.col("a.tile").alias("i"), F.col("b.tile").alias("j"), F.col("a.block").alias("a"), F.col("b.block").alias("b"))
    total = pairs.mapInArrow(multiply, ddl).repartition("i", "j").mapInArrow(add, ddl)
    out = np.zeros((d, d))
    for i, j, p in total.toLocalIterator():
        product = np.frombuffer(bytes(p)).reshape(width(i), width(j))
        out[i * tile : i * tile + width(i), j * tile : j * tile + width(j)] = product
        out[j * tile : j * tile + width(j), i * tile : i * tile + width(i)] = product.T
    return out


def components_of(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances, unit vectors (as columns) and shares of the trace of the leading components that have a variance."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = int((values > len(values) * np.finfo(float).eps * max(values[0], 0)).sum()) if len(values) else 0
    k = min(most, some)
    # Each component's entry of the greatest size is positive, so that a run again gives the same signs.
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    vectors = vectors * np.where(lead < 0, -1.0, 1.0)
    return values[:k], vectors[:, :k], values[:k] / max(np.trace(covariance), np.finfo(float).tiny)


def _identity_error(fit: DataFrame, centre: _Centre, basis: np.ndarray) -> float:
    """The largest distance of the whitened fit list's covariance from the identity."""
    k = basis.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = centre(_matrix(batch.column(0))) @ basis
            total, sums = total + w.T @ w, sums + w.sum(axis=0)
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([total, sums[None]]).ravel())], names=["i", "j", "s"])

    rows = fit.select("x").mapInArrow(multiply, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    moments = np.zeros((k + 1, k))
    for r in rows:
        moments[r["i"], r["j"]] = r["s"] / centre.n
    return float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """Every whole row's whitened value on each of the leading components, one row per component."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = whole_vectors(df, id_col, vector_col)
    fit = scratch.cut(rows.select("x", "d").distinct(), "fit")
    usual = fit.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if usual is None or usual["d"] == 0:
        scratch.drop("fit")
        return spark.createDataFrame([], RESULT)
    d = usual["d"]
    fit = fit.where(F.col("d") == d)
    centre = _Centre(*_sums(fit, d))
    values, vectors, explained = components_of(tiled_products(column_blocks(fit, centre, tile), centre, tile) / centre.n, most)
    if not len(values):
        scratch.drop("fit")
        return spark.createDataFrame([], RESULT)
    basis = vectors / np.sqrt(values)
    error, k = _identity_error(fit, centre, basis), len(values)
    scratch.drop("fit")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(RESULT)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1))
            which = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, centre.n), pa.int64()),
                pa.array(centre.deviation(x), pa.int64()).take(which), pa.array((centre(x) @ basis).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], schema=schema)

    return rows.where(F.col("d") == d).select("vec_id", "x").mapInArrow(project, RESULT)
