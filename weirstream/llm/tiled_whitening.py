"""Whitening of embeddings by a covariance that is computed in tiles.

Pairs of dimensions are cut into tiles. Rows are gathered to blocks, each cut into column blocks; a column block goes to
every tile that it is a side of. One task multiplies the two column blocks of a block of rows for a tile, products
are summed for each tile, and the driver assembles what is left, a matrix of dimensions x dimensions, and finds its
eigenvectors. Nothing that grows with the rows reaches the driver: the number of dimensions bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstream.llm.common import persisted, shared_folder

#: Dimensions of a side of a tile, rows of a block, dimensions at most (the driver holds their square).
TILE, BLOCK_ROWS, MAX_DIMENSIONS = 32, 4_096, 8_192
#: An eigenvalue under this share of their sum is taken for zero.
RANK = 1e-12


def whole_numbers(vectors: DataFrame, embedding: str, scale: int) -> DataFrame:
    """Rows whose vector has finite entries only, with x: floor(scale * entry) as long."""
    bad = F.exists(F.col(embedding), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(embedding).isNotNull() & ~bad)
    return rows.withColumn("x", F.transform(embedding, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """Rows of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def column_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of their entries ``x``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), np.int64)
                n += len(x)
                # two halves, so no sum of a batch leaves 64 bits
                total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "total": pa.array([str(t) for t in total])})

    found = rows.select("x").mapInArrow(add, "dim int, n long, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by_dim = {r.dim: r for r in found.collect()}  # a row for each dimension
    return (by_dim[0].n if by_dim else 0), [int(by_dim[d].total) for d in range(dims)] if by_dim else [0] * dims


def tiled_covariance(rows: DataFrame, mean: np.ndarray, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """Sum over rows of the products of centred entries of ``x``; divide by the number of rows for the covariance.

    ``rows`` must be the same at each reading (a written table). Numbers are doubles, centred before they are multiplied.
    """
    dims = len(mean)
    if dims > MAX_DIMENSIONS:
        raise ValueError(f"{dims} dimensions; the driver assembles at most {MAX_DIMENSIONS} x {MAX_DIMENSIONS}")
    sides = -(-dims // tile)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                x = _matrix(batch.column(0).slice(start, block_rows), np.float64) - mean
                cut = [np.ascontiguousarray(x[:, s * tile : (s + 1) * tile]).tobytes() for s in range(sides)]
                # one column block at a time, for all tiles that it is a side of
                for s in range(sides):
                    tiles = [(min(s, t), max(s, t)) for t in range(sides)]
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([(part << 32) + number] * sides, pa.int64()), "tile": pa.array([a * sides + b for a, b in tiles], pa.int32()),
                        "side": pa.array([s] * sides, pa.int32()), "rows": pa.array([len(x)] * sides, pa.int32()), "data": pa.array([cut[s]] * sides, pa.binary()),
                    })
                number += 1

    def multiply(block: pd.DataFrame) -> pd.DataFrame:
        a, b = divmod(int(block["tile"].iat[0]), sides)
        own = {int(s): np.frombuffer(d, np.float64).reshape(int(n), -1) for s, n, d in zip(block["side"], block["rows"], block["data"], strict=True)}
        return pd.DataFrame({"tile": [a * sides + b], "product": [(own[a].T @ own[b]).ravel()]})

    dealt = rows.select("x").mapInArrow(blocks, "block long, tile int, side int, rows int, data binary")
    products = dealt.groupBy("block", "tile").applyInPandas(multiply, "tile int, product array<double>")
    # partial sums are made before the shuffle; a tile's cells are summed one by one
    cells = products.select("tile", F.posexplode("product").alias("cell", "value")).groupBy("tile", "cell").agg(F.sum("value").alias("value"))
    found = cells.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("cell", "value")))["value"].alias("values"))
    matrix = np.zeros((dims, dims))
    for row in found.toLocalIterator():
        a, b = divmod(row.tile, sides)
        across = slice(a * tile, (a + 1) * tile), slice(b * tile, (b + 1) * tile)
        own = np.array(row["values"]).reshape(matrix[across].shape)
        matrix[across], matrix[across[1], across[0]] = own, own.T
    return matrix


@dataclass
class Whitening:
    """Fit of n distinct vectors: their sums, the components (rows; unit vectors) with eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s) / self.n for s in self.sums]) if self.n else np.zeros(0)

    @property
    def weights(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; not a number where the eigenvalue is zero."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > RANK * self.trace, 1 / np.sqrt(self.values), np.nan)[:, None] * self.components


def fit(distinct: DataFrame, dims: int, n_components: int, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> Whitening:
    """Components of the distinct vectors ``x``, by falling eigenvalue; the largest entry of each is positive."""
    n, sums = column_sums(distinct, dims)
    if not n or not dims:
        return Whitening(0, sums, np.zeros((0, dims)), np.zeros(0), 0.0)
    v = tiled_covariance(distinct, np.array([s / n for s in sums]), tile, block_rows) / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:n_components]
    components = vectors[:, order].T
    components = components * np.where(np.take_along_axis(components, np.abs(components).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    return Whitening(n, sums, components, values[order], float(np.trace(v)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - sum)^2 over dimensions, exact; None beyond 64 bits."""
    bound = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums))
    if len(sums) * bound**2 < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, n_components: int = 4, scale: int = 256, embedding: str = "embedding", keep: list[str] | None = None, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Projections of vectors on the leading components of the covariance of the distinct vectors.

    Entries become x = floor(scale * entry). Rows whose vector is null or has a null, NaN or infinite entry go. The fit
    reads each distinct x once. Vectors of another length than the most frequent one (the longer, if there are several)
    are no part of it and get components with null figures, as do empty ones. Returns, for each row and component from 1, the kept
    columns (default vec_id), component, n, deviation (sum of (n * x - sum)^2, exact; null beyond a long), whitened,
    explained, identity_error (largest entry of whitened's covariance over the fit minus the identity). A component
    whose eigenvalue is zero has null for whitened; if there is no variance explained is null too. There are as many components
    as dimensions if these are fewer. Null ids and repeated rows are rows like any other; an empty table gives none.
    Other columns may have any names. Entries beyond a long over ``scale`` count as the largest or smallest long.
    """
    spark = vectors.sparkSession
    keep = keep or ["vec_id"]
    names = [f"__k{i}" for i in range(len(keep))]
    slim = vectors.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], F.col(embedding).alias("__v"))
    rows = whole_numbers(slim, "__v", scale).drop("__v")
    lengths = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths.dims if lengths else 0
    folder = shared_folder(spark, "whitening")
    distinct = persisted(rows.where(F.size("x") == dims).select("x").distinct(), "distinct", folder)
    found = fit(distinct, dims, n_components, tile, block_rows)
    weights, mean, k = found.weights, found.mean, len(found.values)
    usable = np.flatnonzero(~np.isnan(weights).any(axis=1))
    error = None
    if len(usable):
        projected = project(distinct, mean, weights[usable])
        centre = projected.agg(*[F.avg(F.col("x")[i]) for i in range(len(usable))]).first()
        error = float(np.abs(tiled_covariance(projected, np.array(centre), tile, block_rows) / found.n - np.eye(len(usable))).max())
    explained = [float(e / found.trace) if found.trace > 0 else None for e in found.values]
    n, sums = found.n, found.sums

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            if not batch.num_rows or not k:
                continue
            fits = np.array([size == dims for size in held.value_lengths().to_pylist()])
            deviation, white = np.full(batch.num_rows, None, object), np.full((batch.num_rows, k), np.nan)
            if fits.any():
                x = _matrix(held.filter(pa.array(fits)), np.int64)
                deviation[fits] = deviations(x, n, sums)
                white[fits] = (x - mean) @ weights.T
            take = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_pydict(
                {name: batch.column(i).take(take) for i, name in enumerate(names)}
                | {
                    "component": pa.array(np.tile(np.arange(1, k + 1), batch.num_rows), pa.int32()),
                    "n": pa.array([n] * len(take), pa.int64()),
                    "deviation": pa.array(np.repeat(deviation, k).tolist(), pa.int64()),
                    "whitened": pa.array(white.ravel(), pa.float64(), from_pandas=True),
                    "explained": pa.array(explained * batch.num_rows, pa.float64()),
                    "identity_error": pa.array([error] * len(take), pa.float64()),
                }
            )

    new = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = T.StructType([rows.schema[c] for c in names] + T.StructType.fromDDL(new).fields)
    return rows.mapInArrow(figures, schema).toDF(*keep, *[f.split()[0] for f in new.split(", ")])


def project(rows: DataFrame, mean: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``x`` becomes its centred projections; a null vector isn't expected."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                white = (_matrix(batch.column(0), np.float64) - mean) @ weights.T
                yield pa.RecordBatch.from_pydict({"x": pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), len(weights)).cast(pa.list_(pa.float64()))})

    return rows.select("x").mapInArrow(of, "x array<double>")
