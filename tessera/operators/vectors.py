"""Nearest vectors: coarse cells, exact distances within them, and an exact search by the cells' radii."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources import sinks

#: Vectors that the cells are fitted on (those with the smallest hashes of their ids), and the most cells there are.
SAMPLE, CELLS = 20_000, 4096
#: Rows of the index and queries that meet in one task; larger cells are cut into such tiles.
ROWS, QUERIES = 4096, 512
#: Share of the nearest vectors that the visited cells should hold, as measured on the sample.
RECALL = 0.96
#: Distances are rounded to this many digits, so that equal ones are ordered by id.
DIGITS = 6
NEAR = "query long, id long, distance double"


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))


def fit(vectors: DataFrame, sample: int = SAMPLE, most: int = CELLS, rounds: int = 12) -> tuple[np.ndarray, int]:
    """Centres of cells, about the square root of the number of vectors, by k-means on a bounded sample (id, vector); and how many cells a query should visit."""
    n = vectors.count()
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    x = _matrix(some.column("vector"))
    x = np.unique(x, axis=0)
    cells = max(1, min(most, len(x), math.isqrt(n)))
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), cells, replace=False)] if len(x) else x[:1]
    for _ in range(rounds if len(x) else 0):
        far = _squares(x, centres)
        nearest = far.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        count = np.bincount(nearest, minlength=cells)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        if len(empty):  # begin again at the vectors that are farthest from their centres
            centres[empty] = x[np.argsort(-far.min(1), kind="stable")[: len(empty)]]
    return centres, visits(x, centres, rng)


def visits(x: np.ndarray, centres: np.ndarray, rng: np.random.Generator, k: int = 10, queries: int = 200, recall: float = RECALL) -> int:
    """The fewest nearest cells that hold a share `recall` of the k nearest sample vectors of some queries of the sample."""
    if len(x) < 2:
        return 1
    q = rng.choice(len(x), min(queries, len(x)), replace=False)
    far = _squares(x[q], x)
    far[np.arange(len(q)), q] = np.inf
    near = np.argpartition(far, min(k, len(x) - 1) - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(_squares(x[q], centres), axis=1), axis=1)  # of each cell, for each query
    home = _squares(x, centres).argmin(1)
    places = np.sort(np.take_along_axis(rank, home[near], axis=1).ravel())
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)))]) + 1


@dataclass
class VectorIndex:
    """centres; probes: cells that a query visits; rows: (cell, tile, id, vector), written; cells: (cell, n, radius), at most CELLS rows."""

    centres: np.ndarray
    probes: int
    rows: DataFrame
    cells: DataFrame


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            x = _matrix(batch.column(1))
            far = _squares(x, centres)
            cell = far.argmin(1)
            exact = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            slot = np.arange(seen, seen + len(x)) * 7919 + part * 104729
            seen += len(x)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(slot), batch.column(0), batch.column(1), pa.array(exact)], ["cell", "slot", "id", "vector", "off"])

    return run


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = sinks.home(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def build(vectors: DataFrame) -> VectorIndex:
    """The index of all vectors (id, vector); rows with a null or empty vector are left out. Cells are cut into tiles of about ROWS rows, so a cell may hold any share of them."""
    spark = vectors.sparkSession
    rows = vectors.where(F.size("vector") > 0).select(F.col("id").cast("long").alias("id"), "vector")
    centres, probes = fit(rows)
    kinds = f"cell int, slot long, id long, vector {rows.schema['vector'].dataType.simpleString()}, off double"
    placed = _stored(spark, rows.mapInArrow(_assign(centres), kinds))
    cells = _stored(spark, placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")))
    tiles = F.ceil(F.col("n") / ROWS)
    tiled = placed.join(F.broadcast(cells), "cell").select("cell", F.pmod(F.xxhash64("slot"), tiles).cast("int").alias("tile"), "id", "vector")
    return VectorIndex(centres, probes, tiled, cells)


def _probes(index_centres: np.ndarray, cells: np.ndarray, radius: np.ndarray, probes: int | None):
    """Cells that each query visits: the `probes` nearest ones, or, where probes is None, those that may hold a vector within its limit and were not visited before (both columns of the query)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            x = _matrix(batch.column(1))
            d = np.sqrt(_squares(x, index_centres[cells]))
            if probes is not None:
                near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                row, at = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
            else:
                limit = batch.column(2).to_numpy(zero_copy_only=False)
                visited = np.zeros(d.shape, bool)
                near = np.argsort(d, axis=1, kind="stable")[:, : int(batch.column(3)[0].as_py())] if len(x) else np.zeros((0, 0), int)
                visited[np.arange(len(x))[:, None], near] = True
                row, at = np.nonzero(~visited & (d - radius <= limit[:, None] + 1e-5))
            slot = seen + np.arange(len(row))
            seen += len(row)
            yield pa.RecordBatch.from_arrays([pa.array(cells[at].astype(np.int32)), pa.array(slot), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["cell", "slot", "query", "vector"])

    return run


def _tile(k: int, apart: bool):
    def run(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        x, q = _matrix(rows.column("vector")), _matrix(queries.column("vector"))
        ids, names = rows.column("id").to_numpy(), queries.column("query").to_numpy()
        out = []
        for i in range(len(q)):
            d = np.round(np.sqrt(((x - q[i]) ** 2).sum(1)), DIGITS)
            ok = np.flatnonzero(ids != names[i]) if apart else np.arange(len(ids))
            best = ok[np.lexsort((ids[ok], d[ok]))[:k]]
            out.append((np.full(len(best), names[i]), ids[best], d[best]))
        query, near, distance = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"query": query, "id": near, "distance": distance})

    return run


def _visit(index: VectorIndex, asked: DataFrame, k: int, apart: bool) -> DataFrame:
    """The k nearest of each tile of each (cell, slot, query, vector): tiles of rows meet tiles of queries, both of bounded size."""
    spark = index.rows.sparkSession
    asked = _stored(spark, asked)
    met = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q_tiles")).join(F.broadcast(index.cells), "cell").select("cell", "q_tiles", F.ceil(F.col("n") / ROWS).cast("int").alias("tiles"))
    met = F.broadcast(met)  # at most CELLS rows
    to_all = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = index.rows.join(met, "cell").select("cell", "tile", to_all("q_tiles").alias("q_tile"), "id", "vector")
    queries = asked.join(met, "cell").withColumn("q_tile", F.pmod(F.xxhash64("slot"), F.col("q_tiles")).cast("int")).select("cell", to_all("tiles").alias("tile"), "q_tile", "query", "vector")
    keys = ("cell", "tile", "q_tile")
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_tile(k, apart), NEAR)


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, *, exact: bool = False, apart: bool = True) -> DataFrame:
    """query, rank, id, distance: the k nearest vectors to each query (id, vector), equal distances by id; `apart` leaves out the query's own id.

    The `probes` nearest cells are searched, by default as many as the index found enough on its sample. With exact=True the k-th distance found there then says which
    other cells can hold a nearer vector, by the distance of their centre less their radius, and these are
    searched as well; the result is that of comparing all pairs.
    """
    spark, probes = index.rows.sparkSession, probes or index.probes
    known = index.cells.orderBy("cell").toArrow()  # at most CELLS rows
    cells, radius = known.column("cell").to_numpy().astype(np.int64), known.column("radius").to_numpy()
    asked = queries.where(F.size("vector") > 0).select(F.col("id").cast("long").alias("query"), "vector")
    kinds = f"cell int, slot long, query long, vector {asked.schema['vector'].dataType.simpleString()}"
    if not len(cells):
        return spark.createDataFrame([], "query long, rank int, id long, distance double")
    found = _first(_visit(index, asked.mapInArrow(_probes(index.centres, cells, radius, probes), kinds), k, apart), k)
    if exact:
        found = _stored(spark, found.select("query", "id", "distance"))
        limits = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("limit"))
        wide = asked.join(limits, "query", "left").select("query", "vector", F.coalesce("limit", F.lit(float("inf"))).alias("limit"), F.lit(probes).alias("probes"))
        more = _visit(index, wide.mapInArrow(_probes(index.centres, cells, radius, None), kinds), k, apart)
        found = _first(found.unionByName(more), k)
    return found.select("query", "rank", "id", "distance")
