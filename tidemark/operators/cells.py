"""Exact nearest neighbours from a stored cell index.

Vectors are dealt to the nearest of some centroids by angle. A cell is a folder; a small table has each
cell's number of rows and its members' least and largest angle to the centroid. Angles obey the triangle
inequality, so no member of a cell is nearer to a query than the difference between the query's angle to the
centroid and the members'. A search looks into the cells with the lowest such bound first, takes the k-th
distance found there, and then reads the cells whose bound doesn't exceed it; all others are skipped unread.
The result is that of comparing everything, ties included.

Centroids are fitted on a bounded sample (``Layout.sample`` rows, those with the smallest hash); every row
is indexed. Later segments keep the centroids of the first, so new vectors rewrite nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import retrieval as rt
from tidemark.operators.timeseries import clamp, within
from tidemark.schema import MAX_MS, MIN_MS

#: The cell of vectors without a direction; it is read by every search.
NO_DIRECTION = -1

#: Angle that rounding may amount to.
SLACK = 1e-6

ROWS = "frame_id long, chunk_index int, embedding array<float>, cell int, angle double"


@dataclass(frozen=True)
class Layout:
    """Cells (left out: the root of the rows, ``most`` at most), rows of the sample, steps of the fit, rows of a file, about."""

    cells: int | None = None
    most: int = 4096
    sample: int = 10_000
    steps: int = 8
    file_rows: int = 100_000


def _directions(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if (np.diff(column.offsets.to_numpy()) != size).any():
        raise ValueError(f"a vector doesn't have {size} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def fit(vectors: DataFrame, layout: Layout = Layout()) -> np.ndarray:
    """Centroids by spherical k-means over a bounded sample, the same for the same rows."""
    rows = vectors.count()
    sample = vectors.select("embedding").orderBy(F.xxhash64("frame_id", "chunk_index"), "frame_id", "chunk_index").limit(layout.sample).toArrow().column("embedding")
    size = len(sample[0]) if len(sample) else 0
    drawn = _matrix(sample, size)
    drawn = _directions(drawn[np.abs(drawn).sum(1) > 0])
    cells = min(clamp(layout.cells or isqrt(rows), 1, layout.most), len(drawn))
    centers = drawn[np.random.default_rng(5).choice(len(drawn), cells, replace=False)] if cells else np.zeros((0, size))
    for _ in range(layout.steps if cells else 0):
        own = (drawn @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, drawn)
        empty = ~np.bincount(own, minlength=cells).astype(bool)
        centers = np.where(empty[:, None], centers, _directions(sums))
    return centers


def assign(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """Add ``cell`` and ``angle`` (to the cell's centroid) to ``frame_id, chunk_index, embedding``."""
    schema = pa.schema([("frame_id", pa.int64()), ("chunk_index", pa.int32()), ("embedding", pa.list_(pa.float32())), ("cell", pa.int32()), ("angle", pa.float64())])

    def run(batches):
        for batch in batches:
            v = _directions(_matrix(batch.column(2), centers.shape[1])) if batch.num_rows else np.zeros((0, centers.shape[1]))
            cosine = v @ centers.T if len(centers) else np.zeros((len(v), 1))
            cell = np.where(np.abs(v).sum(1) > 0, cosine.argmax(1), NO_DIRECTION).astype(np.int32)
            angle = np.arccos(np.clip(cosine.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(angle)], schema=schema)

    return vectors.select("frame_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, ROWS)


def write_cells(vectors: DataFrame, path: str, layout: Layout = Layout(), segment: str = "all") -> None:
    """Store ``frame_id, chunk_index, embedding`` as one segment, which is replaced if it is there.

    A cell with many rows is dealt to several tasks and files, about ``file_rows`` each, sorted by angle.
    """
    spark = vectors.sparkSession
    if not (known := rt.segments(spark, path)) or known == [segment]:
        lines = [(k, json.dumps(row)) for k, row in enumerate(fit(vectors, layout).tolist())]
        spark.createDataFrame(lines, "cell int, center string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    centers = read_centers(spark, path)
    rows = assign(vectors, centers)
    share = F.pmod(F.xxhash64("frame_id", "chunk_index"), F.lit(max(1, -(-vectors.count() // (layout.file_rows * max(1, len(centers)))))))
    rows.repartition("cell", share).sortWithinPartitions("cell", "angle").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows/segment={segment}")
    stored = spark.read.schema(ROWS).parquet(f"{path}/rows/segment={segment}")
    table = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/layer/segment={segment}")  # last: without it the segment isn't there


def read_centers(spark: SparkSession, path: str) -> np.ndarray:
    """One row per cell, ``Layout.most`` at most."""
    return np.array([json.loads(r.center) for r in spark.read.parquet(f"{path}/centers").orderBy("cell").collect()], np.float64)


def read_cells(spark: SparkSession, path: str) -> Cells:
    """All complete segments of a stored index."""
    names = rt.segments(spark, path)
    rows = spark.read.schema(f"{ROWS}, segment string").option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/segment={s}" for s in names))
    table = spark.read.option("basePath", f"{path}/layer").parquet(*(f"{path}/layer/segment={s}" for s in names))
    table = table.groupBy("cell").agg(F.sum("n"), F.min("low"), F.max("high")).orderBy("cell").collect()  # a row for each cell
    cell, n, low, high = (np.array(x) for x in zip(*table)) if table else np.zeros((4, 0))
    return Cells(rows.drop("segment"), read_centers(spark, path), cell.astype(np.int64), n.astype(np.int64), low.astype(np.float64), high.astype(np.float64))


class Best:
    """The nearest ``k`` rows of each query so far."""

    def __init__(self, k: int, queries: int):
        self.k, self.kth, self.parts, self.held, self.waiting = k, np.full(queries, np.inf), [], 0, 20_000

    def add(self, of: np.ndarray, distance: np.ndarray, frame: np.ndarray, chunk: np.ndarray) -> None:
        """``distance``: one row per query of ``of``, one column per vector."""
        if distance.shape[1] >= self.k:
            self.kth[of] = np.minimum(self.kth[of], np.partition(distance, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero(distance <= self.kth[of][:, None])
        self.parts.append((of[r], distance[r, c], frame[c], chunk[c]))
        self.held += len(r)
        if self.held > self.waiting:
            kept = self.rows()
            self.parts, self.held, self.waiting = [kept], len(kept[0]), 2 * len(kept[0]) + 20_000

    def rows(self) -> tuple[np.ndarray, ...]:
        return rt._first(self.k, *map(np.concatenate, zip(*self.parts)))


@dataclass
class Cells:
    """A stored index: its rows, the centroids, and of each cell that has rows its number and angles."""

    vectors: DataFrame
    centers: np.ndarray
    cell: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def angles(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query to each cell's centroid, and the lowest angle that a member of the cell can have to it."""
        if len(queries) and len(self.centers) and queries.shape[1] != self.centers.shape[1]:
            raise ValueError(f"a vector doesn't have {self.centers.shape[1]} dimensions")
        at = np.arccos(np.clip(_directions(queries) @ self.centers[np.maximum(self.cell, 0)].T, -1, 1)) if len(self.centers) and len(queries) else np.zeros((len(queries), len(self.cell)))
        bound = np.maximum(0, np.maximum(at - self.high, self.low - at))
        bound[:, self.cell == NO_DIRECTION] = 0
        bound[np.abs(queries).sum(1) == 0] = 0
        return at, bound

    def compared(self, wanted: np.ndarray, reach: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, keep: DataFrame | None) -> DataFrame:
        """The best ``k`` of each task and query among the cells that each query wants (a row of ``wanted``).

        Members that are farther off than a query's ``reach``, by their angle to the centroid, aren't compared.
        """
        q, at = _directions(queries), self.angles(queries)[0]
        of_cell = {int(c): (np.flatnonzero(wanted[:, x]), at[:, x]) for x, c in enumerate(self.cell) if wanted[:, x].any()}
        size, free = queries.shape[1] if len(queries) else 0, np.abs(queries).sum(1) == 0
        schema = pa.schema([("query_id", pa.int64()), ("frame_id", pa.int64()), ("chunk_index", pa.int32()), ("distance", pa.float64())])

        def run(batches):
            best = Best(k, len(q))
            for batch in batches:
                frame, chunk, cell, angle = (batch.column(c).to_numpy() for c in ("frame_id", "chunk_index", "cell", "angle"))
                column = batch.column("embedding")
                for c in np.unique(cell).tolist():
                    asking, theta = of_cell[c]
                    here = np.flatnonzero(cell == c)
                    if c != NO_DIRECTION:
                        near = np.abs(theta[asking][:, None] - angle[here][None]) <= reach[asking][:, None]
                        here = here[(near | free[asking][:, None]).any(0)]
                    if len(here):
                        v = _directions(_matrix(column.take(pa.array(here)), size))
                        for block in range(0, len(asking), 1024):
                            some = asking[block : block + 1024]
                            best.add(some, 1 - q[some] @ v.T, frame[here], chunk[here])
            if best.parts:
                query, distance, frame, chunk = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(frame), pa.array(chunk, pa.int32()), pa.array(distance)], schema=schema)

        rows = self.vectors.where(F.col("cell").isin(list(of_cell)))  # folders of other cells aren't read
        rows = rows if keep is None else rows.join(keep, "frame_id", "left_semi")
        return rows.select("frame_id", "chunk_index", "embedding", "cell", "angle").mapInArrow(run, "query_id long, frame_id long, chunk_index int, distance double")

    def reach(self, ids: np.ndarray, queries: np.ndarray, k: int, keep: DataFrame | None = None) -> np.ndarray:
        """An angle for each query within which its ``k`` nearest lie: that of the k-th in the cells with the lowest bounds."""
        at, bound = self.angles(queries)
        order = np.lexsort((at, bound)) if bound.size else np.zeros(bound.shape, np.int64)
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < 2 * k, axis=1)
        found = self.compared(first, np.full(len(queries), np.inf), np.arange(len(queries)), queries, k, keep)
        w = W.partitionBy("query_id").orderBy("distance", "frame_id", "chunk_index")
        kth = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("query_id", "distance").collect()  # one row a query
        out = np.full(len(queries), np.inf)
        for row in kth:
            out[row.query_id] = np.arccos(np.clip(1 - row.distance, -1, 1)) + SLACK
        return out

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, keep: DataFrame | None = None) -> DataFrame:
        """``query_id, frame_id, chunk_index, distance, rank``: the ``k`` nearest rows of each query, among the frames of ``keep`` if given."""
        reach = self.reach(ids, queries, k, keep)
        found = self.compared(self.angles(queries)[1] <= reach[:, None], reach, ids, queries, k, keep)
        w = W.partitionBy("query_id").orderBy("distance", "frame_id", "chunk_index")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def visits(self, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
        """``query_id, cells_read, cells_skipped, rows_read, rows_skipped`` of a search."""
        read = self.angles(queries)[1] <= self.reach(ids, queries, k)[:, None]
        rows = [(int(i), int(r.sum()), int((~r).sum()), int(self.n[r].sum()), int(self.n[~r].sum())) for i, r in zip(ids, read)]
        return self.vectors.sparkSession.createDataFrame(rows, "query_id long, cells_read long, cells_skipped long, rows_read long, rows_skipped long")

    def chunks(self, query: list[float], k: int, keep: DataFrame | None = None) -> DataFrame:
        """The ``k`` nearest chunks: ``frame_id, chunk_index, distance``."""
        found = self.search(np.zeros(1, np.int64), np.array([query], np.float64), k, keep)
        return found.select("frame_id", "chunk_index", "distance").orderBy("distance", "frame_id", "chunk_index").limit(k)

    def knn(self, frames: DataFrame, query: list[float], k: int, start: int = MIN_MS, end: int = MAX_MS, prefilter: bool = False) -> DataFrame:
        """``frame_id, distance, rank`` as ``retrieval.knn`` gives them."""
        inside = within(frames, start, end).select("frame_id")
        near = self.chunks(query, k, inside) if prefilter else self.chunks(query, k).join(inside, "frame_id", "left_semi")
        return rt.with_rank(near.groupBy("frame_id").agg(F.min("distance").alias("distance")), ["distance", "frame_id"], k)

    def batch(self, queries: DataFrame | list, k: int) -> DataFrame:
        """``query_id, frame_id, chunk_index, distance, rank`` for a stated set of queries, whose size is checked."""
        rows = queries if isinstance(queries, list) else [tuple(r) for r in rt.asked_for(queries, "query_id", "embedding")]
        if len(rows) > rt.MOST_QUERIES or len(rows) * k > rt.MOST_RESULTS:
            raise ValueError(f"a query set holds at most {rt.MOST_QUERIES} vectors and asks for at most {rt.MOST_RESULTS} neighbours")
        return self.search(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), len(rows[0][1]) if rows else 0), k)
