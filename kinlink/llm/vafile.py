"""Exact top-k inner products through a vector-approximation file.

Vectors are stored twice, in two tables: as coarse cells of 2**CELL_BITS
integers a dimension, a byte each, with the length of what the cells leave
out, and exactly. A scan of the cells alone bounds every score from both
sides; a row stays a query's candidate while its upper bound reaches the k-th
lower bound. Exact vectors are then read in the order of the upper bounds:
first the most promising few of each query, then those whose bound still
reaches the k-th exact score, so that the result is certain. Queries go to the
scan in groups of bounded size, one pass a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.common import load, materialise

CELL_BITS = 1
#: Bytes of one group's query vectors, which are broadcast.
QUERY_BYTES = 16 << 20
QUERY_BLOCK = 256
LOW, HIGH = -(2**63), 2**63 - 1


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as whole doubles; unusable vectors left out."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embeddings.where(usable).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))


def exact_file(vectors: DataFrame) -> DataFrame:
    """The exact vectors: rid (a number of the stored row), vec_id, v (64-bit floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(v, dtype=np.float64).tobytes() for v in b.column(1).to_pylist()], pa.binary())], names=["vec_id", "v"])

    return materialise(vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v binary").select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v"), "vectors")


def approximation_file(exact: DataFrame) -> DataFrame:
    """The cells: rid, vec_id, dim, cells (bytes, or wider integers where a cell needs them), rest (length of what they leave out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = float(1 << CELL_BITS)
        for b in batches:
            dims, made, rest = [], [], []
            for raw in b.column(2).to_pylist():
                v = np.frombuffer(raw)
                cells = np.floor(v / width)
                most = float(np.abs(cells).max(initial=0))
                dims.append(len(v))
                made.append(cells.astype("i1" if most < 2**7 else "<i4" if most < 2**31 else "<f8").tobytes())
                rest.append(float(np.linalg.norm(v - width * cells - (width - 1) / 2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(made, pa.binary()), pa.array(rest, pa.float64())], names=["rid", "vec_id", "dim", "cells", "rest"])

    return materialise(exact.mapInArrow(run, "rid long, vec_id long, dim int, cells binary, rest double"), "cells")


class Scan:
    """What the cells of the blocks seen so far leave as candidates of each query."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, queries, k
        self.lows = np.full((len(ids), k), -np.inf)  # highest lower bounds, ascending
        self.found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in ids]
        self.norm, self.taxi = np.linalg.norm(queries, axis=1), np.abs(queries).sum(1)
        self.small = queries.size == 0 or float(np.abs(queries).max()) < 2**10

    def block(self, rid: np.ndarray, ids: np.ndarray, cells: np.ndarray, rest: np.ndarray) -> None:
        width = float(1 << CELL_BITS)
        mid = (width - 1) / 2
        most = float(np.abs(cells).max(initial=0))
        slack = 1e-3 * (1 + most)
        narrow = self.small and most < 2**10  # 32-bit products are exact
        right = cells.T.astype(np.float32 if narrow else np.float64)
        for at in range(0, len(self.ids), QUERY_BLOCK):
            q = self.q[at : at + QUERY_BLOCK]
            centre = (q.astype(right.dtype) @ right).astype(np.float64)
            centre *= width
            centre += mid * q.sum(1)[:, None]
            for j in range(len(q)):
                self._query(at + j, rid, ids, centre[j], rest, mid, slack)

    def _query(self, j: int, rid: np.ndarray, ids: np.ndarray, centre: np.ndarray, rest: np.ndarray, mid: float, slack: float) -> None:
        half = np.minimum(self.norm[j] * rest, self.taxi[j] * mid) * (1 + 1e-9) + slack * (1 + self.norm[j]) * 1e-3 + 1e-6 * np.abs(centre)
        low, upper = centre - half, centre + half
        others = ids != self.ids[j]  # any number of rows may be the query's own
        reach = np.flatnonzero(others & (upper >= self.lows[j, 0]))
        lows = low[reach]
        best = np.concatenate((self.lows[j], np.partition(lows, -self.k)[-self.k :] if len(lows) > self.k else lows))
        self.lows[j] = np.sort(best)[-self.k :]
        reach = reach[upper[reach] >= self.lows[j, 0]]
        if len(reach):
            self.found[j].append((rid[reach], ids[reach], low[reach], upper[reach]))

    def candidates(self) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """query id; rid, vec_id, lower and upper bound of its candidates."""
        for j, parts in enumerate(self.found):
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                keep = columns[3] >= self.lows[j, 0]
                yield int(self.ids[j]), tuple(c[keep] for c in columns)


def scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; by Python integers where doubles wouldn't hold them."""
    if rows.shape[1] and float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1] >= 2**53:
        return np.array([min(max(sum(int(a) * int(b) for a, b in zip(r, x, strict=True)), LOW), HIGH) for r, x in zip(rows, q, strict=True)], dtype=np.int64)
    return np.einsum("ij,ij->i", rows, q).astype(np.int64)


class Asked:
    """A group's queries by dimension, as they are broadcast."""

    def __init__(self, ids: list[int], vectors: list[list[float]]):
        by_dim: dict[int, tuple[list[int], list[list[float]]]] = {}
        for i, v in zip(ids, vectors, strict=True):
            rows = by_dim.setdefault(len(v), ([], []))
            rows[0].append(i)
            rows[1].append(v)
        self.by_dim = {d: (np.array(i), np.array(v, dtype=np.float64).reshape(len(i), d)) for d, (i, v) in by_dim.items()}


def scan(cells: DataFrame, shared, k: int) -> DataFrame:
    """query_id, rid, vec_id, low, upper of each task's candidates; exact vectors are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {d: Scan(ids, q, k) for d, (ids, q) in shared.value.by_dim.items()}
        for b in batches:
            rid, ids, dims, raw, rest = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist(), b.column(4).to_numpy()
            size = np.array([len(x) for x in raw]) // np.maximum(dims, 1)
            for d, w in {(int(d), int(w)) for d, w in zip(dims, size, strict=True)}:
                if d in searches:
                    rows = np.flatnonzero((dims == d) & (size == w))
                    kind = {1: "i1", 4: "<i4", 8: "<f8", 0: "i1"}[w]
                    searches[d].block(rid[rows], ids[rows], np.frombuffer(b"".join(raw[r] for r in rows), kind).reshape(len(rows), d), rest[rows])
        for s in searches.values():
            for query, (rid, ids, low, upper) in s.candidates():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rid), query)), pa.array(rid), pa.array(ids), pa.array(low), pa.array(upper)], names=["query_id", "rid", "vec_id", "low", "upper"])

    return cells.mapInArrow(run, "query_id long, rid long, vec_id long, low double, upper double")


def read_exact(pairs: DataFrame, exact: DataFrame, shared) -> DataFrame:
    """query_id, rid, vec_id, score of given candidates, from their exact vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {d: {int(i): k for k, i in enumerate(ids.tolist())} for d, (ids, _) in shared.value.by_dim.items()}
        for b in batches:
            query, raw = b.column(0).to_pylist(), b.column(3).to_pylist()
            made = np.zeros(len(raw), np.int64)
            dims = np.array([len(x) // 8 for x in raw])
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                q = shared.value.by_dim[d][1][[place[d][query[r]] for r in rows]]
                made[rows] = scores(np.frombuffer(b"".join(raw[r] for r in rows)).reshape(len(rows), d), q)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made)], names=["query_id", "rid", "vec_id", "score"])

    joined = pairs.select("query_id", "rid", "vec_id").join(exact.select("rid", "v"), "rid").select("query_id", "rid", "vec_id", "v")
    return joined.mapInArrow(run, "query_id long, rid long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k best inner products of each query.

    ``vectors`` and ``queries`` hold vec_id and v as ``integer_vectors`` gives
    them; other columns are not read. Rows with the query's vec_id are its
    own. A vec_id that repeats among the queries is asked once, with its first
    vector in order; repeated candidate rows are results of their own. Vectors
    of different lengths don't meet. Scores beyond 64 bits stand as the
    largest or smallest long; which of those are kept follows their true size.
    Empty tables give no rows.
    """
    spark = vectors.sparkSession
    exact = exact_file(vectors)
    cells = approximation_file(exact)
    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = once.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    groups = max(1, -(-size // (QUERY_BYTES // 2)))
    asked = materialise(once.withColumn("_group", F.pmod(F.xxhash64("vec_id"), F.lit(groups))), "queries")
    kept = None
    for group in range(groups):
        got = asked.where(F.col("_group") == group).select("vec_id", "v").toArrow().sort_by("vec_id")  # QUERY_BYTES at most
        if not got.num_rows:
            continue
        shared = spark.sparkContext.broadcast(Asked(got["vec_id"].to_pylist(), got["v"].to_pylist()))
        of_query = Window.partitionBy("query_id")
        found = materialise(scan(cells, shared, k), "candidates")
        # A query's candidates are some hundreds: their k-th lower bound over all tasks, then their order.
        kth = F.max(F.when(F.col("_l") == k, F.col("low"))).over(of_query)
        able = found.withColumn("_l", F.row_number().over(of_query.orderBy(F.desc("low")))).withColumn("_kth", kth).where(F.col("_kth").isNull() | (F.col("upper") >= F.col("_kth")))
        able = materialise(able.withColumn("_place", F.row_number().over(of_query.orderBy(F.desc("upper"), "rid"))).select("query_id", "rid", "vec_id", "upper", "_place"), "ordered")
        first = materialise(read_exact(able.where(F.col("_place") <= 2 * k), exact, shared), "first")
        reached = first.withColumn("_r", F.row_number().over(of_query.orderBy(F.desc("score")))).where(F.col("_r") == k).select("query_id", F.col("score").alias("_least"))
        rest = able.where(F.col("_place") > 2 * k).join(reached, "query_id").where(F.col("upper") >= F.col("_least"))
        part = first.unionAll(read_exact(rest, exact, shared))
        kept = part if kept is None else kept.unionAll(part)
    if kept is None:
        kept = spark.createDataFrame([], "query_id long, rid long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "rid")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(load(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
