"""Nearest neighbours by cosine: a block matrix join over int8 tiles with quantisation error bounds.

Vectors are scaled to unit length and quantised to int8 with a scale of their own; the exact length of the quantisation error is kept.
Vectors are packed into blocks within the tasks that read them.  Blocks of queries and of candidates are numbered and dealt
to a grid of (query group, candidate salt) cells of about GROUP by SALTED rows, so every query block meets every candidate
block in one tile, no task gets a whole row or column of the grid, and nothing is broadcast.
In a tile the int8 product gives each cosine within |error| bounds; pairs whose upper bound reaches the k-th lower bound
survive, are recomputed in double precision from the original vectors and merged into one heap per query.  The heaps of the
tasks are merged by query.  Nothing is lost: the result is exact.

Within a block, of equal vectors only the k + 1 smallest ids can be among the k nearest, so the others leave it first.

Defined cases: vectors that are null, empty, zero, or hold nulls or non-finite components take no part, neither do null ids;
vectors of another length than the query's aren't its candidates; ties go to the smaller id; a row that is repeated (same
id, same vector) counts once, an id with several vectors once for each, as a query by the least of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import small_batches, table

#: Rows of a block, at most, and queries and candidates of a cell of the grid.
ROWS, GROUP, SALTED = 2048, 16_384, 16_384
K, EVERY = 5, 50
BLOCK_SCHEMA = "part int, n int, dim int, ids binary, vectors binary"


def _usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _equal_kept(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Places of rows that are among the keep smallest ids of their (equal) vectors."""
    order = np.lexsort((ids, np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_inverse=True)[1]))
    again = np.concatenate([[False], (vectors[order[1:]] == vectors[order[:-1]]).all(1) & (ids[order[1:]] == ids[order[:-1]])])
    order = order[~again]
    same = np.concatenate([[False], (vectors[order[1:]] == vectors[order[:-1]]).all(1)])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return np.sort(order[np.arange(len(order)) - start < keep])


def _packed(rows: DataFrame, salts: int, keep: int | None) -> DataFrame:
    """Blocks of at most ROWS rows of one dimension; ``part`` is a number below ``salts``."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() * 7919
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(size)])[:-1]
            for dim in np.unique(size).tolist():
                rows_of = np.flatnonzero(size == dim)
                vectors, own = np.ascontiguousarray(flat[at[rows_of][:, None] + np.arange(dim)]), ids[rows_of]
                if keep:
                    kept = _equal_kept(own, vectors, keep)
                    vectors, own = vectors[kept], own[kept]
                yield pa.RecordBatch.from_arrays([pa.array([part % salts], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([dim], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], ["part", "n", "dim", "ids", "vectors"])
                part += 1

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the lengths of what quantising the unit vectors leaves, and the lengths of the quantised."""
    top = np.abs(vectors).max(1, keepdims=True)
    unit = vectors / top
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt(((unit - back) ** 2).sum(1)), np.sqrt((back * back).sum(1))


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows; in float32, sums of up to 1024 products of int8 are exact."""
    out = np.zeros((len(a), len(b)), np.float32)
    for d in range(0, a.shape[1], 1024):
        part = a[:, d : d + 1024].astype(np.float32) @ b[:, d : d + 1024].astype(np.float32).T
        out = part if a.shape[1] <= 1024 else out.astype(np.float64) + part
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision; rows are scaled first, so no square over- or underflows."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def tile(q_ids, q_vectors, q, c_ids, c_vectors, c, k: int, floor: np.ndarray):
    """Surviving (query place, id, cosine) of a tile.  floor: for each query a cosine that k candidates reach already."""
    near = int8_products(q[0], c[0]) * q[1][:, None] * c[1][None, :]
    slack = q[2][:, None] + q[3][:, None] * c[2][None, :] + 1e-6
    near[q_ids[:, None] == c_ids[None, :]] = -9
    low = near - slack
    if len(c_ids) > k:
        reached = np.partition(low, -k, axis=1)[:, -k]
    else:
        reached = np.full(len(q_ids), -4.0)
    at_q, at_c = np.nonzero((near + slack >= np.maximum(reached, floor)[:, None]) & (near > -8))
    for i in range(0, len(at_q), 65_536):
        x, y = at_q[i : i + 65_536], at_c[i : i + 65_536]
        yield x, c_ids[y], cosines(q_vectors[x], c_vectors[y])


def _unpack(n, dim, ids, vectors):
    v = np.frombuffer(vectors, np.float64).reshape(n, dim)
    return np.frombuffer(ids, np.int64), v, quantise(v)


def _searched(k: int):
    """Tiles in, (query_id, vec_id, score) out; heaps are kept while the query block stays the same."""

    def heaped(state):
        ids, heaps = state[1][0], state[2]
        rows = [(int(ids[i]), -v, s) for i, h in enumerate(heaps) for s, v in h]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"]) if rows else None

    def run(batches):
        state = None  # packed ids, unpacked query block, heaps, floors
        for b in batches:
            for qn, dim, qi, qv, n, ids, vectors in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or state[0] != qi:
                    if state is not None and (out := heaped(state)) is not None:
                        yield out
                    state = (qi, _unpack(qn, dim, qi, qv), [[] for _ in range(qn)], np.full(qn, -4.0))
                (q_ids, q_vectors, q), heaps, floor = state[1:]
                for x, vs, ss in tile(q_ids, q_vectors, q, *_unpack(n, dim, ids, vectors), k, floor):
                    for i, v, s in zip(x.tolist(), vs.tolist(), ss.tolist()):
                        h = heaps[i]
                        if (s, -v) in h:
                            continue
                        if len(h) < k:
                            heapq.heappush(h, (s, -v))
                        elif (s, -v) > h[0]:
                            heapq.heapreplace(h, (s, -v))
                for i, h in enumerate(heaps):
                    if len(h) == k:
                        floor[i] = h[0][0] - 1e-9
        if state is not None and (out := heaped(state)) is not None:
            yield out

    return run


def _merged(k: int):
    """Rows sorted by query to each query's k best, ranked, through one heap per query."""

    def run(batches):
        at, heap, out = None, [], []

        def close():
            for r, (s, v) in enumerate(sorted(heap, key=lambda x: (-x[0], -x[1])), 1):
                out.append((at, r, -v, s))
            heap.clear()

        for b in batches:
            for q, v, s in zip(*(c.to_pylist() for c in b.columns)):
                if q != at:
                    close()
                    at = q
                if (s, -v) in heap:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
            if out:
                yield _ranked(out)
        close()
        if out:
            yield _ranked(out)

    return run


def _ranked(out):
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])
    out.clear()
    return batch


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of rows for each of queries, a row with the query's id excepted."""
    spark = rows.sparkSession
    small_batches(spark, ROWS)
    candidates, wanted = _usable(rows, id, vector), _usable(queries, id, vector).groupBy("id").agg(F.min("v").alias("v"))
    n, asked_n = rows.count(), queries.count()
    # As many salts as cores can work on, if there are so many blocks.
    salts = max(1, -(-n // SALTED), min(spark.sparkContext.defaultParallelism, n // ROWS))
    groups = max(1, -(-asked_n // GROUP))
    every = lambda name, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    blocks = _packed(candidates, salts, k + 1).select("*", every("group", groups))
    asked = _packed(wanted.repartition(max(1, -(-asked_n // ROWS)), "id"), groups, None)
    asked = asked.select(F.col("part").alias("group"), F.col("n").alias("qn"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), every("part", salts))
    tiles = asked.join(blocks, ["group", "part", "dim"]).select("qn", "dim", "q_ids", "q_vectors", "n", "ids", "vectors")
    found = tiles.mapInArrow(_searched(k), "query_id long, vec_id long, score double")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE_OP2 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
