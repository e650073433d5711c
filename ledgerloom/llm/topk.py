"""Exact top-k by inner product: tiled matrix products of query blocks and shards.

Each tile (a block of queries and a shard of rows) gives the k best of the shard for each of its queries by partial
selection; lists of one task are merged as they come, those of tasks by a tree of FAN_IN. Components are floor(1024 x), so
scores are whole numbers; products of doubles are used where they are provably exact, Python integers elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1024
TILE = 4096
#: Queries that are broadcast at a time; more of them are searched in further passes over the rows.
QUERY_BYTES = 32 << 20
FAN_IN = 32
_LIST = "query_id long, vec_id long, score long"
_EXACT = float(1 << 53)
#: Marks the query's own row; scores are clipped above it.
_NONE = np.iinfo(np.int64).min
QUERIES = 1024


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of `dim` components as floor(SCALE x) in doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(len(column), dim) * SCALE)


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if q.size == 0 or v.size == 0 or np.abs(q).max() * np.abs(v).max() * q.shape[1] < _EXACT:
        return (q @ v.T).astype(np.int64)
    whole = [np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (q, v)]
    top = (1 << 63) - 1
    return np.array([[max(-top, min(top, s)) for s in r] for r in whole[0] @ whole[1].T], np.int64)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row: highest score, then smallest id."""
    ids = np.broadcast_to(ids, score.shape)
    if score.shape[1] > 4 * k:  # all at or above the k-th score stay, so that ties are decided by id
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        below = score < least[:, None]
        chosen = np.argsort(below, axis=1, kind="stable")[:, : int((~below).sum(1).max())]
        ids, score = np.take_along_axis(ids, chosen, 1), np.take_along_axis(score, chosen, 1)
    order = np.lexsort((ids, np.invert(score)), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def _tiles(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dim, (qid, q) in shared.value.items():
                rows = batch.filter(pa.array(sizes == dim))
                for a in range(0, rows.num_rows, TILE):
                    part = rows.slice(a, TILE)
                    ids, v = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                    for lo in range(0, len(qid), QUERIES):
                        score = _product(q[lo : lo + QUERIES], v)
                        score[qid[lo : lo + QUERIES, None] == ids[None, :]] = _NONE
                        new = _best(ids[None, :], score, k)
                        if (dim, lo) in held:
                            old = held[dim, lo]
                            new = _best(np.concatenate([old[0], new[0]], 1), np.concatenate([old[1], new[1]], 1), k)
                        held[dim, lo] = new
        for (dim, lo), (ids, score) in held.items():
            query = np.repeat(shared.value[dim][0][lo : lo + QUERIES], ids.shape[1])
            good = score.ravel() != _NONE
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel()[good]) for x in (query, ids, score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each query; is_query tells which rows of vectors are.

    vectors: (vec_id, embedding). Score: inner product of floor(1024 x); ties go to the smaller vec_id; the query's own id is
    left out. Null ids, and vectors that are null or hold null or non-finite components take no part, components that are not finite as
    doubles when scaled included; vectors are
    compared with those of their own length, empty ones too, with the score 0. Of rows that share a vec_id, each is a candidate; as a query, one stands for
    all (the one that sorts first). Products beyond 64 bits are clipped to them. Fewer candidates than k give them all; an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * SCALE) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("q")).where(usable)
    queries = rows.where("q").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = materialize(queries, "queries")
    total = queries.agg(F.coalesce(F.sum(F.size("embedding").cast("long") * 8 + 16), F.lit(0))).first()[0]
    passes, parts = max(1, -(-total // query_bytes)), []
    rows = rows.select("vec_id", "embedding")
    for p in range(passes):
        block: dict[int, list] = {}
        for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).collect():
            block.setdefault(len(r["embedding"]), []).append((r["vec_id"], r["embedding"]))
        shared = spark.sparkContext.broadcast({d: (np.array([i for i, _ in b], np.int64), np.floor(np.array([e for _, e in b], np.float64).reshape(len(b), d) * SCALE)) for d, b in block.items()})
        parts.append(rows.mapInArrow(_tiles(shared, k), _LIST).select("*", F.spark_partition_id().alias("part")))
        if passes > 1:
            parts[-1] = materialize(parts[-1], f"pass{p}")
    lists = parts[0]
    for x in parts[1:]:
        lists = lists.union(x)
    best = [F.desc("score"), F.asc("vec_id")]
    # A level of the tree: the lists of FAN_IN tasks become one; each level also prunes before its shuffle.
    lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN))
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
