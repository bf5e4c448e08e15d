"""Exact top-k inner products: queries against shards of the table, in matrix tiles.

A group of queries whose size is bounded by construction is broadcast as a matrix; each task
multiplies its batches of the table with tiles of it, selects the best k of each tile, and folds
them into its running lists.  The tasks' lists meet in two levels of merging, by query and group of
tasks first.  Queries beyond one group's bound are handled by further passes over the table, one
after the other: a pass writes its lists to the shared folder and its queries are dropped, so that
the driver and the executors hold one group at any time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: Bytes of query vectors that one pass broadcasts.
GROUP_BYTES = 32 << 20
QUERY_TILE, SHARD = 1024, 4096
NONE = np.iinfo(np.int64).min
SCHEMA = "query_id long, vec_id long, score long"


def _matrix(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the usable vectors, and which these are: not null, without null or non-finite components."""
    if not len(vectors):
        return np.zeros((0, 0)), np.zeros(0, bool)
    lists = vectors.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(lists)
    flat = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    wrong = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~np.isfinite(flat), out=wrong[1:])
    usable = (wrong[ends] == wrong[ends - sizes]) & (sizes > 0) & ~np.asarray(vectors.is_null().to_numpy(zero_copy_only=False))
    width = int(sizes[usable].max()) if usable.any() else 0
    if usable.any() and (sizes[usable] != width).any():
        raise ValueError("vectors of different lengths")
    place = (ends - sizes)[usable][:, None] + np.arange(width)
    return np.floor(flat[place] * scale), usable


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: in doubles while no sum can leave 2**53, else in Python's integers, saturated to 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2**53:
        if bound < 2**24:
            return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object)
    got = whole(a) @ whole(b).T
    return np.clip(got, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, larger score first, then smaller id."""
    n = scores.shape[1]
    if n > 4 * k and (ids.strides[0] == 0) and scores.max() < 2**48 and scores[scores != NONE].min(initial=0) > -(2**48):
        by_id = np.argsort(ids[0], kind="stable")  # one key for both: the score, then the place in the order of ids
        keys = np.where(scores == NONE, -(2**49), scores)[:, by_id] * n + np.arange(n - 1, -1, -1)
        pick = by_id[np.argpartition(keys, n - k, axis=1)[:, n - k :]]
        scores, ids = np.take_along_axis(scores, pick, 1), np.take_along_axis(ids, pick, 1)
    order = np.lexsort((ids, -np.maximum(scores, NONE + 1)), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k best other rows of each row that is_query selects.

    is_query: a Column over vec_id.  score: inner product of floor(scale * component), exact, or the
    nearest 64-bit integer if it is beyond them.  Ties go to the smaller vec_id.  Vectors that are null, empty, or hold null or non-finite components
    take no part; a query with fewer than k others gets all.  Rows that repeat an id are candidates
    each, but never of a query with that id; of query rows that repeat an id the one with the smallest
    vector asks.  Vectors of different lengths raise.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null")
    queries = rows.where(is_query).where("vector is not null and size(vector) > 0")
    n, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    groups = max(1, math.ceil((n or 0) * 8 * (width or 1) / group_bytes))
    if groups == 1:
        return _pass(rows, _sent(queries, scale), k, scale)
    path = scratch(spark, "lists")
    for g in range(groups):
        sent = _sent(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g), scale)
        found = _pass(rows, sent, k, scale)
        found.write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(found.schema).parquet(path)


def _sent(queries: DataFrame, scale: float):
    """Ids and vectors of a group of queries, whose size is bounded, on all executors."""
    table = queries.toArrow()
    matrix, usable = _matrix(table.column("vector").combine_chunks(), scale)
    ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)[usable]
    order = np.lexsort((*matrix.T[::-1], ids))
    order = order[np.diff(ids[order], prepend=ids[order][:1] - 1) != 0]
    return queries.sparkSession.sparkContext.broadcast((ids[order], matrix[order]))


def _pass(rows: DataFrame, sent, k: int, scale: float) -> DataFrame:
    def run(batches):
        own, matrix = sent.value
        if not len(own):
            return
        scores, ids = np.full((len(own), k), NONE), np.full((len(own), k), np.iinfo(np.int64).max)
        for batch in batches:
            shard, usable = _matrix(batch.column("vector"), scale)
            those = batch.column("vec_id").to_numpy(zero_copy_only=False)[usable]
            if len(those) and shard.shape[1] != matrix.shape[1]:
                raise ValueError("vectors of different lengths")
            for s in range(0, len(those), SHARD):
                part, names = shard[s : s + SHARD], those[s : s + SHARD]
                for q in range(0, len(own), QUERY_TILE):
                    now = slice(q, q + QUERY_TILE)
                    got = _products(matrix[now], part)
                    got[own[now][:, None] == names[None, :]] = NONE
                    tile = _best(got, np.broadcast_to(names, got.shape), k)
                    scores[now], ids[now] = _best(np.hstack([scores[now], tile[0]]), np.hstack([ids[now], tile[1]]), k)
        held = scores != NONE
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[held.ravel()]), pa.array(ids[held]), pa.array(scores[held])], names=["query_id", "vec_id", "score"])

    lists = rows.mapInArrow(run, SCHEMA).withColumn("_task", F.spark_partition_id())
    order = [F.col("score").desc(), F.col("vec_id")]
    level = lists.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id", F.shiftright("_task", 6)).orderBy(*order))).where(F.col("_rank") <= k)
    return level.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
