"""Embedding whitening by a tall-skinny QR: the covariance of the vectors is never formed.

Entries become integers, whose sums over all rows are exact, so centred rows are rounded once.  Each
task folds its centred rows, block by block, into a triangular factor; the factors merge in a tree;
the singular values and right vectors of the last one are the standard deviations and directions of
the whole table.  Only that factor, of the size of a vector squared, reaches the driver.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
#: Rows that are centred and factored at a time, and bytes of factors that meet in one task of the tree.
BLOCK, MERGE_BYTES = 2048, 64 << 20
#: Entries beyond this have no integer of their own in doubles.
LARGEST = 2.0**53
#: A component whose standard deviation is below this part of the largest one holds rounding only.
NO_SPREAD = 1e-10


def integers(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(SCALE * entry) + SHIFT of the vectors that take part, which these are, and the length of every one (0: it takes no part).

    With a width only vectors of that length take part, and the first is a matrix."""
    if not len(vectors):
        return np.zeros((0, width or 0), np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    lists = vectors.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(pc.fill_null(pc.list_flatten(lists), float("nan")).to_numpy(zero_copy_only=False) * SCALE)
    ends = np.cumsum(sizes)
    wrong = np.concatenate([[0], np.cumsum(~(np.abs(flat) <= LARGEST))])
    sizes = np.where(wrong[ends] == wrong[ends - sizes], sizes, 0)
    usable = sizes > 0 if width is None else sizes == width
    if width is None:
        return flat, usable, sizes
    if not width:
        return np.zeros((0, 0), np.int64), np.zeros(len(sizes), bool), sizes
    return flat[(ends[usable] - width)[:, None] + np.arange(width)].astype(np.int64) + SHIFT, usable, sizes


def _sums(batches):
    """Rows and sums of each entry, by the vectors' length, of a task's rows; Python's integers, as the sums can pass 64 bits."""
    held: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        lengths = integers(batch.column("vector"))[2]
        for width in np.unique(lengths[lengths > 0]).tolist():
            x = integers(batch.column("vector"), width)[0]
            own = x.sum(0) if float(np.abs(x).max()) * len(x) < 2**62 else x.astype(object).sum(0)
            n, before = held.get(width, (0, [0] * width))
            held[width] = n + len(x), [a + int(b) for a, b in zip(before, own)]
    for width, (n, sums) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([str(s) for s in sums])], names=["width", "place", "n", "total"])


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the most frequent length (of several the longest), and the exact sum of each entry."""
    parts = mapped(rows.select("vector"), _sums, "width int, place int, n long, total string")
    sums = materialize(parts.groupBy("width", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    most = sums.where("place = 0").orderBy(F.col("n").desc(), F.col("width").desc()).select("width", "n").first()
    if most is None:
        return 0, []
    return most["n"], [int(r["total"]) for r in sums.where(F.col("width") == most["width"]).orderBy("place").collect()]  # one vector


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S of each entry: exact, in 64 bits where they fit, else in Python's integers."""
    bound = n * float(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if bound < 2**62 else object
    return x.astype(kind) * n - np.array(sums, kind)


def _blocks(batches, n: int, sums: list[int]):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            x, usable, _ = integers(piece.column("vector"), len(sums))
            if len(x):
                yield piece.filter(pa.array(usable)), centred(x, n, sums)


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows, with zeros below where they are fewer than columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def _factors(batches, n: int, sums: list[int]):
    import pyspark

    factor = None
    for _, deviations in _blocks(batches, n, sums):
        rows = (deviations / n).astype(float)
        factor = _factor(rows if factor is None else np.vstack([factor, rows]))
    if factor is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pyspark.TaskContext.get().partitionId()], pa.int64()), pa.array([factor.ravel()], pa.list_(pa.float64()))], names=["part", "factor"])


def _merge(table: pa.Table, width: int) -> pa.Table:
    factor = _factor(np.vstack([r.values.to_numpy().reshape(width, width) for r in table.column("factor")]))
    return pa.table({"part": table.column("part").slice(0, 1), "factor": pa.array([factor.ravel()], pa.list_(pa.float64()))})


def triangular_factor(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows, up to the signs of its rows."""
    width = len(sums)
    schema = "part long, factor array<double>"
    factors = mapped(rows.select("vector"), partial(_factors, n=n, sums=sums), schema)
    fan = max(2, min(16, MERGE_BYTES // (8 * width * width)))
    left = rows.rdd.getNumPartitions()
    while left > 1:
        left = math.ceil(left / fan)
        factors = factors.withColumn("part", F.expr(f"part div {fan}")).groupBy("part").applyInArrow(lambda t: _merge(t, width), schema)
    return np.array(factors.first()["factor"]).reshape(width, width)


class Whitening:
    """n, sums, directions (a column each) and deviations of the components, and the share of the whole variance that each explains."""

    def __init__(self, n: int, sums: list[int], factor: np.ndarray, components: int):
        _, s, vt = np.linalg.svd(factor)
        some = np.flatnonzero(s[:components] > NO_SPREAD * s[0]) if len(s) and s[0] > 0 else np.zeros(0, int)
        vt = vt[some]
        sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)]) if len(vt) else np.zeros(0)
        self.n, self.sums = n, sums
        self.directions = (vt * sign[:, None]).T
        self.deviations = s[some] / math.sqrt(n) if n else s[some]
        self.explained = (s[some] / s[0]) ** 2 / np.sum((s / s[0]) ** 2) if len(some) else np.zeros(0)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        """Components of rows given as n * x - S."""
        return (deviations / self.n).astype(float) @ self.directions / self.deviations


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all usable vectors of a table; see whiten."""
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("vector"))
    n, sums = exact_sums(rows)
    return Whitening(n, sums, triangular_factor(rows, n, sums) if n else np.zeros((0, 0)), components)


def _moments(batches, model: Whitening):
    """Sums and products of a task's whitened rows: the upper triangle, with the sums behind."""
    k = model.directions.shape[1]
    held = np.zeros((k + 1, k))
    for _, deviations in _blocks(batches, model.n, model.sums):
        w = model.whiten(deviations)
        held[:k] += w.T @ w
        held[k] += w.sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(range(held.size), pa.int32()), pa.array(held.ravel())], names=["place", "total"])


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = model.directions.shape[1]
    if not k:
        return 0.0
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("vector"))
    sums = mapped(rows, partial(_moments, model=model), "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    total = np.zeros((k + 1) * k)
    for r in sums.collect():  # as many as components squared
        total[r["place"]] = r["total"]
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def _whitened(batches, model: Whitening, error: float):
    k = model.directions.shape[1]
    for piece, deviations in _blocks(batches, model.n, model.sums):
        far = np.abs(deviations).max(axis=1).astype(float) ** 2 * deviations.shape[1] if len(deviations) else np.zeros(0)
        squares = (deviations**2).sum(axis=1) if not (far >= 2.0**62).any() else (deviations.astype(object) ** 2).sum(axis=1)
        squares = pa.array([v if v < 2**63 else None for v in map(int, squares)], pa.int64())
        m = len(deviations)
        at = pa.array(np.repeat(np.arange(m), k))
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        yield pa.RecordBatch.from_arrays([piece.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), squares.take(at), pa.array(model.whiten(deviations).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))], names=names)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    A row for each vector that takes part and each component up to `components`.  Vectors that are
    null, empty, or hold null or non-finite entries take no part, nor do those with an entry that has
    no integer in doubles (beyond 2**53 / 64), nor those of another length than the most frequent one
    (of several the longest).  Rows that repeat an id, or have none, take part each.  Components
    without spread (rank below the number of entries, a single vector, equal vectors) cannot be
    scaled to one and are left out, with all rows if there is no other.  deviation is exact, and null
    where it passes 64 bits.  A component points where its largest entry is positive.  Other columns
    can have any name.  The table is read four times: sums, factors, moments of the result, result.
    """
    model = fit(vectors, vector_col, components)
    error = identity_error(vectors, model, vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    run = partial(_whitened, model=model, error=error)
    return mapped(rows, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
