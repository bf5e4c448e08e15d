"""Images: merging, smoothing, bandwidth choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .ids import first_of_sources


def merge_images(sources: list[DataFrame], keep: DataFrame | None = None) -> DataFrame:
    """Union of (iid, voxels) sources, the first of a repeated subject kept, then the keep list (O-091, O-116J)."""
    sizes = {r[0] for s in sources for r in s.select(F.size("voxels")).distinct().limit(2).collect()}
    if len(sizes) > 1:
        raise ValueError("images of different sizes")
    merged = first_of_sources(sources, ["iid"])
    return merged if keep is None else merged.join(keep.select("iid"), "iid", "left_semi")


def drop_constant(images: DataFrame) -> DataFrame:
    """Subjects whose values differ (O-028)."""
    return images.where(F.array_min("voxels") < F.array_max("voxels"))


def voxel_means(images: DataFrame) -> DataFrame:
    """voxel, mean (O-118)."""
    return images.select(F.posexplode("voxels").alias("voxel", "_v")).groupBy("voxel").agg(F.avg("_v").alias("mean"))


def bandwidths(n_voxels: int, dim: int) -> list[float]:
    """Six candidates around N^(-1/(4+d)) (O-164)."""
    return [c * n_voxels ** (-1 / (4 + dim)) for c in (0.5, 1, 2, 3, 5, 10)]


#: Bytes of weights that tasks hold; more of them take several passes, each for a range of voxels. Pairs that a task weighs at a time, and products of images.
WEIGHT_BYTES, PAIRS, PRODUCTS = 256 << 20, 1 << 20, 8 << 20
#: Voxels of a cell at least, about.
CELL_VOXELS = 256


def smoothing_table(coords: DataFrame, bws: list) -> DataFrame:
    """bw (its place in `bws`), voxel, near, w: local linear weights of each voxel (O-163).

    coords: (voxel, xyz array); a bandwidth is one number, or one for each direction.  Weights are a product of
    Gaussian densities over the neighbours nearer than 4 bandwidths in each direction, with a ridge of 1e-6, and
    only those are kept whose size is above 1/N.  Neighbours meet by cells of 4 bandwidths or more: a task holds a cell
    and those around it.
    """
    first = coords.select(F.size("xyz")).first()
    dim, n = first[0] if first else 0, coords.count()
    ends = coords.select(*[f(F.get("xyz", k)).cast("double") for f in (F.min, F.max) for k in range(dim)]).first() if n else ()
    least = [(b - a) / max(1.0, n / CELL_VOXELS) ** (1 / dim) for a, b in zip(ends[:dim], ends[dim:])]  # no cell is smaller: a task's group has its price
    wide = [np.broadcast_to(np.asarray(b, float), (dim,)).tolist() for b in bws]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("bw"), F.array(*[F.lit(max(4.0 * v, side)) for v, side in zip(b, least)]).alias("side")) for k, b in enumerate(wide)]))
    placed = coords.select(F.col("voxel").cast("int").alias("voxel"), F.col("xyz").cast("array<double>").alias("xyz"), each.alias("_b")).select("voxel", "xyz", "_b.bw", F.zip_with("xyz", "_b.side", lambda x, s: F.floor(x / s)).alias("cell"))
    around = np.stack(np.meshgrid(*[[-1, 0, 1]] * dim, indexing="ij"), axis=-1).reshape(-1, dim).tolist() if dim else []
    near = placed.select(F.col("voxel").alias("near"), F.col("xyz").alias("there"), F.col("bw").alias("bw_j"), F.explode(F.array(*[F.zip_with("cell", F.array(*[F.lit(v) for v in o]), lambda x, y: x + y) for o in around])).alias("cell_j"))

    def weigh(key: tuple, own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"bw": np.zeros(0, np.int32), "voxel": np.zeros(0, np.int32), "near": np.zeros(0, np.int32), "w": np.zeros(0)})
        if not len(own):
            return none
        bw = np.array(wide[key[0]])
        density = float(np.prod(1 / (np.sqrt(2 * np.pi) * bw)))
        at, there = np.stack(own["xyz"].to_numpy()), np.stack(others["there"].to_numpy())
        names, out = others["near"].to_numpy(), []
        step = max(1, PAIRS // len(there))
        for lo in range(0, len(at), step):
            away = there[None] - at[lo : lo + step, None]  # voxels x candidates x directions
            u = away / bw
            k = np.where((np.abs(u) < 4).all(axis=2), density * np.exp(-0.5 * (u * u).sum(axis=2)), 0)
            x = np.concatenate([np.ones((*away.shape[:2], 1)), away], axis=2)
            kx = k[:, :, None] * x
            left = np.linalg.solve(np.einsum("vci,vcj->vij", kx, x) + 1e-6 * np.eye(dim + 1), np.broadcast_to(np.eye(dim + 1)[:, :1], (len(away), dim + 1, 1)))
            w = (kx @ left)[:, :, 0]
            i, j = np.nonzero(np.abs(w) > 1 / n)
            out.append(pd.DataFrame({"bw": np.int32(key[0]), "voxel": own["voxel"].to_numpy()[lo + i], "near": names[j], "w": w[i, j]}))
        return pd.concat(out)

    return placed.groupBy("bw", "cell").cogroup(near.groupBy("bw_j", "cell_j")).applyInPandas(weigh, "bw int, voxel int, near int, w double")


def sparse_bandwidths(table: DataFrame, n: int, of: int) -> list[int]:
    """Places of the bandwidths, `of` in number, that leave at most N // 10 weights to a voxel on average."""
    counts = {r["bw"]: r["count"] for r in table.groupBy("bw").count().collect()}  # a row a bandwidth
    return [k for k in range(of) if counts.get(k, 0) / n <= n // 10]


class _Held:
    """Weights of a range of voxels on all executors: for each bandwidth where each voxel's begin, the neighbours, the weights."""

    def __init__(self, table: DataFrame, low: int, high: int):
        rows = table.where((F.col("voxel") >= low) & (F.col("voxel") < high)).toArrow().to_pandas().sort_values(["bw", "voxel", "near"])  # within WEIGHT_BYTES
        self.low, self.high, self.by = low, high, {}
        for k, own in rows.groupby("bw"):
            voxel = own["voxel"].to_numpy()
            first = np.flatnonzero(np.r_[True, voxel[1:] != voxel[:-1]])
            self.by[int(k)] = (first, voxel[first], own["near"].to_numpy(), own["w"].to_numpy())

    def smoothed(self, bw: int, y: np.ndarray) -> np.ndarray:
        """images x the range's voxels."""
        out = np.zeros((len(y), self.high - self.low))
        if bw in self.by:
            first, voxel, near, w = self.by[bw]
            step = max(1, PRODUCTS // max(1, len(w)))
            for k in range(0, len(y), step):
                out[k : k + step, voxel - self.low] = np.add.reduceat(y[k : k + step, near] * w, first, axis=1)
        return out


def _ranges(table: DataFrame, n: int) -> list[tuple[int, int]]:
    """Ranges of voxels whose weights are held together."""
    step = max(1, n // max(1, -(-16 * table.count() // WEIGHT_BYTES)))
    return [(k, min(k + step, n)) for k in range(0, n, step)]


def smooth(images: DataFrame, table: DataFrame, n: int, bw: int = 0) -> DataFrame:
    """(iid, voxels) with each of the n voxels as the weighted sum of its neighbours, by the weights of one bandwidth of a smoothing_table."""
    own, kind = table.where(F.col("bw") == bw), images.schema["iid"].dataType.simpleString()
    rows, out, ranges = images.select("iid", "voxels"), None, _ranges(own, n)
    for low, high in ranges:
        sent = images.sparkSession.sparkContext.broadcast(_Held(own, low, high))

        def run(batches, sent=sent, low=low):
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"iid": pdf["iid"], "low": np.int32(low), "voxels": list(sent.value.smoothed(bw, np.stack(pdf["voxels"].to_numpy()).astype(float)))})

        part = rows.mapInPandas(run, f"iid {kind}, low int, voxels array<double>")
        out = part if out is None else out.unionAll(part)
    if len(ranges) == 1:
        return out.drop("low")
    return out.groupBy("iid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "voxels"))), lambda x: x["voxels"])).alias("voxels"))


def choose_bandwidth(images: DataFrame, coords: DataFrame) -> tuple[float, list[tuple[float, float]]]:
    """The candidate with the smallest generalised cross-validation score (O-164), and all scores; coords: (voxel, xyz array).

    All candidates are scored in one pass over the images, or one for each range of voxels whose weights are held together."""
    spark, n = images.sparkSession, coords.count()
    candidates = bandwidths(n, coords.select(F.size("xyz")).first()[0])
    path = scratch(spark, "weights")
    smoothing_table(coords, candidates).write.parquet(path)
    table = spark.read.parquet(path)
    usable = sparse_bandwidths(table, n, len(candidates))
    if not usable:
        raise ValueError("no bandwidth gives sparse weights")
    table = table.where(F.col("bw").isin(usable))
    traces = {r["bw"]: r["t"] for r in table.where("voxel = near").groupBy("bw").agg(F.sum("w").alias("t")).collect()}
    errors = dict.fromkeys(usable, 0.0)
    for low, high in _ranges(table, n):
        sent = spark.sparkContext.broadcast(_Held(table, low, high))

        def run(batches, sent=sent, low=low, high=high):
            total = dict.fromkeys(usable, 0.0)
            for pdf in batches:
                if len(pdf):
                    y = np.stack(pdf["voxels"].to_numpy()).astype(float)
                    for k in usable:
                        total[k] += float(((y[:, low:high] - sent.value.smoothed(k, y)) ** 2).sum())
            yield pd.DataFrame({"bw": np.array(list(total), np.int32), "error": list(total.values())})

        for r in images.select("voxels").mapInPandas(run, "bw int, error double").groupBy("bw").agg(F.sum("error").alias("error")).collect():
            errors[r["bw"]] += r["error"]
        sent.destroy()
    count = images.count()
    scores = [(candidates[k], errors[k] / count / (1 - traces.get(k, 0.0) / n + 1e-10) ** 2) for k in usable]
    return min(scores, key=lambda s: (s[1], s[0]))[0], scores
