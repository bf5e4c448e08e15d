"""Bootstrap and permutation nulls, cluster sizes, and threshold-free cluster enhancement.

The randomness of a replicate depends on its number and the subject's place only, so a task that is
run again gives the same rows, and the plan is the same for any number of replicates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .linear import matrix_of, residuals
from .permutations import Side, normals, shuffled
from .rare import CalledSets, by_called_set, set_tests, test_set, weighted_sums


def wild_bootstrap(resid: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """sample_id, iid, resid: each subject's residuals times a standard normal of its own (O-190)."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf["resid"].to_numpy())
                for k, w in enumerate(normals(pdf["place"].to_numpy(), np.arange(samples), seed)):
                    yield pd.DataFrame({"sample_id": np.int32(k), "iid": pdf["iid"], "resid": list(y * w[:, None])})

    return Side(resid, ["resid"], 0).placed.mapInPandas(run, f"sample_id int, iid {resid.schema['iid'].dataType.simpleString()}, resid array<double>")


def _replicate_sums(side: Side, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """X'X, and for each replicate X'Y* and Y*'Y* of the residuals times their normals; n: numbers of the size of covariates and components for each."""
    p, r = side.sizes["x"], side.sizes["resid"]

    def run(batches):
        xx, xy, yy = np.zeros((p, p)), np.zeros((samples, p, r)), np.zeros((samples, r, r))
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                x, y = (np.stack(part[c].to_numpy()) for c in ("x", "resid"))
                xx += x.T @ x
                for k, w in enumerate(normals(part["place"].to_numpy(), np.arange(samples), seed)):
                    own = y * w[:, None]
                    xy[k] += x.T @ own
                    yy[k] += own.T @ own
        yield pd.DataFrame({"k": np.arange(-1, samples), "sums": [xx.ravel(), *(np.concatenate([a.ravel(), b.ravel()]) for a, b in zip(xy, yy))]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)]})

    got = {row["k"]: np.array(row["sums"]) for row in side.placed.mapInPandas(run, "k int, sums array<double>").groupBy("k").applyInPandas(add, "k int, sums array<double>").collect()}
    rest = np.array([got[k] for k in range(samples)]).reshape(samples, -1)
    return got[-1].reshape(p, p), rest[:, : p * r].reshape(-1, p, r), rest[:, p * r :].reshape(-1, r, r)


def bootstrap_clusters(geno: DataFrame, subjects: DataFrame, bases: DataFrame, samples: int, max_p: float = 2.5e-6, seed: int = 1, at_once: int = 25, shards: int | None = None, most_side: int | None = None) -> DataFrame:
    """sample_id, variant, size: for each variant and wild-bootstrap replicate the number of voxels that are significant (O-190).

    The chain of one replicate: residuals times a normal for each subject, association with all variants,
    voxel effects from component effects, voxels with p <= max_p counted, 0 included.  All replicates are
    made in one pass over the calls, which are dealt and sorted by variant: a task takes a batch of calls at a
    time, looks the residuals of its carriers up in the null model it holds and makes the normals, `at_once`
    replicates at a time, so that its memory does not grow with the calls.  A null model too large to be held is
    joined to the calls before that.
    """
    side = Side(residuals(subjects), ["x", "resid"], most_side)
    n, p, r = side.n, side.sizes["x"], side.sizes["resid"]
    xx, xy, yy = _replicate_sums(side, samples, seed)
    inverse, b, limit, df = np.linalg.inv(xx), matrix_of(bases), float(stats.chi2_isf(max_p)), n - p - 1
    kind = geno.schema["variant"].dataType.simpleString()
    schema = f"sample_id int, variant {kind}, size long"

    def products(at, x, y, dosage, code, m, replicates) -> np.ndarray:
        """variants x sums: count, square and missing calls, x of calls and of missing ones, and y* of both for each replicate."""
        missing = np.isnan(dosage)
        d, order = np.where(missing, 0, dosage), np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(m))
        w = normals(at, replicates, seed)
        star = np.einsum("kc,cj->ckj", w, y).reshape(len(at), -1)
        parts = [d[:, None], (d * d)[:, None], missing[:, None], d[:, None] * x, missing[:, None] * x, d[:, None] * star, missing[:, None] * star]
        return np.hstack([np.add.reduceat(v[order].astype(float), first, axis=0) for v in parts])

    def sizes(sums: np.ndarray, replicates: np.ndarray) -> np.ndarray:
        """replicates x variants."""
        own = len(replicates) * r
        ac, gg, missing, gx, mx, gy, my = np.split(sums, np.cumsum([1, 1, 1, p, p, own]), axis=1)
        have = n - missing
        mean = np.divide(ac, have, out=np.zeros_like(ac), where=have > 0)
        gg, gx, gy = gg + mean * mean * missing, gx + mean * mx, (gy + mean * my).reshape(len(sums), -1, r)
        left = gg[:, 0] - np.einsum("ij,jk,ik->i", gx, inverse, gx)
        left[(left <= 1e-10 * np.maximum(gg[:, 0], 1e-300)) | (df <= 0)] = np.nan
        out = np.zeros((len(replicates), len(sums)), np.int64)
        for i, k in enumerate(replicates):
            sigma = (yy[k] - xy[k].T @ inverse @ xy[k]) / n
            beta = (gy[:, i] - gx @ inverse @ xy[k]) / left[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                se = np.sqrt(np.maximum(np.diag(sigma) * n - beta**2 * left[:, None], 0) / max(df, 1) / left[:, None])
                scale = ((se**2 + beta**2 / have) / np.diag(sigma)).mean(axis=1)
                bv = beta @ b.T
                z2 = bv**2 / (scale[:, None] * np.einsum("vi,ij,vj->v", b, sigma, b) - bv**2 / have)
                out[i] = (z2 >= limit).sum(axis=1)
        return out

    def frame(names, found: np.ndarray, replicates: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": np.repeat(replicates.astype(np.int32), len(names)), "variant": np.tile(names, len(replicates)), "size": found.ravel()})

    batches = [np.arange(k, min(k + at_once, samples)) for k in range(0, samples, at_once)]
    shards, held = shards or geno.sparkSession.sparkContext.defaultParallelism * 3, side.held
    calls = geno.select("variant", "iid", "dosage")

    def run(parts):
        """Calls in the order of variants; the last variant of a batch waits for the next batch, with its sums only."""
        name, waiting = None, None
        for pdf in parts:
            if held is not None:
                iids, sides = held.value
                at = iids.get_indexer(pdf["iid"])
                pdf, at = pdf[at >= 0], at[at >= 0]
                x, y = sides["x"][at], sides["resid"][at]
            elif len(pdf):
                at, x, y = pdf["place"].to_numpy(), np.stack(pdf["x"].to_numpy()), np.stack(pdf["resid"].to_numpy())
            if not len(pdf):
                continue
            code, names = pd.factorize(pdf["variant"])
            sums = [products(at, x, y, pdf["dosage"].to_numpy(float), code, len(names), k) for k in batches]
            if waiting is not None:
                if names[0] == name:
                    for own, more in zip(sums, waiting):
                        own[0] += more
                else:
                    yield from (frame([name], sizes(own[None], k), k) for own, k in zip(waiting, batches))
            if len(names) > 1:
                yield from (frame(names[:-1], sizes(own[:-1], k), k) for own, k in zip(sums, batches))
            name, waiting = names[-1], [own[-1].copy() for own in sums]
        if waiting is not None:
            yield from (frame([name], sizes(own[None], k), k) for own, k in zip(waiting, batches))

    if held is None:
        calls = calls.join(side.placed, "iid")
    return calls.repartition(shards, "variant").sortWithinPartitions("variant").mapInPandas(run, schema)


def permuted_clusters(members: DataFrame, calls: DataFrame, null: DataFrame, bases: np.ndarray, variance: np.ndarray, samples: int, max_p: float = 2.5e-6, seed: int = 1, most_side: int | None = None, side: Side | None = None) -> DataFrame:
    """sample_id, set_name, mask, size: for each set and permutation of the residual rows the number of voxels whose
    omnibus (burden where there is none) is significant (O-191).

    members: (set_name, mask, variant, maf, mac, proj, annot); calls: (variant, iid, dosage), or with `side`, the null
    model's without an index, a row a variant whose iids are places (rare.variant_rows); null: (iid, resid).
    A set's covariance is made once; its task looks up which residuals its carriers get in each replicate.
    Where the null model is too large to be held, scores of all replicates come from one join, and a set is
    tested for each replicate under a name of its own.
    """
    tests, schema = ("burden", "skat", "staar"), "sample_id int, set_name string, mask string, size long"
    if side is None:
        side = Side(null, ["resid"], most_side, index=False)
        if side.held is not None:
            who = F.coalesce("place", -1 - F.pmod(F.xxhash64("iid"), F.lit(1 << 62)))
            calls = calls.join(side.placed.select("iid", "place"), "iid", "left").select("variant", who.alias("iid"), "dosage")
    elif side.held is None:
        each = calls.select("variant", F.explode(F.arrays_zip("iids", "dosages")).alias("_c"))
        calls = each.join(side.placed.select("iid", "place"), F.col("_c.iids") == F.col("place")).select("variant", "iid", F.col("_c.dosages").alias("dosage"))
    if side.held is None:
        drawn = permuted_rows(null.select("iid", "resid"), samples, seed)
        placed = calls.join(drawn, "iid").withColumn("_key", F.struct("variant", "sample_id"))
        scored = weighted_sums(placed.select("_key", "dosage", "resid"), "_key", "dosage", "resid", side.sizes["resid"]).select("_key.variant", "_key.sample_id", F.col("sums").alias("score"))
        wide = members.join(scored, "variant").withColumn("set_name", F.to_json(F.struct("sample_id", F.col("set_name").alias("s"))))
        tested = set_tests(wide, None, bases, variance, max_p=1.0, calls=calls)
        of = F.from_json("set_name", "sample_id int, s string")
        hit = F.coalesce(F.col("staar_o"), F.col("burden_p")) <= max_p
        return tested.groupBy(of.alias("_of"), "mask").agg(F.count_if(hit).alias("size")).select("_of.sample_id", F.col("_of.s").alias("set_name"), "mask", "size")
    held, n, rank = side.held, side.n, side.sizes["resid"]

    def run(sets: CalledSets) -> pd.DataFrame:
        resid, out = held.value[1]["resid"], []
        every, mafs, macs, annots = sets.matrix("proj"), sets.column("maf").astype(float), sets.column("mac"), sets._table["annot"]
        for i, (key, a, b) in enumerate(zip(sets.keys, sets.cuts.tolist(), sets.cuts[1:].tolist())):
            cmac, m = int(macs[a:b].sum()), b - a
            if m < 2 or cmac < 2:
                continue
            cov, annot = sets.products(i) - every[a:b] @ every[a:b].T, annots.slice(a, m).to_pylist()
            annot = np.array(annot, float) if all(v is not None for v in annot) else None
            code, at, dosage = (v[sets.calls(i)[1] >= 0] for v in sets.calls(i))
            places, back = np.unique(at, return_inverse=True)
            found, first = [], np.searchsorted(code, np.arange(m))
            empty = np.diff(np.r_[first, len(code)]) == 0
            step = max(1, 4_000_000 // max(1, m * len(variance), rank * len(code)))
            for k in range(0, samples, step):  # replicates are further voxels
                replicates = np.arange(k, min(k + step, samples))
                rows = resid[shuffled(places, n, replicates, seed)][:, back] * dosage[:, None]
                score = np.zeros((len(replicates), m, rank))
                if (~empty).any():
                    score[:, ~empty] = np.add.reduceat(rows, first[~empty], axis=1)
                moved = np.moveaxis(score @ bases.T, 1, 0).reshape(m, -1)
                got, _ = test_set(moved, cov, mafs[a:b], cmac, annot, None, np.tile(variance, len(replicates)), tests)
                p = np.where(np.isnan(got["staar_o"]), got["burden_p"], got["staar_o"]).reshape(len(replicates), -1)
                found += (p <= max_p).sum(axis=1).tolist()
            out.append(pd.DataFrame({"sample_id": np.arange(samples, dtype=np.int32), "set_name": key[0], "mask": key[1], "size": np.array(found, np.int64)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame()

    return by_called_set(members.select("set_name", "mask", "variant", "maf", "mac", "proj", "annot"), calls, run, schema)


def cluster_sizes(significant: DataFrame, variants: DataFrame, samples: int) -> DataFrame:
    """sample_id, snp, size: significant voxels of each variant in each replicate, 0 included (O-112)."""
    every = variants.select("snp").withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    found = significant.groupBy("sample_id", "snp").agg(F.count("*").alias("n"))
    return every.join(found, ["sample_id", "snp"], "left").select("sample_id", "snp", F.coalesce("n", F.lit(0)).alias("size"))


def merge_permutations(frames: list[DataFrame], keep: float = 2.5e-6) -> DataFrame:
    """bin, voxel, stats (ascending, the int(keep * count) largest), count of several nulls (O-133S, O-194).

    Counts add up by bin.  The rows of a bin and voxel are numbered from the largest on and cut before they
    become an array, so no array is longer than what is kept."""
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f)
    counts = stacked.where("voxel = 0").groupBy(F.col("bin").alias("_bin")).agg(F.sum("stat").cast("long").alias("count"))
    most = F.greatest(F.lit(1), F.floor(F.col("count") * keep).cast("int"))
    place = F.row_number().over(Window.partitionBy("bin", "voxel").orderBy(F.desc("stat")))
    kept = stacked.where("voxel > 0").withColumn("_k", place).join(F.broadcast(counts), F.col("bin") == F.col("_bin")).where(F.col("_k") <= most)  # a row a bin
    return kept.groupBy("bin", "voxel", "count").agg(F.array_sort(F.collect_list("stat")).alias("stats")).select("bin", "voxel", "stats", "count")


def permuted_rows(resid: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """sample_id, iid, resid: the residual rows of all subjects dealt to them in a new order (O-191); where a subject's come
    from follows from its place, so no task takes all subjects of a replicate."""
    side = Side(resid.select("iid", "resid"), ["resid"], 0)
    n, kind = side.n, resid.schema["iid"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for k in range(samples) if len(pdf) else ():
                yield pd.DataFrame({"sample_id": np.int32(k), "iid": pdf["iid"], "place": shuffled(pdf["place"].to_numpy(), n, np.array([k]), seed)[0]})

    sent = side.placed.select("iid", "place").mapInPandas(run, f"sample_id int, iid {kind}, place long")
    return sent.join(side.placed.select("place", "resid"), "place").select("sample_id", "iid", "resid")


def grid_neighbours(coords: np.ndarray) -> np.ndarray:
    """For each voxel those that share a face with it (voxels x directions), -1 where there is none."""
    place = {tuple(c): i for i, c in enumerate(coords.tolist())}
    steps = np.vstack([np.eye(coords.shape[1], dtype=int), -np.eye(coords.shape[1], dtype=int)])
    return np.array([[place.get(tuple(c), -1) for c in (coords + s).tolist()] for s in steps]).T.reshape(len(coords), len(steps))


class _Forest:
    """Components that grow as voxels are added, with a value for each voxel that grows with its component."""

    def __init__(self, n: int):
        self.parent, self.size, self.value = list(range(n)), [1] * n, [0.0] * n

    def root(self, x: int) -> int:
        """The root of x; values on the way are kept relative to the parent's."""
        path = []
        while self.parent[x] != x:
            path.append(x)
            x = self.parent[x]
        for y in reversed(path[:-1]):
            self.value[y] += self.value[self.parent[y]]
            self.parent[y] = x
        return x

    def join(self, a: int, b: int) -> None:
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]
        self.value[b] -= self.value[a]

    def total(self, x: int) -> float:
        r = self.root(x)
        return self.value[r] if r == x else self.value[x] + self.value[r]


def grid_components(neighbours: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Labels of the voxels `up` (indices) connected by faces, from 0 in the order of their first voxel."""
    forest, held = _Forest(len(neighbours)), np.zeros(len(neighbours), bool)
    held[up] = True
    for v in up.tolist():
        for u in neighbours[v].tolist():
            if u >= 0 and held[u]:
                a, b = forest.root(v), forest.root(u)
                if a != b:
                    forest.join(a, b)
    _, first, label = np.unique([forest.root(v) for v in up.tolist()], return_index=True, return_inverse=True) if len(up) else ([], np.zeros(0, int), np.zeros(0, int))
    return np.argsort(np.argsort(first))[label] if len(up) else np.zeros(0, int)


def tfce_scores(neighbours: np.ndarray, at: np.ndarray, logp: np.ndarray, h: float = 2, e: float = 0.5, dh: float = 0.1, floor: float = 0.001) -> np.ndarray:
    """Sum over thresholds of extent^e * height^h * dh of the component a voxel is in (O-171), for the voxels `at`.

    Voxels enter from the highest on.  A component is charged for the thresholds at which it had its
    extent when it changes, so each pair of neighbours is looked at once, whatever the thresholds."""
    if not len(logp):
        return np.zeros(0)
    levels = np.arange(max(float(logp.min()), floor), float(logp.max()), dh)
    height = np.searchsorted(levels, logp, "right")  # thresholds below or at the voxel's value
    worth = np.concatenate([[0.0], np.cumsum(levels**h * dh)])
    forest, since = _Forest(len(neighbours)), [0] * len(neighbours)
    held = np.zeros(len(neighbours), bool).tolist()

    def charge(r: int, level: int) -> None:
        if since[r] > level:
            forest.value[r] += forest.size[r] ** e * (worth[since[r]] - worth[level])
            since[r] = level

    order = np.argsort(-height, kind="stable")
    for v, level in zip(at[order].tolist(), height[order].tolist()):
        held[v], since[v] = True, level
        for u in neighbours[v].tolist():
            if u >= 0 and held[u]:
                a, b = forest.root(v), forest.root(u)
                if a != b:
                    charge(a, level)
                    charge(b, level)
                    forest.join(a, b)
                    since[forest.root(a)] = level
    for r in {forest.root(v) for v in at.tolist()}:
        charge(r, 0)
    return np.array([forest.total(v) for v in at.tolist()])


def tfce(results: DataFrame, coords: DataFrame, keys: list[str], sig: float = 2.5e-6, thresh: float = 0.0) -> DataFrame:
    """Summary of each set's map (O-171): most_sig_p, max_tfce, n_sig_voxels, n_clusters, voxels_in_each_cluster.

    results: keys, index (one-based voxel), p; coords: voxel (zero-based) and xyz array, one image grid.
    A set's map is one row of two arrays of at most the image's size.
    """
    grid = coords.toPandas().sort_values("voxel")
    sent = results.sparkSession.sparkContext.broadcast(grid_neighbours(np.stack(grid["xyz"].to_numpy()).astype(int)))
    kinds = ", ".join(f"`{k}` {results.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, most_sig_p double, max_tfce double, n_sig_voxels int, n_clusters int, voxels_in_each_cluster string"
    tested = F.col("p").isNotNull() & ~F.isnan("p")
    maps = results.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(tested, F.struct((F.col("index") - 1).alias("v"), "p")))).alias("_m"))

    def run(batches):
        neighbours = sent.value
        for pdf in batches:
            out = []
            for at, value in zip(pdf["_v"], pdf["_p"]):
                at, value = np.asarray(at, int), np.asarray(value, float)
                score = tfce_scores(neighbours, at, -np.log10(np.maximum(value, 1e-300)))
                hit = value < sig
                if thresh > 0:
                    hit = hit & (score >= thresh)
                sizes = np.bincount(grid_components(neighbours, at[hit])) if hit.any() else np.zeros(0, int)
                out.append((value.min() if len(value) else np.nan, score.max() if len(score) else 0.0, int(hit.sum()), len(sizes), ",".join(map(str, sizes))))
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(out, columns=["most_sig_p", "max_tfce", "n_sig_voxels", "n_clusters", "voxels_in_each_cluster"])], axis=1)

    return maps.select(*keys, F.col("_m.v").alias("_v"), F.col("_m.p").alias("_p")).mapInPandas(run, schema)
