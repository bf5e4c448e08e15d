"""Rare-variant summaries and set tests.

geno is sparse (variant, iid, dosage > 0), the null model is (iid, x, resid) rows.  The summaries
are sparse joins and sums: scores Z'resid, projections Z'X (X'X)^-1/2, and the banded Z'Z from the
pairs of variants that one subject carries.  A set's test runs in one group of its own variants.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import stats
from .ld import called_rows
from .linear import cross_products, sums_by_key, times
from .variants import CMAC_BINS


def weighted_sums(rows: DataFrame, key: str, weight: str, value: str, size: int) -> DataFrame:
    """key, sums: sum over rows of weight * array of `size` elements, by key (O-176)."""
    return sums_by_key(rows.withColumn(weight, F.col(weight).cast("double")), key, [(weight, value, size)])


#: Rows that a task gathers before it hands their sets on; a set with more is one batch by itself.
GATHERED = 50_000


def by_set(members: DataFrame, joined: DataFrame, run, schema: str) -> DataFrame:
    """run(key, members of the set, rows of `joined` of the set) for each (set_name, mask) of members.

    As members.groupBy("set_name", "mask").cogroup(joined.groupBy("set_j", "mask_j")).applyInPandas(run, schema), but
    the rows of many sets are handed to Python together, as a set has few rows and a group costs more than its test."""
    sides = (members, joined.withColumnsRenamed({"set_j": "set_name", "mask_j": "mask"}))
    names = [[c for c in side.columns if c not in ("set_name", "mask")] for side in sides]

    def tagged(at: int) -> DataFrame:
        columns = []
        for k, side in enumerate(sides):
            for i, c in enumerate(names[k]):
                kind = side.schema[c].dataType  # zeros, not nulls, in the other side's rows keep whole numbers whole
                blank = F.lit(None) if kind.typeName() in ("array", "struct", "map") else F.lit("0")
                columns.append((F.col(c) if k == at else blank.cast(kind)).alias(f"_{k}_{i}"))
        return sides[at].select("set_name", "mask", F.lit(at).alias("_side"), *columns)

    def finished(pdf: pd.DataFrame) -> pd.DataFrame | None:
        parts = []
        for k in (0, 1):
            own = pdf[pdf["_side"].to_numpy() == k].reset_index(drop=True)
            name, mask = own["set_name"].to_numpy(object), own["mask"].to_numpy(object)
            first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (mask[1:] != mask[:-1])]).tolist() if len(own) else []
            rows = own[[f"_{k}_{i}" for i in range(len(names[k]))]].set_axis(names[k], axis=1)
            rows.insert(0, "mask" if k == 0 else "mask_j", own["mask"])
            rows.insert(0, "set_name" if k == 0 else "set_j", own["set_name"])
            parts.append((rows, {(name[a], mask[a]): (a, b) for a, b in zip(first, [*first[1:], len(own)])}))
        (left, lefts), (right, rights) = parts
        out = []
        for key, (a, b) in lefts.items():
            lo, hi = rights.get(key, (0, 0))
            got = run(key, left.iloc[a:b].reset_index(drop=True), right.iloc[lo:hi].reset_index(drop=True))
            if len(got):
                out.append(got)
        return pd.concat(out, ignore_index=True) if out else None

    def gather(batches):
        held, first, rows = [], None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            last = (pdf["set_name"].iloc[-1], pdf["mask"].iloc[-1])
            first = first or (pdf["set_name"].iloc[0], pdf["mask"].iloc[0])
            held.append(pdf)
            rows += len(pdf)
            if rows >= GATHERED and first != last:
                whole = pd.concat(held, ignore_index=True)
                cut = int(((whole["set_name"].to_numpy(object) == last[0]) & (whole["mask"].to_numpy(object) == last[1])).argmax())
                got = finished(whole.iloc[:cut])
                held, first, rows = [whole.iloc[cut:]], last, len(whole) - cut
                if got is not None:
                    yield got
        if held:
            got = finished(pd.concat(held, ignore_index=True))
            if got is not None:
                yield got

    both = tagged(0).unionByName(tagged(1))
    return both.repartition("set_name", "mask").sortWithinPartitions("set_name", "mask", "_side").mapInPandas(gather, schema)


#: Calls that a task gathers before it hands their sets on, and cells of products or weights of sets that are tested together.
GATHERED_CALLS, SET_CELLS = 1_000_000, 2_000_000


class CalledSets:
    """Members of sets that a task tests together, rows in the order of sets and variants: keys (set_name, mask), first row
    of each set and the end (cuts), columns by name, and of all calls the row of the member, iid and dosage."""

    def __init__(self, table: pa.Table, cuts: np.ndarray):
        table = table.combine_chunks()
        self.cuts, self._table = cuts, table
        self.keys = list(zip(*(table[c].take(pa.array(cuts[:-1])).to_pylist() for c in ("set_name", "mask"))))
        lists = table["iids"].combine_chunks()
        length = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
        self.row = np.repeat(np.arange(len(table)), length)
        self.iid = lists.flatten().to_numpy(zero_copy_only=False)
        self.dosage = table["dosages"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        self.first_call = np.r_[0, np.cumsum(length)][cuts]
        # subjects of each set numbered from 0, for all sets at once
        code, names = pd.factorize(self.iid)
        of = np.repeat(np.arange(len(cuts) - 1), np.diff(self.first_call)) * max(1, len(names)) + code
        order = np.argsort(of, kind="stable")
        place = np.cumsum(np.r_[False, of[order][1:] != of[order][:-1]]) if len(of) else np.zeros(0, int)
        at = np.r_[place, place[-1:] + 1][np.minimum(self.first_call, len(place))] if len(place) else np.zeros(len(cuts), int)
        self.many, self.subject = np.diff(at), np.empty(len(of), int)
        self.subject[order] = place
        self.subject -= np.repeat(at[:-1], np.diff(self.first_call))

    def column(self, name: str) -> np.ndarray:
        return self._table[name].to_numpy()

    def matrix(self, name: str) -> np.ndarray | None:
        """A column of arrays, rows x elements; None if one is null."""
        lists = self._table[name].combine_chunks()
        return None if lists.null_count else lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)

    def calls(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of set k: row within the set, iid and dosage of each call."""
        own = slice(self.first_call[k], self.first_call[k + 1])
        return self.row[own] - self.cuts[k], self.iid[own], self.dosage[own]

    def products(self, k: int, subjects: int = 4096) -> np.ndarray:
        """Z'Z of set k, by blocks of the subjects that carry any of it."""
        column, _, dosage = self.calls(k)
        m, row = int(self.cuts[k + 1] - self.cuts[k]), self.subject[self.first_call[k] : self.first_call[k + 1]]
        many, out = int(self.many[k]), np.zeros((m, m))
        for lo in range(0, many, subjects):
            own = slice(None) if many <= subjects else (row >= lo) & (row < lo + subjects)
            z = np.zeros((min(subjects, many - lo), m))
            z[row[own] - lo, column[own]] = dosage[own]
            out += z.T @ z
        return out


def by_called_set(members: DataFrame, calls: DataFrame, run, schema: str) -> DataFrame:
    """run(CalledSets) for all sets (set_name, mask) of members, many together, as pandas or Arrow tables.

    calls: (variant, iid, dosage), or a row a variant (variant, iids, dosages); not read if members have these arrays.  A member travels with the calls of its variant
    as arrays, once for each set, so that no row is made for a call; a task holds the sets of about GATHERED_CALLS calls."""

    def finished(table: pa.Table, cuts: np.ndarray):
        got = run(CalledSets(table, cuts))
        yield from (got if isinstance(got, pa.Table) else pa.Table.from_pandas(got, preserve_index=False)).to_batches() if len(got) else ()

    def ends(table: pa.Table) -> np.ndarray:
        """First rows of the sets."""
        codes = [table[c].combine_chunks().dictionary_encode() for c in ("set_name", "mask")]
        codes = [np.nan_to_num(c.indices.to_numpy(zero_copy_only=False), nan=-1) for c in codes]
        return np.flatnonzero(np.r_[True, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])])

    def gather(batches):
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch) + len(batch.column("iids").flatten())
            if size >= GATHERED_CALLS:
                table = pa.Table.from_batches(held)
                first = ends(table)
                if len(first) > 1:  # the last set may go on
                    yield from finished(table.slice(0, int(first[-1])), first)
                    table = table.slice(int(first[-1]))
                held = table.to_batches()
                size = len(table) + sum(len(b.column("iids").flatten()) for b in held)
        if held:
            table = pa.Table.from_batches(held)
            yield from finished(table, np.r_[ends(table), len(table)])

    met = members
    if "iids" not in members.columns:
        rows = calls if "iids" in calls.columns else called_rows(calls.select("variant", "iid", "dosage"), "variant")
        met = members.join(rows.select(F.col("variant").alias("_of"), "iids", "dosages"), F.col("variant") == F.col("_of"), "left").drop("_of")
    return met.repartition("set_name", "mask").sortWithinPartitions("set_name", "mask", "variant").mapInArrow(gather, schema)


def _size(null: DataFrame, column: str) -> int:
    """Elements of the column's arrays, from one row."""
    first = null.select(F.size(column)).first()
    return first[0] if first else 0


def scores(geno: DataFrame, null: DataFrame) -> DataFrame:
    """variant, score array: Z'resid (O-176)."""
    return weighted_sums(geno.join(null.select("iid", "resid"), "iid"), "variant", "dosage", "resid", _size(null, "resid")).withColumnRenamed("sums", "score")


def half_projection(xx: np.ndarray) -> np.ndarray:
    """(X'X)^-1/2, so that with P = Z'X (X'X)^-1/2 the set covariance is ZZ' - PP'."""
    values, vectors = np.linalg.eigh(xx)
    return vectors @ np.diag(values**-0.5) @ vectors.T


def projections(geno: DataFrame, null: DataFrame, xx: np.ndarray) -> DataFrame:
    """variant, proj array (O-177)."""
    moved = null.select("iid", times(half_projection(xx), F.col("x")).alias("u"))
    return weighted_sums(geno.join(moved, "iid"), "variant", "dosage", "u", len(xx)).withColumnRenamed("sums", "proj")


def variant_rows(geno: DataFrame, null: DataFrame, xx: np.ndarray, n: int) -> DataFrame:
    """variant, maf, mac, score, proj, iids, dosages: all that set tests take of a variant, a row each, from one join of the
    calls with the null model and one grouping.  A variant whose carriers have no null model is left out.

    If the null model has a column place (permutations.Side), iids are places, and negative where there is none."""
    r, p, placed = _size(null, "resid"), len(xx), "place" in null.columns
    moved = null.select("iid", *["place"] * placed, "resid", times(half_projection(xx), F.col("x")).alias("_u"))
    d = F.col("dosage").cast("double")
    sums = {f"_s{k}": d * F.get("resid", k) for k in range(r)} | {f"_p{k}": d * F.get("_u", k) for k in range(p)}
    met = geno.join(moved, "iid", "left")
    who = F.coalesce("place", -1 - F.pmod(F.xxhash64("iid"), F.lit(1 << 62))) if placed else F.col("iid")
    met = met.select("variant", who.alias("iid"), "dosage", *[v.alias(c) for c, v in sums.items()])
    missing = F.count_if(F.col("dosage").isNull())
    call = F.struct("iid", F.coalesce(d, F.lit(float("nan"))).alias("dosage"))
    got = met.groupBy("variant").agg((F.lit(n) - missing).cast("long").alias("_n"), F.coalesce(F.sum("dosage"), F.lit(0)).cast("long").alias("_ac"), *[F.sum(c).alias(c) for c in sums], F.collect_list(call).alias("_calls"))
    af = F.try_divide(F.col("_ac"), 2 * F.col("_n"))
    arrays = [F.array(*[F.col(f"{c}{k}") for k in range(size)]).alias(name) for c, size, name in (("_s", r, "score"), ("_p", p, "proj"))]
    return got.where("_s0 is not null").select("variant", F.least(af, 1 - af).alias("maf"), F.least("_ac", 2 * F.col("_n") - F.col("_ac")).alias("mac"), *arrays, F.col("_calls.iid").alias("iids"), F.col("_calls.dosage").alias("dosages"))


def banded_ld(geno: DataFrame, variants: DataFrame, width: int) -> DataFrame:
    """i, j, value: Z'Z of pairs of variants of a contig at most `width` apart, i before j or equal (O-114J, O-177).

    Pairs come from what one subject carries, restricted to neighbouring position buckets, so the
    work is what is nonzero in the band.
    """
    placed = geno.join(variants.select("variant", "contig", "pos"), "variant")
    one = placed.select("iid", "contig", F.col("variant").alias("i"), F.col("pos").alias("pi"), F.col("dosage").alias("gi"), F.explode(F.array(F.floor(F.col("pos") / width), F.floor(F.col("pos") / width) + 1)).alias("_b"))
    two = placed.select("iid", "contig", F.col("variant").alias("j"), F.col("pos").alias("pj"), F.col("dosage").alias("gj"), F.floor(F.col("pos") / width).alias("_b"))
    later = (F.col("pj") > F.col("pi")) | ((F.col("pj") == F.col("pi")) & (F.col("j") >= F.col("i")))
    pairs = one.join(two, ["iid", "contig", "_b"]).where(later & (F.col("pj") <= F.col("pi") + width))
    return pairs.groupBy("i", "j").agg(F.sum(F.col("gi") * F.col("gj")).cast("long").alias("value"))


def symmetric(ld: DataFrame) -> DataFrame:
    """Both halves of a banded matrix kept as its upper one (O-032)."""
    return ld.unionByName(ld.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def voxel_variance(null: DataFrame, bases: np.ndarray, p: int) -> np.ndarray:
    """diag(B R'R B') / (n - p) (O-178)."""
    got = cross_products(null.select(F.array(F.lit(1.0)).alias("x"), F.col("resid").alias("y")))
    return np.einsum("vi,ij,vj->v", bases, got["yy"], bases) / (got["n"] - p)


def single_variants(summary: DataFrame, bases: np.ndarray, variance: np.ndarray, min_mac: int = 5, max_p: float = 1.0) -> DataFrame:
    """Each variant on each voxel (O-188): index (one-based), variant, maf, mac, beta, se, z, p.

    summary: variant, maf, mac, score array, diag (the variant's entry of Z'(I - M)Z)."""
    limit = float(stats.chi2_isf(max_p)) if max_p < 1 else 0.0
    kind = summary.schema["variant"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            beta = np.stack(pdf["score"].to_numpy()) @ bases.T / pdf["diag"].to_numpy()[:, None]
            se = np.sqrt(variance / pdf["diag"].to_numpy()[:, None])
            z = beta / se
            i, v = np.nonzero(z**2 >= limit)
            yield pd.DataFrame({"index": (v + 1).astype(np.int32), "variant": pdf["variant"].to_numpy()[i], "maf": pdf["maf"].to_numpy()[i], "mac": pdf["mac"].to_numpy()[i], "beta": beta[i, v], "se": se[i, v], "z": z[i, v], "p": stats.chi2_sf(z[i, v] ** 2)})

    return summary.where(F.col("mac") >= min_mac).mapInPandas(run, f"index int, variant {kind}, maf double, mac long, beta double, se double, z double, p double")


def annotation_weights(annot: np.ndarray | None, maf: np.ndarray, kind: str) -> list[tuple[str, np.ndarray]]:
    """Weights of a set's variants: the two beta densities, each alone and times the annotations (O-185, A7)."""
    out = []
    extra = [] if annot is None else [1 - 10 ** (-a / 10) for a in np.moveaxis(annot, -1, 0)]
    if any((w <= 0).any() for w in extra):
        raise ValueError("annotations are positive")
    for name, base in (("1,25", stats.beta_pdf(maf, 1, 25)), ("1,1", np.ones_like(maf))):
        out.append((name, base))
        out += [(f"{name}:{k}", base * (w if kind == "burden" else np.sqrt(w))) for k, w in enumerate(extra)]
    return out


def burden(score: np.ndarray, cov: np.ndarray, w: np.ndarray, bases: np.ndarray | None, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Effect, error and chi-square of each voxel (O-180); bases None: the scores are those of voxels."""
    denominator = float(w @ cov @ w)
    effect = (w @ score if bases is None else (w @ score) @ bases.T) / denominator
    se = np.sqrt(variance / denominator)
    return effect, se, (effect / se) ** 2


def burden_p(chi: np.ndarray, cmac: int, null: dict | None = None) -> np.ndarray:
    """p by chi-square for cmac above 100, else by lookup in the permutation null: share of null statistics
    at least as large, NaN where that is not below the share that was kept."""
    if cmac > 100 or null is None:
        return stats.chi2_sf(chi)
    name = next((f"{a}_{b}" for a, b in CMAC_BINS if a <= cmac <= b), None)
    if name not in null:
        return np.full(len(chi), np.nan)
    kept, count = null[name]
    p = np.array([(len(k) - np.searchsorted(k, c, "left")) / count for k, c in zip(kept, chi)])
    most = np.array([len(k) / count for k in kept])
    return np.where(p >= most, np.nan, p)


def spectra(cov: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Eigenvalues of WCW for each of the weights, in one batch; those that are rounding only are 0."""
    w = np.stack(weights)
    values = np.linalg.eigvalsh(w[:, :, None] * cov * w[:, None, :])
    values[values < 1e-8] = 0
    return values


def skat_statistics(score: np.ndarray, w: np.ndarray, bases: np.ndarray | None, variance: np.ndarray) -> np.ndarray:
    s = w[:, None] * score
    return ((s if bases is None else s @ bases.T) ** 2).sum(axis=0) / variance


def skat(score: np.ndarray, cov: np.ndarray, weights: list[np.ndarray], bases: np.ndarray | None, variance: np.ndarray) -> np.ndarray:
    """p of each of the weights and voxel (O-181): all voxels share the eigenvalues of WCW."""
    return np.stack([stats.saddlepoint(skat_statistics(score, w, bases, variance), values) for w, values in zip(weights, spectra(cov, weights))])


def skat_tails(members: DataFrame, calls: DataFrame, bases: np.ndarray, variance: np.ndarray) -> DataFrame:
    """set_name, mask, weights, index (one-based voxel), q, eigenvalues, p: the SKAT statistic of each set, beta
    weights and voxel with the spectrum that its tail comes from (O-181, O-182)."""
    schema = "set_name string, mask string, weights string, index int, q double, eigenvalues array<double>, p double"

    def run(sets: CalledSets) -> pd.DataFrame:
        rows, every, scored, mafs = [], sets.matrix("proj"), sets.matrix("score"), sets.column("maf").astype(float)
        for k, (key, a, b) in enumerate(zip(sets.keys, sets.cuts, sets.cuts[1:])):
            proj, score = every[a:b], scored[a:b]
            cov = sets.products(k) - proj @ proj.T
            names, weights = zip(*annotation_weights(None, mafs[a:b], "skat"))
            for name, w, values in zip(names, weights, spectra(cov, list(weights))):
                q = skat_statistics(score, w, bases, variance)
                rows += [(*key, name, np.int32(v + 1), float(q[v]), values, p) for v, p in enumerate(stats.saddlepoint(q, values).tolist())]
        return pd.DataFrame(rows, columns=["set_name", "mask", "weights", "index", "q", "eigenvalues", "p"]).astype({"index": np.int32})

    return by_called_set(members.select("set_name", "mask", "variant", "maf", "score", "proj"), calls, run, schema)


def acat_v(score: np.ndarray, cov: np.ndarray, maf: np.ndarray, mac: np.ndarray, w: np.ndarray, bases: np.ndarray, variance: np.ndarray, thresh: int = 10) -> np.ndarray:
    """Cauchy combination of single-variant p-values, rare ones as one burden (O-183)."""
    common = mac > thresh
    ps, ws = [], []
    scale = lambda k: (w[k] / stats.beta_pdf(maf[k], 1, 25)) ** 2 * maf[k] * (1 - maf[k]) * stats.beta_pdf(maf[k], 1, 25) ** 2
    for k in np.flatnonzero(common):
        chi = (score[k] @ bases.T) ** 2 / (variance * cov[k, k])
        ps.append(stats.chi2_sf(chi))
        ws.append(scale(k))
    if (~common).any():
        k = np.flatnonzero(~common)
        _, _, chi = burden(score[k], cov[np.ix_(k, k)], w[k], bases, variance)
        ps.append(stats.chi2_sf(chi))
        ws.append(float(np.mean([scale(i) for i in k])))
    return stats.cauchy_combination(np.stack(ps), np.array(ws))


def set_products(calls: pd.DataFrame, place: dict, subjects: int = 4096) -> np.ndarray:
    """Z'Z of the variants of one set (variant -> row in `place`) from their calls (variant, iid, dosage), by blocks of subjects."""
    out = np.zeros((len(place), len(place)))
    row, _ = pd.factorize(calls["iid"])
    column, dosage = calls["variant"].map(place).to_numpy(int), calls["dosage"].to_numpy(float)
    order = np.argsort(row, kind="stable")
    row, column, dosage = row[order], column[order], dosage[order]
    for lo in range(0, int(row[-1]) + 1 if len(row) else 0, subjects):
        a, b = np.searchsorted(row, [lo, lo + subjects])
        z = np.zeros((min(subjects, int(row[-1]) + 1 - lo), len(place)))
        z[row[a:b] - lo, column[a:b]] = dosage[a:b]
        out += z.T @ z
    return out


def set_covariances(members: DataFrame, calls: DataFrame) -> DataFrame:
    """set_name, mask, i, j, value: Z'(I - M)Z = Z'Z - PP' of each set's variants, i not after j (O-179).

    members: (set_name, mask, variant, proj array); calls: (variant, iid, dosage)."""

    def run(sets: CalledSets) -> pd.DataFrame:
        out, names, every = [], sets.column("variant"), sets.matrix("proj")
        for k, (key, a, b) in enumerate(zip(sets.keys, sets.cuts, sets.cuts[1:])):
            cov = sets.products(k) - every[a:b] @ every[a:b].T
            i, j = np.triu_indices(b - a)
            out.append(pd.DataFrame({"set_name": key[0], "mask": key[1], "i": names[a:b][i], "j": names[a:b][j], "value": cov[i, j]}))
        return pd.concat(out, ignore_index=True)

    kind = members.schema["variant"].dataType.simpleString()
    return by_called_set(members.select("set_name", "mask", "variant", "proj"), calls, run, f"set_name string, mask string, i {kind}, j {kind}, value double")


#: Kinds of p-values of a set: the test and the beta density of its weights.
GROUPS = ("burden_1_25", "burden_1_1", "skat_1_25", "skat_1_1")


def _by_beta(weights: list[tuple[str, np.ndarray]]) -> list[tuple[str, list[np.ndarray]]]:
    """Weights of each beta density: alone, then times the annotations."""
    return [(name.replace(",", "_"), [w for n, w in weights if n.split(":")[0] == name]) for name in ("1,25", "1,1")]


def named(results: DataFrame, annotations: list[str] = (), staar_only: bool = False) -> DataFrame:
    """Results of set_tests with a column for each p-value (O-196): INDEX, VARIANT_SET, MASK, N_VARIANTS, CMAC, STAAR-O,
    and for each test and density Test(a,b), Test(a,b)-<annotation> and STAAR-Test(a,b), null where it was not made."""
    head = [F.col(c).alias(n) for c, n in (("index", "INDEX"), ("set_name", "VARIANT_SET"), ("mask", "MASK"), ("n_variants", "N_VARIANTS"), ("cmac", "CMAC"), ("staar_o", "STAAR-O"))]
    if staar_only:
        return results.select(*head)
    columns = []
    for g in GROUPS:
        test, a, b = g.split("_")
        name = f"{test.upper() if test == 'skat' else 'Burden'}({a},{b})"
        columns += [F.get(g, k).alias(name if not k else f"{name}-{annotations[k - 1]}") for k in range(len(annotations) + 1)]
        columns += [F.col(f"staar_{g}").alias(f"STAAR-{name}")] * bool(annotations)
    return results.select(*head, *columns)


def burden_table(results: DataFrame) -> DataFrame:
    """INDEX, VARIANT_SET, MASK, N_VARIANTS, CMAC, Burden_effect, Burden_se, Burden_pvalue of results of set_tests (O-196)."""
    names = (("index", "INDEX"), ("set_name", "VARIANT_SET"), ("mask", "MASK"), ("n_variants", "N_VARIANTS"), ("cmac", "CMAC"), ("burden_effect", "Burden_effect"), ("burden_se", "Burden_se"), ("burden_p", "Burden_pvalue"))
    return results.select(*[F.col(c).alias(n) for c, n in names])


def test_set(score: np.ndarray, cov: np.ndarray, maf: np.ndarray, cmac: int, annot: np.ndarray | None, bases: np.ndarray | None, variance: np.ndarray, tests: tuple, null: dict | None = None) -> tuple[dict, dict]:
    """Columns of set_tests for one set, by voxel, and the p-values of each group, weights x voxels, or None.

    bases None: the scores are those of voxels already."""
    voxels = len(variance)
    annot = annot if cmac > 500 else None
    effect, se, chi = burden(score, cov, np.ones(len(score)), bases, variance)
    nothing = np.full(voxels, np.nan)
    out = {"burden_effect": effect, "burden_se": se, "burden_p": burden_p(chi, cmac, null), "skat_p": nothing, "staar_o": nothing}
    groups: dict = dict.fromkeys(GROUPS)
    every = annotation_weights(annot, maf, "burden")
    if {"burden", "staar"} & set(tests):
        for name, own in _by_beta(every):
            groups[f"burden_{name}"] = np.stack([burden_p(burden(score, cov, w, bases, variance)[2], cmac, null) for w in own])
    if cmac > 100 and {"skat", "staar"} & set(tests):
        for name, own in _by_beta(annotation_weights(annot, maf, "skat")):
            groups[f"skat_{name}"] = skat(score, cov, own, bases, variance)
        out["skat_p"] = stats.cauchy_combination(np.concatenate([groups["skat_1_25"], groups["skat_1_1"]]))
        if "staar" in tests:
            out["staar_o"] = stats.cauchy_combination(np.concatenate([groups[g] for g in GROUPS]))
    for g in GROUPS:
        p = groups[g]
        out[g] = [None] * voxels if p is None else list(p.T)
        out[f"staar_{g}"] = stats.cauchy_combination(p) if p is not None and len(p) > 1 else nothing
    return out, groups


def test_stack(score: np.ndarray, cov: np.ndarray, maf: np.ndarray, cmac: np.ndarray, annot: np.ndarray | None, bases: np.ndarray, variance: np.ndarray, tests: tuple, null: dict | None) -> tuple[dict, dict]:
    """test_set for many sets of one number of variants, whose counts are all above 100 or all not and whose annotations, if
    given, are used: arrays sets x voxels, and of each group weights x sets x voxels, or None.  variance: sets x voxels."""
    shape = len(score), len(bases)

    def burdens(w: np.ndarray) -> tuple:
        by = np.einsum("si,sij,sj->s", w, cov, w)[:, None]
        effect, se = np.einsum("si,sir->sr", w, score) @ bases.T / by, np.sqrt(variance / by)
        return effect, se, (effect / se) ** 2

    def tail(chi: np.ndarray) -> np.ndarray:
        return stats.chi2_sf(chi) if null is None or cmac[0] > 100 else np.stack([burden_p(x, int(n), null) for x, n in zip(chi, cmac)])

    effect, se, chi = burdens(np.ones(maf.shape))
    nothing = np.full(shape, np.nan)
    out = {"burden_effect": effect, "burden_se": se, "burden_p": tail(chi), "skat_p": nothing, "staar_o": nothing}
    groups: dict = dict.fromkeys(GROUPS)
    if {"burden", "staar"} & set(tests):
        for name, own in _by_beta(annotation_weights(annot, maf, "burden")):
            groups[f"burden_{name}"] = np.stack([tail(burdens(w)[2]) for w in own])
    together = lambda names: stats.cauchy_combination(np.concatenate([groups[g].reshape(-1, shape[0] * shape[1]) for g in names])).reshape(shape)
    if cmac[0] > 100 and {"skat", "staar"} & set(tests):
        for name, own in _by_beta(annotation_weights(annot, maf, "skat")):
            parts = []
            for w in own:
                values = np.linalg.eigvalsh(w[:, :, None] * cov * w[:, None, :])
                values[values < 1e-8] = 0
                parts.append(stats.saddlepoint_rows((((w[:, :, None] * score) @ bases.T) ** 2).sum(axis=1) / variance, values))
            groups[f"skat_{name}"] = np.stack(parts)
        out["skat_p"] = together(GROUPS[2:])
        if "staar" in tests:
            out["staar_o"] = together(GROUPS)
    for g in GROUPS:
        out[f"staar_{g}"] = together([g]) if groups[g] is not None and len(groups[g]) > 1 else nothing
    return out, groups


test_set.__test__ = test_stack.__test__ = False  # no tests of the suite


def _stacked(sets: CalledSets, bases: np.ndarray, spread: np.ndarray, tests: tuple, max_p: float, cmac_min: int, null: dict | None, swept: bool, inner: np.ndarray | None, df: int) -> pa.Table:
    """Rows of set_tests of the sets that a task holds; sets of one kind and number of variants are tested together."""
    mac, mafs, every, scored, annots = sets.column("mac"), sets.column("maf"), sets.matrix("proj"), sets.matrix("score"), sets._table["annot"].combine_chunks()
    there = np.r_[0, np.cumsum(annots.is_valid().to_numpy(zero_copy_only=False))]
    lists, ends = annots.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(np.nan_to_num(annots.value_lengths().to_numpy(zero_copy_only=False)).astype(int))]
    given = sets.column("_given").astype(bool) if swept else np.zeros(len(mac), bool)
    counts = np.add.reduceat(np.where(given, 0, np.nan_to_num(mac.astype(float))), sets.cuts[:-1]).astype(np.int64)
    kinds: dict = {}
    for k, (a, b) in enumerate(zip(sets.cuts.tolist(), sets.cuts[1:].tolist())):
        m, cmac = b - a - int(given[a:b].sum()), int(counts[k])
        if m >= 2 and cmac >= cmac_min:
            own = np.flatnonzero(~given[a:b]) + a
            noted = cmac > 500 and all(there[own + 1] > there[own])
            kinds.setdefault((m, cmac > 100, int(ends[own[0] + 1] - ends[own[0]]) if noted else -1), []).append(k)
    tables = []
    for (m, _, notes), ks in kinds.items():
        step = max(1, SET_CELLS // (m * max(m, 1)))
        for part in (ks[i : i + step] for i in range(0, len(ks), step)):
            score, cov, maf, annot, variance = [], [], [], [], []
            for k in part:
                a, b = sets.cuts[k], sets.cuts[k + 1]
                own, by, held = sets.products(k) - every[a:b] @ every[a:b].T, scored[a:b], np.flatnonzero(given[a:b])
                rest, spread_k = np.flatnonzero(~given[a:b]) + a, spread
                if len(held):
                    by, own, spread_k = sweep(by, own, held, bases, inner, df)
                score.append(by), cov.append(own), maf.append(mafs[rest].astype(float)), variance.append(spread_k)
                if notes >= 0:
                    annot.append(np.stack([lists[ends[i] : ends[i + 1]] for i in rest]).astype(float))
            cmac = counts[part]
            out, groups = test_stack(np.stack(score), np.stack(cov), np.stack(maf), cmac, np.stack(annot) if notes >= 0 else None, bases, np.stack(variance), tests, null)
            voxels, many = len(bases), len(part)
            found = np.stack([out[c] for c in ("burden_p", "skat_p", "staar_o", *(f"staar_{g}" for g in GROUPS))] + [p for g in groups.values() if g is not None for p in g])
            keep = np.flatnonzero(~(np.fmin.reduce(found, axis=0).ravel() > max_p))
            of = np.repeat(np.arange(many), voxels)[keep]
            names = [pa.array([sets.keys[part[i]][c] for i in of.tolist()], pa.string()) for c in (0, 1)]
            columns = {"index": pa.array(np.tile(np.arange(1, voxels + 1, dtype=np.int32), many)[keep]), "set_name": names[0], "mask": names[1], "n_variants": pa.array(np.full(len(keep), m, np.int32)), "cmac": pa.array(cmac[of].astype(np.int64))}
            columns |= {c: pa.array(out[c].ravel()[keep], from_pandas=True) for c in ("burden_effect", "burden_se", "burden_p", "skat_p", "staar_o")}
            for g in GROUPS:
                p = groups[g]
                flat = None if p is None else p.reshape(len(p), -1).T[keep]
                columns[g] = pa.nulls(len(keep), pa.list_(pa.float64())) if p is None else pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * len(p)), pa.array(flat.ravel()))
            columns |= {f"staar_{g}": pa.array(out[f"staar_{g}"].ravel()[keep], from_pandas=True) for g in GROUPS}
            tables.append(pa.table(columns))
    return pa.concat_tables(tables) if tables else pa.table({"index": pa.array([], pa.int32())})


def set_tests(members: DataFrame, ld: DataFrame | None, bases: np.ndarray, variance: np.ndarray, tests: tuple = ("burden", "skat", "staar"), max_p: float = 1.0, cmac_min: int = 2, null: dict | None = None, calls: DataFrame | None = None, given: DataFrame | None = None, inner: np.ndarray | None = None, df: int = 0) -> DataFrame:
    """index, set_name, mask, n_variants, cmac, and p-values of variant sets (O-179 to O-185, O-196).

    burden_effect, burden_se, burden_p: the burden of the plain weights.  burden_1_25, burden_1_1, skat_1_25,
    skat_1_1: arrays of p-values, of the beta weights alone and then times each annotation; staar_ and the same
    name: their Cauchy combination, where there are annotations; skat_p: that of all SKAT p-values; staar_o:
    that of all of them.  `named` gives them their columns by name.

    members: (set_name, mask, variant, maf, mac, score, proj, annot array or null), ld: (i, j, value), or None and
    calls: (variant, iid, dosage), from which each set's products are made where it is tested, so that no pair
    of variants is formed that no set needs.
    SKAT and the omnibus are computed for cmac above 100, annotation weights used above 500.  Rows
    whose smallest p-value is above max_p are left out.

    given: (set_name, variant, score, proj), the variants that a set's tests are conditioned on (O-187), each set
    on its own ones, with inner, the residuals' R'R, and df, n - p, of the null model without them; needs calls.
    They are swept out of scores, covariances and variance, as a null model refitted for the set would have it;
    a variant that is given is not tested in that set.
    """
    by_calls, swept = ld is None, given is not None  # `run` must not hold the frames
    if swept:
        if not by_calls or inner is None:
            raise ValueError("conditional tests need calls, inner and df")
        tested = members.join(given.select(F.col("set_name").alias("_s"), F.col("variant").alias("_v")).distinct(), (F.col("set_name") == F.col("_s")) & (F.col("variant") == F.col("_v")), "left_anti")
        tested = tested.select("set_name", "mask", "variant", "maf", "mac", "score", "proj", "annot")
        own = tested.select("set_name", "mask").distinct()
        added = given.select("set_name", "variant", "score", "proj").dropDuplicates(["set_name", "variant"]).join(own, "set_name")
        blank = {c: F.lit(None).cast(tested.schema[c].dataType).alias(c) for c in ("maf", "mac", "annot")}
        members = tested.withColumn("_given", F.lit(False)).unionByName(added.select("set_name", "mask", "variant", "score", "proj", *blank.values(), F.lit(True).alias("_given")))
    spread = variance
    schema = "index int, set_name string, mask string, n_variants int, cmac long, burden_effect double, burden_se double, burden_p double, skat_p double, staar_o double, " + ", ".join([*(f"{g} array<double>" for g in GROUPS), *(f"staar_{g} double" for g in GROUPS)])
    if by_calls:
        return by_called_set(members, calls, lambda sets: _stacked(sets, bases, spread, tests, max_p, cmac_min, null, swept, inner, df), schema)
    one = members.select(F.col("set_name").alias("set_i"), F.col("mask").alias("mask_i"), F.col("variant").alias("at_i"))
    two = members.select(F.col("set_name").alias("set_j"), F.col("mask").alias("mask_j"), F.col("variant").alias("at_j"))
    pairs = one.join(ld, F.col("at_i") == F.col("i")).join(two, (F.col("set_i") == F.col("set_j")) & (F.col("mask_i") == F.col("mask_j")) & (F.col("j") == F.col("at_j")))
    joined = pairs.select("set_j", "mask_j", "i", "j", "value")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("variant").reset_index(drop=True)
        cmac = int(left["mac"].sum())
        if len(left) < 2 or cmac < cmac_min:
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in schema.split(", ")})
        place = {v: k for k, v in enumerate(left["variant"])}
        cov = np.zeros((len(left), len(left)))
        i, j = right["i"].map(place).to_numpy(int), right["j"].map(place).to_numpy(int)
        cov[i, j] = cov[j, i] = right["value"].to_numpy(float)
        proj, score = np.stack(left["proj"].to_numpy()), np.stack(left["score"].to_numpy())
        cov, maf = cov - proj @ proj.T, left["maf"].to_numpy(float)
        annot = np.stack(left["annot"].to_numpy()).astype(float) if left["annot"].notna().all() else None
        out, groups = test_set(score, cov, maf, cmac, annot, bases, spread, tests, null)
        voxels = len(bases)
        frame = pd.DataFrame({"index": np.arange(1, voxels + 1, dtype=np.int32), "set_name": key[0], "mask": key[1], "n_variants": np.int32(len(left)), "cmac": np.int64(cmac), **out})
        found = np.vstack([frame[["burden_p", "skat_p", "staar_o", *(f"staar_{g}" for g in GROUPS)]].to_numpy(float).T, *(p for p in groups.values() if p is not None)])
        return frame[~(np.fmin.reduce(found, axis=0) > max_p)]

    return by_set(members, joined, run, schema)


def sweep(score: np.ndarray, cov: np.ndarray, held: np.ndarray, bases: np.ndarray, inner: np.ndarray, df: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, covariance and voxel variances of the other variants with those `held` as further covariates (O-187).

    Directions of the held variants that depend on each other or on the covariates count once or not at all."""
    rest = np.setdiff1d(np.arange(len(score)), held)
    values, vectors = np.linalg.eigh(cov[np.ix_(held, held)])
    good = values > 1e-9 * max(values.max(), 1e-300)
    half = vectors[:, good] / np.sqrt(values[good])  # its outer product is the inverse
    moved, across = half.T @ score[held], half.T @ cov[np.ix_(held, rest)]
    left = inner - moved.T @ moved
    variance = np.einsum("vi,ij,vj->v", bases, left, bases) / (df - int(good.sum()))
    return score[rest] - across.T @ moved, cov[np.ix_(rest, rest)] - across.T @ across, variance


def exceeds_band(members: DataFrame, bands: DataFrame) -> DataFrame:
    """Sets whose last variant lies outside the band of their first (O-128): members (set_name, variant_idx), bands (variant_idx, band)."""
    ends = members.groupBy("set_name").agg(F.min("variant_idx").alias("_first"), F.max("variant_idx").alias("_last"))
    return ends.join(bands.select(F.col("variant_idx").alias("_first"), "band"), "_first").where(F.col("_last") - F.col("_first") >= F.col("band")).select("set_name")


def genotype_rows(geno: DataFrame) -> Column:
    return C.variant_name(F.col("contig"), F.col("pos"), F.col("ref"), F.col("alt"))


def conditional_null(subjects: DataFrame, geno: DataFrame, conditions: list) -> DataFrame:
    """(iid, x, y) with the dosages of the conditioning variants as further covariates (O-187); a missing dosage is the variant's mean."""
    if not conditions:
        return subjects.select("iid", "x", "y")
    own = geno.where(F.col("variant").isin(conditions)).join(subjects.select("iid"), "iid", "left_semi")
    n = subjects.count()
    means = {r["variant"]: (r["total"] or 0.0) / max(1, n - r["missing"]) for r in own.groupBy("variant").agg(F.sum("dosage").cast("double").alias("total"), F.count_if(F.col("dosage").isNull()).alias("missing")).collect()}  # a row a condition
    value = F.coalesce(F.col("dosage").cast("double"), *[F.when(F.col("variant") == k, F.lit(m)) for k, m in means.items()])
    wide = own.withColumn("_d", value).groupBy("iid").pivot("variant", conditions).agg(F.first("_d"))
    added = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in conditions])
    return subjects.join(wide, "iid", "left").select("iid", F.concat("x", added).alias("x"), "y")


