"""Covariates, cross products, null models and per-variant regression.

Subjects are rows with arrays: covar(iid, x array) with the intercept first, ldrs(iid, y array).
Cross products are summed as arrays of products, so only matrices of the size of covariates and
components reach the driver; genotypes stay sparse and are never densified.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .spectrum import ImageSpectrum


def design(data: DataFrame, numeric: list[str], categorical: list[str] = (), most_levels: int = 1000) -> tuple[DataFrame, list[str]]:
    """iid, x: intercept, dummies of the categories without the first level in order, then numbers (O-152)."""
    columns, names = [F.lit(1.0)], ["intercept"]
    for c in categorical:
        levels = sorted(str(r[0]) for r in data.where(F.col(c).isNotNull()).select(c).distinct().limit(most_levels + 1).collect())
        if len(levels) > most_levels:
            raise ValueError(f"{c} has more than {most_levels} levels")
        for v in levels[1:]:
            columns.append(F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0))
            names.append(f"{c}_{v}")
    columns += [F.col(c).cast("double") for c in numeric]
    names += list(numeric)
    return data.select("iid", F.array(*columns).alias("x")), names


def sum_arrays(data: DataFrame, columns: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """Element-wise sums of arrays, by key: partial sums in vectorised groups, then one sum of the partial ones."""
    names = list(columns)  # what tasks get: columns are of the driver
    out = [f"{name} array<double>" for name in names]
    selected = data.select(*keys, *[c.alias(n) for n, c in columns.items()])
    schema = ", ".join([*(f"`{k}` {selected.schema[k].dataType.simpleString()}" for k in keys), *out])

    def partial(batches):
        totals: dict = {}
        for pdf in batches:
            groups = pdf.groupby(list(keys), sort=False) if keys else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                sums = [np.sum(np.stack(part[n].to_numpy()).astype(float), axis=0) for n in names]
                have = totals.get(key)
                totals[key] = sums if have is None else [a + b for a, b in zip(have, sums)]
        if totals:
            yield pd.DataFrame([[*k, *v] for k, v in totals.items()], columns=[*keys, *names])

    parts = selected.mapInPandas(partial, schema)
    # the sum of equally long arrays, element by element, folded from the partial ones
    if not keys:
        return parts.mapInPandas(partial, schema).coalesce(1).mapInPandas(partial, schema)
    return parts.groupBy(*keys).applyInPandas(lambda pdf: next(partial([pdf])), schema)


def outer(a: Column, b: Column) -> Column:
    """Products of all elements of two arrays, row by row."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def cross_products(subjects: DataFrame, x: str = "x", y: str = "y") -> dict:
    """n, X'X, X'Y, Y'Y of the rows (O-116)."""
    rows = subjects.select(F.col(x).alias("x"), F.col(y).alias("y")).mapInPandas(_products, "n long, xx array<double>, xy array<double>, yy array<double>, p int, r int").collect()  # a row a partition
    p, r = rows[0]["p"], rows[0]["r"]
    total = lambda k, shape: np.sum([np.reshape(row[k], shape) for row in rows], axis=0)
    return {"n": sum(row["n"] for row in rows), "xx": total("xx", (p, p)), "xy": total("xy", (p, r)), "yy": total("yy", (r, r))}


def _products(batches):
    have = None
    for pdf in batches:
        if not len(pdf):
            continue
        x, y = np.stack(pdf["x"].to_numpy()).astype(float), np.stack(pdf["y"].to_numpy()).astype(float)
        now = [len(pdf), x.T @ x, x.T @ y, y.T @ y]
        have = now if have is None else [a + b for a, b in zip(have, now)]
    if have:
        yield pd.DataFrame([[have[0], *(m.ravel() for m in have[1:]), *have[2].shape]], columns=["n", "xx", "xy", "yy", "p", "r"])


def check_singular(xx: np.ndarray) -> None:
    """Raise if the covariates are linearly dependent to working precision (O-153)."""
    scale = np.sqrt(np.diag(xx))
    if (scale == 0).any() or np.linalg.cond(xx / np.outer(scale, scale)) >= 1 / np.finfo(float).eps:
        raise ValueError("the covariates are singular")


def independent_columns(xx: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Columns that don't depend on those before them (O-154), from X'X by a pivot-free Cholesky pass."""
    kept: list[int] = []
    for j in range(len(xx)):
        left = xx[j, j]
        if kept:
            a = xx[np.ix_(kept, kept)]
            left -= xx[j, kept] @ np.linalg.solve(a, xx[kept, j])
        if left > tolerance * max(1.0, xx[j, j]):
            kept.append(j)
    return kept


def covariance(products: dict) -> np.ndarray:
    """Y'(I - M)Y / n (O-117)."""
    xx, xy = products["xx"], products["xy"]
    return (products["yy"] - xy.T @ np.linalg.solve(xx, xy)) / products["n"]


def matrix_rows(m: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def times(m: np.ndarray, v: Column) -> Column:
    """m @ v as an array column."""
    return F.transform(matrix_rows(m), lambda row: dot(row, v))


def residuals(subjects: DataFrame, products: dict | None = None) -> DataFrame:
    """(iid, x, y, resid): resid = y - X (X'X)^-1 X'y (O-175)."""
    products = products or cross_products(subjects)
    coef = np.linalg.solve(products["xx"], products["xy"])  # p x r
    return subjects.withColumn("resid", F.zip_with("y", times(coef.T, F.col("x")), lambda a, b: a - b))


def gwas(geno: DataFrame, subjects: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per variant and component, least squares on dosage and covariates (O-161).

    subjects: (iid, x, y).  Result: variant, n_called, alt_allele_freq, and arrays beta,
    standard_error, t_stat, p_value.  A missing dosage is the variant's mean.  Degrees of freedom:
    n - p - 1.  A variant that the covariates explain has nulls.
    """
    products = cross_products(subjects)
    n, xx = products["n"], products["xx"]
    inverse = np.linalg.inv(xx)
    made = residuals(subjects, products).select("iid", "x", "resid")
    rss = np.diag(products["yy"] - products["xy"].T @ inverse @ products["xy"]).copy()
    p, r = len(xx), len(rss)
    kind = geno.schema["variant"].dataType.simpleString()
    called, absent = F.coalesce(F.col("dosage").cast("double"), F.lit(0.0)), F.col("dosage").isNull().cast("double")
    rows = geno.join(made, "iid").select("variant", called.alias("_d"), absent.alias("_m"), "x", "resid")  # missing calls too: their covariates are needed
    sums = sums_by_key(rows, "variant", [(None, "_d", 1), ("_d", "_d", 1), (None, "_m", 1), ("_d", "x", p), ("_d", "resid", r), ("_m", "x", p), ("_m", "resid", r)])

    def finish(batches):
        for pdf in batches:
            if len(pdf):
                yield _tested(pdf[["variant"]], np.stack(pdf["sums"].to_numpy()), n, inverse, rss)

    out = sums.mapInPandas(finish, f"variant {kind}, {TESTED}")
    return out if names is None else out.join(names, "variant")


TESTED = "n_called long, alt_allele_freq double, beta array<double>, standard_error array<double>, t_stat array<double>, p_value array<double>"


def _tested(names: pd.DataFrame, s: np.ndarray, n: float, inverse: np.ndarray, rss: np.ndarray) -> pd.DataFrame:
    """names with TESTED, from the sums of gwas (a row a variant), the subjects, (X'X)^-1 and the residual sums of squares."""
    p, r = len(inverse), len(rss)
    df = n - p - 1
    ac, gg, missing = s[:, 0], s[:, 1], s[:, 2]
    gx, gy, mx, my = np.split(s[:, 3:], [p, p + r, 2 * p + r], axis=1)
    have = n - missing
    mean = np.divide(ac, have, out=np.zeros(len(s)), where=have > 0)
    gg, gx, gy = gg + mean * mean * missing, gx + mean[:, None] * mx, gy + mean[:, None] * my
    left = gg - np.einsum("ij,jk,ik->i", gx, inverse, gx)
    left[(left <= 1e-10 * np.maximum(gg, 1e-300)) | (df <= 0)] = np.nan
    beta = gy / left[:, None]
    se = np.sqrt(np.maximum(rss - gy * beta, 0) / max(df, 1) / left[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / se
    return names.assign(n_called=have.astype(np.int64), alt_allele_freq=mean / 2, beta=list(beta), standard_error=list(se), t_stat=list(t), p_value=list(stats.t_sf2(t, df)))


#: Sums up to which they are columns of one hash aggregation; beyond, arrays are summed by slices of so many elements.
MOST_SUMS = 96


def sums_by_key(rows: DataFrame, key: str, terms: list[tuple[str | None, str, int]]) -> DataFrame:
    """key, sums array<double>: over the rows of each key, for each term (weight, value, size) the sum of
    weight * value, or of value if the weight is None; a value of size 1 that is no array, or each element of one.

    Spark's hash aggregation sums within each task before it shuffles, so a key with very many rows is spread."""
    kind = {f.name: f.dataType.typeName() for f in rows.schema}
    elements = []
    for weight, value, size in terms:
        for k in range(size):
            element = F.get(value, k) if kind[value] == "array" else F.col(value)
            elements.append(element if weight is None else F.col(weight) * element)
    if len(elements) <= MOST_SUMS:
        got = rows.groupBy(key).agg(*[F.sum(e).alias(f"_s{i}") for i, e in enumerate(elements)])
        return got.select(key, F.array(*[F.col(f"_s{i}") for i in range(len(elements))]).alias("sums"))
    parts = [elements[i : i + MOST_SUMS] for i in range(0, len(elements), MOST_SUMS)]
    cut = rows.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.array(*p, *[F.lit(0.0)] * (MOST_SUMS - len(p))).alias("v")) for i, p in enumerate(parts)])).alias("_p"))
    summed = cut.groupBy(key, F.col("_p.i").alias("_i")).agg(*[F.sum(F.get("_p.v", k)).alias(f"_s{k}") for k in range(MOST_SUMS)])
    each = summed.select(key, F.struct("_i", F.array(*[F.col(f"_s{k}") for k in range(MOST_SUMS)]).alias("v")).alias("_p"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["v"]))
    return each.groupBy(key).agg(F.slice(whole, 1, len(elements)).alias("sums"))


def gwas_loco(geno: DataFrame, subjects: DataFrame, loco: DataFrame, contigs: list) -> DataFrame:
    """The same by contig with the leave-one-chromosome-out predictions taken off y, stacked (O-137S, O-161).

    geno also has contig; loco: (iid, contig, pred array).  All contigs are tested in one plan, which reads the calls
    once; covariates-sized products of each contig reach the driver."""
    own = subjects.join(loco.where(F.col("contig").isin(list(contigs))), "iid").select("iid", "contig", "x", F.zip_with("y", "pred", lambda a, b: a - b).alias("y"))
    first = own.select(F.size("x").alias("p"), F.size("y").alias("r")).first()
    p, r = (first["p"], first["r"]) if first else (0, 0)
    wide = own.select("contig", "x", "y", F.lit(1.0).alias("_n"), *[F.get("x", k).alias(f"_x{k}") for k in range(p)], *[F.get("y", k).alias(f"_y{k}") for k in range(r)])
    terms = [(None, "_n", 1), *[(f"_x{k}", "x", p) for k in range(p)], *[(f"_x{k}", "y", r) for k in range(p)], *[(f"_y{k}", f"_y{k}", 1) for k in range(r)]]
    known = {}
    for row in sums_by_key(wide, "contig", terms).collect() if first else []:  # a row a contig
        n, xx, xy, yy = np.split(np.array(row["sums"]), np.cumsum([1, p * p, p * r]))
        xx, xy = xx.reshape(p, p), xy.reshape(p, r)
        known[row["contig"]] = (n[0], np.linalg.inv(xx), yy - np.einsum("kr,kr->r", xy, np.linalg.solve(xx, xy)), np.linalg.solve(xx, xy).T.tolist())
    missing = [c for c in contigs if c not in known]
    if missing:
        raise ValueError(f"no predictions for contigs {missing}")
    fitted = geno.sparkSession.createDataFrame([(c, k[3]) for c, k in known.items()], f"contig {loco.schema['contig'].dataType.simpleString()}, _coef array<array<double>>")
    made = own.join(F.broadcast(fitted), "contig").select("iid", "contig", "x", F.zip_with("y", F.transform("_coef", lambda b: dot(b, F.col("x"))), lambda a, b: a - b).alias("resid"))
    called, absent = F.coalesce(F.col("dosage").cast("double"), F.lit(0.0)), F.col("dosage").isNull().cast("double")
    rows = geno.join(made, ["iid", "contig"]).select(F.struct("contig", "variant").alias("_key"), called.alias("_d"), absent.alias("_m"), "x", "resid")
    sums = sums_by_key(rows, "_key", [(None, "_d", 1), ("_d", "_d", 1), (None, "_m", 1), ("_d", "x", p), ("_d", "resid", r), ("_m", "x", p), ("_m", "resid", r)])

    def finish(batches):
        for pdf in batches:
            for c, part in pdf.groupby("contig", sort=False):
                yield _tested(part[["variant"]], np.stack(part["sums"].to_numpy()), *known[c][:3]).assign(contig=c)

    kinds = [geno.schema[c].dataType.simpleString() for c in ("variant", "contig")]
    return sums.select("_key.variant", "_key.contig", "sums").mapInPandas(finish, f"variant {kinds[0]}, {TESTED}, contig {kinds[1]}")


def project(images: DataFrame, bases: DataFrame, value: str = "voxels") -> DataFrame:
    """(iid, ldr array): image times bases (O-162); bases (voxel, b array), one row a voxel, collected to the size N x r."""
    b = matrix_of(bases)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"iid": pdf["iid"], "ldr": list(np.stack(pdf[value].to_numpy()).astype(float) @ b)})

    kind = images.schema["iid"].dataType.simpleString()
    return images.select("iid", value).mapInPandas(run, f"iid {kind}, ldr array<double>")


def matrix_of(bases: DataFrame) -> np.ndarray:
    """Bases (voxel, b array) as a matrix, of image size."""
    got = bases.select("voxel", "b").toPandas().sort_values("voxel")
    return np.stack(got["b"].to_numpy()).astype(float)


def reconstruction_quality(images: DataFrame, bases: DataFrame, value: str = "voxels", steps: int = 10) -> DataFrame:
    """share, corr: mean over subjects of the correlation of the image with its reconstruction from the first
    10 %, 20 % ... of the components (O-159, O-162)."""
    b = matrix_of(bases)

    def run(batches):
        total, n = np.zeros(steps), 0
        for pdf in batches:
            if not len(pdf):
                continue
            y = np.stack(pdf[value].to_numpy()).astype(float)
            z = (y - y.mean(axis=1, keepdims=True)) / y.std(axis=1, keepdims=True)
            for k in range(steps):
                r = max(1, round(b.shape[1] * (k + 1) / steps))
                got = y @ b[:, :r] @ b[:, :r].T
                got = (got - got.mean(axis=1, keepdims=True)) / got.std(axis=1, keepdims=True)
                total[k] += (z * got).mean(axis=1).sum()
            n += len(y)
        if n:
            yield pd.DataFrame({"step": range(1, steps + 1), "total": total, "n": n})

    got = images.select(value).mapInPandas(run, "step int, total double, n long")
    return got.groupBy("step").agg((F.sum("total") / F.sum("n")).alias("corr")).select((F.col("step") / steps).alias("share"), "corr")


def principal_components(images: DataFrame, top: int | None = None, value: str = "voxels") -> tuple[np.ndarray, np.ndarray]:
    """Bases (N x k) and eigenvalues of the centred images (O-165, O-118), see ImageSpectrum: no N x N matrix is made."""
    spectrum = ImageSpectrum(images, value)
    return spectrum.components(n_top(spectrum.n, spectrum.width, top))


def n_top(n: int, voxels: int, asked: int | None, everything: bool = False) -> int:
    """How many components: all if asked for, at most min(n, voxels); a fifth of that by default."""
    most = min(n, voxels)
    if everything:
        return most
    return min(asked, most) if asked else max(1, most // 5)


def impute_eigenvalues(known: np.ndarray, total: int) -> np.ndarray:
    """Further eigenvalues on the line of the last two on the log scale (O-166)."""
    logs = np.log(known)
    slope = logs[-1] - logs[-2] if len(logs) > 1 else 0.0
    more = logs[-1] + slope * np.arange(1, total - len(known) + 1)
    return np.exp(np.concatenate([logs, more]))


def effective_tests(values: np.ndarray) -> float:
    """(sum)^2 / sum of squares of the eigenvalues (O-119)."""
    return float(values.sum() ** 2 / (values**2).sum())


def proportions(values: np.ndarray, steps: tuple = (0.7, 0.75, 0.8, 0.85, 0.9, 0.95)) -> list[tuple[float, int]]:
    """How many components each share of the variance takes (O-120)."""
    share = np.cumsum(values) / values.sum()
    return [(p, int((share <= p).sum()) + 1) for p in steps]


def recover_voxels(sumstats: DataFrame, bases: DataFrame, cov: np.ndarray, max_p: float | None = None, voxels: list[int] | None = None) -> DataFrame:
    """Voxel effects from those of components (O-168, O-115J): index (one-based), variant columns, beta, se, z, p.

    sumstats: variant columns and arrays beta, z and n; rows are expanded to voxels inside the
    vectorised step, and with max_p only the significant ones leave it (O-084).
    """
    b = matrix_of(bases)
    chosen = np.arange(len(b)) if voxels is None else np.array(voxels)
    b, sigma = b[chosen], np.diag(cov)
    quad = np.einsum("vi,ij,vj->v", b, cov, b)
    limit = float(stats.chi2_isf(max_p)) if max_p else 0.0
    keys = [c for c in sumstats.columns if c not in ("beta", "z")]
    schema = "index int, " + ", ".join(f"`{k}` {sumstats.schema[k].dataType.simpleString()}" for k in keys) + ", beta double, se double, z double, p double"

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                if not len(part):
                    continue
                beta, z, n = np.stack(part["beta"].to_numpy()).astype(float), np.stack(part["z"].to_numpy()).astype(float), part["n"].to_numpy(float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    k = (((beta / z) ** 2 + beta**2 / n[:, None]) / sigma).mean(axis=1)
                    bv = beta @ b.T
                    se = np.sqrt(k[:, None] * quad - bv**2 / n[:, None])
                    zv = bv / se
                    keep = zv**2 >= limit
                i, v = np.nonzero(keep)
                out = part[keys].iloc[i].reset_index(drop=True)
                out.insert(0, "index", (chosen[v] + 1).astype(np.int32))
                yield out.assign(beta=bv[i, v], se=se[i, v], z=zv[i, v], p=stats.chi2_sf(zv[i, v] ** 2))

    return sumstats.mapInPandas(run, schema)
