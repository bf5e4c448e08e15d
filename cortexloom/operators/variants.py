"""Variant quality measures, filters and their combination.

Genotypes are sparse and long: geno(variant, iid, dosage) with dosage 1 or 2; a missing call is a
row with a null dosage; what is absent is 0.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import VariantFilter
from ..functions import columns as C


def variant_qc(geno: DataFrame, n: int) -> DataFrame:
    """variant, n_called, n_het, n_hom_alt, ac, af, call_rate, maf, mac (O-101, O-102, O-103)."""
    missing = F.count_if(F.col("dosage").isNull())
    counts = geno.groupBy("variant").agg((F.lit(n) - missing).cast("long").alias("n_called"), F.count_if(F.col("dosage") == 1).alias("n_het"), F.count_if(F.col("dosage") == 2).alias("n_hom_alt"), F.coalesce(F.sum("dosage"), F.lit(0)).cast("long").alias("ac"))
    af = F.try_divide(F.col("ac"), 2 * F.col("n_called"))
    return counts.select("*", af.alias("af"), (F.col("n_called") / n).alias("call_rate"), F.least(af, 1 - af).alias("maf"), F.least("ac", 2 * F.col("n_called") - F.col("ac")).alias("mac"))


def hwe_p(qc: DataFrame) -> DataFrame:
    """qc with p_hwe, the exact mid-p (O-072, O-104)."""
    return qc.withColumn("p_hwe", C.hwe(F.col("n_called") - F.col("n_het") - F.col("n_hom_alt"), "n_het", "n_hom_alt"))


def maf_filter(low: float = 0.0, high: float = 0.5) -> Column:
    return (F.col("maf") > low) & (F.col("maf") <= high)


def mac_filter(low: int = 0, high: int | None = None) -> Column:
    test = F.col("mac") > low
    return test if high is None else test & (F.col("mac") <= high)


def type_filter(kind: str) -> Column:
    ref, alt = F.col("ref"), F.col("alt")
    return {"snv": C.is_snv(ref, alt), "indel": C.is_indel(ref, alt), "variant": F.lit(True)}[kind]


def pass_filter() -> Column:
    """No filter failed (O-073)."""
    return F.col("filters").isNull() | (F.size("filters") == 0)


def star_filter() -> Column:
    return F.col("alt") != "*"


def quality(variants: DataFrame, options: VariantFilter) -> DataFrame:
    """All active filters as one predicate (O-075); a filter is active only if all its options are given."""
    tests = []
    if "alt" in variants.columns:
        tests.append(star_filter())
    if "filters" in variants.columns:
        tests.append(pass_filter())
    if options.variant_type:
        tests.append(type_filter(options.variant_type))
    if None not in (options.maf_min, options.maf_max):
        tests.append(maf_filter(options.maf_min, options.maf_max))
    if None not in (options.mac_min, options.mac_max):
        tests.append(mac_filter(options.mac_min, options.mac_max))
    if options.call_rate is not None:
        tests.append(F.col("call_rate") >= options.call_rate)
    if options.hwe is not None:
        tests.append(F.col("p_hwe") >= options.hwe)
    return variants.where(functools.reduce(Column.__and__, tests)) if tests else variants


def plink_filter(geno: DataFrame, n: int, maf_min: float) -> DataFrame:
    """Variants with min(f, 1 - f) above maf_min that aren't all heterozygous or missing (O-082, O-105)."""
    return common_enough(variant_qc(geno, n), n, maf_min)


def common_enough(qc: DataFrame, n: int, maf_min: float) -> DataFrame:
    """The same of measures that are there, such as those of packed calls."""
    freq = F.col("ac") / (2 * F.col("n_called"))
    return qc.where((F.least(freq, 1 - freq) > maf_min) & (F.col("n_het") + (n - F.col("n_called")) < n))


def flip_major(dense: DataFrame, key: str = "variant", value: str = "dosage") -> DataFrame:
    """Dense rows; variants with a mean dosage above 1 become 2 - dosage (O-106)."""
    mean = F.avg(value).over(Window.partitionBy(key))
    return dense.withColumn(value, F.when(mean / 2 > 0.5, 2 - F.col(value)).otherwise(F.col(value)))


def flip_vectors(vectors: DataFrame, value: str = "dosages") -> DataFrame:
    """The same for one row a variant with its dosages in an array."""
    total = F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + x)
    return vectors.withColumn(value, F.when(total > F.size(value), F.transform(value, lambda x: (2 - x).cast("tinyint"))).otherwise(F.col(value)))


def impute(dense: DataFrame, how: str = "mean", key: str = "variant", value: str = "dosage") -> DataFrame:
    """Missing dosages as 0 or as the variant's mean (O-107)."""
    if how == "zero":
        return dense.withColumn(value, F.coalesce(value, F.lit(0)))
    means = dense.groupBy(key).agg(F.avg(value).alias("_mean"))
    return dense.join(means, key).withColumn(value, F.coalesce(F.col(value).cast("double"), "_mean")).drop("_mean")


def finite_rows(data: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null, NaN or infinity in the columns (O-076)."""
    return data.where(functools.reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")) for c in columns]))


def finite_arrays(data: DataFrame, arrays: list[str]) -> DataFrame:
    """Rows whose arrays hold no null and no infinity; NaN passes (O-077)."""
    return data.where(functools.reduce(Column.__and__, [~F.exists(a, lambda x: x.isNull() | (F.abs(x) == float("inf"))) for a in arrays]))


def chromosomes(variants: DataFrame) -> list[str]:
    """Distinct contigs (O-109): a handful of rows."""
    return sorted(r[0] for r in variants.select("contig").distinct().collect())


def range_summary(variants: DataFrame) -> DataFrame:
    """contig, start, end of what is there (O-110)."""
    return variants.groupBy("contig").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))


def cmac(members: DataFrame, sets: list[str] = ("set_name",), low: int = 2, high: int | None = None) -> DataFrame:
    """n_variants and cmac of sets (O-113) with at least two variants and cmac in low..high (O-086, O-087)."""
    got = members.groupBy(*sets).agg(F.count("*").alias("n_variants"), F.sum("mac").cast("long").alias("cmac")).where("n_variants >= 2").where(F.col("cmac") >= low)
    return got if high is None else got.where(F.col("cmac") <= high)


# Bins of cumulative minor allele count, lowest and highest value of each.
CMAC_BINS = [(2, 2), (3, 3), (4, 4), (5, 5), (6, 7), (8, 9), (10, 11), (12, 14), (15, 20), (21, 30), (31, 60), (61, 100)]
# The bins that sets are counted in; those above the null distributions' bins too, the last one open.
HISTOGRAM_BINS = [*CMAC_BINS, (101, 500), (501, None)]


def cmac_bin(value: Column, bins: list[tuple] = CMAC_BINS) -> Column:
    """`lo_hi` of the bin, `lo` if it is open, null outside (O-157)."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(bins):
        inside = value >= lo if hi is None else (value >= lo) & (value <= hi)
        out = F.when(inside, F.lit(f"{lo}" if hi is None else f"{lo}_{hi}")).otherwise(out)
    return out


def bin_histogram(sets: DataFrame) -> DataFrame:
    """Sets in each bin (O-114)."""
    return sets.select(cmac_bin(F.col("cmac"), HISTOGRAM_BINS).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n_sets"))


def nan_summary(data: DataFrame, column: str) -> DataFrame:
    """mean, median, max, min without NaN (O-115)."""
    x = C.flat(F.col(column))
    return data.agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.max(x).alias("max"), F.min(x).alias("min"))


def sample_size_filter(stats: DataFrame, column: str = "n") -> DataFrame:
    """Rows with at least int(90th percentile / 1.5) samples (O-079)."""
    limit = stats.agg(F.percentile(column, 0.9)).first()[0]  # one number
    return stats.where(F.col(column) >= int(limit / 1.5)) if limit is not None else stats


def two_panel_maf(one: DataFrame, two: DataFrame, low: float) -> DataFrame:
    """Variants of both panels with maf >= low in each (O-083)."""
    return one.where(F.col("maf") >= low).select("snp", "a1", "a2", F.col("maf").alias("maf_1")).join(two.where(F.col("maf") >= low).select("snp", "a1", "a2", F.col("maf").alias("maf_2")), ["snp", "a1", "a2"])


def check_median(stats: DataFrame, column: str, null: float, tolerance: float = 0.1) -> float:
    """The median of an effect; raises if it is far from its null value, on either side (O-081)."""
    got = stats.agg(F.median(column)).first()[0]
    if got is not None and abs(got - null) > tolerance:
        raise ValueError(f"the median of {column} is {got}, not near {null}")
    return got
