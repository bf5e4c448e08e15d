"""Sets of subjects and variants, and the joins by key that apply them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBJECT = ["fid", "iid"]


def intersect_ids(frames: list[DataFrame], keys: list[str] = SUBJECT) -> DataFrame:
    """Keys that all frames have, distinct (O-003, O-134S)."""
    return functools.reduce(lambda a, b: a.intersect(b), [f.select(*keys) for f in frames]).distinct()


def union_ids(frames: list[DataFrame], keys: list[str] = SUBJECT) -> DataFrame:
    """Keys that any frame has, distinct (O-004, O-135S)."""
    return functools.reduce(DataFrame.unionByName, [f.select(*keys) for f in frames]).distinct()


def except_ids(left: DataFrame, right: DataFrame, keys: list[str] = SUBJECT) -> DataFrame:
    """Distinct keys of left that right lacks (O-136S)."""
    return left.select(*keys).subtract(right.select(*keys))


def align_subjects(frames: list[DataFrame], keep: DataFrame | None = None, remove: DataFrame | None = None, keys: list[str] = SUBJECT) -> DataFrame:
    """Subjects that all frames and `keep` have and `remove` lacks."""
    common = intersect_ids([*frames, *([keep] if keep is not None else [])], keys)
    return except_ids(common, remove, keys) if remove is not None else common


def keep_subjects(data: DataFrame, keep: DataFrame, keys: list[str] = SUBJECT, merge: bool = False) -> DataFrame:
    """Rows of the kept keys (O-061, O-062). Unless `merge`, a key that data lacks raises when the plan runs."""
    if not merge:
        missing = keep.select(*keys).distinct().join(data.select(*keys).distinct(), keys, "left_anti").limit(1)
        if missing.count():
            raise KeyError(f"{missing.first().asDict()} is not in the data")
    return data.join(keep.select(*keys).distinct(), keys, "left_semi")


def remove_subjects(data: DataFrame, remove: DataFrame, keys: list[str] = SUBJECT) -> DataFrame:
    return data.join(remove.select(*keys).distinct(), keys, "left_anti")


def extract(variants: DataFrame, lists: list[DataFrame], key: str | list[str] = "rsid") -> DataFrame:
    """Variants in all lists (O-005, O-007, O-063, O-064)."""
    return functools.reduce(lambda v, x: v.join(x, key, "left_semi"), lists, variants)


def exclude(variants: DataFrame, lists: list[DataFrame], key: str | list[str] = "rsid") -> DataFrame:
    """Variants in none of the lists (O-006, O-008, O-063, O-064)."""
    return functools.reduce(lambda v, x: v.join(x, key, "left_anti"), lists, variants)


def merge_lists(lists: list[DataFrame], key: str) -> DataFrame:
    """Inner merge of lists: a key repeated in several multiplies (O-005)."""
    return functools.reduce(lambda a, b: a.select(key).join(b.select(key), key), lists)


def unique_keys(data: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; of repeated keys none is kept (O-108).

    Counted by aggregation and joined back, so that a key with very many rows is not gathered.
    """
    once = data.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return data.join(once, functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), "left_semi")


def ordered_extract(keep: DataFrame, info: DataFrame, key: str = "snp", order: str = "row_id") -> DataFrame:
    """Rows of info for the keys of keep in keep's order, with the row number they had in info (O-103J)."""
    return keep.select(F.col(key).alias("_key"), F.col(order).alias("_order")).join(info, F.col("_key") == F.col(key)).orderBy("_order", "row_id").drop("_key", "_order")


def annotate_left(data: DataFrame, table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Left lookup: the other columns of table as a struct, null where it lacks the key (O-105J)."""
    rest = [c for c in table.columns if c not in keys]
    return data.join(table.select(*keys, F.struct(*rest).alias(name)), keys, "left")


def annotate_inner(data: DataFrame, table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Lookup that drops what table lacks (O-106J)."""
    rest = [c for c in table.columns if c not in keys]
    return data.join(table.select(*keys, F.struct(*rest).alias(name)), keys)


def common_variants(tables: list[DataFrame], lists: list[DataFrame] = (), excluded: list[DataFrame] = (), key: str = "snp", alleles: tuple = ("a1", "a2")) -> DataFrame:
    """Variants that all tables have once, with allele columns of the same two alleles, swapped or not (O-101J).

    tables: key and alleles.  Returns the key and each table's alleles as <allele>_<i>.
    """
    def once(t: DataFrame, columns: list[Column]) -> DataFrame:
        counted = t.groupBy(key).agg(F.count("*").alias("_n"), *columns)
        return counted.where("_n = 1").drop("_n")

    # a key is there once in the merge if it is there once in each table and list, so no merge is counted and joined back
    merged = functools.reduce(lambda a, b: a.join(b, key), [once(t, [F.any_value(a).alias(f"{a}_{i}") for a in alleles]) for i, t in enumerate(tables)])
    for x in lists:
        merged = merged.join(once(x, []), key)
    for x in excluded:
        merged = merged.join(x.select(key), key, "left_anti")
    columns = [F.col(f"{a}_{i}") for i in range(len(tables)) for a in alleles]
    return merged.where(F.size(F.array_distinct(F.array(*columns))) == 2)


def panel_join(one: DataFrame, two: DataFrame) -> DataFrame:
    """Inner join of two panels by variant and both alleles (O-102J)."""
    return one.join(two, ["snp", "a1", "a2"])


def align_alleles(data: DataFrame, reference: DataFrame, values: list[str], key: str = "snp") -> DataFrame:
    """Values with their sign changed where the first allele isn't the reference's (O-104J)."""
    ref = reference.select(F.col(key).alias("_key"), F.col("a1").alias("_a1"))
    joined = data.join(ref, F.col(key) == F.col("_key"))
    flip = F.col("_a1") != F.col("a1")
    return joined.select(*[F.when(flip, -F.col(c)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in data.columns])


def first_of_sources(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in order of the frames; of a repeated key the first is kept (O-027, O-116J)."""
    stacked = functools.reduce(DataFrame.unionByName, [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)])
    ranked = stacked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_source", *[c for c in frames[0].columns if c not in keys])))
    return ranked.where("_rank = 1").drop("_rank", "_source")
