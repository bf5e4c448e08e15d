"""Tables that one analysis leaves for the next: LD factors, null models, predictions, scores, permutation nulls."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import check_order


def save_ld(blocks: DataFrame, path: str) -> None:
    """LD blocks as one table (O-046); MAF and scores with four digits are a matter of display, kept in full here."""
    blocks.write.mode("overwrite").parquet(path)


def load_ld(spark: SparkSession, paths: list[str]) -> DataFrame:
    """LD blocks of several files with block numbers that run on (O-025); positions that don't increase within a contig raise."""
    out, base = None, 0
    for p in paths:
        part = spark.read.parquet(p)
        if "row_id" in part.columns and check_order(part).limit(1).count():
            raise ValueError(f"{p}: positions are not increasing and unique")
        blocks = part.agg(F.max("block_idx")).first()[0]  # one number
        part = part.withColumn("block_idx", (F.col("block_idx") + base).cast("int"))
        out = part if out is None else out.unionByName(part)
        base += (blocks if blocks is not None else -1) + 1
    return out


def save_null(null: DataFrame, bases: DataFrame, path: str) -> None:
    """Null model (iid, x, resid) and bases (O-051)."""
    null.write.mode("overwrite").parquet(f"{path}/subjects")
    bases.write.mode("overwrite").parquet(f"{path}/bases")


def load_null(spark: SparkSession, path: str, components: int | None = None, voxels: list[int] | None = None, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Subjects and bases, of the first components, chosen voxels and kept subjects (O-031)."""
    null, bases = spark.read.parquet(f"{path}/subjects"), spark.read.parquet(f"{path}/bases")
    if components:
        null, bases = null.withColumn("resid", F.slice("resid", 1, components)), bases.withColumn("b", F.slice("b", 1, components))
    if voxels is not None:
        bases = bases.where(F.col("voxel").isin(list(voxels)))
    if keep is not None:
        null = null.join(keep.select("iid"), "iid", "left_semi")
    return null, bases


def save_loco(predictions: DataFrame, subjects: list, path: str) -> None:
    """Predictions (ldr, contig, pred array over subjects) as (iid, contig, pred array over components) (O-051)."""
    spark = predictions.sparkSession
    names = spark.createDataFrame([(i, s) for i, s in enumerate(subjects)], ["_k", "iid"])
    long = predictions.select("ldr", "contig", F.posexplode("pred").alias("_k", "_p")).join(names, "_k")
    arrays = long.groupBy("iid", "contig").agg(F.array_sort(F.collect_list(F.struct("ldr", "_p"))).alias("_a"))
    arrays.select("iid", "contig", F.transform("_a", lambda s: s["_p"]).alias("pred")).write.mode("overwrite").partitionBy("contig").parquet(path)


def load_loco(spark: SparkSession, path: str, contig: str | None = None, start: int = 0, count: int | None = None) -> DataFrame:
    """Predictions of a contig, whose folder alone is read, for a block of components (O-030)."""
    table = spark.read.parquet(path).withColumn("contig", F.col("contig").cast("string"))
    table = table if contig is None else table.where(F.col("contig") == contig)
    return table.withColumn("pred", F.slice("pred", start + 1, count or 1_000_000))


def save_scores(summary: DataFrame, ld: DataFrame, path: str) -> None:
    """Rare-variant scores and projections, and the upper half of the banded LD (O-051, O-176, O-177)."""
    summary.write.mode("overwrite").parquet(f"{path}/variants")
    ld.write.mode("overwrite").parquet(f"{path}/ld")


def load_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/variants"), spark.read.parquet(f"{path}/ld")


def save_permutations(merged: DataFrame, path: str) -> None:
    """bin, voxel, stats, count (O-050)."""
    merged.write.mode("overwrite").partitionBy("bin").parquet(path)


def load_permutations(spark: SparkSession, path: str, voxels: int) -> dict:
    """bin -> (ascending statistics of each voxel, count), as the burden test looks them up (O-033): what was kept of
    a null is a fixed small share of it."""
    out: dict = {}
    for r in spark.read.parquet(path).collect():
        kept, count = out.setdefault(r["bin"], ([np.zeros(0)] * voxels, r["count"]))
        kept[r["voxel"] - 1] = np.array(r["stats"])
    return out
