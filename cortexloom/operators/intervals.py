"""Joins of points with intervals, of points with each other in a band, and lookups by floor.

An interval is dealt to the position buckets that it touches, so the join is an equi-join by contig
and bucket with the exact test applied to what meets; nothing is compared across buckets.  The four
boundary rules in use have names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: half_open [s, e); inside (s, e); closed [s, e]; block (s, e].
RULES = ("half_open", "inside", "closed", "block")
BUCKET = 1 << 16


def within(pos: Column, start: Column, end: Column, rule: str = "half_open") -> Column:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    low = pos >= start if rule in ("half_open", "closed") else pos > start
    high = pos <= end if rule in ("closed", "block") else pos < end
    return low & high


def parse_interval(text: str, genome: str | None = None) -> tuple[str, int, int]:
    """<contig>:<start>-<end> with start <= end; the contig spelled as the genome does (O-067)."""
    m = re.fullmatch(r"(?:chr)?(\w+):(\d+)-(\d+)", text.strip())
    if not m:
        raise ValueError(f"not an interval: {text!r}")
    contig, start, end = m[1], int(m[2]), int(m[3])
    if start > end:
        raise ValueError(f"{text!r} ends before it starts")
    return f"chr{contig}" if genome == "GRCh38" else contig, start, end


def filter_intervals(variants: DataFrame, intervals: list[tuple[str, int, int]], rule: str = "half_open") -> DataFrame:
    """Variants in any of the intervals (O-065, O-066): plain predicates that reach the scan."""
    test = F.lit(False)
    for contig, start, end in intervals:
        test = test | ((F.col("contig") == contig) & within(F.col("pos"), F.lit(start), F.lit(end), rule))
    return variants.where(test)


def interval_join(points: DataFrame, intervals: DataFrame, rule: str = "half_open", how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """points (contig, pos, ...) with intervals (contig, start, end, ...) that hold them (O-109J, O-110J, O-111J).

    how: inner, left_semi or left_anti.  A null position or bound meets nothing.
    """
    spread = intervals.where("start <= end").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    spread = spread.withColumnsRenamed({"contig": "_contig", "start": "_start", "end": "_end"})
    dealt = points.withColumn("_at", F.floor(F.col("pos") / bucket))
    on = (F.col("contig") == F.col("_contig")) & (F.col("_at") == F.col("_bucket")) & within(F.col("pos"), F.col("_start"), F.col("_end"), rule)
    if how != "inner":
        return dealt.join(spread, on, how).drop("_at")
    return dealt.join(spread, on).drop("_at", "_bucket", "_contig").withColumnsRenamed({"_start": "start", "_end": "end"})


def band_join(points: DataFrame, width: int, key: list[str], bucket: int | None = None) -> DataFrame:
    """Pairs i, j with equal contig and pos_i <= pos_j <= pos_i + width, j not before i in the order of (pos, key) (O-114J).

    Columns of the two sides are named <column>_i and <column>_j.
    """
    bucket = bucket or max(1, width)
    one = points.select([F.col(c).alias(f"{c}_i") for c in points.columns]).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("pos_i") / bucket), F.floor((F.col("pos_i") + width) / bucket))))
    two = points.select([F.col(c).alias(f"{c}_j") for c in points.columns]).withColumn("_at", F.floor(F.col("pos_j") / bucket))
    later = F.struct("pos_j", *[f"{k}_j" for k in key]) >= F.struct(F.col("pos_i").alias("pos_j"), *[F.col(f"{k}_i").alias(f"{k}_j") for k in key])
    on = (F.col("contig_i") == F.col("contig_j")) & (F.col("_bucket") == F.col("_at")) & (F.col("pos_j") <= F.col("pos_i") + width) & later
    return one.join(two, on).drop("_bucket", "_at")


def floor_index(values: list, target) -> int:
    """Index of the last element not above target, -1 if there is none (O-112J), for a short sorted list."""
    import bisect

    return bisect.bisect_right(values, target) - 1


def floor_join(points: DataFrame, marks: DataFrame, value: str, bucket: int = BUCKET) -> DataFrame:
    """For each point the last mark (contig, pos) not after it, null if there is none (O-112J).

    Points and marks are merged in one ordering for each contig and range of positions; what a range
    starts with is the last mark of the ranges before it.
    """
    tagged = points.select("*", F.floor(F.col("pos") / bucket).alias("_range"), F.lit(None).cast(marks.schema[value].dataType).alias("_mark"), F.lit(1).alias("_kind"))
    other = marks.select("contig", "pos", F.floor(F.col("pos") / bucket).alias("_range"), F.col(value).alias("_mark"), F.lit(0).alias("_kind"))
    both = other.unionByName(tagged, allowMissingColumns=True)
    order = Window.partitionBy("contig", "_range").orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("_local", F.last("_mark", ignorenulls=True).over(order))
    ranges = both.groupBy("contig", "_range").agg(F.max_by("_mark", F.when(F.col("_kind") == 0, F.col("pos"))).alias("_last"))
    before = Window.partitionBy("contig").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("contig", "_range", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    return local.where("_kind = 1").join(carried, ["contig", "_range"]).select(*points.columns, F.coalesce("_local", "_before").alias(value))


def sliding_windows(summary: DataFrame, length: int, step: int | None = None) -> DataFrame:
    """Windows [start + k*step, start + k*step + length) of each contig's range, none beyond its end (O-122)."""
    step = step or length // 2
    starts = F.when(F.col("start") + length <= F.col("end"), F.sequence(F.col("start"), F.col("end") - length, F.lit(step)))
    spread = summary.withColumn("_start", F.explode(starts))
    return spread.select("contig", F.col("_start").alias("start"), (F.col("_start") + length).alias("end"), F.concat_ws("_", F.col("contig").cast("string"), F.col("_start").cast("string")).alias("set_name"))


def window_members(points: DataFrame, summary: DataFrame, length: int, step: int | None = None) -> DataFrame:
    """points (contig, pos, ...) with set_name, start and end of the sliding windows that hold them, as interval_join with
    sliding_windows gives them: a point names its windows itself, so that only a row a contig is joined."""
    step = step or length // 2
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - F.col("_least") - length) / step) + 1)
    last = F.floor(F.least(F.col("pos") - F.col("_least"), F.col("_most") - length - F.col("_least")) / step)
    own = F.when((F.col("_least") + length <= F.col("_most")) & (F.col("pos") >= F.col("_least")) & (first <= last), F.sequence(first, last))
    spans = summary.select(F.col("contig").alias("_contig"), F.col("start").alias("_least"), F.col("end").alias("_most"))
    at = points.join(F.broadcast(spans), F.col("contig") == F.col("_contig")).withColumn("_k", F.explode(own))  # a row a contig
    start = (F.col("_least") + F.col("_k") * step).cast(summary.schema["start"].dataType)
    return at.withColumn("start", start).select(*points.columns, "start", (F.col("start") + length).alias("end"), F.concat_ws("_", F.col("contig").cast("string"), F.col("start").cast("string")).alias("set_name"))


def variant_sets(lines: DataFrame) -> DataFrame:
    """set_name, contig, start, end of lines `name chr:start-end` (O-011)."""
    pattern = r"^(\S+)\s+(?:chr)?(\w+):(\d+)-(\d+)\s*$"
    got = [F.regexp_extract("value", pattern, k) for k in (1, 2, 3, 4)]
    return lines.where(F.trim("value") != "").select(got[0].alias("set_name"), got[1].alias("contig"), got[2].cast("int").alias("start"), got[3].cast("int").alias("end"))


def assign_blocks(variants: DataFrame, partition: DataFrame, most: int = 2000, target: int = 1000) -> DataFrame:
    """LD blocks (O-113J, O-126): block of the interval (start, end] that holds the variant, the first one of a
    contig counting into its first block; empty blocks vanish, numbers run on; blocks of `most`
    variants or more are cut into parts of about `target`: columns block_idx, block_idx2."""
    first = partition.groupBy("contig").agg(F.min("start").alias("_least"))
    moved = variants.join(F.broadcast(first), "contig").withColumn("_pos", F.col("pos")).withColumn("pos", F.greatest(F.col("pos"), F.col("_least") + 1)).drop("_least")
    joined = interval_join(moved, partition, "block").withColumn("pos", F.col("_pos")).drop("_pos")
    sizes = joined.groupBy("contig", "start").agg(F.count("*").alias("_n"))
    number = Window.orderBy(F.col("contig").cast("int"), "start")  # over blocks: a few thousand rows
    sizes = sizes.select("contig", "start", "_n", (F.row_number().over(number) - 1).alias("block_idx"))
    parts = F.when(F.col("_n") >= most, F.floor(F.col("_n") / target)).otherwise(1)
    rank = F.row_number().over(Window.partitionBy("contig", "start").orderBy("pos", "snp")) - 1
    return joined.join(F.broadcast(sizes), ["contig", "start"]).withColumn("_rank", rank).withColumn("block_idx2", F.least(F.floor(F.col("_rank") / F.floor(F.col("_n") / parts)), parts - 1).cast("int")).drop("start", "end", "_n", "_rank")


def numbered(variants: DataFrame, order: list[str], bucket: int = 1 << 20) -> DataFrame:
    """The variants with _rank, from 0 in the order of `pos` and then `order` within the contig, and _n, its variants.

    Each range of `bucket` positions is numbered by itself and completed by a running count of the ranges
    before it, so that a task sorts a range and never a contig.  A null contig counts as one, null positions come first.
    """
    at = variants.withColumn("_range", F.floor(F.col("pos") / bucket))
    counts = at.groupBy("contig", "_range").agg(F.count("*").alias("_m"))
    own = Window.partitionBy("contig")
    before = F.sum("_m").over(own.orderBy(F.asc_nulls_first("_range")).rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(F.col("contig").alias("_contig"), F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_m").over(own).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("contig", "_range").orderBy("pos", *order)) - 1
    joined = at.withColumn("_rank", rank).join(base, F.col("contig").eqNullSafe(F.col("_contig")) & F.col("_range").eqNullSafe(F.col("_at")))
    return joined.select(*variants.columns, (F.col("_rank") + F.col("_base")).alias("_rank"), "_n")


def equal_blocks(variants: DataFrame, size: int, key: str = "snp", bucket: int = 1 << 20) -> DataFrame:
    """Blocks of equal size of each contig (O-123): ceil(n / size) of them, floor(n / blocks) each, the rest in the last.
    Ranks come by ranges of `bucket` positions, see `numbered`."""
    blocks = F.ceil(F.col("_n") / size)
    block = F.least(F.floor(F.col("_rank") / F.floor(F.col("_n") / blocks)), blocks - 1).cast("int")
    return numbered(variants, [key], bucket).select(*variants.columns, block.alias("block"))


def merge_by_size(sizes: list[int], target: int) -> list[int]:
    """Group number of each block, merged in order to about `target` groups (O-125): a block joins the group
    while the sum, or the sum with half of it, does not exceed the mean."""
    if not sizes:
        return []
    mean, out, now, group = sum(sizes) / target, [], 0, 0
    for s in sizes:
        if now and not (now + s <= mean or now + s // 2 <= mean):
            group, now = group + 1, 0
        out.append(group)
        now += s
    return out


def merge_every(blocks: list[tuple[str, int]], target: int = 100) -> list[tuple[str, int]]:
    """Every n // target-th block of each contig and its last, as group ends (O-124)."""
    every = max(1, len(blocks) // target)
    out = []
    for contig in dict.fromkeys(c for c, _ in blocks):
        own = [b for c, b in blocks if c == contig]
        ends = own[every - 1 :: every]
        out += [(contig, b) for b in ends] + ([(contig, own[-1])] if not ends or ends[-1] != own[-1] else [])
    return out


def row_index(variants: DataFrame, order: list[str], bucket: int = 1 << 20) -> DataFrame:
    """variant_idx from 0 in the order of contig and then `order`, whose first column is pos (O-121): ranges of
    `bucket` positions are numbered by themselves (`numbered`), a running count of the contigs completes that."""
    if order[0] != "pos":
        raise ValueError("rows are numbered by position first")
    counts = variants.groupBy("contig").agg(F.count("*").alias("_m"))
    base = counts.select(F.col("contig").alias("_contig"), F.coalesce(F.sum("_m").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranked = numbered(variants, order[1:], bucket).join(F.broadcast(base), F.col("contig").eqNullSafe(F.col("_contig")))  # a row a contig
    return ranked.select(*variants.columns, (F.col("_rank") + F.col("_base")).cast("long").alias("variant_idx"))


def band_sizes(variants: DataFrame, width: int, key: str, bucket: int = 1 << 20) -> DataFrame:
    """Number of variants from each one on with pos <= its pos + width (O-127), those at the same position before it left out.

    A task holds a range of positions, `bucket` or `width` + 1 wide, and the positions, with their counts, of the `width` behind it.
    """
    bucket = max(bucket, width + 1)
    places = variants.groupBy("contig", "pos").agg(F.count("*").alias("_m"))
    spread = places.withColumn("_range", F.explode(F.array_distinct(F.array(F.floor(F.col("pos") / bucket), F.floor((F.col("pos") - width) / bucket)))))
    ahead = F.sum("_m").over(Window.partitionBy("contig", "_range").orderBy("pos").rangeBetween(0, width))
    own = spread.withColumn("_ahead", ahead).where(F.col("_range").eqNullSafe(F.floor(F.col("pos") / bucket))).select(F.col("contig").alias("_contig"), F.col("pos").alias("_pos"), "_ahead")
    tied = F.row_number().over(Window.partitionBy("contig", "pos").orderBy(key)) - 1
    joined = variants.withColumn("_tied", tied).join(own, F.col("contig").eqNullSafe(F.col("_contig")) & F.col("pos").eqNullSafe(F.col("_pos")))
    return joined.select(*variants.columns, (F.col("_ahead") - F.col("_tied")).cast("long").alias("band"))


def check_order(info: DataFrame) -> DataFrame:
    """Rows that break `pos increases strictly within contig` in the order of row_id (O-129)."""
    before = F.lag("pos").over(Window.partitionBy("contig").orderBy("row_id"))
    return info.withColumn("_before", before).where("_before >= pos").drop("_before")
