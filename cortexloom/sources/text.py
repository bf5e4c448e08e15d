"""Text tables: subjects, ID and variant lists, partitions, sets, external association results."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ids

#: Tokens that mean missing.
MISSING = ["-9", "NONE", ".", "NA", "NaN", "nan", ""]
REFUSED = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2")
BLANKS = r"\s+"


def check_compression(path: str) -> str | None:
    """Codec of a text path by its ending (O-002): gz, bgz and bz2 are read, archives are refused."""
    if path.lower().endswith(REFUSED):
        raise ValueError(f"{path}: archives are not read")
    for end, codec in ((".gz", "gzip"), (".bgz", "gzip"), (".bz2", "bzip2")):
        if path.lower().endswith(end):
            return codec
    return None


def expand(pattern: str) -> list[str]:
    """prefix{a:b}suffix as the paths from a to b, both included, in either order; else a comma-separated list (O-012)."""
    m = re.fullmatch(r"(.*)\{(\d*):(\d*)\}(.*)", pattern)
    if not m:
        return [p.strip() for p in pattern.split(",")]
    if not (m[2] and m[3]):
        raise ValueError(f"{pattern}: a range has two ends")
    a, b = sorted((int(m[2]), int(m[3])))
    return [f"{m[1]}{i}{m[4]}" for i in range(a, b + 1)]


def expand_columns(text: str) -> tuple[int, int]:
    """Consecutive one-based columns `a:b` or `a,b,c` as a zero-based range [start, end) (O-160)."""
    picked: list[int] = []
    for part in text.split(","):
        a, _, b = part.strip().partition(":")
        lo, hi = int(a), int(b or a)
        if lo < 1 or hi < lo:
            raise ValueError(f"columns are one-based and in order: {text!r}")
        picked += range(lo, hi + 1)
    if picked != list(range(picked[0], picked[0] + len(picked))):
        raise ValueError(f"columns are consecutive: {text!r}")
    return picked[0] - 1, picked[-1]


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else paths
    for p in paths:
        check_compression(p)
    bgz = [p for p in paths if p.lower().endswith(".bgz")]
    if bgz:  # Spark chooses a codec by the ending
        from .blocks import read_lines

        got = read_lines(spark, bgz)
        rest = [p for p in paths if p not in bgz]
        return got.unionByName(spark.read.text(rest)) if rest else got
    return spark.read.text(paths)


def header_of(spark: SparkSession, path: str) -> list[str]:
    return re.split(BLANKS, lines(spark, path).first()[0].strip())


def missing_as_null(c: Column) -> Column:
    return F.when(c.isin(MISSING), None).otherwise(c)


def read_subjects(spark: SparkSession, path: str, numeric: bool = True) -> DataFrame:
    """fid, iid and further columns of a headed whitespace table (O-001): FID IID first, one more column at
    least, names once; rows with a missing value and all rows of a repeated subject are dropped."""
    head = header_of(spark, path)
    if head[:2] != ["FID", "IID"] or len(head) < 3:
        raise ValueError(f"{path}: the header starts with FID IID and has another column")
    if len(set(head)) < len(head):
        raise ValueError(f"{path}: a column name repeats")
    parts = F.split(F.trim("value"), BLANKS)
    body = lines(spark, path).where(F.trim("value") != "").where(~((parts.getItem(0) == "FID") & (parts.getItem(1) == "IID")))
    columns = [missing_as_null(parts.getItem(i)).alias({"FID": "fid", "IID": "iid"}.get(c, c)) for i, c in enumerate(head)]
    rows = body.select(*columns)
    if numeric:
        rows = rows.select("fid", "iid", *[F.col(c).try_cast("double").alias(c) for c in head[2:]])
    return ids.unique_keys(rows.na.drop(), ids.SUBJECT)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """fid, iid of a list, with or without header (O-003, O-004)."""
    parts = F.split(F.trim("value"), BLANKS)
    rows = lines(spark, path).where(F.trim("value") != "")
    if rows.where(F.size(parts) < 2).limit(1).count():
        raise ValueError(f"{path}: a list of subjects has FID and IID")
    return rows.select(parts.getItem(0).alias("fid"), parts.getItem(1).alias("iid")).where("not (fid = 'FID' and iid = 'IID')").distinct()


def _filled(frames: list[DataFrame]) -> list[DataFrame]:
    return [f for f in frames if f.limit(1).count()]


def read_keep(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Intersection of the lists that aren't empty (O-003)."""
    frames = _filled([read_ids(spark, p) for p in paths])
    if not frames or not (out := ids.intersect_ids(frames)).limit(1).count():
        raise ValueError("no subject is in all lists")
    return out


def read_remove(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of the lists (O-004)."""
    return ids.union_ids([read_ids(spark, p) for p in paths])


def read_variant_list(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).where(F.trim("value") != "").select(F.split(F.trim("value"), BLANKS).getItem(0).alias("snp"))


def read_extract(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Inner merge of the lists (O-005); no common variant raises."""
    out = ids.merge_lists(_filled([read_variant_list(spark, p) for p in paths]), "snp")
    if not out.limit(1).count():
        raise ValueError("no variant is in all lists")
    return out


def read_exclude(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct variants of any list (O-006)."""
    return functools.reduce(DataFrame.unionByName, [read_variant_list(spark, p) for p in paths]).dropDuplicates()


def read_loci(spark: SparkSession, paths: list[str], every: bool = True) -> DataFrame:
    """contig, pos of lists of chr:pos, in all lists (O-007) or in any (O-008)."""
    frames = []
    for p in paths:
        parts = F.split(F.split(F.trim("value"), BLANKS).getItem(0), ":")
        frames.append(lines(spark, p).where(F.trim("value") != "").select(F.regexp_replace(parts.getItem(0), "^chr", "").alias("contig"), parts.getItem(1).cast("int").alias("pos")).distinct())
    if every:
        return functools.reduce(lambda a, b: a.join(b, ["contig", "pos"], "left_semi"), _filled(frames) or frames[:1])
    return functools.reduce(DataFrame.unionByName, frames).distinct()


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end of a headerless genome partition (O-009)."""
    parts = F.split(F.trim("value"), BLANKS)
    rows = lines(spark, path).where(F.trim("value") != "")
    if rows.where(~F.trim("value").rlike(r"^\d+\s+\d+\s+\d+$")).limit(1).count():
        raise ValueError(f"{path}: a partition has three integers a line")
    return rows.select(*[parts.getItem(i).cast("int").alias(c) for i, c in enumerate(("contig", "start", "end"))])


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """Zero-based voxels of a one-based list (O-010)."""
    return lines(spark, path).where(F.trim("value") != "").select((F.split(F.trim("value"), BLANKS).getItem(0).cast("int") - 1).alias("voxel"))


def read_variant_sets(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.intervals import variant_sets

    return variant_sets(lines(spark, path))


#: Standard name of the columns of an association table, by option.
GWAS_COLUMNS = ("chr", "pos", "snp", "a1", "a2", "n", "effect", "se", "z", "p", "maf", "info")


def read_gwas_text(spark: SparkSession, path: str, names: dict[str, str], n: int | None = None) -> DataFrame:
    """An external association table under standard names (O-021, O-089): names maps standard to own names; the
    delimiter is a tab if the header has more tabs than spaces; alleles in upper case."""
    head = lines(spark, path).first()[0]
    sep = "\t" if head.count("\t") > head.count(" ") else " "
    if unknown := set(names) - set(GWAS_COLUMNS):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    raw = spark.read.csv(path, sep=sep, header=True)
    if lacking := set(names.values()) - set(raw.columns):
        raise ValueError(f"{path} lacks {sorted(lacking)}")
    kinds = {"chr": "string", "snp": "string", "a1": "string", "a2": "string", "pos": "int"}
    cols = []
    for std, own in names.items():
        c = missing_as_null(F.col(f"`{own}`"))
        c = F.upper(c) if std in ("a1", "a2") else c
        cols.append(c.cast(kinds.get(std, "double")).alias(std))
    out = raw.select(*cols)
    return out if n is None else out.withColumn("n", F.lit(float(n)))


def read_annotations(spark: SparkSession, paths: str | list[str], favor: bool = True) -> DataFrame:
    """Annotation CSVs (O-020): comma-separated with quotes, or any blanks."""
    if favor:
        return spark.read.csv(paths, header=True, sep=",", quote='"', nullValue="")
    first = [paths] if isinstance(paths, str) else paths
    head = header_of(spark, first[0])
    parts = F.split(F.trim("value"), BLANKS)
    return lines(spark, paths).where(parts.getItem(0) != head[0]).select(*[missing_as_null(parts.getItem(i)).alias(c) for i, c in enumerate(head)])


def read_promoters(spark: SparkSession, path: str, genome: str | None = None) -> DataFrame:
    """contig, start, end of promoter regions (O-034): a Parquet table, or text of three columns as a genome partition has them."""
    from ..functions.columns import recode_contig

    table = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_partition(spark, path)
    if lacking := [c for c in ("contig", "start", "end") if c not in table.columns]:
        raise ValueError(f"{path} lacks {lacking}")
    contig = F.col("contig").cast("string")
    return table.select((recode_contig(contig, genome) if genome else contig).alias("contig"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).where("start <= end").distinct()
