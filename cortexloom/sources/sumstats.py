"""Association results: native parquet, quality control into summary statistics, and result files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import ids, variants

EFFECTS = ["beta", "standard_error", "t_stat", "p_value"]


def write_gwas(result: DataFrame, path: str) -> None:
    """Scalars and arrays, one row a variant (O-041)."""
    result.write.mode("overwrite").parquet(path)


def read_gwas(spark: SparkSession, path: str, effects: bool = True) -> DataFrame:
    """Native results; without effects only the variants' columns are read (O-022)."""
    table = spark.read.parquet(path)
    return table if effects else table.drop(*EFFECTS)


def quality_control(gwas: DataFrame, maf_min: float | None = None, info_min: float | None = None, effects: list[str] = ("effect", "se", "z", "p")) -> DataFrame:
    """Rows of an association table that pass (O-043, O-076 to O-080, O-108): complete, unique rsID, not strand
    ambiguous, sample size at least int(90th percentile / 1.5), MAF and INFO at least their minima."""
    kept = ids.unique_keys(gwas, ["snp"])
    numbers = [c for c in effects if c in gwas.columns]
    kept = variants.finite_rows(kept.na.drop(subset=[c for c in ("chr", "pos", "snp", "a1", "a2", "n") if c in gwas.columns]), numbers) if numbers else kept.na.drop()
    if "maf" in gwas.columns:
        kept = kept.where(F.col("maf") >= (0.01 if maf_min is None else maf_min))
    if "info" in gwas.columns:
        kept = kept.where(F.col("info") >= (0.9 if info_min is None else info_min))
    kept = kept.where(~C.strand_ambiguous(F.col("a1"), F.col("a2")))
    return variants.sample_size_filter(kept)


def with_z(gwas: DataFrame, odds: bool = False) -> DataFrame:
    """z from what the table has: effect and se, or effect and p (O-156)."""
    if "z" in gwas.columns:
        return gwas
    null = 1.0 if odds else 0.0
    se = F.col("se") if "se" in gwas.columns else None
    return gwas.withColumn("z", C.z_from_effect(F.col("effect"), se, None if se is not None else F.col("p"), null))


def save(stats: DataFrame, path: str) -> None:
    """Summary statistics as one table with its row count kept beside it (O-043)."""
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    stats.sparkSession.createDataFrame([(stats.sparkSession.read.parquet(f"{path}/stats").count(),)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/count")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table, if it has as many rows as were written (O-023)."""
    stats = spark.read.parquet(f"{path}/stats")
    if stats.count() != spark.read.parquet(f"{path}/count").first()[0]:
        raise ValueError(f"{path}: rows are missing")
    return stats


def components(array: str, start: int, count: int) -> Column:
    """A block of components (O-024, O-088, O-132S)."""
    return F.slice(array, start + 1, count)


def write_tsv(result: DataFrame, path: str, scientific: list[str], order: list[str]) -> None:
    """Tab-separated text with a header, numbers as %.5e, NA for missing, in order (O-044, O-045, O-158)."""
    columns = [F.coalesce(C.scientific(F.col(c)), F.lit("NA")).alias(c) if c in scientific else F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in result.columns]
    result.orderBy(*order).select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


#: Columns of the index of results, and of a null association table without header.
INDEX_COLUMNS = ("VARIANT_SET", "CHR", "START", "END", "RESULT_FILE")
NULL_COLUMNS = ("SAMPLE_ID", "GENE_ID", "INDEX", "STAAR-O")


def write_sets(result: DataFrame, path: str, sets: DataFrame | None = None) -> DataFrame:
    """Results by variant set as one table sorted by set, and the index of its sets (O-048), which is returned.

    sets: (set_name, contig, start, end).  The rows of a set lie together, so that a scan for one reads what
    its footers do not exclude; a folder for each gene would make as many files as there are genes."""
    result.repartitionByRange("set_name").sortWithinPartitions("set_name").write.mode("overwrite").parquet(f"{path}/results")
    found = result.sparkSession.read.parquet(f"{path}/results").select("set_name").distinct()
    if sets is None:
        placed = found.select("set_name", *[F.lit(None).cast(t).alias(c) for c, t in (("contig", "string"), ("start", "int"), ("end", "int"))])
    else:
        placed = found.join(sets.select("set_name", "contig", "start", "end"), "set_name", "left")
    index = placed.select(F.col("set_name").alias("VARIANT_SET"), F.col("contig").alias("CHR"), F.col("start").alias("START"), F.col("end").alias("END"), F.lit(f"{path}/results").alias("RESULT_FILE"))
    index.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/index")
    return read_index(result.sparkSession, f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of results (O-037)."""
    index = spark.read.option("sep", "\t").option("header", True).csv(path)
    if lacking := [c for c in INDEX_COLUMNS if c not in index.columns]:
        raise ValueError(f"{path} lacks {lacking}")
    return index.select("VARIANT_SET", "CHR", F.col("START").cast("int").alias("START"), F.col("END").cast("int").alias("END"), "RESULT_FILE")


def read_results(spark: SparkSession, index: DataFrame, most_files: int = 100_000) -> DataFrame:
    """The results that an index names, of its sets only (O-037): each file is read once, columns that a file lacks are null."""
    files = sorted(r[0] for r in index.select("RESULT_FILE").distinct().limit(most_files + 1).collect())
    if len(files) > most_files:
        raise ValueError(f"an index of more than {most_files} files")
    if not files:
        raise ValueError("an empty index")
    rows = stack([spark.read.parquet(f) for f in files]) if len(files) < 50 else spark.read.option("mergeSchema", True).parquet(*files)
    return rows.join(index.select(F.col("VARIANT_SET").alias("_set")).distinct(), F.col("set_name") == F.col("_set"), "left_semi")


def stack(frames: list[DataFrame]) -> DataFrame:
    """Result frames one below the other, columns by name, null where a frame lacks one (O-137S, O-138S)."""
    if not frames:
        raise ValueError("nothing to stack")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_null(rows: DataFrame, path: str) -> None:
    """Add replicates of a null distribution (O-049)."""
    rows.write.mode("append").parquet(path)


def append_null_text(rows: DataFrame, path: str) -> None:
    """The same as tab-separated text without header: (sample_id, gene_id, index, p) (O-049)."""
    rows.select("sample_id", "gene_id", "index", "p").write.mode("append").option("sep", "\t").csv(path)


def read_null_associations(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, gene_id, index, p of a headerless table of NULL_COLUMNS (O-038)."""
    raw = spark.read.option("sep", "\t").schema("SAMPLE_ID string, GENE_ID string, INDEX int, `STAAR-O` double").csv(path)
    return raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(NULL_COLUMNS, ("sample_id", "gene_id", "index", "p"))])


def check_points(null: DataFrame, total_points: int) -> int:
    """Replicates and genes of a null table; raises unless `total_points` is greater (O-038)."""
    n = null.select("sample_id", "gene_id").distinct().count()
    if total_points <= n:
        raise ValueError(f"{total_points} points in all, but {n} of them are in the table")
    return n


def import_frame(spark: SparkSession, frame, keys: list[str], most_bytes: int = 1 << 30) -> DataFrame:
    """A small pandas table as a DataFrame (O-036): NaN as null, keys as text and without null or repetition."""
    if frame.memory_usage(deep=True).sum() > most_bytes:
        raise ValueError("too large to pass through the driver: write it as a table and read that")
    if frame[keys].isna().any().any() or frame.duplicated(keys).any():
        raise ValueError(f"{keys} are null or repeat")
    out = spark.createDataFrame(frame)
    return out.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in keys else C.flat(F.col(f"`{c}`")).alias(c) if out.schema[c].dataType.typeName() == "double" else F.col(f"`{c}`") for c in out.columns])


def save_matrix(spark: SparkSession, matrix, path: str, name: str = "value") -> None:
    """A small dense matrix in long form (i, j, value) (O-045, O-051)."""
    rows = [(i, j, float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
    spark.createDataFrame(rows, f"i int, j int, {name} double").write.mode("overwrite").parquet(path)


def annotation_table(raw: DataFrame, names: dict[str, str], weights: list[str]) -> DataFrame:
    """contig, pos, ref, alt and a struct `annot` of renamed columns (O-047, O-090): a `variant` column
    chr:pos:ref:alt, or `variant_vcf` with dashes; weights as numbers, missing CADD as 0."""
    source = F.translate(F.col("variant_vcf"), "-", ":") if "variant_vcf" in raw.columns else F.col("variant")
    values = []
    for own, std in names.items():
        c = F.col(f"`{own}`")
        c = c.cast("double") if std in weights else c
        values.append((F.coalesce(c, F.lit(0.0)) if std == "CADD" else c).alias(std))
    out = raw.select(*C.parse_variant(source), F.struct(*values).alias("annot")).where("pos is not null")
    if not out.limit(1).count():
        raise ValueError("no annotation is left")
    return out
