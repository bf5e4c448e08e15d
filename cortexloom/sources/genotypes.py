"""Genotype files: PLINK (a Python data source), VCF, and sparse tables."""

from __future__ import annotations

import base64
import os
import re
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions.columns import recode_contig
from .text import BLANKS, lines

#: The two-bit codes of a bed file, lowest first, as counts of the first allele; -1 is missing.
BED_CODES = (2, -1, 1, 0)
BED_MAGIC = b"\x6c\x1b\x01"
CHUNK = 4096


def read_bim(spark: SparkSession, prefix: str) -> DataFrame:
    """snp_idx, contig, snp, cm, pos, a1, a2 (O-013); the index is the line's place in the file."""
    parts = F.split(F.trim("value"), BLANKS)
    rows = _numbered(spark, f"{prefix}.bim").select("idx", *[parts.getItem(i).alias(c) for i, c in enumerate(("contig", "snp", "cm", "pos", "a1", "a2"))])
    return rows.select(F.col("idx").alias("snp_idx"), "contig", "snp", F.col("cm").cast("double").alias("cm"), F.col("pos").cast("int").alias("pos"), "a1", "a2")


def read_fam(spark: SparkSession, prefix: str) -> DataFrame:
    """iid_idx, fid, iid (O-013)."""
    parts = F.split(F.trim("value"), BLANKS)
    return _numbered(spark, f"{prefix}.fam").select(F.col("idx").alias("iid_idx"), parts.getItem(0).alias("fid"), parts.getItem(1).alias("iid"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """value and its line number: the order of the file, by RDD as SQL has none."""
    schema = "value string, idx long"
    return spark.createDataFrame(spark.read.text(path).where(F.trim("value") != "").rdd.map(lambda r: r[0]).zipWithIndex(), schema)


def filesystem(path: str):
    """An Arrow file system and the path in it: a local or shared folder, or any store that Arrow can open."""
    import pyarrow.fs as fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path
    return fs.FileSystem.from_uri(path)


def sample_bits(keep: np.ndarray) -> str:
    """The samples that are kept, as text: a bit for each in their order."""
    return base64.b64encode(zlib.compress(np.packbits(keep, bitorder="little").tobytes())).decode()


def packed_mask(bits: str | None, n: int) -> np.ndarray:
    """Two bits for each of n samples, 3 for those kept, in words of 64; None: all of them."""
    keep = np.ones(n, bool) if bits is None else np.unpackbits(np.frombuffer(zlib.decompress(base64.b64decode(bits)), np.uint8), bitorder="little")[:n].astype(bool)
    two = np.zeros(-(-n // 32) * 64, bool)
    two[: 2 * n] = np.repeat(keep, 2)
    return np.packbits(two, bitorder="little").view("<u8")


def packed_counts(raw: np.ndarray, n: int, mask: np.ndarray) -> np.ndarray:
    """variants x (first allele twice, missing, once, none) of packed calls: bits counted by words, nothing is unpacked.

    raw: variants x bytes; mask: of packed_mask."""
    words = np.zeros((len(raw), len(mask) * 8), np.uint8)
    words[:, : raw.shape[1]] = raw
    words = words.view("<u8")
    low, high = words & mask & _LOW, (words & mask) >> np.uint64(1) & _LOW
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    none, missing, one = count(low & high), count(low & ~high), count(high & ~low)
    kept = int(np.bitwise_count(mask & _LOW).sum())
    return np.column_stack([kept - none - missing - one, missing, one, none])


_LOW = np.uint64(0x5555555555555555)


class BedPartition(InputPartition):
    """Variants [start, end), from row `row` of a file on."""

    def __init__(self, name: str, start: int, end: int, row: int):
        self.name, self.start, self.end, self.row = name, start, end, row


_RANGES = {EqualTo: lambda v: (v, v + 1), GreaterThan: lambda v: (v + 1, None), GreaterThanOrEqual: lambda v: (v, None), LessThan: lambda v: (None, v), LessThanOrEqual: lambda v: (None, v + 1)}


class BedReader(DataSourceReader):
    """Variants of a partition are read at their place in the file (O-014), or of the file of a folder of parts.

    Options: samples, variants, and keep, the bits of the samples to read.  Conditions on snp_idx leave the other
    partitions unread.  With counts asked for, calls are not unpacked."""

    def __init__(self, options: dict, counts: bool):
        self.path, self.n, self.m, self.bits, self.counts = options["path"], int(options["samples"]), int(options["variants"]), options.get("keep"), counts
        self.width = (self.n + 3) // 4
        self.low, self.high = 0, self.m

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if f.attribute != ("snp_idx",) or type(f) not in _RANGES and not isinstance(f, IsNotNull):
                yield f
            elif type(f) in _RANGES:
                low, high = _RANGES[type(f)](f.value)
                self.low, self.high = max(self.low, low if low is not None else 0), min(self.high, high if high is not None else self.m)

    def partitions(self):
        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        if info.type.name == "Directory":
            from pyarrow.fs import FileSelector

            parts = sorted((int(f.base_name[5:-4]), f.path, f.size) for f in fs.get_file_info(FileSelector(root)) if re.fullmatch(r"part-\d+\.bed", f.base_name))
        else:
            parts = [(0, root, info.size)]
        out, at = [], 0
        for start, path, size in parts:
            with fs.open_input_file(path) as f:
                if f.read(3) != BED_MAGIC:
                    raise ValueError(f"{path}: not a variant-major bed file")
            rows = (size - 3) // max(1, self.width)
            if start != at or size != 3 + self.width * rows:
                raise ValueError(f"{path}: its size or place does not fit {self.m} variants of {self.n} samples")
            at += rows
            low, high = max(start, self.low), min(at, self.high)
            out += [BedPartition(path, k, min(k + CHUNK, high), k - start) for k in range(low, high, CHUNK)]
        if at != self.m:
            raise ValueError(f"{self.path}: its size does not fit {self.m} variants of {self.n} samples")
        return out or [BedPartition("", 0, 0, 0)]

    def read(self, part: BedPartition):
        if not part.name:
            return
        fs, _ = filesystem(self.path)
        rows, index = part.end - part.start, pa.array(np.arange(part.start, part.end))
        with fs.open_input_file(part.name) as f:
            f.seek(3 + self.width * part.row)
            raw = np.frombuffer(f.read(self.width * rows), np.uint8).reshape(rows, self.width)
        mask = packed_mask(self.bits, self.n)
        if self.counts:
            yield pa.RecordBatch.from_arrays([index, *map(pa.array, packed_counts(raw, self.n, mask).T)], names=["snp_idx", *COUNTS])
            return
        keep = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[: 2 * self.n : 2])
        codes = np.array(BED_CODES, np.int8)[raw[:, keep >> 2] >> (2 * (keep & 3)).astype(np.uint8) & 3]
        values = pa.array(codes.ravel(), mask=codes.ravel() < 0)
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * len(keep))
        yield pa.RecordBatch.from_arrays([index, pa.ListArray.from_arrays(offsets, values)], names=["snp_idx", "dosages"])


#: What is counted of a variant: samples with the first allele twice, without a call, with one, with none.
COUNTS = ("n_two", "n_missing", "n_one", "n_none")


class BedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self) -> str:
        return "snp_idx long, dosages array<tinyint>"

    def reader(self, schema) -> BedReader:
        return BedReader(dict(self.options), False)


class BedCountSource(BedSource):
    @classmethod
    def name(cls) -> str:
        return "plink_counts"

    def schema(self) -> str:
        return "snp_idx long, " + ", ".join(f"{c} long" for c in COUNTS)

    def reader(self, schema) -> BedReader:
        return BedReader(dict(self.options), True)


def open_bed(spark: SparkSession, path: str, samples: int, variants: int, counts: bool = False, keep: np.ndarray | None = None) -> DataFrame:
    """(snp_idx, dosages), or with `counts` the counts of each variant from the packed calls (O-105); keep: which samples are read."""
    spark.dataSource.register(BedSource)
    spark.dataSource.register(BedCountSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("plink_counts" if counts else "plink_bed").option("samples", samples).option("variants", variants)
    return (reader if keep is None else reader.option("keep", sample_bits(keep))).load(path)


def packed_qc(counts: DataFrame, n: int) -> DataFrame:
    """Columns of variant_qc from the counts of n samples."""
    called, ac = F.lit(n) - F.col("n_missing"), 2 * F.col("n_two") + F.col("n_one")
    af = F.try_divide(ac, 2 * called)
    return counts.select(F.col("snp_idx").alias("variant"), called.alias("n_called"), F.col("n_one").alias("n_het"), F.col("n_two").alias("n_hom_alt"), ac.alias("ac"), af.alias("af"), (called / n).alias("call_rate"), F.least(af, 1 - af).alias("maf"), F.least(ac, 2 * called - ac).alias("mac"))


def read_plink(spark: SparkSession, prefix: str, genome: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """bim with maf, fam, and (snp_idx, dosages) (O-014 to O-016)."""
    bim, fam = read_bim(spark, prefix), read_fam(spark, prefix)
    n, m = fam.count(), bim.count()
    bed = open_bed(spark, f"{prefix}.bed", n, m)
    mafs = packed_qc(open_bed(spark, f"{prefix}.bed", n, m, counts=True), n).select(F.col("variant").alias("_i"), "maf")
    bim = bim.join(mafs, F.col("snp_idx") == F.col("_i")).drop("_i")
    return (bim.withColumn("contig", recode_contig(F.col("contig"), genome)) if genome else bim), fam, bed


def _packed(dosages: np.ndarray) -> bytes:
    """variants x samples dosages (2, 1, 0, negative for missing) as packed calls."""
    code = np.zeros(dosages.shape, np.uint8)
    for k, v in enumerate(BED_CODES):
        code[(dosages == v) if v >= 0 else (dosages < 0)] = k
    pad = np.zeros((len(code), -code.shape[1] % 4), np.uint8)
    four = np.hstack([code, pad]).reshape(len(code), -1, 4)
    return (four << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2).astype(np.uint8).tobytes()


def write_bed(path: str, dosages: np.ndarray) -> None:
    """Write a matrix as a bed file; for tests and small panels."""
    with open(path, "wb") as f:
        f.write(BED_MAGIC + _packed(dosages))


def save_bed(bed: DataFrame, path: str, samples: int) -> int:
    """Write (snp_idx from 0 on, dosages array) as packed calls from the executors; the number of variants.

    On a local or shared file system it is one file, whose rows each task puts at their place, so a task that is run
    again writes the same bytes to the same place; in other stores, which have no such writes, it is a folder of
    parts named by their first variant.  An index that is missing or there twice raises, as does a row of another length.
    """
    fs, root = filesystem(path)
    whole = type(fs).__name__ == "LocalFileSystem"
    width = (samples + 3) // 4
    if whole:
        fs.create_dir(root.rpartition("/")[0] or "/", recursive=True)
        with open(root, "wb") as f:
            f.write(BED_MAGIC)
    else:
        fs.create_dir(root, recursive=True)

    def run(batches):
        held, first, n, out = [], None, 0, None
        fs, root = filesystem(path)

        def flush():
            nonlocal held, out
            data = b"".join(held)
            if whole:
                with open(root, "r+b") as f:
                    os.pwrite(f.fileno(), data, 3 + width * (first + n - len(data) // max(1, width)))
            else:
                if out is None:
                    out = fs.open_output_stream(f"{root}/part-{first:012d}.bed", compression=None)
                    out.write(BED_MAGIC)
                out.write(data)
            held = []

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                index, lists = piece.column("snp_idx").to_numpy(), piece.column("dosages")
                first = int(index[0]) if first is None else first
                if (index != first + n + np.arange(len(index))).any():
                    raise ValueError(f"variants from {first + n} on are missing or there twice")
                if lists.null_count or (pc.list_value_length(lists).to_numpy() != samples).any():
                    raise ValueError(f"variants without {samples} dosages")
                held.append(_packed(pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).reshape(-1, samples)))
                n += len(index)
                if sum(map(len, held)) >= 16 << 20:
                    flush()
        if n:
            flush()
            if out is not None:
                out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([n])], names=["first", "n"])

    rows = bed.select(F.col("snp_idx").cast("long"), F.col("dosages").cast("array<tinyint>")).repartitionByRange("snp_idx").sortWithinPartitions("snp_idx")
    at = 0
    for r in sorted(rows.mapInArrow(run, "first long, n long").collect()):  # a row a task
        if r["first"] != at:
            raise ValueError(f"variants from {min(at, r['first'])} on are missing or there twice")
        at += r["n"]
    return at


def to_sparse(bed: DataFrame, fam: DataFrame) -> DataFrame:
    """variant, iid, dosage of nonzero and missing (null) entries (O-042)."""
    long = bed.select(F.col("snp_idx").alias("variant"), F.posexplode("dosages").alias("iid_idx", "dosage")).where("dosage is null or dosage > 0")
    return long.join(fam.select("iid_idx", "iid"), "iid_idx").select("variant", "iid", "dosage")


def read_vcf(spark: SparkSession, path: str, genome: str | None = None, intervals: list[tuple[str, int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """variants (contig, pos, rsid, ref, alt, filters, info) and geno (contig, pos, ref, alt, iid, dosage) of
    biallelic records of a .vcf, .vcf.gz or .vcf.bgz (O-017).

    intervals: (contig as in the file, first, last): only records in them; stretches of a block-gzip file without any
    are not read if it has a tabix index.  Sample names are a table of the header line's columns, joined to the calls.
    """
    if not path.endswith((".vcf", ".vcf.gz", ".vcf.bgz")):
        raise ValueError(f"{path}: .vcf, .vcf.gz or .vcf.bgz")
    from .blocks import read_lines

    text = lines(spark, path) if path.endswith(".vcf") else read_lines(spark, [path], intervals)
    header = (lines(spark, path) if path.endswith(".vcf") else read_lines(spark, [path], [])).where(F.col("value").startswith("#CHROM"))
    samples = header.select(F.posexplode(F.slice(F.split("value", "\t"), 10, F.greatest(F.lit(1), F.size(F.split("value", "\t")) - 9))).alias("_k", "iid"))
    parts = F.split("value", "\t")
    body = text.where(~F.col("value").startswith("#") & (F.col("value") != "")).where(~parts.getItem(4).contains(","))
    if intervals is not None:
        pos, inside = parts.getItem(1).cast("int"), F.lit(False)
        for contig, first, last in intervals:
            inside = inside | ((parts.getItem(0) == contig) & (pos >= first) & (pos <= last))
        body = body.where(inside)
    contig = recode_contig(parts.getItem(0), genome) if genome else parts.getItem(0)
    named = body.select(contig.alias("contig"), parts.getItem(1).cast("int").alias("pos"), parts.getItem(2).alias("rsid"), parts.getItem(3).alias("ref"), parts.getItem(4).alias("alt"), F.when(parts.getItem(6).isin("PASS", "."), F.array().cast("array<string>")).otherwise(F.split(parts.getItem(6), ";")).alias("filters"), parts.getItem(7).alias("info"), parts.getItem(8).alias("_format"), F.slice(parts, 10, F.greatest(F.lit(1), F.size(parts) - 9)).alias("_calls"))
    calls = named.select("contig", "pos", "ref", "alt", F.array_position(F.split("_format", ":"), "GT").alias("_gt"), F.posexplode("_calls").alias("_k", "_call"))
    gt = F.split(F.get(F.split("_call", ":"), F.col("_gt").cast("int") - 1), "[/|]")
    dosage = F.when(F.exists(gt, lambda a: a == "."), None).otherwise(F.aggregate(gt, F.lit(0), lambda s, a: s + a.cast("int"))).cast("tinyint")
    called = calls.select("contig", "pos", "ref", "alt", "_k", dosage.alias("dosage")).where("dosage is null or dosage > 0")
    return named.drop("_format", "_calls"), called.join(samples, "_k").select("contig", "pos", "ref", "alt", "iid", "dosage")


def save_sparse(geno: DataFrame, variants: DataFrame, samples: DataFrame, path: str) -> None:
    """Sparse genotypes as three tables; an empty one raises and is not written (O-042, O-019)."""
    if not geno.limit(1).count():
        raise ValueError("no genotype is left")
    geno.write.mode("overwrite").parquet(f"{path}/geno")
    variants.write.mode("overwrite").parquet(f"{path}/variants")
    samples.write.mode("overwrite").parquet(f"{path}/samples")


def load_sparse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """geno, variants, samples; the variants with mac = sum of dosages and maf = mac / 2n (O-018, O-019, O-103)."""
    geno, variants, samples = (spark.read.parquet(f"{path}/{t}") for t in ("geno", "variants", "samples"))
    n = samples.count()
    sums = geno.groupBy("variant").agg(F.sum("dosage").cast("long").alias("mac"))
    return geno, variants.join(sums, "variant").withColumn("maf", F.col("mac") / (2 * n)), samples
