"""Column expressions of the scalar functions: masks, weights, transforms, tails."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import stats

# Annotation categories as the annotation tables spell them.
STOP = ["stopgain", "stoploss"]
SPLICING = ["splicing", "exonic;splicing", "ncRNA_splicing", "ncRNA_exonic;splicing"]
SPLICING_CODING = ["splicing", "exonic;splicing"]
FRAMESHIFT = ["frameshift insertion", "frameshift deletion"]
UTR = ["UTR3", "UTR5", "UTR5;UTR3"]
NCRNA = ["ncRNA_exonic", "ncRNA_exonic;splicing", "ncRNA_splicing"]


def coding_masks(exonic: Column, category: Column, metasvm: Column, variant_type: str = "snv") -> dict[str, Column]:
    """Coding masks of a variant (O-141), null counting as false."""
    plof = exonic.isin(STOP) | category.isin(SPLICING)
    disruptive = (exonic == "nonsynonymous SNV") & (metasvm == "D")
    ptv_snv = exonic.isin(STOP) | category.isin(SPLICING_CODING)
    ptv = {"snv": ptv_snv, "indel": exonic.isin(FRAMESHIFT), "variant": ptv_snv | exonic.isin(FRAMESHIFT)}[variant_type]
    sure = lambda c: F.coalesce(c, F.lit(False))
    plof, disruptive, ptv = sure(plof), sure(disruptive), sure(ptv)
    return {
        "plof": plof, "synonymous": sure(exonic == "synonymous SNV"), "missense": sure(exonic == "nonsynonymous SNV"), "disruptive_missense": disruptive,
        "plof_ds": plof | disruptive, "ptv": ptv, "ptv_ds": ptv | disruptive,
    }


def coding_prefilter(exonic: Column, category: Column, variant_type: str = "snv") -> Column:
    """Variants that a coding mask can select (O-142); frameshifts only where indels are looked at."""
    keep = exonic.isin(*STOP, "nonsynonymous SNV", "synonymous SNV") | category.isin(SPLICING)
    if variant_type != "snv":
        keep = keep | exonic.isin(FRAMESHIFT)
    return F.coalesce(keep, F.lit(False))


def stream_mask(kind: str, category: Column, info: Column, gene: Column) -> Column:
    """Upstream or downstream of a gene (O-143)."""
    return F.coalesce((category == kind) & info.contains(gene), F.lit(False))


def utr_mask(category: Column, info: Column, gene: Column) -> Column:
    return F.coalesce(category.isin(UTR) & info.startswith(gene), F.lit(False))


def promoter_gene(info: Column) -> Column:
    """The gene that an upstream note starts with (O-145)."""
    return F.split(info, "[(),;\\-]").getItem(0)


def enhancer_gene(genehancer: Column) -> Column:
    """The gene after `connected_gene=` (O-146)."""
    return F.regexp_extract(genehancer, "connected_gene=([^;]*)", 1)


def ncrna_mask(category: Column, info: Column, gene: Column) -> Column:
    return F.coalesce(category.isin(NCRNA) & F.split(info, ";").getItem(0).contains(gene), F.lit(False))


def variant_name(contig: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", contig.cast("string"), pos.cast("string"), ref, alt)


def parse_variant(name: Column) -> list[Column]:
    """contig, pos, ref, alt of chr:pos:ref:alt (O-148)."""
    parts = F.split(name, ":")
    return [F.regexp_replace(parts.getItem(0), "^chr", "").alias("contig"), parts.getItem(1).cast("int").alias("pos"), parts.getItem(2).alias("ref"), parts.getItem(3).alias("alt")]


def recode_contig(contig: Column, genome: str) -> Column:
    """N under GRCh37, chrN under GRCh38, for 1 to 22, X and Y (O-016)."""
    bare = F.regexp_replace(contig, "^chr", "")
    return bare if genome == "GRCh37" else F.when(bare.rlike("^([1-9]|1[0-9]|2[0-2]|X|Y)$"), F.concat(F.lit("chr"), bare)).otherwise(contig)


def complement_phred(x: Column) -> Column:
    """-10 log10(1 - 10^(-x/10)) (O-149)."""
    return -10 * F.log10(1 - F.pow(F.lit(10.0), -x / 10))


def phred_weight(a: Column) -> Column:
    """1 - 10^(-a/10) (O-150)."""
    return 1 - F.pow(F.lit(10.0), -a / 10)


def maf_weight(maf: Column) -> Column:
    """Density of Beta(1, 25) (O-151)."""
    return 25 * F.pow(1 - maf, F.lit(24.0))


def strand_ambiguous(a1: Column, a2: Column) -> Column:
    """Not two single bases, or complementary ones (O-078, negated)."""
    one, two = F.upper(a1), F.upper(a2)
    return ~(one.isin("A", "C", "G", "T") & two.isin("A", "C", "G", "T") & (F.translate(two, "ATCG", "TAGC") != one))


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1) & ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$") & (ref != alt)


def is_indel(ref: Column, alt: Column) -> Column:
    return (F.length(ref) != F.length(alt)) & ref.rlike("^[ACGT]+$") & alt.rlike("^[ACGT]+$") & (ref.startswith(alt) | alt.startswith(ref))


def cauchy(ps: list[Column]) -> Column:
    """Cauchy combination of p-values strictly between 1e-16 and 1 (O-184 without its edge cases)."""
    stat = sum((F.tan((F.lit(0.5) - p) * math.pi) for p in ps), F.lit(0.0)) / len(ps)
    return F.lit(0.5) - F.atan(stat) / math.pi


def scientific(value: Column) -> Column:
    """%.5e (O-158)."""
    return F.format_string("%.5e", value)


def z_from_effect(effect: Column, se: Column | None = None, p: Column | None = None, null: float = 0.0) -> Column:
    """z from effect and standard error, or the signed root of the chi-square of p; null 1: an odds ratio, logged (O-156)."""
    centred = F.log(effect) if null == 1 else effect
    return centred / se if se is not None else F.signum(centred) * F.sqrt(chi2_isf(p))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom; Spark has no erfc."""
    return pd.Series(stats.chi2_sf(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_isf(p: pd.Series) -> pd.Series:
    return pd.Series(stats.chi2_isf(p.to_numpy(float)))


@F.pandas_udf(DoubleType())
def norm_sf(x: pd.Series) -> pd.Series:
    return pd.Series(stats.norm_sf(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def hwe(hom: pd.Series, het: pd.Series, alt: pd.Series) -> pd.Series:
    """Exact Hardy-Weinberg mid-p of genotype counts (O-104)."""
    memo: dict = {}
    keys = zip(hom.astype(int), het.astype(int), alt.astype(int))
    return pd.Series([memo[k] if k in memo else memo.setdefault(k, stats.hwe_exact(*k)) for k in keys])


def flat(x: Column) -> Column:
    """NaN and infinities as null, at the border of pandas and SQL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
