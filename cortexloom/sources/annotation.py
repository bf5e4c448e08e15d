"""Functional annotation tables in the FAVOR layout (O-020, O-090, O-149)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import complement_phred, recode_contig

# Names of the annotations as users give them, and the columns of the published tables.
COLUMNS = {
    "rs_num": "rsid",
    "GENCODE.Category": "genecode_comprehensive_category",
    "GENCODE.Info": "genecode_comprehensive_info",
    "GENCODE.EXONIC.Category": "genecode_comprehensive_exonic_category",
    "MetaSVM": "metasvm_pred",
    "GeneHancer": "genehancer",
    "CAGE": "cage_tc",
    "DHS": "rdhs",
    "CADD": "cadd_phred",
    "LINSIGHT": "linsight",
    "FATHMM.XF": "fathmm_xf",
    "aPC.EpigeneticActive": "apc_epigenetics_active",
    "aPC.EpigeneticRepressed": "apc_epigenetics_repressed",
    "aPC.EpigeneticTranscription": "apc_epigenetics_transcription",
    "aPC.Conservation": "apc_conservation",
    "aPC.LocalDiversity": "apc_local_nucleotide_diversity",
    "aPC.LocalDiversity(-)": "apc_local_nucleotide_diversity2",
    "aPC.Mappability": "apc_mappability",
    "aPC.TF": "apc_transcription_factor",
    "aPC.Protein": "apc_protein_function",
}
# The annotations that weigh variants in set tests.
WEIGHTS = ["CADD", "LINSIGHT", "FATHMM.XF", "aPC.EpigeneticActive", "aPC.EpigeneticRepressed", "aPC.EpigeneticTranscription", "aPC.Conservation", "aPC.LocalDiversity", "aPC.LocalDiversity(-)", "aPC.Mappability", "aPC.TF", "aPC.Protein"]
# Columns whose newer version replaces the one of the plain name.
NEWER = {"apc_conservation": "apc_conservation_v2", "apc_local_nucleotide_diversity": "apc_local_nucleotide_diversity_v3", "apc_protein_function": "apc_protein_function_v3"}


def favor_table(raw: DataFrame, genome: str = "GRCh38") -> DataFrame:
    """contig, pos, ref, alt and a struct `annot` of what COLUMNS names (under the tables' names), as far as the
    table has it: newer versions in place of older ones, missing CADD as 0, the complement of the local
    diversity added, weights as numbers."""
    present = dict.fromkeys(raw.columns)
    weights = {COLUMNS[w] for w in WEIGHTS}
    fields = []
    for name in COLUMNS.values():
        source = next((c for c in (NEWER.get(name), name) if c in present), None)
        if name == "apc_local_nucleotide_diversity2":
            source = next((c for c in (NEWER["apc_local_nucleotide_diversity"], "apc_local_nucleotide_diversity") if c in present), None)
        if source is None:
            continue
        value = F.col(f"`{source}`").cast("double") if name in weights else F.col(f"`{source}`").cast("string")
        if name == "cadd_phred":
            value = F.coalesce(value, F.lit(0.0))
        if name == "apc_local_nucleotide_diversity2":
            value = F.when(value > 0, complement_phred(value))
        fields.append(value.alias(name))
    contig = recode_contig(F.col("chromosome").cast("string"), genome)
    return raw.select(contig.alias("contig"), F.col("position").cast("int").alias("pos"), F.col("ref_vcf").alias("ref"), F.col("alt_vcf").alias("alt"), F.struct(*fields).alias("annot"))


def pick(annotated: DataFrame, names: list[str]) -> DataFrame:
    """The `annot` struct narrowed to the annotations named as users do."""
    if unknown := [n for n in names if n not in COLUMNS]:
        raise ValueError(f"unknown annotations {unknown}")
    return annotated.withColumn("annot", F.struct(*[F.col("annot")[COLUMNS[n]].alias(COLUMNS[n]) for n in names]))
