"""Members of variant sets by gene and mask, for all genes in one interval join (O-085, O-141 to O-147)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .intervals import interval_join

#: Masks that a category stands for; missense brings the disruptive ones with it.
CODING = ["plof", "synonymous", "missense", "disruptive_missense", "plof_ds", "ptv", "ptv_ds"]
NONCODING = ["upstream", "downstream", "utr", "promoter_cage", "promoter_dhs", "enhancer_cage", "enhancer_dhs", "ncrna"]


def categories(names: list[str] | None, known: list[str]) -> list[str]:
    """The masks asked for, all by default."""
    if not names or names == ["all"]:
        return list(known)
    if unknown := set(names) - set(known):
        raise ValueError(f"unknown categories {sorted(unknown)}")
    return [k for k in known if k in names or (k == "disruptive_missense" and "missense" in names)]


def _explode(data: DataFrame, masks: dict) -> DataFrame:
    chosen = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in masks.items()]))
    return data.withColumn("mask", F.explode(chosen))


def coding_members(variants: DataFrame, genes: DataFrame, names: list[str] | None = None, variant_type: str = "snv") -> DataFrame:
    """One row for each gene, mask and variant of variants (contig, pos, category, exonic, metasvm, ...)."""
    kept = variants.where(C.coding_prefilter(F.col("exonic"), F.col("category"), variant_type))
    masks = C.coding_masks(F.col("exonic"), F.col("category"), F.col("metasvm"), variant_type)
    return _explode(interval_join(kept, genes), {k: masks[k] for k in categories(names, CODING)})


def noncoding_members(variants: DataFrame, genes: DataFrame, names: list[str] | None = None, promoters: DataFrame | None = None) -> DataFrame:
    """The same for noncoding masks of variants (contig, pos, variant, category, info, genehancer, cage, dhs).

    promoters: (contig, start, end) of promoter regions; without them no variant is in a promoter."""
    if promoters is None:
        marked = variants.withColumn("_promoter", F.lit(False))
    else:
        inside = interval_join(variants.select("contig", "pos", "variant"), promoters, how="left_semi").select(F.col("variant").alias("_v")).distinct().withColumn("_promoter", F.lit(True))
        marked = variants.join(inside, F.col("variant") == F.col("_v"), "left").drop("_v").withColumn("_promoter", F.coalesce("_promoter", F.lit(False)))
    joined = interval_join(marked, genes)
    category, info, gene = F.col("category"), F.col("info"), F.col("set_name")
    promoter, enhancer = F.col("_promoter") & (C.promoter_gene(info) == gene), C.enhancer_gene(F.col("genehancer")) == gene
    masks = {
        "upstream": C.stream_mask("upstream", category, info, gene), "downstream": C.stream_mask("downstream", category, info, gene), "utr": C.utr_mask(category, info, gene),
        "promoter_cage": promoter & F.col("cage").isNotNull(), "promoter_dhs": promoter & F.col("dhs").isNotNull(), "enhancer_cage": enhancer & F.col("cage").isNotNull(), "enhancer_dhs": enhancer & F.col("dhs").isNotNull(),
        "ncrna": C.ncrna_mask(category, info, gene),
    }
    return _explode(joined, {k: masks[k] for k in categories(names, NONCODING)}).drop("_promoter")
