"""Queries of selections and small statistics that the other modules do not state: lists, masks, blocks, medians, covariances of sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import ids, intervals, linear, masks, rare, variants
from .registry import query
from .surrogate import CTE, Study


def _list(s: Study, step: int):
    return s.variants.where(F.col("variant") % step == 0).select("rsid")


@query("o063_extract_by_name", CTE + "SELECT variant, rsid FROM variants WHERE variant % 6 = 0 AND variant % 5 <> 0")
def extract_by_name(spark, sf_dir):
    s = Study(spark, sf_dir)
    return ids.exclude(ids.extract(s.variants, [_list(s, 2), _list(s, 3)]), [_list(s, 5)]).select("variant", "rsid")


@query("o107j_semi_lookup", CTE + "SELECT variant, iid, dosage FROM geno WHERE variant IN (SELECT variant FROM qc WHERE maf > 0.009)")
def semi_lookup(spark, sf_dir):
    s = Study(spark, sf_dir)
    common = variants.variant_qc(s.geno, s.n).where(variants.maf_filter(0.009)).select("variant")
    return ids.extract(s.geno, [common], "variant")


@query("o108j_anti_lookup", CTE + "SELECT variant, iid, dosage FROM geno WHERE variant NOT IN (SELECT variant FROM qc WHERE maf > 0.009)")
def anti_lookup(spark, sf_dir):
    s = Study(spark, sf_dir)
    common = variants.variant_qc(s.geno, s.n).where(variants.maf_filter(0.009)).select("variant")
    return ids.exclude(s.geno, [common], "variant")


@query("o067_parsed_intervals", CTE + "SELECT set_name, 'chr' || contig AS contig, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\" FROM genes WHERE contig = '2'")
def parsed_intervals(spark, sf_dir):
    g = Study(spark, sf_dir).genes.where("contig = '2'").select("set_name", F.concat("contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("text"))
    rows = [(r["set_name"], *intervals.parse_interval(r["text"], "GRCh38")) for r in g.collect()]  # intervals are options of a run
    return spark.createDataFrame(rows, "set_name string, contig string, start long, end long")


@query("o081_effect_median", CTE + "SELECT round(median(effect), 6) AS median FROM panel")
def effect_median(spark, sf_dir):
    return spark.createDataFrame([(round(variants.check_median(Study(spark, sf_dir).panel, "effect", 0.05), 6),)], "median double")


MASK_SQL = """, j AS (SELECT set_name, variant, exonic, category, metasvm FROM genes g JOIN variants v ON g.contig = v.contig AND v.pos >= g.start AND v.pos < g."end"),
k AS (SELECT set_name, variant, exonic IN ('stopgain', 'stoploss') OR category IN ('splicing', 'exonic;splicing', 'ncRNA_splicing', 'ncRNA_exonic;splicing') AS plof, exonic = 'synonymous SNV' AS synonymous, exonic = 'nonsynonymous SNV' AS missense, exonic = 'nonsynonymous SNV' AND metasvm = 'D' AS dm FROM j),
m AS (SELECT set_name, variant, unnest(list_filter([CASE WHEN plof THEN 'plof' END, CASE WHEN synonymous THEN 'synonymous' END, CASE WHEN missense THEN 'missense' END, CASE WHEN dm THEN 'disruptive_missense' END], lambda x: x IS NOT NULL)) AS mask FROM k)
"""


@query("o085_gene_masks", CTE + MASK_SQL + "SELECT set_name, mask, variant FROM m")
def gene_masks(spark, sf_dir):
    s = Study(spark, sf_dir)
    return masks.coding_members(s.variants, s.genes, ["plof", "synonymous", "missense"]).select("set_name", "mask", "variant")


@query("o087_sets_of_two", CTE + MASK_SQL + "SELECT set_name, mask, count(*) AS n_variants, CAST(sum(mac) AS BIGINT) AS cmac FROM m JOIN qc USING (variant) GROUP BY 1, 2 HAVING count(*) >= 2")
def sets_of_two(spark, sf_dir):
    s = Study(spark, sf_dir)
    members = masks.coding_members(s.variants, s.genes, ["plof", "synonymous", "missense"]).join(variants.variant_qc(s.geno, s.n).select("variant", "mac"), "variant")
    return variants.cmac(members, ["set_name", "mask"], low=0)


@query("o126_sub_blocks", CTE + """, p AS (SELECT variant, contig, pos, count(*) OVER (PARTITION BY contig) AS n, row_number() OVER (PARTITION BY contig ORDER BY pos, rsid) - 1 AS k FROM variants)
SELECT variant, CAST(least(k // (n // CASE WHEN n >= 20 THEN n // 7 ELSE 1 END), CASE WHEN n >= 20 THEN n // 7 ELSE 1 END - 1) AS INTEGER) AS block_idx2 FROM p""")
def sub_blocks(spark, sf_dir):
    v = Study(spark, sf_dir).variants.select("variant", "contig", "pos", F.col("rsid").alias("snp"))
    whole = variants.range_summary(v).select("contig", F.lit(-1).alias("start"), "end")
    return intervals.assign_blocks(v, whole, 20, 7).select("variant", "block_idx2")


@query("o124_merged_blocks", CTE + """, b AS (SELECT DISTINCT contig, pos // 10 AS block FROM variants), c AS (SELECT contig, block, row_number() OVER (PARTITION BY contig ORDER BY block) AS k, count(*) OVER (PARTITION BY contig) AS own, greatest(1, count(*) OVER () // 30) AS every FROM b)
SELECT contig, CAST(block AS BIGINT) AS block FROM c WHERE k % every = 0 OR k = own""")
def merged_blocks(spark, sf_dir):
    b = Study(spark, sf_dir).variants.select("contig", F.floor(F.col("pos") / 10).alias("block")).distinct().orderBy(F.col("contig").cast("int"), "block").collect()  # LD blocks: a few thousand
    return spark.createDataFrame(intervals.merge_every([tuple(r) for r in b], 30), "contig string, block long")


@query("o125_blocks_by_size", """WITH RECURSIVE b AS (SELECT row_number() OVER (ORDER BY l_suppkey) AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey), t AS (SELECT sum(n) / 12.0 AS mean FROM b),
r AS (SELECT k, n, n AS now, 0 AS g FROM b WHERE k = 1 UNION ALL SELECT b.k, b.n, CASE WHEN r.now + b.n <= mean OR r.now + b.n // 2 <= mean THEN r.now + b.n ELSE b.n END, CASE WHEN r.now + b.n <= mean OR r.now + b.n // 2 <= mean THEN r.g ELSE r.g + 1 END FROM r JOIN b ON b.k = r.k + 1, t)
SELECT k AS block, CAST(g AS INTEGER) AS merged FROM r""")
def blocks_by_size(spark, sf_dir):
    sizes = [r["count"] for r in Study(spark, sf_dir).table("lineitem").groupBy("l_suppkey").count().orderBy("l_suppkey").collect()]  # sizes of blocks
    return spark.createDataFrame([(i + 1, g) for i, g in enumerate(intervals.merge_by_size(sizes, 12))], "block long, merged int")


@query("o154_independent_covariates", """WITH s AS (SELECT c_nationkey AS x, c_acctbal AS y, 2 * c_nationkey - 3 AS d FROM customer)
SELECT 'intercept' AS name UNION ALL SELECT 'x' FROM s HAVING var_pop(x) > 0 UNION ALL SELECT 'y' FROM s HAVING 1 - power(corr(x, y), 2) > 1e-9 UNION ALL SELECT 'double' FROM s HAVING 1 - power(corr(x, d), 2) > 1e-9 UNION ALL SELECT 'sum' FROM s HAVING var_pop((x + y) - x - y) > 1e-9""")
def independent_covariates(spark, sf_dir):
    """Of intercept, x, y, 2x - 3 and x + y those that do not depend on the ones before."""
    c = Study(spark, sf_dir).table("customer")
    x, y = F.col("c_nationkey").cast("double"), F.col("c_acctbal")
    rows = c.select(F.array(F.lit(1.0), x, y, 2 * x - 3, x + y).alias("x"), F.array(y).alias("y"))
    xx = linear.cross_products(rows)["xx"]
    scale = np.sqrt(np.diag(xx))
    kept = linear.independent_columns(xx / np.outer(scale, scale))
    return spark.createDataFrame([(["intercept", "x", "y", "double", "sum"][k],) for k in kept], "name string")


@query("o174_common_aligned", CTE + """, a AS (SELECT snp, a1, a2, z FROM panel WHERE n > 20), b AS (SELECT snp, CASE WHEN pos % 3 = 0 THEN a2 ELSE a1 END AS a1, CASE WHEN pos % 3 = 0 THEN a1 ELSE a2 END AS a2 FROM panel WHERE n > 10)
SELECT snp, round(CASE WHEN l1 <> r1 THEN -z ELSE z END, 6) + 0.0 AS z FROM (SELECT a.snp, a.a1 AS l1, a.a2 AS l2, b.a1 AS r1, z, count(*) OVER (PARTITION BY a.snp) AS k FROM a JOIN b ON a.snp = b.snp) WHERE k = 1 AND l1 <> l2""")
def common_aligned(spark, sf_dir):
    p = Study(spark, sf_dir).panel
    one = p.where("n > 20").select("snp", "a1", "a2", "z")
    two = p.where("n > 10").select("snp", F.when(F.col("pos") % 3 == 0, F.col("a2")).otherwise(F.col("a1")).alias("a1"), F.when(F.col("pos") % 3 == 0, F.col("a1")).otherwise(F.col("a2")).alias("a2"))
    common = ids.common_variants([one, two])
    aligned = ids.align_alleles(one.join(common.select("snp"), "snp", "left_semi"), two, ["z"])
    return aligned.select("snp", (F.round("z", 6) + 0.0).alias("z"))


@query("o179_set_covariances", CTE + """, m AS (SELECT set_name, variant FROM genes g JOIN variants x ON g.contig = x.contig AND x.pos >= g.start AND x.pos < g."end" JOIN qc q USING (variant) WHERE maf > 0.009),
c AS (SELECT set_name, variant, iid, dosage FROM m JOIN geno USING (variant)), z AS (SELECT a.set_name, a.variant AS i, b.variant AS j, sum(a.dosage * b.dosage) AS v FROM c a JOIN c b ON a.set_name = b.set_name AND a.iid = b.iid AND a.variant <= b.variant GROUP BY 1, 2, 3)
SELECT a.set_name, a.variant AS i, b.variant AS j, round(coalesce(v, 0) - p.ac * q.ac / CAST(n AS DOUBLE), 6) AS value FROM m a JOIN m b ON a.set_name = b.set_name AND a.variant <= b.variant LEFT JOIN z ON z.set_name = a.set_name AND z.i = a.variant AND z.j = b.variant JOIN qc p ON p.variant = a.variant JOIN qc q ON q.variant = b.variant, num""")
def set_covariances(spark, sf_dir):
    s = Study(spark, sf_dir)
    qc = variants.variant_qc(s.geno, s.n).where("maf > 0.009").select("variant")
    proj = rare.projections(s.geno, linear.residuals(s.plain_subjects), np.array([[float(s.n)]]))
    placed = qc.join(proj, "variant").join(s.variants.select("variant", "contig", "pos"), "variant")
    members = intervals.interval_join(placed, s.genes).select("set_name", F.lit("all").alias("mask"), "variant", "proj")
    return rare.set_covariances(members, s.geno).select("set_name", "i", "j", F.round("value", 6).alias("value"))
