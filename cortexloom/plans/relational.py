"""Queries of the relational operators: scans, filters, joins, aggregates, windows, sets, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VariantFilter
from ..functions import columns as C
from ..operators import ids, intervals, variants
from ..sources import sumstats
from .registry import query
from .surrogate import CTE, Study


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


@query("o113_gene_variant_sets", CTE + """, rare AS (SELECT v.contig, v.pos, q.mac FROM qc q JOIN variants v USING (variant) WHERE q.maf > 0 AND q.maf <= 0.01)
SELECT set_name, count(*) AS n_variants, CAST(sum(mac) AS BIGINT) AS cmac FROM genes g JOIN rare r ON g.contig = r.contig AND r.pos >= g.start AND r.pos < g."end" GROUP BY set_name HAVING count(*) >= 2""")
def gene_variant_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(spark, sf_dir)
    rare = variants.variant_qc(s.geno, s.n).where(variants.maf_filter(0, 0.01)).select("variant", "mac").join(s.variants.select("variant", "contig", "pos"), "variant")
    return variants.cmac(intervals.interval_join(rare, s.genes).select("set_name", "mac"))


@query("o101_variant_qc", CTE + """, m AS (SELECT variant, iid, CASE WHEN (variant * 31 + iid) % 17 = 0 THEN NULL ELSE dosage END AS dosage FROM geno),
c AS (SELECT variant, n - count(*) FILTER (dosage IS NULL) AS n_called, count(*) FILTER (dosage = 1) AS n_het, count(*) FILTER (dosage = 2) AS n_hom_alt, CAST(coalesce(sum(dosage), 0) AS BIGINT) AS ac, n FROM m, num GROUP BY variant, n)
SELECT variant, n_called, n_het, n_hom_alt, ac, round(ac / (2.0 * n_called), 6) AS af, round(n_called / CAST(n AS DOUBLE), 6) AS call_rate FROM c""")
def variant_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(spark, sf_dir)
    return variants.variant_qc(s.geno_missing, s.n).select("variant", "n_called", "n_het", "n_hom_alt", "ac", r6("af"), r6("call_rate"))


@query("o102_minor_allele", CTE + "SELECT variant, round(maf, 6) AS maf, mac FROM qc")
def minor_allele(spark, sf_dir):
    s = Study(spark, sf_dir)
    return variants.variant_qc(s.geno, s.n).select("variant", r6("maf"), "mac")


@query("o069_maf_filter", CTE + "SELECT variant FROM qc WHERE maf > 0.008 AND maf <= 0.01")
def maf_filter(spark, sf_dir):
    s = Study(spark, sf_dir)
    return variants.variant_qc(s.geno, s.n).where(variants.maf_filter(0.008, 0.01)).select("variant")


@query("o070_mac_filter", CTE + "SELECT variant, mac FROM qc WHERE mac > 20 AND mac <= 30")
def mac_filter(spark, sf_dir):
    s = Study(spark, sf_dir)
    return variants.variant_qc(s.geno, s.n).where(variants.mac_filter(20, 30)).select("variant", "mac")


@query("o071_call_rate_filter", CTE + """, c AS (SELECT variant, n - count(*) FILTER ((variant * 31 + iid) % 17 = 0) AS n_called, n FROM geno, num GROUP BY variant, n)
SELECT variant, n_called FROM c WHERE n_called / CAST(n AS DOUBLE) >= 0.999""")
def call_rate_filter(spark, sf_dir):
    s = Study(spark, sf_dir)
    return variants.quality(variants.variant_qc(s.geno_missing, s.n), VariantFilter(call_rate=0.999)).select("variant", "n_called")


@query("o075_quality_filters", CTE + """SELECT v.variant FROM variants v JOIN qc q USING (variant)
WHERE length(ref) = 1 AND length(alt) = 1 AND ref <> alt AND maf > 0 AND maf <= 0.01 AND mac > 15 AND mac <= 40""")
def quality_filters(spark, sf_dir):
    s = Study(spark, sf_dir)
    joined = s.variants.join(variants.variant_qc(s.geno, s.n), "variant")
    return variants.quality(joined, VariantFilter.wgs(mac_min=15, mac_max=40)).select("variant")


@query("o068_variant_types", CTE + """SELECT CASE WHEN length(ref) = 1 AND length(alt) = 1 AND ref <> alt THEN 'snv' WHEN length(ref) <> length(alt) AND (starts_with(alt, ref) OR starts_with(ref, alt)) THEN 'indel' ELSE 'other' END AS kind, count(*) AS n FROM variants GROUP BY 1""")
def variant_types(spark, sf_dir):
    v = Study(spark, sf_dir).variants
    kind = F.when(variants.type_filter("snv"), "snv").when(variants.type_filter("indel"), "indel").otherwise("other")
    return v.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("o082_plink_filter", CTE + "SELECT variant, ac FROM qc, num WHERE least(ac / (2.0 * n), 1 - ac / (2.0 * n)) > 0.009 AND n_het < n")
def plink_filter(spark, sf_dir):
    s = Study(spark, sf_dir)
    return variants.plink_filter(s.geno, s.n, 0.009).select("variant", "ac")


@query("o073_pass_and_star", CTE + "SELECT variant FROM variants WHERE variant % 3 <> 0 AND alt <> '*'")
def pass_and_star(spark, sf_dir):
    v = Study(spark, sf_dir).variants.withColumn("filters", F.when(F.col("variant") % 3 == 0, F.array(F.lit("LowQual"))).when(F.col("variant") % 3 == 1, F.array().cast("array<string>")))
    return variants.quality(v, VariantFilter()).select("variant")


@query("o078_strand_ambiguous", CTE + "SELECT a1, a2, count(*) AS n FROM panel WHERE NOT ((a1 = 'A' AND a2 = 'T') OR (a1 = 'T' AND a2 = 'A') OR (a1 = 'C' AND a2 = 'G') OR (a1 = 'G' AND a2 = 'C')) GROUP BY 1, 2")
def strand_ambiguous(spark, sf_dir):
    return Study(spark, sf_dir).panel.where(~C.strand_ambiguous(F.col("a1"), F.col("a2"))).groupBy("a1", "a2").agg(F.count("*").alias("n"))


@query("o079_sample_size", CTE + "SELECT n, count(*) AS rows_kept FROM panel WHERE n >= (SELECT floor(quantile_cont(n, 0.9) / 1.5) FROM panel) GROUP BY n")
def sample_size(spark, sf_dir):
    return variants.sample_size_filter(Study(spark, sf_dir).panel).groupBy("n").agg(F.count("*").alias("rows_kept"))


@query("o080_sumstats_qc", CTE + """, u AS (SELECT * FROM panel WHERE snp IN (SELECT snp FROM panel GROUP BY snp HAVING count(*) = 1)),
k AS (SELECT * FROM u WHERE maf >= 0.01 AND a1 <> a2 AND NOT ((a1 = 'A' AND a2 = 'T') OR (a1 = 'T' AND a2 = 'A') OR (a1 = 'C' AND a2 = 'G') OR (a1 = 'G' AND a2 = 'C')))
SELECT snp, pos, n, round(z, 6) AS z FROM k WHERE n >= (SELECT floor(quantile_cont(n, 0.9) / 1.5) FROM k)""")
def sumstats_qc(spark, sf_dir):
    return sumstats.quality_control(Study(spark, sf_dir).panel).select("snp", "pos", "n", r6("z"))


@query("o108_unique_keys", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1)")
def unique_keys(spark, sf_dir):
    return ids.unique_keys(Study(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("o061_keep_subjects", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def keep_subjects(spark, sf_dir):
    s = Study(spark, sf_dir)
    keep = s.table("orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return ids.keep_subjects(s.table("customer").select("c_custkey", "c_acctbal"), keep, ["c_custkey"], merge=True)


@query("o062_remove_subjects", CTE + "SELECT variant, iid, dosage FROM geno WHERE iid NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def remove_subjects(spark, sf_dir):
    s = Study(spark, sf_dir)
    gone = s.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("iid"))
    return ids.remove_subjects(s.geno, gone, ["iid"])


@query("o003_keep_lists", "SELECT o_custkey AS iid FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def keep_lists(spark, sf_dir):
    o = Study(spark, sf_dir).table("orders").select(F.col("o_custkey").alias("iid"), "o_orderstatus")
    return ids.intersect_ids([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")], ["iid"])


@query("o004_remove_lists", "SELECT o_custkey AS iid FROM orders WHERE o_totalprice > 100000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def remove_lists(spark, sf_dir):
    s = Study(spark, sf_dir)
    return ids.union_ids([s.table("orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("iid")), s.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("iid"))], ["iid"])


@query("o136_except_ids", "SELECT o_custkey AS iid FROM orders WHERE o_totalprice > 200000 EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def except_ids(spark, sf_dir):
    s = Study(spark, sf_dir)
    return ids.except_ids(s.table("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("iid")), s.table("customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("iid")), ["iid"])


@query("o134_align_subjects", """SELECT c_custkey AS iid FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT vec_id FROM embeddings EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 3""")
def align_subjects(spark, sf_dir):
    s = Study(spark, sf_dir)
    c = s.table("customer")
    return ids.align_subjects([c.select(F.col("c_custkey").alias("iid")), s.table("orders").select(F.col("o_custkey").alias("iid"))], s.images.select("iid"), c.where("c_nationkey = 3").select(F.col("c_custkey").alias("iid")), ["iid"])


@query("o005_extract_lists", CTE + "SELECT rsid, pos FROM variants WHERE variant IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND variant IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def extract_lists(spark, sf_dir):
    s = Study(spark, sf_dir)
    x = s.table("lineitem").select(F.concat(F.lit("rs"), F.col("l_partkey").cast("string")).alias("rsid"), "l_returnflag", "l_quantity")
    return ids.extract(s.variants, [x.where("l_returnflag = 'R'"), x.where("l_quantity > 45")]).select("rsid", "pos")


@query("o006_exclude_lists", CTE + "SELECT rsid, pos FROM variants WHERE variant NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND variant NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def exclude_lists(spark, sf_dir):
    s = Study(spark, sf_dir)
    x = s.table("lineitem").select(F.concat(F.lit("rs"), F.col("l_partkey").cast("string")).alias("rsid"), "l_quantity", "l_discount")
    return ids.exclude(s.variants, [x.where("l_quantity > 49"), x.where("l_discount > 0.09")]).select("rsid", "pos")


@query("o064_extract_loci", CTE + "SELECT variant FROM variants WHERE (contig, pos) IN (SELECT contig, pos FROM variants WHERE phred > 30) AND (contig, pos) NOT IN (SELECT contig, pos FROM variants WHERE phred > 40)")
def extract_loci(spark, sf_dir):
    v = Study(spark, sf_dir).variants
    return ids.exclude(ids.extract(v, [v.where("phred > 30")], ["contig", "pos"]), [v.where("phred > 40")], ["contig", "pos"]).select("variant")


@query("o065_interval_filter", CTE + "SELECT variant, pos FROM variants WHERE (contig = '1' AND pos >= 100 AND pos < 200) OR (contig = '3' AND pos >= 1000 AND pos < 1450)")
def interval_filter(spark, sf_dir):
    return intervals.filter_intervals(Study(spark, sf_dir).variants, [intervals.parse_interval("1:100-200"), intervals.parse_interval("chr3:1000-1450")]).select("variant", "pos")


@query("o066_strict_interval_filter", CTE + "SELECT variant, pos FROM variants WHERE contig = '2' AND pos > 500 AND pos < 700")
def strict_interval_filter(spark, sf_dir):
    return intervals.filter_intervals(Study(spark, sf_dir).variants, [("2", 500, 700)], "inside").select("variant", "pos")


@query("o076_finite_rows", CTE + ", f AS (SELECT snp, CASE WHEN effect = 0 THEN NULL ELSE effect END AS effect FROM panel) SELECT snp, round(effect, 6) AS effect FROM f WHERE effect IS NOT NULL")
def finite_rows(spark, sf_dir):
    p = Study(spark, sf_dir).panel.select("snp", F.when(F.col("effect") == 0, F.lit(float("nan"))).otherwise(F.col("effect")).alias("effect"))
    return variants.finite_rows(p, ["effect"]).select("snp", r6("effect"))


@query("o077_finite_arrays", "SELECT vec_id AS iid FROM embeddings WHERE vec_id % 5 <> 0")
def finite_arrays(spark, sf_dir):
    x = Study(spark, sf_dir).images.withColumn("voxels", F.when(F.col("iid") % 5 == 0, F.concat("voxels", F.array(F.lit(float("inf"))))).otherwise(F.col("voxels")))
    return variants.finite_arrays(x, ["voxels"]).select("iid")


@query("o084_significance", CTE + "SELECT snp, round(z * z, 6) AS chisq FROM panel WHERE z * z >= 3.841458820694124")
def significance(spark, sf_dir):
    from ..functions import stats

    z = F.col("z")
    return Study(spark, sf_dir).panel.where(z * z >= float(stats.chi2_isf(0.05))).select("snp", F.round(z * z, 6).alias("chisq"))


@query("o086_cmac_range", CTE + """, m AS (SELECT g.set_name, q.mac FROM genes g JOIN variants v ON g.contig = v.contig AND v.pos >= g.start AND v.pos < g."end" JOIN qc q USING (variant))
SELECT set_name, count(*) AS n_variants, CAST(sum(mac) AS BIGINT) AS cmac FROM m GROUP BY set_name HAVING count(*) >= 2 AND sum(mac) BETWEEN 500 AND 1050""")
def cmac_range(spark, sf_dir):
    s = Study(spark, sf_dir)
    joined = intervals.interval_join(s.variants.select("variant", "contig", "pos"), s.genes).join(variants.variant_qc(s.geno, s.n).select("variant", "mac"), "variant")
    return variants.cmac(joined, ["set_name"], 500, 1050)


@query("o088_project_components", "SELECT vec_id AS iid, v - 1 AS voxel, round(CAST(embedding[v] AS DOUBLE), 6) AS value FROM embeddings, (SELECT unnest([2, 4, 6]) AS v)")
def project_components(spark, sf_dir):
    from ..sources.sumstats import components

    x = Study(spark, sf_dir).images.select("iid", components("voxels", 0, 6).alias("voxels"))
    return x.select("iid", F.posexplode("voxels").alias("voxel", "value")).where(F.col("voxel").isin(1, 3, 5)).select("iid", F.col("voxel").cast("int").alias("voxel"), r6("value"))


@query("o101j_common_variants", CTE + """, a AS (SELECT snp, a1, a2 FROM panel), b AS (SELECT snp, a2 AS a1, a1 AS a2 FROM panel WHERE n > 10), m AS (SELECT a.snp, a.a1 AS a1_0, a.a2 AS a2_0, b.a1 AS a1_1, b.a2 AS a2_1 FROM a JOIN b USING (snp)),
u AS (SELECT * FROM m WHERE snp IN (SELECT snp FROM m GROUP BY snp HAVING count(*) = 1)) SELECT * FROM u WHERE len(list_distinct([a1_0, a2_0, a1_1, a2_1])) = 2""")
def common_variants(spark, sf_dir):
    p = Study(spark, sf_dir).panel
    one, two = p.select("snp", "a1", "a2"), p.where("n > 10").select("snp", F.col("a2").alias("a1"), F.col("a1").alias("a2"))
    return ids.common_variants([one, two])


@query("o102j_panel_join", CTE + "SELECT snp, a1, a2, count(*) AS n FROM (SELECT snp, a1, a2 FROM panel WHERE n < 25) x JOIN (SELECT snp, a1, a2 FROM panel WHERE maf < 0.4) y USING (snp, a1, a2) GROUP BY 1, 2, 3")
def panel_join(spark, sf_dir):
    p = Study(spark, sf_dir).panel.select("snp", "a1", "a2", "n", "maf")
    return ids.panel_join(p.where("n < 25").select("snp", "a1", "a2"), p.where("maf < 0.4").select("snp", "a1", "a2")).groupBy("snp", "a1", "a2").agg(F.count("*").alias("n"))


@query("o103j_ordered_extract", CTE + "SELECT rsid AS snp, pos, row_id FROM (SELECT rsid, pos, variant AS row_id FROM variants) WHERE row_id IN (SELECT s_suppkey * 3 FROM supplier)")
def ordered_extract(spark, sf_dir):
    s = Study(spark, sf_dir)
    keep = s.table("supplier").select(F.concat(F.lit("rs"), (F.col("s_suppkey") * 3).cast("string")).alias("snp"), F.col("s_suppkey").alias("row_id"))
    return ids.ordered_extract(keep, s.variants.select(F.col("rsid").alias("snp"), "pos", F.col("variant").alias("row_id")))


@query("o104j_align_alleles", CTE + """, ref AS (SELECT snp, max(a2) AS a1 FROM panel GROUP BY snp HAVING count(*) = 1)
SELECT p.snp, round(CASE WHEN ref.a1 <> p.a1 THEN -z ELSE z END, 6) + 0.0 AS z FROM panel p JOIN ref USING (snp)""")
def align_alleles(spark, sf_dir):
    p = ids.unique_keys(Study(spark, sf_dir).panel, ["snp"]).select("snp", "a1", "a2", "z")
    return ids.align_alleles(p, p.select("snp", F.col("a2").alias("a1")), ["z"]).select("snp", (F.round("z", 6) + 0.0).alias("z"))


@query("o105j_annotate_left", "SELECT c_custkey AS iid, s_acctbal AS balance FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def annotate_left(spark, sf_dir):
    s = Study(spark, sf_dir)
    got = ids.annotate_left(s.table("customer").select(F.col("c_custkey").alias("iid")), s.table("supplier").select(F.col("s_suppkey").alias("iid"), "s_acctbal"), ["iid"], "row")
    return got.select("iid", F.col("row.s_acctbal").alias("balance"))


@query("o106j_annotate_inner", CTE + "SELECT v.variant, a.phred FROM variants v JOIN (SELECT contig, pos, ref, alt, phred FROM variants WHERE phred > 20) a USING (contig, pos, ref, alt)")
def annotate_inner(spark, sf_dir):
    v = Study(spark, sf_dir).variants
    table = v.where("phred > 20").select("contig", "pos", "ref", "alt", "phred")
    return ids.annotate_inner(v.select("variant", "contig", "pos", "ref", "alt"), table, ["contig", "pos", "ref", "alt"], "annot").select("variant", F.col("annot.phred").alias("phred"))


@query("o109j_in_promoters", CTE + """SELECT variant FROM variants v WHERE EXISTS (SELECT 1 FROM genes g WHERE g.contig = v.contig AND v.pos >= g.start AND v.pos < g.start + 5)""")
def in_promoters(spark, sf_dir):
    s = Study(spark, sf_dir)
    return intervals.interval_join(s.variants, s.genes.withColumn("end", F.col("start") + 5), how="left_semi").select("variant")


@query("o110j_gene_join", CTE + """SELECT set_name, variant FROM genes g JOIN variants v ON g.contig = v.contig AND v.pos >= g.start AND v.pos < g."end" """)
def gene_join(spark, sf_dir):
    s = Study(spark, sf_dir)
    return intervals.interval_join(s.variants, s.genes, bucket=64).select("set_name", "variant")


@query("o111j_closed_join", CTE + """SELECT set_name, min(variant) AS first, max(variant) AS last FROM genes g JOIN variants v ON g.contig = v.contig AND v.pos >= g.start AND v.pos <= g."end" GROUP BY set_name""")
def closed_join(spark, sf_dir):
    s = Study(spark, sf_dir)
    return intervals.interval_join(s.variants, s.genes, "closed").groupBy("set_name").agg(F.min("variant").alias("first"), F.max("variant").alias("last"))


@query("o112j_floor_join", CTE + ", marks AS (SELECT contig, pos, variant AS mark FROM variants WHERE variant % 37 = 5) SELECT v.variant, m.mark FROM variants v ASOF LEFT JOIN marks m ON v.contig = m.contig AND v.pos >= m.pos")
def floor_join(spark, sf_dir):
    v = Study(spark, sf_dir).variants.select("variant", "contig", "pos")
    marks = v.where("variant % 37 = 5").select("contig", "pos", F.col("variant").alias("mark"))
    return intervals.floor_join(v, marks, "mark", bucket=128).select("variant", "mark")


@query("o113j_ld_blocks", CTE + """, parts AS (SELECT DISTINCT contig, ((pos - 1) // 60) * 60 AS start FROM variants WHERE pos > 0),
j AS (SELECT v.variant, v.contig, p.start FROM variants v JOIN (SELECT contig, min(start) AS least FROM parts GROUP BY contig) f USING (contig) JOIN parts p ON p.contig = v.contig AND greatest(v.pos, f.least + 1) > p.start AND greatest(v.pos, f.least + 1) <= p.start + 60)
SELECT variant, CAST(dense_rank() OVER (ORDER BY CAST(contig AS INTEGER), start) - 1 AS INTEGER) AS block_idx FROM j""")
def ld_blocks(spark, sf_dir):
    v = Study(spark, sf_dir).variants.select("variant", "contig", "pos", F.col("rsid").alias("snp"))
    parts = v.where("pos > 0").select("contig", (F.floor((F.col("pos") - 1) / 60) * 60).cast("int").alias("start")).distinct().withColumn("end", F.col("start") + 60)
    return intervals.assign_blocks(v, parts).select("variant", "block_idx")


@query("o114j_band_pairs", CTE + "SELECT a.variant AS i, b.variant AS j FROM variants a JOIN variants b ON a.contig = b.contig AND b.pos >= a.pos AND b.pos <= a.pos + 4")
def band_pairs(spark, sf_dir):
    v = Study(spark, sf_dir).variants.select("variant", "contig", "pos")
    return intervals.band_join(v, 4, ["variant"]).select(F.col("variant_i").alias("i"), F.col("variant_j").alias("j"))


@query("o116j_image_merge", "SELECT vec_id AS iid, round(CAST(embedding[1] AS DOUBLE) + CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END, 6) AS first FROM embeddings")
def image_merge(spark, sf_dir):
    from ..operators.images import merge_images

    x = Study(spark, sf_dir).images
    return merge_images([x.where("iid % 2 = 0").withColumn("voxels", F.transform("voxels", lambda v: v + 1)), x]).select("iid", F.round(F.get("voxels", 0), 6).alias("first"))


@query("o106_flip_major", "SELECT l_partkey AS variant, l_orderkey AS row_id, l_linenumber AS line, CASE WHEN avg(l_linenumber % 3) OVER (PARTITION BY l_partkey) / 2 > 0.5 THEN 2 - l_linenumber % 3 ELSE l_linenumber % 3 END AS dosage FROM lineitem")
def flip_major(spark, sf_dir):
    x = Study(spark, sf_dir).table("lineitem").select(F.col("l_partkey").alias("variant"), F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") % 3).alias("dosage"))
    return variants.flip_major(x)


@query("o107_impute_mean", CTE + """, m AS (SELECT variant, iid, CASE WHEN (variant * 31 + iid) % 17 = 0 THEN NULL ELSE dosage END AS dosage FROM geno)
SELECT variant, iid, round(coalesce(dosage, avg(dosage) OVER (PARTITION BY variant)), 6) AS dosage FROM m""")
def impute_mean(spark, sf_dir):
    return variants.impute(Study(spark, sf_dir).geno_missing).select("variant", "iid", r6("dosage"))


@query("o107_impute_zero", CTE + "SELECT variant, CAST(sum(CASE WHEN (variant * 31 + iid) % 17 = 0 THEN 0 ELSE dosage END) AS BIGINT) AS total FROM geno GROUP BY variant")
def impute_zero(spark, sf_dir):
    return variants.impute(Study(spark, sf_dir).geno_missing, "zero").groupBy("variant").agg(F.sum("dosage").cast("long").alias("total"))


@query("o109_chromosomes", CTE + "SELECT DISTINCT contig FROM variants")
def chromosomes(spark, sf_dir):
    return Study(spark, sf_dir).variants.select("contig").distinct()


@query("o110_range_summary", CTE + 'SELECT contig, min(pos) AS start, max(pos) AS "end" FROM variants GROUP BY contig')
def range_summary(spark, sf_dir):
    return variants.range_summary(Study(spark, sf_dir).variants)


@query("o111_block_counts", CTE + ", c AS (SELECT contig, count(*) AS n FROM variants GROUP BY contig) SELECT contig, n, CAST(sum(n) OVER (ORDER BY contig) AS BIGINT) AS upto FROM c")
def block_counts(spark, sf_dir):
    from pyspark.sql import Window

    c = Study(spark, sf_dir).variants.groupBy("contig").agg(F.count("*").alias("n"))
    return c.withColumn("upto", F.sum("n").over(Window.orderBy("contig")))  # over contigs, a handful


@query("o112_cluster_sizes", CTE + ", sig AS (SELECT variant, count(*) AS n FROM geno WHERE dosage = 2 GROUP BY variant) SELECT 'rs' || v.variant AS snp, coalesce(n, 0) AS size FROM variants v LEFT JOIN sig USING (variant)")
def cluster_sizes(spark, sf_dir):
    from ..operators.nulls import cluster_sizes as sizes

    s = Study(spark, sf_dir)
    hits = s.geno.where("dosage = 2").select(F.lit(0).alias("sample_id"), F.concat(F.lit("rs"), F.col("variant").cast("string")).alias("snp"))
    return sizes(hits, s.variants.select(F.col("rsid").alias("snp")), 1).select("snp", "size")


CMAC_BIN_SQL = """CASE WHEN cmac < 2 THEN NULL WHEN cmac = 2 THEN '2_2' WHEN cmac = 3 THEN '3_3' WHEN cmac = 4 THEN '4_4' WHEN cmac = 5 THEN '5_5' WHEN cmac <= 7 THEN '6_7' WHEN cmac <= 9 THEN '8_9' WHEN cmac <= 11 THEN '10_11' WHEN cmac <= 14 THEN '12_14'
WHEN cmac <= 20 THEN '15_20' WHEN cmac <= 30 THEN '21_30' WHEN cmac <= 60 THEN '31_60' WHEN cmac <= 100 THEN '61_100' WHEN cmac <= 500 THEN '101_500' ELSE '501' END"""


@query("o114_cmac_bins", CTE + f""", c AS (SELECT variant // 3 * 3 AS g, 1 AS kind, CAST(sum(mac) AS BIGINT) AS cmac FROM qc GROUP BY 1 UNION ALL SELECT variant // 40, 2, CAST(sum(mac) AS BIGINT) FROM qc GROUP BY 1 UNION ALL SELECT variant, 3, CAST(mac // 10 AS BIGINT) FROM qc)
SELECT {CMAC_BIN_SQL} AS bin, count(*) AS n_sets FROM c WHERE cmac >= 2 GROUP BY 1""")
def cmac_bins(spark, sf_dir):
    s = Study(spark, sf_dir)
    qc = variants.variant_qc(s.geno, s.n).select("variant", "mac")
    size = lambda k: qc.groupBy(F.floor(F.col("variant") / k)).agg(F.sum("mac").alias("cmac")).select("cmac")
    return variants.bin_histogram(size(3).unionAll(size(40)).unionAll(qc.select(F.floor(F.col("mac") / 10).alias("cmac"))))


@query("o115_nan_summary", CTE + "SELECT round(avg(z), 6) AS mean, round(median(z), 6) AS median, round(max(z), 6) AS max, round(min(z), 6) AS min FROM panel WHERE pos % 7 <> 0")
def nan_summary(spark, sf_dir):
    p = Study(spark, sf_dir).panel.withColumn("z", F.when(F.col("pos") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("z")))
    return variants.nan_summary(p, "z").select(r6("mean"), r6("median"), r6("max"), r6("min"))


@query("o083_two_panel_maf", CTE + """SELECT snp, round(x.maf, 6) AS maf_1, round(y.maf, 6) AS maf_2 FROM (SELECT rsid AS snp, ref AS a1, alt AS a2, maf FROM variants JOIN qc USING (variant) WHERE maf >= 0.009) x
JOIN (SELECT rsid AS snp, ref AS a1, alt AS a2, maf * 1.1 AS maf FROM variants JOIN qc USING (variant) WHERE maf * 1.1 >= 0.01) y USING (snp)""")
def two_panel_maf(spark, sf_dir):
    s = Study(spark, sf_dir)
    x = s.variants.join(variants.variant_qc(s.geno, s.n), "variant").select(F.col("rsid").alias("snp"), F.col("ref").alias("a1"), F.col("alt").alias("a2"), "maf")
    got = variants.two_panel_maf(x.where("maf >= 0.009"), x.withColumn("maf", F.col("maf") * 1.1).where("maf >= 0.01"), 0.0)
    return got.select("snp", r6("maf_1"), r6("maf_2"))


@query("o121_row_index", CTE + "SELECT variant, row_number() OVER (ORDER BY contig, pos) - 1 AS variant_idx FROM variants")
def row_index(spark, sf_dir):
    return intervals.row_index(Study(spark, sf_dir).variants.select("variant", "contig", "pos"), ["pos"]).select("variant", "variant_idx")


@query("o122_sliding_windows", CTE + """, r AS (SELECT contig, min(pos) AS s, max(pos) AS e FROM variants GROUP BY contig), w AS (SELECT contig, unnest(generate_series(s, e - 50, 25)) AS start FROM r WHERE s + 50 <= e)
SELECT w.contig || '_' || w.start AS set_name, count(*) AS n FROM w JOIN variants v ON v.contig = w.contig AND v.pos >= w.start AND v.pos < w.start + 50 GROUP BY 1""")
def sliding_windows(spark, sf_dir):
    v = Study(spark, sf_dir).variants
    return intervals.window_members(v, variants.range_summary(v), 50).groupBy("set_name").agg(F.count("*").alias("n"))


@query("o123_equal_blocks", CTE + """, c AS (SELECT *, count(*) OVER (PARTITION BY contig) AS n, row_number() OVER (PARTITION BY contig ORDER BY pos) - 1 AS rn FROM variants)
SELECT variant, CAST(least(rn // (n // CAST(ceil(n / 70.0) AS BIGINT)), CAST(ceil(n / 70.0) AS BIGINT) - 1) AS INTEGER) AS block FROM c""")
def equal_blocks(spark, sf_dir):
    return intervals.equal_blocks(Study(spark, sf_dir).variants, 70, "rsid").select("variant", "block")


@query("o127_band_sizes", CTE + "SELECT variant, count(*) OVER (PARTITION BY contig ORDER BY pos RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS band FROM variants")
def band_sizes(spark, sf_dir):
    return intervals.band_sizes(Study(spark, sf_dir).variants, 9, "variant").select("variant", "band")


@query("o128_exceeds_band", CTE + """, i AS (SELECT variant, contig, pos, row_number() OVER (ORDER BY contig, pos) - 1 AS idx, count(*) OVER (PARTITION BY contig ORDER BY pos RANGE BETWEEN CURRENT ROW AND 20 FOLLOWING) AS band FROM variants),
m AS (SELECT set_name, idx, band FROM genes g JOIN i ON g.contig = i.contig AND i.pos >= g.start AND i.pos < g."end")
SELECT set_name FROM m GROUP BY set_name HAVING max(idx) - min(idx) >= arg_min(band, idx)""")
def exceeds_band(spark, sf_dir):
    from ..operators.rare import exceeds_band as over

    s = Study(spark, sf_dir)
    v = intervals.row_index(s.variants.select("variant", "contig", "pos"), ["pos"])
    bands = intervals.band_sizes(v, 20, "variant").select("variant_idx", "band")
    return over(intervals.interval_join(v, s.genes).select("set_name", "variant_idx"), bands)


@query("o129_order_check", CTE + ", i AS (SELECT contig, variant AS row_id, CASE WHEN variant % 50 = 7 THEN pos - 3 ELSE pos END AS pos FROM variants), l AS (SELECT *, lag(pos) OVER (PARTITION BY contig ORDER BY row_id) AS before FROM i) SELECT row_id, pos FROM l WHERE before >= pos")
def order_check(spark, sf_dir):
    v = Study(spark, sf_dir).variants.select("contig", F.col("variant").alias("row_id"), F.when(F.col("variant") % 50 == 7, F.col("pos") - 3).otherwise(F.col("pos")).alias("pos"))
    return intervals.check_order(v).select("row_id", "pos")


@query("o132s_first_rows", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")
def first_rows(spark, sf_dir):
    return Study(spark, sf_dir).table("supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(7)


@query("o133s_null_tail", """WITH n AS (SELECT count(*) AS n FROM lineitem), v AS (SELECT CAST(l_suppkey AS INTEGER) AS voxel, list_sort(list(l_quantity)) AS s FROM lineitem WHERE l_suppkey > 0 GROUP BY l_suppkey)
SELECT voxel, list_slice(s, greatest(1, len(s) - greatest(1, CAST(floor(n * 0.001) AS INTEGER)) + 1), len(s)) AS stats FROM v, n""")
def null_tail(spark, sf_dir):
    from ..operators.nulls import merge_permutations

    x = Study(spark, sf_dir).table("lineitem")
    drawn = x.agg(F.count("*").cast("double").alias("stat")).select(F.lit("all").alias("bin"), F.lit(0).alias("voxel"), "stat")
    return merge_permutations([drawn.unionByName(x.where("l_suppkey > 0").select(F.lit("all").alias("bin"), F.col("l_suppkey").cast("int").alias("voxel"), F.col("l_quantity").alias("stat")))], 0.001).select("voxel", "stats")


@query("o137s_stack_tables", "SELECT c_custkey AS id, c_acctbal AS balance, NULL AS extra FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def stack_tables(spark, sf_dir):
    s = Study(spark, sf_dir)
    return sumstats.stack([s.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), s.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("extra"))])


@query("o141_coding_masks", CTE + """, m AS (SELECT exonic IN ('stopgain', 'stoploss') OR category IN ('splicing', 'exonic;splicing', 'ncRNA_splicing', 'ncRNA_exonic;splicing') AS plof, exonic = 'synonymous SNV' AS synonymous, exonic = 'nonsynonymous SNV' AS missense, exonic = 'nonsynonymous SNV' AND metasvm = 'D' AS disruptive_missense,
exonic IN ('stopgain', 'stoploss') OR category IN ('splicing', 'exonic;splicing') AS ptv, variant FROM variants)
SELECT variant, plof, synonymous, missense, disruptive_missense, plof OR disruptive_missense AS plof_ds, ptv, ptv OR disruptive_missense AS ptv_ds FROM m""")
def coding_masks(spark, sf_dir):
    v = Study(spark, sf_dir).variants
    return v.select("variant", *[c.alias(k) for k, c in C.coding_masks(F.col("exonic"), F.col("category"), F.col("metasvm")).items()])


@query("o141_indel_masks", CTE + "SELECT variant, exonic IN ('frameshift insertion', 'frameshift deletion') AS ptv FROM variants")
def indel_masks(spark, sf_dir):
    return Study(spark, sf_dir).variants.select("variant", C.coding_masks(F.col("exonic"), F.col("category"), F.col("metasvm"), "indel")["ptv"].alias("ptv"))


@query("o142_coding_prefilter", CTE + "SELECT variant FROM variants WHERE exonic IN ('stopgain', 'stoploss', 'nonsynonymous SNV', 'synonymous SNV') OR category IN ('splicing', 'exonic;splicing', 'ncRNA_splicing', 'ncRNA_exonic;splicing')")
def coding_prefilter(spark, sf_dir):
    return Study(spark, sf_dir).variants.where(C.coding_prefilter(F.col("exonic"), F.col("category"))).select("variant")


NONCODING = CTE + """, j AS (SELECT set_name, variant, category, info, genehancer FROM genes g JOIN variants v ON g.contig = v.contig AND v.pos >= g.start AND v.pos < g."end")
"""


def _gene_variants(s: Study) -> DataFrame:
    return intervals.interval_join(s.variants, s.genes)


@query("o143_streams", NONCODING + "SELECT set_name, variant, category FROM j WHERE category IN ('upstream', 'downstream') AND contains(info, set_name)")
def streams(spark, sf_dir):
    j = _gene_variants(Study(spark, sf_dir))
    either = C.stream_mask("upstream", F.col("category"), F.col("info"), F.col("set_name")) | C.stream_mask("downstream", F.col("category"), F.col("info"), F.col("set_name"))
    return j.where(either).select("set_name", "variant", "category")


@query("o144_utr", NONCODING + "SELECT set_name, variant FROM j WHERE category = 'UTR3' AND starts_with(info, set_name)")
def utr(spark, sf_dir):
    return _gene_variants(Study(spark, sf_dir)).where(C.utr_mask(F.col("category"), F.col("info"), F.col("set_name"))).select("set_name", "variant")


@query("o145_promoters", NONCODING + "SELECT set_name, variant FROM j WHERE split_part(info, '(', 1) = set_name")
def promoters(spark, sf_dir):
    return _gene_variants(Study(spark, sf_dir)).where(C.promoter_gene(F.col("info")) == F.col("set_name")).select("set_name", "variant")


@query("o146_enhancers", NONCODING + "SELECT set_name, variant FROM j WHERE regexp_extract(genehancer, 'connected_gene=([^;]*)', 1) = set_name")
def enhancers(spark, sf_dir):
    return _gene_variants(Study(spark, sf_dir)).where(C.enhancer_gene(F.col("genehancer")) == F.col("set_name")).select("set_name", "variant")


@query("o147_ncrna", NONCODING + "SELECT set_name, variant FROM j WHERE category = 'ncRNA_exonic' AND contains(split_part(info, ';', 1), set_name)")
def ncrna(spark, sf_dir):
    return _gene_variants(Study(spark, sf_dir)).where(C.ncrna_mask(F.col("category"), F.col("info"), F.col("set_name"))).select("set_name", "variant")


@query("o148_variant_names", CTE + "SELECT 'chr' || contig || ':' || pos || ':' || ref || ':' || alt AS name, contig, pos, ref, alt FROM variants")
def variant_names(spark, sf_dir):
    named = Study(spark, sf_dir).variants.select(C.variant_name(F.concat(F.lit("chr"), F.col("contig")), F.col("pos"), F.col("ref"), F.col("alt")).alias("name"))
    return named.select("name", *C.parse_variant(F.col("name")))


@query("o149_annotation_transform", CTE + "SELECT variant, round(-10 * log10(1 - pow(10.0, -phred / 10)), 6) AS local_diversity FROM variants")
def annotation_transform(spark, sf_dir):
    return Study(spark, sf_dir).variants.select("variant", F.round(C.complement_phred(F.col("phred")), 6).alias("local_diversity"))


@query("o150_phred_weights", CTE + "SELECT variant, round(1 - pow(10.0, -phred / 10), 6) AS weight FROM variants")
def phred_weights(spark, sf_dir):
    return Study(spark, sf_dir).variants.select("variant", F.round(C.phred_weight(F.col("phred")), 6).alias("weight"))


@query("o151_beta_weights", CTE + "SELECT variant, round(25 * pow(1 - maf, 24), 6) AS weight FROM qc")
def beta_weights(spark, sf_dir):
    s = Study(spark, sf_dir)
    return variants.variant_qc(s.geno, s.n).select("variant", F.round(C.maf_weight(F.col("maf")), 6).alias("weight"))


@query("o152_dummies", """SELECT c_custkey AS iid, 1.0::DOUBLE AS intercept, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS d1, CAST(c_mktsegment = 'FURNITURE' AS DOUBLE) AS d2, CAST(c_mktsegment = 'HOUSEHOLD' AS DOUBLE) AS d3, CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS d4, CAST(c_nationkey AS DOUBLE) AS nation FROM customer""")
def dummies(spark, sf_dir):
    from ..operators.linear import design

    c = Study(spark, sf_dir).table("customer").withColumnRenamed("c_custkey", "iid")
    x, _ = design(c, ["c_nationkey"], ["c_mktsegment"])
    return x.select("iid", *[F.get("x", i).alias(n) for i, n in enumerate(["intercept", "d1", "d2", "d3", "d4", "nation"])])


@query("o156_z_scores", CTE + "SELECT snp, pos, round(effect / se, 6) AS z FROM panel")
def z_scores(spark, sf_dir):
    return sumstats.with_z(Study(spark, sf_dir).panel.drop("z")).select("snp", "pos", r6("z"))


@query("o157_cmac_bin_of_sets", CTE + """, s AS (SELECT variant // 2 AS pair, CAST(sum(mac) AS BIGINT) AS cmac FROM qc GROUP BY 1) SELECT pair, cmac, CASE WHEN cmac BETWEEN 21 AND 30 THEN '21_30' WHEN cmac BETWEEN 31 AND 60 THEN '31_60' WHEN cmac BETWEEN 61 AND 100 THEN '61_100' WHEN cmac BETWEEN 15 AND 20 THEN '15_20' WHEN cmac BETWEEN 12 AND 14 THEN '12_14' END AS bin FROM s WHERE cmac >= 12""")
def cmac_bin_of_sets(spark, sf_dir):
    s = Study(spark, sf_dir)
    c = variants.variant_qc(s.geno, s.n).groupBy(F.floor(F.col("variant") / 2).alias("pair")).agg(F.sum("mac").alias("cmac"))
    return c.where("cmac >= 12").select("pair", "cmac", variants.cmac_bin(F.col("cmac")).alias("bin"))


@query("o158_scientific", CTE + "SELECT snp, pos, format('{:.5e}', effect) AS effect FROM panel WHERE maf < 0.05")
def scientific(spark, sf_dir):
    return Study(spark, sf_dir).panel.where("maf < 0.05").select("snp", "pos", C.scientific(F.col("effect")).alias("effect"))


@query("o089_rename_columns", CTE + 'SELECT chr AS "CHR", pos AS "POS", snp AS "SNP" FROM panel WHERE n = 1')
def rename_columns(spark, sf_dir):
    return Study(spark, sf_dir).panel.where("n = 1").select("chr", "pos", "snp").withColumnsRenamed({"chr": "CHR", "pos": "POS", "snp": "SNP"})


@query("o090_annotation_table", CTE + "SELECT contig, pos, ref, alt, CASE WHEN variant % 9 = 0 THEN 0 ELSE phred END AS cadd, category FROM variants")
def annotation_table(spark, sf_dir):
    v = Study(spark, sf_dir).variants
    raw = v.select(F.concat_ws("-", "contig", F.col("pos").cast("string"), "ref", "alt").alias("variant_vcf"), F.when(F.col("variant") % 9 == 0, None).otherwise(F.col("phred").cast("string")).alias("cadd_phred"), "category")
    got = sumstats.annotation_table(raw, {"cadd_phred": "CADD", "category": "category"}, ["CADD"])
    return got.select("contig", "pos", "ref", "alt", F.col("annot.CADD").alias("cadd"), F.col("annot.category").alias("category"))


@query("o016_recode_contigs", CTE + "SELECT contig, 'chr' || contig AS recoded, count(*) AS n FROM variants GROUP BY contig")
def recode_contigs(spark, sf_dir):
    return Study(spark, sf_dir).variants.groupBy("contig", C.recode_contig(F.col("contig"), "GRCh38").alias("recoded")).agg(F.count("*").alias("n"))
