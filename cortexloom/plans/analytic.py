"""Queries of the numeric operators: regression, projection, recovery, LD, heritability, set tests, nulls."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import stats
from ..operators import images, intervals, ld, linear, masks, nulls, permutations, rare, relatedness, spectrum, variants
from ..session import scratch
from .registry import query
from .surrogate import COMPONENTS, CTE, VOXELS, Study

SUBJECTS = """, s AS (SELECT c_custkey AS iid, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal AS y1, c_acctbal / 100 + c_nationkey AS y2 FROM customer)"""
BASES = """, basis AS (SELECT v, j, sqrt(2.0 / 64) * cos(3.141592653589793 * (v + 0.5) * j / 64) AS b FROM (SELECT unnest(generate_series(0, 63)) AS v) a, (SELECT unnest(generate_series(0, 7)) AS j) c)"""
LD_WIDTH = 3


def r6(name: str, source=None):
    return F.round(F.col(name) if source is None else source, 6).alias(name)


@query("o116_cross_products", CTE + SUBJECTS + "SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(x * x) AS BIGINT) AS sxx, round(sum(y1), 2) AS sy, round(sum(x * y1), 2) AS sxy FROM s")
def cross_products(spark, sf_dir):
    p = linear.cross_products(Study(spark, sf_dir).subjects)
    return spark.createDataFrame([(int(p["n"]), round(p["xx"][0, 1]), round(p["xx"][1, 1]), round(float(p["xy"][0, 0]), 2), round(float(p["xy"][1, 0]), 2))], "n long, sx long, sxx long, sy double, sxy double")


@query("o117_component_covariance", CTE + SUBJECTS + "SELECT round(var_pop(y1) * (1 - power(corr(x, y1), 2)), 2) AS c11, round(covar_pop(y1, y2) - covar_pop(x, y1) * covar_pop(x, y2) / var_pop(x), 2) AS c12, round(var_pop(y2) * (1 - power(corr(x, y2), 2)), 2) AS c22 FROM s")
def component_covariance(spark, sf_dir):
    c = linear.covariance(linear.cross_products(Study(spark, sf_dir).subjects))
    return spark.createDataFrame([(round(float(c[0, 0]), 2), round(float(c[0, 1]), 2), round(float(c[1, 1]), 2))], "c11 double, c12 double, c22 double")


@query("o118_voxel_means", "SELECT CAST(v - 1 AS INTEGER) AS voxel, round(avg(CAST(embedding[v] AS DOUBLE)), 6) AS mean FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS v) GROUP BY v")
def voxel_means(spark, sf_dir):
    return images.voxel_means(Study(spark, sf_dir).images).select(F.col("voxel").cast("int").alias("voxel"), r6("mean"))


@query("o161_gwas", CTE + SUBJECTS + """, t AS (SELECT count(*) AS n, sum(y1) AS s1, sum(y2) AS s2, sum(y1 * y1) AS q1 FROM s),
g AS (SELECT variant, CAST(sum(dosage) AS DOUBLE) AS sg, CAST(sum(dosage * dosage) AS DOUBLE) AS gg, sum(dosage * y1) AS g1, sum(dosage * y2) AS g2 FROM geno JOIN s USING (iid) GROUP BY variant),
c AS (SELECT variant, n, sg, gg - sg * sg / n AS sxx, g1 - sg * s1 / n AS x1, g2 - sg * s2 / n AS x2, q1 - s1 * s1 / n AS yy FROM g, t)
SELECT variant, n AS n_called, round(sg / n / 2, 6) AS alt_allele_freq, round(x1 / sxx, 3) AS beta_1, round(x2 / sxx, 3) AS beta_2, round(sqrt((yy - x1 * x1 / sxx) / (n - 2) / sxx), 3) AS se_1 FROM c""")
def gwas(spark, sf_dir):
    s = Study(spark, sf_dir)
    g = linear.gwas(s.geno, s.plain_subjects)
    return g.select("variant", "n_called", r6("alt_allele_freq"), F.round(F.get("beta", 0), 3).alias("beta_1"), F.round(F.get("beta", 1), 3).alias("beta_2"), F.round(F.get("standard_error", 0), 3).alias("se_1"))


@query("o161_gwas_with_covariates", CTE + SUBJECTS + """, f AS (SELECT iid, y1 - (regr_slope(y1, x) OVER () * x + regr_intercept(y1, x) OVER ()) AS r, x FROM s), t AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS xx, sum(r * r) AS rr FROM f),
g AS (SELECT variant, CAST(sum(dosage) AS DOUBLE) AS sg, CAST(sum(dosage * dosage) AS DOUBLE) AS gg, sum(dosage * x) AS gx, sum(dosage * r) AS gr FROM geno JOIN f USING (iid) GROUP BY variant),
l AS (SELECT variant, gr, rr, n, gg - (sg * sg * xx - 2 * sg * gx * sx + gx * gx * n) / (n * xx - sx * sx) AS rest FROM g, t)
SELECT variant, round(gr / rest, 4) AS beta, round(sqrt((rr - gr * gr / rest) / (n - 3) / rest), 4) AS se FROM l""")
def gwas_with_covariates(spark, sf_dir):
    s = Study(spark, sf_dir)
    return linear.gwas(s.geno, s.subjects).select("variant", F.round(F.get("beta", 0), 4).alias("beta"), F.round(F.get("standard_error", 0), 4).alias("se"))


@query("o161_gwas_all_variants")
def gwas_all(spark, sf_dir):
    s = Study(spark, sf_dir)
    return linear.gwas(s.geno, s.subjects)


@query("o162_component_projection", "WITH a AS (SELECT 1)" + BASES + "SELECT vec_id AS iid, CAST(j AS INTEGER) AS component, round(sum(CAST(embedding[v + 1] AS DOUBLE) * b), 6) AS value FROM embeddings, basis GROUP BY vec_id, j")
def component_projection(spark, sf_dir):
    s = Study(spark, sf_dir)
    return linear.project(s.images, s.bases).select("iid", F.posexplode("ldr").alias("component", "value")).select("iid", F.col("component").cast("int").alias("component"), r6("value"))


@query("o159_reconstruction_quality", "WITH a AS (SELECT 1)" + BASES + """, y AS (SELECT vec_id, v, CAST(embedding[v + 1] AS DOUBLE) AS y FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS v)), c AS (SELECT vec_id, j, sum(y * b) AS c FROM y JOIN basis USING (v) WHERE j > 0 GROUP BY 1, 2),
k AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS step, unnest([1, 1, 2, 3, 4, 4, 5, 6, 6, 7]) AS r), z AS (SELECT step, vec_id, v, sum(c * b) AS z FROM c JOIN basis USING (j), k WHERE j <= r GROUP BY 1, 2, 3),
q AS (SELECT step, vec_id, corr(y, z) AS q FROM z JOIN y USING (vec_id, v) GROUP BY 1, 2) SELECT step / 10 AS share, round(avg(q), 6) AS corr FROM q GROUP BY step""")
def reconstruction_quality(spark, sf_dir):
    s = Study(spark, sf_dir)
    return linear.reconstruction_quality(s.images, s.bases.withColumn("b", F.slice("b", 2, COMPONENTS - 1))).select("share", r6("corr"))


@query("o165_principal_components")
def principal_components(spark, sf_dir):
    _, values = linear.principal_components(Study(spark, sf_dir).images, 10)
    return spark.createDataFrame([(i + 1, float(v), linear.effective_tests(values)) for i, v in enumerate(values)], "component int, eigenvalue double, effective double")


@query("o165_total_variance", "SELECT CAST(count(DISTINCT vec_id) AS BIGINT) AS images, CAST(max(v) AS INTEGER) AS voxels, round(sum((CAST(embedding[v] AS DOUBLE) - m) * (CAST(embedding[v] AS DOUBLE) - m)), 6) AS variance FROM embeddings, (SELECT v, avg(CAST(embedding[v] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS v) GROUP BY v)")
def total_variance(spark, sf_dir):
    """What the eigenvalues of all components add up to."""
    s = spectrum.ImageSpectrum(Study(spark, sf_dir).images)
    return spark.createDataFrame([(s.n, s.width, round(s.trace, 6))], "images long, voxels int, variance double")


@query("o120_variance_proportions", """WITH e AS (SELECT sum(l_quantity) AS v FROM lineitem GROUP BY l_partkey % 37), c AS (SELECT sum(v) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS c FROM e)
SELECT CAST(p AS DOUBLE) AS prop_var, CAST(1 + count(*) FILTER (c <= p) AS INTEGER) AS n_ldrs FROM c, (SELECT unnest([0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS p) GROUP BY p""")
def variance_proportions(spark, sf_dir):
    return spark.createDataFrame(linear.proportions(_spectrum(Study(spark, sf_dir))), "prop_var double, n_ldrs int")


def _spectrum(s: Study) -> np.ndarray:
    """37 falling values that stand for eigenvalues."""
    return np.array([r[0] for r in s.table("lineitem").groupBy(F.col("l_partkey") % 37).agg(F.sum("l_quantity").alias("v")).select("v").orderBy(F.desc("v")).collect()])


@query("o119_effective_tests", "SELECT round(power(sum(v), 2) / sum(v * v), 6) AS effective FROM (SELECT sum(l_quantity) AS v FROM lineitem GROUP BY l_partkey % 37)")
def effective_tests(spark, sf_dir):
    return spark.createDataFrame([(round(linear.effective_tests(_spectrum(Study(spark, sf_dir))), 6),)], "effective double")


@query("o166_imputed_eigenvalues", """WITH e AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS k FROM (SELECT sum(l_quantity) AS v FROM lineitem GROUP BY l_partkey % 37)), l AS (SELECT max(ln(v)) FILTER (k = 37) AS last, max(ln(v)) FILTER (k = 37) - max(ln(v)) FILTER (k = 36) AS slope FROM e)
SELECT CAST(k AS INTEGER) AS place, round(v, 4) AS value FROM e UNION ALL SELECT CAST(37 + i AS INTEGER), round(exp(last + slope * i), 4) FROM l, (SELECT unnest(generate_series(1, 13)) AS i)""")
def imputed_eigenvalues(spark, sf_dir):
    values = linear.impute_eigenvalues(_spectrum(Study(spark, sf_dir)), 50)
    return spark.createDataFrame([(i + 1, round(float(v), 4)) for i, v in enumerate(values)], "place int, value double")


@query("o168_voxel_recovery", CTE + BASES + """, st AS (SELECT p_partkey AS snp, CAST(p_size AS DOUBLE) + 100 AS n, j, sin(p_partkey * 0.37 + j + 1) AS beta, sin(p_partkey * 0.37 + j + 1) / (0.5 + 0.01 * (p_partkey % 7)) AS z FROM part, (SELECT unnest(generate_series(0, 7)) AS j)),
k AS (SELECT snp, n, avg((power(beta / z, 2) + beta * beta / n) / (1 + 0.1 * j)) AS k FROM st GROUP BY snp, n),
q AS (SELECT v, sum(b * b * (1 + 0.1 * j)) AS quad FROM basis GROUP BY v), e AS (SELECT snp, v, sum(beta * b) AS bv FROM st JOIN basis USING (j) GROUP BY snp, v)
SELECT CAST(v + 1 AS INTEGER) AS "index", snp, round(bv, 5) + 0.0 AS beta, round(sqrt(k * quad - bv * bv / n), 5) AS se FROM e JOIN k USING (snp) JOIN q USING (v)""")
def voxel_recovery(spark, sf_dir):
    s = Study(spark, sf_dir)
    j = F.sequence(F.lit(0), F.lit(COMPONENTS - 1))
    effect = lambda k: F.sin(F.col("p_partkey") * 0.37 + k + 1)
    table = s.table("part").select(F.col("p_partkey").alias("snp"), (F.col("p_size").cast("double") + 100).alias("n"), F.transform(j, effect).alias("beta"), F.transform(j, lambda k: effect(k) / (0.5 + 0.01 * (F.col("p_partkey") % 7))).alias("z"))
    got = linear.recover_voxels(table, s.bases, np.diag(1 + 0.1 * np.arange(COMPONENTS)))
    return got.select("index", "snp", (F.round("beta", 5) + 0.0).alias("beta"), F.round("se", 5).alias("se"))


@query("o168_significant_voxels")
def significant_voxels(spark, sf_dir):
    s = Study(spark, sf_dir)
    subjects = linear.project(s.images, s.bases).select("iid", F.array(F.lit(1.0)).alias("x"), F.col("ldr").alias("y"))
    cov = linear.covariance(linear.cross_products(subjects))
    g = linear.gwas(s.geno_of(s.images.select("iid")), subjects)
    table = g.select("variant", F.col("n_called").cast("double").alias("n"), "beta", F.col("t_stat").alias("z")).where(~F.exists("z", lambda v: F.isnan(v)))
    return linear.recover_voxels(table, s.bases, cov, max_p=1e-3)


@query("o175_null_residuals", CTE + SUBJECTS + "SELECT iid, round(y1 - (regr_slope(y1, x) OVER () * x + regr_intercept(y1, x) OVER ()), 4) AS resid FROM s")
def null_residuals(spark, sf_dir):
    return linear.residuals(Study(spark, sf_dir).subjects).select("iid", F.round(F.get("resid", 0), 4).alias("resid"))


@query("o176_set_scores", CTE + SUBJECTS + """, r AS (SELECT iid, y1 - avg(y1) OVER () AS r1 FROM s) SELECT variant, round(sum(dosage * r1), 4) AS score FROM geno JOIN r USING (iid) GROUP BY variant""")
def set_scores(spark, sf_dir):
    s = Study(spark, sf_dir)
    return rare.scores(s.geno, linear.residuals(s.plain_subjects)).select("variant", F.round(F.get("score", 0), 4).alias("score"))


@query("o177_projections", CTE + "SELECT variant, round(ac / sqrt(n), 6) AS proj FROM qc, num")
def projections(spark, sf_dir):
    s = Study(spark, sf_dir)
    null = linear.residuals(s.plain_subjects)
    return rare.projections(s.geno, null, np.array([[float(s.n)]])).select("variant", r6("proj", F.get("proj", 0)))


@query("o177_banded_ld", CTE + f"""SELECT a.variant AS i, b.variant AS j, CAST(sum(a.dosage * b.dosage) AS BIGINT) AS value FROM geno a JOIN variants va ON va.variant = a.variant JOIN geno b ON a.iid = b.iid JOIN variants vb ON vb.variant = b.variant
WHERE va.contig = vb.contig AND vb.pos >= va.pos AND vb.pos <= va.pos + {LD_WIDTH} GROUP BY 1, 2""")
def banded_ld(spark, sf_dir):
    s = Study(spark, sf_dir)
    return rare.banded_ld(s.geno, s.variants, LD_WIDTH)


@query("o032_symmetric_ld", CTE + """, u AS (SELECT a.variant AS i, b.variant AS j, CAST(sum(a.dosage * b.dosage) AS BIGINT) AS value FROM geno a JOIN geno b ON a.iid = b.iid AND b.variant BETWEEN a.variant AND a.variant + 1 AND a.variant // 500 = b.variant // 500 GROUP BY 1, 2)
SELECT i, j, value FROM u UNION ALL SELECT j, i, value FROM u WHERE i <> j""")
def symmetric_ld(spark, sf_dir):
    s = Study(spark, sf_dir)
    return rare.symmetric(rare.banded_ld(s.geno, s.variants, 1))


@query("o178_voxel_variance", CTE + SUBJECTS + "SELECT round(sum(power(y1, 2)) / (count(*) - 1) - count(*) * power(avg(y1), 2) / (count(*) - 1), 2) AS v1, round(var_samp(y2), 2) AS v2 FROM s")
def voxel_variance(spark, sf_dir):
    v = rare.voxel_variance(linear.residuals(Study(spark, sf_dir).plain_subjects), np.eye(2), 1)
    return spark.createDataFrame([(round(float(v[0]), 2), round(float(v[1]), 2))], "v1 double, v2 double")


def _kept_calls(s: Study, rare_ones: bool = False) -> DataFrame:
    """The genotypes, written once: counts, scores, projections and products read them apart."""
    path = scratch(s.spark, "calls")
    (s.rare_geno if rare_ones else s.geno).write.parquet(path)
    return s.spark.read.parquet(path)


def _written_rows(s: Study, geno: DataFrame, null: DataFrame, xx: np.ndarray) -> DataFrame:
    """A row a variant with its measures, sums and calls, written once: members, masks and conditions read it apart."""
    path = scratch(s.spark, "variants")
    rare.variant_rows(geno, null, xx, s.n).write.parquet(path)
    return s.spark.read.parquet(path)


def _summary(s: Study, null: DataFrame | None = None):
    """Members of genes with scores and projections, and the calls of rare variants; one covariate, two components."""
    null = linear.residuals(s.plain_subjects) if null is None else null
    xx, bases = np.array([[float(s.n)]]), np.eye(2)
    calls = _written_rows(s, s.geno, null, xx).where(variants.maf_filter(0, 0.01))
    table = calls.drop("iids", "dosages")
    variance = rare.voxel_variance(null, bases, 1)
    placed = table.join(s.variants.select("variant", "contig", "pos", "phred"), "variant")
    members = intervals.interval_join(placed, s.genes).select("set_name", F.lit("all").alias("mask"), "variant", "maf", "mac", "score", "proj", F.array("phred").alias("annot"))
    return members, calls, bases, variance, table


@query("o188_single_variants", CTE + SUBJECTS + """, r AS (SELECT iid, y1 - avg(y1) OVER () AS r1 FROM s), v AS (SELECT var_samp(y1) AS s2 FROM s),
t AS (SELECT variant, sum(dosage * r1) AS score, sum(dosage * dosage) AS zz FROM geno JOIN r USING (iid) GROUP BY variant)
SELECT variant, round(score / (zz - ac * ac / CAST(n AS DOUBLE)), 4) AS beta, round(sqrt(s2 / (zz - ac * ac / CAST(n AS DOUBLE))), 4) AS se FROM t JOIN qc USING (variant), num, v WHERE mac >= 5""")
def single_variants(spark, sf_dir):
    s = Study(spark, sf_dir)
    null = linear.residuals(s.plain_subjects)
    variance = rare.voxel_variance(null, np.eye(2), 1)
    diag = s.geno.groupBy("variant").agg((F.sum(F.col("dosage") * F.col("dosage")) - F.pow(F.sum("dosage"), F.lit(2)) / s.n).alias("diag"))
    summary = variants.variant_qc(s.geno, s.n).select("variant", "maf", "mac").join(rare.scores(s.geno, null), "variant").join(diag, "variant")
    return rare.single_variants(summary, np.eye(2), variance).where("index = 1").select("variant", F.round("beta", 4).alias("beta"), F.round("se", 4).alias("se"))


@query("o180_burden_test", CTE + SUBJECTS + """, r AS (SELECT iid, y1 - avg(y1) OVER () AS r1 FROM s), v AS (SELECT var_samp(y1) AS s2 FROM s),
m AS (SELECT set_name, variant, mac FROM genes g JOIN variants x ON g.contig = x.contig AND x.pos >= g.start AND x.pos < g."end" JOIN qc q USING (variant) WHERE maf > 0 AND maf <= 0.01),
k AS (SELECT set_name, count(*) AS n_variants, CAST(sum(mac) AS BIGINT) AS cmac FROM m GROUP BY set_name HAVING count(*) >= 2),
b AS (SELECT set_name, iid, sum(dosage) AS load FROM m JOIN geno USING (variant) GROUP BY set_name, iid),
t AS (SELECT set_name, sum(load * r1) AS score, sum(load * load) - power(sum(load), 2) / max(num.n) AS cov FROM b JOIN r USING (iid), num GROUP BY set_name)
SELECT set_name, n_variants, cmac, round(score / cov, 4) AS burden_effect, round(sqrt(s2 / cov), 4) AS burden_se FROM k JOIN t USING (set_name), v""")
def burden_test(spark, sf_dir):
    members, calls, bases, variance, _ = _summary(Study(spark, sf_dir))
    got = rare.set_tests(members, None, bases, variance, ("burden",), calls=calls)
    return got.where("index = 1").select("set_name", F.col("n_variants").cast("long").alias("n_variants"), "cmac", F.round("burden_effect", 4).alias("burden_effect"), F.round("burden_se", 4).alias("burden_se"))


@query("o185_omnibus_tests")
def omnibus_tests(spark, sf_dir):
    members, calls, bases, variance, _ = _summary(Study(spark, sf_dir))
    return rare.set_tests(members, None, bases, variance, ("burden", "skat", "staar"), calls=calls)


@query("o196_named_results")
def named_results(spark, sf_dir):
    members, calls, bases, variance, _ = _summary(Study(spark, sf_dir))
    return rare.named(rare.set_tests(members, None, bases, variance, calls=calls), ["phred"])


@query("o190_bootstrap_clusters")
def bootstrap_clusters(spark, sf_dir):
    s = Study(spark, sf_dir)
    bases = spark.createDataFrame([(v, [math.cos(v / 5), math.sin(v / 5)]) for v in range(20)], "voxel int, b array<double>")
    return nulls.bootstrap_clusters(s.geno, s.plain_subjects, bases, 100, 0.05)


@query("o191_permuted_clusters")
def permuted_clusters(spark, sf_dir):
    s = Study(spark, sf_dir)
    null = linear.residuals(s.plain_subjects)
    side = permutations.Side(null, ["resid"], index=False)
    members, calls, bases, variance, _ = _summary(s, null.join(side.placed.select("iid", "place"), "iid"))
    return nulls.permuted_clusters(members.drop("score"), calls, null, bases, variance, 100, 0.05, side=side)


@query("o122_sliding_window_tests")
def sliding_window_tests(spark, sf_dir):
    s = Study(spark, sf_dir)
    _, calls, bases, variance, _ = _summary(s)
    placed = calls.join(s.variants.select("variant", "contig", "pos"), "variant")
    members = intervals.window_members(placed, variants.range_summary(s.variants), 20).select("set_name", F.lit("window").alias("mask"), "variant", "maf", "mac", "score", "proj", F.lit(None).cast("array<double>").alias("annot"), "iids", "dosages")
    return rare.set_tests(members, None, bases, variance, ("burden", "skat"), cmac_min=10, calls=calls)


@query("o187_conditional_test")
def conditional_test(spark, sf_dir):
    s = Study(spark, sf_dir)
    given = [1, 2]
    subjects = rare.conditional_null(s.plain_subjects, s.geno, given)
    return linear.gwas(s.geno.where(~F.col("variant").isin(given)), subjects)


def _tested_variants(s: Study) -> tuple:
    """Scores and projections of all called variants with their annotations, the null model's sums, and the calls."""
    null, products = linear.residuals(s.subjects), linear.cross_products(s.subjects)
    rows = _written_rows(s, s.geno, null, products["xx"])
    inner = linear.cross_products(null.select("iid", F.array(F.lit(1.0)).alias("x"), F.col("resid").alias("y")))["yy"]
    return rows.drop("iids", "dosages"), null, inner, products["n"] - len(products["xx"]), rows


def _mask_members(s: Study, summary: DataFrame, noncoding: bool = False) -> DataFrame:
    placed = s.variants.join(summary.where(variants.maf_filter(0, 0.05)), "variant").withColumn("annot", F.array("phred"))
    own = masks.noncoding_members(placed.withColumns({"cage": F.lit(None).cast("string"), "dhs": F.lit(None).cast("string")}), s.genes) if noncoding else masks.coding_members(placed, s.genes)
    return own.select("set_name", "mask", "variant", "maf", "mac", "score", "proj", "annot")


def known_loci(s: Study, null: DataFrame) -> DataFrame:
    """contig, pos, snp, variant of the variants that a component shows at p < 0.01, pruned to r2 of 0.3 (O-187)."""
    hits = linear.gwas(s.geno, null.select("iid", "x", "y")).where(F.exists("p_value", lambda p: p < 0.01)).select("variant")
    called = _called(s, s.geno.join(hits, "variant", "left_semi"))
    return ld.ld_prune_called(called, s.n, 0.3, 20).withColumn("variant", F.substring("snp", 3, 18).cast("long"))


@query("o187_conditional_sets")
def conditional_sets(spark, sf_dir):
    """Coding masks of each gene, conditioned on the known loci up to 40 positions from it."""
    s = Study(spark, sf_dir)
    summary, null, inner, df, geno = _tested_variants(s)
    near = s.genes.select("set_name", "contig", (F.col("start") - 40).alias("start"), (F.col("end") + 40).alias("end"))
    given = intervals.interval_join(known_loci(s, null).join(summary.select("variant", "score", "proj"), "variant"), near).select("set_name", "variant", "score", "proj")
    bases = np.eye(2)
    return rare.named(rare.set_tests(_mask_members(s, summary), None, bases, np.diag(inner) / df, calls=geno, given=given, inner=inner, df=df), ["phred"])


@query("o185_mask_tests")
def mask_tests(spark, sf_dir):
    """Coding and noncoding masks of all genes into set tests."""
    s = Study(spark, sf_dir)
    summary, _, inner, df, geno = _tested_variants(s)
    members = _mask_members(s, summary).unionByName(_mask_members(s, summary, noncoding=True))
    return rare.named(rare.set_tests(members, None, np.eye(2), np.diag(inner) / df, calls=geno), ["phred"])


@query("o184_cauchy", CTE + "SELECT snp, pos, n, round(0.5 - atan((tan((0.5 - p1) * pi()) + tan((0.5 - p2) * pi())) / 2) / pi(), 6) AS p FROM (SELECT snp, pos, n, (n + 0.5) / 60 AS p1, (maf + 0.01) / 2 AS p2 FROM panel)")
def cauchy(spark, sf_dir):
    p = Study(spark, sf_dir).panel
    return p.select("snp", "pos", "n", F.round(C.cauchy([(F.col("n") + 0.5) / 60, (F.col("maf") + 0.01) / 2]), 6).alias("p"))


@query("o195_jackknife", """WITH b AS (SELECT l_suppkey % 20 AS block, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(s) AS s, sum(n) AS n FROM b), l AS (SELECT (t.s - b.s) / (t.n - b.n) AS e FROM b, t)
SELECT round(20 * max(t.s / t.n) - 19 * avg(e), 6) AS estimate, round(sqrt(19.0 / 20 * sum(power(e - m, 2))), 6) AS se FROM (SELECT e, avg(e) OVER () AS m FROM l), t""")
def jackknife(spark, sf_dir):
    blocks = Study(spark, sf_dir).table("lineitem").groupBy((F.col("l_suppkey") % 20).alias("block")).agg(F.sum("l_quantity").alias("s"), F.count("*").alias("n")).orderBy("block").collect()  # 20 rows
    s, n = (np.array([r[c] for r in blocks], float) for c in ("s", "n"))
    estimate, se = ld.jackknife(np.array([s.sum() / n.sum()]), ((s.sum() - s) / (n.sum() - n))[:, None])
    return spark.createDataFrame([(round(float(estimate[0]), 6), round(float(se[0]), 6))], "estimate double, se double")


HWE_SQL = """, k AS (SELECT variant, n_called AS n, n_het AS het, 2 * least(n_called - n_het - n_hom_alt, n_hom_alt) + n_het AS rare FROM qc),
h AS (SELECT variant, het, rare, unnest(generate_series(rare % 2, rare, 2)) AS h, n FROM k), p AS (SELECT variant, het, h, h * ln(2) - lgamma(h + 1) - lgamma((rare - h) / 2 + 1) - lgamma(n - (rare + h) / 2 + 1) AS l FROM h),
q AS (SELECT variant, het, h, exp(l - max(l) OVER (PARTITION BY variant)) AS p FROM p), o AS (SELECT variant, p AS own FROM q WHERE h = het),
e AS (SELECT variant, least(1.0, (sum(CASE WHEN p < own * (1 - 1e-9) THEN p WHEN p <= own * (1 + 1e-9) THEN p / 2 ELSE 0 END)) / sum(p)) AS p_hwe FROM q JOIN o USING (variant) GROUP BY variant)
"""


@query("o104_hardy_weinberg", CTE + HWE_SQL + "SELECT variant, round(p_hwe, 6) AS p_hwe FROM e")
def hardy_weinberg(spark, sf_dir):
    s = Study(spark, sf_dir)
    return variants.hwe_p(variants.variant_qc(s.geno, s.n)).select("variant", r6("p_hwe"))


@query("o072_hwe_filter", CTE + HWE_SQL + "SELECT variant FROM e WHERE p_hwe >= 0.3")
def hwe_filter(spark, sf_dir):
    from ..config import VariantFilter

    s = Study(spark, sf_dir)
    return variants.quality(variants.hwe_p(variants.variant_qc(s.geno, s.n)), VariantFilter(hwe=0.3)).select("variant")


@query("o155_tails")
def tails(spark, sf_dir):
    return Study(spark, sf_dir).panel.select("snp", "pos", "z", C.chi2_sf(F.col("z") * F.col("z")).alias("p"))


def _calls(s: Study) -> DataFrame:
    """Genotypes with the place of their variants; operators make them dense block by block."""
    return s.geno.join(s.variants.select("variant", "contig", "pos", F.col("rsid").alias("snp")), "variant")


def _called(s: Study, geno: DataFrame) -> DataFrame:
    """A row a variant with its calls and place; only numbers are shuffled for each call."""
    return ld.called_rows(geno, "variant").join(s.variants.select("variant", "contig", "pos", F.col("rsid").alias("snp")), "variant")


def _blocks(s: Study) -> DataFrame:
    return ld.ld_blocks(_calls(s).select(F.floor(F.col("pos") / 50).cast("int").alias("block_idx"), "snp", "pos", "iid", "dosage"), n=s.n)


def _kept_blocks(s: Study) -> DataFrame:
    """The blocks, written once: estimates read their keys, factors and scores apart."""
    path = scratch(s.spark, "blocks")
    _blocks(s).write.parquet(path)
    return s.spark.read.parquet(path)


@query("o167_ld_scores", CTE + """, m AS (SELECT variant, pos // 50 AS block, ac / CAST(n AS DOUBLE) AS mean, sqrt((SELECT sum(dosage * dosage) FROM geno g WHERE g.variant = qc.variant) / CAST(n AS DOUBLE) - power(ac / CAST(n AS DOUBLE), 2)) AS sd FROM qc JOIN variants USING (variant), num),
b AS (SELECT g.variant, g.iid, g.dosage, m.block FROM geno g JOIN m USING (variant)), x AS (SELECT a.variant AS i, c.variant AS j, sum(a.dosage * c.dosage) AS s FROM b a JOIN b c ON a.block = c.block AND a.iid = c.iid GROUP BY 1, 2),
r AS (SELECT p.variant AS i, count(*) AS p, sum(power((coalesce(s, 0) / CAST(n AS DOUBLE) - p.mean * q.mean) / (p.sd * q.sd), 2)) AS r2 FROM m p JOIN m q ON p.block = q.block LEFT JOIN x ON x.i = p.variant AND x.j = q.variant, num GROUP BY 1)
SELECT CAST(m.block AS INTEGER) AS block_idx, 'rs' || m.variant AS snp, CAST(m.variant AS INTEGER) AS pos, round(r2 - (p - r2) / (n - 2), 6) AS ldscore FROM r JOIN m ON r.i = m.variant, num""")
def ld_scores(spark, sf_dir):
    return _blocks(Study(spark, sf_dir)).select("block_idx", "snp", "pos", F.round("ldscore", 6).alias("ldscore"))


@query("o187_ld_prune")
def ld_prune(spark, sf_dir):
    s = Study(spark, sf_dir)
    return ld.ld_prune_called(_called(s, s.geno), s.n, 0.3, 20)


def _component_stats(s: Study) -> tuple:
    subjects = s.plain_subjects
    cov = linear.covariance(linear.cross_products(subjects))
    g = linear.gwas(s.geno, subjects)
    table = g.select(F.concat(F.lit("rs"), F.col("variant").cast("string")).alias("snp"), F.col("n_called").cast("double").alias("n"), F.col("t_stat").alias("z"), (F.get("t_stat", 0) * 0.9 + 0.1).alias("z2"), F.col("n_called").cast("double").alias("n2"))
    return table, cov


@query("o169_heritability")
def heritability(spark, sf_dir):
    s = Study(spark, sf_dir)
    table, cov = _component_stats(s)
    return spark.createDataFrame(ld.Heritability(table, _kept_blocks(s), np.array([[1.0, 0.0], [0.6, 8.0], [0.0, 1.0]]), cov).heritability())


@query("o170_genetic_correlation")
def genetic_correlation(spark, sf_dir):
    s = Study(spark, sf_dir)
    table, cov = _component_stats(s)
    est = ld.Heritability(table, _kept_blocks(s), np.array([[1.0, 0.0], [0.6, 8.0], [0.0, 1.0]]), cov)
    pairs = est.correlation_table(spark).select("i", F.posexplode(F.arrays_zip("gc", "se")).alias("j", "_pair"))
    return pairs.select("i", "j", F.col("_pair.gc").alias("gc"), F.col("_pair.se").alias("se"))


@query("o172_cross_trait")
def cross_trait(spark, sf_dir):
    s = Study(spark, sf_dir)
    table, cov = _component_stats(s)
    return spark.createDataFrame(ld.Heritability(table, _kept_blocks(s), np.eye(2), cov, two=True).cross_trait())


@query("o173_cross_trait_overlap")
def cross_trait_overlap(spark, sf_dir):
    s = Study(spark, sf_dir)
    table, cov = _component_stats(s)
    blocks = _kept_blocks(s)
    est = ld.Heritability(table, blocks, np.eye(2), cov, two=True)
    return spark.createDataFrame(est.cross_trait_overlap(*est.intercepts(table, blocks)))


@query("o173_intercepts", """WITH r AS (SELECT CAST(l_suppkey % 20 AS INTEGER) AS block, greatest(l_extendedprice % 50, 1) AS score, l_quantity + 100 AS n1, l_quantity + 300.0 AS n2, sqrt((l_quantity + 100) * (l_quantity + 300.0)) AS n, j,
  (CASE WHEN j = 1 THEN l_discount * 20 - 1 ELSE l_tax * 25 - 1 END) * (l_discount * 10 + l_tax * 15 - 1) AS y, CASE WHEN j = 1 THEN 0.2 ELSE 0.4 END AS h1 FROM lineitem, (SELECT unnest([1, 2]) AS j)),
m AS (SELECT j, avg(n) AS mean_n, greatest(least(900 * avg(y) / avg(score * n), 1), -1) AS slope, 0.0 AS level FROM r GROUP BY j),
w AS (SELECT r.j, block, score * n / mean_n AS x, y, 1 / ((h1 * n1 / 900 * score + 1) * (0.3 * n2 / 900 * score + 1) + power(slope * n / 900 * score + level, 2)) / score AS w FROM r JOIN m ON r.j = m.j),
s AS (SELECT j, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * y) AS t0, sum(w * x * y) AS t1 FROM w GROUP BY j),
f AS (SELECT j, mean_n, greatest(least((s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) * 900 / mean_n, 1), -1) AS slope, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS level FROM s JOIN m USING (j)),
v AS (SELECT r.j, block, score * n / mean_n AS x, y, 1 / ((h1 * n1 / 900 * score + 1) * (0.3 * n2 / 900 * score + 1) + power(slope * n / 900 * score + level, 2)) / score AS w FROM r JOIN f ON r.j = f.j),
b AS (SELECT j, block, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * y) AS t0, sum(w * x * y) AS t1 FROM v GROUP BY j, block),
t AS (SELECT j, sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2, sum(t0) AS t0, sum(t1) AS t1 FROM b GROUP BY j),
l AS (SELECT b.block, j, t.s0 - b.s0 AS s0, t.s1 - b.s1 AS s1, t.s2 - b.s2 AS s2, t.t0 - b.t0 AS t0, t.t1 - b.t1 AS t1 FROM b JOIN t USING (j) UNION ALL SELECT -1, j, s0, s1, s2, t0, t1 FROM t)
SELECT block AS left_out, CAST(j AS INTEGER) AS component, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 6) AS intercept FROM l""")
def intercepts(spark, sf_dir):
    """Intercepts after one reweighting, of two traits that lines of orders have; -1: with all blocks."""
    x = Study(spark, sf_dir).table("lineitem")
    snp = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    table = x.select(snp.alias("snp"), (F.col("l_quantity") + 100).alias("n"), F.array(F.col("l_discount") * 20 - 1, F.col("l_tax") * 25 - 1).alias("z"), (F.col("l_quantity") + 300).alias("n2"), (F.col("l_discount") * 10 + F.col("l_tax") * 15 - 1).alias("z2"))
    panel = x.select((F.col("l_suppkey") % 20).cast("int").alias("block_idx"), snp.alias("snp"), (F.col("l_extendedprice") % 50).alias("ldscore"))
    total, left = ld.ldsc_intercepts(table, panel, np.array([0.2, 0.4]), 0.3, 900.0, iterations=1)
    return spark.createDataFrame([(b - 1, j + 1, round(float(v), 6)) for b, row in enumerate(np.vstack([total[None], left])) for j, v in enumerate(row)], "left_out int, component int, intercept double")


@query("o171_tfce")
def tfce(spark, sf_dir):
    s = Study(spark, sf_dir)
    results = s.images.select(F.col("iid").alias("set_name"), F.posexplode("voxels").alias("_v", "x")).select("set_name", (F.col("_v") + 1).cast("int").alias("index"), C.chi2_sf(F.pow(F.col("x") * 20, F.lit(2))).alias("p"))
    return nulls.tfce(results, s.coords, ["set_name"], 1e-3)


@query("o163_smooth_images", """WITH g AS (SELECT v, CAST(v // 16 AS DOUBLE) AS x, CAST(v // 4 % 4 AS DOUBLE) AS y, CAST(v % 4 AS DOUBLE) AS z FROM (SELECT unnest(generate_series(0, 63)) AS v)),
p AS (SELECT a.v, b.v AS near, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM g a, g b WHERE abs(b.x - a.x) < 1.6 AND abs(b.y - a.y) < 1.6 AND abs(b.z - a.z) < 1.6),
k AS (SELECT *, power(1 / (sqrt(2 * pi()) * CAST(0.4 AS DOUBLE)), 3) * exp(-(x * x + y * y + z * z) / (2 * CAST(0.16 AS DOUBLE))) AS k FROM p),
m AS (SELECT v, sum(k) + 1e-6 AS a, sum(k * x) AS bx, sum(k * y) AS by_, sum(k * z) AS bz, sum(k * x * x) + 1e-6 AS xx, sum(k * y * y) + 1e-6 AS yy, sum(k * z * z) + 1e-6 AS zz, sum(k * x * y) AS xy, sum(k * x * z) AS xz, sum(k * y * z) AS yz FROM k GROUP BY v),
d AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM m),
u AS (SELECT v, a, bx, by_, bz, ((yy * zz - yz * yz) * bx + (xz * yz - xy * zz) * by_ + (xy * yz - xz * yy) * bz) / det AS ux, ((xz * yz - xy * zz) * bx + (xx * zz - xz * xz) * by_ + (xy * xz - xx * yz) * bz) / det AS uy,
  ((xy * yz - xz * yy) * bx + (xy * xz - xx * yz) * by_ + (xx * yy - xy * xy) * bz) / det AS uz FROM d),
w AS (SELECT k.v, near, k * (1 - ux * x - uy * y - uz * z) / (a - bx * ux - by_ * uy - bz * uz) AS w FROM k JOIN u ON k.v = u.v)
SELECT vec_id AS iid, CAST(v AS INTEGER) AS voxel, round(sum(w * CAST(embedding[near + 1] AS DOUBLE)), 6) + 0.0 AS value FROM embeddings, w WHERE abs(w) > 1 / CAST(64 AS DOUBLE) GROUP BY vec_id, v""")
def smooth_images(spark, sf_dir):
    s = Study(spark, sf_dir)
    smoothed = images.smooth(s.images, images.smoothing_table(s.coords, [0.4]), VOXELS)
    return smoothed.select("iid", F.posexplode("voxels").alias("voxel", "value")).select("iid", F.col("voxel").cast("int").alias("voxel"), (F.round("value", 6) + 0.0).alias("value"))


@query("o164_bandwidths")
def bandwidth_scores(spark, sf_dir):
    s = Study(spark, sf_dir)
    best, scores = images.choose_bandwidth(s.images, s.coords)
    return spark.createDataFrame([(float(b), float(v), b == best) for b, v in scores], "bandwidth double, score double, chosen boolean")


def _written_calls(s: Study) -> DataFrame:
    """The calls, written once: they are counted, and read by several steps."""
    path = scratch(s.spark, "calls")
    s.geno.write.parquet(path)
    return s.spark.read.parquet(path)


def _loco(s: Study, geno: DataFrame) -> DataFrame:
    """iid, contig, pred: leave-one-chromosome-out predictions of both components."""
    path = scratch(s.spark, "arranged")
    relatedness.arrange(linear.residuals(s.plain_subjects)).write.parquet(path)
    arranged = s.spark.read.parquet(path)
    moments = arranged.select(*[F.stddev_pop(F.get("resid", j)).alias(f"s{j}") for j in range(2)]).first()
    scale = np.array([moments["s0"], moments["s1"]])
    called = s.variants.join(geno.select("variant"), "variant", "left_semi").select("variant", "contig", "pos", F.col("rsid").alias("snp"))
    path = scratch(s.spark, "blocks")
    intervals.equal_blocks(called, 150, "snp").select("variant", "contig", (F.col("contig").cast("int") * 1_000_000 + F.col("block")).cast("int").alias("block")).write.parquet(path)
    blocks = s.spark.read.parquet(path)
    return relatedness.called_loco(geno.join(blocks, "variant"), arranged, scale, blocks.count(), geno.count())


@query("o189_loco_predictions")
def loco_predictions(spark, sf_dir):
    s = Study(spark, sf_dir)
    return _loco(s, _written_calls(s))


@query("o189_loco_association")
def loco_association(spark, sf_dir):
    """Association of the variants of each chromosome, with what the others predict taken off (O-137S, O-161)."""
    s = Study(spark, sf_dir)
    path, calls = scratch(spark, "loco"), _written_calls(s)
    _loco(s, calls).write.parquet(path)
    geno = calls.join(s.variants.select("variant", "contig"), "variant")
    return linear.gwas_loco(geno, s.plain_subjects, spark.read.parquet(path), variants.chromosomes(s.variants))


@query("o190_wild_bootstrap")
def wild_bootstrap(spark, sf_dir):
    s = Study(spark, sf_dir)
    draws = nulls.wild_bootstrap(linear.residuals(s.plain_subjects).select("iid", "resid"), 5)
    return draws.groupBy("sample_id").agg(F.count("*").alias("n"), F.avg(F.get("resid", 0)).alias("mean"))


@query("o191_permuted_rows")
def permuted_rows(spark, sf_dir):
    s = Study(spark, sf_dir)
    return nulls.permuted_rows(linear.residuals(s.plain_subjects), 3)


RANDOM_SETS_SQL = """WITH g AS (SELECT (l_partkey * 10000 + l_suppkey) * 8 + l_linenumber AS variant, o_custkey, least(2, count(*)) AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), num AS (SELECT count(*) AS n FROM customer),
m AS (SELECT variant, CAST(least(sum(dosage), 2 * n - sum(dosage)) AS BIGINT) AS mac FROM g, num GROUP BY variant, n), p AS (SELECT unnest(generate_series(0, 3)) AS pass),
o AS (SELECT variant, mac, pass, row_number() OVER (PARTITION BY pass ORDER BY CAST('0x' || substr(md5('order:' || variant || ':' || pass || ':1'), 1, 15) AS BIGINT), variant) - 1 AS place, count(*) OVER (PARTITION BY pass) AS n FROM m, p),
b AS (SELECT unnest([2, 3, 4, 5, 6, 8, 10, 12, 15, 21, 31, 61]) AS lo, unnest([2, 3, 4, 5, 7, 9, 11, 14, 20, 30, 60, 100]) AS hi),
w AS (SELECT lo || '_' || hi AS bin, lo, hi, pass, greatest(2, lo // 10) + CAST('0x' || substr(md5('width:' || lo || '_' || hi || ':' || pass || ':1'), 1, 15) AS BIGINT) % (hi - greatest(2, lo // 10) + 1) AS width FROM b, p),
x AS (SELECT *, unnest([place // (width * 4 // 5 + 1), place // (width * 4 // 5 + 1) - 1]) AS win FROM o JOIN w USING (pass)),
z AS (SELECT bin, pass, win, CAST(sum(mac) AS BIGINT) AS cmac, list_sort(list(variant)) AS variants FROM x WHERE win >= 0 AND place < win * (width * 4 // 5 + 1) + width AND win * (width * 4 // 5 + 1) < n - width GROUP BY bin, lo, hi, pass, win HAVING sum(mac) BETWEEN lo AND hi),
k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY pass, win) - 1 AS k FROM z) SELECT bin, CAST(k AS INTEGER) AS set_idx, variants, cmac FROM k WHERE k < 1000"""


@query("o192_random_sets", RANDOM_SETS_SQL)
def random_sets(spark, sf_dir):
    """A thousand sets of each bin, of the variants that parts, suppliers and line numbers make."""
    s = Study(spark, sf_dir)
    return permutations.draw_sets(variants.variant_qc(s.rare_geno, s.n), 1000, most_passes=4)


def _drawn_null(s: Study, geno: DataFrame, sets: int = 200, count: int = 300, keep: float = 0.001) -> DataFrame:
    """Tail of the burden statistics of drawn sets under permutations, merged (O-192 to O-194)."""
    null = linear.residuals(s.subjects)
    drawn = permutations.draw_sets(variants.variant_qc(geno, s.n), sets, most_passes=4)
    products = linear.cross_products(s.subjects)
    frame = permutations.permutation_null(drawn, geno, null, products["xx"], np.eye(2), rare.voxel_variance(null, np.eye(2), 2), count, keep)
    return nulls.merge_permutations([frame], keep)


@query("o193_permutation_null")
def permutation_null(spark, sf_dir):
    s = Study(spark, sf_dir)
    return _drawn_null(s, _kept_calls(s, rare_ones=True))


@query("o193_burden_by_permutation")
def burden_by_permutation(spark, sf_dir):
    """Burden tests of the variants of each part, whose p-values come from the permutation null where their count is 100 or less."""
    s = Study(spark, sf_dir)
    geno, null, products = _kept_calls(s, rare_ones=True), linear.residuals(s.subjects), linear.cross_products(s.subjects)
    rows = rare.variant_rows(geno, null, products["xx"], s.n).where(variants.maf_filter(0, 0.01))
    members = rows.select(F.concat(F.lit("P"), F.floor(F.col("variant") / 80000).cast("string")).alias("set_name"), F.lit("all").alias("mask"), "variant", "maf", "mac", "score", "proj", F.lit(None).cast("array<double>").alias("annot"), "iids", "dosages")
    tested = rare.set_tests(members, None, np.eye(2), rare.voxel_variance(null, np.eye(2), 2), ("burden",), calls=rows)
    return rare.burden_table(permutations.burden_by_null(tested, _drawn_null(s, geno)))


@query("o181_skat_tails")
def skat_tails(spark, sf_dir):
    """Statistics, spectra and tails of the sets of genes."""
    members, calls, bases, variance, _ = _summary(Study(spark, sf_dir))
    return rare.skat_tails(members, calls, bases, variance)


@query("o181_saddlepoint")
def saddlepoint(spark, sf_dir):
    """Tail of a mixture of four chi-squares at a value of each supplier."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "q": pdf["q"], "p": stats.saddlepoint(pdf["q"], np.array([4.0, 3.0, 2.0, 1.0]))})

    return Study(spark, sf_dir).table("supplier").select(F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 100 + 0.01).alias("q")).mapInPandas(run, "id long, q double, p double")
