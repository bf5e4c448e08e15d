"""Queries of sources and sinks: tables are written in a format and read back by its reader.

Files go to the shared folder.  SQL states what has to come back.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ids, nulls, variants
from ..session import scratch
from ..sources import genotypes, images, models, sumstats, text
from .registry import query
from .surrogate import CTE, Study


def _text(df: DataFrame, kind: str, header: bool = False, sep: str = " ", end: str = "", **options) -> str:
    """df as delimited text in the shared folder."""
    path = f"{scratch(df.sparkSession, kind)}{end}"
    df.write.option("sep", sep).option("header", header).options(**options).csv(path)
    return path


def _covariates(s: Study) -> DataFrame:
    """Customers as a table of subjects; each seventh occurs twice, each tenth lacks its value."""
    c = s.table("customer")
    rows = c.select(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("FID"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("IID"), F.when(F.col("c_custkey") % 10 == 3, "NA").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), "c_custkey")
    return rows.unionAll(rows.where("c_custkey % 7 = 2")).drop("c_custkey")


SUBJECT_ROWS = "SELECT 'f' || c_nationkey AS fid, 'c' || c_custkey AS iid, c_acctbal AS balance FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 7 <> 2"


@query("o001_subject_text", SUBJECT_ROWS)
def subject_text(spark, sf_dir):
    return text.read_subjects(spark, _text(_covariates(Study(spark, sf_dir)), "subjects", True))


@query("o002_compressed_text", SUBJECT_ROWS)
def compressed_text(spark, sf_dir):
    return text.read_subjects(spark, _text(_covariates(Study(spark, sf_dir)), "subjects", True, compression="bzip2"))


def _loci(s: Study, step: int) -> str:
    return _text(s.variants.where(F.col("variant") % step == 0).select(F.concat(F.lit("chr"), "contig", F.lit(":"), F.col("pos").cast("string"))), "loci")


@query("o007_extract_loci_lists", CTE + "SELECT contig, pos FROM variants WHERE variant % 6 = 0")
def extract_loci_lists(spark, sf_dir):
    s = Study(spark, sf_dir)
    return text.read_loci(spark, [_loci(s, 2), _loci(s, 3)])


@query("o008_exclude_loci_lists", CTE + "SELECT variant FROM variants WHERE variant % 2 <> 0 AND variant % 3 <> 0")
def exclude_loci_lists(spark, sf_dir):
    s = Study(spark, sf_dir)
    return ids.exclude(s.variants, [text.read_loci(spark, [_loci(s, 2), _loci(s, 3)], every=False)], ["contig", "pos"]).select("variant")


@query("o009_partition_text", CTE + 'SELECT CAST(contig AS INTEGER) AS contig, start, "end" FROM genes')
def partition_text(spark, sf_dir):
    return text.read_partition(spark, _text(Study(spark, sf_dir).genes.select("contig", "start", "end"), "partition"))


@query("o010_voxel_list", "SELECT CAST(vec_id AS INTEGER) AS voxel FROM embeddings WHERE label < 5")
def voxel_list(spark, sf_dir):
    return text.read_voxels(spark, _text(Study(spark, sf_dir).table("embeddings").where("label < 5").select(F.col("vec_id") + 1), "voxels"))


@query("o011_variant_set_text", CTE + 'SELECT set_name, contig, start, "end" FROM genes')
def variant_set_text(spark, sf_dir):
    g = Study(spark, sf_dir).genes
    return text.read_variant_sets(spark, _text(g.select("set_name", F.concat(F.lit("chr"), "contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))), "sets"))


@query("o012_brace_paths", CTE + "SELECT rsid AS snp FROM variants WHERE variant % 5 IN (1, 2, 3)")
def brace_paths(spark, sf_dir):
    v, folder = Study(spark, sf_dir).variants, scratch(spark, "lists")
    for k in (1, 2, 3):
        v.where(F.col("variant") % 5 == k).select("rsid").write.text(f"{folder}/list{k}.txt")
    return text.read_exclude(spark, text.expand(f"{folder}/list{{3:1}}.txt"))


#: Suppliers as samples and nations as variants: a small panel whose calls are known by rule.
PANEL = """, calls AS (SELECT CAST(n_nationkey AS BIGINT) AS variant, s_suppkey AS sample, CASE WHEN s_nationkey = n_nationkey THEN 2 WHEN (s_suppkey + n_nationkey) % 11 = 0 THEN NULL WHEN (s_suppkey * 7 + n_nationkey) % 3 = 0 THEN 1 ELSE 0 END AS dosage FROM nation, supplier)
"""


def _panel(s: Study) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nations, suppliers, calls): a row a nation and supplier, blocks of a small table with a larger one."""
    n, p = s.table("nation").select(F.col("n_nationkey").cast("long").alias("variant"), "n_name"), s.table("supplier").select(F.col("s_suppkey").alias("sample"), "s_nationkey")
    both = p.withColumn("variant", F.explode(F.array(*[F.lit(r[0]) for r in n.select("variant").collect()])))  # nations are few
    k, m = F.col("sample"), F.col("variant")
    dosage = F.when(F.col("s_nationkey") == m, 2).when((k + m) % 11 == 0, None).when((k * 7 + m) % 3 == 0, 1).otherwise(0)
    return n, p, both.select("variant", "sample", dosage.alias("dosage"))


def _plink(spark, s: Study) -> str:
    """The panel as bed, bim and fam files at one prefix."""
    n, p, calls = _panel(s)
    prefix = f"{scratch(spark, 'plink')}/panel"
    lines = lambda df, *cols: df.coalesce(1).orderBy(df.columns[0]).select(F.concat_ws("\t", *cols))
    name = F.col("variant").cast("string")
    lines(n, F.lit("1"), F.concat(F.lit("rs"), name), F.lit("0"), (F.col("variant") * 10 + 5).cast("string"), F.lit("A"), F.lit("G")).write.text(f"{prefix}.bim")
    lines(p.withColumn("_s", F.col("sample").cast("string")), F.lit("f"), F.concat(F.lit("s"), "_s"), F.lit("0"), F.lit("0"), F.lit("1"), F.lit("-9")).write.text(f"{prefix}.fam")
    rows = calls.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("sample", "dosage"))).alias("c"))
    genotypes.save_bed(rows.select(F.col("variant").alias("snp_idx"), F.transform("c", lambda x: x["dosage"]).alias("dosages")), f"{prefix}.bed", p.count())
    return prefix


@query("o013_plink_tables", "SELECT 'bim' AS kind, n_nationkey + 0 AS idx, 'rs' || n_nationkey AS name, CAST(n_nationkey * 10 + 5 AS INTEGER) AS pos FROM nation UNION ALL SELECT 'fam', row_number() OVER (ORDER BY s_suppkey) - 1, 's' || s_suppkey, NULL FROM supplier")
def plink_tables(spark, sf_dir):
    prefix = _plink(spark, Study(spark, sf_dir))
    bim = genotypes.read_bim(spark, prefix).select(F.lit("bim").alias("kind"), F.col("snp_idx").alias("idx"), F.col("snp").alias("name"), "pos")
    return bim.unionAll(genotypes.read_fam(spark, prefix).select(F.lit("fam"), "iid_idx", "iid", F.lit(None).cast("int")))


@query("o014_plink_calls", CTE + PANEL + "SELECT variant, 's' || sample AS iid, CAST(dosage AS INTEGER) AS dosage FROM calls WHERE dosage IS NULL OR dosage > 0")
def plink_calls(spark, sf_dir):
    _, fam, bed = genotypes.read_plink(spark, _plink(spark, Study(spark, sf_dir)))
    return genotypes.to_sparse(bed, fam).select("variant", "iid", F.col("dosage").cast("int").alias("dosage"))


@query("o015_plink_maf", CTE + PANEL + "SELECT 'chr1' AS contig, 'rs' || variant AS snp, round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 6) AS maf FROM calls GROUP BY variant")
def plink_maf(spark, sf_dir):
    bim, _, _ = genotypes.read_plink(spark, _plink(spark, Study(spark, sf_dir)), "GRCh38")
    return bim.select("contig", "snp", F.round("maf", 6).alias("maf"))


@query("o105_plink_frequency", CTE + PANEL + """, f AS (SELECT variant, avg(dosage) / 2 AS f, count(*) FILTER (dosage = 1 OR dosage IS NULL) AS odd, count(*) AS n FROM calls GROUP BY variant)
SELECT variant, round(f, 6) AS af FROM f WHERE least(f, 1 - f) > 0.2 AND odd < n""")
def plink_frequency(spark, sf_dir):
    """Of the packed calls, which are counted without being unpacked."""
    s = Study(spark, sf_dir)
    n, m = s.table("supplier").count(), s.table("nation").count()
    counts = genotypes.open_bed(spark, f"{_plink(spark, s)}.bed", n, m, counts=True)
    return variants.common_enough(genotypes.packed_qc(counts, n), n, 0.2).select("variant", F.round("af", 6).alias("af"))


@query("o105_packed_counts", CTE + PANEL + "SELECT variant AS snp_idx, count(*) FILTER (dosage = 2) AS n_two, count(*) FILTER (dosage IS NULL) AS n_missing, count(*) FILTER (dosage = 1) AS n_one, count(*) FILTER (dosage = 0) AS n_none FROM calls WHERE sample % 3 = 1 AND variant >= 5 AND variant < 20 GROUP BY variant")
def packed_counts(spark, sf_dir):
    """A range of variants and a third of the samples; the other rows of the file are not read."""
    s = Study(spark, sf_dir)
    samples = np.array([r[0] for r in s.table("supplier").select("s_suppkey").orderBy("s_suppkey").collect()])  # the order of the fam file
    return genotypes.open_bed(spark, f"{_plink(spark, s)}.bed", len(samples), s.table("nation").count(), counts=True, keep=samples % 3 == 1).where("snp_idx >= 5 and snp_idx < 20")


@query("o017_vcf", CTE + PANEL + "SELECT 'chr1' AS contig, CAST(variant * 10 + 5 AS INTEGER) AS pos, 's' || sample AS iid, CAST(dosage AS INTEGER) AS dosage FROM calls WHERE variant % 9 <> 4 AND (dosage IS NULL OR dosage > 0)")
def vcf(spark, sf_dir):
    n, p, calls = _panel(Study(spark, sf_dir))
    gt = F.when(F.col("dosage").isNull(), "./.").otherwise(F.element_at(F.array(F.lit("0/0"), F.lit("0|1"), F.lit("1/1")), F.col("dosage") + 1))
    body = calls.groupBy("variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", gt.alias("g")))), lambda x: F.concat(x["g"], F.lit(":9"))).alias("g"))
    alt = F.when(F.col("variant") % 9 == 4, "G,T").otherwise("G")  # records of several alleles are left out
    rows = body.select(F.col("variant"), F.concat_ws("\t", F.lit("1"), (F.col("variant") * 10 + 5).cast("string"), F.concat(F.lit("rs"), F.col("variant").cast("string")), F.lit("A"), alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DP"), F.array_join("g", "\t")).alias("value"))
    names = [f"s{r[0]}" for r in p.select("sample").orderBy("sample").collect()]  # the header line of the file
    head = spark.createDataFrame([(-2, "##fileformat=VCFv4.2"), (-1, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names]))], "variant long, value string")
    path = f"{scratch(spark, 'vcf')}.vcf"
    head.unionAll(rows).coalesce(1).orderBy("variant").select("value").write.text(path)
    return genotypes.read_vcf(spark, path, "GRCh38")[1].select("contig", "pos", "iid", F.col("dosage").cast("int").alias("dosage"))


def _sparse(spark, s: Study) -> str:
    path = scratch(spark, "sparse")
    genotypes.save_sparse(s.geno, s.variants.select("variant", "contig", "pos"), s.table("customer").select(F.col("c_custkey").alias("iid")), path)
    return path


@query("o019_sparse_genotypes", CTE + "SELECT variant, contig, pos, ac AS mac, round(ac / (2.0 * n), 6) AS maf FROM qc JOIN variants USING (variant), num")
def sparse_genotypes(spark, sf_dir):
    _, v, _ = genotypes.load_sparse(spark, _sparse(spark, Study(spark, sf_dir)))
    return v.select("variant", "contig", "pos", "mac", F.round("maf", 6).alias("maf"))


@query("o018_genotype_rows", CTE + "SELECT variant, iid, dosage FROM geno")
def genotype_rows(spark, sf_dir):
    return genotypes.load_sparse(spark, _sparse(spark, Study(spark, sf_dir)))[0]


@query("o020_annotation_text", CTE + "SELECT rsid, category, info, round(phred, 6) AS phred FROM variants")
def annotation_text(spark, sf_dir):
    v = Study(spark, sf_dir).variants.select("rsid", "category", "info", "phred")
    return text.read_annotations(spark, _text(v, "annotations", True, ",", quoteAll=True)).select("rsid", "category", "info", F.round(F.col("phred").cast("double"), 6).alias("phred"))


@query("o021_association_text", CTE + "SELECT chr, pos, snp, a1, a2, n, effect, round(se, 9) AS se FROM panel")
def association_text(spark, sf_dir):
    p = Study(spark, sf_dir).panel.select(F.col("chr").alias("CHROM"), F.col("pos").alias("BP"), F.col("snp").alias("ID"), F.lower("a1").alias("EA"), F.lower("a2").alias("OA"), F.col("n").alias("N"), F.col("effect").alias("BETA"), F.col("se").alias("SE"))
    names = {"chr": "CHROM", "pos": "BP", "snp": "ID", "a1": "EA", "a2": "OA", "n": "N", "effect": "BETA", "se": "SE"}
    return text.read_gwas_text(spark, _text(p, "gwas", True, "\t"), names).withColumn("se", F.round("se", 9))


@query("o022_association_table", CTE + "SELECT variant, contig, pos FROM variants")
def association_table(spark, sf_dir):
    path = scratch(spark, "gwas")
    effects = {e: F.array(F.col("phred"), F.col("phred") * 2).alias(e) for e in sumstats.EFFECTS}
    sumstats.write_gwas(Study(spark, sf_dir).variants.select("variant", "contig", "pos", *effects.values()), path)
    return sumstats.read_gwas(spark, path, effects=False)


@query("o023_summary_statistics", CTE + "SELECT snp, chr, pos, n, round(z, 6) AS z FROM panel WHERE maf >= 0.1")
def summary_statistics(spark, sf_dir):
    path = scratch(spark, "sumstats")
    sumstats.save(Study(spark, sf_dir).panel.where("maf >= 0.1"), path)
    return sumstats.load(spark, path).select("snp", "chr", "pos", "n", F.round("z", 6).alias("z"))


@query("o024_component_block", "SELECT vec_id AS iid, round(CAST(embedding[4] AS DOUBLE), 6) AS first, round(CAST(embedding[9] AS DOUBLE), 6) AS last, 6 AS n FROM embeddings")
def component_block(spark, sf_dir):
    part = Study(spark, sf_dir).images.select("iid", sumstats.components("voxels", 3, 6).alias("v"))
    return part.select("iid", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 5), 6).alias("last"), F.size("v").alias("n"))


@query("o025_ld_tables", CTE + "SELECT rsid AS snp, CAST(CASE WHEN variant % 2 = 0 THEN pos // 50 ELSE pos // 100 + 1 + (SELECT max(pos // 50) FROM variants WHERE variant % 2 = 0) END AS INTEGER) AS block_idx FROM variants")
def ld_tables(spark, sf_dir):
    v, paths = Study(spark, sf_dir).variants, []
    for k, width in ((0, 50), (1, 100)):
        paths.append(scratch(spark, "ld"))
        part = v.where(F.col("variant") % 2 == k)
        models.save_ld(part.select(F.floor(F.col("pos") / width).cast("int").alias("block_idx"), F.col("rsid").alias("snp"), "contig", "pos", F.col("variant").alias("row_id")), paths[-1])
    return models.load_ld(spark, paths).select("snp", "block_idx")


def _image_files(spark, s: Study) -> str:
    """One file a nation with eight values; those of nations below 5 are in a second folder too, with other values."""
    folder = scratch(spark, "images").removeprefix("file://")
    sent = s.table("nation").select(F.col("n_nationkey").cast("long").alias("k"))

    def run(batches):
        import os

        for pdf in batches:
            for name, extra, most in (("a", 0.0, 1 << 30), ("b", 100.0, 5)):
                os.makedirs(f"{folder}/{name}", exist_ok=True)
                for k in (k for k in pdf["k"] if k < most):
                    with open(f"{folder}/{name}/n{k}_map.nii", "wb") as f:
                        f.write(images.nifti_bytes((np.arange(8.0) * (k + 1) + extra).reshape(2, 2, 2)))
            yield pdf

    sent.mapInPandas(run, "k long").count()
    return folder


@query("o026_image_files", "SELECT 'n' || n_nationkey AS iid, CAST(i AS INTEGER) AS voxel, CAST((4 * (i % 2) + 2 * (i // 2 % 2) + i // 4) * (n_nationkey + 1) AS DOUBLE) AS value FROM nation, (SELECT unnest(generate_series(0, 7)) AS i)")
def image_files(spark, sf_dir):
    folder = _image_files(spark, Study(spark, sf_dir))
    read = images.read_images(images.list_images(spark, [f"{folder}/a", f"{folder}/b"], "_map.nii"))
    return read.select("iid", F.posexplode("voxels").alias("voxel", "value"))


@query("o027_image_listing", "SELECT 'n' || n_nationkey AS iid, CASE WHEN n_nationkey < 5 THEN 'b' ELSE 'a' END AS folder FROM nation")
def image_listing(spark, sf_dir):
    folder = _image_files(spark, Study(spark, sf_dir))
    return images.list_images(spark, [f"{folder}/b", f"{folder}/a"], "_map.nii").select("iid", F.regexp_extract("path", "/([ab])/[^/]*$", 1).alias("folder"))


@query("o029_image_table", "SELECT vec_id AS iid, round(CAST(embedding[1] AS DOUBLE), 5) AS first, 64 AS n FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 2 = 0")
def image_table(spark, sf_dir):
    s, path = Study(spark, sf_dir), scratch(spark, "images")
    images.save_images(s.images, path)
    own = s.images.select("iid")
    batches = images.image_batches(images.load_images(spark, path, own.where("iid % 2 = 0"), own.where("iid % 3 = 0")), 1 << 20)
    return batches.select("iid", F.round(F.get("voxels", 0).cast("double"), 5).alias("first"), F.size("voxels").alias("n"))


@query("o030_loco_tables", "SELECT CAST(s_suppkey % 3 + 1 AS VARCHAR) AS contig, s_suppkey AS iid, round(s_acctbal, 2) AS p1, round(s_acctbal * 2, 2) AS p2 FROM supplier WHERE s_suppkey % 3 = 1")
def loco_tables(spark, sf_dir):
    rows = Study(spark, sf_dir).table("supplier").select("s_suppkey", "s_acctbal").orderBy("s_suppkey")
    subjects = [r[0] for r in rows.collect()]  # the order that predictions have, of null-model size
    whole = rows.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_acctbal"))), lambda x: x["s_acctbal"]).alias("pred"))
    preds = whole.select(F.explode(F.array(*[F.struct(F.lit(j).alias("ldr"), F.lit(str(c)).alias("contig"), F.transform("pred", lambda x: x * (j + 1)).alias("pred")) for j in (0, 1) for c in (1, 2, 3)])).alias("x")).select("x.*")  # noqa: B023
    path = scratch(spark, "loco")
    models.save_loco(preds, subjects, path)
    got = models.load_loco(spark, path, "2").where("iid % 3 = 1")
    return got.select("contig", "iid", F.round(F.get("pred", 0), 2).alias("p1"), F.round(F.get("pred", 1), 2).alias("p2"))


@query("o031_null_model", "SELECT c_custkey AS iid, round(c_acctbal, 2) AS r1, 1 AS n FROM customer WHERE c_custkey % 4 = 1")
def null_model(spark, sf_dir):
    s, path = Study(spark, sf_dir), scratch(spark, "null")
    models.save_null(s.subjects.withColumnRenamed("y", "resid"), s.bases, path)
    null, _ = models.load_null(spark, path, 1, keep=s.subjects.select("iid").where("iid % 4 = 1"))
    return null.select("iid", F.round(F.get("resid", 0), 2).alias("r1"), F.size("resid").alias("n"))


@query("o034_promoter_table", CTE + 'SELECT \'chr\' || contig AS contig, start, CAST(start + 10 AS INTEGER) AS "end" FROM genes')
def promoter_table(spark, sf_dir):
    g, path = Study(spark, sf_dir).genes, f"{scratch(spark, 'promoters')}.parquet"
    g.select("contig", "start", (F.col("start") + 10).alias("end")).write.parquet(path)
    return text.read_promoters(spark, path, "GRCh38")


@query("o036_imported_table", "SELECT CAST(n_nationkey AS VARCHAR) AS iid, n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey / 2.0 END AS value FROM nation")
def imported_table(spark, sf_dir):
    rows = Study(spark, sf_dir).table("nation").select(F.col("n_nationkey").alias("iid"), F.col("n_name").alias("name")).toPandas()  # nations are few
    return sumstats.import_frame(spark, rows.assign(value=[np.nan if k % 4 == 0 else k / 2 for k in rows["iid"]]), ["iid"])


def _results(s: Study) -> DataFrame:
    x = s.table("lineitem")
    return x.select(F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("set_name"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("int").alias("index"), F.col("l_tax").alias("p"))


@query("o037_results_by_index", "SELECT 'G' || l_suppkey AS set_name, l_orderkey AS order_id, CAST(l_linenumber AS INTEGER) AS \"index\", l_tax AS p FROM lineitem WHERE l_suppkey % 3 = 0")
def results_by_index(spark, sf_dir):
    index = sumstats.write_sets(_results(Study(spark, sf_dir)), scratch(spark, "results"))
    return sumstats.read_results(spark, index.where(F.substring("VARIANT_SET", 2, 9).cast("int") % 3 == 0))


@query("o048_results_index", "SELECT 'G' || s_suppkey AS set_name, CAST(s_nationkey AS VARCHAR) AS contig, CAST(s_suppkey AS INTEGER) AS start FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def results_index(spark, sf_dir):
    s = Study(spark, sf_dir)
    sets = s.table("supplier").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("set_name"), F.col("s_nationkey").cast("string").alias("contig"), F.col("s_suppkey").cast("int").alias("start"), (F.col("s_suppkey") + 1).cast("int").alias("end"))
    index = sumstats.write_sets(_results(s), scratch(spark, "results"), sets)
    return index.select(F.col("VARIANT_SET").alias("set_name"), F.col("CHR").alias("contig"), F.col("START").alias("start"))


NULL_ROWS = "SELECT CAST(o_custkey % 20 AS VARCHAR) AS sample_id, 'g' || o_orderkey AS gene_id, CAST(o_orderkey % 64 AS INTEGER) AS \"index\", 1 / (1 + o_totalprice) AS p FROM orders"


def _null_rows(s: Study) -> DataFrame:
    o = s.table("orders")
    return o.select((F.col("o_custkey") % 20).alias("sample_id"), F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("gene_id"), (F.col("o_orderkey") % 64).cast("int").alias("index"), (1 / (1 + F.col("o_totalprice"))).alias("p"))


@query("o038_null_associations", NULL_ROWS)
def null_associations(spark, sf_dir):
    path, rows = scratch(spark, "null"), _null_rows(Study(spark, sf_dir))
    for part in (rows.where("sample_id < 10"), rows.where("sample_id >= 10")):
        sumstats.append_null_text(part, path)
    return sumstats.read_null_associations(spark, path)


@query("o049_appended_null", f"SELECT sample_id, count(*) AS n, count(DISTINCT gene_id) AS genes FROM ({NULL_ROWS}) GROUP BY sample_id")
def appended_null(spark, sf_dir):
    path, rows = scratch(spark, "null"), _null_rows(Study(spark, sf_dir))
    for k in (0, 1):
        sumstats.append_null(rows.where(F.col("sample_id") % 2 == k), path)
    return spark.read.parquet(path).groupBy(F.col("sample_id").cast("string").alias("sample_id")).agg(F.count("*").alias("n"), F.count_distinct("gene_id").alias("genes"))


@query("o044_voxel_text", CTE + "SELECT snp, CAST(pos AS VARCHAR) AS pos, format('{:.5e}', effect) AS effect FROM panel WHERE maf < 0.02")
def voxel_text(spark, sf_dir):
    path = scratch(spark, "voxels")
    sumstats.write_tsv(Study(spark, sf_dir).panel.where("maf < 0.02").select("snp", "pos", "effect"), path, ["effect"], ["pos", "snp"])
    return spark.read.option("sep", "\t").option("header", True).csv(path)


@query("o045_matrix_table", "SELECT CAST(a.n_nationkey AS INTEGER) AS i, CAST(b.r_regionkey AS INTEGER) AS j, CAST(a.n_nationkey * 10 + b.r_regionkey AS DOUBLE) AS value FROM nation a, region b")
def matrix_table(spark, sf_dir):
    s, path = Study(spark, sf_dir), scratch(spark, "matrix")
    n, r = s.table("nation").count(), s.table("region").count()
    sumstats.save_matrix(spark, np.arange(n)[:, None] * 10.0 + np.arange(r), path)
    return spark.read.parquet(path)


PERMUTATION_SQL = """SELECT bin, voxel, stats, n AS count FROM (SELECT l_returnflag AS bin, CAST(l_suppkey % 9 + 1 AS INTEGER) AS voxel, list(l_quantity) AS s FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2) JOIN (SELECT l_returnflag AS bin, CAST(2 * count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1) USING (bin),
LATERAL (SELECT list_sort(list_concat(s, s)) AS a), LATERAL (SELECT list_slice(a, greatest(1, len(a) - greatest(1, CAST(floor(n * 0.005) AS INTEGER)) + 1), len(a)) AS stats)"""


def _permutations(s: Study) -> DataFrame:
    x = s.table("lineitem")
    kept = x.where("l_quantity > 45").select(F.col("l_returnflag").alias("bin"), (F.col("l_suppkey") % 9 + 1).cast("int").alias("voxel"), F.col("l_quantity").alias("stat"))
    return kept.unionAll(x.groupBy(F.col("l_returnflag").alias("bin")).agg(F.count("*").cast("double").alias("stat")).select("bin", F.lit(0), "stat"))


@query("o194_merged_permutations", PERMUTATION_SQL)
def merged_permutations(spark, sf_dir):
    one = _permutations(Study(spark, sf_dir))
    return nulls.merge_permutations([one, one], 0.005).select("bin", "voxel", "stats", "count")


@query("o033_permutation_tables", f"SELECT bin, voxel, len(stats) AS n, stats[1] AS least, count FROM ({PERMUTATION_SQL})")
def permutation_tables(spark, sf_dir):
    one, path = _permutations(Study(spark, sf_dir)), scratch(spark, "permutations")
    models.save_permutations(nulls.merge_permutations([one, one], 0.005), path)
    got = models.load_permutations(spark, path, 9)
    return spark.createDataFrame([(b, v + 1, len(s), float(s[0]), n) for b, (kept, n) in got.items() for v, s in enumerate(kept) if len(s)], "bin string, voxel int, n long, least double, count long")


@query("o050_permutation_sink", f"SELECT bin, count(*) AS voxels, max(count) AS count FROM ({PERMUTATION_SQL}) GROUP BY bin")
def permutation_sink(spark, sf_dir):
    one, path = _permutations(Study(spark, sf_dir)), scratch(spark, "permutations")
    models.save_permutations(nulls.merge_permutations([one, one], 0.005), path)
    return spark.read.parquet(path).groupBy("bin").agg(F.count("*").alias("voxels"), F.max("count").alias("count"))


@query("o138s_stacked_results", "SELECT c_custkey AS id, c_acctbal AS balance, NULL AS name, NULL AS size FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name, NULL FROM supplier UNION ALL SELECT p_partkey, NULL, p_name, CAST(p_size AS BIGINT) FROM part")
def stacked_results(spark, sf_dir):
    s = Study(spark, sf_dir)
    parts = [s.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), s.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")), s.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))]
    return sumstats.stack(parts)


@query("o135s_union_ids", "SELECT DISTINCT fid, iid FROM (SELECT CAST(c_nationkey AS VARCHAR) AS fid, CAST(c_custkey AS VARCHAR) AS iid FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 5 = 0)")
def union_ids(spark, sf_dir):
    c = Study(spark, sf_dir).table("customer").select(F.col("c_nationkey").cast("string").alias("fid"), F.col("c_custkey").cast("string").alias("iid"), "c_custkey")
    return ids.union_ids([c.where(F.col("c_custkey") % k == 0) for k in (3, 5)])


@query("o131s_sorted_rows", CTE + "SELECT CAST(row_number() OVER (ORDER BY pos, snp) - 1 AS BIGINT) AS place, snp FROM panel WHERE maf < 0.02")
def sorted_rows(spark, sf_dir):
    """The rows of a sorted result file by their place in it."""
    path = scratch(spark, "sorted")
    sumstats.write_tsv(Study(spark, sf_dir).panel.where("maf < 0.02").select("pos", "snp"), path, [], ["pos", "snp"])
    rows = spark.read.option("sep", "\t").option("header", True).csv(path).select("snp", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_r"))
    counts = {r["_f"]: r["n"] for r in rows.groupBy("_f").agg(F.count("*").alias("n")).collect()}  # a row a file
    before = functools.reduce(lambda c, f: c.when(F.col("_f") == f, sum(n for g, n in counts.items() if g < f)), sorted(counts), F.when(F.lit(False), 0))
    from pyspark.sql import Window

    return rows.select((before + F.row_number().over(Window.partitionBy("_f").orderBy("_b", "_r")) - 1).cast("long").alias("place"), "snp")
