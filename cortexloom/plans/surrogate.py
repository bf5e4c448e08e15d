"""The star-schema tables read as a study: customers are subjects, parts variants, ordered parts genotypes.

A subject's dosage of a variant is how often they ordered the part, 2 at most.  Genes are the
overlapping intervals [20g, 20g + 35) of part keys, cut at contigs of 500 keys.  Embeddings are
images on a 4 x 4 x 4 grid.  SQL has the same as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ["exonic", "splicing", "UTR3", "upstream", "downstream", "ncRNA_exonic"]
EXONIC = ["stopgain", "nonsynonymous SNV", "synonymous SNV", "frameshift insertion", "none"]
VOXELS, COMPONENTS = 64, 8


class Study:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def n(self) -> int:
        return self.table("customer").count()  # from the footers

    @property
    def geno(self) -> DataFrame:
        return self._ordered(self.table("orders").select("o_orderkey", "o_custkey"))

    def geno_of(self, subjects: DataFrame) -> DataFrame:
        """Calls of these subjects: orders of others go before lines meet them, and the lines, many more, are not sorted."""
        orders = self.table("orders").select("o_orderkey", "o_custkey").join(subjects.select(F.col("iid").alias("o_custkey")), "o_custkey", "left_semi")
        return self._ordered(orders.hint("shuffle_hash"))

    def _ordered(self, orders: DataFrame) -> DataFrame:
        joined = self.table("lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.groupBy(F.col("l_partkey").alias("variant"), F.col("o_custkey").alias("iid")).agg(F.least(F.lit(2), F.count("*")).cast("int").alias("dosage"))

    @property
    def rare_geno(self) -> DataFrame:
        """Calls of rarer variants: one for each part, supplier and line number."""
        lines, orders = self.table("lineitem").select("l_orderkey", ((F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 8 + F.col("l_linenumber")).alias("variant")), self.table("orders").select("o_orderkey", "o_custkey")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.groupBy("variant", F.col("o_custkey").alias("iid")).agg(F.least(F.lit(2), F.count("*")).cast("int").alias("dosage"))

    @property
    def geno_missing(self) -> DataFrame:
        return self.geno.withColumn("dosage", F.when((F.col("variant") * 31 + F.col("iid")) % 17 == 0, None).otherwise(F.col("dosage")))

    @property
    def variants(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        base = lambda i: F.substring(F.lit("ACGT"), (i % 4 + 1).cast("int"), F.lit(1))
        pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))
        return self.table("part").select(
            k.alias("variant"), (F.floor(k / 500) % 22 + 1).cast("string").alias("contig"), k.cast("int").alias("pos"), F.concat(F.lit("rs"), k.cast("string")).alias("rsid"), base(size).alias("ref"),
            F.when(k % 7 == 0, F.concat(base(size), F.lit("T"))).otherwise(base(size + 1 + k % 3)).alias("alt"), pick(CATEGORIES, size).alias("category"), pick(EXONIC, k).alias("exonic"), F.when(k % 2 == 0, "D").otherwise("T").alias("metasvm"),
            F.concat(F.lit("G"), F.floor(k / 20).cast("string"), F.lit("(dist=1);x")).alias("info"), F.concat(F.lit("a;connected_gene=G"), F.floor(k / 20).cast("string"), F.lit(";s=1")).alias("genehancer"), size.cast("double").alias("phred"),
        )

    @property
    def genes(self) -> DataFrame:
        starts = self.table("part").select(F.floor(F.col("p_partkey") / 20).alias("g")).distinct()
        return starts.select(F.concat(F.lit("G"), F.col("g").cast("string")).alias("set_name"), (F.floor(F.col("g") * 20 / 500) % 22 + 1).cast("string").alias("contig"), (F.col("g") * 20).cast("int").alias("start"), (F.col("g") * 20 + 35).cast("int").alias("end"))

    @property
    def subjects(self) -> DataFrame:
        c = self.table("customer")
        return c.select(F.col("c_custkey").alias("iid"), F.array(F.lit(1.0), F.col("c_nationkey").cast("double")).alias("x"), F.array(F.col("c_acctbal"), F.col("c_acctbal") / 100 + F.col("c_nationkey")).alias("y"))

    @property
    def plain_subjects(self) -> DataFrame:
        return self.subjects.withColumn("x", F.array(F.lit(1.0)))

    @property
    def images(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("iid"), F.col("embedding").cast("array<double>").alias("voxels"))

    @property
    def bases(self) -> DataFrame:
        v, j = F.col("id"), F.sequence(F.lit(0), F.lit(COMPONENTS - 1))
        return self.spark.range(VOXELS).select(v.cast("int").alias("voxel"), F.transform(j, lambda k: F.sqrt(F.lit(2.0 / VOXELS)) * F.cos(F.lit(3.141592653589793) * (v + 0.5) * k / VOXELS)).alias("b"))

    @property
    def coords(self) -> DataFrame:
        v = F.col("id")
        return self.spark.range(VOXELS).select(v.cast("int").alias("voxel"), F.array(F.floor(v / 16), F.floor(v / 4) % 4, v % 4).alias("xyz"))

    @property
    def panel(self) -> DataFrame:
        """Association results: one row a line of an order, as an external table has them."""
        x = self.table("lineitem")
        return x.select((F.col("l_partkey") % 22 + 1).cast("string").alias("chr"), F.col("l_partkey").cast("int").alias("pos"), F.concat_ws("_", F.lit("rs"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("snp"), F.substring(F.lit("ACGT"), (F.col("l_suppkey") % 4 + 1).cast("int"), F.lit(1)).alias("a1"), F.substring(F.lit("ACGT"), ((F.col("l_suppkey") + 1 + F.col("l_partkey") % 2) % 4 + 1).cast("int"), F.lit(1)).alias("a2"), F.col("l_quantity").alias("n"), F.col("l_discount").alias("effect"), (F.col("l_tax") + 0.01).alias("se"), (F.col("l_discount") / (F.col("l_tax") + 0.01)).alias("z"), (F.col("l_extendedprice") % 50 / 100).alias("maf"))


CTE = """
WITH geno AS (SELECT l_partkey AS variant, o_custkey AS iid, CAST(least(2, count(*)) AS INTEGER) AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
num AS (SELECT count(*) AS n FROM customer),
variants AS (SELECT p_partkey AS variant, CAST((p_partkey // 500) % 22 + 1 AS VARCHAR) AS contig, CAST(p_partkey AS INTEGER) AS pos, 'rs' || p_partkey AS rsid,
  substr('ACGT', CAST(p_size % 4 + 1 AS INTEGER), 1) AS ref,
  CASE WHEN p_partkey % 7 = 0 THEN substr('ACGT', CAST(p_size % 4 + 1 AS INTEGER), 1) || 'T' ELSE substr('ACGT', CAST((p_size + 1 + p_partkey % 3) % 4 + 1 AS INTEGER), 1) END AS alt,
  list_extract(['exonic', 'splicing', 'UTR3', 'upstream', 'downstream', 'ncRNA_exonic'], CAST(p_size % 6 + 1 AS INTEGER)) AS category,
  list_extract(['stopgain', 'nonsynonymous SNV', 'synonymous SNV', 'frameshift insertion', 'none'], CAST(p_partkey % 5 + 1 AS INTEGER)) AS exonic,
  CASE WHEN p_partkey % 2 = 0 THEN 'D' ELSE 'T' END AS metasvm, 'G' || (p_partkey // 20) || '(dist=1);x' AS info, 'a;connected_gene=G' || (p_partkey // 20) || ';s=1' AS genehancer, CAST(p_size AS DOUBLE) AS phred FROM part),
genes AS (SELECT DISTINCT 'G' || (p_partkey // 20) AS set_name, CAST(((p_partkey // 20) * 20 // 500) % 22 + 1 AS VARCHAR) AS contig, CAST((p_partkey // 20) * 20 AS INTEGER) AS start, CAST((p_partkey // 20) * 20 + 35 AS INTEGER) AS "end" FROM part),
qc AS (SELECT variant, n AS n_called, count(*) FILTER (dosage = 1) AS n_het, count(*) FILTER (dosage = 2) AS n_hom_alt, CAST(sum(dosage) AS BIGINT) AS ac, sum(dosage) / (2.0 * n) AS af,
  least(sum(dosage) / (2.0 * n), 1 - sum(dosage) / (2.0 * n)) AS maf, CAST(least(sum(dosage), 2 * n - sum(dosage)) AS BIGINT) AS mac FROM geno, num GROUP BY variant, n),
panel AS (SELECT CAST(l_partkey % 22 + 1 AS VARCHAR) AS chr, CAST(l_partkey AS INTEGER) AS pos, 'rs_' || l_orderkey || '_' || l_linenumber AS snp, substr('ACGT', CAST(l_suppkey % 4 + 1 AS INTEGER), 1) AS a1,
  substr('ACGT', CAST((l_suppkey + 1 + l_partkey % 2) % 4 + 1 AS INTEGER), 1) AS a2, l_quantity AS n, l_discount AS effect, l_tax + 0.01 AS se, l_discount / (l_tax + 0.01) AS z, (l_extendedprice % 50) / 100 AS maf FROM lineitem)
"""
