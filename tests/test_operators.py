"""Relational operators on tables small enough to check by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexloom.config import SetTest, VariantFilter, accepted, zero_based
from cortexloom.functions import columns as C
from cortexloom.operators import ids, intervals, ld, linear, nulls, rare, variants


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_id_sets(spark):
    a, b = (spark.createDataFrame([(f"f{i}", f"s{i}") for i in k], "fid string, iid string") for k in ((1, 2, 3, 3), (2, 3, 4)))
    assert rows(ids.intersect_ids([a, b]), "iid") == [("s2",), ("s3",)]
    assert rows(ids.union_ids([a, b]), "iid") == [("s1",), ("s2",), ("s3",), ("s4",)]
    assert rows(ids.except_ids(a, b), "iid") == [("s1",)]
    assert rows(ids.unique_keys(a, ids.SUBJECT), "iid") == [("s1",), ("s2",)]
    with pytest.raises(KeyError):
        ids.keep_subjects(a, b)
    assert len(rows(ids.keep_subjects(a, b, merge=True))) == 3


def test_common_variants_counts_each_table_once(spark):
    """No merge is counted and joined back; keys repeated in a table or list, null keys and null alleles."""
    one = spark.createDataFrame([("a", "A", "C"), ("b", "A", "C"), ("b", "A", "C"), ("c", "A", None), (None, "A", "C"), ("d", "A", "C")], "snp string, a1 string, a2 string")
    two = spark.createDataFrame([("a", "C", "A"), ("b", "A", "C"), ("c", "A", None), (None, "A", "C"), ("d", "A", "C")], "snp string, a1 string, a2 string")
    listed = spark.createDataFrame([("a",), ("c",), ("d",), ("d",)], "snp string")
    got = ids.common_variants([one, two], [listed])
    assert {tuple(r) for r in got.collect()} == {("a", "A", "C", "C", "A"), ("c", "A", None, "A", None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_common_variants(spark):
    make = lambda *r: spark.createDataFrame(r, "snp string, a1 string, a2 string")
    gwas, one = make(("rs1", "G", "A"), ("rs3", "C", "A")), make(("rs1", "A", "G"), ("rs2", "C", "T"), ("rs3", "C", "A"))
    two, three = make(("rs1", "A", "G"), ("rs3", "G", "A")), make(("rs1", "A", "G"), ("rs3", "C", "A"), ("rs3", "C", "A"))
    assert rows(ids.common_variants([gwas, one]), "snp") == [("rs1",), ("rs3",)]
    assert rows(ids.common_variants([gwas, one], [spark.createDataFrame([("rs2",), ("rs3",)], "snp string")]), "snp") == [("rs3",)]
    assert rows(ids.common_variants([gwas, two]), "snp") == [("rs1",)]
    assert rows(ids.common_variants([gwas, three]), "snp") == [("rs1",)]


@pytest.mark.parametrize("rule", intervals.RULES)
@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_interval_join_is_the_naive_join(spark, rule, bucket):
    rng = np.random.default_rng(3)
    points = [("1" if p % 3 else "2", int(p), i) for i, p in enumerate(rng.integers(0, 60, 80))]
    spans = [("1" if i % 2 else "2", int(a), int(a + w), f"g{i}") for i, (a, w) in enumerate(zip(rng.integers(0, 55, 20), rng.integers(0, 25, 20)))]
    test = {"half_open": lambda p, a, b: a <= p < b, "inside": lambda p, a, b: a < p < b, "closed": lambda p, a, b: a <= p <= b, "block": lambda p, a, b: a < p <= b}[rule]
    want = sorted((i, n) for c, p, i in points for d, a, b, n in spans if c == d and test(p, a, b))
    p, s = spark.createDataFrame(points, "contig string, pos int, id int"), spark.createDataFrame(spans, "contig string, start int, end int, name string")
    assert rows(intervals.interval_join(p, s, rule, bucket=bucket), "id", "name") == want
    assert rows(intervals.interval_join(p, s, rule, "left_semi", bucket), "id") == sorted({(i,) for i, _ in want})
    assert len(rows(intervals.interval_join(p, s, rule, "left_anti", bucket), "id")) == len(points) - len({i for i, _ in want})


def test_no_nested_loop(spark):
    p = spark.range(10).select(F.lit("1").alias("contig"), F.col("id").cast("int").alias("pos"))
    s = spark.createDataFrame([("1", 2, 5)], "contig string, start int, end int")
    plan = intervals.interval_join(p, s)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_floor(spark):
    assert [intervals.floor_index([1, 3, 5, 7], t) for t in (6, 5, 8, -1)] == [2, 2, 3, -1]
    points = spark.createDataFrame([("1", p) for p in range(0, 40)], "contig string, pos int")
    marks = spark.createDataFrame([("1", m, m) for m in (3, 9, 31)], "contig string, pos int, mark int")
    got = {r["pos"]: r["mark"] for r in intervals.floor_join(points, marks, "mark", bucket=4).collect()}
    assert got == {p: max((m for m in (3, 9, 31) if m <= p), default=None) for p in range(40)}


def test_band_join(spark):
    pos = [1, 1, 4, 9, 10, 30]
    p = spark.createDataFrame([("1", x, i) for i, x in enumerate(pos)], "contig string, pos int, id int")
    want = sorted((i, j) for i in range(6) for j in range(i, 6) if pos[j] <= pos[i] + 5)
    assert rows(intervals.band_join(p, 5, ["id"]), "id_i", "id_j") == want
    assert rows(intervals.band_sizes(p, 5, "id"), "id", "band") == [(i, sum(a == i for a, _ in want)) for i in range(6)]


def test_blocks(spark):
    v = spark.createDataFrame([("1", p, f"rs{p}") for p in (100, 150, 250, 350, 450)], "contig string, pos int, snp string")
    parts = spark.createDataFrame([("1", a, a + 100) for a in (100, 200, 300, 400, 500)], "contig string, start int, end int")
    assert rows(intervals.assign_blocks(v, parts), "pos", "block_idx") == [(100, 0), (150, 0), (250, 1), (350, 2), (450, 3)]
    assert intervals.merge_by_size([3, 3, 3, 3], 2) == [0, 0, 1, 1]
    assert intervals.merge_every([("1", 0), ("1", 1), ("1", 2), ("2", 3)], 2) == [("1", 1), ("1", 2), ("2", 3)]


def test_parse_interval():
    assert intervals.parse_interval("3:5-9", "GRCh38") == ("chr3", 5, 9)
    with pytest.raises(ValueError):
        intervals.parse_interval("3:9-5")


def test_flip(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([[1, 2, 2, 2], [0, 0, 2, 1], [0, 0, 0, 1]])], "variant int, dosages array<tinyint>")
    got = [r["dosages"] for r in variants.flip_vectors(df).orderBy("variant").collect()]
    assert got == [[1, 0, 0, 0], [0, 0, 2, 1], [0, 0, 0, 1]]


def test_banded_ld(spark):
    z = np.array([[0, 2, 1, 2], [3, 1, 3, 0], [0, 4, 0, 0], [1, 0, 1, 1]])
    geno = spark.createDataFrame([(i, j, int(z[i, j])) for i in range(4) for j in range(4) if z[i, j]], "variant int, iid int, dosage int")
    where = spark.createDataFrame([(i, "1", i) for i in range(4)], "variant int, contig string, pos int")
    got = {(r["i"], r["j"]): r["value"] for r in rare.banded_ld(geno, where, 1).collect()}
    assert got == {(0, 0): 9, (0, 1): 5, (1, 1): 19, (1, 2): 4, (2, 2): 16, (3, 3): 3}


def test_masks(spark):
    v = spark.createDataFrame([("stopgain", "exonic", "T"), ("nonsynonymous SNV", "exonic", "D"), (None, "ncRNA_splicing", None), ("frameshift insertion", "exonic", None)], "exonic string, category string, metasvm string")
    cols = (F.col("exonic"), F.col("category"), F.col("metasvm"))
    got = v.select(*[c.alias(k) for k, c in C.coding_masks(*cols).items()]).collect()
    assert [r["plof"] for r in got] == [True, False, True, False]
    assert [r["disruptive_missense"] for r in got] == [False, True, False, False]
    assert [r["ptv_ds"] for r in got] == [True, True, False, False]
    assert v.where(C.coding_prefilter(*cols[:2])).count() == 3 and v.where(C.coding_prefilter(*cols[:2], "indel")).count() == 4


def test_options():
    assert VariantFilter(maf_max=0.01).maf_min == 0 and VariantFilter(mac_max=5).mac_min == 0
    assert VariantFilter.wgs().variant_type == "snv"
    for bad in (lambda: VariantFilter(maf_min=0.6), lambda: SetTest(tests=("x",)), lambda: SetTest(cmac_min=1), lambda: zero_based([0])):
        with pytest.raises(ValueError):
            bad()
    with pytest.warns(UserWarning):
        assert accepted(SetTest, {"cmac_min": 3, "other": 1}) == {"cmac_min": 3}


def study(spark, n=200, m=30, p=3, r=2, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(n), rng.normal(size=(n, p - 1))])
    z = rng.binomial(2, 0.1, (m, n))
    y = x @ rng.normal(size=(p, r)) + z.T @ (rng.normal(size=(m, r)) * 0.3) + rng.normal(size=(n, r))
    subjects = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(n)], "iid int, x array<double>, y array<double>")
    geno = spark.createDataFrame([(j, i, int(z[j, i])) for j in range(m) for i in range(n) if z[j, i]], "variant int, iid int, dosage int")
    return x, z, y, subjects, geno


@pytest.mark.parametrize("parts", [1, 5])
def test_gwas_is_least_squares(spark, parts):
    x, z, y, subjects, geno = study(spark)
    got = {r["variant"]: r for r in linear.gwas(geno.repartition(parts), subjects).collect()}
    for j in (0, 7, 29):
        full = np.column_stack([x, z[j]])
        coef = np.linalg.lstsq(full, y, rcond=None)[0]
        res = y - full @ coef
        se = np.sqrt((res**2).sum(axis=0) / (len(x) - 4) * np.linalg.inv(full.T @ full)[-1, -1])
        assert got[j]["beta"] == pytest.approx(coef[-1]) and got[j]["standard_error"] == pytest.approx(se)


def test_gwas_with_missing_calls(spark):
    x, z, y, subjects, geno = study(spark, m=3)
    missing = [(0, 5), (0, 9)]
    holes = geno.where("not (variant = 0 and iid in (5, 9))").unionByName(spark.createDataFrame([(*m, None) for m in missing], geno.schema))
    g = z[0].astype(float)
    g[[5, 9]] = np.delete(g, [5, 9]).mean()
    coef = np.linalg.lstsq(np.column_stack([x, g]), y, rcond=None)[0]
    got = next(r for r in linear.gwas(holes, subjects).collect() if r["variant"] == 0)
    assert got["beta"] == pytest.approx(coef[-1]) and got["n_called"] == 198


def test_set_tests(spark):
    x, z, y, subjects, geno = study(spark, n=300, m=20)
    null = linear.residuals(subjects)
    xx = linear.cross_products(subjects)["xx"]
    qc = variants.variant_qc(geno, 300).select("variant", "maf", "mac")
    table = qc.join(rare.scores(geno, null), "variant").join(rare.projections(geno, null, xx), "variant")
    members = table.select(F.lit("g").alias("set_name"), F.lit("all").alias("mask"), "variant", "maf", "mac", "score", "proj", F.lit(None).cast("array<double>").alias("annot"))
    where = spark.createDataFrame([(j, "1", j) for j in range(20)], "variant int, contig string, pos int")
    variance = rare.voxel_variance(null, np.eye(2), 3)
    got = rare.set_tests(members, rare.banded_ld(geno, where, 20), np.eye(2), variance).orderBy("index").collect()
    m = np.eye(300) - x @ np.linalg.solve(x.T @ x, x.T)
    cov, s = z @ m @ z.T, z @ m @ y
    assert [r["burden_effect"] for r in got] == pytest.approx(s.sum(axis=0) / cov.sum())
    assert all(0 < r["skat_p"] < 1 and 0 < r["staar_o"] < 1 for r in got)


def test_ld_and_heritability(spark):
    rng = np.random.default_rng(2)
    z = rng.binomial(2, 0.3, (12, 100)).astype(float)
    df = spark.createDataFrame([(0, f"rs{i}", i, z[i].tolist()) for i in range(12)], "block_idx int, snp string, pos int, dosages array<double>")
    got = ld.ld_blocks(df, 1.0).orderBy("pos").collect()
    r = np.corrcoef(z)
    assert [g["ldscore"] for g in got] == pytest.approx(((r**2).sum(axis=1) - (12 - (r**2).sum(axis=1)) / 98))
    f, g = (np.array([x[k] for x in got]) for k in ("factor", "inverse_factor"))
    assert f @ f.T == pytest.approx(r, abs=1e-8) and g @ g.T == pytest.approx(np.linalg.inv(r), abs=1e-6)
    kept = {x["snp"] for x in ld.ld_prune(df.select(F.lit("1").alias("contig"), "pos", "snp", "dosages").unionByName(df.limit(1).select(F.lit("1").alias("contig"), F.lit(99).alias("pos"), F.lit("copy").alias("snp"), "dosages")), 0.3, 500).collect()}
    assert "copy" not in kept


def test_jackknife_and_recovery(spark):
    full, loo = np.array([2.0]), np.array([[1.9], [2.1], [2.0]])
    est, se = ld.jackknife(full, loo)
    assert est == pytest.approx([2.0]) and se == pytest.approx([np.sqrt(2 / 3 * 0.02)])
    bases = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "voxel int, b array<double>")
    s = spark.createDataFrame([("rs1", 100.0, [0.1, 0.2], [1.0, 2.0])], "snp string, n double, beta array<double>, z array<double>")
    got = linear.recover_voxels(s, bases, np.eye(2)).orderBy("index").collect()
    assert [r["beta"] for r in got] == pytest.approx([0.1, 0.15])


def test_tfce_and_components(spark):
    grid = np.array([[0, 0], [0, 1], [2, 2], [3, 2], [5, 5]])
    assert nulls.grid_components(nulls.grid_neighbours(grid), np.arange(len(grid))).tolist() == [0, 0, 1, 1, 2]
    one = nulls.tfce_scores(np.array([[-1, -1]]), np.array([0]), np.array([1.0]))
    assert one[0] == pytest.approx(sum(t**2 * 0.1 for t in np.arange(1.0, 1.0, 0.1)))


def test_permutations(spark):
    moved = nulls.permuted_rows(spark.createDataFrame([(i, [float(i)]) for i in range(20)], "iid int, resid array<double>"), 2).collect()
    assert all(sorted(r["resid"][0] for r in moved if r["sample_id"] == k) == list(range(20)) for k in (0, 1))
