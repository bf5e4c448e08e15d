import numpy as np
import pytest

from cortexloom.operators import masks, rare
from cortexloom.sources import models


def test_ld_numbers_run_on(spark, tmp_path):
    for k in (1, 2):
        spark.createDataFrame([(b, "1", 10 * b + i, f"rs{k}{b}{i}", 3 * b + i) for b in (0, 1) for i in (0, 1)], "block_idx int, contig string, pos int, snp string, row_id int").write.parquet(str(tmp_path / f"ld{k}"))
    got = models.load_ld(spark, [str(tmp_path / "ld1"), str(tmp_path / "ld2")])
    assert sorted({r["block_idx"] for r in got.collect()}) == [0, 1, 2, 3]
    spark.createDataFrame([(0, "1", 5, "a", 0), (0, "1", 5, "b", 1)], "block_idx int, contig string, pos int, snp string, row_id int").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        models.load_ld(spark, [str(tmp_path / "bad")])


def test_null_and_loco(spark, tmp_path):
    null = spark.createDataFrame([("a", [1.0], [1.0, 2.0]), ("b", [1.0], [3.0, 4.0])], "iid string, x array<double>, resid array<double>")
    bases = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "voxel int, b array<double>")
    models.save_null(null, bases, str(tmp_path / "null"))
    n, b = models.load_null(spark, str(tmp_path / "null"), 1, [1], null.where("iid = 'b'").select("iid"))
    assert [tuple(r["resid"]) for r in n.collect()] == [(3.0,)] and [tuple(r["b"]) for r in b.collect()] == [(0.0,)]
    preds = spark.createDataFrame([(0, "1", [1.0, 2.0]), (1, "1", [3.0, 4.0]), (0, "2", [5.0, 6.0]), (1, "2", [7.0, 8.0])], "ldr int, contig string, pred array<double>")
    models.save_loco(preds, ["a", "b"], str(tmp_path / "loco"))
    assert {r["iid"]: r["pred"] for r in models.load_loco(spark, str(tmp_path / "loco"), "2").collect()} == {"a": [5.0, 7.0], "b": [6.0, 8.0]}


def test_permutation_lookup(spark, tmp_path):
    merged = spark.createDataFrame([("2_2", 1, [10.0, 20.0, 30.0], 1000)], "bin string, voxel int, stats array<double>, count long")
    models.save_permutations(merged, str(tmp_path / "perm"))
    null = models.load_permutations(spark, str(tmp_path / "perm"), 2)
    p = rare.burden_p(np.array([20.0, 5.0]), 2, null)
    assert p[0] == pytest.approx(2 / 1000) and np.isnan(p[1])
    assert np.isnan(rare.burden_p(np.array([5.0, 5.0]), 2, null)[0])
    assert rare.burden_p(np.array([3.841458820694124]), 101, null)[0] == pytest.approx(0.05)


def test_masks(spark):
    genes = spark.createDataFrame([("G1", "1", 0, 50), ("G2", "1", 40, 100)], "set_name string, contig string, start int, end int")
    v = spark.createDataFrame([(1, "1", 10, "exonic", "stopgain", None, "G1", None, None, None), (2, "1", 45, "exonic", "nonsynonymous SNV", "D", "G2", None, None, None), (3, "1", 46, "upstream", None, None, "G2(dist=1)", "x;connected_gene=G1;y", "c", None), (4, "1", 60, "UTR3", None, None, "G2:c", None, None, "d")], "variant int, contig string, pos int, category string, exonic string, metasvm string, info string, genehancer string, cage string, dhs string")
    got = sorted((r["set_name"], r["mask"], r["variant"]) for r in masks.coding_members(v, genes, ["plof", "missense"]).collect())
    assert got == [("G1", "disruptive_missense", 2), ("G1", "missense", 2), ("G1", "plof", 1), ("G2", "disruptive_missense", 2), ("G2", "missense", 2)]
    regions = spark.createDataFrame([("1", 46, 47)], "contig string, start int, end int")
    got = sorted((r["set_name"], r["mask"], r["variant"]) for r in masks.noncoding_members(v, genes, promoters=regions).collect())
    assert got == [("G1", "enhancer_cage", 3), ("G2", "promoter_cage", 3), ("G2", "upstream", 3), ("G2", "utr", 4)]
    assert masks.noncoding_members(v, genes, ["promoter_cage"]).count() == 0
    with pytest.raises(ValueError):
        masks.categories(["x"], masks.CODING)
