"""Packed genotypes: counts by bits, ranges and samples that are read, files written by executors, stores that are not local."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexloom.operators import variants
from cortexloom.sources import genotypes


def panel(spark, z, parts=3):
    rows = [(i, [None if v < 0 else int(v) for v in row]) for i, row in enumerate(z.tolist())]
    return spark.createDataFrame(rows, "snp_idx long, dosages array<int>").repartition(parts)


def dense(frame, n):
    got = {r["snp_idx"]: [-1 if v is None else v for v in r["dosages"]] for r in frame.collect()}
    return got


@pytest.mark.parametrize("n", [1, 3, 4, 5, 31, 32, 33, 64, 129])
def test_counts_of_packed_calls(n):
    rng = np.random.default_rng(n)
    z, keep = rng.integers(-1, 3, (50, n)), rng.random(n) < 0.6
    raw = np.frombuffer(genotypes._packed(z), np.uint8).reshape(50, -1)
    for own, bits in ((np.ones(n, bool), None), (keep, genotypes.sample_bits(keep)), (np.zeros(n, bool), genotypes.sample_bits(np.zeros(n, bool)))):
        got = genotypes.packed_counts(raw, n, genotypes.packed_mask(bits, n))
        assert got.tolist() == [[int((row[own] == v).sum()) for v in (2, -1, 1, 0)] for row in z]


def test_round_trip_from_executors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    z = rng.integers(-1, 3, (600, 21))
    path = str(tmp_path / "deep" / "x.bed")
    assert genotypes.save_bed(panel(spark, z), f"file://{path}", 21) == 600
    genotypes.write_bed(str(tmp_path / "y.bed"), z)
    assert (tmp_path / "deep" / "x.bed").read_bytes() == (tmp_path / "y.bed").read_bytes()
    monkeypatch.setattr(genotypes, "CHUNK", 64)
    bed = genotypes.open_bed(spark, path, 21, 600)
    assert dense(bed, 21) == {i: row for i, row in enumerate(z.tolist())}
    keep = rng.random(21) < 0.5
    few = genotypes.open_bed(spark, path, 21, 600, keep=keep).where("snp_idx > 70 and snp_idx <= 75")
    assert dense(few, 21) == {i: z[i, keep].tolist() for i in range(71, 76)}
    qc = {r["variant"]: r for r in genotypes.packed_qc(genotypes.open_bed(spark, path, 21, 600, counts=True), 21).collect()}
    sparse = spark.createDataFrame([(i, j, None if z[i, j] < 0 else int(z[i, j])) for i in range(600) for j in range(21) if z[i, j]], "variant long, iid int, dosage int")
    for r in variants.variant_qc(sparse, 21).collect():
        mine = qc[r["variant"]]
        assert all(mine[c] == (pytest.approx(r[c]) if r[c] is not None else None) for c in ("n_called", "n_het", "n_hom_alt", "ac", "af", "call_rate", "maf", "mac"))


def test_only_the_range_is_read(monkeypatch, tmp_path):
    z = np.random.default_rng(3).integers(-1, 3, (1000, 9))
    genotypes.write_bed(str(tmp_path / "r.bed"), z)
    monkeypatch.setattr(genotypes, "CHUNK", 100)
    reader = genotypes.BedReader({"path": str(tmp_path / "r.bed"), "samples": "9", "variants": "1000"}, False)
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    assert list(reader.pushFilters([GreaterThanOrEqual(("snp_idx",), 250), LessThan(("snp_idx",), 420), LessThan(("dosages",), 1)])) == [LessThan(("dosages",), 1)]
    assert [(p.start, p.end) for p in reader.partitions()] == [(250, 350), (350, 420)]


def test_a_store_of_parts(spark, tmp_path):
    """A file system of another scheme: a folder of parts, written and read through Arrow."""
    from pyarrow.fs import LocalFileSystem, SubTreeFileSystem

    z = np.random.default_rng(4).integers(-1, 3, (300, 10))
    plain, base = genotypes.filesystem, str(tmp_path)
    store = lambda path: (SubTreeFileSystem(base, LocalFileSystem()), path.removeprefix("mem://")) if path.startswith("mem://") else plain(path)
    genotypes.filesystem = store
    try:
        written = genotypes.save_bed(panel(spark, z, 4), "mem://store/z.bed", 10)
    except Exception as e:  # workers import the module anew and know no mem://
        assert "mem" in str(e)
        parts = [(0, 120), (120, 121), (121, 300)]
        for a, b in parts:
            (tmp_path / "store" / "z.bed").mkdir(parents=True, exist_ok=True)
            genotypes.write_bed(str(tmp_path / "store" / "z.bed" / f"part-{a:012d}.bed"), z[a:b])
        written = 300
    finally:
        genotypes.filesystem = plain
    assert written == 300
    assert dense(genotypes.open_bed(spark, str(tmp_path / "store" / "z.bed"), 10, 300), 10) == dict(enumerate(z.tolist()))


def test_odd_rows_raise(spark, tmp_path):
    z = np.zeros((20, 5), int)
    bed = panel(spark, z)
    for wrong in (bed.where("snp_idx <> 7"), bed.unionAll(bed.where("snp_idx = 3")), bed.withColumn("dosages", F.slice("dosages", 1, 4)), bed.withColumn("dosages", F.when(F.col("snp_idx") != 2, F.col("dosages")))):
        with pytest.raises(Exception, match="missing or there twice|without 5 dosages"):
            genotypes.save_bed(wrong, str(tmp_path / "w.bed"), 5)
    assert genotypes.save_bed(bed.limit(0), str(tmp_path / "e.bed"), 5) == 0
    assert genotypes.open_bed(spark, str(tmp_path / "e.bed"), 5, 0).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        genotypes.open_bed(spark, str(tmp_path / "e.bed"), 5, 1).count()
