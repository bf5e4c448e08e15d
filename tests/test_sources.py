import bz2
import gzip

import numpy as np
import pytest

from cortexloom.sources import genotypes, images, sumstats, text


def write(path, content):
    path.write_text(content)
    return str(path)


def test_subjects(spark, tmp_path):
    p = write(tmp_path / "d.txt", "FID IID data\ns1 s1 1\ns2 s2 2\ns3 s3 3\ns3 s3 3\ns4 s4 NA\ns6 s6 6\n")
    assert sorted((r["iid"], r["data"]) for r in text.read_subjects(spark, p).collect()) == [("s1", 1.0), ("s2", 2.0), ("s6", 6.0)]
    for bad in ("ID data\n1 2\n", "FID IID a a\n1 1 1 1\n", "FID IID\n1 1\n"):
        with pytest.raises(ValueError):
            text.read_subjects(spark, write(tmp_path / "bad.txt", bad))


def test_compression(spark, tmp_path):
    body = b"FID IID x\na a 1\nb b 2\n"
    for end, pack in (("gz", gzip.compress), ("bgz", gzip.compress), ("bz2", bz2.compress)):
        (tmp_path / f"c.txt.{end}").write_bytes(pack(body))
        assert text.read_subjects(spark, str(tmp_path / f"c.txt.{end}")).count() == 2
    for end in ("zip", "tar", "tar.gz", "tar.bz2"):
        with pytest.raises(ValueError):
            text.check_compression(f"x.{end}")


def test_lists(spark, tmp_path):
    k = [write(tmp_path / f"k{i}", c) for i, c in enumerate(("s1 s1\ns2 s2\ns3 s3\n", "s2 s2 x\ns3 s3 y\n", "FID IID\ns2 s2\ns3 s3\n"))]
    assert sorted(r["iid"] for r in text.read_keep(spark, k).collect()) == ["s2", "s3"]
    assert sorted(r["iid"] for r in text.read_remove(spark, k).collect()) == ["s1", "s2", "s3"]
    with pytest.raises(ValueError):
        text.read_ids(spark, write(tmp_path / "one", "s1\n"))
    e = [write(tmp_path / f"e{i}", c) for i, c in enumerate(("rs1\nrs2 a\n", "rs2\nrs3\n", "rs100\n"))]
    assert [r["snp"] for r in text.read_extract(spark, e[:2]).collect()] == ["rs2"]
    with pytest.raises(ValueError):
        text.read_extract(spark, e)
    assert text.read_exclude(spark, e).count() == 4
    loci = [write(tmp_path / "l1", "1:5\nchr2:6\n"), write(tmp_path / "l2", "2:6\n")]
    assert [tuple(r) for r in text.read_loci(spark, loci).collect()] == [("2", 6)]
    assert text.read_loci(spark, loci, every=False).count() == 2
    part = text.read_partition(spark, write(tmp_path / "p", "1 10000 20000\n1 20001 30000\n")).collect()
    assert [r["start"] for r in part] == [10000, 20001]
    assert [r["voxel"] for r in text.read_voxels(spark, write(tmp_path / "v", "1\n5\n")).collect()] == [0, 4]
    assert [tuple(r) for r in text.read_variant_sets(spark, write(tmp_path / "s", "G1 chr1:5-9\n")).collect()] == [("G1", "1", 5, 9)]


def test_expand():
    assert text.expand("file{1:2}_a") == ["file1_a", "file2_a"] == text.expand("file{2:1}_a")
    assert text.expand("file{}") == ["file{}"]
    with pytest.raises(ValueError):
        text.expand("file{1:}")
    assert [text.expand_columns(t) for t in ("1:3", "3,4,5", "1:8,9,10")] == [(0, 3), (2, 5), (0, 10)]
    for bad in ("1:3,5", "0:3"):
        with pytest.raises(ValueError):
            text.expand_columns(bad)


def test_plink(spark, tmp_path):
    rng = np.random.default_rng(1)
    z = rng.integers(-1, 3, (7, 10))
    genotypes.write_bed(str(tmp_path / "p.bed"), z)
    write(tmp_path / "p.bim", "".join(f"22\trs{i}\t0\t{100 + i}\tA\tG\n" for i in range(7)))
    write(tmp_path / "p.fam", "".join(f"f s{i} 0 0 1 -9\n" for i in range(10)))
    bim, fam, bed = genotypes.read_plink(spark, str(tmp_path / "p"), "GRCh38")
    got = {r["snp_idx"]: r["dosages"] for r in bed.collect()}
    assert [[-1 if v is None else v for v in got[i]] for i in range(7)] == z.tolist()
    assert {r["contig"] for r in bim.collect()} == {"chr22"}
    masked = np.ma.masked_less(z, 0)
    freq = masked.mean(axis=1) / 2
    assert [r["maf"] for r in bim.orderBy("snp_idx").collect()] == pytest.approx(np.minimum(freq, 1 - freq).tolist())
    sparse = genotypes.to_sparse(bed, fam)
    assert sparse.count() == int((z != 0).sum())
    genotypes.save_sparse(sparse, bim.withColumnRenamed("snp_idx", "variant").drop("maf"), fam, str(tmp_path / "out"))
    macs = {r["variant"]: r["mac"] for r in genotypes.load_sparse(spark, str(tmp_path / "out"))[1].collect()}
    assert all((macs[i] or 0) == t for i, t in enumerate(np.maximum(z, 0).sum(axis=1)) if i in macs)
    (tmp_path / "q.bed").write_bytes(b"xyz")
    with pytest.raises(Exception, match="bed file"):
        spark.read.format("plink_bed").option("samples", 1).option("variants", 1).load(str(tmp_path / "q.bed")).collect()


def test_vcf(spark, tmp_path):
    body = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n1\t10\trs1\tA\tG\t.\tPASS\t.\tGT:DP\t0/1:3\t1|1:2\t./.:0\n1\t11\trs2\tA\tG,T\t.\tPASS\t.\tGT\t0/0\t0/1\t0/2\n"
    v, g = genotypes.read_vcf(spark, write(tmp_path / "a.vcf", body), "GRCh38")
    assert [(r["contig"], r["rsid"], r["filters"]) for r in v.collect()] == [("chr1", "rs1", [])]
    assert sorted(((r["iid"], r["dosage"]) for r in g.collect()), key=str) == sorted([("a", 1), ("b", 2), ("c", None)], key=str)
    with pytest.raises(ValueError):
        genotypes.read_vcf(spark, "x.txt")


def test_images(spark, tmp_path):
    data = np.zeros((4, 3, 2))
    data[1, 2, 1], data[0, 0, 1] = 5, 7
    (tmp_path / "s1.nii").write_bytes(images.nifti_bytes(data))
    (tmp_path / "mask.nii").write_bytes(images.nifti_bytes((data > 0).astype(float)))
    files = images.list_images(spark, [str(tmp_path)], ".nii").where("iid = 's1'")
    coords = images.mask_coordinates((tmp_path / "mask.nii").read_bytes())
    assert sorted(images.read_images(files, "nifti", coords).first()["voxels"]) == [5.0, 7.0]
    assert images.parse_nifti(gzip.compress((tmp_path / "s1.nii").read_bytes()))[1, 2, 1] == 5


def test_sumstats(spark, tmp_path):
    p = write(tmp_path / "g.txt", "chr\tpos\tsnp\ta1\ta2\tbeta\tse\tz\tn\tmaf\tinfo\n1\t10\trs1\tA\tG\t0\t1\t0\t100\t.0001\t.9\n1\t10\trs1\tA\tC\t0\t1\t0\t99\t.05\t.8\n1\t11\trs11\tT\tG\tNA\tNA\tNA\t100\t.03\t.8\n2\t3\trs3\tA\tT\t0\t1\t0\t100\t.01\t.8\n2\t5\trs5\tA\tG\t0\t1\t0\t10\t.04\t.8\n2\t10\trs2\tc\tA\t0\t1\t0\t100\t.05\t.7\n2\t4\trs4\tC\tA\t0\t1\t0\t100\t.1\t.9\n")
    names = {"chr": "chr", "pos": "pos", "snp": "snp", "a1": "a1", "a2": "a2", "effect": "beta", "se": "se", "z": "z", "n": "n", "maf": "maf"}
    got = sumstats.quality_control(text.read_gwas_text(spark, p, names)).collect()
    assert sorted((r["snp"], r["a1"], r["n"]) for r in got) == [("rs2", "C", 100.0), ("rs4", "C", 100.0)]
    assert [r["snp"] for r in sumstats.quality_control(text.read_gwas_text(spark, p, names | {"info": "info"})).collect()] == ["rs4"]
    sumstats.save(spark.createDataFrame(got), str(tmp_path / "s"))
    assert sumstats.load(spark, str(tmp_path / "s")).count() == 2
    sumstats.write_tsv(spark.createDataFrame(got).select("snp", "z"), str(tmp_path / "t"), ["z"], ["snp"])
    assert any("0.00000e+00" in f.read_text() for f in (tmp_path / "t").glob("part*"))


def test_favor(spark):
    from cortexloom.sources import annotation

    raw = spark.createDataFrame([("1", 5, "A", "G", None, "3.0", "9.0", "x", "10"), ("1", 6, "A", "G", "2", "1.0", "8.0", "y", "0")], "chromosome string, position string, ref_vcf string, alt_vcf string, cadd_phred string, apc_conservation string, apc_conservation_v2 string, genehancer string, apc_local_nucleotide_diversity_v3 string")
    got = annotation.favor_table(raw).orderBy("pos").collect()
    assert [(r["contig"], r["annot"]["cadd_phred"], r["annot"]["apc_conservation"], r["annot"]["genehancer"]) for r in got] == [("chr1", 0.0, 9.0, "x"), ("chr1", 2.0, 8.0, "y")]
    assert got[0]["annot"]["apc_local_nucleotide_diversity2"] == pytest.approx(-10 * np.log10(1 - 0.1)) and got[1]["annot"]["apc_local_nucleotide_diversity2"] is None
    assert annotation.pick(annotation.favor_table(raw), ["CADD"]).schema["annot"].dataType.fieldNames() == ["cadd_phred"]
    with pytest.raises(ValueError):
        annotation.pick(annotation.favor_table(raw), ["x"])
