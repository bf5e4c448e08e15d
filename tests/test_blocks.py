"""Block-gzip files in stretches: every line once at any split, intervals by an index, variant files of any number of samples."""

import gzip
import random
import struct
import zlib

import pytest

from cortexloom.sources import blocks, genotypes, text


def bgzf(data, sizes):
    """Block-gzip bytes of data cut into blocks of these text sizes, and the places of the blocks; an empty block ends the file."""
    out, places, at = b"", [], 0
    cuts = []
    while at < len(data):
        n = sizes[len(cuts) % len(sizes)]
        cuts.append(data[at : at + n])
        at += n
    for piece in [*cuts, b""]:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = deflate.compress(piece) + deflate.flush()
        places.append(len(out))
        out += struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(piece), len(piece))
    return out, places


def lines_of(spark, path, split, intervals=None):
    return [r["value"] for r in blocks.read_lines(spark, [str(path)], intervals, split).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_every_line_once_at_any_split(spark, tmp_path, seed):
    """Lines longer than blocks and stretches, blocks that end at line ends, bytes that look like a block's beginning."""
    rng = random.Random(seed)
    rows = [rng.choice(["", "x", "y" * rng.randint(1, 300), "".join(chr(rng.randint(33, 900)) for _ in range(rng.randint(1, 2000))), "\x1f" * 9]) for _ in range(300)]
    body = "\n".join(rows) + ("\n" if seed else "")
    data, _ = bgzf(body.encode(), [rng.randint(1, 900) for _ in range(40)])
    path = tmp_path / "a.bgz"
    path.write_bytes(data)
    want = body.split("\n")[:-1] if seed else rows if rows[-1] else rows[:-1]
    for split in (50, 997, 5000, 1 << 30):
        reader = blocks.LinesReader({"paths": f'["{path}"]', "split": str(split)})
        got = [v for p in reader.partitions() for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert got == want
    assert sorted(lines_of(spark, path, 4000)) == sorted(want)
    assert [r["value"] for r in text.lines(spark, str(path)).collect()] == want


def test_plain_gzip_is_one_stretch(spark, tmp_path):
    (tmp_path / "p.gz").write_bytes(gzip.compress(b"a\nb\r\n") + gzip.compress(b"c"))
    assert lines_of(spark, tmp_path / "p.gz", 1) == ["a", "b", "c"]


def vcf(samples, variants):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples) + "\n"
    call = lambda v, k: ["0/0", "0|1", "1/1", "./."][(v * 7 + k) % 4]
    body = [f"{c}\t{pos}\trs{v}\tA\tG\t.\tPASS\t.\tGT\t" + "\t".join(call(v, k) for k in range(len(samples))) + "\n" for v, (c, pos) in enumerate(variants)]
    return head, body


def tabix(head, body, variants, places, sizes):
    """The index of the blocks: a chunk for each variant, in its smallest bin, and the linear index."""
    edges = [0]
    for k in range(len(places) - 1):
        edges.append(edges[-1] + sizes[k % len(sizes)])
    virtual = lambda at: next((places[k] << 16 | at - edges[k] for k in range(len(places) - 1) if edges[k] <= at < edges[k + 1]), places[-1] << 16)
    names, at, per = list(dict.fromkeys(c for c, _ in variants)), len(head.encode()), {}
    for (c, pos), line in zip(variants, body):
        begin, end = virtual(at), virtual(at + len(line.encode()))
        at += len(line.encode())
        p = pos - 1
        bins, linear = per.setdefault(c, ({}, {}))
        bins.setdefault(4681 + (p >> 14), []).append((begin, end))
        linear.setdefault(p >> 14, begin)
    out = b"TBI\1" + struct.pack("<8i", len(names), 2, 1, 2, 0, ord("#"), 0, sum(len(n) + 1 for n in names)) + b"".join(n.encode() + b"\0" for n in names)
    for n in names:
        bins, linear = per[n]
        out += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", b, len(cs)) + b"".join(struct.pack("<QQ", *c) for c in cs) for b, cs in bins.items())
        top, before, offsets = max(linear) + 1, 0, []
        for k in range(top):
            before = linear.get(k, before)
            offsets.append(before)
        out += struct.pack(f"<i{top}Q", top, *offsets)
    return bgzf(out, [5000])[0]


def test_variant_file_in_stretches(spark, tmp_path):
    samples = [f"s{i}" for i in range(60)]
    variants = [("1", 100 + 40_000 * i) for i in range(40)] + [("X", 7 + 20_000 * i) for i in range(30)]
    head, body = vcf(samples, variants)
    data, places = bgzf((head + "".join(body)).encode(), sizes := [700, 1500, 333])
    assert len(places) > 10
    path = tmp_path / "v.vcf.bgz"
    path.write_bytes(data)
    plain = tmp_path / "v.vcf"
    plain.write_text(head + "".join(body))
    key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    for part in (0, 1):
        want = key(genotypes.read_vcf(spark, str(plain))[part].collect())
        assert key(genotypes.read_vcf(spark, str(path))[part].collect()) == want and len(want) > 50
    geno = genotypes.read_vcf(spark, str(path))[1]
    assert not any(f"s{i}," in geno._jdf.queryExecution().optimizedPlan().toString() for i in range(60))  # no literal a sample
    intervals = [("1", 400_000, 700_000), ("X", 7, 7)]
    inside = lambda c, p: any(c == a and x <= p <= y for a, x, y in intervals)
    want = sorted((c, p) for c, p in variants if inside(c, p))
    got = lambda: sorted((r["contig"], r["pos"]) for r in genotypes.read_vcf(spark, str(path), intervals=intervals)[0].collect())
    assert got() == want
    (tmp_path / "v.vcf.bgz.tbi").write_bytes(tabix(head, body, variants, places, sizes))
    assert got() == want
    reader = blocks.LinesReader({"paths": f'["{path}"]', "intervals": '[["1", 400000, 700000], ["X", 7, 7]]', "split": "2000"})
    parts = reader.partitions()
    read = [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
    seen = [tuple(v.split("\t")[:2]) for v in read if not v.startswith("#")]
    assert len(set(seen)) == len(seen) < 20 and {(c, str(p)) for c, p in want} <= set(seen) and sum(v.startswith("#CHROM") for v in read) == 1
    assert genotypes.read_vcf(spark, str(path), intervals=[("7", 1, 10)])[0].count() == 0
    sent = genotypes.read_vcf(spark, str(path), intervals=intervals)[1]
    assert {r["iid"] for r in sent.collect()} <= set(samples) and sent.count() > 0


def test_a_cut_file_is_told(tmp_path):
    data, places = bgzf(b"line\n" * 500, [100])
    path = tmp_path / "c.bgz"
    path.write_bytes(data[: places[5] + 12])
    reader = blocks.LinesReader({"paths": f'["{path}"]'})
    with pytest.raises(ValueError, match="no block"):
        [b for p in reader.partitions() for b in reader.read(p)]
