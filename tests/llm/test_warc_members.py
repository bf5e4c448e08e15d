"""Odd rows of pages, and members that are skipped by their length."""

import random

import pytest
from pyspark.sql import functions as F

from cortexloom.llm import warc
from cortexloom.llm.common import scratch

PAGES = "page_id long, url string, html string, _sha1 string, _first long, _n int, payload string, record_type string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, "p", "t") for r in rows], PAGES)


def test_null_negative_and_repeated_ids(spark):
    rows = [(None, "u", "<p>a</p>"), (None, None, "<p>b</p>"), (-5, "n", "<p>a</p>"), (-7, "n", "<p>a</p>"), (3, "x", "<p>c</p>"), (3, "y", "<p>c</p>"), (2, "z", "<p>c</p>"), (0, "", None)]
    path = scratch(spark, "warc")
    warc.write_pages(pages(spark, rows).repartition(3), path)
    got = [(r["page_id"], r["url"], r["record_type"], r["refers_to"], None if r["payload"] is None else r["payload"].decode()) for r in warc.read_archive(spark, path).collect()]
    assert sorted(got, key=repr) == sorted([
        (None, "u", "response", None, "<p>a</p>"), (None, None, "response", None, "<p>b</p>"), (-5, "n", "response", None, "<p>a</p>"), (-7, "n", "revisit", -5, None),
        (3, "x", "response", None, "<p>c</p>"), (3, "y", "response", None, "<p>c</p>"), (2, "z", "revisit", 3, None), (0, "", "response", None, ""),
    ], key=repr)
    found = warc.read_archive(spark, path).where("page_id is null")
    assert found.count() == 2 and warc.read_archive(spark, path).where("refers_to = -5").first()["page_id"] == -7


def test_urls_come_back(spark):
    urls = ["http://h/a b?q=ü%20%C3%BC", "http://h/" + "x" * 100_000, "line\r\nWARC-Type: revisit", " lead and trail ", "", None, "\t", "http://h/{}|^`\"", "漢字", "X-Page-URL: \"q\""]
    path = scratch(spark, "warc")
    warc.write_pages(pages(spark, [(i, u, "h") for i, u in enumerate(urls)]), path, least=2)
    got = {r["page_id"]: r["url"] for r in warc.read_archive(spark, path, payload=False).collect()}
    assert got == dict(enumerate(urls))
    head = warc.parse_headers(warc.record(1, "http://h/a b%20", b"", "response", "x", None).split(b"\r\n\r\n")[0])
    assert head["warc-target-uri"] == "http://h/a%20b%20"


def read_all(path, least_inflated=None, **options):
    reader = warc.WarcReader({"path": path} | options)
    return reader, [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_unwanted_payloads_are_not_inflated(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "u", "".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(400_000 if i % 3 else 10))) for i in range(12)]
    path = scratch(spark, "warc")
    warc.write_pages(pages(spark, rows).coalesce(1), path)
    streams = []
    plain = warc._Stream.__init__

    def kept(self, *args):
        plain(self, *args)
        streams.append(self)

    monkeypatch.setattr(warc._Stream, "__init__", kept)
    _, heads = read_all(path, payload="false")
    assert sorted(r["page_id"] for r in heads) == list(range(12)) and all(r["payload"] is None for r in heads)
    skipped = sum(s.inflated for s in streams)
    streams.clear()
    _, whole = read_all(path)
    assert {r["page_id"]: r["payload"].decode() for r in whole} == {i: t for i, _, t in rows}
    assert skipped <= 12 * 2 * warc._STEP < sum(s.inflated for s in streams) / 50


@pytest.mark.parametrize("size", [1, 300, 5000])
def test_ranges_and_reads_of_any_size(spark, monkeypatch, size):
    """Members of many ranges, fetched in small blocks, with lengths known or not."""
    rng = random.Random(2)
    rows = [{"page_id": i, "url": "u", "payload": bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 3000]))), "record_type": "response", "refers_to": None} for i in range(40)]
    import pyarrow as pa

    for r in rows:
        r["payload_digest"] = warc.digest(r["payload"])
    monkeypatch.setattr(warc, "RANGE_BYTES", 4000)
    monkeypatch.setattr(warc, "_READ", max(16, size))
    path = scratch(spark, "warc").removeprefix("file://")
    writer = warc.WarcWriter({"path": path})
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows)]))])
    reader, got = read_all(path)
    assert len(reader.partitions()) > 5 and {r["page_id"]: r["payload"] for r in got} == {r["page_id"]: r["payload"] for r in rows}
    odd = [r for r in reader.partitions()]
    monkeypatch.setattr(warc.np, "frombuffer", lambda raw, kind: __import__("numpy").zeros(len(raw) // 4, kind))  # no length is known
    assert sorted(r["page_id"] for p in odd for b in reader.read(p) for r in b.to_pylist()) == list(range(40))


def test_abort_leaves_nothing(spark, tmp_path):
    import pyarrow as pa

    writer = warc.WarcWriter({"path": str(tmp_path / "a")})
    row = {"page_id": 1, "url": "u", "payload": b"x", "record_type": "response", "payload_digest": warc.digest(b"x"), "refers_to": None}
    writer.abort([writer.write(iter([pa.RecordBatch.from_pylist([row])])), None])
    assert not list((tmp_path / "a").iterdir())


def test_filters_on_headers(spark):
    path = scratch(spark, "warc")
    warc.write_pages(pages(spark, [(i, f"http://h/{i}", f"page {i % 4}") for i in range(20)]), path)
    archive = warc.read_archive(spark, path)
    assert archive.where(F.col("url").isin("http://h/3", "http://h/19")).count() == 2
    assert sorted(r["page_id"] for r in archive.where("record_type = 'response'").collect()) == [16, 17, 18, 19]
    assert archive.where("payload_bytes > 100").count() == 0


def test_pages_reach_the_writer_in_small_batches(spark, tmp_path, monkeypatch):
    """Settings hold for the job only, whether it fails or not."""
    from pyspark.sql.readwriter import DataFrameWriter

    names, seen, save = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"), [], DataFrameWriter.save
    before = [spark.conf.get(k, None) for k in names]

    def watched(self, *args, **kwargs):
        seen.append([int(spark.conf.get(k)) for k in names])
        return save(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "save", watched)
    pages = spark.createDataFrame([(k, f"u{k}", "x" * (k % 3)) for k in range(1200)], "page_id long, url string, html string").coalesce(1)
    warc.write_pages(pages, f"file://{tmp_path}/a")
    with pytest.raises(Exception):
        warc.write_pages(pages.withColumn("html", F.raise_error(F.lit("no")).cast("string")), f"file://{tmp_path}/b")
    assert seen == [[warc.WRITE_BATCH, warc.BATCH_BYTES]] * 2 and [spark.conf.get(k, None) for k in names] == before
    assert warc.read_archive(spark, f"file://{tmp_path}/a").where("record_type = 'response'").count() == 3
