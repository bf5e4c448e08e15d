"""Archive folders written more than once, and archives of other writers."""

import gzip

import pytest
from pyspark.sql import functions as F

from cortexloom.llm import warc
from cortexloom.llm.common import scratch


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def names(path):
    fs, root = warc.filesystem(path)
    return sorted(f.base_name for f in warc.files_of(fs, root))


def test_append_keeps_what_was_there(spark):
    path = scratch(spark, "warc")
    warc.write_pages(pages(spark, [(1, "a", "one"), (2, "b", "two")]), path)
    warc.write_pages(pages(spark, [(3, "c", "one"), (4, "d", "four")]), path)
    warc.write_pages(pages(spark, []), path)
    got = {r["page_id"]: (r["record_type"], bytes(r["payload"])) for r in warc.read_archive(spark, path).collect()}
    assert got == {1: ("response", b"one"), 2: ("response", b"two"), 3: ("response", b"one"), 4: ("response", b"four")}
    assert warc.read_archive(spark, path, payload=False).where("page_id = 3").count() == 1


def test_overwrite_clears(spark):
    path = scratch(spark, "warc")
    warc.write_pages(pages(spark, [(1, "a", "one"), (2, "b", "two")]).repartition(2), path)
    warc.write_pages(pages(spark, [(5, "e", "five")]), path, mode="overwrite")
    assert [r["page_id"] for r in warc.read_archive(spark, path).collect()] == [5]
    assert len([n for n in names(path) if n.endswith(".warc.gz")]) == 1 and len([n for n in names(path) if n.endswith(".json")]) == 1
    warc.write_pages(pages(spark, []), path, mode="overwrite")
    assert warc.read_archive(spark, path).count() == 0


def test_two_writers_at_once(spark):
    """Jobs whose tasks overlap: each commits its own manifest."""
    path = scratch(spark, "warc")
    writers = [warc.WarcWriter({"path": path}) for _ in range(2)]
    batch = pages(spark, [(1, "a", "x")]).select("page_id", "url", F.col("html").cast("binary").alias("payload"), F.lit("response").alias("record_type"), F.lit(warc.digest(b"x")).alias("payload_digest"), F.lit(None).cast("long").alias("refers_to")).toArrow().to_batches()
    written = [w.write(iter(batch)) for w in writers]
    lost = writers[0].write(iter(batch))  # a task that is run again: nobody commits this one
    for w, message in zip(writers, written):
        w.commit([message])
    assert lost.files and warc.read_archive(spark, path).count() == 2
    writers[0].abort([lost])
    assert not any(n.startswith(lost.files[0]["name"]) for n in names(path))


def record(kind, body, **head):
    lines = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:0>", "Content-Length": len(body)} | {k.replace("_", "-"): v for k, v in head.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


HTTP = "application/http; msgtype=response"
RECORDS = [
    record("warcinfo", b"software: other\r\n", Content_Type="application/warc-fields"),
    record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Target_URI="http://a/", Content_Type="application/http; msgtype=request"),
    record("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>WARC/1.0\r\n\r\n</p>", WARC_Target_URI="http://a/", WARC_Payload_Digest="sha1:ABC", Content_Type=HTTP),
    record("resource", b"plain \xff", WARC_Target_URI="http://b/", Content_Type="text/plain"),
    record("response", b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 3_000_000, WARC_Target_URI="http://c/", Content_Type=HTTP),
    record("revisit", b"HTTP/1.1 304\r\n\r\n", WARC_Target_URI="http://a/", Content_Type=HTTP),
    record("response", b"", WARC_Target_URI="http://empty/", Content_Type=HTTP),
]


@pytest.mark.parametrize("kind", ["members", "one member", "padded", "plain", "two files"])
def test_archives_of_others(spark, kind):
    path = scratch(spark, "foreign")
    fs, root = warc.filesystem(path)
    fs.create_dir(root, recursive=True)
    files = {
        "members": {"x.warc.gz": b"".join(map(gzip.compress, RECORDS))}, "one member": {"x.warc.gz": gzip.compress(b"".join(RECORDS))}, "padded": {"x.warc.gz": b"\0\0".join(map(gzip.compress, RECORDS))},
        "plain": {"x.warc": b"".join(RECORDS)}, "two files": {"x.WARC.GZ": b"".join(map(gzip.compress, RECORDS[:3])), "y.warc": b"".join(RECORDS[3:]), "notes.txt": b"no archive"},
    }[kind]
    for name, data in files.items():
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(data)
    got = sorted((r["record_type"], r["url"] or "", r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in warc.read_archive(spark, path).collect())
    assert [g[:2] for g in got] == [("request", "http://a/"), ("resource", "http://b/"), ("response", "http://a/"), ("response", "http://c/"), ("response", "http://empty/"), ("revisit", "http://a/"), ("warcinfo", "")]
    assert [g[3] for g in got] == [None, b"plain \xff", b"<p>WARC/1.0\r\n\r\n</p>", b"z" * 3_000_000, b"", None, None] and got[2][2] == "ABC"
    found = warc.read_archive(spark, path).where("record_type = 'response' and url = 'http://c/'").collect()
    assert len(found) == 1 and found[0]["page_id"] is None and len(found[0]["payload"]) == 3_000_000
    assert warc.read_archive(spark, path, payload=False).where("payload is null").count() == 7


def test_no_archive_is_told(spark):
    path = scratch(spark, "foreign")
    with pytest.raises(Exception, match="no manifest"):
        warc.read_archive(spark, path).collect()
    fs, root = warc.filesystem(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/cut.warc", compression=None) as out:
        out.write(RECORDS[4][:1000])
    with pytest.raises(Exception, match="ends early"):
        warc.read_archive(spark, path).collect()
