"""WARC archives as a PySpark Python data source, format name "warc".

Writing: each task writes members compressed record by record to a file of its own, and the length
of each member to an index beside it; commit writes a manifest that names the files of the tasks
that succeeded, and only those are read, so a task that is run again leaves no double records.  Each
job has a manifest of its own: appending adds one, overwriting replaces all that were there.
A folder without manifests is read too: its .warc and .warc.gz files, whoever wrote them, one
partition each, record by record.
Reading: one partition for each range of members of a file; filters on the record type and on
headers are taken over from Spark; the headers of a record are parsed first, and its payload is
decoded only if the filters let the record pass and payloads are asked for.  Else the reader goes
to the next member by the index: what is left of the payload is neither inflated nor, if it is
longer than a read, fetched.

Columns written: page_id, url, payload (binary), record_type, payload_digest, refers_to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from array import array
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import quote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"  # a fixed date: equal tables give equal archives
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, record_bytes long, payload binary"
#: Names of the manifests, one a job.
MANIFEST = "manifest"
#: Ending of the index of a file: the compressed length of each member, 32-bit little-endian, 0 for one beyond that range (found by inflating it).
INDEX = ".lengths"
#: Characters of a url that stay as they are in WARC-Target-URI; others are percent-encoded, and X-Page-URL has the url as a JSON string.
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))
#: Compressed bytes of a file after which a new member range begins; a partition of the reader.
RANGE_BYTES = 32 << 20
#: Bytes fetched at once, and decoded at once while headers are looked for.
_READ, _STEP = 1 << 20, 1024
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20
#: Rows of a batch that goes to the writer.
WRITE_BATCH = 500


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str):
    """A file system and the path in it: a local or shared folder, or any store that Arrow can open."""
    import pyarrow.fs as fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path
    return fs.FileSystem.from_uri(path)


def _urn(page_id: int | None) -> str:
    return "<urn:page:>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, payload_digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has no payload of its own."""
    body = payload if kind != "revisit" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        clean = quote(url, safe=_PLAIN)
        head += [("WARC-Target-URI", clean)] + [("X-Page-URL", json.dumps(url))] * (clean != url)
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


def manifests(fs, root: str) -> list[str]:
    """Paths of the manifests of an archive folder."""
    return sorted(f.path for f in files_of(fs, root) if f.base_name.startswith(MANIFEST) and f.base_name.endswith(".json"))


def files_of(fs, root: str) -> list:
    from pyarrow.fs import FileSelector

    return [f for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.is_file]


def named_files(fs, manifest: str) -> list[dict]:
    with fs.open_input_stream(manifest, compression=None) as f:
        return json.loads(f.read())["files"]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", "1")), overwrite

    def write(self, iterator) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, starts, firsts, size, lengths, out = f"part-{uuid.uuid4().hex}.warc.gz", [0], [0], 0, array("I"), None
        for batch in iterator:
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                deflate = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                raw = deflate.compress(record(row["page_id"], row["url"], row["payload"] or b"", row["record_type"], row["payload_digest"], row["refers_to"])) + deflate.flush()
                if size - starts[-1] >= RANGE_BYTES:
                    starts.append(size)
                    firsts.append(len(lengths))
                out.write(raw)
                size += len(raw)
                lengths.append(len(raw) if len(raw) < 1 << 32 else 0)
        if out is None:
            return Written([])
        out.close()
        with fs.open_output_stream(f"{root}/{name}{INDEX}", compression=None) as index:
            index.write(np.array(lengths, "<u4").tobytes())
        return Written([{"name": name, "starts": starts, "firsts": firsts, "size": size, "records": len(lengths)}])

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        before = manifests(fs, root) if self.overwrite else []
        stale = [f["name"] for m in before for f in named_files(fs, m)]
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps({"files": [f for m in messages if m for f in m.files]}).encode())
        for path in [*before, *(f"{root}/{name}{end}" for name in stale for end in ("", INDEX))]:
            fs.delete_file(path)

    def abort(self, messages) -> None:
        fs, root = filesystem(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f['name']}")
            fs.delete_file(f"{root}/{f['name']}{INDEX}")


class Members(InputPartition):
    """Bytes start..end of a file: the members first..last of its index."""

    def __init__(self, name: str, start: int, end: int, first: int, last: int):
        self.name, self.start, self.end, self.first, self.last = name, start, end, first, last


class _Whole:
    """The bytes of a file from its start to its end, inflated if it is compressed, however its members are cut."""

    def __init__(self, raw, compressed: bool):
        self.raw, self.buffer = raw, b""
        self.inflate = zlib.decompressobj(31) if compressed else None
        self.pending = b""

    def _more(self) -> bool:
        """Add bytes to the buffer; False at the end of the file."""
        while True:
            data = self.pending or self.raw.read(_READ)
            if not data:
                return False
            if self.inflate is None:
                self.buffer += data
                return True
            if self.inflate.eof:
                self.inflate, data = zlib.decompressobj(31), data.lstrip(b"\0")  # some writers pad members
                if not data:
                    self.pending = b""
                    continue
            got = self.inflate.decompress(data, _READ)
            self.pending = self.inflate.unconsumed_tail or self.inflate.unused_data
            if got:
                self.buffer += got
                return True

    def begin(self) -> bool:
        """Go to the next record, past the line ends behind the last one; False if there is none."""
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            if self.buffer:
                return True
            if not self._more():
                return False

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                raise ValueError("a record without end of headers")
        got, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                raise ValueError("a record that ends early")
            parts.append(self.buffer)
            have += len(self.buffer)
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        """Past n bytes, of which no more than a read is held."""
        while n > len(self.buffer):
            n, self.buffer = n - len(self.buffer), b""
            if self.inflate is None and n > _READ:
                self.raw.seek(n, 1)
                n = 0
            elif n and not self._more():
                raise ValueError("a record that ends early")
        self.buffer = self.buffer[n:]


class _Stream:
    """The decompressed bytes of one member after the other, read in blocks; what is skipped is not inflated."""

    def __init__(self, raw, start: int, end: int, lengths: np.ndarray):
        self.raw, self.end, self.lengths, self.at = raw, end, lengths, 0
        self.base, self.block, self.pos = start, b"", 0  # place of the block in the file, the block, what of it is used
        self.buffer, self.member, self.next = b"", None, None
        self.inflated = 0  # compressed bytes that were decoded
        raw.seek(start)

    def begin(self) -> bool:
        """Go to the next member."""
        if self.member is not None and self.next is None:  # its length is not known: inflate to its end
            while self._more(_READ):
                self.buffer = b""
        elif self.member is not None and self.base <= self.next <= self.base + len(self.block):
            self.pos = self.next - self.base
        elif self.member is not None:
            self.raw.seek(self.next)
            self.base, self.block, self.pos = self.next, b"", 0
        self.buffer = b""
        if self.at >= len(self.lengths):
            return False
        length = int(self.lengths[self.at])
        self.next = self.base + self.pos + length if length else None
        self.at += 1
        self.member = zlib.decompressobj(31)
        return True

    def _more(self, step: int) -> bool:
        """Decode at most `step` compressed bytes of the member."""
        if self.member.eof:
            return False
        if self.pos == len(self.block):
            self.base, self.pos = self.base + len(self.block), 0
            self.block = self.raw.read(min(_READ, self.end - self.base)) if self.base < self.end else b""
        data = self.block[self.pos : self.pos + step]
        if not data:
            return False
        self.buffer += self.member.decompress(data)
        used = len(data) - len(self.member.unused_data)
        self.pos, self.inflated = self.pos + used, self.inflated + used
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more(_STEP):
                raise ValueError("a record without end of headers")
        got, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more(_READ >> 4):
                raise ValueError("a record that ends early")
            parts.append(self.buffer)
            have += len(self.buffer)
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def page_of(urn: str | None) -> int | None:
    """The page_id in a record's name; None for other names and for a record of a row without page_id."""
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn and urn.startswith("<urn:page:") else ""
    return int(number) if number else None


def fields(head: dict[str, str]) -> dict:
    return {
        "page_id": page_of(head.get("warc-record-id")), "url": json.loads(head["x-page-url"]) if "x-page-url" in head else head.get("warc-target-uri"), "record_type": head.get("warc-type"),
        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": int(head.get("x-payload-length", head.get("content-length", "0"))),
        "refers_to": page_of(head.get("warc-refers-to")), "record_bytes": int(head.get("content-length", "0")),
    }


_TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads, self.tests = options["path"], options.get("payload", "true").lower() != "false", []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "record_bytes") and (type(f) in _TESTS or isinstance(f, IsNotNull)):
                self.tests.append((name, type(f), getattr(f, "value", None)))
            else:
                yield f

    def passes(self, row: dict) -> bool:
        return all(row[name] is not None and (kind is IsNotNull or _TESTS[kind](row[name], value)) for name, kind, value in self.tests)

    def partitions(self):
        fs, root = filesystem(self.path)
        known = manifests(fs, root)
        if not known:
            others = sorted((f.base_name, f.size) for f in files_of(fs, root) if f.base_name.lower().endswith((".warc", ".warc.gz")))
            if not others:
                raise FileNotFoundError(f"{self.path}: no manifest, no .warc and no .warc.gz file")
            return [Members(name, 0, size, -1, -1) for name, size in others]
        files = [f for m in known for f in named_files(fs, m)]
        ranges = lambda f: zip(f["starts"], [*f["starts"][1:], f["size"]], f["firsts"], [*f["firsts"][1:], f["records"]])
        return [Members(f["name"], *r) for f in files for r in ranges(f)] or [Members("", 0, 0, 0, 0)]

    def read(self, part: Members):
        if not part.name:
            return
        fs, root = filesystem(self.path)
        rows, held = [], 0
        for row in self._whole(fs, f"{root}/{part.name}") if part.first < 0 else self._indexed(fs, f"{root}/{part.name}", part):
            rows.append(row)
            held += len(row["payload"] or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _indexed(self, fs, path: str, part: Members):
        """Rows of a range of members of a file that this library wrote."""
        with fs.open_input_file(f"{path}{INDEX}") as index:
            index.seek(4 * part.first)
            lengths = np.frombuffer(index.read(4 * (part.last - part.first)), "<u4")
        with fs.open_input_file(path) as raw:
            stream = _Stream(raw, part.start, part.end, lengths)
            while stream.begin():
                row = fields(parse_headers(stream.until(b"\r\n\r\n")))
                if not self.passes(row):
                    continue
                row["payload"] = None
                if self.payloads and row["record_type"] == "response":
                    row["payload"] = stream.take(row["record_bytes"])
                    if digest(row["payload"]) != row["payload_digest"]:
                        raise ValueError(f"the payload of page {row['page_id']} does not have its digest")
                yield row

    def _whole(self, fs, path: str):
        """Rows of a file of any writer: the block of a response, without the HTTP headers if it has them, is its payload."""
        with fs.open_input_file(path) as raw:
            stream = _Whole(raw, raw.read(2) == b"\x1f\x8b")
            raw.seek(0)
            while stream.begin():
                head = parse_headers(stream.until(b"\r\n\r\n"))
                row = fields(head)
                if not self.passes(row):
                    stream.skip(row["record_bytes"])
                    continue
                row["payload"] = None
                if self.payloads and row["record_type"] in ("response", "resource", "conversion"):
                    block = stream.take(row["record_bytes"])
                    row["payload"] = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                else:
                    stream.skip(row["record_bytes"])
                yield row


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("record_bytes", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@contextmanager
def smaller_batches(spark):
    """Arrow batches of WRITE_BATCH rows and BATCH_BYTES at most while a job runs: a row holds a whole page, and a batch
    is there in the executor and in its Python worker at once."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": WRITE_BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_pages(pages: DataFrame, path: str, least: int = 0, mode: str = "append") -> None:
    """Write a record for each row of pages (page_id, url, html) to the archive folder `path`.

    mode: `append` adds to what is there, `overwrite` replaces it when the new records are written.
    Revisits refer to pages of the same call; payloads are told apart by their SHA-1.

    The payload is the html in UTF-8, null as empty.  Of the rows with equal payloads of at least
    `least` bytes the one with the largest page_id is a response, the others are revisits that refer
    to it; rows with smaller payloads are all responses.  If rows repeat a page_id, all with the
    largest one are responses.  A row without page_id is a response that no revisit refers to.  A url
    comes back as it was, null as null.  An empty table gives an archive without records.  Rows of one
    payload, however many, meet their group's one row in a join that adaptive execution splits.
    """
    register(pages.sparkSession)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("_sha1", F.unhex(F.sha1("payload")))
    groups = rows.where(F.length("payload") >= least).groupBy("_sha1").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_sha1").alias("_key"), "_first")
    marked = rows.join(groups, (F.col("_sha1") == F.col("_key")) & (F.length("payload") >= least), "left")
    revisit = F.coalesce(F.col("_first") != F.col("page_id"), F.lit(False))
    hexed = F.hex("_sha1")
    value = lambda i: F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 10).cast("int")  # noqa: E731  20 bits: four letters
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    base32 = F.concat(*[F.substring(F.lit(letters), 1 + F.shiftright(value(i), 15 - 5 * k).bitwiseAND(31), F.lit(1)) for i in range(8) for k in range(4)])
    out = marked.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), base32.alias("payload_digest"), F.when(revisit, F.col("_first")).alias("refers_to"))
    with smaller_batches(pages.sparkSession):
        out.write.format("warc").mode(mode).save(path)


def read_archive(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive folder; see READ_SCHEMA. Without payload, only headers are parsed.

    Records of other writers have no page_id, their payload is not checked against its digest, and
    payload_bytes is the length of the whole block, HTTP headers included."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
