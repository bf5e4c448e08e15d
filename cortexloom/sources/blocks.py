"""Lines of block-gzip files as a Python data source, format name "bgzf_lines".

A block-gzip file is a row of small gzip members that name their own size, so a task finds the first
member behind its place and reads from there: files of any size are dealt to many tasks.  A task
that does not begin at the file's start leaves the line it lands in to the one before, which reads
on to its end.  With a tabix index beside the file and intervals asked for, only the stretches that
can hold them are read.  A gzip file without block sizes is read by one task, as it streams.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .genotypes import filesystem

#: Compressed bytes that a task reads, and bytes of text in a batch.
SPLIT, BATCH = 32 << 20, 4 << 20
_MOST = 1 << 16
_MARK = b"\x1f\x8b\x08\x04"


def block_size(head: bytes) -> int | None:
    """Size of the block that begins with these bytes; None if they begin none."""
    if len(head) < 18 or not head.startswith(_MARK):
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(len(head), 12 + extra):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def first_block(raw, start: int, size: int) -> int:
    """Place of the first block at or behind `start`: one that another block, or the file's end, follows; the size if there is none."""
    raw.seek(start)
    data = raw.read(3 * _MOST)
    at = data.find(_MARK)
    while at >= 0:
        own = block_size(data[at : at + 64])
        if own is not None:
            behind = at + own
            if start + behind == size or block_size(data[behind : behind + 64]) is not None:
                return start + at
        at = data.find(_MARK, at + 1)
    return size


def blocks(raw, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of each block from `start` on."""
    raw.seek(start)
    held = b""
    while start < size:
        if len(held) < _MOST:
            held += raw.read(1 << 20)
        own = block_size(held[:64])
        if own is None or own > len(held):
            raise ValueError(f"no block of a block-gzip file at {start}")
        yield start, zlib.decompress(held[:own], 31)
        start, held = start + own, held[own:]


class Stretch(InputPartition):
    """Blocks that begin in start..end.  skip, stop: places in the text of the first block and of the block at `end`
    where lines are known to begin; None: the line the stretch lands in belongs to the one before, and the last one is read to its end.
    head: only the lines from the start on that begin with #."""

    def __init__(self, path: str, start: int, end: int, skip: int | None, stop: int | None, blocked: bool = True, head: bool = False):
        self.path, self.start, self.end, self.skip, self.stop, self.blocked, self.head = path, start, end, skip, stop, blocked, head


def _bins(start: int, end: int) -> set[int]:
    """Bins of the index that overlap the zero-based positions start..end-1."""
    out = {0}
    for base, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)):
        out |= set(range(base + (start >> shift), base + (max(end - 1, start) >> shift) + 1))
    return out


def indexed(index: bytes, intervals: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Virtual places (block << 16 | place in its text) of the stretches that can hold the one-based closed intervals, joined and in order."""
    data = zlib.decompressobj(31)
    text, rest = b"", index
    while rest:
        text += data.decompress(rest)
        rest, data = data.unused_data, zlib.decompressobj(31)
    if not text.startswith(b"TBI\x01"):
        raise ValueError("not a tabix index")
    refs, *_, length = struct.unpack_from("<8i", text, 4)
    names, at = [n.decode() for n in text[36 : 36 + length].split(b"\0")[:-1]], 36 + length
    wanted: dict[str, list] = {}
    for contig, start, end in intervals:
        wanted.setdefault(contig, []).append((max(0, start - 1), end))
    found = []
    for name in names[:refs]:
        chunks: dict[int, list] = {}
        (bins,) = struct.unpack_from("<i", text, at)
        at += 4
        for _ in range(bins):
            number, n = struct.unpack_from("<Ii", text, at)
            chunks[number] = list(struct.iter_unpack("<QQ", text[at + 8 : at + 8 + 16 * n]))
            at += 8 + 16 * n
        (n,) = struct.unpack_from("<i", text, at)
        linear = struct.unpack_from(f"<{n}Q", text, at + 4)
        at += 4 + 8 * n
        for start, end in wanted.get(name, ()):
            least = linear[min(start >> 14, n - 1)] if n else 0
            found += [(a, b) for k in _bins(start, end) & set(chunks) for a, b in chunks[k] if b > least]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.split = json.loads(options["paths"]), int(options.get("split", SPLIT))
        self.intervals = [tuple(x) for x in json.loads(options.get("intervals", "null"))] if options.get("intervals") else None

    def partitions(self):
        out = []
        for path in self.paths:
            fs, root = filesystem(path)
            size = fs.get_file_info(root).size
            with fs.open_input_file(root) as raw:
                blocked = block_size(raw.read(64)) is not None
            there = fs.get_file_info(f"{root}.tbi").is_file if blocked and self.intervals is not None else False
            if not blocked:
                out.append(Stretch(path, 0, size, 0, None, False))
            elif there:
                with fs.open_input_file(f"{root}.tbi") as f:
                    found = indexed(f.read(), self.intervals)
                out.append(Stretch(path, 0, size, 0, None, head=True))
                for a, b in found:
                    out += self._cut(path, a >> 16, b >> 16, a & 0xFFFF, b & 0xFFFF)
            else:
                out += self._cut(path, 0, size, 0, None)
        return out or [Stretch("", 0, 0, None, None)]

    def _cut(self, path: str, start: int, end: int, skip: int | None, stop: int | None) -> list[Stretch]:
        edges = [*range(start, max(end, start + 1), self.split), end]
        last = len(edges) - 2
        return [Stretch(path, a, b, skip if k == 0 else None, stop if k == last else None) for k, (a, b) in enumerate(zip(edges, edges[1:]))]

    def read(self, part: Stretch):
        if not part.path:
            return
        fs, root = filesystem(part.path)
        with fs.open_input_file(root) as raw:
            yield from _batches(_text(raw, part, fs.get_file_info(root).size), part.head)


def _text(raw, part: Stretch, size: int) -> Iterator[bytes]:
    """Pieces of the text of a stretch, from the first line that begins in it to the end of the last one."""
    if not part.blocked:
        inflate = zlib.decompressobj(31)
        while data := raw.read(1 << 20):
            while data:
                yield inflate.decompress(data)
                data = inflate.unused_data
                inflate = zlib.decompressobj(31) if inflate.eof else inflate
        return
    start = part.start if part.skip is not None else first_block(raw, part.start, size)
    begun = part.skip is not None
    for at, text in blocks(raw, start, size):
        if at == start and part.skip:
            text = text[part.skip :]
        if part.stop is not None and at >= part.end:
            if at == part.end:
                yield text[: part.stop - (part.skip or 0 if at == start else 0)]
            return
        if part.stop is None and at >= part.end:  # to the end of the line that is open, or of the one that begins here
            if not begun:
                return
            cut = text.find(b"\n")
            yield text if cut < 0 else text[: cut + 1]
            if cut >= 0:
                return
            continue
        if not begun:
            cut = text.find(b"\n")
            if cut < 0:
                continue
            begun, text = True, text[cut + 1 :]
        yield text


def _batches(pieces: Iterator[bytes], head: bool = False) -> Iterator[pa.RecordBatch]:
    open_, rows, size = [], [], 0
    for piece in pieces:
        if b"\n" not in piece:  # a line of many blocks is put together once
            open_.append(piece)
            continue
        *whole, rest = b"".join([*open_, piece]).split(b"\n")
        open_ = [rest]
        if head and (past := next((k for k, line in enumerate(whole) if not line.startswith(b"#")), None)) is not None:
            rows, open_ = rows + whole[:past], []
            break
        rows += whole
        size += len(piece)
        if size >= BATCH and rows:
            yield _batch(rows)
            rows, size = [], 0
    if last := b"".join(open_):
        rows.append(last)
    if rows:
        yield _batch(rows)


def _batch(rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.removesuffix(b"\r").decode("utf-8", "replace") for r in rows], pa.string())], names=["value"])


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))


def read_lines(spark: SparkSession, paths: list[str], intervals: list[tuple[str, int, int]] | None = None, split: int = SPLIT) -> DataFrame:
    """value: the lines of gzip files, block-gzip ones by stretches of `split` compressed bytes.

    intervals: (contig, first, last) that have to be there; where a file has an index, stretches without them are not read,
    the header lines are."""
    spark.dataSource.register(LinesSource)
    reader = spark.read.format("bgzf_lines").option("paths", json.dumps(paths)).option("split", split)
    return (reader if intervals is None else reader.option("intervals", json.dumps(intervals))).load()
