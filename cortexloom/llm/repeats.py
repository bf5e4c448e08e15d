"""Substring dedup over words: windows of suffixes, partitioned by prefixes, grouped by their hash.

A suffix is a text from one of its words on.  Suffixes are split by variable-length prefixes: by
their first word, and where that many suffixes share it that they would not fit in memory, by their
first 2, 4, 8 or `window` words; one pass counts hash buckets of these prefixes, and groups of
prefixes are packed into shards of bounded size.  A shard builds no tree: it sorts its suffixes by
the hash of their first `window` words, and equal neighbours are what would be the leaves below one
node of that depth.  Such a group with several documents is a repeat; it is maximal when the windows
that follow each other in a document are joined into spans.

What can't repeat is left out early: each window has an anchor, the smallest hash among the runs of
HALF words in it.  Equal windows have equal anchors, so only windows whose anchor occurs in several
documents enter the shards.  Before anything is shuffled, a task keeps of each window or anchor only
the occurrences of its smallest document; the others are decided on the spot.  Shuffled rows are
packed: one for each task and shard, with arrays of hashes and places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mix, run_hashes, slices, text_buffer, window_hashes, word_hashes, words

WINDOW = 13
LEVELS = (1, 2, 4, 8)
BITS = 12
#: Suffixes in a shard: as many as give up to FEW shards, at most MOST.
LEAST, MOST, FEW = 25_000, 2_000_000, 512
SLICE_BYTES, TASK_WINDOWS = 1 << 20, 1_500_000
SCHEMA = "shard int, kind int, docs binary, counts binary, places binary, hashes binary, checks binary"
_CHECK = np.uint64(0xA24BAED4963EE407)
_EMPTY = b""


class Hashed:
    """Words and windows of a slice of texts."""

    def __init__(self, texts: pa.Array, window: int):
        self.data, self.offsets = text_buffer(texts)
        self.starts, self.ends, self.first = words(self.data, self.offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.at, self.whole = window_hashes(self.hashes, self.first, window)
        self.doc = np.searchsorted(self.first, self.at, "right") - 1
        self.place = self.at - self.first[self.doc]

    def checks(self, window: int) -> np.ndarray:
        """32 further bits of each window's hash, so that different windows meet at no size of the corpus."""
        return (run_hashes(self.hashes ^ _CHECK, window)[self.at] >> np.uint64(32)).astype(np.uint32) if len(self.at) else np.zeros(0, np.uint32)

    def runs(self, size: int) -> np.ndarray:
        """Hash of the run of `size` words at the start of each window."""
        got = np.zeros(len(self.hashes), np.uint64)
        at, h = window_hashes(self.hashes, np.array([0, len(self.hashes)]), size)
        got[at] = h
        return got

    def anchors(self, window: int) -> np.ndarray:
        half = window // 2 + 1
        got = self.runs(half)
        n = len(got)
        low = got.copy()
        for k in range(1, window - half + 1):
            low[: n - k] = np.minimum(low[: n - k], got[k:])
        return low[self.at]


def _count_prefixes(docs: DataFrame, window: int) -> dict[int, np.ndarray]:
    """Suffixes by hash bucket of their first words, for each level."""
    levels = [*(n for n in LEVELS if n < window), window]

    def run(batches):
        total = np.zeros((len(levels), 1 << BITS), np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h = Hashed(part.column("text"), window)
                for k, n in enumerate(levels):
                    total[k] += np.bincount((h.whole if n == window else h.runs(n)[h.at]) >> np.uint64(64 - BITS), minlength=1 << BITS)
        level, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[level, bucket])], names=["level", "bucket", "n"])

    got = mapped(docs.select("doc_id", "text"), run, "level int, bucket int, n long").groupBy("level", "bucket").agg(F.sum("n").alias("n")).collect()  # len(levels) * 4096 rows at most
    out = {n: np.zeros(1 << BITS, np.int64) for n in levels}
    for r in got:
        out[levels[r["level"]]][r["bucket"]] = r["n"]
    return out


class Shards:
    """Which shard a suffix belongs to, from the counts of prefixes."""

    def __init__(self, counts: dict[int, np.ndarray]):
        self.levels = list(counts)
        total = int(counts[self.levels[-1]].sum())
        self.n = max(1, min(FEW, -(-total // LEAST)), -(-total // MOST))
        self.limit = max(1, total // self.n)
        self.deep = {n: counts[n] > self.limit for n in self.levels[:-1]}  # go on to longer prefixes
        sizes, self.of = [], {}
        for n in self.levels:
            sizes += [(int(c), n, b) for b, c in enumerate(counts[n]) if c and not (n in self.deep and self.deep[n][b])]
            self.of[n] = np.zeros(1 << BITS, np.int32)
        load = [(0, s) for s in range(self.n)]
        import heapq

        heapq.heapify(load)
        for c, n, b in sorted(sizes, reverse=True):  # largest first into the least loaded
            have, s = heapq.heappop(load)
            self.of[n][b] = s
            heapq.heappush(load, (have + c, s))
        #: A bucket of whole windows beyond the limit is split by further bits of its hash; equal windows stay together.
        self.parts = np.minimum(-(-counts[self.levels[-1]] // self.limit), self.n).astype(np.int64)

    def __call__(self, h: Hashed) -> np.ndarray:
        shift = np.uint64(64 - BITS)
        out, open_ = np.zeros(len(h.at), np.int32), np.ones(len(h.at), bool)
        for n in self.levels[:-1]:
            b = (h.runs(n)[h.at] >> shift).astype(np.int64)
            now = open_ & ~self.deep[n][b]
            out[now] = self.of[n][b[now]]
            open_ &= self.deep[n][b]
        if open_.any():
            b = (h.whole[open_] >> shift).astype(np.int64)
            more = (mix(h.whole[open_]) % np.maximum(self.parts[b], 1).astype(np.uint64)).astype(np.int64)
            out[open_] = (self.of[self.levels[-1]][b] + more) % self.n
        return out


class _Entries:
    """(hash, its further bits, document, place) of windows gathered in a task, packed by shard."""

    def __init__(self):
        self.parts: list = []
        self.n = 0

    def add(self, shard, hashes, checks, docs, places) -> None:
        self.parts.append((shard.astype(np.int32), hashes, checks, docs, places.astype(np.int32)))
        self.n += len(hashes)

    def packed(self, shards: int, blocks: int):
        """Rows of kind 0, entries for the trees, and of kind 1, places decided here: an entry of a
        document that isn't the smallest with its hash in this task."""
        if not self.n:
            return []
        shard, hashes, checks, docs, places = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.n = [], 0
        later = docs > smallest_docs(hashes, docs, checks)
        rows = pack(0, shard[~later], hashes[~later], docs[~later], places[~later], checks[~later])
        if later.any():
            rows += pack(1, block_of(docs[later], blocks), None, docs[later], places[later])
        return rows


def smallest_docs(hashes: np.ndarray, docs: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
    """For each entry the smallest document with its hash, and with its further bits if they are given."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    if checks is not None and (~new[1:] & (checks[order[1:]] != checks[order[:-1]])).any():  # one hash, different windows
        order = np.lexsort((checks, hashes))
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
    at = np.flatnonzero(new)
    low = np.minimum.reduceat(docs[order], at) if len(at) else docs[:0]
    out = np.empty(len(docs), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(at, len(order))))
    return out


def largest_docs(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return -smallest_docs(hashes, -docs)


def block_of(docs: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(docs.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)


def pack(kind: int, shard: np.ndarray, hashes: np.ndarray | None, docs: np.ndarray, places: np.ndarray | None, checks: np.ndarray | None = None) -> list[dict]:
    """A row for each shard: its documents, entries of each, and the entries in the order of documents and places."""
    order = np.lexsort((docs, shard)) if places is None else np.lexsort((places, docs, shard))
    shard, docs = shard[order], docs[order]
    hashes, places, checks = (None if x is None else x[order] for x in (hashes, places, checks))
    edges = np.append(np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)), len(shard))
    rows = []
    for a, b in zip(edges[:-1], edges[1:]):
        at = np.flatnonzero(np.diff(docs[a:b], prepend=docs[a] - 1))
        counts = np.diff(np.append(at, b - a)).astype(np.int32)
        own = docs[a:b][at]
        rows.append({
            "shard": int(shard[a]), "kind": kind, "docs": np.diff(own, prepend=np.int64(0)).tobytes(), "counts": counts.tobytes(),
            "places": _EMPTY if places is None else np.diff(places[a:b], prepend=np.int32(0)).astype(np.int32).tobytes(), "hashes": _EMPTY if hashes is None else hashes[a:b].tobytes(),
            "checks": _EMPTY if checks is None else checks[a:b].tobytes(),
        })
    return rows


def unpack(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, places and hashes of the entries of all rows (places or hashes that weren't packed: zeros)."""
    docs, places, hashes = [], [], []
    for r in rows:
        d = np.repeat(np.cumsum(np.frombuffer(r["docs"], np.int64)), np.frombuffer(r["counts"], np.int32))
        docs.append(d)
        places.append(np.cumsum(np.frombuffer(r["places"], np.int32), dtype=np.int64) if r["places"] else np.zeros(len(d), np.int64))
        hashes.append(np.frombuffer(r["hashes"], np.uint64) if r["hashes"] else np.zeros(len(d), np.uint64))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)


_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("hashes", pa.binary()), ("checks", pa.binary())])


def _batches(rows: list[dict]):
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_pylist(rows[i : i + 64], schema=_ARROW)


def _repeated_anchors(docs: DataFrame, window: int, shards: int) -> DataFrame:
    """doc_id, anchors (binary: sorted low halves of the anchors that other documents have too)."""

    def send(batches):
        parts, held = [], 0

        def flush():
            h, d = (np.concatenate(x) for x in zip(*parts))
            low, high = smallest_docs(h, d), largest_docs(h, d)
            one = d == low
            order = np.lexsort((d[one], h[one]))  # one entry for each hash goes on
            h1, d1 = h[one][order], d[one][order]
            new = np.ones(len(h1), bool)
            new[1:] = h1[1:] != h1[:-1]
            # kind 0: (hash, a document of this task); kind 2: the same, of a hash that has several documents here
            several = (low != high)[one][order]
            rows = []
            for kind, keep in ((0, new & ~several), (2, new & several)):
                if keep.any():
                    rows += pack(kind, (h1[keep] % np.uint64(shards)).astype(np.int32), h1[keep], d1[keep], None)
            mine = low != high  # known here, for all their documents
            if mine.any():
                rows += pack(1, block_of(d[mine], shards), h[mine], d[mine], None)
            parts.clear()
            return rows

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                hashed = Hashed(part.column("text"), window)
                if not len(hashed.at):
                    continue
                a = hashed.anchors(window)
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (hashed.doc[1:] != hashed.doc[:-1])
                parts.append((a[new], part.column("doc_id").to_numpy(zero_copy_only=False)[hashed.doc[new]]))
                held += int(new.sum())
                if held >= TASK_WINDOWS:
                    yield from _batches(flush())
                    held = 0
        if parts:
            yield from _batches(flush())

    def decide(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs_, _, hashes = unpack([r for r in rows if r["kind"] != 1])
        known = np.concatenate([np.full(len(r["hashes"]) // 8, r["kind"] == 2) for r in rows if r["kind"] != 1] or [np.zeros(0, bool)])
        out = [r for r in rows if r["kind"] == 1]
        if len(hashes):
            repeated = (smallest_docs(hashes, docs_) != largest_docs(hashes, docs_)) | (smallest_docs(hashes, (~known).astype(np.int64)) == 0)
            if repeated.any():
                out += pack(1, block_of(docs_[repeated], shards), hashes[repeated], docs_[repeated], None)
        return pa.Table.from_pylist(out, schema=_ARROW)

    def collect(table: pa.Table) -> pa.Table:
        d, _, h = unpack(table.to_pylist())
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((low, d))
        d, low = d[order], low[order]
        at = np.flatnonzero(np.diff(d, prepend=d[:1] - 1)) if len(d) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(d))
        return pa.table({"doc_id": pa.array(d[at]), "anchors": pa.array([np.unique(low[a:b]).tobytes() for a, b in zip(at, ends)], pa.binary())})

    sent = mapped(docs.select("doc_id", "text"), send, SCHEMA)
    decided = sent.groupBy("shard").applyInArrow(decide, SCHEMA)
    return decided.groupBy("shard").applyInArrow(collect, "doc_id long, anchors binary")


def _covered(docs: DataFrame, window: int, shards: Shards) -> DataFrame:
    """doc_id, windows (binary: sorted places, in words, of the windows that a smaller document has too)."""

    def send(batches):
        held = _Entries()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                if part.column("anchors").null_count == part.num_rows:
                    continue
                h = Hashed(part.column("text"), window)
                if not len(h.at):
                    continue
                flags = part.column("anchors").to_pylist()  # null: nothing of this text repeats
                known = [np.frombuffer(f, np.uint32).astype(np.uint64) | (np.uint64(i) << np.uint64(32)) for i, f in enumerate(flags) if f]
                known = np.concatenate(known) if known else np.zeros(0, np.uint64)
                keys = (h.anchors(window) & np.uint64(0xFFFFFFFF)) | (h.doc.astype(np.uint64) << np.uint64(32))
                spot = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                keep = known[spot] == keys if len(known) else np.zeros(len(keys), bool)
                if keep.any():
                    held.add(shards(h)[keep], h.whole[keep], h.checks(window)[keep], part.column("doc_id").to_numpy(zero_copy_only=False)[h.doc[keep]], h.place[keep])
                if held.n >= TASK_WINDOWS:
                    yield from _batches(held.packed(shards.n, shards.n))
        yield from _batches(held.packed(shards.n, shards.n))

    def trees(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        entries = [r for r in rows if r["kind"] == 0]
        d, p, h = unpack(entries)
        out = [r for r in rows if r["kind"] == 1]
        if len(d):
            later = d > smallest_docs(h, d, np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in entries]))
            if later.any():
                out += pack(1, block_of(d[later], shards.n), None, d[later], p[later])
        return pa.Table.from_pylist(out, schema=_ARROW)

    def collect(table: pa.Table) -> pa.Table:
        d, p, _ = unpack(table.to_pylist())
        order = np.lexsort((p, d))
        d, p = d[order], p[order].astype(np.int32)
        at = np.flatnonzero(np.diff(d, prepend=d[:1] - 1)) if len(d) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(d))
        return pa.table({"doc_id": pa.array(d[at]), "windows": pa.array([p[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())})

    sent = mapped(docs, send, SCHEMA)
    decided = sent.groupBy("shard").applyInArrow(trees, SCHEMA)
    return decided.groupBy("shard").applyInArrow(collect, "doc_id long, windows binary")


def _keep(text: str | None, windows: bytes | None, size: int) -> tuple[str, int, int, list]:
    """Kept words joined by a space, words, words removed, spans removed (in words)."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    spans: list = []
    gone = np.zeros(len(starts) + 1, np.int32)
    if windows:
        places = np.unique(np.frombuffer(windows, np.int32))
        places = places[places + size <= len(starts)]  # of a longer row with the same id
        np.add.at(gone, places, 1)
        np.add.at(gone, places + size, -1)
        away = np.cumsum(gone[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], away, [False]]).astype(np.int8)))
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
    keep = np.ones(len(starts), bool)
    for s in spans:
        keep[s["start"] : s["end"]] = False
    raw = data.tobytes()
    kept = b" ".join(raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist()))
    return kept.decode("utf-8", "surrogatepass"), len(starts), len(starts) - int(keep.sum()), spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, kept, n_words, n_removed, spans (array of struct start, end in words): one row for each row of docs.

    carry: columns of docs, the text if it is named too, that come along as a struct column `row`.

    Words are what lies between the characters space and 0x09 to 0x0D, unchanged.  Each word is
    removed that lies in a window of `window` consecutive words whose sequence also starts in a
    document with a smaller id; all windows are judged on the input.  kept: the other words joined
    by one space.  A null text has no words.  Rows that repeat an id count as one document as to
    what repeats; each gets the spans of all of them that lie within its words, so ids should be
    unique.  Rows with a null id are kept whole.  Windows are compared by 96 bits of hash of their words.
    """
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    named = rows.where("doc_id is not null and text is not null")
    counts = _count_prefixes(named, window)
    shards = Shards(counts)
    anchors = _repeated_anchors(named, window, shards.n)
    # Both joins below shuffle the same columns of the same rows, so that Spark writes the texts once.
    covered = _covered(rows.join(anchors, "doc_id", "left"), window, shards)

    def finish(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                got = [_keep(t, w, window) for t, w in zip(part.column("text").to_pylist(), part.column("windows").to_pylist())]
                kept, n, gone, spans = (list(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), *([part.column("row")] if carry else [])],
                    names=["doc_id", "kept", "n_words", "n_removed", "spans", *(["row"] if carry else [])],
                )

    out = "doc_id long, kept string, n_words long, n_removed long, spans array<struct<start:int,end:int>>"
    if carry:
        out += f", row {rows.schema['row'].dataType.simpleString()}"
    return mapped(rows.join(covered, "doc_id", "left"), finish, out)
