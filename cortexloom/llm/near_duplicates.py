"""Near-duplicate classes by DartMinHash signatures and banded joins.

A text is a weighted set: its runs of five words, weighted by how often they occur.  Each unit of
weight of each run is a strip along a rank axis into which darts are thrown at hashed places, at
one dart per unit of rank on average (arrival times of a Poisson process that depend only on the
run and the unit).  Of each text only darts below a rank are looked at that gives about k ln k + 2k
of them; each falls in one of k coordinates, and the earliest dart of a coordinate is the
signature's value there; where a coordinate has none, the rank is doubled.  Two texts agree in a
coordinate with a probability that equals their weighted Jaccard similarity.

Bands of the signature are joined.  Equal texts are one node.  In a bucket of a band, every node is
paired with the smallest one only, and the pairs are checked exactly on the whole texts; connected
nodes become classes.  Then the nodes of a bucket that aren't in the class of its smallest node are
compared with all nodes there of other classes, in tiles, with exact intersections by matrix
products.  So no link between classes is lost that the bands have found, a bucket of many similar
texts costs as many pairs as it has members, and no list of all pairs is ever made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, mapped, materialize, mix, slices, text_buffer, window_hashes, word_hashes, words
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5  # a pair at the threshold is missed with probability (1 - 0.8**5)**30 = 7e-6
SKETCH_LONGS = 3
SLICE_BYTES = 1 << 20
#: Nodes, and runs of words, in a tile of a bucket that holds several classes: on average, one node at least.
TILE, TILE_WEIGHT = 256, 200_000
#: Parts that the rows of one text are dealt to, however many they are.
SALTS = 256
_UNIT, _DART, _PLACE, _TIME = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def unit_elements(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per unit of weight of all texts: index of the text and 64-bit hash; per text two hashes of all its words."""
    data, offsets = text_buffer(texts)
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    at, runs = window_hashes(hashes, first, size)
    doc = np.searchsorted(first, at, "right") - 1
    n = np.diff(first)
    whole = []
    for seed in (np.uint64(1), _UNIT):
        own = mix(hashes * seed + seed)
        place = np.arange(len(hashes)) - np.repeat(first[:-1], n)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(mix(own + place.astype(np.uint64) * _TIME), out=sums[1:])
        whole.append(mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)))
    short = np.flatnonzero((n > 0) & (n < size))
    doc, runs = np.concatenate([doc, short]), np.concatenate([runs, whole[0][short]])
    keys = runs ^ mix(doc.astype(np.uint64) + _PLACE)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    unit = (np.arange(len(keys)) - start).astype(np.uint64)
    return doc[order], mix(runs[order] + unit * _UNIT), *whole


def _waits(elements: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Exponential waits before dart i of each element."""
    u = mix((elements ^ _TIME) + i.astype(np.uint64) * _DART) >> np.uint64(11)
    return -np.log((u.astype(np.float64) + 0.5) * 2.0**-53)


def signatures(doc: np.ndarray, elements: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k: id of the earliest dart of each coordinate; rows of texts without elements are 0."""
    sig = np.zeros((n, k), np.uint64)
    weight = np.bincount(doc, minlength=n)
    low, high = np.zeros(n), (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    best = np.full(n * k, np.inf)
    i = np.zeros(len(elements), np.int64)
    rank = _waits(elements, i)
    todo = np.arange(len(elements))
    while len(todo):
        darts: list = []
        live = todo[rank[todo] < high[doc[todo]]]
        while len(live):
            dart = mix(elements[live] + i[live].astype(np.uint64) * _PLACE)
            darts.append((doc[live] * k + (mix(dart ^ _DART) % np.uint64(k)).astype(np.int64), rank[live], dart))
            i[live] += 1
            rank[live] += _waits(elements[live], i[live])
            live = live[rank[live] < high[doc[live]]]
        if darts:
            cell, at, name = (np.concatenate(x) for x in zip(*darts))
            order = np.argsort(-at, kind="stable")  # the earliest is written last
            order = order[at[order] < best[cell[order]]]
            best[cell[order]] = at[order]
            sig.reshape(-1)[cell[order]] = name[order]
        open_ = np.isinf(best.reshape(n, k)).any(axis=1) & (weight > 0)
        low, high = high, np.where(open_, high * 2, 0)
        todo = np.flatnonzero(open_[doc])
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = mix(np.full(len(sig), b + 1, np.uint64))
        for r in range(rows):
            h = mix(h ^ sig[:, b * rows + r])
        out[:, b] = h
    return out


def sketch(sig: np.ndarray) -> np.ndarray:
    """A bit of each coordinate, in 64-bit words."""
    bits = np.zeros((len(sig), 64 * SKETCH_LONGS), np.uint8)
    k = min(sig.shape[1], bits.shape[1])
    bits[:, :k] = (sig[:, :k] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def most_different(k: int, threshold: float) -> int:
    """Sketch bits in which two texts at the threshold may differ: six standard deviations above the mean."""
    p = (1 - threshold) / 2
    return math.ceil(k * p + 6 * math.sqrt(k * p * (1 - p)))


def sign(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, h1, h2 (hashes of the whole word sequence), weight, keys (a long for each band), s0..s2, of texts with words."""
    k = bands * rows

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                doc, elements, h1, h2 = unit_elements(part.column("text"), size)
                n = part.num_rows
                weight = np.bincount(doc, minlength=n)
                some = np.flatnonzero(weight)
                sig = signatures(doc, elements, n, k)[some]
                s = sketch(sig)
                keys = band_keys(sig, bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(some)), pa.array(h1[some].view(np.int64)), pa.array(h2[some].view(np.int64)), pa.array(weight[some]), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())), *(pa.array(np.ascontiguousarray(s[:, c])) for c in range(SKETCH_LONGS))],
                    names=["doc_id", "h1", "h2", "weight", "keys", *(f"s{c}" for c in range(SKETCH_LONGS))],
                )

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, h1 long, h2 long, weight long, keys array<long>, " + ", ".join(f"s{c} long" for c in range(SKETCH_LONGS)))


def _similar(texts: DataFrame, pairs: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) whose texts have at least the weighted Jaccard similarity."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a", SLICE_BYTES):
                n = part.num_rows
                keys, weights = [], []
                for side in ("text_a", "text_b"):
                    doc, e, *_ = unit_elements(part.column(side), size)
                    weights.append(np.bincount(doc, minlength=n))
                    keys.append((doc, e ^ mix(doc.astype(np.uint64) + _DART)))
                common = np.isin(keys[0][1], keys[1][1])
                shared = np.bincount(keys[0][0][common], minlength=n)
                union = weights[0] + weights[1] - shared
                good = pa.array((union > 0) & (shared >= threshold * union - 1e-9))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], names=["a", "b"])

    one = texts.select(F.col("doc_id").alias("_ia"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("_ib"), F.col("text").alias("text_b"))
    # the second text goes to the first: pairs (member, hub) then carry the member's text once and meet a hub's in a join that can be split
    return mapped(pairs.join(two, F.col("b") == F.col("_ib")).join(one, F.col("a") == F.col("_ia")).select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _mixed_links(placed: DataFrame, sizes: DataFrame, known: DataFrame, texts: DataFrame, threshold: float, limit: int, size: int) -> DataFrame:
    """Links (a, b) that join the classes of buckets which hold several.

    The nodes outside the class of a bucket's smallest node are cut into tiles, and so are all its
    nodes; each pair of tiles is one unit of work of at most 2 * TILE texts.  It compares all pairs
    of nodes of different classes exactly, by products of its incidence matrices, and returns a
    spanning forest of the links it finds, so that no list of all pairs exists anywhere.
    """
    mixed = placed.join(sizes, F.col("key") == F.col("_key")).select("key", "id", "class", "hub_class", "_l", "_r")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = mixed.where("class <> hub_class").select("key", "id", "class", own("_l").alias("l"), every("_r").alias("r"), F.lit(0).alias("side"))
    right = mixed.select("key", "id", "class", every("_l").alias("l"), own("_r").alias("r"), F.lit(1).alias("side"))
    nodes = known.join(texts.select(F.col("doc_id").alias("_t"), "text"), F.col("doc_id") == F.col("_t")).drop("_t")
    rows = left.unionAll(right).join(nodes, F.col("id") == F.col("doc_id")).drop("doc_id")
    tiles = rows.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            edges = _edges(table)
            if len(edges) > 1:  # the last tile may go on in the next batch
                yield from _tile_links(table.slice(0, edges[-1]), edges, threshold, limit, size)
            rest = table.slice(edges[-1]).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from _tile_links(rest, np.array([0, rest.num_rows]), threshold, limit, size)

    return mapped(tiles, run, "a long, b long").distinct()


def _edges(table: pa.Table) -> np.ndarray:
    """Rows at which a tile begins."""
    new = np.zeros(table.num_rows, bool)
    for c in ("key", "l", "r"):
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(0, np.flatnonzero(new)) if table.num_rows else np.zeros(1, np.int64)


def _tile_links(table: pa.Table, edges: np.ndarray, threshold: float, limit: int, size: int):
    ids, classes, side, weight = (table.column(c).to_numpy() for c in ("id", "class", "side", "weight"))
    bits = np.column_stack([table.column(f"s{c}").to_numpy() for c in range(SKETCH_LONGS)]).view(np.uint64)
    parts, base, counts = [], 0, []
    for part in table.combine_chunks().to_batches():
        for piece in slices(part, "text", SLICE_BYTES):
            doc, e, *_ = unit_elements(piece.column("text"), size)
            order = np.argsort(doc, kind="stable")
            parts.append(e[order])
            counts.append(np.bincount(doc, minlength=piece.num_rows))
            base += piece.num_rows
    elements, counts = np.concatenate(parts), np.concatenate(counts)
    at = np.concatenate([[0], np.cumsum(counts)])
    found: list = []
    for lo, hi in zip(edges, np.append(edges[1:], table.num_rows)):
        if lo >= table.num_rows:
            break
        one, two = (np.arange(lo, hi)[side[lo:hi] == k] for k in (0, 1))
        may = classes[one][:, None] != classes[two][None, :]
        may &= np.minimum(weight[one][:, None], weight[two][None, :]) >= threshold * np.maximum(weight[one][:, None], weight[two][None, :])
        may &= np.bitwise_count(bits[one][:, None, :] ^ bits[two][None, :, :]).sum(axis=2) <= limit
        one, two, may = one[may.any(axis=1)], two[may.any(axis=0)], may[may.any(axis=1)][:, may.any(axis=0)]
        if not len(one):
            continue
        common = _intersections(elements, at, one, two)
        union = counts[one][:, None] + counts[two][None, :] - common
        i, j = np.nonzero(may & (common >= threshold * union - 1e-9))
        parent: dict = {}
        for a, b in zip(ids[one[i]].tolist(), ids[two[j]].tolist()):
            ra, rb = _root(parent, a), _root(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                found.append((min(a, b), max(a, b)))
    if found:
        a, b = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _root(parent: dict, x: int) -> int:
    while x in parent:
        x = parent[x]
    return x


def _intersections(elements: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Common elements of each of `one` with each of `two`: incidence matrices over the elements both sides have."""
    sides = []
    for rows in (one, two):
        n = at[rows + 1] - at[rows]
        sides.append((np.concatenate([elements[at[r] : at[r + 1]] for r in rows]), np.repeat(np.arange(len(rows)), n)))
    both = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(one), len(two)), np.float32)
    coded = []
    for values, row in sides:
        spot = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        hit = both[spot] == values if len(both) else np.zeros(len(values), bool)
        coded.append((spot[hit], row[hit]))
    for lo in range(0, len(both), columns):
        m = []
        for (spot, row), n in zip(coded, (len(one), len(two))):
            here = (spot >= lo) & (spot < lo + columns)
            dense = np.zeros((n, min(columns, len(both) - lo)), np.float32)
            dense[row[here], spot[here] - lo] = 1
            m.append(dense)
        out += m[0] @ m[1].T
    return out


def _nodes(signed: DataFrame) -> DataFrame:
    """doc_id, node (the smallest id with the same words) of all rows.

    Rows of one text are counted in SALTS parts, the parts meet, and the rows go to their part's
    result, so that no task gets all rows of a text that very many documents share."""
    rows = signed.select("doc_id", "h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    parts = rows.groupBy("h1", "h2", "_salt").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_last"))
    several = parts.groupBy("h1", "h2").agg(F.min("_least").alias("_node"), F.max("_last").alias("_end")).where("_node < _end").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "_node")
    known = parts.join(several, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("_h1", "_h2", F.col("_salt").alias("_part"), "_node")
    mine = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("_salt") == F.col("_part"))
    return rows.join(known, mine, "left").select("doc_id", F.coalesce("_node", "doc_id").alias("node"))


def links_and_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(member, root) of nodes in classes of several nodes, and (doc_id, node) of all texts with words."""
    signed = materialize(sign(docs, bands, rows, size))
    membership = materialize(_nodes(signed))
    own = membership.where("doc_id = node").select(F.col("node").alias("_node")).distinct()
    entries = signed.join(own, F.col("doc_id") == F.col("_node"), "left_semi").select(F.col("doc_id").alias("id"), "weight", F.explode("keys").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("_last")).where("hub < _last").select(F.col("key").alias("_key"), "hub")
    shared = materialize(entries.join(hubs, F.col("key") == F.col("_key")).select("key", "id", "weight", "hub"))
    sketches = signed.select("doc_id", "weight", *[f"s{c}" for c in range(SKETCH_LONGS)])
    involved = shared.select("id").distinct()
    texts = materialize(docs.select("doc_id", "text").join(involved, F.col("doc_id") == F.col("id"), "left_semi"))
    known = materialize(sketches.join(involved, F.col("doc_id") == F.col("id"), "left_semi"))
    limit = most_different(bands * rows, threshold)

    def side(name: str) -> DataFrame:
        return known.select(F.col("doc_id").alias(f"_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in known.columns if c != "doc_id"])

    def may(x: str, y: str):
        differ = sum((F.bit_count(F.col(f"{x}_s{c}").bitwiseXOR(F.col(f"{y}_s{c}"))) for c in range(SKETCH_LONGS)), F.lit(0))
        lengths = F.least(f"{x}_weight", f"{y}_weight") >= F.lit(threshold) * F.greatest(f"{x}_weight", f"{y}_weight")
        return lengths & (differ <= limit)

    first = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = first.join(side("b"), F.col("b") == F.col("_b")).join(side("a"), F.col("a") == F.col("_a")).where(may("a", "b")).select("a", "b")
    links = materialize(_similar(texts, first, threshold, size))
    rooted = components(links)

    # Nodes that aren't in the class of their bucket's smallest node, against those of other classes there.
    root_of = lambda frame, column, name: frame.join(rooted.select(F.col("member").alias(f"_m{name}"), F.col("root").alias(name)), F.col(column) == F.col(f"_m{name}"), "left").withColumn(name, F.coalesce(name, column)).drop(f"_m{name}")
    placed = materialize(root_of(root_of(shared, "id", "class"), "hub", "hub_class"))
    other = F.col("class") != F.col("hub_class")
    sizes = placed.groupBy("key").agg(F.count("*").alias("_n"), F.sum("weight").alias("_w"), F.count_if(other).alias("_no"), F.sum(F.when(other, F.col("weight"))).alias("_wo")).where("_no > 0")
    tiles = lambda n, w: F.greatest(F.ceil(F.col(n) / TILE), F.ceil(F.col(w) / TILE_WEIGHT))
    sizes = sizes.select(F.col("key").alias("_key"), tiles("_no", "_wo").alias("_l"), tiles("_n", "_w").alias("_r"))
    more = materialize(_mixed_links(placed, sizes, known, texts, threshold, limit, size))
    if more.limit(1).count():
        rooted = components(rooted.select(F.col("root").alias("a"), F.col("member").alias("b")).unionAll(more.select("a", "b")))
    return rooted, membership


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id for each row of docs: the smallest id of the document's class.

    A class is a connected component of links between texts whose weighted Jaccard similarity over
    runs of `size` words is at least `threshold`; texts with the same words are in one class.  A
    text with fewer than `size` words is one run.  A text that is null or has no words, and a row
    with a null id, is a class of its own.  Rows that repeat an id are in one class with each other.
    """
    texts = ids_and_texts(docs, id_col, text_col)
    rooted, membership = links_and_classes(texts.where("doc_id is not null and text is not null"), threshold, bands, rows, size)
    moved = membership.join(rooted, F.col("node") == F.col("member"), "left").select(F.col("doc_id").alias("_id"), F.coalesce("root", "node").alias("class_id")).where("_id <> class_id").groupBy("_id").agg(F.min("class_id").alias("class_id"))
    return texts.select("doc_id").join(moved, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
