"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are numbered by a hash and cut into blocks.  In the ideal mix all sources
run side by side, each at its share of the weights; when one runs out, the rest scale up.  Block j
of a source has release time floor(a) and deadline ceil(b) if it runs from a to b in the ideal mix;
one block goes in each slot, the released one with the earliest deadline.  Then after any number of
slots each source has had less than one block more or less than in the ideal mix.

Weights count exactly, as fractions: with integers p in proportion to them, a source of n blocks
runs out at v = n / p, and at v the mix has T(v) = P v + D slots, P the sum of p of the sources that
still run and D the blocks of those that have run out.  What the driver holds: a count for each
source and a number for each block.
"""

from __future__ import annotations

import bisect
import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a source whose slots make a row of the table of slots.
PERIOD = 1024
BLOCK_ROWS = 64
#: Rows numbered together; buckets are by hash, so a source of any size is spread.
BUCKET_ROWS = 512


def turns(blocks: dict, weights: dict) -> list:
    """The source of each slot until all blocks are placed: earliest deadline first among the released blocks, ties by name."""
    exact = {s: Fraction(weights[s]) for s, n in blocks.items() if n > 0}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights have to be positive")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    rate = {s: int(w * scale) for s, w in exact.items()}
    ends, slope, base = [], [sum(rate.values())], [0]  # T in pieces: piece k up to v = ends[k]
    for end, s in sorted((Fraction(blocks[s], p), s) for s, p in rate.items()):
        if ends and ends[-1] == end:
            slope[-1], base[-1] = slope[-1] - rate[s], base[-1] + blocks[s]
        else:
            ends.append(end)
            slope.append(slope[-1] - rate[s])
            base.append(base[-1] + blocks[s])
    tops = [(e.numerator, e.denominator) for e in ends]
    piece = dict.fromkeys(rate, 0)

    def at(s, j: int) -> tuple[int, int]:
        """T(j / p) rounded down and up."""
        p, k = rate[s], piece[s]
        if j * tops[k][1] > tops[k][0] * p:
            k = piece[s] = bisect.bisect_left(ends, Fraction(j, p), k)
        down, rest = divmod(slope[k] * j, p)
        return base[k] + down, base[k] + down + (rest > 0)

    waiting = [(0, str(s), s, 0) for s in rate]  # by release time
    heapq.heapify(waiting)
    ready: list = []  # by deadline
    out = []
    for slot in range(sum(blocks[s] for s in rate)):
        while waiting and waiting[0][0] <= slot:
            _, name, s, j = heapq.heappop(waiting)
            released, deadline = at(s, j + 1)
            heapq.heappush(ready, (deadline, name, s, j, released))
        if not ready:
            raise AssertionError("no block is released")
        deadline, name, s, j, released = heapq.heappop(ready)
        if deadline < slot + 1:
            raise AssertionError("a deadline is missed")
        out.append(s)
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (released, name, s, j + 1))
    return out


def plan(blocks: dict, weights: dict) -> list[tuple]:
    """One phase (first slot, slots, source of each slot, blocks of each source before it) for all blocks, none if there are none."""
    order = turns(blocks, weights)
    return [(0, len(order), order, {s: 0 for s in blocks})] if order else []


def default_weights(rows: dict) -> dict:
    """Each source in proportion to the square root of its rows: large ones still lead, small ones come earlier."""
    return {s: math.sqrt(n) for s, n in rows.items()}


def schedule(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, block (of its source), slot (of the mix), place (in the block): one row for each row of docs.

    Sorted by (slot, place) the rows are the mix.  Every row is placed.  weights: target weight by
    source, positive; None: default_weights.  A null source is a source of its own, None in weights
    and null in the result; an empty name is another; a source missing in weights raises.  Any number of sources is placed.
    Rows that repeat an id are placed each.  An empty table gives no rows.  period: blocks of a source
    in a row of the table of slots; the result does not depend on it.
    """
    spark = docs.sparkSession
    named = F.concat(F.lit("="), F.col(source_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(named, F.lit("")).alias("source"))  # "": null
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    weights = {"" if s is None else f"={s}": w for s, w in weights.items()} if weights else default_weights(counts)
    if missing := sorted(set(counts) - set(weights)):
        raise ValueError(f"no weight for {[s[1:] or None for s in missing[:5]]}")
    order = turns({s: math.ceil(n / block_rows) for s, n in counts.items()}, weights) if counts else []
    buckets = spark.createDataFrame([(s, max(1, n // BUCKET_ROWS)) for s, n in counts.items()], "_source string, _buckets long")  # a row for each source
    hashed = rows.withColumn("_h", F.xxhash64("doc_id", F.lit(17))).join(F.broadcast(buckets), F.col("source") == F.col("_source")).select("doc_id", "source", "_h", F.pmod(F.xxhash64("_h"), F.col("_buckets")).alias("_bucket"))
    sizes = hashed.groupBy("source", "_bucket").agg(F.count("*").alias("_n"))
    # Offsets of the buckets: summed in groups of 4096 first, so that no window holds all buckets of a source.
    part = sizes.withColumn("_part", F.floor(F.col("_bucket") / 4096))
    inner = Window.partitionBy("source", "_part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = part.groupBy("source", "_part").agg(F.sum("_n").alias("_n")).select("source", "_part", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_base"))
    offsets = part.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(parts, ["source", "_part"]).select("source", "_bucket", (F.col("_before") + F.col("_base")).alias("_offset"))
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id")) - 1)
    placed = ranked.join(offsets, ["source", "_bucket"]).select("doc_id", "source", (F.col("_rank") + F.col("_offset")).alias("_at"))
    placed = placed.select("doc_id", "source", F.floor(F.col("_at") / block_rows).alias("block"), (F.col("_at") % block_rows).cast("int").alias("place"))
    return _slots(placed, order, period)


def _slots(placed: DataFrame, order: list, period: int) -> DataFrame:
    """Slot of each block, from the source of each slot: a row for each source and `period` of its blocks."""
    spots: dict = {}
    for slot, s in enumerate(order):
        spots.setdefault(s, []).append(slot)
    table = [(s, k, at[k * period : (k + 1) * period]) for s, at in spots.items() for k in range(-(-len(at) // period))]
    columns = [pa.array([r[i] for r in table], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))]
    frame = placed.sparkSession.createDataFrame(pa.Table.from_arrays(columns, ["_source", "_part", "_spots"]))
    hit = (F.col("source") == F.col("_source")) & (F.floor(F.col("block") / period) == F.col("_part"))
    slot = F.element_at("_spots", (F.col("block") % period).cast("int") + 1)
    source = F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source")
    return placed.join(F.broadcast(frame), hit).select("doc_id", source, "block", slot.cast("long").alias("slot"), "place")
