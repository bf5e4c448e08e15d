"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Everything is DataFrame functions.  Each shingle is hashed once; the high bits choose its bin, and
the smallest hash of each bin is kept.  To find these, one marker for each bin, larger than any hash
in it, is added, all are sorted, and the first of each bin is taken: then every bin is present, and
a bin that holds its marker is empty.  An empty bin takes the value of the first non-empty one in a
fixed random order of its own (optimal densification: a fresh draw for each bin, not its
neighbour's).  The low BITS of each bin are packed into a string of hex digits, and likeness is
corrected for the chance that low bits agree.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS, BINS, BITS = 5, 256, 8
#: Words are what lies between blanks and line ends.
BLANK = "[ \\t\\n\\x0B\\f\\r]+"
_LOW = 48  # bits of a hash below its bin
_MARK = (1 << _LOW) - 1
#: Documents in a range of ids, and the most ranges; see neighbours().
RANGE_ROWS, MOST_RANGES = 256, 16384


def shingle_hashes(text: Column, size: int = WORDS) -> Column:
    """Hashes of all runs of `size` words; of a shorter text its words as one run; of one without words none."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _runs(hashed, size)


def _runs(hashed: Column, size: int) -> Column:
    # the array is made once, in a one-element array that transform binds to a variable
    def over(h: Column) -> Column:
        n = F.size(h)
        run = lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(size)])
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), run)).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(hashed), over), 0)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, _LOW)


def smallest_of_bins(hashes: Column, bins: int = BINS) -> Column:
    """The smallest hash of each bin, in the order of bins; an empty bin has its marker."""
    bits = bins.bit_length() - 1
    own = F.transform(hashes, lambda h: F.shiftrightunsigned(h, 64 - _LOW - bits))
    marks = F.array(*[F.lit((b << _LOW) | _MARK) for b in range(bins)])

    def first(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1))))

    return F.get(F.transform(F.array(F.sort_array(F.concat(own, marks))), first), 0)


def _orders(bins: int, seed: int = 5) -> list[list[int]]:
    """For each bin the other bins in a random order of its own."""
    rng = random.Random(seed)
    return [rng.sample([b for b in range(bins) if b != k], bins - 1) for k in range(bins)]


def densified(smallest: Column, bins: int = BINS) -> Column:
    """Values of all bins, empty ones filled; if all are empty, all are -1."""
    orders = _orders(bins)
    ranks = [[o.index(b) if b in o else bins for b in range(bins)] for o in orders]
    table = lambda rows: F.from_json(F.lit(str(rows)), "array<array<int>>")  # noqa: E731  a literal, folded when planned
    heads, ranked = [table([o[:4] for o in orders]), table([o[4:16] for o in orders])], table(ranks)
    empty = lambda v: v.bitwiseAND(_MARK) == _MARK

    def fill(s: Column) -> Column:
        present = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda p: ~empty(F.get(s, p)))

        def over(held: Column) -> Column:
            def draw(v: Column, b: Column) -> Column:
                # the first few of the bin's order, then a few more, then the best-ranked of the bins present
                found = [F.get(F.filter(F.get(h, b), lambda p: ~empty(F.get(s, p))), 0) for h in heads]
                best = F.array_min(F.transform(held, lambda p: F.get(F.get(ranked, b), p) * bins + p)) % bins
                return F.when(~empty(v), v).otherwise(F.coalesce(F.get(s, found[0]), F.get(s, found[1]), F.get(s, best), F.lit(-1)))

            return F.transform(s, draw)

        return F.get(F.transform(F.array(present), over), 0)

    return F.get(F.transform(F.array(smallest), fill), 0)


def signature(text: Column, size: int = WORDS, bins: int = BINS, bits: int = BITS) -> Column:
    """The low bits of each bin (array of int); a text without words has -1 in all."""
    return F.transform(densified(smallest_of_bins(shingle_hashes(text, size), bins), bins), lambda v: F.when(v == -1, -1).otherwise(v.bitwiseAND((1 << bits) - 1)).cast("int"))


def packed(bins: Column, bits: int = BITS) -> Column:
    """Hex digits of the low bits; "" for a text without words."""
    digits = bits // 4
    return F.when(F.get(bins, 0) == -1, "").otherwise(F.array_join(F.transform(bins, lambda v: F.lpad(F.lower(F.hex(v)), digits, "0")), ""))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two signatures: agreeing bins, less those expected by chance; 1 if both texts lack words, 0 if one does."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-bits
    corrected = F.greatest(F.lit(0.0), (same / float(bins) - chance) / (1 - chance))
    none = lambda x: F.get(x, 0) == -1
    return F.when(none(a) & none(b), 1.0).when(none(a) | none(b), 0.0).otherwise(F.least(F.lit(1.0), corrected))


def _ranges(docs: DataFrame) -> list[int]:
    """Upper bounds, ids that exist, of ranges of about RANGE_ROWS rows: MOST_RANGES numbers at most."""
    n = docs.agg(F.count("doc_id")).first()[0]
    k = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = docs.agg(F.percentile_approx("doc_id", [(i + 1) / k for i in range(k)], max(10_000, 4 * k)), F.max("doc_id")).first() if n else ([], None)
    return sorted({*(bounds[0] or []), bounds[1]} - {None})


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows dealt to ranges of ids, for windows over (_range) by `order()` that see the next document too.

    The first row of each range is dealt to the range above it as well, as a guest at its end, and
    the very first row to the lowest range; guests are dropped by the caller.
    """
    bounds = _ranges(docs)
    aside = (-1 - F.pmod(F.monotonically_increasing_id(), F.lit(4096))).cast("int")  # rows without id, next to none
    if not bounds:
        return docs.select("doc_id", *columns, aside.alias("_range"), F.lit(False).alias("_guest"))
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    blocks = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    at = F.size(F.filter(coarse, lambda b: b < F.col("doc_id")))
    rank = at * step + F.size(F.filter(F.get(blocks, F.least(at, F.lit(-(-len(bounds) // step) - 1))), lambda b: b < F.col("doc_id")))
    edge = F.array_contains(F.get(blocks, at), F.col("doc_id"))
    here = F.struct(F.when(F.col("doc_id").isNull(), aside).otherwise(F.col("_at")).alias("r"), F.lit(False).alias("g"))
    above = F.struct(F.pmod(F.col("_at") + 1, F.lit(len(bounds))).alias("r"), F.lit(True).alias("g"))
    dealt = docs.select("doc_id", *columns, rank.alias("_at"), edge.alias("_edge")).select("doc_id", *columns, F.explode(F.when(F.col("_edge"), F.array(here, above)).otherwise(F.array(here))).alias("_to"))
    return dealt.select("doc_id", *columns, F.col("_to.r").alias("_range"), F.col("_to.g").alias("_guest"))


def next_of(column: str) -> Column:
    return F.when(F.col("doc_id").isNull(), F.col(column)).otherwise(_lead(column))


def _lead(column: str) -> Column:
    return F.lead(column).over(Window.partitionBy("_range").orderBy(F.col("_guest"), F.col("doc_id").desc(), F.col("text")))


def fingerprint(docs: DataFrame, size: int = WORDS, bins: int = BINS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint, for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), packed(signature(F.col("text"), size, bins, bits), bits).alias("fingerprint"))


def compare_with_next(docs: DataFrame, size: int = WORDS, bins: int = BINS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many, or
    all, of the next document: by descending doc_id, rows that repeat an id by text, after the last
    the first (a single row is its own next).  A null text counts as empty; the fingerprint of a
    text without words is "".  A row with a null id has no place in that order and is its own next.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = with_next(rows, ["text"]).withColumn("_next", next_of("text")).withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 3) as int))"), F.substring(F.coalesce(F.col("_next"), F.lit("")), F.lit(1), tail))
    signed = dealt.withColumn("_edited", edited).withColumn("_bins", signature(F.col("text"), size, bins, bits))
    signed = signed.withColumn("_next_bins", next_of("_bins")).where(~F.col("_guest")).withColumn("_edited_bins", signature(F.col("_edited"), size, bins, bits))
    return signed.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("_bins"), bits).alias("fingerprint"), packed(F.col("_edited_bins"), bits).alias("edited_fingerprint"),
        likeness(F.col("_bins"), F.col("_edited_bins"), bins, bits).alias("near_edited"), likeness(F.col("_bins"), F.col("_next_bins"), bins, bits).alias("near_next"),
    )
