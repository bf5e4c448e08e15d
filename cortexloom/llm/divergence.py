"""Source divergence audit: how far the term distributions of each language's sources lie apart.

Terms are counted by source with smoothing, as fixed-point shares, so that sums are exact.  The
distance of two sources is a sum over all terms that their language keeps, but only terms that occur
are touched: a source's histogram of counts prices its own terms as if the other had none of them,
a term that both have is corrected where their postings meet, and terms that neither has are a
constant times their number, by inclusion and exclusion.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, materialize

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: What a task holds before it hands its counts on: different terms, and bytes of text read.
HELD_TERMS, HELD_BYTES = 200_000, 64 << 20
#: Bytes of a text that are taken apart at a time, and postings that a task of the overlaps gets on average.
PIECE, POSTINGS = 1 << 20, 10_000
SCHEMA = "lang string, source string, term string, n long, docs long"

#: Letters and bytes of other characters stay, A to Z in lower case; everything else ends a term.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str):
    """Lists of the terms of a text, in UTF-8; a long text gives several."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERM)
    start = 0
    while len(data) - start > PIECE:
        end = data.find(b" ", start + PIECE)
        if end < 0:
            break
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def _tally(batches):
    """Occurrences of each term and documents with it, by group; a row without term tells that a group is there."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    read, rows = 0, 0

    def out():
        for (lang, source), (n, docs) in held.items():
            terms = [None, *(t.decode("utf-8", "surrogatepass") for t in n)]
            k = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            text, own, before = text.as_py(), set(), len(n)
            for terms in terms_of(text):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            read, rows = read + len(text), rows + 1 + len(n) - before
            if rows > HELD_TERMS or read > HELD_BYTES:
                yield from out()
                read, rows = 0, 0
    yield from out()


def _share(n, total, terms):
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)), in decimals: no product leaves them."""
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)") if isinstance(c, str) else c.cast(f"decimal({digits},0)")
    above = (wide(n, 19) + F.lit(SMOOTHING).cast("decimal(2,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    below = wide(total, 20) + wide(terms, 12) * F.lit(SMOOTHING).cast("decimal(2,0)")
    return F.call_function("div", above, below).cast("long") + F.lit(1)


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with it); one row without term for each group. Nulls are read as ''."""
    read = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(read(lang_col, "lang"), read(source_col, "source"), read(text_col, "text"))
    return mapped(rows, _tally, SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _overlap(table: pa.Table) -> pa.Table:
    """Of the postings in a bucket of terms: for each two sources what the terms they share add to the price of both as one-sided terms."""
    source = table.column("source").combine_chunks().dictionary_encode()
    names, code = source.dictionary, source.indices.to_numpy().astype(np.int64)
    # sources in the order of their names, and the postings by term, then source
    rank = np.empty(len(names), np.int64)
    rank[np.array(sorted(range(len(names)), key=lambda i: names[i].as_py().encode("utf-8", "surrogatepass")), np.int64)] = np.arange(len(names))
    names = names.take(pa.array(np.argsort(rank)))
    code = rank[code]
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.lexsort((code, term))
    p, zero = (table.column(c).to_numpy()[order] for c in ("p", "p0"))
    code, term = code[order], term[order]
    sums: dict[int, int] = {}
    step = 1
    while True:  # each posting with the step-th behind it, while they are of one term
        a = np.flatnonzero(term[:-step] == term[step:]) if step < len(term) else np.zeros(0, np.int64)
        if not len(a):
            break
        b = a + step
        more = np.abs(p[a] - p[b]) - np.abs(p[a] - zero[b]) - np.abs(zero[a] - p[b]) + np.abs(zero[a] - zero[b])
        keys, at = np.unique(code[a] * len(names) + code[b], return_inverse=True)
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, at, more)
        for key, total in zip(keys.tolist(), totals.tolist()):
            sums[key] = sums.get(key, 0) + total
        step += 1
    keys = np.array(list(sums), np.int64)
    first, second = keys // max(len(names), 1), keys % max(len(names), 1)
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(keys), pa.string()), "source": names.take(pa.array(first)).cast(pa.string()), "item": names.take(pa.array(second)).cast(pa.string()), "value": pa.array(list(sums.values()), pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, **columns) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: item is each other source of the language, value the sum over its kept terms of the
    absolute difference of their shares; all ranks.  Part `term`: item is a kept term that the source
    has, with a share above that of its language, value the excess; ranks up to `top`.  Ranks run
    from 1 by falling value, then by item in the order of its bytes.  A language keeps the terms that
    at least min_docs of its documents hold.

    Nulls in text, lang or source are read as ''.  Groups without terms are there too, with the
    smallest share for every term; where a language keeps none, all distances are 0.  Rows count
    each, whatever their id.  Other columns of docs can have any name.  An empty table gives no rows.
    """
    counts = materialize(count_terms(docs, **columns))
    terms = counts.where("term is not null")
    kept = terms.groupBy(F.col("lang").alias("_lang"), F.col("term").alias("_term")).agg(F.sum("docs").alias("_docs"), F.sum("n").alias("_in_lang")).where(F.col("_docs") >= min_docs)
    postings = materialize(terms.join(kept, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term"))).select("lang", "source", "term", "n", "_in_lang"))
    once = postings.groupBy("lang", "term").agg(F.first("_in_lang").alias("_in_lang"))
    langs = once.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("terms"), F.sum("_in_lang").alias("all_n"))
    totals = postings.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = counts.where("term is null").select("lang", "source").join(totals, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")), "left")
    groups = groups.join(langs, F.col("lang") == F.col("_lang"), "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "own", "terms", "all_n")))
    groups = materialize(groups.withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0), "total", "terms")).otherwise(0)))
    priced = postings.join(groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "total", "terms", "all_n", "p0"), (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")))
    priced = materialize(priced.select("lang", "source", "term", "n", "p0", _share("n", "total", "terms").alias("p"), _share("_in_lang", "all_n", "terms").alias("q")))

    other = groups.select(F.col("lang").alias("_l"), F.col("source").alias("item"), F.col("p0").alias("_p0"), F.col("own").alias("_own"))
    apart = (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("item"))
    neither = groups.join(other, apart).select("lang", "source", "item", ((F.col("terms") - F.col("own") - F.col("_own")) * F.abs(F.col("p0") - F.col("_p0"))).alias("value"))
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = histogram.join(other, apart).groupBy("lang", "source", "item").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("_p0"))).alias("value"))
    rows = priced.count()
    buckets = priced.select("lang", "source", "term", "p", "p0", F.pmod(F.xxhash64("term"), F.lit(max(1, math.ceil(rows / POSTINGS)))).alias("_bucket")).groupBy("lang", "_bucket")
    both = buckets.applyInArrow(_overlap, "lang string, source string, item string, value long")
    turned = lambda x: x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = neither.unionAll(alone).unionAll(turned(alone)).unionAll(both).unionAll(turned(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    found = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", "part", "item", "value", "rank")
    return ranked(pairs).unionAll(ranked(found).where(F.col("rank") <= top))
