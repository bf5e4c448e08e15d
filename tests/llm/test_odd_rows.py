"""Null and repeated ids, clashing labels and sources, and naive twins of operators 2 and 5."""

import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cortexloom.llm import fingerprints, mixing, quality, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def earliest_deadline(blocks, weights):
    """The schedule by its definition: the ideal mix runs in real time; every slot goes to the released block with the earliest deadline."""
    w = {s: Fraction(weights[s]) for s, n in blocks.items() if n}
    times, t, left = {s: [Fraction(0)] for s in w}, Fraction(0), {s: Fraction(blocks[s]) for s in w}
    while any(left.values()):
        live = [s for s in w if left[s]]
        total = sum(w[s] for s in live)
        events = [(left[s] - (math.ceil(left[s]) - 1)) * total / w[s] for s in live]  # until the block each is in is done
        step = min(events)
        for s in live:
            left[s] -= step * w[s] / total
        t += step
        for s, e in zip(live, events):
            if e == step:
                times[s].append(t)
    jobs = [(math.ceil(b), str(s), s, k, math.floor(a)) for s, at in times.items() for k, (a, b) in enumerate(zip(at, at[1:]))]
    out, done = [], set()
    for slot in range(len(jobs)):
        ready = [j for j in jobs if (j[2], j[3]) not in done and j[4] <= slot and (j[3] == 0 or (j[2], j[3] - 1) in done)]
        best = min(ready, key=lambda j: j[:4])
        assert best[0] >= slot + 1
        done.add((best[2], best[3]))
        out.append(best[2])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_turns_are_earliest_deadline_first(seed):
    rng = random.Random(seed)
    blocks = {f"s{i}": rng.randint(1, 25) for i in range(rng.randint(1, 5))}
    weights = {s: rng.choice([1, 2, 7, 0.3, math.sqrt(2), 1e-3]) for s in blocks}
    assert mixing.turns(blocks, weights) == earliest_deadline(blocks, weights)


def test_null_source_and_empty_name(spark):
    rows = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else "=x") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.schedule(docs, {None: 1, "": 2, "=x": 1}, block_rows=5).collect()
    assert {r["doc_id"]: r["source"] for r in got} == dict(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], set()).add(r["source"])
    assert len(slots) == 18 and all(len(s) == 1 for s in slots.values())
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"": 2, "=x": 1})


def test_labels_that_clash(spark):
    docs = spark.createDataFrame([(i, "good words here. " * 9 if i % 2 else "BAD!!! 123 ") for i in range(60)] + [(7, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 3 + [(3, 0), (None, 1), (9, None)] + [(5, 1)] * 5000, "doc_id long, quality int")
    once = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0)], "doc_id long, quality int")
    one, two = quality.train(docs, labels), quality.train(docs, once)
    assert one.bias == two.bias and one.rules == two.rules
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, one).collect()}
    assert got[11] > 0.5 > got[10]


def test_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 50)
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    seen = []
    plain = quality.RuleEnsemble.fit
    monkeypatch.setattr(quality.RuleEnsemble, "fit", staticmethod(lambda x, y: seen.append(len(y)) or plain(x, y)))
    quality.train(docs, spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, quality int"))
    assert seen == [100]


def test_rows_without_id_have_fingerprints(spark):
    docs = spark.createDataFrame([(None, "one two three four five six seven"), (4, "a b c d e f"), (None, None), (9, "g h i j k l m n"), (4, "z y x w v u"), (-3, "")], "doc_id long, text string")
    got = fingerprints.compare_with_next(docs).collect()
    assert len(got) == 6 and sum(r["doc_id"] is None for r in got) == 2
    assert all(r["near_next"] == 1.0 for r in got if r["doc_id"] is None)
    only = fingerprints.compare_with_next(docs.where("doc_id is null")).collect()
    assert sorted(r["fingerprint"] for r in only) == sorted(r["fingerprint"] for r in got if r["doc_id"] is None)
    # by descending id, rows of one id by text: 9, 4 "a...", 4 "z...", -3, then 9 again
    import hashlib

    edited = lambda t, u: hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest()
    want = {edited("g h i j k l m n", "a b c d e f"), edited("a b c d e f", "z y x w v u"), edited("z y x w v u", ""), edited("", "g h")}
    assert {r["edited_sha256"] for r in got if r["doc_id"] is not None} == want


def naive_bins(hashes, bins=256, low=48):
    """Smallest hash of each bin; an empty bin takes that of the first bin in its own order that has one."""
    mask, bits, got = (1 << 64) - 1, bins.bit_length() - 1, {}
    for h in hashes:
        v = (h & mask) >> (64 - low - bits)
        got[v >> low] = min(v, got.get(v >> low, v))
    got = {b: v for b, v in got.items() if v & ((1 << low) - 1) != (1 << low) - 1}
    if not got:
        return [-1] * bins
    return [got[b] if b in got else got[next(o for o in order if o in got)] for b, order in enumerate(fingerprints._orders(bins))]


def test_fingerprints_by_definition(spark, sf_dir):
    """Bins, densification, packing and likeness against plain Python, from the hashes of the shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "one"), (10_003, "a b c d e"), (10_004, "x " * 4000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionAll(odd)
    hashes = {r["doc_id"]: r["h"] for r in rows.select("doc_id", fingerprints.shingle_hashes(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    words = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows.collect()}
    assert all(len(hashes[d]) == (n - 4 if n >= 5 else min(n, 1)) for d, n in words.items())
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(rows).collect()}
    low = {d: [v if v == -1 else v & 255 for v in naive_bins(h)] for d, h in hashes.items()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: "" if b[0] == -1 else "".join(f"{v:02x}" for v in b) for d, b in low.items()}
    order = sorted(low, reverse=True)
    for d, e in zip(order, order[1:] + order[:1]):
        a, b = low[d], low[e]
        same = sum(x == y for x, y in zip(a, b)) / 256
        want = 1.0 if a[0] == b[0] == -1 else 0.0 if -1 in (a[0], b[0]) else min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))
        assert got[d]["near_next"] == pytest.approx(want)


def test_op1_counts(spark, sf_dir):
    got = queries.op1_quality_rules(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.where("score is null or score < 0 or score > 1").count() == 0
