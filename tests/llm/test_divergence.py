"""Source divergence against the definition, term by term."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from cortexloom.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WIDE = "lang string, source string, text string, term int, n string, docs int, item int, value string, p int, _lang int"


def naive(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, TERM.findall(t.translate(LOWER))) for la, s, t in rows if la == lang]
        docs = Counter(t for _, ts in own for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        counts = {s: Counter() for s, _ in own}
        for s, ts in own:
            counts[s].update(t for t in ts if docs[t] >= min_docs)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def audited(spark, rows, **args):
    docs = spark.createDataFrame([(*r, 1, "n", 2, 3, "v", 4, 5) for r in rows], WIDE).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(docs, **args).collect())


def test_by_definition(spark, monkeypatch):
    """Nulls, empty texts, a group without terms, a language that keeps none, ties, letters beyond ASCII, a hot source."""
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "é", "ÉCLAIR", "漢字", "a1b", "x-y", "🙂", "zz"]
    text = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["hot", "hot", "a", "b", "é", None]), rng.choice([text(), text(), "", None])) for _ in range(200)]
    rows += [("en", "none", None), ("xx", "s", "rare words"), ("xx", "t", "other"), ("xx", "u", None), ("yy", "alone", "one one")] + [("zz", s, "same text") for s in "abc"] * 4
    monkeypatch.setattr(divergence, "POSTINGS", 7)
    for min_docs, top in ((4, 3), (1, 50), (30, 50)):
        assert audited(spark, rows, min_docs=min_docs, top=top) == naive(rows, min_docs, top)


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    rows = [("en", f"s{i % 3}", f"w{'abcdefg'[i % 7]} common {'q' * (i % 5)}") for i in range(90)]
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    monkeypatch.setattr(divergence, "PIECE", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "source", "text"])
    got = Counter()
    for out in divergence._tally([batch]):
        for lang, source, term, n, docs in zip(*(c.to_pylist() for c in out.columns)):
            if term is not None:
                got[source, term] += n
                got["docs", term] += docs
    want = Counter((s, t) for _, s, x in rows for t in x.split()) + Counter(("docs", t) for _, _, x in rows for t in set(x.split()))
    assert got == want


def test_long_text_in_pieces():
    rng = np.random.default_rng(1)
    text = " ".join("abcdefghij"[i] * (1 + i) for i in rng.integers(0, 10, 400_000)) + " " + "Z" * 3_000_000
    got = [t for ts in divergence.terms_of(text) for t in ts]
    assert len(list(divergence.terms_of(text))) > 1
    assert got == text.lower().encode().split()


def test_no_rows(spark):
    assert audited(spark, []) == []


def test_large_counts_stay_exact(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_000_000, 10**9)], "n long, total long, terms long")
    got = rows.select(divergence._share("n", "total", "terms").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (9_000_000_000_000_000 + 5) // (9_000_000_000_000_000_000 + 5 * 10**9)


def test_query_by_definition(spark, sf_dir):
    rows = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op12_source_divergence(spark, sf_dir).collect()) == naive(rows, 30, 50)
