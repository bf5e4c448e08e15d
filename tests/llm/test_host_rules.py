"""Host-level rules against naive counts and rates; odd rows, urls, hot hosts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexloom.llm import host_rules, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
WIDE = "doc_id long, source string, text string, host string, kept int, rows string, n_words string, _host int, _salt int, base_failed string"


def naive_counts(text):
    ws = WORD.findall(text or "")
    runs = defaultdict(list)
    for i in range(len(ws) - 2):
        runs[tuple(ws[i : i + 3])].append(i)
    inside = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), len(lines)


def naive_verdicts(rows):
    """rows: (source, text); whether each is kept, by the definition."""
    fails = []
    for _, text in rows:
        n, chars, symbols, dup, repeat, lines = naive_counts(text)
        fails.append({"short": n < 50, "repetitive": 100 * repeat > 50 * n, "symbols": 10 * symbols > n, "lines": 3 * dup > lines, "word_length": chars < 3 * n or chars > 10 * n})
    hosts = Counter(h for h, _ in rows if h is not None)
    rate = {}
    for rule in host_rules.RULES:
        failed = Counter(h for (h, _), f in zip(rows, fails) if h is not None and f[rule])
        sums = len(hosts), sum(hosts.values()), sum(failed.values()), sum(n * n for n in hosts.values()), sum(failed[h] ** 2 / n for h, n in hosts.items())
        a, b = host_rules.beta_prior(*sums) if hosts else (0, 1)
        for h, n in hosts.items():
            rate[h, rule] = (failed[h] + a) / (n + a + b)
    out = []
    for (h, _), f in zip(rows, fails):
        base = f["short"] or f["repetitive"]
        bad = h is not None and any(rate[h, r] > 0.5 or rate[h, r] > 0.05 and f[r] for r in f)
        out.append((base, not base and not bad))
    return out


def random_text(rng, words=None):
    alphabet = rng.choice(["ab", "abcdefgh", "éß漢🙂a", "#a|<"])
    gap = lambda: rng.choice([" ", " ", " ", "\n", "\t", "\x0b", "  ", "\r\n", "\n\n"])
    return "".join("".join(rng.choices(alphabet, k=rng.randint(1, 6))) + gap() for _ in range(rng.randint(0, 120) if words is None else words))


def test_counts_by_definition(spark):
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(150)] + [None, "", " \n\t", "\n", "a", "a a a a", "x y  z", "line\nline\nline ", "a b c a b c", "z" * 5000 + "\n" + "z" * 5000, random_text(rng, 30_000), "no gap" + "\x1c\x85w w w w w"]
    docs = spark.createDataFrame([(i, "s", t, "h", 1, "r", "n", 2, 3, "b") for i, t in enumerate(texts)], WIDE).repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in host_rules.COUNTS) for r in host_rules.count(docs).collect()}
    assert got == {i: naive_counts(t) for i, t in enumerate(texts)}


def test_hash_collisions_are_told_apart(monkeypatch):
    data = np.frombuffer(b"aa bb aa cc", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    monkeypatch.setattr(host_rules, "word_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    assert host_rules.word_ids(data, starts, ends).tolist() == [0, 1, 0, 2]


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_by_definition(spark, seed, monkeypatch):
    """A hot host, hosts of one document, a host that fails, a null host, equal and missing ids."""
    rng = random.Random(seed)
    good = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(60))
    junk = lambda: good() + " |||||||||||||||||||"
    rows = [("hot", rng.choice([good(), good(), junk(), "short"])) for _ in range(60)] + [("bad", junk()) for _ in range(25)]
    rows += [(f"one{i}", rng.choice([good(), junk()])) for i in range(20)] + [(None, junk()), (None, good()), (None, ""), ("hot", None), ("", good())] * 2
    monkeypatch.setattr(host_rules, "HOT", rng.choice([1, 3, 1000]))
    docs = spark.createDataFrame([(None if i % 9 == 0 else i // 2, h, t, "h", 1, "r", "n", 2, 3, "b") for i, (h, t) in enumerate(rows)], WIDE)
    got = sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["base_failed"], r["kept"]) for r in host_rules.judge(docs).collect())
    want = sorted((-1 if i % 9 == 0 else (i // 2 or -1), *naive_counts(t)[:2], *v) for i, ((_, t), v) in enumerate(zip(rows, naive_verdicts(rows))))
    assert got == want


def test_rejected_host_takes_its_good_documents(spark):
    good, junk = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), " ".join(f"w{i}x|" for i in range(60))
    rows = [(i, "bad", junk) for i in range(30)] + [(100, "bad", good), (101, "fine", good)] + [(200 + i, f"h{i % 5}", good) for i in range(50)]
    got = {r["doc_id"]: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[100]["host_rejected"] and not got[100]["kept"] and got[101]["kept"] and not got[101]["host_rejected"]


def test_no_rows_and_no_rules(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert host_rules.judge(empty).collect() == []
    one = spark.createDataFrame([(1, "s", "few words")], empty.schema)
    assert [(r["base_failed"], r["kept"]) for r in host_rules.judge(one, rules={}, base={}).collect()] == [(False, True)]


def test_prior():
    assert sum(host_rules.beta_prior(5, 500, 50, 5 * 100**2, 5.0)) > 1e5  # all hosts alike
    a, b = host_rules.beta_prior(10, 1000, 500, 10 * 100**2, 5 * 100.0)  # five fail always, five never
    assert a + b < 0.01 and a == pytest.approx(b)
    assert host_rules.beta_prior(3, 30, 0, 300, 0.0)[0] == 0


def test_hosts_of_urls(spark):
    urls = {"https://www.Example.ORG:80/a?b": "example.org", "http://u:p@x.de/": "x.de", "ftp://[::1]:9/z": "[::1]", "no url": None, "": None, None: None, "http://a.b.": "a.b"}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host_rules.host_of_url(F.col("url")).alias("h")).collect()
    assert {r["url"]: r["h"] for r in rows} == urls


def test_query_by_definition(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    verdicts = naive_verdicts([(r["source"], r["text"]) for r in rows])
    want = sorted((r["doc_id"], *naive_counts(r["text"])[:5], *v) for r, v in zip(rows, verdicts))
    got = sorted((r["doc_id"], *(r[c] for c in host_rules.COUNTS[:5]), r["base_failed"], r["kept"]) for r in queries.op11_host_rules(spark, sf_dir).collect())
    assert got == want
