"""Training-data operators against brute force, exact round trips and held-out labels, with the odd cases of their contracts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cortexloom.llm import fingerprints, language, mixing, near_duplicates, piece_automaton, pieces, quality, queries, repeats, token_counts, top_k, warc
from cortexloom.llm.common import crc_mod, shared_dir
from cortexloom.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Columns with the names that operators use inside, beside id and text.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, class string, score double, fingerprint string, row string, windows string, slot long"


def odd_docs(spark, n=12):
    """Nulls, empty, blank, short, repeated, very long, and clashing columns."""
    texts = [None, "", "   \n\t", "one", "one two three four", "one two three four five", "same text of six words here", "same text of six words here", "漢字 😀 ß é x", "w " * 3000, "x" * 20_000, " ".join(f"t{i}" for i in range(3000))]
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", 5, 1, 2, "c", 0.5, "f", "r", "w", 3) for i, t in enumerate(texts[:n])], CLASH)


def empty_docs(spark):
    return spark.createDataFrame([], CLASH)


def collected(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


def random_texts(n=400, seed=3):
    rng, alphabet = random.Random(seed), "aab  eth▁\n.,éß漢字😀\tזש01<s>𒀀"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(n)] + ["", " ", "a" * 5000, " " * 3000, "<s></s><unk><0x0A>", "\x00\x01", "﻿a"]


def test_piece_automaton_gives_the_librarys_ids(sp):
    model = piece_automaton.load_model(queries.tokenizer_path())
    automaton, texts = piece_automaton.PieceAutomaton(model), random_texts()
    ids, at = piece_automaton.encode(automaton, texts)
    want = sp.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert piece_automaton.count(automaton, texts).tolist() == [len(w) for w in want]
    small = piece_automaton.PieceAutomaton(model, most_states=1000)  # forgets its states at every block
    assert [piece_automaton.count(small, texts[i : i + 50], 700).tolist() for i in range(0, 100, 50)] == [[len(w) for w in want[i : i + 50]] for i in range(0, 100, 50)]
    data, places = piece_automaton.PieceBytes(model).decode(ids, at)
    assert [data[a:b].tobytes().decode() for a, b in zip(places[:-1], places[1:])] == [t.replace("▁", " ") for t in texts]


def test_streaming_viterbi(sp):
    viterbi = pieces.StreamingViterbi(piece_automaton.load_model(queries.tokenizer_path()))
    for t in random_texts(25, 9)[:25]:
        assert viterbi.encode(t[:80]) == sp.encode(t[:80])
    held = 0
    for c in " the quick brown fox " * 20:
        viterbi.feed(c)
        held = max(held, len(viterbi.nodes))
    assert held <= 2 * viterbi.longest + 2


def test_unigram_viterbi():
    model = {"pieces": ["▁", "a", "b", "ab", "▁a", *[f"<0x{i:02X}>" for i in range(256)]], "normal": [0, 1, 2, 3, 4], "scores": [-3.0, -2.0, -2.0, -2.5, -2.5] + [0.0] * 256, "bytes": {i: 5 + i for i in range(256)}, "digest": "x"}
    assert pieces.StreamingViterbi(model, "unigram").encode("ab") == [4, 2]
    assert pieces.StreamingViterbi(model, "unigram").encode("bab") == [0, 2, 3]


def test_token_counts(spark, sp):
    docs = odd_docs(spark)
    got = collected(token_counts.count_tokens(docs, queries.tokenizer_path(), limit=2))
    for r in docs.collect():
        t = r["text"] or ""
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 2)
    assert token_counts.count_tokens(empty_docs(spark), queries.tokenizer_path()).count() == 0


def test_encoding_round_trip(spark, sp):
    docs = odd_docs(spark)
    encoded = pieces.encode_and_check(docs, queries.tokenizer_path())
    got = collected(encoded)
    assert all(r["round_trip"] for r in got.values()) and got[8]["ids"] == sp.encode(docs.where("doc_id = 8").first()["text"])
    back = collected(pieces.decode_pieces(encoded, queries.tokenizer_path()))
    assert all(back[r["doc_id"]]["text"] == (r["text"] or "") for r in docs.collect())
    assert pieces.encode_pieces(empty_docs(spark), queries.tokenizer_path()).count() == 0


def test_op3_and_op9_on_whole_tables(spark, sf_dir, sp):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts, ids = collected(queries.op3_token_counts(spark, sf_dir)), collected(queries.op9_piece_ids(spark, sf_dir))
    assert counts.keys() == ids.keys() == texts.keys()
    for d, t in texts.items():
        want = sp.encode(t)
        assert counts[d]["n_tokens"] == len(want) and ids[d]["ids"] == want and ids[d]["round_trip"]


def test_quality_on_held_out_labels(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op1_quality_rules(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(labels[r["doc_id"]], r["score"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for q, s in held if q == k] for k in (1, 0))
    if good and bad:
        assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_rules_compile(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.STATISTICS)))
    rules = quality.RuleEnsemble.fit(x, ((x[:, 3] > 0.5) & (x[:, 6] < 0.7)).astype(float))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], "doc_id long, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = [r[0] for r in df.orderBy("doc_id").select(rules.column()).collect()]
    assert got == pytest.approx(rules.score(x).tolist())
    assert ((rules.score(x) > 0.5) == ((x[:, 3] > 0.5) & (x[:, 6] < 0.7))).mean() > 0.97


def test_quality_odd_cases(spark):
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, None), (None, 0)], "doc_id long, quality int")
    rules = quality.train(odd_docs(spark), labels)  # one class only
    got = collected(quality.score(odd_docs(spark), rules))
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.score(empty_docs(spark), quality.train(empty_docs(spark), labels.limit(0))).count() == 0


def test_statistics_by_hand():
    s = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["Ab ab 1!\nAb ab 1!", None]))[0]))
    assert (s["n_bytes"], s["n_words"], s["upper"], s["digits"], s["marks"]) == (17, 6, 2 / 17, 2 / 17, 2 / 17)
    assert s["distinct"] == 3 / 6 and s["repeated_lines"] == 1 / 2 and s["lines"] == 2 / 6


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 0.61, "b": 0.28, "c": 0.11}])
def test_pfair_deviation(weights):
    n = 1024
    turn, total = mixing.turns({s: n for s in weights}, weights)[:n], sum(weights.values())
    for s, w in weights.items():
        assert (np.abs(np.cumsum([t == s for t in turn]) - np.arange(1, n + 1) * w / total) < 1).all()


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "a" if i < 700 else "b" if i < 900 else None) for i in range(1000)], "doc_id long, source string")
    got = mixing.schedule(docs, {"a": 1, "b": 2, None: 1}, block_rows=10, period=64).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1000))
    blocks = {(r["source"], r["block"]): r["slot"] for r in got}
    assert sorted(blocks.values()) == list(range(100)) and len({(r["slot"], r["place"]) for r in got}) == 1000
    order = [s for (s, _), _ in sorted(blocks.items(), key=lambda x: x[1])]
    first = order[:36]  # until the first source runs out
    for s, w in (("a", 0.25), ("b", 0.5), (None, 0.25)):
        assert all(abs(first[: t + 1].count(s) - (t + 1) * w) < 1 for t in range(36))
    assert all(slot > blocks[(s, b - 1)] for (s, b), slot in blocks.items() if b)


def test_mixing_is_the_plan(spark, sf_dir):
    got = queries.op2_pfair_mixing(spark, sf_dir).collect()
    n = Counter(r["source"] for r in got)
    phases = mixing.plan({s: math.ceil(c / mixing.BLOCK_ROWS) for s, c in n.items()}, mixing.default_weights(n))
    want = {}
    for first, used, turn, done in phases:
        at = dict(done)
        for k in range(used):
            s = turn[k % len(turn)]
            want[(s, at[s])] = first + k
            at[s] += 1
    assert {(r["source"], r["block"]): r["slot"] for r in got} == want
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_mixing_odd_cases(spark):
    assert mixing.schedule(empty_docs(spark)).count() == 0
    assert mixing.schedule(odd_docs(spark)).count() == 12
    with pytest.raises(ValueError):
        mixing.schedule(odd_docs(spark), {"s0": 1})


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows, threshold=0.8):
    bags, root = {d: bag(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum((bags[a] & bags[b]).values())
            if both and both >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - both) - 1e-9:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def crowd(n=120, seed=4):
    """Texts of one base with edits, many of them near the threshold, and some that only share a passage."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for d in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        out.append((d + 100, " ".join(w + [f"y{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))])))
    return out


def test_near_duplicates_are_brute_force(spark):
    rows = crowd() + [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)
    assert got[7] == 6 and got[0] == 0 and got[1] == 1 and got[2] == 2


def test_near_duplicates_odd_cases(spark):
    assert near_duplicates.near_duplicates(empty_docs(spark)).count() == 0
    twice = odd_docs(spark).unionAll(odd_docs(spark)).unionAll(spark.createDataFrame([(None, "one two three four five", *[None] * 11)], CLASH))
    got = near_duplicates.near_duplicates(twice).collect()
    assert len(got) == 25 and sum(r["doc_id"] is None for r in got) == 1


def test_op4_on_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op4_dart_near_duplicates(spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_signatures_estimate_weighted_similarity():
    texts = [t for _, t in crowd(40)]
    doc, e, *_ = near_duplicates.unit_elements(pa.array(texts))
    sig = near_duplicates.signatures(doc, e, len(texts), 400)
    errors = []
    for i in range(0, 40, 3):
        for j in range(i):
            a, b = bag(texts[i]), bag(texts[j])
            both = sum((a & b).values())
            errors.append((sig[i] == sig[j]).mean() - both / (sum(a.values()) + sum(b.values()) - both))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.13


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r["member"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def next_of(rows, i):
    order = sorted(rows, key=lambda r: -r[0])
    k = [r[0] for r in order].index(rows[i][0])
    return order[(k + 1) % len(order)][1] or ""


def test_fingerprints(spark, sf_dir):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = collected(queries.op5_fingerprints(spark, sf_dir))
    assert len(got) == len(rows)
    near, exact = [], []
    for i, (d, t) in enumerate(rows):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + next_of(rows, i)[:cut]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = set(bag(t)), set(bag(edited))
        near.append(r["near_edited"])
        exact.append(len(a & b) / len(a | b))
    assert np.abs(np.array(near) - exact).mean() < 0.04 and np.abs(np.array(near) - exact).max() < 0.2
    by_text = {}
    assert all(by_text.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"] for d, t in rows)


def test_fingerprint_ranges(spark):
    rows = [(7 * i, f"word{i} a b c d e f g {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = fingerprints.with_next(docs, ["text"]).withColumn("_next", fingerprints.next_of("text")).where("not _guest").collect()
    text = dict(rows)
    assert len(dealt) == 2000 and len({r["_range"] for r in dealt}) > 3
    assert all(r["_next"] == text[r["doc_id"] - 7 if r["doc_id"] else 7 * 1999] for r in dealt)


def test_fingerprint_odd_cases(spark):
    got = collected(fingerprints.compare_with_next(odd_docs(spark)))
    assert len(got) == 12 and got[0]["fingerprint"] == got[1]["fingerprint"] == got[2]["fingerprint"] == "" and got[6]["fingerprint"] == got[7]["fingerprint"] != ""
    assert got[1]["near_next"] == 1.0 and got[3]["near_next"] == 0.0 and got[7]["near_next"] == 1.0
    assert fingerprints.compare_with_next(empty_docs(spark)).count() == 0
    assert collected(fingerprints.compare_with_next(odd_docs(spark, 1)))[0]["n_chars"] == 0
    assert collected(fingerprints.fingerprint(odd_docs(spark)))[6]["fingerprint"] == got[6]["fingerprint"]


def brute_repeats(rows, n=13):
    words, first = {d: WORD.findall(t or "") for d, t in rows}, {}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            first[tuple(w[i : i + n])] = min(d, first.get(tuple(w[i : i + n]), d))
    out = {}
    for d, w in words.items():
        gone = {k for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for k in range(i, i + n)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("window", [3, 13])
def test_repeats_are_brute_force(spark, window):
    rng = random.Random(5)
    shared = [[f"p{k}_{i}" for i in range(20)] for k in range(4)]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()]
    for d in range(100, 160):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(shared) + [rng.choice("abcdefg") for _ in range(rng.randint(0, 25))]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = repeats.remove_repeats(docs, window).collect()
    want = brute_repeats(rows, window)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_repeats_odd_cases(spark):
    assert repeats.remove_repeats(empty_docs(spark)).count() == 0
    docs = odd_docs(spark).unionAll(spark.createDataFrame([(None, "a b", *[None] * 11)], CLASH))
    got = repeats.remove_repeats(docs, carry=docs.columns).collect()
    assert len(got) == 13 and {r["row"]["slot"] for r in got} == {3, None}


def test_long_prefixes_split_large_groups():
    counts = {n: np.zeros(1 << repeats.BITS, np.int64) for n in (1, 2, 4, 8, 13)}
    counts[1][5], counts[2][7], counts[2][9], counts[4][1], counts[8][2], counts[13][3] = 200_000, 100, 199_900, 199_900, 199_900, 199_900
    counts[13][4] = 100
    s = repeats.Shards(counts)
    assert s.n == 8 and s.deep[1][5] and s.deep[2][9] and not s.deep[2][7] and s.parts[3] == 8


def brute_top(vectors, k=5):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in (i for i in whole if i % 50 == 0):
        held = lambda s: max(-(2**63), min(s, 2**63 - 1))
        best = sorted(((-held(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e6, 1e13])
def test_top_k_is_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-2, 3, 8) * scale).tolist()) for i in range(300)] + [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    for group in (top_k.GROUP_BYTES, 128):  # one pass, and several
        got = top_k.top_k(df, F.col("vec_id") % 50 == 0, group_bytes=group)
        assert sorted(tuple(r) for r in got.collect()) == brute_top(rows)


def test_top_k_odd_cases(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [0.5])], "vec_id long, embedding array<float>")
    assert top_k.top_k(few, F.col("vec_id") % 50 == 0).count() == 4
    assert top_k.top_k(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_cross_parsing_is_greedy():
    samples = {"x": "the cat sat on the mat and the dog", "y": "der hund und die katze auf dem dach"}
    langs = language.Languages(samples)
    parser = language.Parser(langs)
    rng = random.Random(1)
    texts = ["the dog sat", "die katze", "é", "katze é mat", " ".join(rng.choice(["the", "mat", "die", "hund", "zzz"]) for _ in range(800))]

    def phrases(text, sample):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in sample:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
        return n

    folded = [language.fold(t) for t in texts]
    points = np.frombuffer("".join(folded).encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in folded])])
    assert parser.phrases(parser.table[points], at).tolist() == [[phrases(t, samples[k]) for k in langs.names] for t in folded]
    names, _ = parser.predict([*texts[:2], "", "123 !"])
    assert names == ["x", "y", "und", "und"]


def test_language_on_held_out(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op8_language_id(spark, sf_dir).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_language_odd_cases(spark):
    docs = odd_docs(spark)
    learned = language.train(docs)
    got = collected(language.identify(docs, learned))
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and got[3]["lang_pred"] == "en"
    assert language.identify(empty_docs(spark), learned).count() == 0
    nothing = language.train(empty_docs(spark))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    kept = language.keep_languages(docs, learned)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["lang_pred"] != "und"}


def test_warc_round_trip(spark):
    html = [None, "", "<p>x</p>", "<p>x</p>", "ünï\r\n\r\ncode", "z" * 300_000, "<p>x</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h, "t") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")
    for least in (0, 5):
        path = f"{shared_dir(spark)}/warc-test-{least}-{random.random()}"
        warc.write_pages(pages.repartition(3), path, least)
        got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
        assert len(got) == len(html)
        for i, h in enumerate(html):
            raw = (h or "").encode()
            same = [j for j, o in enumerate(html) if (o or "") == (h or "")] if len(raw) >= least else [i]
            kind, to = ("response", None) if max(same) == i else ("revisit", max(same))
            r = got[i]
            assert (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) == (kind, to, len(raw), warc.digest(raw))
            assert r["payload"] == (raw if kind == "response" else None) and r["url"] == f"http://h/{i}"
        heads = warc.read_archive(spark, path, payload=False).where("record_type = 'revisit' and payload_bytes >= 0")
        assert heads.count() == sum(r["record_type"] == "revisit" for r in got.values()) and all(r["payload"] is None for r in heads.collect())


def test_warc_pushdown(spark):
    path = f"{shared_dir(spark)}/warc-push-{random.random()}"
    warc.write_pages(spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string"), path)
    reader = warc.WarcReader({"path": path})
    assert not list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.GreaterThan(("page_id",), 15)]))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["page_id"] for r in rows) == [16, 17, 18, 19]
    bad = warc.record(1, "u", b"abc", "response", warc.digest(b"other"), None)
    with pytest.raises(ValueError):
        warc.parse_headers(b"HTTP/1.1 200\r\n")
    assert warc.fields(warc.parse_headers(bad.split(b"\r\n\r\n")[0]))["record_bytes"] == 3


def test_warc_empty(spark):
    path = f"{shared_dir(spark)}/warc-none-{random.random()}"
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


def test_pipeline_stages(spark, sf_dir, sp):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", "src0", 0), (10_001, "123 !!", "en", "src0", 6), (10_002, "", None, None, 0)], docs.schema)
    docs = docs.unionAll(extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    named = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mixing", "encoding"]

    known = named["language_id"](spark, docs, sf_dir)
    kept = [(r["doc_id"], r["text"]) for r in known.collect()]
    assert {d for d, _ in rows} - {d for d, _ in kept} == {10_000, 10_001, 10_002} and known.columns == docs.columns

    single = named["near_dedup"](spark, known, sf_dir)
    want = brute_classes(kept)
    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert sorted(d for d, _ in left) == sorted({c for c in want.values()}) and single.columns == docs.columns

    cut = named["substring_dedup"](spark, single, sf_dir)
    gone = brute_repeats(left)
    text = dict(left)
    got = cut.collect()
    assert cut.columns == docs.columns and cut.schema == docs.schema
    assert {r["doc_id"]: r["text"] for r in got} == {d: (k if n else text[d]) for d, (_, n, k) in gone.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got if gone[r["doc_id"]][1])

    mixed = named["mixing"](spark, cut, sf_dir)
    assert sorted(tuple(r) for r in mixed.collect()) == sorted(tuple(r) for r in got) and mixed.columns == docs.columns
    order = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.schedule(cut).collect()}
    assert [order[r["doc_id"]] for r in mixed.collect()] == sorted(order.values())

    encoded = named["encoding"](spark, mixed, sf_dir).collect()
    final = {r["doc_id"]: r["text"] for r in got}
    assert all(r["ids"] == sp.encode(final[r["doc_id"]]) and r["round_trip"] for r in encoded) and len(encoded) == len(got)


def test_labels_are_split_by_hash(spark):
    import zlib

    got = spark.range(50).select("id", crc_mod("id", 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


@pytest.mark.parametrize("weights", [{"a": 0.61, "b": 0.3897, "c": 0.0003}, {"a": math.sqrt(7), "b": math.sqrt(3), "c": 1e-4}])
def test_mixing_keeps_the_given_weights(weights):
    blocks = {"a": 60_000, "b": 60_000, "c": 1_000}
    order = mixing.turns(blocks, weights)
    total, n = sum(weights.values()), 60_000  # before a source runs out
    for s, w in weights.items():
        done = np.cumsum(np.array(order[:n]) == s)
        assert (np.abs(done - np.arange(1, n + 1) * w / total) < 1 + 1e-9).all()
    assert Counter(order) == blocks


def test_mixing_of_many_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod("id", F.lit(1500))).alias("source"))
    got = mixing.schedule(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000)) and {r["slot"] for r in got} == set(range(1500))


def test_mixing_after_a_source_runs_out():
    blocks, weights = {"a": 3, "b": 30, "c": 60}, {"a": 2, "b": 1, "c": 1}
    order = mixing.turns(blocks, weights)
    for t in range(6, 64):  # a runs out at slot 6, when b and c have 1.5 blocks each, b at 63
        assert abs(order[:t].count("b") - (1.5 + (t - 6) / 2)) < 1
    with pytest.raises(ValueError):
        mixing.turns({"a": 1, "b": 1}, {"a": 0, "b": 1})


def test_mix_survives_the_reread(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, "x " * (1 + (i % 700 if i % 3 else 1)), "en", f"src{i % 3}", 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    named, path = dict(corpus_pipeline.STAGES), str(tmp_path / "mix")
    want = [r["doc_id"] for r in mixing.schedule(docs).orderBy("slot", "place").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        named["mixing"](spark, docs, "").write.option("maxRecordsPerFile", 40).parquet(path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = list((tmp_path / "mix").glob("*.parquet"))
    assert len(files) > 13 and len({f.stat().st_size for f in files}) > 13
    reread = spark.read.parquet(path)
    assert [r["doc_id"] for r in reread.select("doc_id").collect()] != want  # the scan's own order is another
    assert [r["doc_id"] for r in named["encoding"](spark, reread, "").orderBy("position").collect()] == want
    mixed = named["mixing"](spark, docs, "")
    assert [r["doc_id"] for r in named["encoding"](spark, mixed, "").orderBy("position").collect()] == want


def test_position_of_rows_that_are_no_scan(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    turned = docs.repartitionByRange(F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"))
    got = [r["doc_id"] for r in corpus_pipeline.placed_rows(turned).orderBy("position").collect()]
    assert got == sorted(got, reverse=True) and len(got) == docs.count()


def test_languages_of_long_texts_only(spark):
    rng = random.Random(5)
    words = {"x": ["alpha", "beta", "gamma", "delta"], "y": ["𐐨eins", "zwei", "drei", "vier"]}
    long = {k: " ".join(rng.choice(w) for _ in range(8000)) for k, w in words.items()}
    assert min(map(len, long.values())) > language.MAX_TEXT
    rows = [(0, long["x"], "x"), (1, "🙂 7 " * 9000 + long["y"], "y"), (2, "12 34", "z"), (3, "9 " * 15_000, "z"), (4, None, "z"), (5, "one two", None)]
    learned = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned.names == ["x", "y"]
    names, _ = language.Parser(learned).predict(["gamma beta beta", "drei vier zwei", "77"])
    assert names == ["x", "y", "und"]


def test_nothing_learned_drops_no_text_with_letters(spark):
    docs = spark.createDataFrame([(0, "some text", None), (1, None, None), (2, "12 !", "en"), (3, "", None), (4, "é", None)], "doc_id long, text string, lang string")
    learned = language.train(docs)
    assert not learned.names
    assert sorted(r["doc_id"] for r in language.keep_languages(docs, learned).collect()) == [0, 4]
    assert {r["lang_pred"] for r in language.identify(docs, learned).collect()} == {"und"}
