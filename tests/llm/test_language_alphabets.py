"""Languages of large alphabets, and training rows that repeat."""

import random

from pyspark.sql import functions as F

from cortexloom.llm import language


def test_twenty_thousand_letters():
    rng = random.Random(6)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 20_000)]
    samples = {"zh": "".join(rng.choice(han) for _ in range(60_000)), "en": "the cat sat on the mat and the dog ran " * 200, "ko": "".join(chr(0xAC00 + rng.randrange(11_000)) for _ in range(40_000))}
    langs = language.Languages(samples)
    kinds = {k: type(t) for k, t in zip(langs.names, langs.tables)}
    assert kinds == {"zh": language.HashedTable, "ko": language.HashedTable, "en": language.DenseTable}
    names, score = langs.parser().predict(["the dog sat on the cat", samples["zh"][100:160], samples["ko"][500:560], "12", ""])
    assert names == ["en", "zh", "ko", "und", "und"] and score[0] > 0.5


def test_hashed_and_dense_tables_agree():
    rng = random.Random(7)
    samples = {k: " ".join("".join(rng.choice(v) for _ in range(rng.randint(1, 7))) for _ in range(900)) for k, v in {"x": "abcde", "y": "cdefgh", "z": "éèabj"}.items()}
    texts = [" ".join("".join(rng.choice("abcdefghijké,") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    dense, hashed = language.Languages(samples), language.Languages(samples, dense_cells=0)
    assert {type(t) for t in hashed.tables} == {language.HashedTable} and {type(t) for t in dense.tables} == {language.DenseTable}
    one, two = dense.parser().predict(texts), hashed.parser().predict(texts)
    assert one[0] == two[0] and one[1].tolist() == two[1].tolist()


def test_many_rows_of_one_id(spark):
    """A lang whose rows are mostly copies is learned from all its texts, and the copies are not collected."""
    copies = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("gleich und gleich").alias("text"), F.lit("de").alias("lang"))
    nulls = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("der die das").alias("text"), F.lit("de").alias("lang"))
    few = spark.createDataFrame([(i, f"the word {w}", "en") for i, w in enumerate("cat dog sun sea".split())], copies.schema)
    langs = language.train(copies.unionAll(nulls).unionAll(few))
    assert langs.names == ["de", "en"]
    names, _ = langs.parser().predict(["die das der gleich", "the sea", "dog cat sun"])
    assert names == ["de", "en", "en"]
    got = [tuple(r) for r in language.identify(few.unionAll(few), langs).select("doc_id", "lang_pred").collect()]
    assert sorted(got) == sorted([(i, "en") for i in range(4)] * 2)


def test_lanes_of_one_text(monkeypatch):
    """Texts of many lanes, with parses that meet late or never, against the greedy parse; also when lanes go one by one."""
    rng = random.Random(9)
    samples = {"x": "abababababab" * 30 + "aab" + "b" * 700, "y": "".join(rng.choice("ab ") for _ in range(3000))}
    texts = ["ab" * 4000, "a" * 3000, "b" * 5000, "".join(rng.choice("ab") for _ in range(4000)), "ab" * 600 + "c" + "ba" * 900]
    langs = language.Languages(samples)

    def phrases(text, sample):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in sample:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
        return n

    import numpy as np

    parser = langs.parser()
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes = parser.table[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    want = [[phrases(t, language.fold(samples[k])) for k in langs.names] for t in texts]
    for rounds in (0, 1, 8):
        monkeypatch.setattr(language, "MEND_ROUNDS", rounds)
        assert parser.phrases(codes, at).tolist() == want
