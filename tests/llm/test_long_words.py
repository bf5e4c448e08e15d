"""Words whose polynomial hashes modulo 2^64 are equal for every base, as texts and as single words."""

import numpy as np
import pyarrow as pa
import pytest

from cortexloom.llm import common, near_duplicates, quality, repeats


def thue_morse(n, letters="ab"):
    bits = "0"
    while len(bits) < n:
        bits += bits.translate(str.maketrans("01", "10"))
    return bits[:n].translate(str.maketrans("01", letters)), bits[:n].translate(str.maketrans("01", letters[::-1]))


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 512, 1024, 4096])
def test_word_hashes_differ(n):
    one, two = thue_morse(n)
    data, offsets = common.text_buffer(pa.array([one, two, f"x {one}", one]))
    starts, ends, _ = common.words(data, offsets)
    got = common.word_hashes(data, starts, ends)
    assert len(got) == 5 and len(set(got.tolist())) == 3 and got[0] != got[1] and got[0] == got[3] == got[4]


def test_hashes_of_many_words_differ():
    rng = np.random.default_rng(3)
    texts = sorted({bytes(rng.integers(97, 100, rng.integers(1, 90)).astype(np.uint8)).decode() for _ in range(20_000)})
    data, offsets = common.text_buffer(pa.array(texts))
    starts, ends, _ = common.words(data, offsets)
    assert len(set(common.word_hashes(data, starts, ends).tolist())) == len(texts)


@pytest.mark.parametrize("n", [5, 13, 1024, 4096])
def test_run_hashes_differ(n):
    one, two = (np.array([0x1234567890ABCDEF if c == "a" else 0xFEDCBA0987654321 for c in t], np.uint64) for t in thue_morse(n))
    assert common.run_hashes(one, n)[0] != common.run_hashes(two, n)[0]
    joined = common.run_hashes(np.concatenate([one, two, one]), n)
    assert len(joined) == 2 * n + 1 and joined[0] == joined[2 * n] != joined[n]


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_operators_tell_long_words_apart(spark, n):
    one, two = thue_morse(n)
    head = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}"), (4, one), (5, two)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0}
    classes = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}  # eight of ten runs of texts 1 and 2 agree
    got = dict(zip(quality.STATISTICS, quality.statistics(pa.array([f"{one} {two}\n{one}\n{two}"]))[0]))
    assert got["distinct"] == 2 / 4 and got["repeated_lines"] == 0


def test_one_hash_of_two_windows():
    hashes, checks, docs = np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 1], np.uint32), np.array([5, 3, 8, 4])
    assert repeats.smallest_docs(hashes, docs).tolist() == [3, 3, 3, 4]
    assert repeats.smallest_docs(hashes, docs, checks).tolist() == [5, 3, 5, 4]


def test_ids_that_repeat(spark):
    """Rows of one id count as one document: what they share with each other stays."""
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (2, "short")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in repeats.remove_repeats(docs).collect())
    assert got == [(1, 20, 0), (1, 20, 0), (2, 1, 0), (2, 20, 20)]
