"""Row numbers, equal blocks and bands by ranges of positions against whole contigs."""

import math

import numpy as np
import pytest

from cortexloom.operators import intervals

SCHEMA = "contig string, pos int, snp string"


@pytest.fixture(scope="module")
def places():
    rng = np.random.default_rng(4)
    return [(str(c), int(p), f"rs{i:04d}") for i, (c, p) in enumerate(zip(rng.integers(1, 4, 400), rng.integers(1, 150, 400)))]


def ranks(places):
    """(rank, contig's rows) of each snp."""
    out = {}
    for contig in {c for c, *_ in places}:
        own = sorted((p, s) for c, p, s in places if c == contig)
        out |= {s: (i, len(own)) for i, (_, s) in enumerate(own)}
    return out


@pytest.mark.parametrize("bucket", [1, 7, 64, 1 << 20])
def test_ranges_number_as_the_contig(spark, places, bucket):
    frame, want = spark.createDataFrame(places, SCHEMA), ranks(places)
    got = {r["snp"]: (r["_rank"], r["_n"]) for r in intervals.numbered(frame, ["snp"], bucket).collect()}
    assert got == want
    index = [r["snp"] for r in sorted(intervals.row_index(frame, ["pos", "snp"], bucket).collect(), key=lambda r: r["variant_idx"])]
    assert index == [s for *_, s in sorted(places)]
    for r in intervals.equal_blocks(frame, 30, "snp", bucket).collect():
        rank, n = want[r["snp"]]
        blocks = math.ceil(n / 30)
        assert r["block"] == min(rank // (n // blocks), blocks - 1)
    for r in intervals.band_sizes(frame, 11, "snp", bucket).collect():
        assert r["band"] == sum(c == r["contig"] and (r["pos"], r["snp"]) <= (p, s) and p <= r["pos"] + 11 for c, p, s in places)


def test_numbers_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, 5, "a"), ("1", None, "b"), ("1", 3, "c"), ("1", 3, "d")], SCHEMA)
    got = {r["snp"]: (r["_rank"], r["_n"]) for r in intervals.numbered(odd, ["snp"], 2).collect()}
    assert got == {"a": (0, 1), "b": (0, 3), "c": (1, 3), "d": (2, 3)}
    assert {r["snp"]: r["band"] for r in intervals.band_sizes(odd, 4, "snp").collect()} == {"a": 1, "b": 1, "c": 2, "d": 1}
    empty = odd.limit(0)
    assert intervals.equal_blocks(empty, 3).count() == intervals.row_index(empty, ["pos"]).count() == intervals.band_sizes(empty, 3, "snp").count() == 0
    with pytest.raises(ValueError):
        intervals.row_index(odd, ["snp"])


def test_permuted_rows_are_permutations(spark):
    from cortexloom.operators import nulls

    resid = spark.createDataFrame([(f"s{i}", [float(i), -float(i)]) for i in range(300)], "iid string, resid array<double>")
    got = {}
    for r in nulls.permuted_rows(resid, 4, seed=3).collect():
        assert r["resid"][0] == -r["resid"][1]
        got[r["sample_id"], r["iid"]] = int(r["resid"][0])
    orders = [[got[k, f"s{i}"] for i in range(300)] for k in range(4)]
    assert all(sorted(o) == list(range(300)) for o in orders)
    assert len({tuple(o) for o in orders}) == 4 and all(sum(i == v for i, v in enumerate(o)) < 15 for o in orders)
    again = {(r["sample_id"], r["iid"]): int(r["resid"][0]) for r in nulls.permuted_rows(resid.repartition(5), 4, seed=3).collect()}
    assert again == got
