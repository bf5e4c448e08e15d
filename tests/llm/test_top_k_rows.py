"""Repeated ids, ties across tasks and clashing names in exact top-k."""

import numpy as np
from pyspark.sql import functions as F

from cortexloom.llm import top_k

WIDE = "vec_id long, embedding array<double>, query_id long, rank int, score double, vector string, _task int, _rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 0.5, "v", 3, 4) for i, v in rows], WIDE)


def test_ties_across_tasks(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(400)]
    for parts in (1, 3, 40):
        got = top_k.top_k(table(spark, rows).repartition(parts), F.col("vec_id") == 100, group_bytes=1 << 20).orderBy("rank").collect()
        assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(i + 1, v, 65536) for i, v in enumerate([0, 1, 2, 3, 4])]


def test_repeated_ids(spark):
    """All rows of an id are candidates; the smallest vector of an id asks, and never finds its own id."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (7, [0.0, 2.0]), (7, [0.0, 3.0]), (8, [9.0, 0.0]), (None, [5.0, 5.0])]
    got = top_k.top_k(table(spark, rows), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(50, 7, 3 * 65536), (50, 7, 2 * 65536), (50, 8, 0)]


def test_groups_of_queries_are_let_go(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(600)]
    held, most = set(), 0
    plain = top_k._sent

    def counted(queries, scale):
        nonlocal most
        sent = plain(queries, scale)
        held.add(sent)
        most = max(most, len(held))
        destroy = sent.destroy
        sent.destroy = lambda *a: (held.discard(sent), destroy(*a))
        return sent

    one = sorted(tuple(r) for r in top_k.top_k(table(spark, rows), F.col("vec_id") % 50 == 0).collect())
    monkeypatch.setattr(top_k, "_sent", counted)
    many = sorted(tuple(r) for r in top_k.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, group_bytes=100).collect())
    assert one == many and most == 1 and not held
