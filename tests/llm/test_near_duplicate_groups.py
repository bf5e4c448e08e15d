"""Groups of copies: very large ones, repeated ids, long texts in mixed buckets."""

import random

from pyspark.sql import functions as F

from cortexloom.llm import near_duplicates


def test_nodes_of_a_large_group(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("h1"), F.lit(1).cast("long").alias("h2"))
    twice = rows.unionAll(rows.where("doc_id < 10"))
    want = {r["h1"]: r["m"] for r in rows.groupBy("h1").agg(F.min("doc_id").alias("m")).collect()}
    got = near_duplicates._nodes(twice).collect()
    key = {r["doc_id"]: r["h1"] for r in rows.collect()}
    assert len(got) == 5010 and all(r["node"] == want[key[r["doc_id"]]] for r in got)


def test_no_task_gets_all_copies(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("h1"), F.lit(1).cast("long").alias("h2"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = near_duplicates._nodes(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in sizes) == 20_000 and max(r["count"] for r in sizes) < 10_000


def test_tiles_by_weight(spark, monkeypatch):
    """Long texts make small tiles; the classes are those of one tile."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w + [f"y{rng.randrange(10**6)}" for _ in range(rng.randint(0, 90))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    monkeypatch.setattr(near_duplicates, "TILE_WEIGHT", 700)
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs).collect()} == want
    assert len(set(want.values())) > 1
