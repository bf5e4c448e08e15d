"""Results by index, null associations, stacked frames, imported tables, image batches, settings from JSON, promoters."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cortexloom import session
from cortexloom.sources import images, sumstats, text


def test_results_by_index(spark, tmp_path):
    frame = spark.createDataFrame([(f"g{i % 4}", i, i / 7) for i in range(40)], "set_name string, index int, p double")
    sets = spark.createDataFrame([(f"g{i}", "1", i, i + 5) for i in range(9)], "set_name string, contig string, start int, end int")
    index = sumstats.write_sets(frame, str(tmp_path / "a"), sets)
    assert sorted(tuple(r)[:4] for r in index.collect()) == [(f"g{i}", "1", i, i + 5) for i in range(4)] and index.columns == list(sumstats.INDEX_COLUMNS)
    some = sumstats.read_results(spark, index.where("START < 2"))
    assert sorted(tuple(r) for r in some.collect()) == sorted(tuple(r) for r in frame.where("set_name in ('g0', 'g1')").collect())
    more = frame.where("index < 3").select(F.concat(F.lit("h"), "set_name").alias("set_name"), "index", F.lit(2.0).alias("extra"))
    two = sumstats.stack([index, sumstats.write_sets(more, str(tmp_path / "b"))])
    both = sumstats.read_results(spark, two)
    assert both.count() == 43 and both.where("extra is null").count() == 40 and both.where("p is null").count() == 3
    with pytest.raises(ValueError):
        sumstats.read_results(spark, index.limit(0))
    with pytest.raises(ValueError):
        sumstats.stack([])
    (tmp_path / "bad").write_text("VARIANT_SET\tCHR\ng\t1\n")
    with pytest.raises(ValueError):
        sumstats.read_index(spark, str(tmp_path / "bad"))


def test_null_associations(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"g{k % 2}", i, 10.0**-i) for k in range(3) for i in range(4)], "sample_id int, gene_id string, index int, p double")
    for k in range(3):
        sumstats.append_null_text(rows.where(F.col("sample_id") == k), str(tmp_path / "null"))
    got = sumstats.read_null_associations(spark, str(tmp_path / "null"))
    assert sorted((int(r["sample_id"]), r["gene_id"], r["index"], r["p"]) for r in got.collect()) == sorted(tuple(r) for r in rows.collect())
    assert sumstats.check_points(got, 4) == 3
    with pytest.raises(ValueError):
        sumstats.check_points(got, 3)


def test_import_frame(spark):
    frame = pd.DataFrame({"iid": [1, 2], "x": [0.5, np.nan], "name": ["a", None]})
    assert [tuple(r) for r in sumstats.import_frame(spark, frame, ["iid"]).orderBy("iid").collect()] == [("1", 0.5, "a"), ("2", None, None)]
    for bad in (pd.concat([frame, frame]), pd.DataFrame({"iid": [None, "a"]})):
        with pytest.raises(ValueError):
            sumstats.import_frame(spark, bad, ["iid"])
    with pytest.raises(ValueError):
        sumstats.import_frame(spark, frame, ["iid"], most_bytes=10)


def test_image_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"s{i:03d}", rng.normal(size=50).astype(np.float32).tolist()) for i in range(200)]
    images.save_images(spark.createDataFrame(rows, "iid string, voxels array<double>"), str(tmp_path / "img"))
    keep, remove = (spark.createDataFrame([(f"s{i:03d}",) for i in r], "iid string") for r in (range(150), range(0, 150, 5)))
    table = images.load_images(spark, str(tmp_path / "img"), keep, remove)
    assert table.count() == 120
    got = images.image_batches(table, 50 * 4 * 20)
    sizes = {r["batch"]: r["count"] for r in got.groupBy("batch").count().collect()}
    assert sum(sizes.values()) == 120 and set(sizes) <= set(range(6)) and max(sizes.values()) < 60
    assert len({tuple(r) for r in got.select("batch", F.spark_partition_id()).distinct().collect()}) == len(sizes)
    assert {r["iid"]: r["voxels"] for r in got.collect()} == {i: pytest.approx(v) for i, v in rows if int(i[1:]) < 150 and int(i[1:]) % 5}
    with pytest.raises(ValueError):
        images.load_images(spark, str(tmp_path / "img"), keep, keep)


def test_settings_from_json(tmp_path):
    path = tmp_path / "conf.json"
    path.write_text(json.dumps({"spark.sql.shuffle.partitions": 200, "spark.shuffle.compress": True, "spark.io.compression.codec": "lz4", "spark.x": None}))
    want = {"spark.sql.shuffle.partitions": "200", "spark.shuffle.compress": "true", "spark.io.compression.codec": "lz4"}
    assert session.conf_from_json(str(path)) == want
    assert session.conf_from_json(str(path), "/data/run") == want | {"spark.local.dir": "/data/run_spark"}
    path.write_text(json.dumps({"spark.local.dir": "/d"}))
    assert session.conf_from_json(str(path), "/data/run") == {"spark.local.dir": "/d"}
    for bad in ([1], {"a": {"b": 1}}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            session.conf_from_json(str(path))


def test_promoters(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 10 20\n1 10 20\n2 5 9\n3 9 5\n")
    assert sorted(tuple(r) for r in text.read_promoters(spark, str(tmp_path / "p.txt"), "GRCh38").collect()) == [("chr1", 10, 20), ("chr2", 5, 9)]
    spark.createDataFrame([("X", 1, 2, "n")], "contig string, start long, end long, name string").write.parquet(str(tmp_path / "p.parquet"))
    assert [tuple(r) for r in text.read_promoters(spark, str(tmp_path / "p.parquet")).collect()] == [("X", 1, 2)]
