from cortexloom.streaming import ingest_gwas, variant_counts


def test_ingest(spark, tmp_path):
    schema = "chr string, pos int, snp string, a1 string, a2 string, n double, effect double, se double, z double"
    rows = [("1", i, f"rs{i}", "A", "G" if i % 2 else "T", 100.0, 0.1, 0.1, 1.0) for i in range(10)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = ingest_gwas(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_counts(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1, 1), ("2024-01-01 00:20:00", 1, 2), ("2024-01-01 01:10:00", 1, 1)]
    df = spark.createDataFrame(rows, "ts string, variant int, dosage int").selectExpr("cast(ts as timestamp) ts", "variant", "dosage")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = variant_counts(stream).writeStream.outputMode("complete").format("memory").queryName("variant_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["ac"] for r in spark.table("variant_counts").collect()) == [1, 3]
