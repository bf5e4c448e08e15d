"""Streams of files: quality control of association tables batch by batch, and running variant counts.

The analyses themselves are batch; what is streamed is their input.  A batch that is run again
overwrites its own folder, so the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sumstats import quality_control


def ingest_gwas(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Start a query that passes each arriving batch of association rows through quality control into target/batch=<id>."""

    def write(batch: DataFrame, batch_id: int) -> None:
        quality_control(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def variant_counts(calls: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Allele counts of a stream of calls (ts, variant, dosage) by tumbling window, late rows beyond `delay` left out."""
    return calls.withWatermark("ts", delay).groupBy(F.window("ts", window), "variant").agg(F.count("*").alias("n"), F.sum("dosage").cast("long").alias("ac"))
