"""From raw documents to mixed, encoded training text: five stages, each one operator of cortexloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  What a stage rejects is gone for the next.  doc_id names a document: rows that repeat
one are judged together, and rows without one are kept as documents of their own by all stages that
do not read their language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.llm import language, mixing, near_duplicates, pieces, repeats
from cortexloom.llm.common import crc_mod, materialize, table
from cortexloom.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts that are null or without a letter go."""
    learned = language.train(docs.where(crc_mod("doc_id", 4) != 2))
    return language.keep_languages(docs, learned)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates.

    Rows that repeat an id are one document and stay or go together; rows without id stay."""
    gone = near_duplicates.near_duplicates(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages that a document with a smaller id has too are cut, other texts stay as they are."""
    got = repeats.remove_repeats(docs, carry=docs.columns).withColumn("_cut", F.col("n_removed") > 0)
    changed = {"text": F.when(F.col("_cut"), F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(F.col("_cut"), F.length("kept")).otherwise(F.col("row.n_chars"))}
    return got.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: by slot within and across partitions (files)."""
    order = mixing.schedule(docs).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("_order")).withColumnRenamed("doc_id", "_id")
    placed = docs.join(order, F.col("doc_id") == F.col("_id"), "left")
    return placed.repartitionByRange("_order").sortWithinPartitions("_order").select(*docs.columns)


def placed_rows(docs: DataFrame) -> DataFrame:
    """docs with `position` (part, file, row), which sorts as the rows were written.

    A scan reads files in any order, so the place in a written table comes from the names of its part
    files and the rows' numbers in them; of a DataFrame that is not a scan, from its partitions.
    """
    if docs._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation"):
        number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("int"), F.lit(0))
        part, file, row = number(r"^part-(\d+)"), number(r"-c(\d+)\."), F.col("_metadata.row_index")
    else:
        part, file, row = F.lit(0), F.lit(0), F.monotonically_increasing_id()
    return docs.select("*", F.struct(part.alias("part"), file.alias("file"), row.alias("row")).alias("position"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip, position; sorted by position the rows are the mix."""
    return pieces.encode_and_check(placed_rows(docs), tokenizer_path(), carry=("position",))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode_documents),
]

#: Classes of near-duplicates are connected components, and languages are learned: SQL cannot state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
