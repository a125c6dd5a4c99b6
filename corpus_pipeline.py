"""A corpus from raw documents to packed training sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet in the shared checkpoint folder and rereads it as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import jaccard_join, packing, pii, quality, toxicity
from pixelloom.llm.common import saved, table
from pixelloom.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.5 or more; every row by its own text."""
    ship_package(spark)
    return toxicity.ordinary_rows(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents of quality 0.7 or more; every row by its own text."""
    ship_package(spark)
    return quality.good_rows(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id, one of its rows if it has several.

    Every row is a document, also one that repeats a doc_id or has none; the
    latter stays only if no row of its group has an id. Documents without
    shingles are in no group and stay.
    """
    ship_package(spark)
    # written, so a row keeps its number in every pass
    rows = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    grouped = saved(jaccard_join.classes(rows.select(F.col("_row").alias("doc_id"), "text")), "classes")
    several = grouped.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    members = grouped.join(several, "component_id").select("component_id", F.col("doc_id").alias("_row")).join(rows.select("_row", "doc_id"), "_row")
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("stays")
    gone = members.join(members.groupBy("component_id").agg(stays), "component_id").filter(F.col("_row") != F.col("stays"))
    return rows.join(gone.select("_row"), "_row", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data masked and n_chars counted anew."""
    ship_package(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of the permitted lengths."""
    ship_package(spark)
    return packing.pack_documents(packing.text_lengths(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("n-gram jaccard join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("best-fit packing", pack_sequences),
]

# Two learned filters and a greedy packing are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
