"""The driver's tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vectors(spark: SparkSession, sf_dir: str, classes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries (every fifth vector) and training rows: id, y, v. y is 1 for label 0, or the label itself."""
    y = F.col("label") if classes else (F.col("label") == 0).cast("int")
    own = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), y.alias("y"), F.col("embedding").cast("array<double>").alias("v"))
    return own.where("id % 5 = 0"), own.where("id % 5 <> 0")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: id, y (1: quality 0), numbers with gaps, words with gaps, and test for every fifth."""
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"),
        (F.col("quality") == 0).cast("int").alias("y"),
        "quality",
        F.when(F.col("doc_id") % 11 != 0, F.col("n_chars").cast("double")).alias("n_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("blanks"),
        F.lit(1.0).alias("fixed"),
        F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"),
        F.col("source"),
        (F.col("doc_id") % 5 == 0).alias("test"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table in long form: nations as datasets, priorities as algorithms, mean order prices as values."""
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    own = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 rows
    return own.groupBy(F.col("n_name").alias("dataset"), F.col("o_orderpriority").alias("algorithm")).agg(F.avg("o_totalprice").alias("value"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confusion table: return flags as algorithms, ship years as datasets; a line is rare if its discount is over 0.07, and found if its quantity is over 25."""
    own = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("algorithm"), F.year("l_shipdate").alias("dataset"), (F.col("l_discount") > 0.07).cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("y_pred"), F.col("l_quantity").alias("score"))
    return own
