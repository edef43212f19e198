"""Metrics of two-class predictions, by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def confusion(df: DataFrame, by: list[str], y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """tp, tn, fp, fn by group: one shuffle of sums (G1)."""
    n = lambda a, b: F.count_if((F.col(y) == a) & (F.col(y_pred) == b))
    return df.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))


def scores(df: DataFrame, guard: str = "zero") -> DataFrame:
    """df, which has tp, tn, fp and fn, with recall, precision, specificity, f1, balanced_accuracy, geometric_mean, mcc.

    guard: what a division by nothing gives: "zero" (G5b), "null" (G5; mcc is 0
    still), or "eps", where every denominator has 1e-9 more (G5c).
    """
    def over(a: Column, b: Column) -> Column:
        a, b = a.cast("double"), b.cast("double")
        if guard == "eps":
            return a / (b + 1e-9)
        return F.try_divide(a, b) if guard == "null" else F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    out = df.withColumns({"recall": over(tp, tp + fn), "precision": over(tp, tp + fp), "specificity": over(tn, tn + fp)})
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = (tp * tn - fp * fn) / (root + 1e-9) if guard == "eps" else F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0))
    return out.withColumns(
        {
            "f1": over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
            "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2,
            "geometric_mean": F.sqrt(F.col("recall") * F.col("specificity")),
            "mcc": mcc,
        }
    ).withColumn("combined", (F.col("mcc") + F.col("geometric_mean")) / 2)


def scalarized(weight: float) -> Column:
    """Of scores(): a weight on mcc, the rest on geometric_mean."""
    return weight * F.col("mcc") + (1 - weight) * F.col("geometric_mean")


def rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean true and false rates by group."""
    of = lambda a, b: F.avg(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")))
    return df.groupBy(*by).agg(of("tp", "fn").alias("tpr"), of("tn", "fp").alias("tnr"), of("fp", "tn").alias("fpr"), of("fn", "tp").alias("fnr"))


def roc_auc(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """by and roc_auc, from average ranks; null where a class is missing.

    Rows are first summed by score, so that windows hold distinct scores only.
    """
    per = df.groupBy(*by, score).agg(F.count_if(F.col(y) == 1).alias("p"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*by).orderBy(score)) - F.col("n")
    ranked = per.withColumn("r", before + (F.col("n") + 1) / 2)
    pos, neg = F.sum("p").cast("double"), F.sum(F.col("n") - F.col("p")).cast("double")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("r") * F.col("p")) - pos * (pos + 1) / 2, pos * neg).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """by and pr_auc: the sum over falling scores of recall gained times precision; 0 without positives."""
    per = df.groupBy(*by, score).agg(F.count_if(F.col(y) == 1).cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    w = W.partitionBy(*by).orderBy(F.col(score).desc())
    run = per.withColumns({"tp": F.sum("p").over(w), "all": F.sum("n").over(w)})
    return run.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), F.sum("p")), F.lit(0.0)).alias("pr_auc"))
