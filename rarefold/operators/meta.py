"""Features of whole tables, and estimators of their geometry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.functions.geometry import explaining
from rarefold.operators.neighbours import nearest, within
from rarefold.operators.votes import lid


def by_place(df: DataFrame) -> DataFrame:
    """place, m, s and skew of each place of the vectors v."""
    each = df.select(F.posexplode(F.col("v").cast("array<double>")).alias("place", "x"))
    m = F.avg("x")
    third = F.avg(F.col("x") * F.col("x") * F.col("x")) - 3 * m * F.avg(F.col("x") * F.col("x")) + 2 * m * m * m
    return each.groupBy("place").agg(m.alias("m"), F.stddev_pop("x").alias("s"), F.coalesce(F.try_divide(third, F.pow(F.stddev_pop("x"), F.lit(3.0))), F.lit(0.0)).alias("skew"))


def table_features(df: DataFrame) -> DataFrame:
    """One row: sizes, imbalance, class entropy, mean variation and skewness."""
    counts = df.agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("y") == 1).cast("double").alias("a"), F.max(F.size("v")).cast("double").alias("p"))
    p = F.col("a") / F.col("n")
    entropy = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    shape = by_place(df).agg(F.avg(F.when(F.abs("m") > 1e-9, F.col("s") / F.abs("m"))).alias("mean_cv"), F.avg(F.abs("skew")).alias("mean_skew"))
    one = counts.join(F.broadcast(shape), F.lit(True))
    return one.select(F.ln("n").alias("log_n"), F.ln("p").alias("log_p"), F.ln((F.col("n") - F.col("a")) / F.col("a")).alias("log_imbalance"), (F.col("p") / F.col("n")).alias("p_by_n"), entropy.alias("class_entropy"), "mean_cv", "mean_skew")


def histogram_entropy(df: DataFrame) -> DataFrame:
    """One row: the mean entropy of equal bins of each place, min(10, max(2, n // 10)) of them."""
    each = df.select(F.posexplode(F.col("v").cast("array<double>")).alias("place", "x"))
    edge = each.groupBy("place").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").cast("double").alias("n")).where("hi > lo")
    bins = F.least(F.lit(10.0), F.greatest(F.lit(2.0), F.floor(F.col("n") / 10)))
    placed = each.join(edge, "place").withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), bins - 1))
    counts = placed.groupBy("place", "bin", "n").agg(F.count("*").alias("c"))
    share = F.col("c") / F.col("n")
    return counts.groupBy("place").agg((-F.sum(share * F.log2(share))).alias("h")).agg(F.avg("h").alias("hist_entropy"))


def graph_features(df: DataFrame, k_first: int = 5, k_second: int = 10) -> DataFrame:
    """One row with both definitions (X6): v1 over k_first neighbours, majority share and mixed lists of all rows; v2 over k_second, rare share and rare rows whose nearest is common; nn_dist_ratio: rare rows' mean distance to their k_first by common rows', 1 where a class has a row at most."""
    near = nearest(df, df, max(k_first, k_second), "id")
    first, second = F.slice("near", 1, k_first), F.slice("near", 1, k_second)
    ones = lambda a: F.size(F.filter(a, lambda x: x["label"] == 1)) / F.size(a)
    rare = F.col("y") == 1
    mean_d = F.aggregate(first, F.lit(0.0), lambda s, x: s + x["d"]) / F.size(first)
    each = near.select("y", ones(first).alias("a"), ones(second).alias("b"), F.get("near", F.lit(0))["label"].alias("l"), mean_d.alias("d"))
    ratio = F.avg(F.when(rare, F.col("d"))) / (F.avg(F.when(~rare, F.col("d"))) + 1e-9)
    return each.agg(
        F.avg(F.when(rare, 1 - F.col("a"))).alias("purity_v1"),
        F.avg(((F.col("a") > 0) & (F.col("a") < 1)).cast("double")).alias("borderline_v1"),
        F.avg(F.when(rare, F.col("b"))).alias("purity_v2"),
        F.avg(F.when(rare, (F.col("l") == 0).cast("double"))).alias("borderline_v2"),
        F.when((F.count_if(rare) > 1) & (F.count_if(~rare) > 1), ratio).otherwise(1.0).alias("nn_dist_ratio"),
    )


def dimensions(df: DataFrame, k: int = 10) -> DataFrame:
    """id and lid of each row from its k nearest others."""
    near = nearest(df, df, k, "id")
    return near.select("id", lid(F.transform("near", lambda x: x["d"])).alias("lid"))


def dimension_spread(df: DataFrame, k: int = 10, sample: int = 200) -> DataFrame:
    """spread: the variation of lid over the rows with the least md5 of their ids, at most sample."""
    own = df.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
    return dimensions(own, k).agg(F.coalesce(F.try_divide(F.stddev_pop("lid"), F.avg("lid")), F.lit(0.0)).alias("spread"), F.count("*").alias("n"))


def neighbour_slope(df: DataFrame, k: int = 20) -> DataFrame:
    """slope of the log mean distance on the log rank (Z3), and the dimension it tells."""
    near = nearest(df, df, k, "id").select(F.posexplode("near").alias("i", "x"))
    per = near.groupBy("i").agg(F.avg("x.d").alias("d"))
    slope = F.regr_slope(F.ln("d"), F.ln(F.col("i") + 1))
    return per.agg(slope.alias("slope"), (1 / slope).alias("dimension"))


def counted_k(lists: DataFrame, rank: int) -> DataFrame:
    """id, counting and by_rank: k from the common rows inside the rank-th rare radius, and from the ratio of distances at that rank."""
    radius = F.get("dmin", F.lit(rank - 1))
    return lists.select("id", (within(F.col("dmaj"), radius) / rank).alias("counting"), F.try_divide(radius, F.get("dmaj", F.lit(rank - 1))).alias("by_rank"))


def effective_dimension(df: DataFrame, share: float = 0.95) -> DataFrame:
    """y, components and n of each class (Z2): sums of products, partition by partition, and one small eigenvalue problem a class."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].sum())
        s, p = (np.sum(np.stack(rows[c].to_numpy()), axis=0) for c in ("s", "p"))
        values = np.linalg.eigvalsh((p.reshape(len(s), -1) - np.outer(s, s) / n) / max(1, n - 1))
        return pd.DataFrame({"y": [rows["y"].iloc[0]], "components": [explaining(values, share)], "n": [n]})

    return moments(df, "y").groupBy("y").applyInPandas(of, "y int, components int, n long")


def moments(df: DataFrame, by: str | None = None) -> DataFrame:
    """n, sum and product sums of v, partition by partition (and by an int column): what a covariance of any number of rows needs."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for b in batches:
            for key, own in b.groupby(by) if by else ((0, b),):
                if len(own):
                    x = np.stack(own["v"].to_numpy())
                    n, s, p = found.get(key, (0, 0.0, 0.0))
                    found[key] = n + len(x), s + x.sum(axis=0), p + x.T @ x
        for key, (n, s, p) in found.items():
            yield pd.DataFrame(({by: [key]} if by else {}) | {"n": [n], "s": [s], "p": [p.ravel()]})

    v = F.col("v").cast("array<double>").alias("v")
    return df.select(*([F.col(by).cast("int").alias(by)] if by else []), v).mapInPandas(part, (f"{by} int, " if by else "") + "n long, s array<double>, p array<double>")


def principal(df: DataFrame, components: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Axes (rows, the largest entry of each positive) and shares of variance."""
    rows = moments(df).collect()  # a row per partition
    n = sum(r.n for r in rows)
    s, p = sum(np.array(r.s) for r in rows), sum(np.array(r.p) for r in rows)
    c = (p.reshape(len(s), -1) - np.outer(s, s) / n) / max(1, n - 1)
    values, axes = np.linalg.eigh(c)
    axes = axes[:, ::-1].T[:components]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return axes, values[::-1][:components] / values.sum()


def projected(df: DataFrame, axes: np.ndarray) -> DataFrame:
    """df with pc, the coordinates of v along axes, v itself unchanged."""
    rows = [F.array(*map(F.lit, map(float, a))) for a in axes]
    dot = lambda a: F.aggregate(F.zip_with(F.col("v"), a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("pc", F.array(*map(dot, rows)))


def learners() -> dict:
    """Meta-learners by name (X11). There is no kernel machine with a radial basis in MLlib; a linear one takes its place, and boosted trees and it tell two classes only."""
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier

    return {
        "logistic": LogisticRegression(maxIter=100, regParam=0.01),
        "forest": RandomForestClassifier(numTrees=100, seed=42),
        "boosted": OneVsRest(classifier=GBTClassifier(maxIter=20, seed=42)),
        "linear_svm": OneVsRest(classifier=LinearSVC(maxIter=50)),
    }


def importances(model, data: DataFrame, names: list[str], repeats: int = 30, seed: int = 42) -> list[tuple[str, float]]:
    """feature and importance (X12): of trees, of coefficients, or the accuracy that shuffling a feature costs."""
    if hasattr(model, "featureImportances"):
        return list(zip(names, model.featureImportances.toArray().tolist(), strict=True))
    if hasattr(model, "coefficientMatrix"):
        return list(zip(names, np.abs(model.coefficientMatrix.toArray()).mean(axis=0).tolist(), strict=True))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import Window as W

    own = data.select("label", vector_to_array("features").alias("x"), F.monotonically_increasing_id().alias("i"))
    numbered = own.withColumn("i", F.row_number().over(W.orderBy("i")))
    right = lambda df: model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    base, out = right(own.withColumn("features", array_to_vector("x"))), []
    for k, name in enumerate(names):
        cost = 0.0
        for r in range(repeats):
            other = numbered.select(F.get("x", F.lit(k)).alias("swap"), F.row_number().over(W.orderBy(F.xxhash64("i", F.lit(seed + r)))).alias("i"))
            mixed = numbered.join(other, "i").withColumn("x", F.transform("x", lambda x, j: F.when(j == k, F.col("swap")).otherwise(x)))  # noqa: B023
            cost += base - right(mixed.withColumn("features", array_to_vector("x")))
        out.append((name, cost / repeats))
    return out
