"""Choosing parameters by inner folds: a grid is rows beside neighbour lists that are searched once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarefold.operators.metrics import confusion, scores
from rarefold.operators.neighbours import class_lists, counts_inside, majorities, sizes
from rarefold.operators.votes import ALPHAS, N_VOTES, counted_votes, share, votes


def folds(df: DataFrame, k: int, *, repeat: int = 0, seed: int = 42, by: Sequence[str] = ("y",)) -> DataFrame:
    """df with fold: rows of each class dealt out in an order that md5 of id, repeat and seed fixes.

    The order needs each class's rows in one window; classes of many rows are
    better split by fold_of.
    """
    order = F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(repeat)), F.lit(str(seed))))
    return df.withColumn("fold", ((F.row_number().over(W.partitionBy(*by).orderBy(order, "id")) - 1) % k).cast("int"))


def fold_of(df: DataFrame, k: int, *, repeat: int = 0, seed: int = 42) -> DataFrame:
    """df with fold by hash alone: no shuffle, and classes dealt out about evenly."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col("id"), F.lit(repeat), F.lit(seed)), F.lit(k)).cast("int"))


def fold_sizes(train: DataFrame) -> DataFrame:
    """fold, n_min and n_maj of the training rows outside each fold: a row per fold."""
    per = train.groupBy("fold").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    whole = W.partitionBy()
    return per.select("fold", (F.sum("a").over(whole) - F.col("a")).alias("n_min"), (F.sum("b").over(whole) - F.col("b")).alias("n_maj"))


def grid_scores(train: DataFrame, alphas: Sequence[float] = ALPHAS, n_votes: Sequence[int] = (5,), scoring: str = "geometric_mean", whole: bool = False) -> DataFrame:
    """n_votes, alpha and score (the mean over folds) of each cell. train has fold. whole: votes reach any number of rows of either class, where lists end at their caps."""
    s = sizes(train, n_votes=max(n_votes))
    cells = F.array(*[F.struct(F.lit(int(n)).alias("n_votes"), F.lit(float(a)).alias("alpha")) for n in n_votes for a in alphas])
    r = F.col("n_maj") / F.greatest(F.col("n_min"), F.lit(1))
    if whole:
        counts = counts_inside(train, train, range(1, max(n_votes) + 1), "fold").join(F.broadcast(fold_sizes(train)), "fold")  # a row per fold
        frac = share(counted_votes(F.col("rare"), F.col("inside"), F.col("n_maj"), F.pow(r, F.col("cell.alpha")), F.col("cell.n_votes")))
        made = counts.withColumn("cell", F.explode(cells)).select("fold", "cell.n_votes", "cell.alpha", "y", (frac > 0.5).cast("int").alias("y_pred"))
        return mean_scores(made, ["n_votes", "alpha"], scoring)
    lists = class_lists(train, train, s.k_min, min(s.cap, max(s.floor, (-(-s.n_maj // max(1, s.n_min)) + 4) * max(n_votes) + s.buffer)), "fold")
    own = lists.join(F.broadcast(fold_sizes(train)), "fold")  # a row per fold
    each = own.withColumn("cell", F.explode(cells)).withColumn("r", r)
    k_maj = F.least(F.greatest(F.ceil("r") * F.col("cell.n_votes") + s.buffer, F.lit(s.floor)), F.lit(s.cap), F.col("n_maj")).cast("int")
    each = each.withColumn("dmaj", F.slice("dmaj", F.lit(1), k_maj))
    frac = share(votes(F.col("dmin"), F.col("dmaj"), F.pow("r", F.col("cell.alpha")), F.col("cell.n_votes")))
    made = each.select("fold", "cell.n_votes", "cell.alpha", "y", (frac > 0.5).cast("int").alias("y_pred"))
    return mean_scores(made, ["n_votes", "alpha"], scoring)


def mean_scores(made: DataFrame, cell: list[str], scoring: str) -> DataFrame:
    """cell and score: the metric of each fold, then the mean over folds. "utopia" is the nearness to the best mean of both mcc and geometric_mean."""
    per = scores(confusion(made, [*cell, "fold"]))
    if scoring != "utopia":
        return per.groupBy(*cell).agg(F.avg(scoring).alias("score"))
    both = per.groupBy(*cell).agg(F.avg("mcc").alias("m"), F.avg("geometric_mean").alias("g"))
    gap = lambda c: F.coalesce(F.try_divide(F.max(c).over(W.partitionBy()) - F.col(c), F.max(c).over(W.partitionBy())), F.lit(0.0))
    return both.select(*cell, (-(gap("m") * gap("m") + gap("g") * gap("g"))).alias("score"))


def best(grid: DataFrame, *order: str) -> dict:
    """The cell with the best score, the first by order among equals."""
    return grid.orderBy(F.round("score", 12).desc(), *order).first().asDict()


def chosen(grid: DataFrame, *order: str) -> DataFrame:
    """grid with chosen, true for the cell that best() gives."""
    return grid.withColumn("chosen", F.row_number().over(W.orderBy(F.round("score", 12).desc(), *order)) == 1)


def k_scores(train: DataFrame, ks: Sequence[int], scoring: str = "geometric_mean") -> DataFrame:
    """k and score of plain neighbour votes, whose lists are searched once for the largest k."""
    each = majorities(train, train, ks, "fold").select("fold", "y", F.explode(F.arrays_zip(F.array(*map(F.lit, ks)).alias("k"), F.col("said").alias("y_pred"))).alias("x"))
    return mean_scores(each.select("fold", "x.k", "y", "x.y_pred"), ["k"], scoring)


def majority(near: str) -> Column:
    """The most frequent of two labels (0 and 1) in near; the nearest row's label where both are as frequent (K2)."""
    ones = F.size(F.filter(near, lambda x: x["label"] == 1))
    zeros = F.size(near) - ones
    return F.when(ones > zeros, 1).when(ones < zeros, 0).otherwise(F.get(near, F.lit(0))["label"])


def odd_up_to(n: int) -> list[int]:
    return list(range(1, max(1, n) + 1, 2))
