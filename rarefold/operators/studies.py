"""Studies of the method: geometry by k and imbalance, on tables and on simulated classes, and the choice of an algorithm by a table's features."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.functions.geometry import noise_components
from rarefold.operators import selection
from rarefold.operators.multiclass import majority_label, ranked_label
from rarefold.operators.neighbours import nearest
from rarefold.operators.meta import effective_dimension
from rarefold.operators.ranking import averaged, spearman, winners
from rarefold.operators.votes import lid


def dimension_sweep(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    """k, mean_lid, std_lid and cv_lid over all rows, whose neighbours are searched once for the largest k (Z1). k that no row has so many others for are left out."""
    near = nearest(df, df, max(ks), "id").select("id", F.transform("near", lambda x: x["d"]).alias("d"))
    each = near.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("k") <= F.size("d"))
    each = each.select("k", lid(F.slice("d", F.lit(1), F.col("k"))).alias("lid"))
    out = each.groupBy("k").agg(F.avg("lid").alias("mean_lid"), F.stddev_pop("lid").alias("std_lid"))
    return out.withColumn("cv_lid", F.when(F.col("mean_lid") > 0, F.col("std_lid") / F.col("mean_lid")))


def choices(results: DataFrame) -> DataFrame:
    """dataset and label: the number, by name from 0, of the algorithm that wins there; names has it too."""
    names = results.select("algorithm").distinct().agg(F.array_sort(F.collect_set("algorithm")).alias("names_"))  # one row of algorithms' names
    best = winners(averaged(results).where("value is not null"))
    return best.join(F.broadcast(names), F.lit(True)).select("dataset", (F.array_position("names_", F.col("algorithm")) - 1).cast("int").alias("label"))


def leading_pair(results: DataFrame) -> tuple[str, str]:
    """The two algorithms with the best means over datasets, by name among equals: two rows reach the driver."""
    top = averaged(results).groupBy("algorithm").agg(F.avg("value").alias("m")).orderBy(F.col("m").desc_nulls_last(), "algorithm").limit(2).collect()
    if len(top) < 2:
        raise ValueError("fewer than two algorithms")
    return top[0][0], top[1][0]


def duel(results: DataFrame, first: str, second: str) -> DataFrame:
    """dataset and label: 1 where the first is better."""
    own = averaged(results).groupBy("dataset").pivot("algorithm", [first, second]).agg(F.first("value"))
    return own.select("dataset", F.coalesce(F.col(f"`{first}`") > F.col(f"`{second}`"), F.lit(False)).cast("int").alias("label"))


def rank_learner(table: DataFrame) -> DataFrame:
    """id, y and y_pred by corrected ranks, each row left out in turn: a join per row, for tables of a row per dataset."""
    ids = [r[0] for r in table.select("id").orderBy("id").collect()]
    runs = [ranked_label(table.where(F.col("id") == i), table.where(F.col("id") != i)).select("id", "y", "y_pred") for i in ids]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionAll(r)
    return out


LEARNERS: dict[str, Callable[[DataFrame], DataFrame]] = {"neighbours": lambda t: majority_label(nearest(t, t, 5, "id")).select("id", "y", "y_pred"), "ranks": rank_learner}


def selection_accuracy(features: DataFrame, labels: DataFrame, learner: Callable[[DataFrame], DataFrame] = LEARNERS["neighbours"]) -> DataFrame:
    """accuracy, baseline (the most frequent label's share), gain and n of telling each dataset's label from the other datasets (X9, X10). features: dataset, id (long) and v."""
    table = features.join(labels, "dataset").select("id", F.col("label").alias("y"), "v")
    made = learner(table)
    right = made.agg(F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    most = table.groupBy("y").count().agg(F.max("count").alias("m"))
    return right.join(F.broadcast(most), F.lit(True)).select("accuracy", (F.col("m") / F.col("n")).alias("baseline"), (F.col("accuracy") - F.col("m") / F.col("n")).alias("gain"), "n")


def simulated(spark: SparkSession, cells: Sequence[tuple], names: Sequence[str], run: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of run(*cell) for each cell, a task's share of them at a time."""
    kinds = ", ".join(f"{n} {'double' if isinstance(v, float) else 'long'}" for n, v in zip(names, cells[0], strict=True))
    columns = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for cell in batch.itertuples(index=False) for row in run(*cell)], columns=columns)

    return spark.createDataFrame(list(cells), kinds).repartition(min(len(cells), 64)).mapInPandas(each, schema)


def normal_density(x: np.ndarray, mean: Sequence[float], s: float) -> float:
    gap = x - np.asarray(mean)
    return float(np.exp(-(gap @ gap) / (2 * s * s)) / (2 * np.pi * s * s))


#: Where the local odds are estimated: inside the rare class, at its rim, between and inside the two common blobs.
PLACES = ((0.0, 0.0), (0.5, 0.0), (1.0, 0.0), (1.5, 0.0), (2.0, 0.0))


def odds_errors(spark: SparkSession, ratios: Sequence[int] = (3, 9, 27, 54), seeds: int = 20, n_maj: int = 540, rare: float = 0.5, blob: float = 0.5, wide: float = 2.0, away: float = 2.0) -> DataFrame:
    """ratio, counting and joint: mean errors of two estimators of the local odds against the densities' own.

    Rare rows are one normal cloud, common ones two at either side and a wide one.
    counting: common rows inside the radius of the root-of-n-th rare row, by that
    number. joint: the ratio of classes among as many nearest rows as hold that
    number of rare ones on average. Errors are by truth, 1 at least.
    """

    def one(ratio: int, seed: int) -> Iterator[tuple]:
        rng = np.random.default_rng([seed, ratio])
        n_min, third = max(1, n_maj // ratio), n_maj // 3
        a = rng.standard_normal((n_min, 2)) * rare
        b = np.concatenate([rng.standard_normal((third, 2)) * blob + (away, 0), rng.standard_normal((third, 2)) * blob - (away, 0), rng.standard_normal((n_maj - 2 * third, 2)) * wide])
        ref = max(3, int(n_min**0.5))
        for x in map(np.array, PLACES):
            common = (normal_density(x, (away, 0), blob) + normal_density(x, (-away, 0), blob) + normal_density(x, (0, 0), wide)) / 3
            truth = common * n_maj / max(normal_density(x, (0, 0), rare) * n_min, 1e-300)
            if not truth < 1e6:
                continue
            da, db = np.sort(np.hypot(*(a - x).T)), np.sort(np.hypot(*(b - x).T))
            counting = (db <= da[ref - 1]).sum() / ref if ref <= n_min else np.nan
            both = np.argsort(np.concatenate([da, db]), kind="stable")[: int(n_maj / n_min * ref)]
            near = int((both < n_min).sum())
            joint = (len(both) - near) / near if near else np.inf
            yield (ratio, *[abs(e - truth) / max(truth, 1.0) if np.isfinite(e) else None for e in (counting, joint)])

    errors = simulated(spark, [(r, s) for r in ratios for s in range(seeds)], ("ratio", "seed"), one, "ratio long, counting double, joint double")
    return errors.groupBy("ratio").agg(F.avg("counting").alias("counting"), F.avg("joint").alias("joint"), F.count("*").alias("n"))


def rank_one_ratios(spark: SparkSession, ratios: Sequence[float] = (1.0, 2.0, 5.0, 10.0, 20.0), dimension: int = 2, n_maj: int = 200, queries: int = 50, seeds: int = 10) -> DataFrame:
    """ratio, simulated and expected: mean distance to the nearest rare row by that to the nearest common one, both classes uniform, and the dimension's root of the ratio."""

    def one(ratio: float, seed: int) -> Iterator[tuple]:
        rng = np.random.default_rng([seed, round(ratio * 1000)])
        a, b, q = (rng.random((n, dimension)) for n in (max(int(n_maj / ratio), 5), n_maj, queries))
        least = lambda x: np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2)).min(axis=1).mean()
        yield ratio, least(a), least(b)

    made = simulated(spark, [(float(r), s) for r in ratios for s in range(seeds)], ("ratio", "seed"), one, "ratio double, a double, b double")
    return made.groupBy("ratio").agg((F.avg("a") / F.avg("b")).alias("simulated")).withColumn("expected", F.pow("ratio", F.lit(1.0 / dimension)))


def bias_curve(spark: SparkSession, ratios: Sequence[float] = (1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02), ks: Sequence[int] = (1, 5, 11), n: int = 300, folds: int = 5, seeds: int = 5) -> DataFrame:
    """ratio (rare by common), k, f1 and balanced_accuracy of plain votes on two normal clouds, by folds."""

    def one(ratio: float, seed: int) -> Iterator[tuple]:
        rng = np.random.default_rng([seed, round(ratio * 1000)])
        a = max(int(n * ratio / (1 + ratio)), 5)
        y = np.repeat([0, 1], [n - a, a])
        x = rng.standard_normal((n, 2)) * np.where(y, 0.6**0.5, 1.0)[:, None] + 1.5 * y[:, None]
        x = (x - x.mean(axis=0)) / x.std(axis=0)
        fold = np.empty(n, int)
        for c in (0, 1):
            at = rng.permutation(np.flatnonzero(y == c))
            fold[at] = np.arange(len(at)) % folds
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        d[fold[:, None] == fold[None]] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        for k in ks:
            p = (y[order[:, :k]].mean(axis=1) > 0.5).astype(int)
            for f in range(folds):
                own = fold == f
                tp, fp, fn, tn = ((own & (p == u) & (y == v)).sum() for u, v in ((1, 1), (1, 0), (0, 1), (0, 0)))
                yield ratio, k, 2 * tp / max(1, 2 * tp + fp + fn), (tp / max(1, tp + fn) + tn / max(1, tn + fp)) / 2

    made = simulated(spark, [(float(r), s) for r in ratios for s in range(seeds)], ("ratio", "seed"), one, "ratio double, k long, f1 double, balanced_accuracy double")
    return made.groupBy("ratio", "k").agg(F.avg("f1").alias("f1"), F.avg("balanced_accuracy").alias("balanced_accuracy"))


def exponents_and_dimensions(tables: dict[str, DataFrame], folds: int = 3) -> DataFrame:
    """dataset, alpha, ratio (components of the rare class by the common one's) and structural (less the same of noise of these shapes) of each table (Z8). A table is a few jobs, and a row of the result."""
    rows = []
    for name, table in tables.items():
        alpha = selection.best(selection.grid_scores(selection.folds(table, folds), whole=True), "n_votes", "alpha")["alpha"]
        p = table.select(F.max(F.size("v"))).first()[0]
        own = {r["y"]: (r["components"], r["n"]) for r in effective_dimension(table).collect()}
        ratio = structural = None
        if len(own) == 2 and own[1][1] >= max(2, p):
            ratio = own[1][0] / own[0][0]
            structural = ratio - noise_components(own[1][1], p) / noise_components(own[0][1], p)
        rows.append((name, float(alpha), ratio, structural))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "dataset string, alpha double, ratio double, structural double")


def exponent_correlations(study: DataFrame) -> DataFrame:
    """of, rho, n and p: whether the chosen exponents follow the ratio of dimensions, or its structural part."""
    one = lambda c: spearman(study, c, "alpha").select(F.lit(c).alias("of"), "rho", "n", "p")
    return one("ratio").unionByName(one("structural"))
