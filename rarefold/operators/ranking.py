"""Analysis of result tables, long form: dataset, algorithm, value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarefold.functions.pvalues import chi2_p, kendall_p, signed_rank_p, student_p

# 0.05 quantiles of the studentized range by the root of 2, for 2 to 10 algorithms, and the one for other numbers; the second table is the report's.
Q_05, Q_OTHER = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}, 2.569
Q_05_REPORT, Q_OTHER_REPORT = Q_05 | {3: 2.344}, 2.949


def averaged(df: DataFrame) -> DataFrame:
    """A row per dataset and algorithm: the mean of its folds' values, null where it has none."""
    return df.groupBy("dataset", "algorithm").agg(F.avg("value").alias("value"))


def two_level_mean(df: DataFrame, value: str = "value") -> DataFrame:
    """Folds to datasets to algorithms."""
    per = df.groupBy("dataset", "algorithm").agg(F.avg(value).alias("m"))
    return per.groupBy("algorithm").agg(F.avg("m").alias(value), F.count("*").alias("n_datasets"))


def covered(df: DataFrame, other: DataFrame, least: int) -> DataFrame:
    """algorithm, value and delta: the two-level mean over datasets that have at least so many rows in other, and less that over all."""
    some = other.groupBy("dataset").agg(F.count("*").alias("n_")).where(F.col("n_") >= least)
    whole = two_level_mean(df).select("algorithm", F.col("value").alias("all_"))
    part = two_level_mean(df.join(some, "dataset", "left_semi")).select("algorithm", "value")
    return part.join(whole, "algorithm").select("algorithm", "value", (F.col("value") - F.col("all_")).alias("delta"))


def pivoted(df: DataFrame, algorithms: Sequence[str], complete: bool = False) -> DataFrame:
    """A column per named algorithm (G8); complete drops datasets that lack one."""
    out = df.groupBy("dataset").pivot("algorithm", list(algorithms)).agg(F.avg("value"))
    return out.na.drop() if complete else out


def ranks(df: DataFrame, by: str = "dataset", descending: bool = True) -> DataFrame:
    """df with rank: 1 for the best, equal values share their mean; null values have none."""
    own = df.withColumn("rank_value", F.col("value"))
    order = F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last()
    r = F.rank().over(W.partitionBy(by).orderBy(order)) + (F.count("*").over(W.partitionBy(by, "rank_value")) - 1) / 2
    return own.withColumn("rank", F.when(F.col("value").isNotNull(), r)).drop("rank_value")


def average_ranks(df: DataFrame) -> DataFrame:
    """algorithm and avg_rank over the datasets where it has a value; folds are averaged first."""
    return ranks(averaged(df)).groupBy("algorithm").agg(F.avg("rank").alias("avg_rank"))


def complete(df: DataFrame) -> DataFrame:
    """Means of folds, of the datasets that have a value for every algorithm."""
    df = averaged(df)
    n = df.select(F.count_distinct("algorithm").alias("k_"))
    good = df.where("value is not null").groupBy("dataset").agg(F.count("*").alias("n_")).join(F.broadcast(n), F.lit(True)).where("n_ = k_")
    return df.join(good.select("dataset"), "dataset", "left_semi")


def friedman(df: DataFrame) -> DataFrame:
    """statistic (with the correction for ties), df, n and p of complete datasets (H1)."""
    r = ranks(complete(df))
    ties = r.groupBy("dataset", "rank").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    per = r.groupBy("algorithm").agg(F.sum("rank").alias("s"), F.count("*").cast("double").alias("n"))
    one = per.agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.first("n").alias("n"), F.count("*").cast("double").alias("k")).join(F.broadcast(ties), F.lit(True))
    n, k = F.col("n"), F.col("k")
    plain = 12 / (n * k * (k + 1)) * F.col("q") - 3 * n * (k + 1)
    out = one.select((plain / (1 - F.col("ties") / (n * (k * k * k - k)))).alias("statistic"), (k - 1).cast("int").alias("df"), n.cast("long").alias("n"))
    return out.withColumn("p", chi2_p(F.col("statistic"), F.col("df")))


def differences(df: DataFrame, baseline: str) -> DataFrame:
    """dataset, algorithm and diff: the mean of its folds less the baseline's (G12); null where one of both is missing."""
    df = averaged(df)
    base = df.where(F.col("algorithm") == baseline).select("dataset", F.col("value").alias("base"))
    return df.where(F.col("algorithm") != baseline).join(base, "dataset", "left").select("dataset", "algorithm", (F.col("value") - F.col("base")).alias("diff"))


def wilcoxon(df: DataFrame, baseline: str) -> DataFrame:
    """algorithm, n, statistic, p_raw and ties: signed ranks without zeros (H2); ties is how many ranks are shared.

    p is exact for up to 50 datasets without ties and zeros, else the normal tail
    with the correction for ties. All algorithms but the baseline have a row, with
    null statistic and p where there are under two pairs or no difference. An
    unknown baseline is an error.
    """
    if df.where(F.col("algorithm") == baseline).isEmpty():
        raise ValueError(f"no results of the baseline {baseline!r}")
    every = differences(df, baseline).where("diff is not null")
    pairs = every.groupBy("algorithm").agg(F.count("*").alias("pairs"), F.count_if(F.col("diff") == 0).alias("zeros"))
    signed = ranks(every.where("diff <> 0").withColumn("value", F.abs("diff")), "algorithm", descending=False)
    t = F.col("t")
    ties = signed.groupBy("algorithm", "rank").agg(F.count("*").cast("double").alias("t")).groupBy("algorithm").agg(F.sum(t * t * t - t).alias("cubes"), F.sum(F.when(t > 1, t).otherwise(0.0)).cast("long").alias("ties"))
    sums = signed.groupBy("algorithm").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.when(F.signum("diff") == s, F.col("rank"))), F.lit(0.0)).alias(c) for s, c in ((1, "up"), (-1, "down"))])
    own = sums.join(ties, "algorithm").join(pairs, "algorithm").where("pairs > 1").withColumn("statistic", F.least("up", "down"))
    own = own.withColumn("p_raw", signed_rank_p(F.col("statistic"), F.col("n"), F.col("cubes"), F.col("zeros")))
    names = df.where(F.col("algorithm") != baseline).select("algorithm").distinct()
    return names.join(own.select("algorithm", "n", "statistic", "p_raw", "ties"), "algorithm", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def holm(tests: DataFrame, monotone: bool = False, alpha: float = 0.05) -> DataFrame:
    """tests with p_corrected and significant: by rising p, times how many are left (H2); monotone: never below an earlier one."""
    w = W.orderBy(F.col("p_raw").asc_nulls_last(), "algorithm")  # a row per algorithm
    left = F.count("p_raw").over(W.partitionBy()) - F.row_number().over(w) + 1
    out = tests.withColumn("p_corrected", F.when(F.col("p_raw").isNotNull(), F.least(F.lit(1.0), F.col("p_raw") * left)))
    if monotone:
        out = out.withColumn("p_corrected", F.when(F.col("p_raw").isNotNull(), F.max("p_corrected").over(w)))
    return out.withColumn("significant", F.coalesce(F.col("p_corrected") < alpha, F.lit(False)))


def paired_report(df: DataFrame, baseline: str) -> DataFrame:
    """The monotone Holm table with d, its size in words and shared ranks."""
    return holm(wilcoxon(df, baseline), monotone=True).join(cohen_d(df, baseline), "algorithm", "left")


def critical_difference(df: DataFrame, q: dict[int, float] = Q_05, other: float = Q_OTHER) -> DataFrame:
    """k, n and cd by Nemenyi (H3): of all algorithms and datasets, complete or not; other is used for numbers of algorithms that q lacks."""
    own = df.agg(F.count_distinct("algorithm").alias("k"), F.count_distinct("dataset").alias("n"))
    value = F.coalesce(F.create_map(*[F.lit(x) for kv in q.items() for x in kv])[F.col("k").cast("int")], F.lit(other).cast("double"))
    return own.select("k", "n", (value * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))).alias("cd"))


def separated(df: DataFrame) -> DataFrame:
    """Whether the best average rank leads the second by more than cd (H5)."""
    two = average_ranks(df).withColumn("i", F.row_number().over(W.orderBy("avg_rank", "algorithm"))).where("i <= 2").agg((F.max("avg_rank") - F.min("avg_rank")).alias("gap"))
    return two.join(F.broadcast(critical_difference(df)), F.lit(True)).select("gap", "cd", (F.col("gap") > F.col("cd")).alias("separated"))


def cohen_d(df: DataFrame, baseline: str) -> DataFrame:
    """algorithm, d (paired, 0 without spread) and size in words (H4)."""
    d = differences(df, baseline).groupBy("algorithm").agg(F.coalesce(F.try_divide(F.avg("diff"), F.stddev_samp("diff")), F.lit(0.0)).alias("d"))
    size = F.abs("d")
    return d.withColumn("size", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large"))


def quantile_bins(df: DataFrame, column: str, q: int = 4, out: str = "bin") -> DataFrame:
    """df with bin 1 to q: edges are percentiles of the rows, each bin holds its upper edge, the first its lower too."""
    edges = df.agg(F.percentile(column, F.array(*[F.lit(i / q) for i in range(1, q)])).alias("edges_"))
    place = F.size(F.filter("edges_", lambda e: F.col(column) > e)) + 1
    return df.join(F.broadcast(edges), F.lit(True)).withColumn(out, F.when(F.col(column).isNotNull(), place)).drop("edges_")


def winners(df: DataFrame) -> DataFrame:
    """dataset, algorithm and value of the best, the first by name among equals."""
    best = F.row_number().over(W.partitionBy("dataset").orderBy(F.col("value").desc_nulls_last(), "algorithm"))
    return df.withColumn("i_", best).where("i_ = 1").select("dataset", "algorithm", "value")


def bootstrap(df: DataFrame, draws: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """algorithm, mean, lower, upper: percentiles of means of rows drawn again, by md5 of draw and place.

    The draws are a row each beside each value: draws times the rows, in one shuffle by algorithm and draw.
    """
    numbered = df.select("algorithm", "value", (F.row_number().over(W.partitionBy("algorithm").orderBy("dataset")) - 1).alias("i"), F.count("*").over(W.partitionBy("algorithm")).alias("n"))
    turns = numbered.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    dice = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("b").cast("string"), F.col("i").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    drawn = turns.select("algorithm", "b", (dice % F.col("n")).alias("i"))
    means = drawn.join(numbered, ["algorithm", "i"]).groupBy("algorithm", "b").agg(F.avg("value").alias("m"))
    tail = (1 - level) / 2
    ci = means.groupBy("algorithm").agg(F.percentile("m", tail).alias("lower"), F.percentile("m", 1 - tail).alias("upper"))
    return ci.join(df.groupBy("algorithm").agg(F.avg("value").alias("mean")), "algorithm").select("algorithm", "mean", "lower", "upper")


def pearson(a: str, b: str) -> Column:
    """The correlation over rows with both, null where one of them doesn't vary."""
    x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double")) for c in (a, b))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def shared_ranks(df: DataFrame, column: str, ranges: int = 1024) -> DataFrame:
    """column and its rank of each distinct value, from 1, equal values sharing their mean: counts per value, running sums in each of so many equal ranges of values, and over the ranges."""
    per = df.groupBy(column).agg(F.count("*").alias("c_"))
    ends = df.agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"))
    place = F.least(F.lit(ranges - 1), F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("lo_"), F.col("hi_") - F.col("lo_")), F.lit(0.0)) * ranges))
    dealt = per.join(F.broadcast(ends), F.lit(True)).select(column, "c_", place.alias("p_"))
    before = dealt.groupBy("p_").agg(F.sum("c_").alias("s_")).select("p_", (F.sum("s_").over(W.orderBy("p_")) - F.col("s_")).alias("before_"))  # a row per range
    placed = dealt.withColumn("up_", F.sum("c_").over(W.partitionBy("p_").orderBy(column))).join(F.broadcast(before), "p_")
    return placed.select(column, (F.col("before_") + F.col("up_") - (F.col("c_") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho, n and p (by Student's t) of rows with both (H6). Only distinct values are ordered, range by range: no window holds all rows."""
    own = df.select(F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")).na.drop()
    r = own.join(shared_ranks(own, "a").withColumnRenamed("rank", "ra"), "a").join(shared_ranks(own, "b").withColumnRenamed("rank", "rb"), "b")
    out = r.agg(pearson("ra", "rb").alias("rho"), F.count("*").alias("n"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / ((1 - F.col("rho")) * (1 + F.col("rho"))))
    return out.withColumn("p", F.when((F.col("n") > 2) & F.col("rho").isNotNull(), student_p(F.when(F.abs("rho") < 1, t).otherwise(F.lit(float("inf"))), F.col("n") - 2)))


def kendall(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """tau b, pairs and p (H7), over pairs of rows of a small table of results: exact for up to 33 rows without ties, else the normal tail."""
    own = df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    a, b = own.alias("a"), own.alias("b")
    s = lambda c: F.signum(F.col(f"a.{c}") - F.col(f"b.{c}"))
    pairs = a.join(b, F.col(f"a.{key}") < F.col(f"b.{key}")).select(s("x").alias("sx"), s("y").alias("sy"))
    sums = pairs.agg(F.sum(F.col("sx") * F.col("sy")).alias("s"), F.sum(F.abs("sx")).alias("ux"), F.sum(F.abs("sy")).alias("uy"), F.count("*").alias("pairs"))
    for c in ("x", "y"):
        t = F.col("t").cast("double")
        of = own.groupBy(c).agg(F.count("*").alias("t"))
        sums = sums.join(F.broadcast(of.agg(F.sum(t * (t - 1) / 2).alias(f"{c}tie"), F.sum(t * (t - 1) * (t - 2)).alias(f"{c}0"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{c}1"))), F.lit(True))
    sums = sums.join(F.broadcast(own.agg(F.count("*").alias("n"))), F.lit(True))
    tau = F.try_divide(F.col("s"), F.sqrt(F.col("ux") * F.col("uy")))
    return sums.select(tau.alias("tau"), "pairs", F.when(tau.isNotNull(), kendall_p(*[F.col(c).cast("double") for c in ("s", "n", "xtie", "ytie", "x0", "y0", "x1", "y1")])).alias("p"))


def trend(df: DataFrame, first: str, second: str, along: DataFrame, by: str = "value") -> DataFrame:
    """One row (H7): how often and by how much the first algorithm leads the second, whether that follows along (dataset and by), and a verdict in words."""
    own = averaged(df).groupBy("dataset").pivot("algorithm", [first, second]).agg(F.first("value")).join(along.select("dataset", F.col(by).alias("along_")), "dataset")
    own = own.select("dataset", "along_", (F.col(f"`{first}`") - F.col(f"`{second}`")).alias("delta"), F.coalesce(F.col(f"`{first}`") > F.col(f"`{second}`"), F.lit(False)).cast("double").alias("wins"))
    out = own.agg(F.avg("wins").alias("win_rate"), F.avg("delta").alias("mean_delta"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"), F.count("*").alias("n_datasets"))
    for name, column in (("wins", "wins"), ("gain", "delta")):
        k = kendall(own, "along_", column, "dataset").select(F.col("tau").alias(f"tau_{name}"), F.col("p").alias(f"p_{name}"))
        out = out.join(F.broadcast(k), F.lit(True))
    flat = (F.abs("tau_wins") < 0.15) & (F.col("p_wins") > 0.05) & (F.col("win_rate") > 0.7)
    clear = F.col("p_wins") < 0.05
    return out.withColumn("verdict", F.when(flat, "leads everywhere").when(clear & (F.col("tau_wins") > 0), "lead grows").when(clear & (F.col("tau_wins") < 0), "lead shrinks").otherwise("no trend"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b and r of each pair of columns, over rows with both: Pearson's matrix in long form (H9). One pass over the rows."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(a, b).alias("r")) for a, b in pairs]).alias("m"))
    return one.select(F.inline("m"))


def with_metadata(df: DataFrame, metadata: DataFrame, on: str = "dataset") -> DataFrame:
    """Results with the columns of their datasets; results of unknown datasets stay, with nulls."""
    return df.join(metadata, on, "left")


def aligned(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """A row of df per row of keys, nulls where df has none: a lookup by key, in keys' columns and order columns."""
    return keys.join(df, key, "left")


def winner_map(df: DataFrame, places: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """places with the winning algorithm of each metric, a column <metric>_winner each (X8). df: dataset, algorithm and the metrics."""
    for m in metrics:
        best = winners(averaged(df.withColumn("value", F.col(m))).where("value is not null")).select("dataset", F.col("algorithm").alias(f"{m}_winner"))
        places = places.join(best, "dataset", "left")
    return places


def stress_test(placed: DataFrame, winner: str, imbalance: str, q: int = 4) -> DataFrame:
    """bin, algorithm, wins, n and share: how often each algorithm wins by quantile of the imbalance, with Wilson's interval."""
    own = quantile_bins(placed, imbalance, q).where(F.col(winner).isNotNull())
    n = own.groupBy("bin").agg(F.count("*").alias("n"))
    won = own.groupBy("bin", F.col(winner).alias("algorithm")).agg(F.count("*").alias("wins")).join(n, "bin")
    ends = wilson(F.col("wins"), F.col("n"))
    return won.select("bin", "algorithm", "wins", "n", (F.col("wins") / F.col("n")).alias("share"), ends["lower"].alias("lower"), ends["upper"].alias("upper"))


def peaks(sweep: DataFrame, at: int = 5, within: float = 0.005) -> DataFrame:
    """One row per n_votes: datasets where it is best (the smallest among equals), and, the same in all rows, those where the vote count at is within a share of the best (G17). sweep: dataset, n_votes, value."""
    best = F.max_by("n_votes", F.struct("value", -F.col("n_votes")))
    per = sweep.groupBy("dataset").agg(best.alias("peak"), F.max("value").alias("top"), F.max(F.when(F.col("n_votes") == at, F.col("value"))).alias("own"))
    close = per.agg(F.count_if((F.col("top") - F.col("own")) / F.greatest(F.col("top"), F.lit(1e-9)) < within).alias("close"), F.count("*").alias("n_datasets"))
    counts = per.groupBy(F.col("peak").alias("n_votes")).agg(F.count("*").alias("n_best"))
    grid = sweep.select("n_votes").distinct().join(counts, "n_votes", "left")
    return grid.select("n_votes", F.coalesce("n_best", F.lit(0)).alias("n_best")).join(F.broadcast(close), F.lit(True))


def line(df: DataFrame, y: str, x: str) -> DataFrame:
    """slope, intercept and r of the least-squares line."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))


def cumulative_ratio(df: DataFrame, by: str, order: Sequence[str], y: str = "y") -> DataFrame:
    """df with seen_min, seen_maj and ratio along an order within by."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumns({"seen_min": F.sum(F.col(y).cast("long")).over(w), "seen_maj": F.sum((1 - F.col(y)).cast("long")).over(w)})
    return out.withColumn("ratio", F.try_divide(F.col("seen_maj").cast("double"), F.col("seen_min").cast("double")))


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """The lower and upper end of the interval of a share (H8)."""
    p, n = wins / n, n.cast("double")
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(((middle - half) / (1 + z * z / n)).alias("lower"), ((middle + half) / (1 + z * z / n)).alias("upper"))
