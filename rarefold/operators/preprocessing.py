"""Preparation that is fitted on training rows alone (P1 to P10, P14): one pass of aggregates over the training rows for all columns, joined back as one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def binarised(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """df with y: 1 for the rarer of two labels, the first in order among equals; groups without exactly two labels fail."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("c_"))
    rare = counts.groupBy(*by).agg(F.min(F.struct("c_", label)).alias("m_"), F.count("*").alias("n_"))
    own = F.when(F.col("n_") != 2, F.raise_error(F.lit("a table needs exactly two labels"))).otherwise(F.col(f"m_.{label}"))
    rare = rare.select(*by, own.alias("rare_"))
    out = df.join(rare, list(by)) if by else df.join(F.broadcast(rare), F.lit(True))  # one row where there are no groups
    return out.withColumn("y", (F.col(label) == F.col("rare_")).cast("int")).drop("rare_")


def _fitted(df: DataFrame, train: Column, aggs: list[Column]) -> DataFrame:
    """df joined with one row of aggregates over the rows where train holds."""
    return df.join(F.broadcast(df.where(train).agg(*aggs)), F.lit(True))


def standardised(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Columns less the training mean, by the training deviation of the population, or by 1 where that is 0."""
    own = _fitted(df, train, [f(c).alias(f"{p}_{c}") for c in columns for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in columns}
    return own.withColumns(z).select(*df.columns)


def standardised_vectors(df: DataFrame, train: Column, v: str = "v") -> DataFrame:
    """The same for an array column, place by place."""
    stats = df.where(train).select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    fit = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("fit_"))  # as many structs as a vector has places
    z = F.zip_with(F.col(v), F.col("fit_"), lambda x, f: (x - f["m"]) / F.when(f["s"] > 0, f["s"]).otherwise(1.0))
    return df.join(F.broadcast(fit), F.lit(True)).withColumn(v, z).drop("fit_")


def varying(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    """column and deviation, of the columns that vary over the (training) rows (P3, P5): whose least and greatest numbers differ, as merged means of one number may miss it by a digit."""
    own = df.where(train) if train is not None else df
    return own.agg(*[F.when(F.min(c) < F.max(c), F.stddev_pop(c)).alias(c) for c in columns]).unpivot([], list(columns), "column", "deviation").where("deviation > 0")


def without_constants(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    keep = {r["column"] for r in varying(df, columns, train).select("column").collect()}  # names of columns
    return df.drop(*[c for c in columns if c not in keep])


def median_imputed(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Missing numbers become the training median."""
    own = _fitted(df, train, [F.percentile(c, 0.5).alias(f"m_{c}") for c in columns])
    return own.withColumns({c: F.coalesce(F.col(c), F.col(f"m_{c}")) for c in columns}).select(*df.columns)


def mode_imputed(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Missing words become the most frequent of the training rows, the first in order among equals; columns without any word stay empty, and have no place in features()."""
    out, keep = df, []
    for c in columns:
        top = df.where(train & F.col(c).isNotNull()).groupBy(c).count().groupBy().agg(F.min(F.struct(-F.col("count"), F.col(c).alias("v")))["v"].alias(f"m_{c}"))
        out = out.join(F.broadcast(top), F.lit(True))  # one row
        keep.append(c)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"m_{c}")) for c in keep})
    return out.select(*df.columns)


def one_hot(df: DataFrame, columns: Sequence[str], train: Column, out: str = "hot") -> DataFrame:
    """df with an array of 0 and 1: for each column its training words in order; unknown words and nulls are all 0."""
    own = _fitted(df, train, [F.array_sort(F.collect_set(c)).alias(f"w_{c}") for c in columns])
    each = [_hot(c) for c in columns]
    return own.withColumn(out, F.concat(*each) if each else F.array().cast("array<double>")).select(*df.columns, out)


def _hot(c: str) -> Column:
    return F.transform(F.col(f"w_{c}"), lambda w: F.coalesce((w == F.col(c)).cast("double"), F.lit(0.0)))


def features(df: DataFrame, numbers: Sequence[str], words: Sequence[str], train: Column, out: str = "v") -> DataFrame:
    """The whole preparation of a fold (P4 to P9): impute, drop constants, one-hot, put together, scale.

    One aggregate of the training rows fits all numbers, and one a column of words
    its counts; means and deviations after imputation follow from these. The rows
    are then read once, beside these few broadcast rows.
    """
    num = lambda c: F.col(c).cast("double")
    fits = [F.struct(F.percentile(num(c), 0.5).alias("m"), F.count(c).alias("k"), F.avg(num(c)).alias("a"), F.var_pop(num(c)).alias("v"), (F.max(num(c)) > F.min(num(c))).alias("keep")).alias(f"f_{c}") for c in numbers]
    own = df.join(F.broadcast(df.where(train).agg(F.count("*").alias("n_"), *fits)), F.lit(True))
    for c in words:
        counts = df.where(train & F.col(c).isNotNull()).groupBy(c).count()
        top = F.min(F.struct(-F.col("count"), F.col(c).alias("w")))["w"]
        own = own.join(F.broadcast(counts.agg(F.array_sort(F.collect_list(F.struct(F.col(c).alias("w"), F.col("count").alias("k")))).alias(f"w_{c}"), top.alias(f"m_{c}"), F.sum("count").alias(f"k_{c}"))), F.lit(True))  # a row; a word each

    def number(c: str) -> Column:
        f, n = F.col(f"f_{c}"), F.col("n_")
        miss = n - f["k"]
        mean = (f["k"] * f["a"] + miss * f["m"]) / n
        var = (f["k"] * (f["v"] + (f["a"] - mean) * (f["a"] - mean)) + miss * (f["m"] - mean) * (f["m"] - mean)) / n
        return F.struct(F.coalesce(f["keep"], F.lit(False)).alias("keep"), F.try_divide(F.coalesce(num(c), f["m"]) - mean, F.sqrt(var)).alias("x"))

    def word(c: str) -> Column:
        top, n = F.col(f"m_{c}"), F.col("n_")
        value = F.coalesce(F.col(c), top)

        def one(w: Column) -> Column:
            p = (w["k"] + F.when(w["w"] == top, n - F.col(f"k_{c}")).otherwise(0)) / n
            sd = F.sqrt(p * (1 - p))
            return ((value == w["w"]).cast("double") - p) / F.when(sd > 0, sd).otherwise(1.0)

        return F.transform(F.coalesce(F.col(f"w_{c}"), F.array().cast(f"array<struct<w:{df.schema[c].dataType.simpleString()},k:bigint>>")), one)

    left = F.transform(F.filter(F.array(*map(number, numbers)), lambda x: x["keep"]), lambda x: x["x"]) if numbers else F.array().cast("array<double>")
    return own.withColumn(out, F.concat(left, *map(word, words))).select(*df.columns, out)


def degenerate(df: DataFrame, by: str, folds: int, label: str = "y") -> tuple[DataFrame, DataFrame]:
    """The groups with at least twice as many rare rows as folds, and the others (P10)."""
    few = df.groupBy(by).agg(F.count_if(F.col(label) == 1).alias("n_min"))
    good = few.where(F.col("n_min") >= 2 * folds)
    return df.join(good, by, "left_semi"), df.join(good, by, "left_anti")


def numbered(df: DataFrame, key: str, out: str, shares: int = 256) -> DataFrame:
    """df with out, from 0 without gaps, by md5 share of key and then key: a window in each share, and one over the counts of shares."""
    share = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % shares
    own = df.withColumn("share_", share)
    before = own.groupBy("share_").agg(F.count("*").alias("n_")).select(F.col("share_").alias("s_"), (F.sum("n_").over(W.orderBy("share_")) - F.col("n_")).alias("before_"))  # a row per share
    placed = own.withColumn("at_", F.row_number().over(W.partitionBy("share_").orderBy(key)) - 1)
    return placed.join(F.broadcast(before), F.col("share_") == F.col("s_")).withColumn(out, F.col("before_") + F.col("at_")).drop("share_", "s_", "before_", "at_")


def oversampled(train: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """train (id, y, v) with rare rows added up to parity: row j of them lies between a rare row and one of its k nearest, all by md5 of j (P14). Under two rare rows give train as it is."""
    from rarefold.operators.neighbours import nearest, sizes

    s = sizes(train)
    if s.n_min < 2 or s.n_maj <= s.n_min:
        return train
    rare = train.where("y = 1")
    n = max(1, min(k, s.n_min - 1))
    near = nearest(rare, rare, n, "id").select(F.col("id"), "near")
    near = numbered(near, "id", "rank")
    dice = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("-", F.col("j").cast("string"), F.lit(str(seed)), F.lit(salt))), 1, 8), 16, 10).cast("long")
    new = train.sparkSession.range(s.n_maj - s.n_min).withColumnRenamed("id", "j")
    new = new.withColumns({"rank": dice("base") % s.n_min, "pick": (dice("pick") % n).cast("int"), "gap": dice("gap") / F.lit(2.0**32)})
    new = new.join(near, "rank").withColumn("to", F.get("near", F.col("pick"))["id"])
    of = lambda a: rare.select(F.col("id").alias(a), F.col("v").cast("array<double>").alias(f"v_{a}"))
    new = new.join(of("id"), "id").join(of("to"), "to")
    made = F.zip_with(F.col("v_id"), F.col("v_to"), lambda a, b: a + (b - a) * F.col("gap"))
    return train.select("id", "y", F.col("v").cast("array<double>").alias("v")).unionByName(new.select((-1 - F.col("j")).alias("id"), F.lit(1).alias("y"), made.alias("v")))
