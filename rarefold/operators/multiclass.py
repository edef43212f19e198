"""Neighbour votes for two and more classes: plain, weighted, with k chosen by entropy, and by corrected ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.operators.neighbours import nearest, searched


def label_votes(near: DataFrame) -> DataFrame:
    """id, y, label, n, first (rank of its nearest row) and share, from nearest()."""
    each = near.select("id", "y", F.size("near").alias("k"), F.posexplode("near").alias("rank", "x"))
    return each.groupBy("id", "y", "k", F.col("x.label").alias("label")).agg(F.count("*").alias("n"), F.min("rank").alias("first")).withColumn("share", F.col("n") / F.col("k"))


def majority_label(near: DataFrame) -> DataFrame:
    """id, y, y_pred and p (its share): the most frequent label, the nearest among equals (K1 to K3)."""
    best = F.max(F.struct("n", (-F.col("first")).alias("f"), "label", "share"))
    return label_votes(near).groupBy("id", "y").agg(best.alias("m")).select("id", "y", F.col("m.label").alias("y_pred"), F.col("m.share").alias("p"))


def label_shares(queries: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """id, y, label and share: each known label's share of the k nearest rows, 0 included; k = 0 takes all training rows (K1)."""
    labels = train.select(F.col("y").cast("int").alias("label")).distinct()  # a row per class
    if k == 0:
        n = train.groupBy(F.col("y").cast("int").alias("label")).count()
        shares = n.join(F.broadcast(n.agg(F.sum("count").alias("n"))), F.lit(True)).select("label", (F.col("count") / F.col("n")).alias("share"))
        return queries.select("id", F.col("y").cast("int").alias("y")).join(F.broadcast(shares), F.lit(True))
    found = label_votes(nearest(queries, train, k)).select(F.col("id").alias("id_"), F.col("label").alias("label_"), "share")
    every = queries.select("id", F.col("y").cast("int").alias("y")).join(F.broadcast(labels), F.lit(True))
    return every.join(found, (F.col("id") == F.col("id_")) & (F.col("label") == F.col("label_")), "left").select("id", "y", "label", F.coalesce("share", F.lit(0.0)).alias("share"))


def weighted_label(near: DataFrame, train: DataFrame) -> DataFrame:
    """Votes times n / (classes * n_class); the lowest label among equals (K5)."""
    counts = train.groupBy("y").count()
    all_of = counts.agg(F.sum("count").alias("n"), F.count("*").alias("c"))
    weights = counts.join(all_of, F.lit(True)).select(F.col("y").alias("label"), (F.col("n") / (F.col("c") * F.col("count"))).alias("w"))  # a row per class
    votes = label_votes(near).join(F.broadcast(weights), "label").withColumn("s", F.col("n") * F.col("w"))
    best = F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("label")).alias("l")))
    return votes.groupBy("id", "y").agg(best.alias("m"), F.sum("s").alias("t")).select("id", "y", (-F.col("m.l")).alias("y_pred"), (F.col("m.s") / F.col("t")).alias("p"))


def odd_floor(k: int) -> int:
    return k if k % 2 else max(1, k - 1)


def entropy_k(near: DataFrame, n_train: int, k_min: int = 1, smoothing: float = 1e-9) -> DataFrame:
    """near with k: by halves from the odd root of n_train down, while the labels' entropy rises (A1).

    The steps don't depend on the data, so each is a column.
    """
    steps, k = [], max(k_min, odd_floor(max(1, int(np.sqrt(n_train)))))
    while True:
        steps.append(k)
        nxt = max(k_min, odd_floor(k // 2))
        if nxt >= k:
            break
        k = nxt

    def entropy(k: int) -> Column:
        own = F.slice("near", 1, k)
        n = F.size(own)
        labels = F.array_distinct(F.transform(own, lambda x: x["label"]))
        p = F.transform(labels, lambda c: F.size(F.filter(own, lambda x: x["label"] == c)) / n + smoothing)
        whole = 1 + smoothing * F.size(labels)
        return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x / whole * F.log2(x / whole))

    out = near.withColumns({f"h{k}": entropy(k) for k in steps})
    found: Column = F.lit(steps[-1])
    for a, b in reversed(list(zip(steps, steps[1:], strict=False))):
        found = F.when(F.col(f"h{b}") > F.col(f"h{a}"), found).otherwise(F.lit(a))
    return out.withColumn("k", found).drop(*[f"h{k}" for k in steps])


def ratios(counts: dict[int, int]) -> dict[int, float]:
    """k of each class: its rows by the median class's, 1 at least (M1)."""
    middle = max(1.0, float(np.median(list(counts.values()))))
    return {c: max(1.0, n / middle) for c, n in counts.items()}


def at_rank(near: Column, k: Column) -> Column:
    """The distance at a fractional rank from 1, between neighbours in proportion."""
    at = F.greatest(F.lit(0.0), F.least(k - 1, (F.size(near) - 1).cast("double")))
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(near, lo)["d"], F.get(near, hi)["d"]
    return F.when(lo == hi, a).otherwise((1 - (at - lo)) * a + (at - lo) * b)


def ranked_label(queries: DataFrame, train: DataFrame, *, n_votes: int = 5, buffer: int = 5, floor: int = 5, cap: int = 500, excluded: bool = False) -> DataFrame:
    """id, y, y_pred and p: rounds in which the class wins whose row at rank i k is nearest (M1), or the same once without each class (M2).

    Counts of classes are all that reaches the driver.
    """
    counts = {r[0]: r[1] for r in train.groupBy("y").count().collect()}
    runs = [[c for c in counts if c != x] for x in counts] if excluded and len(counts) > 2 else [list(counts)]
    own = ratios(counts)
    plans = [(k, c, ratios({x: counts[x] for x in run})[c]) for k, run in enumerate(runs) for c in run]
    if excluded:  # all that n_votes rounds of any run reach
        fetch = {c: min(max(int(np.ceil(k * n_votes)) for _, x, k in plans if x == c), counts[c]) for c in counts}
    else:
        fetch = {c: min(min(max(int(np.ceil(own[c])) * n_votes + buffer, floor), cap), counts[c]) for c in counts}
    lists = searched(queries, train, fetch)
    rows = counts if excluded else fetch  # M2 may use whole classes, M1 what it fetched
    rounds = [max(1, min(n_votes, *[int(rows[c] / k) for r, c, k in plans if r == run])) for run in range(len(runs))]
    plan = queries.sparkSession.createDataFrame([(r, c, k, rounds[r]) for r, c, k in plans], "run int, label int, k double, rounds int")  # a row per class and run
    each = lists.join(F.broadcast(plan), "label").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    dist = each.withColumn("d", at_rank(F.col("near"), F.col("i") * F.col("k")))
    wins = dist.groupBy("id", "y", "run", "rounds", "i").agg(F.min(F.struct("d", "label")).alias("m"))
    shares = wins.groupBy("id", "y", F.col("m.label").alias("label")).agg(F.sum(1 / F.col("rounds")).alias("s"))
    best = F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("label")).alias("l")))
    return shares.groupBy("id", "y").agg(best.alias("m"), F.sum("s").alias("t")).select("id", "y", (-F.col("m.l")).cast("int").alias("y_pred"), (F.col("m.s") / F.col("t")).alias("p"))


def lodo(table: DataFrame, k: int = 5) -> DataFrame:
    """Each row's label from the k nearest other rows."""
    return majority_label(nearest(table, table, k, "id"))


def left_out_label(queries: DataFrame, train: DataFrame, *, n_votes: int = 5, buffer: int = 5, floor: int = 5, cap: int = 500, probe: int | None = None) -> DataFrame:
    """id, y, y_pred and p: the rounds of ranked_label, averaged over leaving out each of the nearest fetched rows (M3; all of them unless probe says how many)."""
    counts = {r[0]: r[1] for r in train.groupBy("y").count().collect()}
    k = ratios(counts)
    fetch = {c: min(min(max(int(np.ceil(k[c])) * n_votes + buffer, floor), cap), counts[c]) for c in counts}
    lists = searched(queries, train, fetch).groupBy("id", "y").agg(F.collect_list(F.struct("label", F.transform("near", lambda x: x["d"]).alias("d"))).alias("lists"))  # a list per class

    def tried(lists: dict[int, np.ndarray]) -> dict[int, float]:
        live = {c: d for c, d in lists.items() if len(d)}
        rounds = max(1, min([n_votes, *[int(len(d) // k[c]) for c, d in live.items()]]))
        won = dict.fromkeys(live, 0.0)
        for i in range(1, rounds + 1):
            won[min(live, key=lambda c: (np.interp(i * k[c] - 1, np.arange(len(live[c])), live[c]), c))] += 1 / rounds  # noqa: B023
        return won

    def each(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for own in batch["lists"]:
                base = {int(x["label"]): np.asarray(x["d"]) for x in own}
                rows = sorted((d, c, i) for c, ds in base.items() for i, d in enumerate(ds))[:probe]
                total = dict.fromkeys(base, 0.0)
                for _, c, i in rows:
                    for label, w in tried(base | {c: np.delete(base[c], i)}).items():
                        total[label] += w / len(rows)
                best = min(total, key=lambda c: (-round(total[c], 9), c))  # noqa: B023
                out.append((best, round(total[best], 9)))
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "y_pred": [a for a, _ in out], "p": [b for _, b in out]})

    return lists.mapInPandas(each, "id long, y int, y_pred int, p double")
