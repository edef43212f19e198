"""A query per operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.functions import geometry
from rarefold.operators import benchmark, local_models, meta, metrics, multiclass, preprocessing, ranking, selection, studies, votes
from rarefold.operators.neighbours import TRAIN_BLOCK, class_lists, joined, nearest, sizes
from rarefold.plans.views import counts, documents, load, results, vectors
from rarefold.sources import shared
from rarefold.sources.tables import LabelledTable, ResultStore, Settings, completed, csv_folder, exported, summary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ALGORITHMS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to so many places, as sums may run in another order elsewhere."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


# votes over the vectors


def voting(name: str, of: Callable[[DataFrame, object], DataFrame], n_votes: int = 5, k_maj: Callable | None = None, k_min: Callable | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, t = vectors(spark, sf_dir)
        s = sizes(t, n_votes=n_votes)
        return rounded(of(class_lists(q, t, k_min(s) if k_min else s.k_min_eff, k_maj(s) if k_maj else s.k_maj), s))

    run.__name__ = name
    query(run)


voting("f2_rank_vote", votes.single)
voting("f5_rank_vote_soft", lambda d, s: votes.single(d, s, soft=True))
voting("e1_rank_vote_pooled", votes.pooled, max(votes.N_VOTES))
voting("e2_rank_vote_pooled_soft", votes.pooled_soft)
voting("f8_rank_vote_density", votes.by_density, k_maj=votes.density_k_maj)
voting("l1_rank_vote_local_odds", votes.by_local_odds)
voting("l2_rank_vote_local_count", votes.by_local_count, k_min=lambda s: max(s.k_min_eff, votes.reference_count(s)))
voting("r1_rank_vote_left_out", votes.left_out)
voting("r2_rank_vote_left_out_grid", lambda d, s: votes.left_out(d, s, "grid"))
voting("r3_rank_vote_left_out_odds", lambda d, s: votes.left_out(d, s, "odds"))
voting("z5_counted_k", lambda d, s: meta.counted_k(d, 5))


def choosing(name: str, alphas: Sequence[float], n_votes: Sequence[int], of: Callable | None, scoring: str = "geometric_mean") -> None:
    """of: the vote with the chosen cell; None gives the grid itself."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, t = vectors(spark, sf_dir)
        grid = selection.grid_scores(selection.folds(t, 3), alphas, n_votes, scoring, whole=of is votes.bayesian)
        if of is None:
            return rounded(selection.chosen(grid, "n_votes", "alpha")).select("n_votes", "alpha", "score", "chosen")
        cell = selection.best(grid, "n_votes", "alpha")
        s = sizes(t, n_votes=max(n_votes))
        k_min = max(s.k_min_eff, votes.reference_count(s)) if of is votes.bayesian else s.k_min_eff
        return rounded(of(class_lists(q, t, k_min, s.k_maj), s, cell["alpha"], cell["n_votes"]))

    run.__name__ = name
    query(run)


def chosen_vote(soft: bool = False) -> Callable:
    return lambda d, s, a, n: votes.decided(d, votes.share(votes.votes(F.col("dmin"), F.col("dmaj"), votes.power(s, a), n, soft)))


choosing("f6_alpha_grid", votes.ALPHAS, (5,), None)
choosing("f6a_joint_grid_mcc", votes.ALPHAS, votes.N_VOTES, None, "mcc")
choosing("f6a_joint_grid_combined", votes.ALPHAS, votes.N_VOTES, None, "combined")
choosing("f6a_joint_grid_utopia", votes.ALPHAS, votes.N_VOTES, None, "utopia")
choosing("e3_votes_grid", (1.0,), votes.N_VOTES, None)
choosing("e4_joint_grid", votes.ALPHAS, votes.N_VOTES, None)
choosing("f6_rank_vote_alpha", votes.ALPHAS, (5,), chosen_vote())
choosing("f7_rank_vote_alpha_soft", votes.ALPHAS, (5,), chosen_vote(True))
choosing("e3_rank_vote_votes", (1.0,), votes.N_VOTES, chosen_vote())
choosing("e4_rank_vote_joint", votes.ALPHAS, votes.N_VOTES, chosen_vote())
choosing("l3_rank_vote_bayesian", votes.ALPHAS, votes.N_VOTES, votes.bayesian)


@query
def f0_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sizes(vectors(spark, sf_dir)[1])
    return spark.createDataFrame([(s.n_min, s.n_maj, round(s.r, 9), s.k_min_eff, s.k_maj)], "n_min long, n_maj long, r double, k_min_eff int, k_maj int")


@query
def k2_knn_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiclass.majority_label(nearest(*vectors(spark, sf_dir), 5))


@query
def j1_knn_any_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pluggable distance: the same answer as k2."""
    return multiclass.majority_label(joined(*vectors(spark, sf_dir), 5))


@query
def k5_knn_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = vectors(spark, sf_dir)
    return rounded(multiclass.weighted_label(nearest(q, t, 5), t))


@query
def k4_knn_best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = vectors(spark, sf_dir)[1]
    grid = selection.k_scores(selection.folds(t, 3), selection.odd_up_to(int(t.count() ** 0.5)))
    return rounded(selection.chosen(grid, "k")).select("k", "score", "chosen")


@query
def z9_fixed_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.k_scores(selection.folds(vectors(spark, sf_dir)[1], 3), (1, 3, 5, 7, 11, 21), "f1"))


@query
def a1_knn_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = vectors(spark, sf_dir, classes=True)
    n = t.count()
    own = multiclass.entropy_k(nearest(q, t, max(1, int(n**0.5))), n).withColumn("near", F.slice("near", F.lit(1), F.col("k")))
    return multiclass.majority_label(own).join(own.select("id", "k"), "id")


@query
def m1_rank_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multiclass.ranked_label(*scaled(spark, sf_dir)))


@query
def m2_rank_label_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multiclass.ranked_label(*scaled(spark, sf_dir), excluded=True))


@query
def m3_rank_label_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiclass.left_out_label(*scaled(spark, sf_dir))


def scaled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, t = vectors(spark, sf_dir, classes=True)
    own = preprocessing.standardised_vectors(q.withColumn("train", F.lit(False)).unionByName(t.withColumn("train", F.lit(True))), F.col("train"))
    return own.where("not train").drop("train"), own.where("train").drop("train")


@query
def f4_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(meta.dimensions(vectors(spark, sf_dir)[1]), 6)


@query
def l5_rank_vote_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = vectors(spark, sf_dir)
    s, spread = sizes(t), meta.dimension_spread(t).first()["spread"]
    return rounded(votes.single(class_lists(q, t, s.k_min_eff, s.k_maj), s, alpha=min(1.0, max(0.0, 1 - 0.75 * spread))))


def local(name: str, model: str) -> None:
    """A numpy model on one training set, with queries dealt to tasks: each reads the training rows from the shared folder, and meets its queries part by part. Long fits are dealt to tasks before, which leave their numbers there too."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, t = vectors(spark, sf_dir)
        n = max(8, spark.sparkContext.defaultParallelism)
        path = shared.stored(t, "train", n)
        jobs, job, fitted = local_models.DEALT.get(model, (None,) * 3)

        def training() -> tuple[np.ndarray, np.ndarray] | None:
            rows = [(shared.matrix(b["v"]), b["y"].to_numpy()) for b in shared.read(path, TRAIN_BLOCK)]
            return tuple(map(np.concatenate, zip(*rows, strict=True))) if rows else None

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for number in batch["id"]:
                    if rows := training():
                        yield pd.DataFrame({"id": [number], "v": [job(local_models.Fold(*rows, rows[0][:0]), int(number))]})

        done = None
        if jobs:
            many = jobs(t.count())
            done = shared.stored(spark.range(0, many, 1, many).mapInPandas(work, "id long, v array<double>"), "fitted", 1)

        def fit(a: pd.DataFrame) -> pd.DataFrame:
            if not (rows := training()):
                return pd.DataFrame({"id": [], "y": [], "frac": [], "y_pred": []})
            whole = local_models.Fold(*rows, np.stack(a["v"].to_numpy()))
            if done:
                fitted(whole, [np.array(v.as_py(), float) for b in shared.read(done, TRAIN_BLOCK) for v in b["v"]])
            p = np.concatenate([local_models.MODELS[model](f) for f in whole.parts(searched=model in local_models.SEARCHED)])
            return pd.DataFrame({"id": a["id"], "y": a["y"], "frac": p, "y_pred": (p > 0.5).astype(int)})

        return q.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("part")).applyInPandas(fit, "id long, y int, frac double, y_pred int")

    run.__name__ = name
    query(run)


for _name, _model in (
    ("a2_knn_components", "knn_components"),
    ("a3_knn_topology", "knn_topology"),
    ("a4_knn_two_anchors", "knn_two_anchors"),
    ("k6_knn_local_metric", "knn_local_metric"),
    ("k6_knn_local_metric_entropy", "knn_local_metric_entropy"),
    ("k6_knn_local_metric_eigen", "knn_local_metric_eigen"),
    ("l4_rank_vote_density_regions", "rank_density_regions"),
    ("t1_rank_vote_regions", "rank_regions"),
    ("t2_rank_vote_trusted_regions", "rank_trusted_regions"),
    ("t3_rank_vote_scale", "rank_scale"),
    ("p15_synthetic_best_k", "knn_synthetic_best_k"),
):
    local(_name, _model)


@query
def p14_oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = vectors(spark, sf_dir)
    return multiclass.majority_label(nearest(q, preprocessing.oversampled(t), 5))


@query
def s1_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds over labelled documents with preparation in each, for some models."""
    own = documents(spark, sf_dir)
    table = LabelledTable("documents", own.select("n_chars", "blanks", "fixed", "lang", "source", "y"), 0.15, ["n_chars", "blanks", "fixed"], ["lang", "source"])
    models = {k: local_models.MODELS[k] for k in ("knn", "rank", "rank_pooled")}
    return benchmark.evaluate(benchmark.samples([table]), models, n_folds=5, n_repeats=1)


# preparation


@query
def p1_binarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocessing.binarised(documents(spark, sf_dir).drop("y"), "quality").select("id", "y")


@query
def p2_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocessing.standardised(documents(spark, sf_dir), ["blanks"], ~F.col("test")).select("id", "blanks"), 7)


@query
def p3_varying(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocessing.varying(documents(spark, sf_dir), ["n_chars", "blanks", "fixed"], ~F.col("test")), 6)


@query
def p4_median_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocessing.median_imputed(documents(spark, sf_dir), ["n_chars"], ~F.col("test")).select("id", "n_chars")


@query
def p6_mode_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocessing.mode_imputed(documents(spark, sf_dir), ["lang"], ~F.col("test")).select("id", "lang")


@query
def p7_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = preprocessing.one_hot(documents(spark, sf_dir), ["lang"], ~F.col("test"))
    return own.select("id", F.array_join(F.transform("hot", lambda x: x.cast("int").cast("string")), "").alias("hot"))


@query
def p9_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = preprocessing.features(documents(spark, sf_dir), ["n_chars", "blanks", "fixed"], ["lang"], ~F.col("test"))
    return rounded(own.select("id", F.posexplode("v").alias("place", "x")), 7)


@query
def p10_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "purchase").cast("int").alias("y"))
    good, bad = preprocessing.degenerate(own, "user_id", 2)
    return good.select("user_id", F.lit(True).alias("usable")).unionByName(bad.select("user_id", F.lit(False).alias("usable"))).distinct()


@query
def p12_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query
def s9_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two algorithms dropped from a result store, which is read again."""
    return stored(spark, sf_dir, lambda store: store.drop("algorithm", ["click", "view", "unknown"])).withColumnRenamed("algorithm", "event_type")


def stored(spark: SparkSession, sf_dir: str, change: Callable[[ResultStore], object]) -> DataFrame:
    """Counts by algorithm of a store of events after a change. The store lies in the folder that the cluster names, or under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    store = ResultStore(spark, f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}")
    store.append(load(spark, sf_dir, "events").select(F.col("event_type").alias("algorithm"), F.lit("events").alias("dataset"), "value", (F.col("event_id") % 10).alias("fold")))
    change(store)
    return store.load().groupBy("algorithm").agg(F.count("*").alias("n"))


@query
def s1_csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of any size written as CSV, found again as labelled ones, and summed up."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/tables-{uuid.uuid4().hex}"
    for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal")):
        own = load(spark, sf_dir, t)
        own.select(*own.columns[2:], (F.col(c) < 0).cast("int").alias("target")).coalesce(1).write.mode("append").option("header", True).csv(path)
    found = summary(csv_folder(spark, path, Settings(most_rows=None)))
    return rounded(found.drop("dataset"))


@query
def s4_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, lambda store: None).withColumnRenamed("algorithm", "event_type")


@query
def s10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot, a deletion, and the snapshot restored."""

    def change(store: ResultStore) -> None:
        store.save("whole")
        store.drop("algorithm", ["click"])
        store.restore("whole")

    return stored(spark, sf_dir, change).withColumnRenamed("algorithm", "event_type")


@query
def s12_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as CSV, read again."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/csv-{uuid.uuid4().hex}"
    exported(ranking.average_ranks(results(spark, sf_dir)), path, ["algorithm"])
    return rounded(spark.read.option("header", True).schema("algorithm string, avg_rank double").csv(path))


# metrics


def confused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(counts(spark, sf_dir), ["dataset", "algorithm"])


@query
def g1_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confused(spark, sf_dir)


@query
def g2_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(counts(spark, sf_dir), ["algorithm"]))


@query
def g3_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(counts(spark, sf_dir), ["algorithm"]))


for _name, _guard in (("g5_metrics_null", "null"), ("g5b_metrics_zero", "zero"), ("g5c_metrics_eps", "eps")):

    def _metrics(spark: SparkSession, sf_dir: str, guard: str = _guard) -> DataFrame:
        return rounded(metrics.scores(confused(spark, sf_dir), guard).drop("tp", "tn", "fp", "fn", "combined"))

    _metrics.__name__ = _name
    query(_metrics)


@query
def g9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rates(confused(spark, sf_dir), ["algorithm"]))


# result tables


def over_results(name: str, of: Callable[[DataFrame], DataFrame], digits: int = 9) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(of(results(spark, sf_dir)), digits)

    run.__name__ = name
    query(run)


def quartiles(df: DataFrame) -> DataFrame:
    p = F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return df.groupBy("algorithm").agg(p.alias("p")).select("algorithm", *[F.get("p", F.lit(i)).alias(f"q{c}") for i, c in enumerate((25, 50, 75))])


def deltas(df: DataFrame) -> DataFrame:
    d = ranking.differences(df, "5-LOW")
    return d.groupBy("algorithm").agg(F.avg("diff").alias("delta"), F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") < 0).alias("losses"))


def win_rates(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    own = ranking.quantile_bins(ranking.winners(df), "value").groupBy("bin", "algorithm").agg(F.count("*").alias("wins"))
    return own.withColumn("rate", F.col("wins") / F.sum("wins").over(W.partitionBy("bin")))


def paired(df: DataFrame) -> DataFrame:
    own = df.groupBy("dataset").pivot("algorithm", ["1-URGENT", "5-LOW"]).agg(F.avg("value"))
    return ranking.kendall(own, "1-URGENT", "5-LOW", "dataset")


over_results("g8_pivot", lambda d: ranking.pivoted(d, ALGORITHMS), 6)
over_results("g11_quartiles", quartiles, 6)
over_results("g12_deltas", deltas, 6)
over_results("g13_winners", ranking.winners, 6)
over_results("g13_win_rates", win_rates)
over_results("g14_bootstrap", lambda d: ranking.bootstrap(d, 2000), 5)
over_results("w3_average_ranks", ranking.average_ranks)
over_results("w4_quantile_bins", lambda d: ranking.quantile_bins(d, "value").drop("value"))
over_results("h1_friedman", ranking.friedman, 7)
over_results("h2_wilcoxon", lambda d: ranking.wilcoxon(d, "5-LOW"))
over_results("h2_wilcoxon_holm", lambda d: ranking.holm(ranking.wilcoxon(d, "5-LOW")))
over_results("h2a_wilcoxon_holm_monotone", lambda d: ranking.paired_report(d, "5-LOW"))
over_results("h3b_critical_difference_report", lambda d: ranking.critical_difference(d, ranking.Q_05_REPORT, ranking.Q_OTHER_REPORT))
over_results("h3_critical_difference", ranking.critical_difference)
over_results("h4_cohen_d", lambda d: ranking.cohen_d(d, "5-LOW").drop("size"))
over_results("h5_separated", ranking.separated)
over_results("h7_kendall", lambda d: paired(d).drop("p"))


@query
def g7_two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "events").select(F.col("user_id").alias("dataset"), F.col("event_type").alias("algorithm"), "value")
    return rounded(ranking.two_level_mean(own), 7)


@query
def g15_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("n_maj"), F.count_if(F.col("y") == 1).alias("n_min"))


@query
def g16_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many common rows a vote asks for, how many it gets, and whether that is fewer than it asks."""
    own = g15_summary(spark, sf_dir)
    asked = F.ceil(F.col("n_maj") / F.greatest(F.lit(1), F.col("n_min"))) * 5 + 10
    return own.select("source", asked.alias("asked"), F.least(F.greatest(asked, F.lit(30)), F.lit(1000), F.col("n_maj")).alias("used"), (asked > F.col("n_maj")).alias("short"))


@query
def g18_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ranking.line(documents(spark, sf_dir), "blanks", "n_chars")
    return own.select(F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r", 9).alias("r"))


@query
def g19_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completed(load(spark, sf_dir, "events").select(F.col("user_id").alias("dataset"), F.col("event_type").alias("algorithm")), 3)


@query
def w6_cumulative_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ranking.cumulative_ratio(documents(spark, sf_dir), "source", ["blanks", "id"])
    return rounded(own.select("source", "id", "seen_min", "seen_maj", "ratio"))


@query
def h6_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.spearman(documents(spark, sf_dir), "n_chars", "blanks").drop("p"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of the result table with features: dataset, id, v (customers, their mean balance and its spread, scaled by hand) and imbalance."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    own = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("dataset"), F.col("n_nationkey").cast("long").alias("id"))
    per = own.agg(F.count("*").cast("double").alias("a"), F.avg("c_acctbal").alias("b"), F.avg((F.col("c_acctbal") < 0).cast("double")).alias("c"))
    return per.select("dataset", "id", F.array(F.ln("a"), F.col("b") / 1000, F.col("c") * 10).alias("v"), (F.col("a") / (1 + F.col("c") * F.col("a"))).alias("imbalance"))


@query
def h7_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ranking.trend(results(spark, sf_dir), "1-URGENT", "5-LOW", nations(spark, sf_dir), "imbalance")
    return rounded(own.drop("p_wins", "p_gain", "verdict"), 6)


@query
def h7_trend_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.trend(results(spark, sf_dir), "1-URGENT", "5-LOW", nations(spark, sf_dir), "imbalance"))


@query
def h9_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.correlations(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query
def j9_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results beside their datasets' features, of which some datasets have none."""
    known = nations(spark, sf_dir).where("id % 3 <> 0").select("dataset", "id", "imbalance")
    return rounded(ranking.with_metadata(results(spark, sf_dir), known), 6)


@query
def j11_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances by nation, in the order of the customers' nations."""
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("suppliers"), F.sum("s_acctbal").alias("balance"))
    return rounded(ranking.aligned(s.where("id % 4 <> 0"), nations(spark, sf_dir).select("id", "dataset"), "id"), 4)


@query
def x8_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = results(spark, sf_dir).select("dataset", "algorithm", F.col("value").alias("high"), (-F.col("value")).alias("low"))
    return rounded(ranking.winner_map(o, nations(spark, sf_dir).select("dataset", "imbalance"), ["high", "low"]), 6)


@query
def x8_stress_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.stress_test(x8_footprints(spark, sf_dir), "high_winner", "imbalance"))


@query
def x9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best priority of a nation told from the others by its customers."""
    return rounded(studies.selection_accuracy(nations(spark, sf_dir), studies.choices(results(spark, sf_dir))))


@query
def x9_selection_by_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")).where("id < 12")
    return rounded(studies.selection_accuracy(nations(spark, sf_dir).join(own, "id", "left_semi"), studies.choices(results(spark, sf_dir)), studies.LEARNERS["ranks"]))


@query
def x10_duel(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = results(spark, sf_dir)
    return rounded(studies.selection_accuracy(nations(spark, sf_dir), studies.duel(own, *studies.leading_pair(own))))


def told_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features and label: which of the two leading priorities is better in a nation."""
    from pyspark.ml.functions import array_to_vector

    own = results(spark, sf_dir)
    rows = nations(spark, sf_dir).join(studies.duel(own, *studies.leading_pair(own)), "dataset")
    return rows.select(array_to_vector("v").alias("features"), F.col("label").cast("double").alias("label")).orderBy("id")


@query
def x11_learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nations two of the meta-learners tell, of those that they have learnt; boosted trees and the linear machine take minutes of small jobs."""
    data, out = told_apart(spark, sf_dir).cache(), None
    for name in ("logistic", "forest"):
        learner = meta.learners()[name]
        one = learner.fit(data).transform(data).agg(F.lit(name).alias("learner"), F.count_if(F.col("prediction") == F.col("label")).alias("right"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@query
def x12_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, rows = told_apart(spark, sf_dir).cache(), []
    for name in ("logistic", "forest"):
        rows += [(name, f, float(v)) for f, v in meta.importances(meta.learners()[name].fit(data), data, ["customers", "balance", "debtors"])]
    return spark.createDataFrame(rows, "learner string, feature string, importance double")


@query
def h8_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = counts(spark, sf_dir).groupBy("algorithm").agg(F.count_if(F.col("y") == 1).alias("w"), F.count("*").alias("n"))
    return rounded(own.select("algorithm", ranking.wilson(F.col("w"), F.col("n")).alias("c")).select("algorithm", "c.lower", "c.upper"))


@query
def g6_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    own = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag")).agg(F.avg("l_discount").alias("mean"), F.count("*").alias("n"))
    return rounded(own.withColumn("place", F.row_number().over(W.orderBy(F.col("n").desc(), "status", "flag"))), 7)


@query
def g10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


def label_tables(spark: SparkSession, sf_dir: str, labels: Sequence[int]) -> dict[str, DataFrame]:
    """A table per label: that label against the rest."""
    t = vectors(spark, sf_dir, classes=True)[1]
    return {f"label {c}": t.withColumn("y", (F.col("y") == c).cast("int")) for c in labels}


@query
def g17_votes_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean score of each number of votes on each of three tables, the best of each, and how many are within half a percent with five."""
    out = None
    for name, t in label_tables(spark, sf_dir, (0, 1, 2)).items():
        one = selection.grid_scores(selection.folds(t, 5), (1.0,), (1, 2, 3, 5, 7, 10, 15), whole=True).select(F.lit(name).alias("dataset"), "n_votes", F.round("score", 12).alias("value"))
        out = one if out is None else out.unionAll(one)
    return ranking.peaks(out)


@query
def z4_noise_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that noise needs, by rows and places."""
    cells = [(n, p) for n in (20, 50, 200) for p in (2, 8, 32)]
    return studies.simulated(spark, cells, ("n", "p"), lambda n, p: iter([(n, p, geometry.noise_components(n, p))]), "n long, p long, components double")


@query
def z6_odds_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.odds_errors(spark))


@query
def z7_rank_one_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.rank_one_ratios(spark))


@query
def z8_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole vectors; a label with fewer rows than places has no ratio."""
    return rounded(studies.exponents_and_dimensions(label_tables(spark, sf_dir, (0, 1, 2, 3))))


@query
def z8_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.exponent_correlations(z8_exponents(spark, sf_dir)))


@query
def z10_bias_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.bias_curve(spark))


@query
def k1_label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = vectors(spark, sf_dir, classes=True)
    return rounded(multiclass.label_shares(q, t, 7))


@query
def k1_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = vectors(spark, sf_dir, classes=True)
    return rounded(multiclass.label_shares(q, t, 0))


@query
def z11_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level means of the datasets with ten rows at least, and how they differ from those of all."""
    own = load(spark, sf_dir, "events").select(F.col("user_id").alias("dataset"), F.col("event_type").alias("algorithm"), "value")
    return rounded(ranking.covered(own, own, 10), 7)


@query
def w7_rank_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of distances of equal ranks, averaged over queries."""
    q, t = vectors(spark, sf_dir)
    own = class_lists(q, t, 5, 5).select(F.posexplode(F.arrays_zip("dmin", "dmaj")).alias("rank", "d"))
    return rounded(own.groupBy((F.col("rank") + 1).alias("rank")).agg(F.avg(F.col("d.dmin") / F.col("d.dmaj")).alias("ratio")), 7)


# features of tables


def meta_sweep(t: DataFrame) -> DataFrame:
    return studies.dimension_sweep(t, (5, 10, 20, 50, 100, 200, 500))


def over_vectors(name: str, of: Callable[[DataFrame], DataFrame], digits: int = 9) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(of(vectors(spark, sf_dir)[1]), digits)

    run.__name__ = name
    query(run)


over_vectors("x5_histogram_entropy", meta.histogram_entropy)
over_vectors("x6_graph_features", meta.graph_features)
over_vectors("z1_dimension_sweep", meta_sweep, 6)
over_vectors("z2_effective_dimension", meta.effective_dimension)


@query
def x1_table_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = meta.table_features(vectors(spark, sf_dir)[1])
    return own.select(*[F.round(c, 6 if c.startswith("mean") else 9).alias(c) for c in own.columns])


@query
def z3_neighbour_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.neighbour_slope(vectors(spark, sf_dir)[1]).select(F.round("slope", 7).alias("slope"), F.round("dimension", 5).alias("dimension"))


@query
def x7_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = scaled(spark, sf_dir)
    axes, _ = meta.principal(t)
    return rounded(meta.projected(q, axes).select("id", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2")), 6)


@query
def x9_lodo(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = multiclass.lodo(vectors(spark, sf_dir, classes=True)[1])
    most = own.groupBy("y").count().agg(F.max("count").alias("m"))
    right = own.agg(F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return rounded(right.join(F.broadcast(most), F.lit(True)).select("accuracy", (F.col("m") / F.col("n")).alias("baseline"), "n"))
