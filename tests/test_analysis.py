"""Preparation, metrics, statistics, results on disk and geometry, against hand counts and published values."""

import math
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rarefold.functions import geometry, pvalues
from rarefold.operators import benchmark, local_models, meta, metrics, preprocessing, ranking
from rarefold.sources.tables import LabelledTable, ResultStore, Settings, csv_folder, exported, labelled, summary, target_column

PREPARED = "id long, a double, w string, y int, test boolean"


@pytest.fixture(scope="module")
def table(spark):
    data = [(0, 1.0, "x", 0, False), (1, None, "y", 0, False), (2, 3.0, "x", 1, False), (3, 8.0, None, 0, False), (4, None, "new", 1, True), (5, 2.0, None, 0, True)]
    return spark.createDataFrame(data, PREPARED)


def values(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


def test_preparation_uses_training_rows_only(table):
    train = ~F.col("test")
    assert values(preprocessing.median_imputed(table, ["a"], train), "a") == [1.0, 3.0, 3.0, 8.0, 3.0, 2.0]
    assert values(preprocessing.mode_imputed(table, ["w"], train), "w") == ["x", "y", "x", "x", "new", "x"]
    assert values(preprocessing.one_hot(table, ["w"], train), "hot")[:5] == [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    z = values(preprocessing.standardised(table, ["a"], train), "a")
    own = np.array([1.0, 3.0, 8.0])
    assert math.isclose(z[0], (1 - own.mean()) / own.std()) and z[1] is None
    one = table.withColumn("c", F.lit(5.0))
    assert "c" not in preprocessing.without_constants(one, ["a", "c"], train).columns
    v = preprocessing.features(one, ["a", "c"], ["w"], train)
    assert len(values(v, "v")[0]) == 3 and np.allclose(np.array(values(v, "v"))[:4].mean(axis=0), 0)


def test_binarised_ties_and_failures(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",)], "l string")
    assert sorted((r["l"], r["y"]) for r in preprocessing.binarised(df, "l").collect()) == [("a", 1), ("a", 1), ("b", 0), ("b", 0)]
    with pytest.raises(Exception, match="two labels"):
        preprocessing.binarised(df.where("l = 'a'"), "l").collect()


def test_oversampled_reaches_parity(spark):
    rng = np.random.default_rng(0)
    data = [(i, int(i < 6), rng.standard_normal(2).tolist()) for i in range(30)]
    out = preprocessing.oversampled(spark.createDataFrame(data, "id long, y int, v array<double>"))
    assert out.where("y = 1").count() == 24 and out.where("y = 0").count() == 24
    rare = np.array([v for _, y, v in data if y])
    new = np.array([r["v"] for r in out.where("id < 0").collect()])
    assert (new >= rare.min(axis=0) - 1e-9).all() and (new <= rare.max(axis=0) + 1e-9).all()


def test_metrics_by_hand(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    df = spark.createDataFrame([("g", int(a), float(b), int(b > 0.5)) for a, b in zip(y, p, strict=True)] + [("one", 1, 0.3, 0)], "g string, y int, score double, y_pred int")
    auc = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, ["g"]).collect()}
    want = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert math.isclose(auc["g"], want) and auc["one"] is None
    assert math.isclose(benchmark.auc(y, p), want)
    ap = {r["g"]: r["pr_auc"] for r in metrics.average_precision(df, ["g"]).collect()}
    area = sum(((p >= t) & (y == 1)).sum() / (p >= t).sum() * ((p == t) & (y == 1)).sum() for t in np.unique(p)) / y.sum()
    assert math.isclose(ap["g"], area) and math.isclose(benchmark.precision_area(y, p), area)
    s = metrics.scores(metrics.confusion(df, ["g"])).where("g = 'g'").first()
    tp, fn = ((p > 0.5) & (y == 1)).sum(), ((p <= 0.5) & (y == 1)).sum()
    assert math.isclose(s["recall"], tp / (tp + fn)) and math.isclose(s["mcc"], np.corrcoef(y, p > 0.5)[0, 1])
    none = metrics.scores(metrics.confusion(df.where("g = 'one'"), ["g"]), "null").first()
    assert none["precision"] is None and none["mcc"] == 0


def test_tails():
    assert math.isclose(pvalues.normal_two_sided((224 - 39 * 40 / 4) / math.sqrt(39 * 40 * 79 / 24)), 0.020529367233119, rel_tol=1e-9)
    assert math.isclose(pvalues.normal_two_sided((55 - 39 * 40 / 4) / math.sqrt(39 * 40 * 79 / 24)), 2.94062e-06, rel_tol=1e-4)
    assert math.isclose(pvalues.chi2_upper(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(pvalues.chi2_upper(9.487729036781154, 4), 0.05, rel_tol=1e-9)
    assert math.isclose(pvalues.chi2_upper(11.070497693516351, 5), 0.05, rel_tol=1e-9)


@pytest.fixture(scope="module")
def results(spark):
    rng = np.random.default_rng(7)
    data = [(f"d{i}", a, float(np.round(rng.random() + k / 10, 1))) for i in range(12) for k, a in enumerate("abc")]
    return pd.DataFrame(data, columns=["dataset", "algorithm", "value"]), spark.createDataFrame(data, "dataset string, algorithm string, value double")


def test_ranks_and_tests(results):
    pdf, df = results
    pdf = pdf.copy()
    pdf["rank"] = pdf.groupby("dataset")["value"].rank(ascending=False)
    want = pdf.groupby("algorithm")["rank"].mean()
    assert {r["algorithm"]: r["avg_rank"] for r in ranking.average_ranks(df).collect()} == pytest.approx(want.to_dict())
    r = pdf.pivot(index="dataset", columns="algorithm", values="rank").to_numpy()
    n, k = r.shape
    ties = sum((c**3 - c) for row in r for c in np.unique(row, return_counts=True)[1])
    stat = (12 / (n * k * (k + 1)) * (r.sum(axis=0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
    got = ranking.friedman(df).first()
    assert got["statistic"] == pytest.approx(stat) and got["p"] == pytest.approx(math.exp(-stat / 2))
    tests = ranking.holm(ranking.wilcoxon(df, "a"), monotone=True).collect()
    wide = pdf.pivot(index="dataset", columns="algorithm", values="value")
    for t in tests:
        d = (wide[t["algorithm"]] - wide["a"]).to_numpy()
        d = d[d != 0]
        rk = pd.Series(np.abs(d)).rank().to_numpy()
        assert t["statistic"] == min(rk[d > 0].sum(), rk[d < 0].sum()) and t["n"] == len(d)
        assert t["p_raw"] <= t["p_corrected"] <= 1
    cd = ranking.critical_difference(df).first()
    assert cd["cd"] == pytest.approx(2.343 * math.sqrt(3 * 4 / (6 * 12)))
    d = {r["algorithm"]: r["d"] for r in ranking.cohen_d(df, "a").collect()}
    diff = wide["b"] - wide["a"]
    assert d["b"] == pytest.approx(diff.mean() / diff.std())
    bins = ranking.quantile_bins(df, "value").toPandas()
    assert (bins["bin"] - 1 == pd.qcut(bins["value"], 4, labels=False, duplicates="drop")).all()
    ci = {r["algorithm"]: (r["lower"], r["mean"], r["upper"]) for r in ranking.bootstrap(df, 200).collect()}
    assert all(lo < m < hi for lo, m, hi in ci.values())


def test_incomplete_datasets_drop_out(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 2.0), ("e", "a", 1.0), ("e", "b", None)], "dataset string, algorithm string, value double")
    assert ranking.complete(df).select("dataset").distinct().collect()[0][0] == "d"
    assert ranking.ranks(df).where("dataset = 'e' and algorithm = 'b'").first()["rank"] is None


def test_csv_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x.1,w,binaryClass\n" + "\n".join(f"{i},{'u' if i % 2 else ''},{'P' if i < 4 else 'N'}" for i in range(20)))
    (tmp_path / "b.csv").write_text("x,label\n1,0\n2,1\n")
    (tmp_path / "c.csv").write_text("x,y,last\n" + "\n".join(f"{i},{i},{i % 3}" for i in range(30)))
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "dataset_1039_hiva_agnostic.csv").write_text("x,binaryClass\n" + "\n".join(f"{i},{i % 2}" for i in range(20)))
    tables = csv_folder(spark, str(tmp_path))
    assert [t.name for t in tables] == ["a"]
    t = tables[0]
    assert (t.numbers, t.words, t.ratio_min_maj) == (["x_1"], ["w"], 0.25)
    assert summary(tables).first()["r_maj_min"] == 4
    assert target_column(["p", "q"]) == "q" and target_column(["class", "binaryClass"]) == "binaryClass"
    assert labelled(spark.createDataFrame([(1,)], "x int"), "n", Settings()) is None


def test_benchmark_store(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(float(v), None if i % 9 == 0 else "uv"[i % 2], int(i < 12)) for i, v in enumerate(rng.standard_normal(60) + np.repeat([2.0, 0.0], [12, 48]))]
    t = LabelledTable("t", spark.createDataFrame(rows, "a double, w string, y int"), 0.25, ["a"], ["w"])
    store = ResultStore(spark, str(tmp_path / "r"))
    assert store.load() is None and store.backup() is None
    broken = local_models.MODELS | {"broken": lambda f: 1 / 0}
    out = benchmark.run_benchmark(spark, [t], store, ["knn", "broken"], models=broken, n_folds=3, n_repeats=2)
    assert out.where("algorithm = 'knn' and error is null").count() == 6
    assert out.where("error like 'ZeroDivisionError%' and tp is null").count() == 6
    sums = out.where("algorithm = 'knn'").agg(F.sum("tp") + F.sum("fn"), F.sum("tn") + F.sum("fp")).first()
    assert tuple(sums) == (24, 96)
    benchmark.run_benchmark(spark, [t], store, ["knn"], n_folds=3, n_repeats=2)
    assert store.load().where("algorithm = 'knn'").count() == 6
    store.save("one")
    assert store.drop("algorithm", ["broken", "none"]) == (["broken"], ["none"])
    assert store.load().select("algorithm").distinct().count() == 1 and store.snapshots() == ["one"]
    store.restore("one")
    assert store.load().count() == 12


def test_loops_are_reduced_only_where_bounds_leave_it_open(monkeypatch):
    rng, plain, asked = np.random.default_rng(3), geometry.loops, []
    monkeypatch.setattr(geometry, "loops", lambda d: asked.append(len(d)) or plain(d))
    for n, dims in ((3, 1), (12, 2), (18, 3), (18, 8)):
        x = rng.standard_normal((n, dims)).round(1)
        d = geometry.pairwise(x, x)
        total = np.ptp(plain(d), axis=1).sum()
        for share in (0.0, 0.3, 0.9, 1.1):
            assert geometry.looped(d, total * share) == (total > total * share)
    x, y = rng.standard_normal((400, 32)), np.arange(400) % 20 == 0
    f = local_models.Fold(x, y.astype(int), x[:6])
    asked.clear()
    got = [local_models.topology_k(f, own) for own in f.nearest(19)]
    assert len(asked) < 3  # of six lists
    monkeypatch.setattr(local_models, "looped", lambda d, least: np.ptp(plain(d), axis=1).sum() > least)
    assert got == [local_models.topology_k(f, own) for own in f.nearest(19)]


def test_ward_searches_many_clusters_at_once():
    x, calls = np.random.default_rng(4).standard_normal((600, 8)), []
    sys.setprofile(lambda frame, event, _: calls.append(1) if event == "call" and frame.f_code.co_filename == geometry.__file__ and frame.f_code.co_name[0] != "<" else None)
    try:
        merges, heights = geometry.ward(x)
    finally:
        sys.setprofile(None)
    assert len(calls) < 100 and len(merges) == 599  # not a search for each merge
    for few in (np.repeat(x[:9], 3, axis=0), np.stack(np.meshgrid(range(5), range(5)), axis=-1).reshape(-1, 2)):
        merges, heights = geometry.ward(few)
        assert len(merges) == len(few) - 1 and (np.diff(heights) >= 0).all() and len(np.unique(geometry.cut(len(few), merges, len(few) - 3))) == 3


def test_trees_and_loops():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((15, 2)), rng.standard_normal((15, 2)) + 20])
    d = geometry.pairwise(x, x)
    edges = geometry.tree_edges(d)
    assert len(edges) == 29 and edges[-1] == d[:15, 15:].min()
    merges, heights = geometry.ward(x)
    assert (np.diff(heights) >= -1e-12).all() and len(set(geometry.cut(30, merges, 28)[:15])) == 1
    gap = x[:15].mean(axis=0) - x[15:].mean(axis=0)
    assert heights[-1] == pytest.approx(math.sqrt(2 * 15 * 15 / 30 * (gap @ gap)))
    square = np.array([[0.0, 0], [1, 0], [1, 1], [0, 1]])
    assert np.allclose(geometry.loops(geometry.pairwise(square, square)), [[1, math.sqrt(2)]])
    ring = np.array([[math.cos(t), math.sin(t)] for t in np.linspace(0, 2 * math.pi, 12, endpoint=False)])
    assert len(geometry.loops(geometry.pairwise(ring, ring))) == 1
    assert (local_models.regions(x) == np.repeat(local_models.regions(x)[[0, 15]], 15)).all()
    centres, label = geometry.k_means(x, 2, 1)
    assert len(set(label[:15])) == 1 and label[0] != label[15]


def test_table_features(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((50, 3)) + 1
    df = spark.createDataFrame([(i, int(i < 10), r.tolist()) for i, r in enumerate(x)], "id long, y int, v array<double>")
    one = meta.table_features(df).first()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert one["mean_skew"] == pytest.approx(np.abs((z**3).mean(axis=0)).mean()) and one["log_imbalance"] == pytest.approx(math.log(4))
    axes, share = meta.principal(df, 3)
    values = np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1]
    assert np.allclose(share, values / values.sum())
    assert np.allclose(np.array([r["pc"] for r in meta.projected(df, axes).orderBy("id").collect()]), x @ axes.T)
    assert {r["y"]: r["components"] for r in meta.effective_dimension(df).collect()} == {c: geometry.components_for(x[:10] if c else x[10:]) for c in (0, 1)}


def plain_signed_rank(d):
    """The chance by going through all signs of the ranks."""
    import itertools

    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return w, min(1.0, 2 * sum(x <= w for x in sums) / len(sums))


def test_signed_ranks_are_exact_without_ties_and_folds_are_averaged(spark):
    rng = np.random.default_rng(5)
    rows = [(f"d{i}", a, float(rng.random() + (a == "b") * 0.2)) for i in range(9) for a in "abc"]
    folds = [(d, a, v + e) for d, a, v in rows for e in (-0.25, 0.25)]
    schema = "dataset string, algorithm string, value double"
    pdf = pd.DataFrame(rows, columns=["dataset", "algorithm", "value"]).pivot(index="dataset", columns="algorithm", values="value")
    for data in (rows, folds):
        df = spark.createDataFrame(data, schema)
        got = {r["algorithm"]: r for r in ranking.wilcoxon(df, "a").collect()}
        for a in "bc":
            w, p = plain_signed_rank((pdf[a] - pdf["a"]).round(12).to_numpy())
            assert (got[a]["statistic"], got[a]["ties"]) == (w, 0) and got[a]["p_raw"] == pytest.approx(p)
        assert ranking.critical_difference(df).first()["n"] == 9
        assert ranking.friedman(df).first()["n"] == 9
    assert pvalues.signed_rank_two_sided(1, 6) == 4 / 64
    lone = spark.createDataFrame([*rows, ("d0", "same", rows[0][2]), ("d1", "same", rows[3][2]), ("d0", "once", 1.0)], schema)
    got = {r["algorithm"]: r for r in ranking.holm(ranking.wilcoxon(lone, "a")).collect()}
    assert got["same"]["p_raw"] is None and got["once"]["statistic"] is None and not got["once"]["significant"]
    assert got["b"]["p_corrected"] <= min(1, 2 * got["b"]["p_raw"]) and ranking.critical_difference(lone).first()["n"] == 9
    with pytest.raises(ValueError, match="baseline"):
        ranking.wilcoxon(lone, "unknown")


def test_chances_of_rank_correlations(spark):
    import itertools

    for n, s in ((4, 4), (5, -6), (6, 1)):
        top = n * (n - 1) // 2
        all_s = [sum(np.sign(b - a) for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        if (s - top) % 2 == 0:
            assert pvalues.kendall_two_sided(s, n) == pytest.approx(np.mean([abs(x) >= abs(s) for x in all_s]))
    # by hand: for 2 degrees of freedom the tail is 1 - t / sqrt(t^2 + 2), for 1 it is 1 - 2 atan(t) / pi
    for t in (0.1, 1.0, 4.0, 30.0):
        assert pvalues.student_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(t * t + 2))
        assert pvalues.student_two_sided(-t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi)
    data = [(i, float(i % 7), float((i * i) % 11)) for i in range(40)] + [(40, None, 1.0)]
    got = ranking.spearman(spark.createDataFrame(data, "k long, x double, y double"), "x", "y").first()
    x, y = (pd.Series([r[c] for r in data[:40]]).rank() for c in (1, 2))
    assert got["n"] == 40 and got["rho"] == pytest.approx(x.corr(y))
    t = got["rho"] * math.sqrt(38 / (1 - got["rho"] ** 2))
    assert got["p"] == pytest.approx(pvalues.student_two_sided(t, 38))
    tau = ranking.kendall(spark.createDataFrame(data[:12], "k long, x double, y double"), "x", "y", "k").first()
    assert 0 < tau["p"] <= 1 and abs(tau["tau"]) < 1


def test_breaks_are_the_widest_gaps_with_enough_rows():
    """Against taking gaps by width, each if all parts keep enough rows."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        v = np.sort(rng.choice([rng.random(30), rng.random(30) ** 4, np.round(rng.random(30) * 6)]))
        got = local_models.breaks(v, 4, 0.1)
        gaps, kept = np.diff(v) / max(v[-1] - v[0], 1e-12), []
        for p in sorted(range(1, len(v)), key=lambda p: (-gaps[p - 1], -p)):
            if gaps[p - 1] >= 0.1 and min(np.diff([0, *sorted([*kept, p]), len(v)])) >= 4:
                kept.append(p)
        assert got == sorted(kept)


@pytest.mark.parametrize("strategy", ["entropy", "eigen"])
def test_adaptive_metric(strategy):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((60, 4))
    fold = local_models.Fold(x, (x[:, 0] + x[:, 1] > 0).astype(int), x[:9], 1)
    for k_max in (None, 7):
        p = local_models.adaptive_metric(fold, strategy, 1, k_max)
        assert p.shape == (9,) and ((p >= 0) & (p <= 1)).all()
    assert (local_models.two_anchors(fold, 1, 9, 5) >= 0).all()


def test_a_store_outlives_a_change_that_stops_half_way(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame([("d", "a", 1.0), ("d", "b", 2.0)], "dataset string, algorithm string, value double"))
    store._copy(store.load().where("algorithm = 'a'"), "next")
    fs, path = store._fs()
    fs.delete(path(f"{store.path}/current"), True)
    assert [r["algorithm"] for r in store.load().collect()] == ["a"]
    exported(store.load().select("dataset", "value"), str(tmp_path / "csv"), ["dataset"])
    (one,) = (tmp_path / "csv").glob("*.csv")
    assert one.read_text().splitlines() == ["dataset,value", "d,1.0"]


def test_numbers_without_gaps(spark):
    got = sorted(r["n"] for r in preprocessing.numbered(spark.range(1000).repartition(5), "id", "n").collect())
    assert got == list(range(1000))


def test_csv_tables_of_any_size_are_found(spark, tmp_path):
    for t, n in (("customer", 50_001), ("supplier", 20)):
        spark.range(n).selectExpr("id AS key", "id AS name", "concat('w', id) AS w", f"IF(id % 4 = 0, -1.0D, 1.0D) AS {t[0]}_acctbal").write.parquet(str(tmp_path / f"{t}.parquet"))
    from rarefold.plans.queries import QUERIES

    assert sorted(r["n"] for r in QUERIES["s1_csv_tables"](spark, str(tmp_path)).collect()) == [20, 50_001]


def test_exponents_are_of_whole_vectors(spark, tmp_path):
    from rarefold.functions.geometry import components_for
    from rarefold.plans import queries

    rng = np.random.default_rng(9)
    label, x = np.arange(375) % 4, rng.standard_normal((375, 12))
    x[:, :10] *= 0.01
    x[label == 1, 11] *= 0.01  # the places that count are beyond the eighth
    data = [(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(label, x, strict=True))]
    spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["dataset"]: r["ratio"] for r in queries.QUERIES["z8_exponents"](spark, str(tmp_path)).collect()}
    t = np.arange(375) % 5 != 0
    want = {f"label {c}": components_for(x[t & (label == c)]) / components_for(x[t & (label != c)]) for c in range(4)}
    assert got == pytest.approx(want) and len(set(got.values())) > 1


def test_columns_of_one_number_do_not_vary_however_rows_are_dealt(spark):
    # 8 parts of 49 rows: 1 / 49 * 49 is below 1
    df = spark.range(0, 8 * 49, 1, 8).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    assert [r["column"] for r in preprocessing.varying(df, ["a", "b"]).collect()] == ["a"]
