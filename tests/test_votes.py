"""Votes and neighbour lists in Spark against the numpy models of one training set."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefold.functions import distance, geometry
from rarefold.operators import local_models as lm
from rarefold.operators import multiclass, neighbours, selection, votes


def cloud(seed=0, n=120, rare=24, dims=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    y = np.zeros(n, int)
    y[:rare] = 1
    x[:rare] += 1.2
    return x, y, rng.standard_normal((25, dims)) + 0.5


def frame(spark, x, y=None, start=0):
    data = [(start + i, int(y[i]) if y is not None else 0, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "id long, y int, v array<double>")


@pytest.fixture(scope="module")
def task(spark):
    x, y, q = cloud()
    return x, y, q, frame(spark, q, start=1000), frame(spark, x, y)


def fractions(df):
    return np.array([r["frac"] for r in df.orderBy("id").collect()])


CASES = [
    ("rank", votes.single, 5),
    ("rank_soft", lambda d, s: votes.single(d, s, soft=True), 5),
    ("rank_pooled", votes.pooled, 10),
    ("rank_pooled_soft", votes.pooled_soft, 5),
    ("rank_density", votes.by_density, 5),
    ("rank_local_odds", votes.by_local_odds, 5),
    ("rank_local_count", votes.by_local_count, 5),
    ("rank_left_out", votes.left_out, 5),
    ("rank_left_out_grid", lambda d, s: votes.left_out(d, s, "grid"), 5),
    ("rank_left_out_odds", lambda d, s: votes.left_out(d, s, "odds"), 5),
]


@pytest.mark.parametrize("name,of,n", CASES, ids=[c[0] for c in CASES])
def test_variants_agree_with_numpy(task, name, of, n):
    x, y, q, dq, dt = task
    s = neighbours.sizes(dt, n_votes=n)
    k_maj = votes.density_k_maj(s) if name == "rank_density" else s.k_maj
    got = fractions(of(neighbours.class_lists(dq, dt, s.k_min_eff, k_maj), s))
    assert np.allclose(got, lm.MODELS[name](lm.Fold(x, y, q)), atol=1e-12)


def test_blocks_give_the_same_lists(task, monkeypatch):
    _, _, _, dq, dt = task
    want = {r["id"]: (r["dmin"], r["dmaj"]) for r in neighbours.class_lists(dq, dt, 7, 30).collect()}
    near = {r["id"]: r["near"] for r in neighbours.nearest(dq, dt, 9).collect()}
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 17)
    assert {r["id"]: (r["dmin"], r["dmaj"]) for r in neighbours.class_lists(dq, dt, 7, 30).collect()} == want
    assert {r["id"]: r["near"] for r in neighbours.nearest(dq, dt, 9).collect()} == near


@pytest.mark.parametrize("shift,scale", [(0, 1), (1e6, 1), (0, 1e25), (0, 1e-25)])
@pytest.mark.parametrize("k", [3, 40, 700])
def test_lists_are_exact_in_single_precision(shift, scale, k, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((600, 5)), 1)  # with equal distances
    x, own = np.concatenate([x, x[:60]]) * scale + shift, rng.integers(0, 3, 660)
    q, mine, full, kinds = x[::40], own[::40], neighbours.distances, []
    made = neighbours.Rough.__init__
    monkeypatch.setattr(neighbours.Rough, "__init__", lambda self, t, kind: kinds.append(kind) or made(self, t, kind))
    lists = neighbours.Lists(q, k, mine)
    for i in range(0, 660, 110):
        lists.add(x[i : i + 110], np.zeros(110, int), np.arange(i, i + 110), own[i : i + 110])
    for row, (d, at) in enumerate(zip(*lists.of(0), strict=True)):
        want = full(q[row], x)
        order = np.argsort(np.where(own == mine[row], np.inf, want), kind="stable")[: min(k, int((own != mine[row]).sum()))]
        assert at.tolist() == order.tolist() and d.tolist() == want[order].tolist()
    assert (np.float64 in kinds) == (abs(np.log10(scale)) > 20) or shift


def test_majorities_leave_tasks_as_numbers(task):
    _, _, _, dq, dt = task
    near = {r["id"]: [n["label"] for n in r["near"]] for r in neighbours.nearest(dq, dt, 9).collect()}
    ks = [1, 2, 4, 9]
    got = {r["id"]: r["said"] for r in neighbours.majorities(dq, dt, ks).collect()}
    assert got == {i: [int(sum(own[:k]) * 2 > k) if sum(own[:k]) * 2 != k else own[0] for k in ks] for i, own in near.items()}
    alone = selection.fold_of(dt.limit(1), 1)
    assert [r["said"] for r in neighbours.majorities(alone, alone, ks, "fold").collect()] == [[-1] * 4]
    plan = selection.k_scores(selection.folds(dt, 3), ks)._jdf.queryExecution().optimizedPlan().toString()
    assert "near" not in plan and "said" in plan


def test_any_distance(task):
    x, _, q, dq, dt = task
    for of, plain in ((distance.euclidean, lambda d: np.sqrt((d**2).sum(-1))), (distance.manhattan, lambda d: np.abs(d).sum(-1)), (distance.minkowski(3), lambda d: (np.abs(d) ** 3).sum(-1) ** (1 / 3))):
        want = np.argsort(plain(q[:, None] - x[None]), axis=1)[:, :4]
        got = [[n["id"] for n in r["near"]] for r in neighbours.joined(dq, dt, 4, of).orderBy("id").collect()]
        assert (np.array(got) == want).all()


def test_far_pairs_are_dropped_before_they_are_ranked(spark):
    rng = np.random.default_rng(8)
    x, q = rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 4, (20, 3)).astype(float)  # many ties
    dt, dq = frame(spark, x), frame(spark, q, start=1000)
    assert not [w for w in ("Cartesian", "NestedLoop") if w in neighbours.joined(dq, dt, 5)._jdf.queryExecution().toString()]
    for of, rows, k in ((distance.manhattan, 300, 5), (distance.manhattan, 7, 5), (distance.cosine, 300, 3)):
        d = of(F.col("a.v"), F.col("b.v")).alias("d")
        pairs = dq.alias("a").join(dt.where(F.col("id") < rows).alias("b")).select(F.col("a.id").alias("q"), d, F.col("b.id").alias("t")).collect()
        got = {r["id"]: [(n["d"], n["id"]) for n in r["near"]] for r in neighbours.joined(dq, dt.where(F.col("id") < rows), k, of).collect()}
        for i in got:
            assert got[i] == sorted([(r["d"], r["t"]) for r in pairs if r["q"] == i], key=lambda p: (p[0] is not None, p))[:k]
        assert len(got) == 20


def test_empty_classes(spark):
    one = frame(spark, np.zeros((3, 2)), np.zeros(3))
    s = neighbours.sizes(one)
    got = votes.single(neighbours.class_lists(frame(spark, np.ones((2, 2)), start=9), one, s.k_min_eff, s.k_maj), s)
    assert [(r["frac"], r["y_pred"]) for r in got.collect()] == [(0.0, 0)] * 2


def test_one_comparison_where_the_list_is_short(spark):
    row = spark.createDataFrame([([1.0, 2.0], [1.5, 3.0])], "a array<double>, b array<double>")
    got = row.select(votes.votes(F.col("a"), F.col("b"), 7.0).alias("v")).first()["v"]
    assert (got["wins"], got["n"]) == (1.0, 1)
    assert lm.vote(np.array([1.0, 2.0]), np.array([1.5, 3.0]), 7) == (1.0, 1)
    half = row.select(votes.votes(F.col("a"), F.col("b"), 2.5).alias("v")).first()["v"]  # 2.5 rounds to 2
    assert half["n"] == 1 and half["wins"] == 1.0


def test_selection_by_inner_folds(task):
    x, y, _, _, dt = task
    t = selection.folds(dt, 3)
    sizes = {r["fold"]: r["count"] for r in t.where("y = 1").groupBy("fold").count().collect()}
    assert set(sizes.values()) == {8}
    grid = selection.grid_scores(t, (0.5, 1.0), (1, 5))
    part = {r["id"]: r["fold"] for r in t.collect()}
    fold = np.array([part[i] for i in range(len(y))])
    for r in grid.collect():
        want = np.mean([lm.g_mean(y[fold == f], lm.ranked(lm.Fold(x[fold != f], y[fold != f], x[fold == f]), r["alpha"], r["n_votes"])) for f in range(3)])
        assert abs(r["score"] - want) < 1e-12
    best = selection.best(grid, "n_votes", "alpha")
    assert best["score"] == max(r["score"] for r in grid.collect())
    ks = selection.k_scores(t, [1, 3, 5]).collect()
    for r in ks:
        want = np.mean([lm.g_mean(y[fold == f], lm.plain(lm.Fold(x[fold != f], y[fold != f], x[fold == f]), r["k"])) for f in range(3)])
        assert abs(r["score"] - want) < 1e-12


def test_plain_and_weighted_votes(task):
    x, y, q, dq, dt = task
    near = neighbours.nearest(dq, dt, 5)
    got = [r["y_pred"] for r in multiclass.majority_label(near).orderBy("id").collect()]
    assert got == (lm.plain(lm.Fold(x, y, q)) > 0.5).astype(int).tolist()
    got = [r["y_pred"] for r in multiclass.weighted_label(near, dt).orderBy("id").collect()]
    assert got == (lm.weighted(lm.Fold(x, y, q)) > 0.5).astype(int).tolist()


def test_entropy_k(task):
    x, y, q, dq, dt = task
    own = multiclass.entropy_k(neighbours.nearest(dq, dt, 10), len(y))
    got = [sum(n["label"] for n in r["near"][: r["k"]]) / r["k"] for r in own.orderBy("id").collect()]
    assert np.allclose(got, lm.by_entropy(lm.Fold(x, y, q)))


def plain_rank_label(x, y, q, n_votes=5):
    counts = {c: int((y == c).sum()) for c in np.unique(y)}
    k = multiclass.ratios(counts)
    out = []
    for p in q:
        d = {c: np.sort(np.linalg.norm(x[y == c] - p, axis=1))[: min(max(int(np.ceil(k[c])) * 5 + 5, 5), 500)] for c in counts}
        rounds = max(1, min([n_votes, *[int(len(d[c]) // k[c]) for c in counts]]))
        wins = [min(counts, key=lambda c: (np.interp(i * k[c] - 1, np.arange(len(d[c])), d[c]), c)) for i in range(1, rounds + 1)]
        out.append(min(counts, key=lambda c: (-wins.count(c), c)))
    return out


def test_many_classes(spark):
    rng = np.random.default_rng(4)
    y = np.repeat([0, 1, 2], [40, 12, 8])
    x = rng.standard_normal((60, 2)) + y[:, None]
    q = rng.standard_normal((15, 2)) + 1
    dq, dt = frame(spark, q, start=100), frame(spark, x, y)
    got = [r["y_pred"] for r in multiclass.ranked_label(dq, dt).orderBy("id").collect()]
    assert got == plain_rank_label(x, y, q)
    for other in (multiclass.ranked_label(dq, dt, excluded=True), multiclass.left_out_label(dq, dt)):
        labels = {r["y_pred"] for r in other.collect()}
        assert labels <= {0, 1, 2} and len(labels) > 1


@pytest.mark.parametrize("name", sorted(lm.MODELS))
def test_every_model_tells_parted_classes(name):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((20, 3)) * 0.3 + 8, rng.standard_normal((80, 3)) * 0.3])
    y = np.repeat([1, 0], [20, 80])
    p = lm.MODELS[name](lm.Fold(x, y, np.array([[8.0, 8, 8], [0.0, 0, 0]])))
    assert p.shape == (2,) and p[0] > 0.5 >= p[1]


@pytest.mark.parametrize("name", ["knn_topology", "knn_components", "knn_two_anchors", "rank_regions", "rank_scale", "rank"])
def test_equal_rows_do_not_fail(name):
    p = lm.MODELS[name](lm.Fold(np.ones((20, 3)), np.repeat([0, 1], [18, 2]), np.ones((2, 3))))
    assert p.shape == (2,) and np.isfinite(p).all()


def test_lid(spark):
    d = [0.0, 0.5, 1.0, 2.0]
    got = spark.createDataFrame([(d,), ([1.0],), ([2.0, 2.0],)], "d array<double>").select(votes.lid(F.col("d")).alias("l")).collect()
    assert np.allclose([r["l"] for r in got], [1 / np.mean(np.log(2.0 / np.array([0.5, 1.0]))), 1.0, 2.0])


def test_lists_without_classes_take_what_their_rounds_reach(task, monkeypatch):
    *_, dq, dt = task
    dt = dt.withColumn("y", F.col("id").cast("int") % 3)
    asked, search = [], multiclass.searched
    monkeypatch.setattr(multiclass, "searched", lambda q, t, k: asked.append(k) or search(q, t, k))
    got = multiclass.ranked_label(dq, dt, excluded=True).orderBy("id").collect()
    assert max(asked[0].values()) == 5  # of 40 rows a class
    monkeypatch.setattr(multiclass, "searched", lambda q, t, k: search(q, t, 40))
    assert multiclass.ranked_label(dq, dt, excluded=True).orderBy("id").collect() == got


def test_training_rows_of_many_blocks_are_shuffled_once(task, monkeypatch):
    *_, dq, dt = task
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 17)
    plan = neighbours.class_lists(dq, dt, 7, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "CoGroup" not in plan and plan.count("Repartition") == 1


@pytest.mark.parametrize("name,model", [("l2_rank_vote_local_count", "rank_local_count"), ("l3_rank_vote_bayesian", None)])
def test_local_counts_reach_the_reference_row(spark, tmp_path, name, model):
    from rarefold.plans import queries

    x, y, _ = cloud(seed=4, n=600, rare=230)
    frame(spark, x, y).selectExpr("id AS vec_id", "1 - y AS label", "v AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    asked, lists = [], queries.class_lists
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "class_lists", lambda q, t, k, *a: asked.append(k) or lists(q, t, k, *a))
        got = fractions(queries.QUERIES[name](spark, str(tmp_path)))
    at = np.arange(600) % 5 != 0
    assert asked == [13] and int((y[at] == 1).sum()) == 184
    if model:
        assert np.allclose(got, lm.MODELS[model](lm.Fold(x[at], y[at], x[~at])), atol=1e-9)


LOCAL = ("knn_components", "knn_topology", "knn_two_anchors", "knn_local_metric", "knn_local_metric_entropy", "knn_local_metric_eigen", "rank_density_regions", "rank_regions", "rank_trusted_regions", "rank_scale", "knn_synthetic_best_k")


@pytest.mark.parametrize("name", LOCAL)
def test_models_hold_a_part_of_the_distances_at_once(name, monkeypatch):
    x, y, q = cloud(seed=2, n=200, rare=40)
    want = lm.MODELS[name](lm.Fold(x, y, q))
    monkeypatch.setattr(lm, "PART", 1000)
    cells, pairs, fits = [], lm.pairwise, []
    monkeypatch.setattr(lm, "pairwise", lambda a, b: cells.append(len(a) * len(b) if len(b) >= 100 else 0) or pairs(a, b))
    for of in ("regions", "synthetic", "k_means"):
        monkeypatch.setattr(lm, of, lambda *a, f=getattr(lm, of): fits.append(1) or f(*a))
    got = np.concatenate([lm.MODELS[name](f) for f in lm.Fold(x, y, q).parts()])
    assert np.array_equal(got, want) and (max(cells) <= 1000 or name == "rank_trusted_regions")  # that one's inner folds are whole
    assert len(fits) <= (21 if name == "rank_trusted_regions" else 1)


@pytest.mark.parametrize("name", ["knn_local_metric", "knn_local_metric_entropy"])
def test_metrics_meet_some_training_rows_at_once(name, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((30000, 16)), rng.integers(0, 2, 30000)
    f = lm.Fold(x, y, x[:2] + 0.1)
    f.nearest(200)
    tracemalloc.start()
    got = lm.MODELS[name](f)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes
    monkeypatch.setattr(lm, "ROWS", 30000)
    assert np.array_equal(got, lm.MODELS[name](f))


def test_first_of_a_stable_order():
    d = np.random.default_rng(0).integers(0, 9, (20, 60)).astype(float)
    for k in (1, 7, 60, 80):
        assert np.array_equal(geometry.smallest(d, k), np.argsort(d, axis=1, kind="stable")[:, :k])


def test_ward_joins_the_cheapest():
    x = np.round(np.random.default_rng(0).standard_normal((150, 3)), 1)
    merges, heights = geometry.ward(x)
    centre, size = dict(enumerate(x)), dict.fromkeys(range(150), 1)
    for (i, j), h in zip(merges.tolist(), heights, strict=True):
        assert np.isclose(h, np.sqrt(2 * size[i] * size[j] / (size[i] + size[j]) * ((centre[i] - centre[j]) ** 2).sum()))
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[i] += size.pop(j)
    assert size == {0: 150} and (np.diff(heights) >= 0).all()


def test_local_queries_shuffle_training_rows_once(spark, tmp_path):
    from rarefold.plans import queries

    x, y, _ = cloud()
    frame(spark, x, y).selectExpr("id AS vec_id", "1 - y AS label", "v AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["k6_knn_local_metric"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    at = np.arange(120) % 5 != 0
    assert "Generate" not in plan and "CoGroup" not in plan
    assert np.array_equal(fractions(got), lm.MODELS["knn_local_metric"](lm.Fold(x[at], y[at], x[~at])))


@pytest.mark.parametrize("scale", [1, 1e-25])
@pytest.mark.parametrize("block", [16384, 70])
def test_all_common_rows_inside_a_radius_are_counted(spark, monkeypatch, block, scale):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((300, 3)), 1) * scale  # with equal distances
    y, fold = np.r_[np.ones(40, int), np.zeros(260, int)], rng.integers(0, 3, 300)
    df = frame(spark, x, y).join(spark.createDataFrame([(i, int(f)) for i, f in enumerate(fold)], "id long, fold int"), "id")
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", block)
    got = {r["id"]: (r["rare"], r["inside"]) for r in neighbours.counts_inside(df, df, (1, 3, 12, 99), "fold").collect()}
    for i in range(300):
        d = neighbours.distances(x[i], x)
        a, b = np.sort(d[(y == 1) & (fold != fold[i])]), d[(y == 0) & (fold != fold[i])]
        assert got[i] == (len(a), [int((b <= a[min(p, len(a)) - 1]).sum()) for p in (1, 3, 12, 99)])


def test_local_counts_go_beyond_the_list_of_common_rows(spark, tmp_path):
    from rarefold.plans import queries

    x, y, _ = cloud(seed=6, n=600, rare=60)
    frame(spark, x, y).selectExpr("id AS vec_id", "1 - y AS label", "v AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    at, want, longest = np.arange(600) % 5 != 0, [], 0
    t, u = x[at], y[at]
    for q in x[~at]:
        d = np.linalg.norm(t - q, axis=1)
        a, b = np.sort(d[u == 1]), np.sort(d[u == 0])
        ref = int((u == 1).sum() ** 0.5)
        n = int((b <= a[ref - 1]).sum())
        longest = max(longest, n)
        wins, made = lm.vote(a, b, n / ref)
        want.append(wins / made)
    s = neighbours.sizes(frame(spark, t, u))
    assert longest > s.k_maj
    assert np.allclose(fractions(queries.QUERIES["l2_rank_vote_local_count"](spark, str(tmp_path))), want, atol=1e-9)


def test_local_exponents_go_beyond_the_list_of_common_rows(spark):
    x, y, q = cloud(seed=7, n=500, rare=40)
    dt = frame(spark, x, y)
    s = neighbours.sizes(dt, n_votes=5)
    got = fractions(votes.bayesian(neighbours.class_lists(frame(spark, q, start=1000), dt, s.k_min_eff, s.k_maj), s, 0.5, 5))
    want, longest = [], 0
    for p in q:
        d = np.linalg.norm(x - p, axis=1)
        a, b = np.sort(d[y == 1]), np.sort(d[y == 0])
        n, ref = int((b <= a[5]).sum()), 6
        longest, w = max(longest, n), ref / (ref + n)
        wins, made = lm.vote(a, b, s.r ** (w * 0.5 + (1 - w) * np.log(n / ref) / np.log(s.r)) if n else s.r**0.5)
        want.append(wins / made)
    assert longest > s.k_maj
    assert np.allclose(got, want, atol=1e-9)


def test_grids_of_whole_lists_reach_beyond_the_caps(spark):
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((1560, 1)), np.r_[np.ones(18, int), np.zeros(1542, int)]
    t = selection.folds(frame(spark, x, y), 3).cache()
    fold = np.array([r["fold"] for r in t.orderBy("id").collect()])
    cells = {}
    for f in range(3):
        a, b = x[(fold != f) & (y == 1), 0], x[(fold != f) & (y == 0), 0]
        for n in (1, 12):
            p = []
            for v in x[fold == f, 0]:
                wins, made = lm.vote(np.sort(abs(a - v)), np.sort(abs(b - v)), len(b) / len(a), n)
                p.append(wins / made)
            cells.setdefault(n, []).append(lm.g_mean(y[fold == f], np.array(p)))
    got = {r["n_votes"]: r["score"] for r in selection.grid_scores(t, (1.0,), (1, 12), whole=True).collect()}
    cut = {r["n_votes"]: r["score"] for r in selection.grid_scores(t, (1.0,), (1, 12)).collect()}
    assert all(abs(got[n] - np.mean(cells[n])) < 1e-12 for n in (1, 12)) and abs(cut[12] - got[12]) > 1e-6


@pytest.mark.parametrize("name", sorted(lm.DEALT))
@pytest.mark.parametrize("shares", [1, 3])
def test_long_fits_are_the_same_in_jobs(name, shares, monkeypatch):
    x, y, q = cloud(seed=2, n=200, rare=40)
    x[y == 0] += np.where(np.arange(160) % 2, 9, 0)[:, None]  # regions
    want = lm.MODELS[name](lm.Fold(x, y, q))
    monkeypatch.setattr(lm, "shares_of", lambda n: shares)
    monkeypatch.setattr(lm, "PART", 2000)
    jobs, job, fitted = lm.DEALT[name]
    if name == "knn_synthetic_best_k":
        jobs = lambda n: shares
    f = lm.Fold(x, y, q)
    fitted(f, [job(lm.Fold(x, y, x[:0]), i) for i in range(jobs(200))])
    for dealt in ("inner", "judged", "regions"):
        monkeypatch.setattr(lm, dealt, None) if hasattr(lm, dealt) else monkeypatch.setattr(lm.Fold, dealt, None)
    assert np.array_equal(np.concatenate([lm.MODELS[name](p) for p in f.parts()]), want)


def test_neighbours_of_a_fold_are_searched_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((300, 2)), 1)
    monkeypatch.setattr(lm, "TRAIN_BLOCK", 64)
    monkeypatch.setattr(lm, "ROWS", 100)
    full = geometry.smallest(geometry.pairwise(x[:50], x), 40)
    monkeypatch.setattr(lm, "pairwise", None)
    assert np.array_equal(lm.Fold(x, np.zeros(300, int), x[:50]).nearest(40), full)
