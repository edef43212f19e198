"""The queries once more as SQL, written on their own from the definitions."""

from __future__ import annotations

E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, label FROM embeddings), q AS (SELECT * FROM e WHERE id % 5 = 0), t AS (SELECT * FROM e WHERE id % 5 <> 0)"
S = "s AS (SELECT n_min, n_maj, n_maj::DOUBLE / n_min AS r, least(10, n_min) AS k_min, least(greatest(ceil(n_maj::DOUBLE / n_min)::BIGINT * 5 + 10, 30), 1000, n_maj) AS k_maj FROM (SELECT count(*) FILTER (y = 1) AS n_min, count(*) FILTER (y = 0) AS n_maj FROM t))"
D = "d AS (SELECT q.id AS qid, q.y AS qy, t.id AS tid, t.y, t.label, list_distance(q.v, t.v) AS d FROM q, t)"
A = "a0 AS (SELECT qid, any_value(qy) AS qy, list(d ORDER BY d) FILTER (y = 1) AS amin, list(d ORDER BY d) FILTER (y = 0) AS amaj FROM d GROUP BY qid), a AS (SELECT qid AS id, qy AS y, amin[1:k_min] AS dmin, amaj[1:{k_maj}] AS dmaj, s.* FROM a0, s)"
#: All rows of both classes.
WHOLE = f"WITH {E}, {S}, {D}, {A.format(k_maj='n_maj').replace('amin[1:k_min]', 'amin')}"
BASE = f"WITH {E}, {S}, {D}, {A.format(k_maj='k_maj')}"


def wins(k: str, nv: str = "5", soft: bool = False, dmin: str = "dmin", dmaj: str = "dmaj") -> tuple[str, str]:
    """Wins and comparisons as expressions."""
    whole = f"greatest(1, round_even(({k})::DOUBLE, 0)::BIGINT)"
    fit = f"least(({nv})::BIGINT, len({dmin}), len({dmaj}) // {whole})"
    n, k_eff = f"greatest(1, {fit})", f"(CASE WHEN {fit} < 1 THEN least({whole}, len({dmaj})) ELSE {whole} END)"
    far = f"{dmaj}[least(i * {k_eff}, len({dmaj}))]"
    score = f"CASE WHEN {dmin}[i] + {far} = 0 THEN 0.5::DOUBLE ELSE {far} / ({dmin}[i] + {far}) END" if soft else f"CASE WHEN {dmin}[i] < {far} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"list_sum(list_transform(range(1, {n} + 1), lambda i: {score}))", n


def vote(k: str, nv: str = "5", soft: bool = False, base: str = BASE) -> str:
    w, n = wins(k, nv, soft)
    return f"{base}, f AS (SELECT id, y, {w} / {n} AS frac FROM a) SELECT id, y, round(frac, 9) AS frac, CASE WHEN frac > 0.5 THEN 1 ELSE 0 END AS y_pred FROM f"


def pooled(cells: list[tuple[str, str]], soft: bool = False) -> str:
    each = [wins(k, nv, soft) for k, nv in cells]
    frac = f"({' + '.join(w for w, _ in each)}) / ({' + '.join(n for _, n in each)})"
    return f"{BASE}, f AS (SELECT id, y, {frac} AS frac FROM a) SELECT id, y, round(frac, 9) AS frac, CASE WHEN frac > 0.5 THEN 1 ELSE 0 END AS y_pred FROM f"


def left_out(kind: str) -> str:
    trials = 10 if kind == "odds" else 5
    odds = "(list_median(list_transform(range(1, least(k_min, len(x)) + 1), lambda i: len(list_filter(dmaj, lambda z: z <= x[i]))::DOUBLE / i)) + r) / 2"
    if kind == "grid":
        each = [wins(f"r ** {a}", "5", dmin="x") for a in (0.25, 0.5, 0.75, 1.0)]
        frac = f"({' + '.join(w for w, _ in each)}) / ({' + '.join(n for _, n in each)})"
    else:
        w, n = wins("k" if kind == "odds" else "r", "5", dmin="x")
        frac = f"{w} / {n}"
    k = f", k AS (SELECT *, {odds} AS k FROM j)" if kind == "odds" else ", k AS (SELECT * FROM j)"
    return f"{BASE}, j AS (SELECT a.*, list_concat(dmin[1:j - 1], dmin[j + 1:]) AS x FROM a, range(1, 1 + least({trials}, (SELECT k_min - 5 FROM s))) AS g(j)){k}, f AS (SELECT id, any_value(y) AS y, avg({frac}) AS frac FROM k GROUP BY id) SELECT id, y, round(frac, 9) AS frac, CASE WHEN round(frac, 12) > 0.5 THEN 1 ELSE 0 END AS y_pred FROM f"


FOLDS = "tf AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(concat(id, '-0-42')), id) - 1) % 3 AS fold FROM t)"
G_MEAN = "sqrt((CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END) * (CASE WHEN tn + fp = 0 THEN 0 ELSE tn::DOUBLE / (tn + fp) END))"
MCC = "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END"
CONFUSION = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn"


def grid(alphas: list[float], n_votes: list[int]) -> str:
    cells = ", ".join(f"({n}, {a}::DOUBLE)" for n in n_votes for a in alphas)
    w, n = wins("r ** alpha", "n_votes", dmaj="m")
    return f"""WITH {E}, {FOLDS},
    fs AS (SELECT fold, (SELECT count(*) FROM t WHERE y = 1) - count(*) FILTER (y = 1) AS n_min, (SELECT count(*) FROM t WHERE y = 0) - count(*) FILTER (y = 0) AS n_maj FROM tf GROUP BY fold),
    d AS (SELECT x.id AS qid, x.y AS qy, x.fold, z.y, list_distance(x.v, z.v) AS d FROM tf x JOIN tf z ON x.fold <> z.fold),
    a AS (SELECT qid, any_value(qy) AS y, any_value(fold) AS fold, (list(d ORDER BY d) FILTER (y = 1))[1:10] AS dmin, list(d ORDER BY d) FILTER (y = 0) AS dmaj FROM d GROUP BY qid),
    g AS (SELECT * FROM (VALUES {cells}) AS v(n_votes, alpha)),
    b AS (SELECT a.*, n_votes, alpha, n_maj::DOUBLE / n_min AS r, dmaj[1:least(greatest(ceil(n_maj::DOUBLE / n_min)::BIGINT * n_votes + 10, 30), 1000, n_maj)] AS m FROM a JOIN fs USING (fold), g),
    p AS (SELECT n_votes, alpha, fold, y, CASE WHEN {w} / {n} > 0.5 THEN 1 ELSE 0 END AS p FROM b),
    c AS (SELECT n_votes, alpha, fold, {CONFUSION} FROM p GROUP BY ALL),
    o AS (SELECT n_votes, alpha, avg({G_MEAN}) AS score, avg({MCC}) AS mcc FROM c GROUP BY ALL)"""


def grid_result(alphas: list[float], n_votes: list[int]) -> str:
    return grid(alphas, n_votes) + " SELECT n_votes, alpha, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, n_votes, alpha) = 1 AS chosen FROM o"


def rescored(score: str) -> str:
    """The joint grid by another score of a cell."""
    return grid([0.25, 0.5, 0.75, 1.0], VOTES) + f", z AS (SELECT n_votes, alpha, {score} AS score FROM o, (SELECT max(score) AS g, max(mcc) AS m FROM o)) SELECT n_votes, alpha, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, n_votes, alpha) = 1 AS chosen FROM z"


def with_choice(alphas: list[float], n_votes: list[int], k: str, nv: str, soft: bool = False) -> str:
    """The vote with the cell that the grid chooses."""
    inner = grid(alphas, n_votes) + " SELECT n_votes, alpha FROM o ORDER BY round(score, 12) DESC, n_votes, alpha LIMIT 1"
    size = S.replace("* 5 + 10", f"* {max(n_votes) if len(n_votes) > 1 else 5} + 10")
    base = f"WITH best AS ({inner}), {E}, {size}, {D}, {A.format(k_maj='k_maj').replace('FROM a0, s)', 'FROM a0, s)').replace('a AS (SELECT qid', 'a1 AS (SELECT qid')}, a AS (SELECT a1.*, alpha, n_votes, len(list_filter(dmaj, lambda z: z <= dmin[greatest(3, floor(sqrt(n_min))::BIGINT)])) AS near, greatest(3, floor(sqrt(n_min))::BIGINT) AS ref FROM a1, best)"
    return vote(k, nv, soft, base)


NEAR5 = f"WITH {E}, {D}, n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS rk FROM d), k AS (SELECT * FROM n WHERE rk <= 5)"
DOCS = "docs AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS y, quality, CASE WHEN doc_id % 11 <> 0 THEN n_chars::DOUBLE END AS n_chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks, 1.0::DOUBLE AS fixed, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, source, doc_id % 5 = 0 AS test FROM documents JOIN labels USING (doc_id))"
RESULTS = "r AS (SELECT n_name AS dataset, o_orderpriority AS algorithm, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"
RANKS = "k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2.0::DOUBLE AS rank FROM r)"
LINES = "l AS (SELECT l_returnflag AS algorithm, year(l_shipdate)::INTEGER AS dataset, CASE WHEN l_discount > 0.07 THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p, l_quantity AS score FROM lineitem), c AS (SELECT dataset, algorithm, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM l GROUP BY ALL)"
DIFF = "x AS (SELECT r.dataset, r.algorithm, r.value - b.value AS diff FROM r JOIN r b ON b.dataset = r.dataset AND b.algorithm = '5-LOW' WHERE r.algorithm <> '5-LOW')"
#: Exact signed-rank chances, from the ways that ranks 1 to k give each sum; the driver's results have no ties.
WILCOXON = """w0 AS (SELECT *, rank() OVER (PARTITION BY algorithm ORDER BY abs(diff)) AS rk FROM x WHERE diff <> 0),
    w1 AS (SELECT algorithm, count(*) AS n, least(coalesce(sum(rk) FILTER (diff > 0), 0), coalesce(sum(rk) FILTER (diff < 0), 0))::DOUBLE AS statistic FROM w0 GROUP BY algorithm),
    u AS (SELECT 0 AS k, list_concat([1.0::DOUBLE], list_transform(range(0, 325), lambda i: 0.0::DOUBLE)) AS c UNION ALL SELECT k + 1, list_transform(range(1, 327), lambda i: c[i] + CASE WHEN i > k + 1 THEN c[i - k - 1] ELSE 0 END) FROM u WHERE k < 25),
    w AS (SELECT algorithm, n, statistic, least(1, 2 * list_sum(c[1:statistic::BIGINT + 1]) / 2.0::DOUBLE ** n) AS p_raw, 0::BIGINT AS ties FROM w1 JOIN u ON k = n)"""
HOLM = "h AS (SELECT *, least(1, p_raw * (count(*) OVER () - row_number() OVER (ORDER BY p_raw, algorithm) + 1)) AS p FROM w)"
NATIONS = "m0 AS (SELECT n_name AS dataset, n_nationkey::BIGINT AS id, count(*)::DOUBLE AS a, avg(c_acctbal) AS b, avg(CASE WHEN c_acctbal < 0 THEN 1.0::DOUBLE ELSE 0 END) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), m AS (SELECT dataset, id, [ln(a), b / 1000, c * 10] AS v, a / (1 + c * a) AS imbalance FROM m0)"


def told(labels: str) -> str:
    """Leave-one-out accuracy of five neighbours over the nations, of labels by dataset."""
    return f"""o AS (SELECT id, v, label FROM m JOIN {labels} USING (dataset)),
        n AS (SELECT x.id, x.label AS y, z.label AS l, row_number() OVER (PARTITION BY x.id ORDER BY list_distance(x.v, z.v), z.id) AS rk FROM o x JOIN o z ON x.id <> z.id),
        c AS (SELECT id, y, l, count(*) AS n, min(rk) AS f FROM n WHERE rk <= 5 GROUP BY ALL), p AS (SELECT id, y, arg_min(l, (-n, f)) AS p FROM c GROUP BY ALL),
        t AS (SELECT avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END) AS a, (SELECT max(n) FROM (SELECT count(*) AS n FROM o GROUP BY label))::DOUBLE / count(*) AS b, count(*) AS n FROM p)
        SELECT round(a, 9) AS accuracy, round(b, 9) AS baseline, round(a - b, 9) AS gain, n FROM t"""
RATIO = "(n_maj::DOUBLE / n_min)"


def scored(div: str, mcc: str) -> str:
    """Metrics with a division as a template of two places."""
    d = lambda a, b: div.format(f"({a})::DOUBLE", f"({b})::DOUBLE")
    return f"""WITH {LINES}, m AS (SELECT *, {d('tp', 'tp + fn')} AS recall, {d('tp', 'tp + fp')} AS precision, {d('tn', 'tn + fp')} AS specificity FROM c)
    SELECT dataset, algorithm, round(recall, 9) AS recall, round(precision, 9) AS precision, round(specificity, 9) AS specificity, round({d('2 * precision * recall', 'precision + recall')}, 9) AS f1,
    round((recall + specificity) / 2, 9) AS balanced_accuracy, round(sqrt(recall * specificity), 9) AS geometric_mean,
    round({mcc.format('(tp::DOUBLE * tn - fp::DOUBLE * fn)', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')}, 9) AS mcc FROM m"""


ALPHAS, VOTES = [0.25, 0.5, 0.75, 1.0], [1, 2, 3, 5, 7, 10]
ZERO = "(CASE WHEN {1} = 0 THEN 0.0::DOUBLE ELSE {0} / {1} END)"
NULL = "(CASE WHEN {1} = 0 THEN NULL ELSE {0} / {1} END)"
REF = "greatest(3, floor(sqrt(n_min))::BIGINT)"
MULTI = """WITH e0 AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings),
    u AS (SELECT g.i, avg(v[g.i]) AS m, stddev_pop(v[g.i]) AS sd FROM e0, range(1, 65) AS g(i) WHERE id % 5 <> 0 GROUP BY g.i),
    fit AS (SELECT list(m ORDER BY i) AS m, list(CASE WHEN sd > 0 THEN sd ELSE 1 END ORDER BY i) AS sd FROM u),
    e AS (SELECT id, label, list_transform(range(1, 65), lambda i: (v[i] - m[i]) / sd[i]) AS v FROM e0, fit),
    n AS (SELECT label, count(*) AS n FROM e WHERE id % 5 <> 0 GROUP BY label),
    {plan},
    d AS (SELECT q.id, q.label AS y, t.label, list_distance(q.v, t.v) AS d FROM e q, e t WHERE q.id % 5 = 0 AND t.id % 5 <> 0),
    l AS (SELECT id, any_value(y) AS y, label, list(d ORDER BY d) AS ds FROM d GROUP BY id, label),
    c AS (SELECT l.id, l.y, l.label, k.run, k.k, l.ds[1:k.fetch] AS ds FROM l JOIN k USING (label)),
    g AS (SELECT *, greatest(1, least(5, min(floor(len(ds) / k)) OVER (PARTITION BY id, run)))::BIGINT AS rounds FROM c),
    h AS (SELECT g.*, i.i, greatest(0::DOUBLE, least(i.i * k - 1, (len(ds) - 1)::DOUBLE)) AS pos FROM g, range(1, 6) AS i(i) WHERE i.i <= rounds),
    w AS (SELECT *, (1 - (pos - floor(pos))) * ds[floor(pos)::BIGINT + 1] + (pos - floor(pos)) * ds[ceil(pos)::BIGINT + 1] AS x FROM h),
    b AS (SELECT id, y, run, i, rounds, arg_min(label, (x, label)) AS label FROM w GROUP BY ALL),
    s AS (SELECT id, y, label, round(sum(1.0::DOUBLE / rounds), 9) AS s FROM b GROUP BY ALL)
    SELECT id, y, arg_min(label, (-s, label)) AS y_pred, round(max(s) / sum(s), 9) AS p FROM s GROUP BY id, y"""
ONE_RUN = "k AS (SELECT 0 AS run, label, greatest(1.0::DOUBLE, n / md) AS k, least(least(greatest(ceil(greatest(1.0::DOUBLE, n / md))::BIGINT * 5 + 5, 5), 500), n) AS fetch FROM n, (SELECT greatest(1.0::DOUBLE, median(n)::DOUBLE) AS md FROM n))"
ALL_RUNS = "k AS (SELECT x.label AS run, n.label, greatest(1.0::DOUBLE, n.n / x.md) AS k, n.n AS fetch FROM n, (SELECT a.label, greatest(1.0::DOUBLE, median(b.n)::DOUBLE) AS md FROM n a JOIN n b ON a.label <> b.label GROUP BY a.label) x WHERE x.label <> n.label)"

# The steps 19, 9, 3, 1 are those of 400 training rows, as the smaller tables have.
ENTROPY = f"""WITH {E}, n AS (SELECT q.id, q.label AS y, t.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS rk FROM q, t), g AS (SELECT unnest([19, 9, 3, 1]) AS k),
    c AS (SELECT id, k, label, count(*)::DOUBLE / k + 1e-9::DOUBLE AS p FROM n JOIN g ON rk <= k GROUP BY id, k, label),
    z AS (SELECT id, k, p / sum(p) OVER (PARTITION BY id, k) AS p FROM c), h AS (SELECT id, k, -sum(p * log2(p)) AS h FROM z GROUP BY id, k),
    w AS (SELECT id, max(h) FILTER (k = 19) AS a, max(h) FILTER (k = 9) AS b, max(h) FILTER (k = 3) AS c, max(h) FILTER (k = 1) AS d FROM h GROUP BY id),
    b AS (SELECT id, CASE WHEN NOT b > a THEN 19 WHEN NOT c > b THEN 9 WHEN NOT d > c THEN 3 ELSE 1 END AS k FROM w),
    v AS (SELECT n.id, n.y, b.k, label, count(*) AS m, min(rk) AS f FROM n JOIN b ON n.id = b.id AND rk <= b.k GROUP BY ALL)
    SELECT id, y, arg_min(label, (-m, f)) AS y_pred, max(m)::DOUBLE / any_value(k) AS p, any_value(k)::INTEGER AS k FROM v GROUP BY id, y"""

ORACLES = {
    "a1_knn_entropy": ENTROPY,
    "j1_knn_any_distance": f"{NEAR5}, c AS (SELECT qid, qy, y, count(*) AS n, min(rk) AS first FROM k GROUP BY ALL) SELECT qid AS id, qy AS y, arg_min(y, (-n, first)) AS y_pred, max(n) / 5.0::DOUBLE AS p FROM c GROUP BY ALL",
    "h5_separated": f"WITH {RESULTS}, {RANKS}, m AS (SELECT avg(rank) AS a FROM k GROUP BY algorithm), t AS (SELECT a FROM m ORDER BY a LIMIT 2), c AS (SELECT 2.728::DOUBLE * sqrt(5 * 6 / (6.0::DOUBLE * count(DISTINCT dataset))) AS cd FROM r) SELECT round((SELECT max(a) - min(a) FROM t), 9) AS gap, round(cd, 9) AS cd, (SELECT max(a) - min(a) FROM t) > cd AS separated FROM c",
    "k2_knn_majority": f"{NEAR5}, c AS (SELECT qid, qy, y, count(*) AS n, min(rk) AS first FROM k GROUP BY ALL) SELECT qid AS id, qy AS y, arg_min(y, (-n, first)) AS y_pred, max(n) / 5.0::DOUBLE AS p FROM c GROUP BY ALL",
    "k5_knn_weighted": f"{NEAR5}, w AS (SELECT y, (SELECT count(*) FROM t)::DOUBLE / (2 * count(*)) AS w FROM t GROUP BY y), c AS (SELECT qid, qy, y, round(count(*) * any_value(w), 9) AS s FROM k JOIN w USING (y) GROUP BY ALL) SELECT qid AS id, qy AS y, arg_min(y, (-s, y)) AS y_pred, round(max(s) / sum(s), 9) AS p FROM c GROUP BY ALL",
    "k4_knn_best_k": f"""WITH {E}, {FOLDS}, d AS (SELECT x.id AS qid, x.y AS qy, x.fold, z.y, row_number() OVER (PARTITION BY x.id ORDER BY list_distance(x.v, z.v), z.id) AS rk FROM tf x JOIN tf z ON x.fold <> z.fold),
        g AS (SELECT unnest(range(1, (SELECT floor(sqrt(count(*)))::BIGINT + 1 FROM t), 2)) AS k),
        v AS (SELECT k, qid, qy AS y, fold, count(*) FILTER (d.y = 1) AS a, count(*) FILTER (d.y = 0) AS b, arg_min(d.y, rk) AS f FROM d JOIN g ON rk <= k GROUP BY ALL),
        p AS (SELECT k, fold, y, CASE WHEN a > b THEN 1 WHEN a < b THEN 0 ELSE f END AS p FROM v), c AS (SELECT k, fold, {CONFUSION} FROM p GROUP BY ALL), o AS (SELECT k, avg({G_MEAN}) AS score FROM c GROUP BY k)
        SELECT k::INTEGER AS k, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, k) = 1 AS chosen FROM o""",
    "f2_rank_vote": vote("r"),
    "f5_rank_vote_soft": vote("r", soft=True),
    "f6_rank_vote_alpha": with_choice(ALPHAS, [5], "r ** alpha", "5"),
    "f7_rank_vote_alpha_soft": with_choice(ALPHAS, [5], "r ** alpha", "5", soft=True),
    "f6_alpha_grid": grid_result(ALPHAS, [5]),
    "e3_votes_grid": grid_result([1.0], VOTES),
    "f6a_joint_grid_mcc": rescored("mcc"),
    "f6a_joint_grid_combined": rescored("(mcc + score) / 2"),
    "f6a_joint_grid_utopia": rescored("-(((m - mcc) / m) ** 2 + ((g - score) / g) ** 2)"),
    "s1_csv_tables": "WITH t AS (SELECT (c_acctbal < 0)::INTEGER AS y, 'c' AS s, 3 AS f FROM customer UNION ALL SELECT (s_acctbal < 0)::INTEGER, 's', 2 FROM supplier), g AS (SELECT s, any_value(f)::INTEGER AS n_features, count(*) AS n, count(*) FILTER (y = 1) AS a FROM t GROUP BY s) SELECT n, n_features, greatest(a, n - a) AS n_maj, least(a, n - a) AS n_min, round(greatest(a, n - a) / least(a, n - a)::DOUBLE, 9) AS r_maj_min FROM g",
    "e4_joint_grid": grid_result(ALPHAS, VOTES),
    "e3_rank_vote_votes": with_choice([1.0], VOTES, "r", "n_votes"),
    "e4_rank_vote_joint": with_choice(ALPHAS, VOTES, "r ** alpha", "n_votes"),
    "l3_rank_vote_bayesian": with_choice(ALPHAS, VOTES, "r ** (CASE WHEN near > 0 AND r > 1 THEN ref / (ref + near)::DOUBLE * alpha + (1 - ref / (ref + near)::DOUBLE) * ln(near::DOUBLE / ref) / ln(r) ELSE alpha END)", "n_votes").replace("30), 1000, n_maj)", "30), n_maj)").replace("amin[1:k_min]", "amin").replace("amaj[1:k_maj]", "amaj"),
    "e1_rank_vote_pooled": pooled([(f"r ** {a}", str(n)) for a in ALPHAS for n in VOTES]).replace("* 5 + 10", "* 10 + 10"),
    "e2_rank_vote_pooled_soft": pooled([(f"r ** {a}", "5") for a in ALPHAS], soft=True),
    "f8_rank_vote_density": vote("(len(list_filter(dmaj, lambda z: z <= dmin[k_min])) + k_min * r) / (k_min * 2.0::DOUBLE)", base=f"WITH {E}, {S}, {D}, {A.format(k_maj='least(greatest(k_maj, ceil(2.0::DOUBLE * k_min * r)::BIGINT), n_maj)')}"),
    "l1_rank_vote_local_odds": vote("(list_median(list_transform(range(1, len(dmin) + 1), lambda i: len(list_filter(dmaj, lambda z: z <= dmin[i]))::DOUBLE / i)) + r) / 2"),
    "l2_rank_vote_local_count": vote(f"len(list_filter(dmaj, lambda z: z <= dmin[{REF}]))::DOUBLE / {REF}", base=WHOLE),
    "r1_rank_vote_left_out": left_out("single"),
    "r2_rank_vote_left_out_grid": left_out("grid"),
    "r3_rank_vote_left_out_odds": left_out("odds"),
    "f4_dimension": f"WITH {E}, d AS (SELECT x.id, row_number() OVER (PARTITION BY x.id ORDER BY list_distance(x.v, z.v), z.id) AS rk, list_distance(x.v, z.v) AS d FROM t x JOIN t z ON x.id <> z.id), l AS (SELECT id, list(d ORDER BY rk) AS ds FROM d WHERE rk <= 10 AND d > 0 GROUP BY id) SELECT id, round(1 / (list_sum(list_transform(ds, lambda x: ln(ds[len(ds)]) - ln(x))) / (len(ds) - 1)), 6) AS lid FROM l",
    "f0_sizes": f"WITH {E}, {S} SELECT n_min, n_maj, round(r, 9) AS r, k_min::INTEGER AS k_min_eff, k_maj::INTEGER AS k_maj FROM s",
    "m1_rank_label": MULTI.format(plan=ONE_RUN),
    "m2_rank_label_excluded": MULTI.format(plan=ALL_RUNS),
    "z5_counted_k": f"{BASE} SELECT id, round(len(list_filter(dmaj, lambda z: z <= dmin[5]))::DOUBLE / 5, 9) AS counting, round(dmin[5] / dmaj[5], 9) AS by_rank FROM a",
    "z9_fixed_k": f"""WITH {E}, {FOLDS}, d AS (SELECT x.id AS qid, x.y AS qy, x.fold, z.y, row_number() OVER (PARTITION BY x.id ORDER BY list_distance(x.v, z.v), z.id) AS rk FROM tf x JOIN tf z ON x.fold <> z.fold),
        g AS (SELECT unnest([1, 3, 5, 7, 11, 21]) AS k), v AS (SELECT k, qid, qy AS y, fold, count(*) FILTER (d.y = 1) AS a, count(*) FILTER (d.y = 0) AS b FROM d JOIN g ON rk <= k GROUP BY ALL),
        p AS (SELECT k, fold, y, CASE WHEN a > b THEN 1 ELSE 0 END AS p FROM v), c AS (SELECT k, fold, {CONFUSION} FROM p GROUP BY ALL) SELECT k, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 9) AS score FROM c GROUP BY k""",
    "x6_graph_features": f"""WITH {E}, n AS (SELECT x.id, x.y, z.y AS l, list_distance(x.v, z.v) AS d, row_number() OVER (PARTITION BY x.id ORDER BY list_distance(x.v, z.v), z.id) AS rk FROM t x JOIN t z ON x.id <> z.id),
        a AS (SELECT id, any_value(y) AS y, avg(d) FILTER (rk <= 5) AS d, avg(l) FILTER (rk <= 5) AS a, avg(l) FILTER (rk <= 10) AS b, max(l) FILTER (rk = 1) AS f FROM n GROUP BY id)
        SELECT round(avg(1 - a) FILTER (y = 1), 9) AS purity_v1, round(avg(CASE WHEN a > 0 AND a < 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS borderline_v1, round(avg(b) FILTER (y = 1), 9) AS purity_v2, round(avg(1.0::DOUBLE - f) FILTER (y = 1), 9) AS borderline_v2, round(avg(d) FILTER (y = 1) / (avg(d) FILTER (y = 0) + 1e-9), 9) AS nn_dist_ratio FROM a""",
    "x1_table_features": f"""WITH {E}, p AS (SELECT g.i, avg(v[g.i]) AS m, stddev_pop(v[g.i]) AS s, avg(v[g.i] ** 3) AS c, avg(v[g.i] ** 2) AS q FROM t, range(1, 65) AS g(i) GROUP BY g.i),
        n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (y = 1)::DOUBLE AS a FROM t)
        SELECT round(ln(n), 9) AS log_n, round(ln(64), 9) AS log_p, round(ln((n - a) / a), 9) AS log_imbalance, round(64 / n, 9) AS p_by_n, round(-(a / n * log2(a / n) + (1 - a / n) * log2(1 - a / n)), 9) AS class_entropy,
        (SELECT round(avg(s / abs(m)) FILTER (abs(m) > 1e-9), 6) FROM p) AS mean_cv, (SELECT round(avg(abs((c - 3 * m * q + 2 * m ** 3) / s ** 3)), 6) FROM p) AS mean_skew FROM n""",
    "x5_histogram_entropy": f"""WITH {E}, x AS (SELECT g.i, v[g.i] AS x FROM t, range(1, 65) AS g(i)), b AS (SELECT i, min(x) AS lo, max(x) AS hi, count(*) AS n FROM x GROUP BY i),
        h AS (SELECT i, least(floor((x - lo) / (hi - lo) * least(10.0::DOUBLE, greatest(2.0::DOUBLE, floor(n / 10.0::DOUBLE)))), least(10.0::DOUBLE, greatest(2.0::DOUBLE, floor(n / 10.0::DOUBLE))) - 1) AS bin, n FROM x JOIN b USING (i)),
        c AS (SELECT i, bin, count(*)::DOUBLE / any_value(n) AS p FROM h GROUP BY i, bin), e2 AS (SELECT i, -sum(p * log2(p)) AS h FROM c GROUP BY i) SELECT round(avg(h), 9) AS hist_entropy FROM e2""",
    "z3_neighbour_slope": f"WITH {E}, n AS (SELECT list_distance(x.v, z.v) AS d, row_number() OVER (PARTITION BY x.id ORDER BY list_distance(x.v, z.v), z.id) AS rk FROM t x JOIN t z ON x.id <> z.id), m AS (SELECT rk, avg(d) AS d FROM n WHERE rk <= 20 GROUP BY rk) SELECT round(regr_slope(ln(d), ln(rk)), 7) AS slope, round(1 / regr_slope(ln(d), ln(rk)), 5) AS dimension FROM m",
    "x9_lodo": f"WITH {E}, n AS (SELECT x.id, x.label AS y, z.label AS l, row_number() OVER (PARTITION BY x.id ORDER BY list_distance(x.v, z.v), z.id) AS rk FROM t x JOIN t z ON x.id <> z.id), c AS (SELECT id, y, l, count(*) AS n, min(rk) AS f FROM n WHERE rk <= 5 GROUP BY ALL), p AS (SELECT id, y, arg_min(l, (-n, f)) AS p FROM c GROUP BY ALL) SELECT round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, round((SELECT max(n) FROM (SELECT count(*) AS n FROM t GROUP BY label))::DOUBLE / count(*), 9) AS baseline, count(*) AS n FROM p",
    "p1_binarised": f"WITH {DOCS}, c AS (SELECT quality, count(*) AS n FROM docs GROUP BY quality) SELECT id, CASE WHEN quality = (SELECT quality FROM c ORDER BY n, quality LIMIT 1) THEN 1 ELSE 0 END AS y FROM docs",
    "p2_standardised": f"WITH {DOCS}, m AS (SELECT avg(blanks) AS m, stddev_pop(blanks) AS s FROM docs WHERE NOT test) SELECT id, round((blanks - m) / s, 7) AS blanks FROM docs, m",
    "p3_varying": f"WITH {DOCS}, m AS (SELECT stddev_pop(n_chars) AS n_chars, stddev_pop(blanks) AS blanks, stddev_pop(fixed) AS fixed FROM docs WHERE NOT test), u AS (UNPIVOT m ON n_chars, blanks, fixed INTO NAME \"column\" VALUE deviation) SELECT \"column\", round(deviation, 6) AS deviation FROM u WHERE deviation > 0",
    "p4_median_imputed": f"WITH {DOCS} SELECT id, coalesce(n_chars, (SELECT quantile_cont(n_chars, 0.5) FROM docs WHERE NOT test)) AS n_chars FROM docs",
    "p6_mode_imputed": f"WITH {DOCS} SELECT id, coalesce(lang, (SELECT lang FROM docs WHERE NOT test AND lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)) AS lang FROM docs",
    "p7_one_hot": f"WITH {DOCS}, w AS (SELECT list(DISTINCT lang ORDER BY lang) FILTER (lang IS NOT NULL) AS w FROM docs WHERE NOT test) SELECT id, array_to_string(list_transform(w, lambda x: CASE WHEN x = lang THEN '1' ELSE '0' END), '') AS hot FROM docs, w",
    "p9_features": f"""WITH {DOCS}, i AS (SELECT id, test, coalesce(n_chars, (SELECT quantile_cont(n_chars, 0.5) FROM docs WHERE NOT test)) AS a, blanks AS b, coalesce(lang, (SELECT lang FROM docs WHERE NOT test AND lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)) AS lang FROM docs),
        w AS (SELECT list(DISTINCT lang ORDER BY lang) AS w FROM i WHERE NOT test), v AS (SELECT id, test, list_concat([a, b], list_transform(w, lambda x: CASE WHEN x = lang THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS v FROM i, w),
        u AS (SELECT id, test, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM v), m AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM u WHERE NOT test GROUP BY k) SELECT id, (k - 1)::INTEGER AS place, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 7) AS x FROM u JOIN m USING (k)""",
    "p10_degenerate": "WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY user_id) SELECT user_id, n >= 4 AS usable FROM c",
    "p12_unseen": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "s9_dropped": "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type",
    "g1_confusion": f"WITH {LINES} SELECT * FROM c",
    "g2_roc_auc": f"WITH {LINES}, k AS (SELECT algorithm, y, rank() OVER (PARTITION BY algorithm ORDER BY score) + (count(*) OVER (PARTITION BY algorithm, score) - 1) / 2.0::DOUBLE AS r FROM l) SELECT algorithm, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 9) AS roc_auc FROM k GROUP BY algorithm",
    "g3_average_precision": f"WITH {LINES}, s AS (SELECT algorithm, score, count(*) FILTER (y = 1)::DOUBLE AS p, count(*)::DOUBLE AS n FROM l GROUP BY ALL), w AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS a FROM s WINDOW o AS (PARTITION BY algorithm ORDER BY score DESC)) SELECT algorithm, round(sum(p * tp / a) / sum(p), 9) AS pr_auc FROM w GROUP BY algorithm",
    "g5_metrics_null": scored(NULL, "coalesce(CASE WHEN {1} = 0 THEN 0 ELSE {0} / {1} END, 0)"),
    "g5b_metrics_zero": scored(ZERO, "(CASE WHEN {1} = 0 THEN 0 ELSE {0} / {1} END)"),
    "g5c_metrics_eps": scored("({0} / ({1} + 1e-9::DOUBLE))", "({0} / ({1} + 1e-9::DOUBLE))"),
    "g6_means": "WITH g AS (SELECT l_linestatus AS status, l_returnflag AS flag, round(avg(l_discount), 7) AS mean, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY n DESC, status, flag)::INTEGER AS place FROM g",
    "g10_counts": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
    "z11_covered": "WITH p AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL), s AS (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 10), a AS (SELECT event_type, avg(m) AS a FROM p GROUP BY event_type), b AS (SELECT event_type, avg(m) AS b FROM p SEMI JOIN s USING (user_id) GROUP BY event_type) SELECT event_type AS algorithm, round(b, 7) AS value, round(b - a, 7) AS delta FROM a JOIN b USING (event_type)",
    "w7_rank_ratios": f"{BASE}, g AS (SELECT unnest(range(1, 6)) AS i) SELECT i::INTEGER AS rank, round(avg(dmin[i] / dmaj[i]), 7) AS ratio FROM a, g GROUP BY i",
    "g7_two_level_mean": "WITH p AS (SELECT user_id AS dataset, event_type AS algorithm, avg(value) AS m FROM events GROUP BY ALL) SELECT algorithm, round(avg(m), 7) AS value, count(*) AS n_datasets FROM p GROUP BY algorithm",
    "g8_pivot": f"WITH {RESULTS} SELECT dataset, " + ", ".join(f"round(avg(value) FILTER (algorithm = '{a}'), 6) AS \"{a}\"" for a in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM r GROUP BY dataset",
    "g9_rates": f"WITH {LINES} SELECT algorithm, round(avg(tp::DOUBLE / nullif(tp + fn, 0)), 9) AS tpr, round(avg(tn::DOUBLE / nullif(tn + fp, 0)), 9) AS tnr, round(avg(fp::DOUBLE / nullif(fp + tn, 0)), 9) AS fpr, round(avg(fn::DOUBLE / nullif(fn + tp, 0)), 9) AS fnr FROM c GROUP BY algorithm",
    "g11_quartiles": f"WITH {RESULTS} SELECT algorithm, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM r GROUP BY algorithm",
    "g12_deltas": f"WITH {RESULTS}, {DIFF} SELECT algorithm, round(avg(diff), 6) AS delta, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses FROM x GROUP BY algorithm",
    "g13_winners": f"WITH {RESULTS} SELECT dataset, arg_min(algorithm, (-value, algorithm)) AS algorithm, round(max(value), 6) AS value FROM r GROUP BY dataset",
    "g13_win_rates": f"WITH {RESULTS}, w AS (SELECT dataset, arg_min(algorithm, (-value, algorithm)) AS algorithm, max(value) AS value FROM r GROUP BY dataset), e AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM w), k AS (SELECT *, CASE WHEN value <= a THEN 1 WHEN value <= b THEN 2 WHEN value <= c THEN 3 ELSE 4 END AS bin FROM w, e) SELECT bin, algorithm, count(*) AS wins, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY bin), 9) AS rate FROM k GROUP BY bin, algorithm",
    "g14_bootstrap": f"WITH {RESULTS}, n AS (SELECT algorithm, value, row_number() OVER (PARTITION BY algorithm ORDER BY dataset) - 1 AS i, count(*) OVER (PARTITION BY algorithm) AS n FROM r), d AS (SELECT algorithm, b, ('0x' || substr(md5(concat(b, '-', i, '-42')), 1, 8))::BIGINT % n AS i FROM n, range(0, 2000) AS g(b)), m AS (SELECT algorithm, b, avg(value) AS m FROM d JOIN n USING (algorithm, i) GROUP BY ALL), q AS (SELECT algorithm, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY algorithm) SELECT algorithm, round(avg(value), 5) AS mean, round(any_value(lo), 5) AS lower, round(any_value(hi), 5) AS upper FROM q JOIN r USING (algorithm) GROUP BY algorithm",
    "g15_summary": f"WITH {DOCS} SELECT source, count(*) AS n, count(*) FILTER (y = 0) AS n_maj, count(*) FILTER (y = 1) AS n_min FROM docs GROUP BY source",
    "g16_saturation": f"WITH {DOCS}, c AS (SELECT source, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM docs GROUP BY source) SELECT source, (ceil(b::DOUBLE / greatest(1, a))::BIGINT * 5 + 10)::BIGINT AS asked, least(greatest(ceil(b::DOUBLE / greatest(1, a))::BIGINT * 5 + 10, 30), 1000, b) AS used, ceil(b::DOUBLE / greatest(1, a))::BIGINT * 5 + 10 > b AS short FROM c",
    "g18_line": f"WITH {DOCS} SELECT round(regr_slope(blanks, n_chars), 9) AS slope, round(regr_intercept(blanks, n_chars), 6) AS intercept, round(corr(blanks, n_chars), 9) AS r FROM docs",
    "g19_completed": "SELECT user_id AS dataset, event_type AS algorithm FROM events GROUP BY ALL HAVING count(*) >= 3",
    "w3_average_ranks": f"WITH {RESULTS}, {RANKS} SELECT algorithm, round(avg(rank), 9) AS avg_rank FROM k GROUP BY algorithm",
    "w4_quantile_bins": f"WITH {RESULTS}, e AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM r) SELECT dataset, algorithm, CASE WHEN value <= a THEN 1 WHEN value <= b THEN 2 WHEN value <= c THEN 3 ELSE 4 END AS bin FROM r, e",
    "w6_cumulative_ratio": f"WITH {DOCS}, c AS (SELECT source, id, sum(y) OVER o AS seen_min, sum(1 - y) OVER o AS seen_maj FROM docs WINDOW o AS (PARTITION BY source ORDER BY blanks, id ROWS UNBOUNDED PRECEDING)) SELECT source, id, seen_min::BIGINT AS seen_min, seen_maj::BIGINT AS seen_maj, round(CASE WHEN seen_min > 0 THEN seen_maj::DOUBLE / seen_min END, 9) AS ratio FROM c",
    "h1_friedman": f"WITH {RESULTS}, {RANKS}, s AS (SELECT sum(q * q) AS q, count(*)::DOUBLE AS k, any_value(n)::DOUBLE AS n FROM (SELECT algorithm, sum(rank) AS q, count(*) AS n FROM k GROUP BY algorithm)), t AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM k GROUP BY dataset, rank)) SELECT round((12 / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - t / (n * (k ** 3 - k))), 7) AS statistic, (k - 1)::INTEGER AS df, n::BIGINT AS n, round(exp(-c / 2) * (1 + c / 2), 7) AS p FROM (SELECT *, (12 / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - t / (n * (k ** 3 - k))) AS c FROM s, t)",
    "h2_wilcoxon": f"WITH RECURSIVE {RESULTS}, {DIFF}, {WILCOXON} SELECT algorithm, n, statistic, round(p_raw, 9) AS p_raw, ties FROM w",
    "h2_wilcoxon_holm": f"WITH RECURSIVE {RESULTS}, {DIFF}, {WILCOXON}, {HOLM} SELECT algorithm, n, statistic, round(p_raw, 9) AS p_raw, ties, round(p, 9) AS p_corrected, p < 0.05 AS significant FROM h",
    "h2a_wilcoxon_holm_monotone": f"WITH RECURSIVE {RESULTS}, {DIFF}, {WILCOXON}, {HOLM}, g AS (SELECT *, max(p) OVER (ORDER BY p_raw, algorithm) AS q FROM h), d AS (SELECT algorithm, avg(diff) / stddev_samp(diff) AS d FROM x GROUP BY algorithm) SELECT algorithm, n, statistic, round(p_raw, 9) AS p_raw, ties, round(q, 9) AS p_corrected, q < 0.05 AS significant, round(d, 9) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS size FROM g JOIN d USING (algorithm)",
    "h3b_critical_difference_report": f"WITH {RESULTS} SELECT count(DISTINCT algorithm) AS k, count(DISTINCT dataset) AS n, round(2.728::DOUBLE * sqrt(5 * 6 / (6.0::DOUBLE * count(DISTINCT dataset))), 9) AS cd FROM r",
    "h7_trend": f"""WITH {RESULTS}, {NATIONS}, p AS (SELECT dataset, avg(value) FILTER (algorithm = '1-URGENT') AS x, avg(value) FILTER (algorithm = '5-LOW') AS y FROM r GROUP BY dataset),
        o AS (SELECT dataset, imbalance AS i, x - y AS d, CASE WHEN x > y THEN 1.0::DOUBLE ELSE 0 END AS w FROM p JOIN m USING (dataset)),
        z AS (SELECT sign(a.i - b.i) AS si, sign(a.d - b.d) AS sd, sign(a.w - b.w) AS sw FROM o a JOIN o b ON a.dataset < b.dataset),
        k AS (SELECT sum(si * sw) / sqrt(sum(abs(si))::DOUBLE * sum(abs(sw))) AS tw, sum(si * sd) / sqrt(sum(abs(si))::DOUBLE * sum(abs(sd))) AS tg FROM z)
        SELECT round(avg(w), 6) AS win_rate, round(avg(d), 6) AS mean_delta, round(min(d), 6) AS min_delta, round(max(d), 6) AS max_delta, count(*) AS n_datasets, round(any_value(tw), 6) AS tau_wins, round(any_value(tg), 6) AS tau_gain FROM o, k""",
    "h9_correlations": "SELECT a, b, round(r, 9) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")",
    "j9_with_metadata": f"WITH {RESULTS}, {NATIONS} SELECT dataset, algorithm, round(value, 6) AS value, id, round(imbalance, 6) AS imbalance FROM r LEFT JOIN (SELECT * FROM m WHERE id % 3 <> 0) USING (dataset)",
    "j11_aligned": f"WITH {NATIONS}, s AS (SELECT s_nationkey AS id, count(*) AS suppliers, sum(s_acctbal) AS balance FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1) SELECT m.id, dataset, suppliers, round(balance, 4) AS balance FROM m LEFT JOIN s ON m.id = s.id",
    "x8_footprints": f"WITH {RESULTS}, {NATIONS}, w AS (SELECT dataset, arg_min(algorithm, (-value, algorithm)) AS high_winner, arg_min(algorithm, (value, algorithm)) AS low_winner FROM r GROUP BY dataset) SELECT dataset, round(imbalance, 6) AS imbalance, high_winner, low_winner FROM m LEFT JOIN w USING (dataset)",
    "x8_stress_test": f"""WITH {RESULTS}, {NATIONS}, o AS (SELECT dataset, round(imbalance, 6) AS i, algorithm FROM m JOIN (SELECT dataset, arg_min(algorithm, (-value, algorithm)) AS algorithm FROM r GROUP BY dataset) USING (dataset)),
        e AS (SELECT quantile_cont(i, 0.25) AS a, quantile_cont(i, 0.5) AS b, quantile_cont(i, 0.75) AS c FROM o), k AS (SELECT CASE WHEN i <= a THEN 1 WHEN i <= b THEN 2 WHEN i <= c THEN 3 ELSE 4 END AS bin, algorithm FROM o, e),
        s AS (SELECT bin, algorithm, count(*) AS wins, sum(count(*)) OVER (PARTITION BY bin)::BIGINT AS n FROM k GROUP BY bin, algorithm), z AS (SELECT *, wins / n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM s)
        SELECT bin, algorithm, wins, n, round(p, 9) AS share, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 9) AS lower, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 9) AS upper FROM z""",
    "x9_selection": f"WITH {RESULTS}, {NATIONS}, b AS (SELECT dataset, arg_min(algorithm, (-value, algorithm)) AS label FROM r GROUP BY dataset), {told('b')}",
    "x10_duel": f"WITH {RESULTS}, {NATIONS}, g AS (SELECT algorithm, row_number() OVER (ORDER BY avg(value) DESC, algorithm) AS i FROM r GROUP BY algorithm), b AS (SELECT dataset, CASE WHEN avg(value) FILTER (i = 1) > avg(value) FILTER (i = 2) THEN 1 ELSE 0 END AS label FROM r JOIN g USING (algorithm) GROUP BY dataset), {told('b')}",
    "z1_dimension_sweep": f"""WITH {E}, d AS (SELECT x.id, row_number() OVER (PARTITION BY x.id ORDER BY list_distance(x.v, z.v), z.id) AS rk, list_distance(x.v, z.v) AS d FROM t x JOIN t z ON x.id <> z.id),
        g AS (SELECT unnest([5, 10, 20, 50, 100, 200, 500]) AS k), l AS (SELECT id, k, list(d ORDER BY rk) AS ds, max(rk) AS top FROM d JOIN g ON rk <= k WHERE d > 0 GROUP BY id, k),
        o AS (SELECT k, 1 / (list_sum(list_transform(ds, lambda x: ln(ds[len(ds)]) - ln(x))) / (len(ds) - 1)) AS lid FROM l WHERE top = k)
        SELECT k, round(avg(lid), 6) AS mean_lid, round(stddev_pop(lid), 6) AS std_lid, round(stddev_pop(lid) / avg(lid), 6) AS cv_lid FROM o GROUP BY k""",
    "k1_label_shares": f"WITH {E}, n AS (SELECT q.id, q.label AS y, t.label AS l, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS rk FROM q, t) SELECT id, y, g.label, round(count(*) FILTER (l = g.label) / 7.0::DOUBLE, 9) AS share FROM n, (SELECT DISTINCT label FROM t) g WHERE rk <= 7 GROUP BY ALL",
    "k1_all_rows": f"WITH {E} SELECT q.id, q.label AS y, g.label, round(g.n::DOUBLE / (SELECT count(*) FROM t), 9) AS share FROM q, (SELECT label, count(*) AS n FROM t GROUP BY label) g",
    "s4_stored": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "s10_restored": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "s12_exported": f"WITH {RESULTS}, {RANKS} SELECT algorithm, round(avg(rank), 9) AS avg_rank FROM k GROUP BY algorithm",
    "h3_critical_difference": f"WITH {RESULTS} SELECT count(DISTINCT algorithm) AS k, count(DISTINCT dataset) AS n, round(2.728::DOUBLE * sqrt(5 * 6 / (6.0::DOUBLE * count(DISTINCT dataset))), 9) AS cd FROM r",
    "h4_cohen_d": f"WITH {RESULTS}, {DIFF} SELECT algorithm, round(avg(diff) / stddev_samp(diff), 9) AS d FROM x GROUP BY algorithm",
    "h6_spearman": f"WITH {DOCS}, k AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY blanks) + (count(*) OVER (PARTITION BY blanks) - 1) / 2.0::DOUBLE AS b FROM docs WHERE n_chars IS NOT NULL) SELECT round(corr(a, b), 9) AS rho, count(*) AS n FROM k",
    "h7_kendall": f"WITH {RESULTS}, p AS (SELECT dataset, avg(value) FILTER (algorithm = '1-URGENT') AS x, avg(value) FILTER (algorithm = '5-LOW') AS y FROM r GROUP BY dataset), z AS (SELECT sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM p a JOIN p b ON a.dataset < b.dataset) SELECT round(sum(sx * sy) / sqrt(sum(abs(sx))::DOUBLE * sum(abs(sy))), 9) AS tau, count(*) AS pairs FROM z",
    "h8_wilson": f"WITH {LINES}, w AS (SELECT algorithm, count(*) FILTER (y = 1) / count(*)::DOUBLE AS p, count(*)::DOUBLE AS n FROM l GROUP BY algorithm) SELECT algorithm, round((p + 1.959963984540054::DOUBLE ** 2 / (2 * n) - 1.959963984540054::DOUBLE * sqrt(p * (1 - p) / n + 1.959963984540054::DOUBLE ** 2 / (4 * n * n))) / (1 + 1.959963984540054::DOUBLE ** 2 / n), 9) AS lower, round((p + 1.959963984540054::DOUBLE ** 2 / (2 * n) + 1.959963984540054::DOUBLE * sqrt(p * (1 - p) / n + 1.959963984540054::DOUBLE ** 2 / (4 * n * n))) / (1 + 1.959963984540054::DOUBLE ** 2 / n), 9) AS upper FROM w",
}
