"""Classifiers of one small training set, in numpy, for whatever needs linear algebra or topology and for grids of many small folds.

A model takes training rows, their labels (1: the rare class) and queries, and
gives the share for the rare class of each query; over a half means class 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, partial

import numpy as np

from rarefold.functions.geometry import components_for, cut, k_means, looped, pairwise, smallest, tree_edges, ward, whitened_distance
from rarefold.operators.neighbours import TRAIN_BLOCK, Lists
from rarefold.operators.votes import ALPHAS, N_VOTES

Model = Callable[["Fold"], np.ndarray]
#: Bootstraps by which regions are judged.
RUNS = 20
#: Distances of a part of the queries: 32 MB.
PART = 4_000_000
#: Training rows that a query's own metric meets at once, as many as a processor's cache holds, and beyond which neighbours are searched without all distances.
ROWS = 2048


def odd(k: float) -> int:
    k = int(k)
    return k if k % 2 else max(1, k - 1)


def vote(dmin: np.ndarray, dmaj: np.ndarray, k: float, n: int = 5, soft: bool = False) -> tuple[float, int]:
    """Wins and comparisons: the same as votes.votes of a row."""
    if not len(dmin) or not len(dmaj):
        return float(len(dmin) > 0), 0
    k = max(1, int(np.round(k)))
    n = min(n, len(dmin), len(dmaj) // k)
    if n < 1:
        n, k = 1, min(k, len(dmaj))
    a, b = dmin[:n], dmaj[np.minimum(np.arange(1, n + 1) * k, len(dmaj)) - 1]
    if soft:
        with np.errstate(invalid="ignore", divide="ignore"):
            return float(np.where(a + b > 0, b / (a + b), 0.5).sum()), n
    return float((a < b).sum()), n


def searched(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """By query, the first k rows of x by distance, ties by place: the same as of all distances, of which few are computed in full."""
    if not np.isfinite(x).all() or not np.isfinite(q).all():
        return smallest(pairwise(q, x), k)
    lists = Lists(q, k)
    for i in range(0, len(x), TRAIN_BLOCK):
        own = x[i : i + TRAIN_BLOCK]
        lists.add(own, np.zeros(len(own), int), i + np.arange(len(own)), None)
    return lists.found[0][1] if len(x) else np.zeros((len(q), 0), np.int64)


class Fold:
    """Training rows, queries, and what models share of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, q: np.ndarray, seed: int = 42, fitted: dict | None = None) -> None:
        """fitted: what models have made of the training rows alone, which folds of the same ones may share."""
        self.x, self.y, self.q, self.seed = x, y, q, seed
        self.fitted = {} if fitted is None else fitted
        self.n_min, self.n_maj = int((y == 1).sum()), int((y != 1).sum())
        self.r = self.n_maj / max(1, self.n_min)

    @cached_property
    def d(self) -> np.ndarray:
        return pairwise(self.q, self.x)

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.d, axis=1, kind="stable")

    def once(self, name: str, make: Callable[[], object]):
        if name not in self.fitted:
            self.fitted[name] = make()
        return self.fitted[name]

    def nearest(self, k: int) -> np.ndarray:
        """The first k columns of order."""
        held = self.__dict__.get("order", self.__dict__.get("_near"))
        if held is None or held.shape[1] < min(k, len(self.x)):
            held = self._near = smallest(self.d, k) if "d" in self.__dict__ or len(self.x) <= ROWS else searched(self.x, self.q, k)
        return held[:, :k]

    def parts(self, searched: bool = False) -> Iterator[Fold]:
        """Folds of some of the queries each, so many that PART distances to training rows are held at once. searched: for what asks for nearest alone, which holds few distances of many training rows."""
        own = self.starts()
        step = max(own.step, ROWS) if searched and len(self.x) > ROWS else own.step
        for i in range(0, len(self.q), step):
            yield Fold(self.x, self.y, self.q[i : i + step], self.seed, self.fitted)

    def starts(self) -> range:
        """Where the queries of parts begin."""
        return range(0, len(self.q), max(1, PART // max(1, len(self.x))))

    @cached_property
    def dmin(self) -> np.ndarray:
        return np.sort(self.d[:, self.y == 1], axis=1)

    @cached_property
    def dmaj(self) -> np.ndarray:
        return np.sort(self.d[:, self.y != 1], axis=1)

    def lists(self, n_votes: int = 5, k_min: int = 10, k_maj: int | None = None):
        size = lambda n: min(max(int(np.ceil(self.r)) * n + 10, 30), 1000, self.n_maj)
        if k_maj is None and k_min == 10 and n_votes <= max(N_VOTES):  # what grids ask for time and again
            if "_lists" not in self.__dict__:
                self._lists = [*self.lists(max(N_VOTES), k_maj=size(max(N_VOTES)))]
            return [(a, b[: size(n_votes)]) for a, b in self._lists]
        k_maj = k_maj or size(n_votes)
        first = lambda d, k: np.sort(np.partition(d, k - 1, axis=1)[:, :k] if 0 < k < d.shape[1] else d, axis=1)[:, :k]
        return zip(first(self.d[:, self.y == 1], k_min), first(self.d[:, self.y != 1], k_maj), strict=True)

    def inner(self, k: int = 3) -> list[Fold]:
        """Stratified folds of the training rows."""
        rng, part = np.random.default_rng(self.seed), np.zeros(len(self.y), int)
        for label in (0, 1):
            at = rng.permutation(np.flatnonzero(self.y == label))
            part[at] = np.arange(len(at)) % k
        out = []
        for i in range(k):
            if (part == i).any() and (part != i).any():
                f = Fold(self.x[part != i], self.y[part != i], self.x[part == i], self.seed)
                f.truth = self.y[part == i]
                out.append(f)
        return out


def shares(votes: list[tuple[float, int]]) -> np.ndarray:
    return np.array([w / max(1, n) for w, n in votes])


def plain(f: Fold, k: int = 5) -> np.ndarray:
    own = f.y[f.nearest(k)]
    share = own.mean(axis=1)
    return np.where(share == 0.5, 0.5 + 1e-9 * (own[:, 0] * 2 - 1), share)


def weighted(f: Fold, k: int = 5) -> np.ndarray:
    own = f.y[f.nearest(k)]
    a, b = own.sum(axis=1) / max(1, f.n_min), (1 - own).sum(axis=1) / max(1, f.n_maj)
    return a / np.maximum(a + b, 1e-12)


def g_mean(y: np.ndarray, p: np.ndarray) -> float:
    pred = p > 0.5
    a, b = pred[y == 1], ~pred[y != 1]
    return float(np.sqrt((a.mean() if len(a) else 0) * (b.mean() if len(b) else 0)))


def selected(f: Fold, grid: list[dict], make: Callable[..., np.ndarray]) -> dict:
    """The cell with the best mean over inner folds, the first among equals."""
    inner = f.inner()
    mean = [np.mean([g_mean(i.truth, make(i, **cell)) for i in inner]) if inner else 0.0 for cell in grid]
    return grid[int(np.argmax(np.round(mean, 12)))]


def odd_grid(f: Fold) -> list[dict]:
    return [{"k": k} for k in range(1, max(1, int(len(f.y) ** 0.5)) + 1, 2)]


def best_k(f: Fold) -> np.ndarray:
    grid = odd_grid(f)
    return plain(f, **f.once("best_k", lambda: selected(f, grid, listed(grid[-1]["k"]))))


def tallied(f: Fold, grid: list[dict], make: Callable[..., np.ndarray], number: int, of: int, searched: bool = False) -> np.ndarray:
    """By inner fold and cell, how many rows of each class are told right, of a share of the inner queries (one of so many): rows right of class 1, all of class 1, and the same of class 0. Sums over all shares say what selected says."""
    inner = f.inner()
    out = np.zeros((len(inner), len(grid), 4))
    for got, i in zip(out, inner, strict=True):
        q, truth, at = i.q[number::of], i.truth[number::of], 0
        for p in Fold(i.x, i.y, q, i.seed).parts(searched):
            p, y = Fold(p.x, p.y, p.q, p.seed), truth[at : at + len(p.q)]
            at += len(p.q)
            for cell, by in zip(grid, got, strict=True):
                pred = make(p, **cell) > 0.5
                by += pred[y == 1].sum(), (y == 1).sum(), (~pred[y != 1]).sum(), (y != 1).sum()
    return out


def told_best(grid: list[dict], tallies: np.ndarray) -> dict:
    """The cell with the best mean over inner folds, the first among equals."""
    if not len(tallies):
        return grid[0]
    a, n, b, m = np.moveaxis(tallies, 2, 0)
    mean = np.mean(np.sqrt(a / np.maximum(n, 1) * (b / np.maximum(m, 1))), axis=0)
    return grid[int(np.argmax(np.round(mean, 12)))]


def listed(most: int) -> Callable[..., np.ndarray]:
    """plain for up to so many neighbours, whose labels alone are kept of a fold."""
    def of(f: Fold, k: int) -> np.ndarray:
        own, ones = f.once("labels", lambda: labels(f))
        share = ones[:, min(k, ones.shape[1]) - 1] / min(k, ones.shape[1])
        return np.where(share == 0.5, 0.5 + 1e-9 * (own * 2.0 - 1), share)

    def labels(f: Fold) -> tuple[np.ndarray, np.ndarray]:
        """The nearest row's, and how many rare ones are among the first of each number."""
        own = np.concatenate([f.y[p.nearest(most)].astype(np.int8) for p in f.parts(searched=True)])
        return own[:, 0], np.cumsum(own, axis=1, dtype=np.int32)

    return of


def ranked(f: Fold, alpha: float = 1.0, n_votes: int = 5, soft: bool = False) -> np.ndarray:
    return shares([vote(a, b, f.r**alpha, n_votes, soft) for a, b in f.lists(n_votes)])


def pooled(f: Fold, n_votes: tuple = N_VOTES, soft: bool = False) -> np.ndarray:
    out = np.zeros((len(f.q), 2))
    for n in n_votes:
        for alpha in ALPHAS:
            out += np.array([vote(a, b, f.r**alpha, n, soft) for a, b in f.lists(max(n_votes))]).reshape(-1, 2)
    return out[:, 0] / np.maximum(1, out[:, 1])


def by_alpha(f: Fold, soft: bool = False) -> np.ndarray:
    return ranked(f, soft=soft, **selected(f, [{"alpha": a} for a in ALPHAS], ranked))


def by_votes(f: Fold) -> np.ndarray:
    return ranked(f, **selected(f, [{"n_votes": n} for n in N_VOTES], ranked))


JOINT = [{"n_votes": n, "alpha": a} for n in N_VOTES for a in ALPHAS]


def both(f: Fold) -> dict:
    return selected(f, JOINT, ranked)


def jointly(f: Fold) -> np.ndarray:
    return ranked(f, **both(f))


def density(f: Fold, target: int = 50, shrinkage: float = 1.0) -> np.ndarray:
    t = min(target, 10, f.n_min)
    k_maj = min(max(int(np.ceil(f.r)) * 5 + 10, 30, int(np.ceil(2 * t * f.r))), f.n_maj)
    return shares([vote(a, b, ((b <= a[min(t, len(a)) - 1]).sum() + shrinkage * t * f.r) / (t * (1 + shrinkage)) if len(a) else 1) for a, b in f.lists(k_maj=k_maj)])


def odds(a: np.ndarray, b: np.ndarray, r: float, shrinkage: float = 1.0) -> float:
    return float((np.median(np.searchsorted(b, a[:10], side="right") / np.arange(1, len(a[:10]) + 1)) + shrinkage * r) / (1 + shrinkage)) if len(a) else 1.0


def local_odds(f: Fold) -> np.ndarray:
    return shares([vote(a, b, odds(a, b, f.r)) for a, b in f.lists()])


def reference(f: Fold) -> int:
    return max(1, min(max(3, int(f.n_min**0.5)), f.n_min))


def local_count(f: Fold) -> np.ndarray:
    k = reference(f)
    return shares([vote(a, b, (b <= a[k - 1]).sum() / k if len(a) else 1) for a, b in f.lists(k_min=max(10, k), k_maj=f.n_maj)])


def bayesian(f: Fold) -> np.ndarray:
    cell, k = both(f), reference(f)

    def power(a: np.ndarray, b: np.ndarray) -> float:
        n = int((b <= a[k - 1]).sum()) if len(a) else 0
        w = k / (k + n)
        alpha = w * cell["alpha"] + (1 - w) * np.log(n / k) / np.log(f.r) if f.r > 1 and n else cell["alpha"]
        return f.r**alpha

    return shares([vote(a, b, power(a, b), cell["n_votes"]) for a, b in f.lists(max(N_VOTES), k_min=max(10, k), k_maj=f.n_maj)])


def left_out(f: Fold, kind: str = "single") -> np.ndarray:
    trials = min(10 if kind == "odds" else 5, max(0, min(10, f.n_min) - 5))

    def one(a: np.ndarray, b: np.ndarray) -> float:
        if kind == "grid":
            got = [vote(a, b, f.r**x) for x in ALPHAS]
            return sum(w for w, _ in got) / max(1, sum(n for _, n in got))
        w, n = vote(a, b, odds(a, b, f.r) if kind == "odds" else f.r)
        return w / max(1, n)

    return np.array([np.mean([one(np.delete(a, j), b) for j in range(trials)]) if trials and len(a) > 5 else one(a, b) for a, b in f.lists()])


def by_dimension(f: Fold, scale: float = 0.75, least: float = 0.0, sample: int = 200, k: int = 10) -> np.ndarray:
    x = f.x[np.random.default_rng(f.seed).permutation(len(f.x))[:sample]]
    d = pairwise(x, x)
    np.fill_diagonal(d, np.inf)
    rows = [r[r > 0] for r in np.sort(d, axis=1)[:, : min(k, len(x) - 1)]]
    means = [np.log(r[-1] / r[:-1]).mean() if len(r) > 1 else 1.0 for r in rows]
    lids = np.array([1 / m if m > 0 else len(r) for m, r in zip(means, rows, strict=True)])
    spread = float(lids.std() / lids.mean()) if len(lids) > 1 and lids.mean() > 0 else 0.0
    return ranked(f, alpha=float(np.clip(1 - scale * spread, least, 1)))


def climbed(f: Fold, value: Callable[[np.ndarray], float], k_min: int = 1, k_max: int | None = None, orders: Iterable[np.ndarray] | None = None) -> np.ndarray:
    """Shares with k, by query, halved from k_max (the odd root of n) while value of the nearest rows' numbers rises, k_min at least. orders: training rows by query, nearest first, the fold's own if not given."""
    out, top = [], odd(max(1, int(len(f.y) ** 0.5) if k_max is None else k_max))
    for own in f.nearest(top) if orders is None else orders:
        k, best = top, value(own[:top])
        while k > k_min:
            nxt = max(k_min, odd(k // 2))
            if nxt >= k or (v := value(own[:nxt])) <= best:
                break
            k, best = nxt, v
        out.append(f.y[own[:k]].mean())
    return np.array(out)


def label_entropy(f: Fold) -> Callable[[np.ndarray], float]:
    def of(at: np.ndarray) -> float:
        p = np.unique(f.y[at], return_counts=True)[1] / len(at) + 1e-9
        p /= p.sum()
        return -float((p * np.log2(p)).sum())

    return of


def variance_components(f: Fold) -> Callable[[np.ndarray], float]:
    return lambda at: components_for(f.x[at])


def by_entropy(f: Fold, k_min: int = 1, k_max: int | None = None) -> np.ndarray:
    return climbed(f, label_entropy(f), k_min, k_max)


def by_components(f: Fold, k_min: int = 1, k_max: int | None = None) -> np.ndarray:
    return climbed(f, variance_components(f), k_min, k_max)


def topology_k(f: Fold, own: np.ndarray, h0: float = 0.5, h1: float = 0.1, rare: float = 0.15) -> int:
    """k from the shape of the nearest rows: small at borders, the root's root for an outlier, else the root of n."""
    top = min(odd(max(1, int(len(f.y) ** 0.5))), len(own))
    pool = own[:top]
    d = pairwise(f.x[pool], f.x[pool])
    deaths = tree_edges(d)
    size = deaths[-1] if len(deaths) else 0.0
    share = float((f.y[pool] == 1).mean())
    mixed = h0 < 1 and rare < share < 1 - rare  # 1 below whatever the loops are
    if size < 1e-10 or share > 1 - rare or mixed or looped(d, h1 * size):
        return 1
    # every component is born at 0, so that the longest life is always the whole size: the cloud is in parts unless h0 is 1
    if h0 >= 1 or share in (rare, 1 - rare):
        return top
    return odd(int(top**0.5)) if share < rare else 1


def by_topology(f: Fold) -> np.ndarray:
    return np.array([f.y[own[: topology_k(f, own)]].mean() for own in f.nearest(odd(max(1, int(len(f.y) ** 0.5))))])


def two_anchors(f: Fold, k_min: int = 1, k_max: int | None = None, k_min_proba: int = 3) -> np.ndarray:
    """k from how near the query is to the local cloud of each class, in the cloud's own metric. The side of 0.5 is that of k rows, the share that of k_min_proba rows at least, as far as both agree."""
    top = odd(max(1, int(len(f.y) ** 0.5) if k_max is None else k_max))

    rows = f.once("classes", lambda: {c: f.x[f.y == c] for c in (0, 1)})

    def to(q: np.ndarray, d: np.ndarray, label: int) -> float:
        own = rows[label]
        if not len(own):
            return np.inf
        anchor = own[d.argmin()]
        return whitened_distance(q, own[smallest(pairwise(anchor[None], own), top + 1)[0]])

    out, label = [], {c: f.y == c for c in (0, 1)}
    for q, d, own in zip(f.q, f.d, f.nearest(max(top, k_min, k_min_proba)), strict=True):
        a, b = to(q, d[label[1]], 1), to(q, d[label[0]], 0)
        if np.isinf(a) or np.isinf(b) or a + b < 1e-12:
            k = top if np.isinf(a) and not np.isinf(b) else k_min if np.isinf(b) and not np.isinf(a) else odd(int(top**0.5))
        else:
            k = odd(round(k_min + a / (a + b) * (top - k_min)))
        said, share = f.y[own[:k]].mean() > 0.5, f.y[own[: max(k, k_min_proba)]].mean()
        out.append(max(share, np.nextafter(0.5, 1)) if said else min(share, 0.5))
    return np.array(out)


def regions(x: np.ndarray, least: float = 0.05) -> np.ndarray:
    """Region of each row: the Ward cut with the widest gap whose clusters all have enough rows; one region if none is wide enough."""
    n = len(x)
    rows = max(10, int(n**0.5))
    if n < 4 or n // rows < 2:
        return np.zeros(n, int)
    merges, heights = ward(x)
    if heights[-1] < 1e-10:
        return np.zeros(n, int)
    gaps = np.diff(heights) / heights[-1]
    late = np.arange(max(0, n - n // rows - 1), n - 2)  # cuts above which few enough clusters are left
    for i in late[np.argsort(-gaps[late], kind="stable")]:
        if gaps[i] < least:
            break
        label = cut(n, merges, i + 1)
        if np.bincount(label).min() >= rows:
            return label
    return np.zeros(n, int)


def region_k(f: Fold, label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """k of each training row: its region's ratio of classes, r at most."""
    a = np.bincount(label, f.y != 1) + smooth
    b = np.bincount(label, f.y == 1) + smooth
    return np.minimum(a / b, f.r)[label] if label.any() else np.full(len(label), f.r)


def by_regions(f: Fold) -> np.ndarray:
    k = f.once("region_k", lambda: region_k(f, regions(f.x)))[f.nearest(1)[:, 0]]
    return shares([vote(a, b, kk) for (a, b), kk in zip(f.lists(), k, strict=True)])


def bootstraps(y: np.ndarray, seed: int, runs: int) -> Iterator[np.ndarray]:
    """Rows drawn with replacement, class by class."""
    rng = np.random.default_rng(seed)
    for _ in range(runs):
        yield np.concatenate([rng.choice(np.flatnonzero(y == c), int((y == c).sum())) for c in (0, 1) if (y == c).any()])


def judged(f: Fold, drawn: np.ndarray, alpha: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a bootstrap left out, and of each whether regions (1) or r**alpha (-1) alone were right; none where there is one region."""
    label = regions(f.x[drawn])
    out = np.setdiff1d(np.arange(len(f.y)), drawn)
    if not label.any() or not len(out):
        return np.zeros(0, int), np.zeros(0, int)
    b = Fold(f.x[drawn], f.y[drawn], f.x[out])
    k, reach = region_k(b, label), max(1, int(np.ceil(b.r)))
    near, lists = [], []
    for p in b.parts():
        near.append(p.nearest(1)[:, 0])
        lists += p.lists(k_min=1, k_maj=min(reach, b.n_maj))
    own = k[np.concatenate(near)]
    right = lambda k: np.array([vote(x, y, kk, 1)[0] for (x, y), kk in zip(lists, k, strict=True)]) == f.y[out]
    return out, right(own).astype(int) - right(np.full(len(out), b.r**alpha)).astype(int)


def trusted(n: int, runs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    total, count = np.zeros(n), np.zeros(n)
    for out, gain in runs:
        total[out] += gain
        count[out] += 1
    return total / np.maximum(1, count)


def reliability(f: Fold, runs: int = RUNS, alpha: float = 0.75) -> np.ndarray:
    """By training row: how much oftener regions than r**alpha were right where bootstraps left the row out."""
    return trusted(len(f.y), (judged(f, drawn, alpha) for drawn in bootstraps(f.y, f.seed, runs)))


def by_trusted_regions(f: Fold) -> np.ndarray:
    k, trust = f.once("region_k", lambda: region_k(f, regions(f.x))), f.once("trust", lambda: reliability(f))
    cell = f.once("both", lambda: both(f)) if (trust < 0).any() else None
    out = []
    for (a, b), near in zip(f.lists(max(N_VOTES)), f.nearest(1)[:, 0], strict=True):
        out.append(vote(a, b, k[near]) if trust[near] >= 0 else vote(a, b, f.r ** cell["alpha"], cell["n_votes"]))
    return shares(out)


def by_scale(f: Fold, least: float = 0.05) -> np.ndarray:
    """k from the classes inside the radius before the widest gap among the component deaths of the nearest rows."""
    top = max(1, min(max(int(len(f.y) ** 0.5), int(f.r * reference(f))), max(1, f.n_min), len(f.y) - 1))
    out = []
    for own, (a, b) in zip(f.nearest(top), f.lists(k_min=top), strict=True):
        pool = f.x[own[:top]]
        deaths = tree_edges(pairwise(pool, pool))
        k = f.r
        if len(deaths) and deaths[-1] >= 1e-10:
            gaps = np.diff(deaths)
            wide = float(gaps.max() / deaths[-1]) if len(gaps) else 1.0
            if wide >= least:
                scale = deaths[int(gaps.argmax()) if len(gaps) else 0]
                x, y = int((a <= scale).sum()), int((b <= scale).sum())
                if x and not y:
                    out.append((1.0, 1))
                    continue
                k = y / x if x else f.r
        out.append(vote(a, b, k))
    return shares(out)


def crowding(a: np.ndarray, b: np.ndarray, ref: int) -> np.ndarray:
    """Rows of b inside the ball around each row of a that reaches its ref-th other row of a, by ref."""
    near, step, out = min(ref, len(a) - 1), max(1, PART // max(1, len(a), len(b))), []
    for i in range(0, len(a), step):
        own = a[i : i + step]
        reach = np.partition(pairwise(own, a), near, axis=1)[:, near]
        out.append(np.count_nonzero(pairwise(own, b) <= reach[:, None], axis=1) / ref)
    return np.concatenate(out)


def breaks(values: np.ndarray, least_rows: int, least_gap: float) -> list[int]:
    """Where rising values part: at the widest gap that leaves enough rows on either side, if it is wide enough against the whole range, then so within both sides."""
    span = values[-1] - values[0]
    if span < 1e-9:
        return []

    def inside(low: int, high: int) -> list[int]:
        at = np.arange(low + least_rows, high - least_rows + 1)
        if not len(at):
            return []
        gaps = (values[at] - values[at - 1]) / span
        widest = len(at) - 1 - int(gaps[::-1].argmax())
        mid = int(at[widest])
        return [*inside(low, mid), mid, *inside(mid, high)] if gaps[widest] >= least_gap else []

    return inside(0, len(values))


def by_density_regions(f: Fold, least: float = 0.1) -> np.ndarray:
    """k from the nearest centre of each class: rare rows by gaps in their local odds, common rows by as many means."""
    a, b = f.x[f.y == 1], f.x[f.y != 1]
    if not len(a) or not len(b):
        return np.full(len(f.q), float(len(a) > 0))
    ref = max(1, min(max(3, int(len(a) ** 0.5)), len(a) - 1))

    def centres() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        odds = crowding(a, b, ref)
        order = np.argsort(odds, kind="stable")
        groups = np.split(order, breaks(odds[order], ref, least))
        cb, label = k_means(b, min(len(groups), len(b)), f.seed)
        return np.array([a[g].mean(axis=0) for g in groups]), np.array([len(g) for g in groups]), cb, np.bincount(label, minlength=len(cb))

    ca, na, cb, nb = f.once("centres", centres)
    da, db = pairwise(f.q, ca), pairwise(f.q, cb)
    i, j = da.argmin(axis=1), db.argmin(axis=1)
    k = nb[j] * (da.min(axis=1) + 1e-9) / (na[i] * (db.min(axis=1) + 1e-9))
    return shares([vote(x, y, kk) for (x, y), kk in zip(f.lists(k_min=max(10, ref)), k, strict=True)])


def synthetic(f: Fold, k: int = 5) -> Fold:
    """The fold with rare rows added up to parity, each between a rare row and one of its nearest (P14); the fold itself where too few are rare."""
    at = np.flatnonzero(f.y == 1)
    more = f.n_maj - f.n_min
    near = max(1, min(k, len(at) - 1))
    if len(at) < 2 or more <= 0:
        return f
    rng = np.random.default_rng(f.seed)
    order = np.concatenate([p.nearest(near + 1) for p in Fold(f.x[at], f.y[at], f.x[at]).parts()])[:, 1 : near + 1]
    base, pick, gap = rng.integers(0, len(at), more), rng.integers(0, near, more), rng.random((more, 1))
    start = f.x[at[base]]
    new = start + gap * (f.x[at[order[base, pick]]] - start)
    return Fold(np.concatenate([f.x, new]), np.concatenate([f.y, np.ones(more, f.y.dtype)]), f.q, f.seed)


def with_synthetic(f: Fold, model: Model) -> np.ndarray:
    """The model on synthetic rows, which are made once for all parts of the queries."""
    full = f.once("synthetic", lambda: synthetic(f))
    return np.concatenate([model(p) for p in Fold(full.x, full.y, f.q, full.seed, f.once("on synthetic", dict)).parts(searched=True)])


def metric_orders(f: Fold, pool: int, ridge: float, least: int, most: int) -> Iterator[np.ndarray]:
    """most training rows by query, nearest first in the metric that the classes of its pool of near rows suggest."""
    p = f.x.shape[1]
    for q, own in zip(f.q, f.nearest(max(most, least, pool)), strict=True):
        at = own[: max(least, min(pool, len(own)))]
        x, y = f.x[at], f.y[at]
        labels = [c for c in (0, 1) if (y == c).sum() > 1]
        if len(labels) == 2:
            within = sum((y == c).mean() * np.cov(x[y == c], rowvar=False).reshape(p, p) for c in labels) + 1e-6 * np.eye(p)
            values, axes = np.linalg.eigh(within)
            root = axes @ np.diag(values.clip(1e-12) ** -0.5) @ axes.T
            mean = x.mean(axis=0)
            between = sum((y == c).mean() * np.outer(x[y == c].mean(axis=0) - mean, x[y == c].mean(axis=0) - mean) for c in labels)
            metric = root @ (root @ between @ root + ridge * np.eye(p)) @ root
            d = np.empty(len(f.x))
            for i in range(0, len(d), ROWS):
                gap = f.x[i : i + ROWS] - q
                d[i : i + ROWS] = ((gap @ metric) * gap).sum(axis=1)
            own = smallest(d[None], most)[0]
        yield own


def local_metric(f: Fold, k: int = 5, pool: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Discriminant adaptive neighbours: k of them in the metric around each query (K6)."""
    return np.array([f.y[own[:k]].mean() for own in metric_orders(f, pool, ridge, k, k)])


def adaptive_metric(f: Fold, strategy: str = "entropy", k_min: int = 1, k_max: int | None = None, pool: int = 50, ridge: float = 1.0) -> np.ndarray:
    """The same with k chosen around each query, by the labels' entropy or, with strategy eigen, the components of the near rows (K6)."""
    value = {"entropy": label_entropy, "eigen": variance_components}[strategy](f)
    most = odd(max(1, int(len(f.y) ** 0.5) if k_max is None else k_max))
    return climbed(f, value, k_min, k_max, metric_orders(f, pool, ridge, k_max or 1, max(most, k_min)))


#: Models that ask for nearest alone.
SEARCHED = {"knn_synthetic_best_k"}
#: Every model by name; more may be added by the caller.
MODELS: dict[str, Model] = {
    "knn": plain,
    "knn_best_k": best_k,
    "knn_weighted": weighted,
    "knn_entropy": by_entropy,
    "knn_components": by_components,
    "knn_topology": by_topology,
    "knn_two_anchors": two_anchors,
    "knn_local_metric": local_metric,
    "knn_local_metric_entropy": adaptive_metric,
    "knn_local_metric_eigen": partial(adaptive_metric, strategy="eigen"),
    "knn_synthetic": partial(with_synthetic, model=plain),
    "knn_synthetic_best_k": partial(with_synthetic, model=best_k),
    "rank": ranked,
    "rank_soft": partial(ranked, soft=True),
    "rank_alpha": by_alpha,
    "rank_alpha_soft": partial(by_alpha, soft=True),
    "rank_votes": by_votes,
    "rank_joint": jointly,
    "rank_pooled": pooled,
    "rank_pooled_soft": partial(pooled, n_votes=(5,), soft=True),
    "rank_density": density,
    "rank_local_odds": local_odds,
    "rank_local_count": local_count,
    "rank_bayesian": bayesian,
    "rank_dimension": by_dimension,
    "rank_density_regions": by_density_regions,
    "rank_left_out": left_out,
    "rank_left_out_grid": partial(left_out, kind="grid"),
    "rank_left_out_odds": partial(left_out, kind="odds"),
    "rank_regions": by_regions,
    "rank_trusted_regions": by_trusted_regions,
    "rank_scale": by_scale,
}


#: Fits of training rows that are long enough to be dealt to tasks: how many jobs there are for so many rows, a job's numbers, and what a fold holds of them all.


def trusted_jobs(n: int) -> int:
    return 1 + RUNS + shares_of(n)


def shares_of(n: int) -> int:
    return max(1, min(64, n // 2048))


def trusted_job(f: Fold, job: int) -> np.ndarray:
    """First the regions, then a bootstrap each, then shares of the inner folds."""
    if not job:
        return region_k(f, regions(f.x))
    if job <= RUNS:
        return np.stack(judged(f, [*bootstraps(f.y, f.seed, job)][-1])).astype(float).ravel()
    return tallied(f, JOINT, ranked, job - 1 - RUNS, shares_of(len(f.y))).ravel()


def trusted_fitted(f: Fold, jobs: list[np.ndarray]) -> None:
    f.fitted["region_k"] = jobs[0]
    f.fitted["trust"] = trusted(len(f.y), ((own[: len(own) // 2].astype(int), own[len(own) // 2 :].astype(int)) for own in jobs[1 : RUNS + 1]))
    f.fitted["both"] = told_best(JOINT, sum(jobs[RUNS + 1 :]).reshape(-1, len(JOINT), 4))


def synthetic_job(f: Fold, job: int) -> np.ndarray:
    full = synthetic(f)
    grid = odd_grid(full)
    inner = Fold(full.x, full.y, full.q, full.seed)
    return tallied(inner, grid, listed(grid[-1]["k"]), job, shares_of(len(f.y)), searched=True).ravel()


def synthetic_fitted(f: Fold, jobs: list[np.ndarray]) -> None:
    full = f.fitted["synthetic"] = synthetic(f)
    grid = odd_grid(full)
    f.fitted["on synthetic"] = {"best_k": told_best(grid, sum(jobs).reshape(-1, len(grid), 4))}


DEALT: dict[str, tuple[Callable[[int], int], Callable[[Fold, int], np.ndarray], Callable[[Fold, list[np.ndarray]], None]]] = {
    "rank_trusted_regions": (trusted_jobs, trusted_job, trusted_fitted),
    "knn_synthetic_best_k": (shares_of, synthetic_job, synthetic_fitted),
}
