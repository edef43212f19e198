"""Geometry of small point sets in numpy: spanning trees, Ward trees, persistence, local metrics."""

from __future__ import annotations

import numpy as np


#: Distances at a time, as many as a processor's cache holds.
CELLS = 1 << 16


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    b = np.ascontiguousarray(b.T)
    width = max(1, min(len(out.T), CELLS))
    rows = max(1, CELLS // width)
    for i in range(0, len(a), rows):
        for j in range(0, out.shape[1], width):
            part = out[i : i + rows, j : j + width]
            for d in range(a.shape[1]):
                step = a[i : i + rows, d, None] - b[None, d, j : j + width]
                step *= step
                part += step
    return np.sqrt(out, out=out)


def smallest(d: np.ndarray, k: int) -> np.ndarray:
    """By row, the first k of a stable argsort."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    far = np.partition(d, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(d), k), np.int64)
    for row, (own, most) in enumerate(zip(d, far, strict=True)):
        at = np.flatnonzero(own <= most) if most == most else np.arange(len(own))
        out[row] = at[np.argsort(own[at], kind="stable")[:k]]
    return out


def spanning_tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs of a minimum spanning tree, and their lengths."""
    n = len(d)
    if n < 2:
        return np.zeros((0, 2), int), np.zeros(0)
    near, by, open_, pairs, out = d[0].copy(), np.zeros(n, int), np.ones(n, bool), [], []
    open_[0] = False
    for _ in range(n - 1):
        k = int(np.where(open_, near, np.inf).argmin())
        out.append(near[k])
        pairs.append((by[k], k))
        open_[k] = False
        by[d[k] < near] = k
        near = np.minimum(near, d[k])
    return np.array(pairs), np.array(out)


def tree_edges(d: np.ndarray) -> np.ndarray:
    """Ascending edge lengths of a minimum spanning tree: the deaths of components (H0)."""
    return np.sort(spanning_tree(d)[1])


def ward(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges (pairs of rows that stand for their clusters) and heights, by rising height: the distance of centres, weighted by sizes, of the clusters that cost least to join.

    By turns, all pairs of clusters that cost each other least are joined: no other
    cluster comes nearer by that, so that only those are searched anew whose
    nearest one is gone.
    """
    n = len(x)
    row, place = np.arange(n), np.arange(n)  # first rows of clusters by position, and back
    centre, size = np.ascontiguousarray(x, float).copy(), np.ones(n)
    norm, near, cost = (centre * centre).sum(axis=1), np.full(n, -1), np.full(n, np.inf)
    unsure = 8e-15 * (centre.shape[1] + 6)
    merges, heights = [np.zeros((0, 2), int)], [np.zeros(0)]

    def search(some: np.ndarray) -> None:
        """Costs by one product of matrices, for clusters of one size at a time, say which few are computed in full."""
        most, step = norm.max(), max(16, CELLS * 32 // len(row))
        for own in np.split(some, np.flatnonzero(np.diff(size[some])) + 1):
            weight = size / (size[own[0]] + size)
            right = np.concatenate([centre, norm[:, None], np.ones((len(row), 1))], axis=1) * weight[:, None]
            for at in (own[i : i + step] for i in range(0, len(own), step)):
                rough = np.concatenate([-2 * centre[at], np.ones((len(at), 1)), norm[at, None]], axis=1) @ right.T
                rough[np.arange(len(at)), at] = np.inf
                least = rough.min(axis=1) + unsure * (norm[at] + most)
                i, j = np.nonzero(rough <= least[:, None])
                i = at[i]
                gap = centre[j] - centre[i]
                full = 2 * size[j] * size[i] / (size[j] + size[i]) * (gap * gap).sum(axis=1)
                order = np.lexsort((j, full, i))
                first = order[np.unique(i[order], return_index=True)[1]]
                near[i[first]], cost[i[first]] = row[j[first]], full[first]

    stale = np.arange(n)
    while len(row) > 1:
        search(stale[np.argsort(size[stale], kind="stable")])
        to = place[near]
        lo = np.flatnonzero((to[to] == np.arange(len(row))) & (np.arange(len(row)) < to))
        if not len(lo):  # equal costs in a ring
            a = int(cost.argmin())
            lo, to = np.array([min(a, to[a])]), np.where(np.arange(len(row)) == min(a, to[a]), max(a, to[a]), to)
        hi = to[lo]
        merges.append(np.stack([row[lo], row[hi]], axis=1))
        heights.append(np.sqrt(cost[lo]))
        total = size[lo] + size[hi]
        centre[lo] = (centre[lo] * size[lo, None] + centre[hi] * size[hi, None]) / total[:, None]
        size[lo] = total
        norm[lo] = (centre[lo] * centre[lo]).sum(axis=1)
        gone = np.zeros(len(row), bool)
        gone[lo] = gone[hi] = True
        anew = gone | gone[to]
        keep = np.ones(len(row), bool)
        keep[hi] = False
        row, centre, size, norm, near, cost = (v[keep] for v in (row, centre, size, norm, near, cost))
        place[row], stale = np.arange(len(row)), np.flatnonzero(anew[keep])
    merged, height = np.concatenate(merges), np.concatenate(heights)
    order = np.argsort(height, kind="stable")
    return merged[order], height[order]


def cut(n: int, merges: np.ndarray, count: int) -> np.ndarray:
    """Cluster numbers from 0 after the first count merges."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in merges[:count]:
        root[find(j)] = find(i)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def loops(d: np.ndarray) -> np.ndarray:
    """Birth and death of loops (H1) of the Rips filtration, those of no length left out: columns of triangles are reduced over two elements."""
    n = len(d)
    i, j = np.triu_indices(n, 1)
    order = np.argsort(d[i, j], kind="stable")
    rank = np.zeros((n, n), int)
    rank[i[order], j[order]] = rank[j[order], i[order]] = np.arange(len(order))
    length = d[i, j][order]
    triples = [(max(rank[a, b], rank[a, c], rank[b, c]), rank[a, b], rank[a, c], rank[b, c]) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n)]
    held: dict[int, set[int]] = {}
    out = []
    for last, *edges in sorted(triples):
        column = set(edges)
        while column and (low := max(column)) in held:
            column ^= held[low]
        if column:
            held[low] = column
            if length[last] > length[low]:
                out.append((length[low], length[last]))
    return np.array(out).reshape(-1, 2)


def looped(d: np.ndarray, least: float) -> bool:
    """Whether the lengths of loops(d) sum to over least.

    A loop is born with each edge outside the spanning tree, and dies with the first
    triangle on that edge at the soonest. Where these bounds are enough, no triangle
    is reduced.
    """
    n = len(d)
    i, j = np.triu_indices(n, 1)
    tree = np.zeros((n, n), bool)
    pairs = spanning_tree(d)[0]
    tree[pairs[:, 0], pairs[:, 1]] = tree[pairs[:, 1], pairs[:, 0]] = True
    i, j = i[~tree[i, j]], j[~tree[i, j]]
    order = np.argsort(d[i, j], kind="stable")
    step, total = max(16, CELLS // max(1, n)), 0.0
    for k in (order[at : at + step] for at in range(0, len(order), step)):
        whole = np.maximum(d[i[k]], d[j[k]])
        whole[np.arange(len(k)), i[k]] = whole[np.arange(len(k)), j[k]] = np.inf
        total += float((whole.min(axis=1) - d[i[k], j[k]]).clip(0).sum())
        if total > least * (1 + 1e-9):
            return True
    rings = loops(d)
    return bool((rings[:, 1] - rings[:, 0]).sum() > least)


def components_for(x: np.ndarray, share: float = 0.95) -> int:
    """Principal components that hold the share of the variance."""
    return explaining(np.linalg.eigvalsh(np.cov(x, rowvar=False).reshape(x.shape[1], x.shape[1])), share) if len(x) > 1 else 1


def explaining(variances: np.ndarray, share: float = 0.95) -> int:
    """How many of a covariance's rising eigenvalues, from the largest, hold the share of their sum."""
    values = variances[::-1].clip(0)
    if values.sum() < 1e-12:
        return 1
    return int(np.searchsorted(values.cumsum() / values.sum(), share) + 1)


def whitened_distance(x: np.ndarray, cloud: np.ndarray) -> float:
    """Mahalanobis distance from x to the centre of a cloud, with a small ridge."""
    if len(cloud) < 2:
        return float(np.linalg.norm(x - cloud[0]))
    c = np.cov(cloud, rowvar=False).reshape(cloud.shape[1], cloud.shape[1])
    c = c + np.eye(len(c)) * (1e-6 * np.trace(c) / len(c) + 1e-12)
    values, axes = np.linalg.eigh(c)
    return float(np.sqrt(((axes.T @ (x - cloud.mean(axis=0))) ** 2 / values.clip(1e-12)).sum()))


def k_means(x: np.ndarray, k: int, seed: int, tries: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of the best of some seeded runs."""
    rng, best = np.random.default_rng(seed), (np.inf, None, None)
    for _ in range(tries):
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:
            d = (pairwise(x, np.array(centres)) ** 2).min(axis=1)
            centres.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() else rng.integers(len(x))])
        c = np.array(centres)
        for _ in range(100):
            d = pairwise(x, c)
            label = d.argmin(axis=1)
            new = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = float((d.min(axis=1) ** 2).sum())
        if cost < best[0]:
            best = (cost, c, label)
    return best[1], best[2]


def noise_components(n: int, p: int, share: float = 0.95, draws: int = 20, seed: int = 0) -> float:
    """Components that pure noise of the same shape needs, on average."""
    rng = np.random.default_rng(seed)
    return float(np.mean([components_for(rng.standard_normal((n, p)), share) for _ in range(draws)]))
