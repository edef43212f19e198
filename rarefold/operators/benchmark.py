"""Repeated stratified folds over tables and models, with leakage-free preparation, into a result store (S5, G1 to G3, 3.1)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.operators.local_models import MODELS, Fold, Model
from rarefold.sources.tables import LabelledTable, ResultStore

RESULT = "dataset string, algorithm string, repeat int, fold int, imbalance_ratio double, tp long, tn long, fp long, fn long, roc_auc double, pr_auc double, error string"


def samples(tables: Sequence[LabelledTable]) -> DataFrame:
    """dataset, id, y, ratio, num (array of double) and cat (array of string) of all tables."""
    parts = [
        t.data.select(
            F.lit(t.name).alias("dataset"),
            F.xxhash64(*t.data.columns).alias("id"),
            "y",
            F.lit(t.ratio_min_maj).alias("ratio"),
            F.array(*[F.col(c).cast("double") for c in t.numbers]).cast("array<double>").alias("num"),
            F.array(*[F.col(c) for c in t.words]).cast("array<string>").alias("cat"),
        )
        for t in tables
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prepared(num: np.ndarray, cat: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Features of all rows, fitted on the training rows: medians, no constants, one-hot, scaled."""
    with np.errstate(all="ignore"):
        middle = np.array([np.median(c[np.isfinite(c)]) if np.isfinite(c).any() else np.nan for c in num[train].T]).reshape(-1)
        num = np.where(np.isnan(num), middle, num) if num.shape[1] else num
        keep = np.isfinite(num[train].std(axis=0)) & (num[train].std(axis=0) > 0)
    parts = [num[:, keep]]
    for c in cat.T:
        words, counts = np.unique([w for w in c[train] if w is not None], return_counts=True)
        if len(words):
            filled = np.array([words[counts.argmax()] if w is None else w for w in c])
            parts.append((filled[:, None] == np.unique(filled[train])[None, :]).astype(float))
    x = np.concatenate(parts, axis=1)
    sd = x[train].std(axis=0)
    return (x - x[train].mean(axis=0)) / np.where(sd > 0, sd, 1)


def auc(y: np.ndarray, p: np.ndarray) -> float | None:
    if not 0 < y.sum() < len(y):
        return None
    r = pd.Series(p).rank().to_numpy()
    n = y.sum()
    return float((r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)))


def precision_area(y: np.ndarray, p: np.ndarray) -> float:
    per = pd.DataFrame({"y": y, "n": 1}).groupby(p).sum().sort_index(ascending=False).cumsum()
    return float(((per["y"].diff().fillna(per["y"])) * per["y"] / per["n"]).sum() / y.sum()) if y.sum() else 0.0


def evaluate(data: DataFrame, models: dict[str, Model], *, n_folds: int = 10, n_repeats: int = 5, seed: int = 42) -> DataFrame:
    """RESULT rows: a task per dataset, repeat and fold prepares the fold once for all models, as tables are small. A model that fails leaves its message."""
    turns = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(k).alias("fold")) for r in range(n_repeats) for k in range(n_folds)]))
    spread = data.withColumn("turn", turns).select("dataset", "id", "y", "ratio", "num", "cat", "turn.*")

    def folded(rows: pd.DataFrame, repeat: int, fold: int) -> tuple[Fold, np.ndarray]:
        y = rows["y"].to_numpy()
        part, rng = np.zeros(len(y), int), np.random.default_rng((seed, repeat))
        for label in (0, 1):
            at = rng.permutation(np.flatnonzero(y == label))
            part[at] = np.arange(len(at)) % n_folds
        train = part != fold
        num = np.array([list(v) for v in rows["num"]], float).reshape(len(y), -1)
        cat = np.array([list(v) for v in rows["cat"]], object).reshape(len(y), -1)
        x = prepared(num, cat, train)
        return Fold(x[train], y[train], x[~train], seed), y[~train]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
        name, repeat, fold = (rows[c][0] for c in ("dataset", "repeat", "fold"))
        made, out = None, []
        for algorithm, model in models.items():
            one = dict.fromkeys([c.split()[0] for c in RESULT.split(", ")]) | {"dataset": name, "algorithm": algorithm, "repeat": repeat, "fold": fold, "imbalance_ratio": rows["ratio"][0]}
            try:
                made = made or folded(rows, int(repeat), int(fold))
                own, truth = made
                p = model(own)
                pred = p > 0.5
                one |= {"tp": int((pred & (truth == 1)).sum()), "tn": int((~pred & (truth == 0)).sum()), "fp": int((pred & (truth == 0)).sum()), "fn": int((~pred & (truth == 1)).sum()), "roc_auc": auc(truth, p), "pr_auc": precision_area(truth, p)}
            except Exception as e:  # noqa: BLE001  a failing model must not end the others
                one["error"] = f"{type(e).__name__}: {e}"
            out.append(one)
        return pd.DataFrame(out).astype({c: "Int64" for c in ("tp", "tn", "fp", "fn")})

    return spread.groupBy("dataset", "repeat", "fold").applyInPandas(run, RESULT)


def run_benchmark(spark: SparkSession, tables: Sequence[LabelledTable], store: ResultStore, names: Sequence[str] | None = None, *, models: dict[str, Model] | None = None, replace: Sequence[str] = (), n_folds: int = 10, n_repeats: int = 5) -> DataFrame:
    """The store's rows after what was missing has been run; algorithms in replace are run anew, and failed ones again."""
    known = models or MODELS
    own = {n: known[n] for n in (names or known)}
    if replace:
        store.drop("algorithm", list(replace))
    done = store.completed(n_folds * n_repeats)
    have = {tuple(r) for r in done.collect()} if done is not None else set()
    for n, m in own.items():
        left = [t for t in tables if (t.name, n) not in have]
        if left:
            store.append(evaluate(samples(left), {n: m}, n_folds=n_folds, n_repeats=n_repeats))
    return store.load()
