"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import utf8

#: Labelled documents that a model learns from at most: those with the smallest hashes of their ids.
SAMPLE = 6000
BITS = 18
KEPT_WORDS = 300_000
SCALE = 8.0
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(word: bytes) -> bytes:
    """How a word is written, with its letters left out: runs of upper case, lower case, digits and other ASCII signs."""
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word.decode("utf-8", "replace"))
    return re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d+", "0", s)).encode()


class Grams:
    """Feature numbers of texts: words, pairs of words, and the same of the words' shapes and repeats, by hash.

    A feature's value is its share of the text's words, times SCALE.
    """

    def __init__(self, bits: int = BITS, kept: int = KEPT_WORDS) -> None:
        self.shift, self.kept = np.uint64(64 - bits), kept
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros((1024, 2), np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Rows of hashes for words; those beyond the bound are numbered for this call only."""
        number = self.number
        if new := {w for w in words if w not in number}:
            if len(number) + len(new) > self.kept:
                number.clear()
                new = set(words)
            while len(number) + len(new) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            for w in new:
                low, s = w.lower(), shape(w)
                self.hashes[len(number)] = zlib.crc32(low) << 20 | zlib.adler32(low) & 0xFFFFF, zlib.crc32(s, 77) << 8 | len(s) & 255
                number[w] = len(number)
        return np.fromiter(map(number.__getitem__, words), np.int32, len(words))

    def __call__(self, text: bytes) -> np.ndarray:
        """The features of a text, one of each kind per word."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64)
        rows = self.numbers(words)
        both = self.hashes[rows]
        w, s = both[:, 0] * M1, both[:, 1] * M2
        last_w, last_s = np.roll(w, 1), np.roll(s, 1)
        last_w[0] = last_s[0] = 0
        raw = np.stack([w, (last_w >> np.uint64(7)) ^ w * M2, s + np.uint64(1), (last_s >> np.uint64(7)) ^ s * M1 + np.uint64(2), (w == last_w) * M1 + np.uint64(3)])
        raw ^= raw >> np.uint64(29)
        raw *= M2
        return (raw >> self.shift).astype(np.int64).ravel()

    def counted(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Features and values of a text, each feature once."""
        found, counts = np.unique(self(text), return_counts=True)
        return found, (counts * (5 * SCALE / max(1, counts.sum()))).astype(np.float32)

    def dot(self, text: bytes, weights: np.ndarray) -> float:
        """The same features and values times weights, without sorting."""
        found = self(text)
        return float(weights[found].sum(dtype=np.float64)) * (5 * SCALE / max(1, len(found)))


class Model:
    """Follow the regularised leader, coordinate by coordinate, for logistic loss."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.2, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.bits = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), bits

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 6) -> Model:
        """rows: features, values and label. The last coordinate is the intercept."""
        for _ in range(rounds):
            for i, values, y in rows:
                at, v = np.append(i, 1 << self.bits), np.append(values, 1.0)
                w = self.weights(at)
                g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[at] = n + g * g
        return self


def remainder(doc_id: Column, of: int) -> Column:
    """The id's fold, from crc32 of its text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def trained(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", sample: int = SAMPLE, folds: int = 5) -> np.ndarray:
    """Weights from at most sample labelled documents outside fold 0.

    Only so many ids, a fixed number whatever the size of the tables, are
    broadcast, and only their features are sent to the driver. Ids without one
    clear label (null, or both) are left out; of rows that share an id, the text
    that is first in order of bytes counts. Null texts are empty; without any label
    all weights are 0. Other columns of docs and labels are not read.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.min(label).alias("y_"), F.max(label).alias("y2_")).where("y_ = y2_")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id_"), F.col("y_").cast("int").alias("y_"))
    each = docs.select(F.col("doc_id").alias("doc_"), utf8(text).alias("bytes_")).join(F.broadcast(known), F.col("doc_") == F.col("id_"))
    own = each.groupBy("id_", "y_").agg(F.min("bytes_").alias("bytes_"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for batch in batches:
            got = [grams.counted(t) for t in batch["bytes_"]]
            yield pd.DataFrame({"id_": batch["id_"], "y_": batch["y_"], "at": [i.astype("<i4").tobytes() for i, _ in got], "v": [v.tobytes() for _, v in got]})

    got = own.mapInPandas(features, "id_ long, y_ int, at binary, v binary").toArrow()
    ids, y = got["id_"].to_pylist(), got["y_"].to_pylist()  # an id has one row
    order = sorted(range(len(ids)), key=lambda k: (zlib.crc32(b"%d" % ids[k]), ids[k]))[:sample]
    at, v = ([x.as_buffer() for x in got[c]] for c in ("at", "v"))  # views, no copies
    model = Model().learn([(np.frombuffer(at[k], "<i4"), np.frombuffer(v[k], np.float32), y[k]) for k in order])
    return model.weights(slice(None)).astype(np.float32)


def scored(docs: DataFrame, weights: np.ndarray, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with score, the chance of label 1 by the whole text: a sparse dot product.

    Null texts are empty, and get the intercept's. Texts may have any length, equal
    texts get equal scores, ids are not read; an empty table gives none. A column of
    docs that is named like score is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def dot(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, w = Grams(), sent.value
        for batch in batches:
            sums = np.array([grams.dot(t, w) for t in batch]) + float(w[-1])
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    return docs.withColumn(score, dot(utf8(text)))
