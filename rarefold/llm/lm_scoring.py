"""LM scoring: a small causal self-attention model over subword ids, written and trained in numpy.

Texts are read in blocks of STRIDE ids; a block attends to itself, causally, and
to the block before it, so that windows overlap and every id is scored once.
The next id's chance is that of its slot's class and that of the slot within the
class, both from the model, times its share of the slot, from counts over all
training documents: frequent ids have slots of their own, the others share slots
of about equal weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import utf8, written
from rarefold.llm.packing import default_tokenizer, encoder
from rarefold.llm.quality_classifier import remainder

STRIDE, WIDTH, CLASSES, LEAVES, INPUTS = 16, 16, 32, 32, 1024
SLOTS, OWN = CLASSES * LEAVES, CLASSES * LEAVES - 16
#: Documents that the first weights are fitted to, as a start that all tasks share; training itself goes over all documents outside the fold.
START = 256
#: Times that tasks' weights are averaged, and ids that are learnt from at least: small corpora are gone over more than once.
ROUNDS, LEAST = 4, 1500 * 256 * STRIDE
BLOCK_BYTES = 32 << 20
ROWS = 256
END = 0
#: Ids that are laid out for training at a time, groups of sums, and the first round's rate.
GROUP, FAN, RATE = 1 << 18, 16, 0.01
SUMS = "fan int, total binary, weight binary"


class Slots:
    """From ids to slots and inputs, and each id's share of its slot. counts: of every id, and of text ends as the last."""

    def __init__(self, counts: np.ndarray) -> None:
        smooth = counts + 1.0
        order = np.argsort(-smooth[:-1], kind="stable")
        rest = smooth[order[OWN - 1 :]]
        into = np.minimum((rest.cumsum() - rest) * (SLOTS - OWN) / max(rest.sum(), 1), SLOTS - OWN - 1).astype(np.int64)
        self.slot = np.zeros(len(counts), np.int32)
        self.slot[order[: OWN - 1]] = np.arange(1, OWN)[: len(order)]
        self.slot[order[OWN - 1 :]] = OWN + into
        self.weight = np.maximum(np.bincount(self.slot, smooth, SLOTS), 1e-9)
        self.share = np.log10(smooth / self.weight[self.slot]).astype(np.float32)
        self.input = np.zeros(len(counts), np.int32)
        self.input[order] = np.where(np.arange(len(order)) < INPUTS - 65, np.arange(1, len(order) + 1), INPUTS - 64 + order % 64)


def blocked(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each text, after an end sign, in rows of STRIDE: ids (-1: none), the row before each (-1: none), and each row's text."""
    rows = [-(-(len(t) + 1) // STRIDE) for t in texts]
    out = np.full((sum(rows), STRIDE), -1, np.int64)
    before = np.arange(-1, len(out) - 1)
    flat, at = out.ravel(), 0
    for t, n in zip(texts, rows, strict=True):
        before[at] = -1
        flat[at * STRIDE] = -2
        flat[at * STRIDE + 1 : at * STRIDE + 1 + len(t)] = t
        at += n
    return out, before, np.repeat(np.arange(len(texts)), rows)


FAR = np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None, :]  # how far back each key is of each query
MASK = np.where(FAR >= 0, 0.0, -1e9).astype(np.float32)


def by_block(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """a @ w, for each STRIDE rows alone: what a row gets doesn't depend, by rounding, on how many others there are."""
    return (a.reshape(-1, STRIDE, a.shape[1]) @ w).reshape(len(a), -1)


class Adam:
    """Steps of parameters p, in place: they become parts of one vector, so that a step takes few passes."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p, self.t, at = p, 0, 0
        self.flat = np.concatenate([v.ravel() for v in p.values()])
        for k, v in p.items():
            p[k] = self.flat[at : at + v.size].reshape(v.shape)
            at += v.size
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        lr = rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        all_ = np.concatenate([g[k].ravel() for k in self.p])
        self.m *= 0.9
        self.m += 0.1 * all_
        all_ *= all_
        all_ *= 0.01
        self.v *= 0.99
        self.v += all_
        np.sqrt(self.v, out=all_)
        all_ += 1e-8
        np.divide(self.m, all_, out=all_)
        all_ *= lr
        self.flat -= all_


class Attention:
    """One layer: embeddings, causal attention with a bias by distance, a rectified layer, both added up; then classes, and slots in each.

    weight: of each slot, for its first chance.
    """

    def __init__(self, weight: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * 0.3 / math.sqrt(s[0] if s[0] < 100 else 10)).astype(np.float32)
        d = WIDTH
        self.p = {"E": r(INPUTS, d), "Q": r(d, d), "K": r(d, d), "V": r(d, d), "O": r(d, d), "D": np.zeros(2 * STRIDE, np.float32), "A": r(d, 2 * d), "B": r(2 * d, d), "W": r(d, CLASSES), "W2": r(CLASSES, d, LEAVES)}
        weight = weight.reshape(CLASSES, LEAVES)
        self.p |= {"b": np.log(weight.sum(axis=1) / weight.sum()).astype(np.float32), "b2": np.log(weight / weight.sum(axis=1, keepdims=True)).astype(np.float32)}

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """From inputs to queries that meet inputs themselves, and from weighted inputs to what is added: Q with K, and V with O, of which only the products matter."""
        p = self.p
        return p["Q"] @ p["K"].T / np.float32(math.sqrt(WIDTH)), p["V"] @ p["O"]

    def forward(self, x: np.ndarray, before: np.ndarray, safe: bool = True, times: Callable = np.matmul) -> tuple:
        """x: inputs (rows, STRIDE); before: -1 for rows that have none before, else the index of the row above. Unless safe, large exponents may overflow.

        Weights of keys come without their division by their sums. The last result has a one as its last column, which biases meet.
        """
        p, n, d = self.p, len(x), WIDTH
        h = np.empty((n + 1, STRIDE, d), np.float32)
        h[0] = 0
        np.take(p["E"], x, axis=0, out=h[1:], mode="clip")
        both = np.lib.stride_tricks.as_strided(h, (n, 2 * STRIDE, d), h.strides, writeable=False)  # the row above, then the own
        flat = h[1:].reshape(-1, d)
        into, added = self.folded()
        q = times(flat, into).reshape(n, STRIDE, d)
        s = q @ both.transpose(0, 2, 1)
        s += p["D"][np.clip(FAR, 0, 2 * STRIDE - 1)] + MASK
        s[before < 0, :, :STRIDE] = -1e9
        if safe:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        part = 1 / times(s.reshape(-1, 2 * STRIDE), np.ones((2 * STRIDE, 1), np.float32)).ravel()
        c = (s @ both).reshape(-1, d)
        c *= part[:, None]
        h1 = times(c, added)
        h1 += flat
        a = times(h1, p["A"])
        np.maximum(a, np.zeros_like(a), out=a)
        h2 = np.empty((n * STRIDE, d + 1), np.float32)
        h2[:, d] = 1
        np.add(h1, times(a, p["B"]), out=h2[:, :d])
        return flat, both, q, s, part, c, h1, a, h2

    def outputs(self, h2: np.ndarray, slot: np.ndarray, times: Callable = np.matmul, leaf_type: type = np.float32) -> tuple:
        """Logits of classes, and, by class, of the slots in each right answer's class: right classes, right leaves by class, the order by class, each class's bounds in it, h2 in it, and both kinds of logits.

        leaf_type: what the latter are computed in; doubles, once rounded, don't tell an id's place among its class.
        """
        cls = (slot // LEAVES).astype(np.uint8)  # bytes sort in linear time
        order = np.argsort(cls, kind="stable")
        bounds = [0, *np.bincount(cls, minlength=CLASSES).cumsum().tolist()]
        own, leaves = h2.take(order, axis=0).astype(leaf_type, copy=False), np.empty((len(h2), LEAVES), np.float32)
        inner = np.concatenate([self.p["W2"], self.p["b2"][:, None]], axis=1).astype(leaf_type, copy=False)
        for k in range(CLASSES):
            if bounds[k] < bounds[k + 1]:
                np.matmul(own[bounds[k] : bounds[k + 1]], inner[k], out=leaves[bounds[k] : bounds[k + 1]])
        return cls, (slot % LEAVES).take(order), order, bounds, own, times(h2, np.concatenate([self.p["W"], self.p["b"][None]])), leaves

    def log10(self, x: np.ndarray, before: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Log10 chance of each next slot (rows, STRIDE), equal for equal rows after equal rows."""
        at, whole = np.arange(slot.size), None
        for safe in (False, True):
            with np.errstate(all="ignore"):
                cls, leaf, order, _, _, *both = self.outputs(self.forward(x, before, safe, by_block)[-1], slot.ravel(), by_block, float)
                got = []
                for z, right in zip(both, (cls, leaf), strict=True):
                    if safe:
                        z -= z.max(axis=1, keepdims=True)
                    own = z.ravel().take(at * z.shape[1] + right)
                    np.exp(z, out=z)
                    got.append(own - np.log(z.sum(axis=1)))
                out = got[0]
                out[order] += got[1]
            out = out.reshape(slot.shape)
            if whole is not None:  # safe, but only for the rows that need it
                whole = np.where(fine[:, None], whole, out)
                break
            whole, fine = out, np.isfinite(out).all(axis=1)
            if fine.all():
                break
        return whole / np.float32(math.log(10))

    def gradient(self, x: np.ndarray, before: np.ndarray, slot: np.ndarray, good: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, n, d = self.p, len(x), WIDTH
        with np.errstate(all="ignore"):
            made = self.forward(x, before, safe=False)
        if not np.isfinite(made[-1]).all():
            made = self.forward(x, before)
        h, both, q, s, part, c, h1, a, h2 = made
        ok = good.ravel()
        share, at = (ok / max(1, ok.sum())).astype(np.float32), np.arange(len(ok))
        cls, leaf, order, bounds, own, z, leaves = self.outputs(h2, slot.ravel())
        loss = 0.0
        for y, right, use in ((z, cls, share), (leaves, leaf, share[order])):
            if max(y.max(), -y.min()) > 60:
                y -= y.max(axis=1, keepdims=True)
            np.exp(y, out=y)
            total = y @ np.ones(y.shape[1], np.float32)
            right = at * y.shape[1] + right
            loss -= float(np.log(y.ravel().take(right) / total + 1e-20) @ use)
            y *= (use / total)[:, None]
            y.ravel()[right] -= use
        outer, inner = h2.T @ z, np.zeros((CLASSES, d + 1, LEAVES), np.float32)
        back, place = np.empty((len(own), d), np.float32), np.empty_like(order)
        for k in range(CLASSES):
            low, high = bounds[k], bounds[k + 1]
            if low < high:
                np.matmul(own[low:high].T, leaves[low:high], out=inner[k])
                np.matmul(leaves[low:high], p["W2"][k].T, out=back[low:high])
        place[order] = at
        g = {"W": outer[:d], "b": outer[d], "W2": inner[:, :d], "b2": inner[:, d]}
        dh2 = z @ p["W"].T
        dh2 += back.take(place, axis=0)
        g["B"] = a.T @ dh2
        da = dh2 @ p["B"].T
        da *= a > 0
        g["A"] = h1.T @ da
        dh1 = da @ p["A"].T
        dh1 += dh2
        into, added = self.folded()
        g_added = c.T @ dh1
        g["V"], g["O"] = g_added @ p["O"].T, p["V"].T @ g_added
        dc = dh1 @ added.T
        mean = (c * dc) @ np.ones(d, np.float32)  # of the weights' slopes, by the weights
        mean *= part
        dc *= part[:, None]
        dc = dc.reshape(n, STRIDE, d)
        ds = dc @ both.transpose(0, 2, 1)
        ds -= mean.reshape(n, STRIDE, 1)
        ds *= s
        g["D"] = np.bincount(np.clip(FAR, 0, 2 * STRIDE - 1).ravel(), np.ones(n, np.float32) @ ds.reshape(n, -1), 2 * STRIDE).astype(np.float32)
        met = ds.transpose(0, 2, 1) @ q  # by the row above and the own, as keys and as values
        met += s.transpose(0, 2, 1) @ dc
        dq = (ds @ both).reshape(-1, d)
        g_into = h.T @ dq / np.float32(math.sqrt(d))
        g["Q"], g["K"] = g_into @ p["K"], g_into.T @ p["Q"]
        dh = dq @ into.T
        dh += dh1
        rows = dh.reshape(n, STRIDE, d)
        rows += met[:, STRIDE:]
        rows[:-1] += met[1:, :STRIDE]  # zero where no row is before
        own = x.ravel().astype(np.uint16)
        order = np.argsort(own, kind="stable")
        own = own.take(order)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        g["E"] = np.zeros_like(p["E"])
        g["E"][own[first]] = np.add.reduceat(dh.take(order, axis=0), first)
        return loss, g

    def fit(self, x: np.ndarray, before: np.ndarray, slot: np.ndarray, good: np.ndarray, steps: int = 1500, rows: int = 256, rate: float = 0.02) -> Attention:
        """Adam over runs of rows, in an order that a seed fixes."""
        adam = Adam(self.p)
        rng = np.random.default_rng(2)
        for t in range(1, steps + 1):
            at = int(rng.integers(0, max(1, len(x) - rows + 1)))
            own = slice(at, at + rows)
            prev = np.where(before[own] >= at, before[own] - at, -1)
            _, g = self.gradient(x[own], prev, slot[own], good[own])
            adam.step(g, rate * (1 - t / (steps + 1)))
        return self


def laid_out(texts: list[np.ndarray], slots: Slots) -> tuple[np.ndarray, ...]:
    """Inputs, rows before, next ids (the last id number is the end), where a next id is, and texts of rows."""
    ids, before, text = blocked(texts)
    end = len(slots.slot) - 1
    flat = ids.ravel()
    follow = np.append(flat[1:], -1)
    here = flat != -1
    follow = np.where(here & (follow < 0), end, np.maximum(follow, 0))
    x = np.where(flat >= 0, slots.input[np.maximum(flat, 0)], 0)
    shape = ids.shape
    return x.reshape(shape), before, follow.reshape(shape), here.reshape(shape), text


def scores(texts: list[np.ndarray], slots: Slots, model: Attention) -> np.ndarray:
    """Log10 chance of each text, its end included."""
    out = np.zeros(len(texts))
    low = 0
    while low < len(texts):  # so many rows at a time stay in the cache
        high, n = low, 0
        while high < len(texts) and (high == low or n < ROWS):
            n += len(texts[high]) // STRIDE + 1
            high += 1
        part = texts[low:high]
        x, before, follow, here, text = laid_out(part, slots)
        each = np.zeros(len(x))
        for a in range(0, len(x), ROWS):  # a long text in pieces, with the row before the first
            b = min(len(x), a + ROWS)
            c = max(0, a - 1)
            prev = np.where(before[c:b] >= c, before[c:b] - c, -1)
            got = model.log10(x[c:b], prev, slots.slot[follow[c:b]]) + slots.share[follow[c:b]]
            each[a:b] = np.where(here[c:b], got, 0).sum(axis=1)[a - c :]
        out[low:high] = np.bincount(text, each, len(part))
        low = high
    return out


def learnt(groups: Iterator[list[np.ndarray]], slots: Slots, model: Attention, rate: float, repeats: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The model's parameters after Adam over all texts, times their weights, and these weights: an input's is how often it occurs, a class's how often it follows, others' the number of ids. None without texts.

    So a task that has not met an input or a class has no say in its average.
    """
    p = {k: v.copy() for k, v in model.p.items()}
    own = Attention.__new__(Attention)
    own.p, adam, rng = p, Adam(p), np.random.default_rng(2)
    inputs, classes = np.zeros(INPUTS), np.zeros(CLASSES)
    for texts in groups:
        x, before, follow, here, _ = laid_out(texts, slots)
        slot = slots.slot[follow]
        inputs += np.bincount(x[here], minlength=INPUTS)
        classes += np.bincount(slot[here] // LEAVES, minlength=CLASSES)
        for _ in range(repeats):
            for at in (rng.permutation(-(-len(x) // ROWS)) * ROWS).tolist():
                part = slice(at, at + ROWS)
                prev = np.where(before[part] >= at, before[part] - at, -1)
                adam.step(own.gradient(x[part], prev, slot[part], here[part])[1], rate)
    if not inputs.sum():
        return None
    weight = {k: np.full(v.shape, inputs.sum()) for k, v in p.items()}
    weight["E"][:] = inputs[:, None]
    weight["W2"][:] = classes[:, None, None]
    weight["b2"][:] = classes[:, None]
    w = np.concatenate([weight[k].ravel() for k in p])
    return w * np.concatenate([v.ravel() for v in p.values()]), w


def averaged(model: Attention, total: np.ndarray, weight: np.ndarray) -> Attention:
    """The model with parameters total / weight, its own where nothing was learnt."""
    at = 0
    for k, v in model.p.items():
        t, w = (x[at : at + v.size].reshape(v.shape) for x in (total, weight))
        model.p[k] = np.where(w > 0, t / np.maximum(w, 1), v).astype(np.float32)
        at += v.size
    return model


def trained(docs: DataFrame, slots: Slots, model: Attention, n_ids: int) -> Attention:
    """The model after ROUNDS of training over docs (uid, ids), every one of them: in a round, each task learns from its part of the round's documents, and the driver gets the sums.

    Documents are dealt to the rounds by hash; those of a corpus of under LEAST
    ids take part in all rounds. Sums are made in FAN groups first, so that what
    reaches the driver has one size whatever the corpus.
    """
    passes = -(-LEAST // max(1, n_ids))
    sent = docs.sparkSession.sparkContext.broadcast(slots)
    deal = F.pmod(F.xxhash64("uid"), F.lit(1 if passes > 1 else ROUNDS))
    repeats = -(-passes // ROUNDS)

    def one(r: int, start: dict[str, np.ndarray]):  # noqa: ANN202
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def groups() -> Iterator[list[np.ndarray]]:
                held, size = [], 0
                for batch in batches:
                    for ids in batch["ids"]:
                        held.append(unpacked(ids))
                        size += len(held[-1]) + STRIDE
                        if size >= GROUP:
                            yield held
                            held, size = [], 0
                if held:
                    yield held

            own = Attention.__new__(Attention)
            own.p = start
            got = learnt(groups(), sent.value, own, RATE * (1 - r / ROUNDS), repeats)
            if got:
                yield pd.DataFrame({"fan": [TaskContext.get().partitionId() % FAN], "total": [got[0].tobytes()], "weight": [got[1].tobytes()]})

        return each

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fan": part["fan"].iloc[:1], **{c: [sum(np.frombuffer(x) for x in part[c]).tobytes()] for c in ("total", "weight")}})

    for r in range(ROUNDS):
        own = docs if passes > 1 else docs.where(deal == r)
        got = own.select("ids").mapInPandas(one(r, model.p), SUMS).groupBy("fan").applyInPandas(summed, SUMS).orderBy("fan").collect()
        if got:
            model = averaged(model, *(sum(np.frombuffer(row[c]) for row in got) for c in ("total", "weight")))
    return model


def packed(ids: np.ndarray) -> bytes:
    """Ids as 16 bits each where they fit, else as 32; the last byte says which."""
    return ids.astype("<u2").tobytes() + b"\2" if ids.max(initial=0) < 1 << 16 else ids.astype("<u4").tobytes() + b"\4"


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[-1]}", (len(data) - 1) // data[-1])


PARTS = "uid long, block long, doc_id long, held_out boolean, ids binary, words binary, place int, word long, n long"


def parts(docs: DataFrame, text: str, tokenizer: str, ids: int) -> DataFrame:
    """A stored table of three kinds of rows, from which nothing is encoded again.

    Documents: subword ids, and words by their places in the block's list; each
    block's words: place, hash and count in its training documents (ends have
    place 0); and ids' counts there (block -1, the end last).
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 24
        uid = TaskContext.get().partitionId() << 33
        encode, counts = encoder(tokenizer), np.zeros(ids + 1, np.int64)
        place: dict[bytes, int] = {}
        coded = [b""]  # subword ids of the word of each place
        tally, ends, size = np.zeros(1 << 16, np.int64), 0, 0

        def new(word: bytes) -> int:
            at = place.setdefault(word, len(place) + 1)
            if at == len(coded):
                coded.append(encode.word(word))
            return at

        def numbers(words: list[bytes]) -> list[int]:
            found = list(map(place.get, words))
            if None in found:
                found = [new(w) if at is None else at for w, at in zip(words, found, strict=True)]
            return found

        def listed() -> pd.DataFrame:
            hashes = np.fromiter(map(hashed, place), np.int64, len(place))
            return pd.DataFrame({"block": block, "place": np.arange(len(place) + 1), "word": np.append(END, hashes), "n": np.append(ends, tally[1 : len(place) + 1])})

        for batch in batches:
            for low in range(0, len(batch), 256):
                rows = batch.iloc[low : low + 256]
                found = [numbers(b.lower().split()) for b in rows["bytes_"]]
                own = [np.array(f, np.uint32) for f in found]
                bodies = [np.frombuffer(b"".join(map(coded.__getitem__, f)), "<u4") for f in found]
                train = ~rows["held_out"].to_numpy(bool)
                while len(place) + 1 > len(tally):
                    tally = np.concatenate([tally, np.zeros_like(tally)])
                none = np.zeros(0, np.int64)
                tally += np.bincount(np.concatenate([none, *[w for w, t in zip(own, train, strict=True) if t]]).astype(np.int64), minlength=len(tally))
                counts += np.bincount(np.concatenate([none, *[b for b, t in zip(bodies, train, strict=True) if t]]).astype(np.int64), minlength=ids + 1)
                counts[-1] += train.sum()
                ends += int(train.sum())
                yield shaped(rows.assign(uid=np.arange(uid, uid + len(rows)), block=block, ids=[packed(x) for x in bodies], words=[w.tobytes() for w in own]))
                uid += len(rows)
                size += sum(map(len, rows["bytes_"]))
                if size >= BLOCK_BYTES:
                    yield shaped(listed())
                    place.clear()
                    del coded[1:]
                    tally, ends, size, block = np.zeros(1 << 16, np.int64), 0, 0, block + 1
        yield shaped(listed())
        known = np.flatnonzero(counts)
        yield shaped(pd.DataFrame({"block": -1, "word": known, "n": counts[known]}))

    got = docs.select(F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), utf8(text).alias("bytes_"))
    return written(got.mapInPandas(each, PARTS), "parts")


def shaped(df: pd.DataFrame) -> pd.DataFrame:
    out = df.reindex(columns=[c.split()[0] for c in PARTS.split(", ")])
    for c in ("uid", "doc_id", "word", "n"):
        out[c] = pd.array(out[c], dtype="Int64")
    out["place"] = pd.array(out["place"], dtype="Int32")
    out["held_out"] = out["held_out"].astype("boolean")
    for c in ("ids", "words"):
        out[c] = out[c].astype(object).where(out[c].notna(), None)
    return out


def hashed(word: bytes) -> int:
    """64 bits, signed; never END."""
    h = xxhash.xxh3_64_intdigest(word)
    return (h - (1 << 64) if h >> 63 else h) or 1


def word_scores(table: DataFrame, counts: DataFrame, total: int, kinds: int) -> DataFrame:
    """uid, n_tokens, n_known and base_score of each document: a block's documents meet the counts of the block's own words."""
    words = table.where("block >= 0 and word is not null").select(F.col("block").alias("by"), "place", "word")
    asked = words.join(counts, "word").select("by", "place", "c")

    def each(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        c = known.sort_values("place")["c"].to_numpy(np.int64)
        log = np.log10((c + 1) / (total + kinds + 1))
        out = []
        for uid, data in zip(rows["uid"], rows["words"], strict=True):
            at = np.append(np.frombuffer(data, "<u4"), 0)
            out.append((uid, len(at), int((c[at] > 0).sum()), float(log[at].sum())))
        return pd.DataFrame(out, columns=["uid", "n_tokens", "n_known", "base_score"])

    own = table.where("ids is not null").select("block", "uid", "words")
    return own.groupBy("block").cogroup(asked.groupBy("by")).applyInPandas(each, "uid long, n_tokens long, n_known long, base_score double")


def scored(docs: DataFrame, *, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out of all counts
    and training. A null text is empty, and has its end alone; texts may have any
    length; rows may repeat, with equal or null ids; an empty table gives none;
    without training documents the model keeps its first weights, else it is
    trained on all of them. Other columns of docs, whatever their names, are not
    read. Words' counts travel by block of documents: a block asks for its own
    distinct words only. The model scores documents where they are stored, each
    task its share of their bytes.
    """
    from tokenizers import Tokenizer

    path = tokenizer or default_tokenizer()
    ids = Tokenizer.from_file(path).get_vocab_size()
    spark = docs.sparkSession
    table = parts(docs, text, path, ids)
    words = table.where("block >= 0 and word is not null")
    counts = written(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()

    seen = np.zeros(ids + 1, np.int64)
    for k, c in table.where("block = -1").groupBy("word").agg(F.sum("n")).collect():  # a row per id of the vocabulary at most
        seen[k] = c
    slots = Slots(seen)
    model = Attention(slots.weight)
    own = table.where("ids is not null and not held_out")
    chosen = [r[0] for r in own.select("uid", F.xxhash64("doc_id").alias("h")).orderBy("h", "uid").limit(START).select("uid").collect()]
    sample = [unpacked(r[0]) for r in own.where(F.col("uid").isin(chosen)).orderBy("uid").select("ids").collect()]  # START texts
    if sample:
        x, before, follow, here, _ = laid_out(sample, slots)
        model = trained(own, slots, model.fit(x, before, slots.slot[follow], here, steps=400), int(seen.sum()))
    sent = spark.sparkContext.broadcast((slots, model))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, model = sent.value
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.iloc[low : low + 256]
                yield pd.DataFrame(
                    {
                        "uid": part["uid"],
                        "doc_id": pd.array(part["doc_id"], dtype="Int64"),
                        "held_out": part["held_out"].to_numpy(bool),
                        "train_tokens": total,
                        "score": scores([unpacked(x) for x in part["ids"]], slots, model),
                    }
                )

    by_model = table.where("ids is not null").select("uid", "doc_id", "held_out", "ids").mapInPandas(each, "uid long, doc_id long, held_out boolean, train_tokens long, score double")
    out = by_model.join(word_scores(table, counts, total, kinds), "uid")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
