"""SentencePiece encoding and decoding with seeded merge-dropout: merges leave the agenda unused where a keyed hash says so."""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import spare, utf8

SPACE = "▁"
#: Parts that a worker keeps, and bytes of text that are encoded at a time.
KEPT, GROUP = 400_000, 1 << 20
#: Parts of over so many characters take an agenda of their own, a heap, and are not kept. Others go by lengths up to these.
LONG, LENGTHS, COLUMNS = 48, (8, 16, 32, 48), 8192
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xC2B2AE3D27D4EB4F)
#: No symbol, a character without a piece, no place in the agenda, and no pair.
NONE, ODD, NEVER, FREE = 0xFFFF, 0xFFFE, np.int32(2**31 - 1), np.uint32(2**32 - 1)
#: A run of spaces and what follows up to the next: no piece of the vocabulary reaches over such a border.
PART = re.compile(f"{SPACE}*[^{SPACE}]*")
#: What stands for a SPACE sign of the text itself, among its parts.
SIGN = None


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each row, size of them, one row after the other."""
    return np.repeat(start - (size.cumsum() - size), size) + np.arange(size.sum())


class Flat:
    """Arrays of different sizes, one after the other in one that grows."""

    def __init__(self, kind: str) -> None:
        self.data, self.used = np.zeros(1024, kind), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, data: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(data)] = data
        self.start = np.concatenate([self.start, self.used + size.cumsum() - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(data)

    def of(self, rows: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.start[rows], self.size[rows])]


class Pairs:
    """The piece that two symbols merge to, by a hash table of pairs with linear probing."""

    def __init__(self, pairs: np.ndarray, pieces: np.ndarray) -> None:
        bits = max(10, int(4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint32(32 - bits), (1 << bits) - 1
        self.key, self.piece = np.full(1 << bits, FREE), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(pairs)), self.place(pairs)
        while len(left):
            _, first = np.unique(at, return_index=True)
            first = first[self.key[at[first]] == FREE]
            self.key[at[first]], self.piece[at[first]] = pairs[left[first]], pieces[left[first]]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, at = left[stay], at[stay] + 1 & self.last

    def place(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * np.uint32(0x9E3779B1) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1: they don't merge."""
        pairs = (a.astype(np.uint32) << np.uint32(16) | b).ravel()
        at = self.place(pairs)
        found = self.key[at]
        out = np.where(found == pairs, self.piece[at], np.int32(-1))
        left = np.flatnonzero((found != pairs) & (found != FREE))
        at = at[left]
        while len(left):
            at = at + 1 & self.last
            found, own = self.key[at], pairs[left]
            out[left] = np.where(found == own, self.piece[at], np.int32(-1))
            more = (found != own) & (found != FREE)
            left, at = left[more], at[more]
        return out.reshape(a.shape)


class Codec:
    """Merge-type pieces of a model file, whose spaces stand at the front of pieces.

    Spaces become SPACE, and one is put before the text, as the model does; a
    SPACE sign of the text itself and characters without a piece become byte
    pieces, so that decoding gives back the text. rate: the share of merges that
    are skipped.

    Parts of texts (a run of spaces, and what follows) are merged many at a time:
    each turn takes the best merge of every part's agenda. What a worker keeps of
    a part is its plain way: the merges that it meets where none is skipped. Where
    none of them is skipped under an occurrence's key, its ids are the plain ones;
    else the occurrence's own agenda is gone through.
    """

    def __init__(self, path: str, rate: float, seed: int) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [p.id_to_piece(k) for k in range(p.get_piece_size())]
        n = len(self.pieces)
        special = [p.is_control(k) or p.is_unknown(k) or p.is_byte(k) for k in range(n)]
        self.number = {x: k for k, x in enumerate(self.pieces) if not special[k]}
        self.score = {x: -p.get_score(k) for x, k in self.number.items()}
        self.byte = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [x.replace(SPACE, " ").encode() for x in self.pieces]
        for b, k in enumerate(self.byte):
            self.text[k] = bytes([b])
        if any(SPACE in x.lstrip(SPACE) for x in self.number):
            raise ValueError("a piece has a space inside")
        # characters' symbols: their pieces, and numbers above for those that only larger pieces have
        symbol = {x: k for x, k in self.number.items() if len(x) == 1}
        for x in self.number:
            for c in x:
                symbol.setdefault(c, n + len(symbol))
        known = self.number | symbol
        if max(known.values()) >= ODD:
            raise ValueError("too many pieces")
        self.symbol = np.full(0x110000, ODD, np.uint16)
        for c, k in symbol.items():
            self.symbol[ord(c)] = k
        both = [(known[x[:k]] << 16 | known[x[k:]], self.number[x]) for x in self.number for k in range(1, len(x)) if x[:k] in known and x[k:] in known]
        pairs = np.array(both, np.int64).reshape(-1, 2)
        self.pairs = Pairs(pairs[:, 0].astype(np.uint32), pairs[:, 1].astype(np.int32))
        ranks = {v: k for k, v in enumerate(sorted(set(self.score.values())))}
        self.rank = np.full(n + 1, NEVER)  # of a piece in agendas, with room for its place; the last is that of no piece
        for x, k in self.number.items():
            self.rank[k] = ranks[self.score[x]] << 6
        self.limit, self.seed = np.uint64(int(rate * 2**32)), seed
        self.forget()

    def forget(self) -> None:
        """Without any part. The first number is the sign's."""
        self.known: dict[str | tuple | None, int] = {SIGN: 0}
        self.chars, self.codes, self.ids = Flat("<u4"), Flat("<u8"), Flat("<u4")
        none, sign = np.zeros(0, np.int64), np.array([self.byte[b] for b in SPACE.encode()])
        self.chars.add(none, np.zeros(1, np.int64))
        self.codes.add(none, np.zeros(1, np.int64))
        self.ids.add(sign, np.array([len(sign)]))

    def skipped(self, keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether occurrences with these keys leave out these merges; a code has a merge's place in the part and its piece."""
        x = (keys ^ codes) * M1
        x = (x ^ x >> np.uint64(29)) * M2
        return (x ^ x >> np.uint64(32)) * M3 >> np.uint64(32) < self.limit

    def merged(self, chars: np.ndarray, size: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Ids and their counts of parts of up to LONG characters; without keys also the merges that they met, and their counts. So many parts at a time stay in the cache."""
        end = np.append(0, size.cumsum())
        cuts = range(0, max(len(size), 1), COLUMNS)
        got = [self.turns(chars[end[a] : end[min(a + COLUMNS, len(size))]], size[a : a + COLUMNS], keys if keys is None else keys[a : a + COLUMNS]) for a in cuts]
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def turns(self, chars: np.ndarray, size: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """The same for parts that are few enough.

        A turn takes the best merge of each part, leftmost among equals, and skips
        it if its key says so. Symbols are linked lists in columns, from row 1 on.
        """
        n, high = len(size), int(size.max(initial=1))
        s = np.full((high + 2, n), NONE, np.uint16)
        col = np.repeat(np.arange(n), size)
        row = ranges(np.ones(n, np.int64), size)
        s[row, col] = self.symbol[chars]
        place = np.arange(high + 2, dtype=np.int32)[:, None]
        piece = np.full((high + 2, n), -1, np.int32)
        piece[1:-1] = self.pairs(s[1:-1], s[2:])
        agenda = np.where(piece >= 0, self.rank[piece] + place, NEVER)
        after, before = np.repeat(place.astype(np.int8) + np.int8(1), n, axis=1), np.repeat(place.astype(np.int8) - np.int8(1), n, axis=1)
        done = np.full((high, n), NONE, np.uint16)
        own, met_by, met = np.arange(n), [], []
        while n:
            best = agenda.min(axis=0)
            c = np.flatnonzero(best < NEVER)
            if len(c) < 0.7 * n:  # those that are at their ends go
                ends = np.flatnonzero(best == NEVER)
                done[:, own[ends]] = s[1:-1, ends]
                own, n, best = own[c], len(c), best[c]
                s, piece, agenda, after, before = (x.take(c, axis=1) for x in (s, piece, agenda, after, before))
                keys = keys if keys is None else keys[c]
                c = np.arange(n)
            k = best[c] & 63
            at = k * n + c
            new = piece.ravel()[at]
            code = (k.astype(np.uint64) - np.uint64(1)) << np.uint64(20) | new.astype(np.uint64)
            if keys is None:
                met_by.append(own[c])
                met.append(code)
            else:
                skip = self.skipped(keys[c], code)
                agenda.ravel()[at[skip]] = NEVER
                stay = ~skip
                c, k, at, new = c[stay], k[stay], at[stay], new[stay]
            flat, nexts, lasts = s.ravel(), after.ravel(), before.ravel()
            right = nexts[at] * np.int64(n) + c
            over = nexts[right]
            far = over * np.int64(n) + c
            flat[at], flat[right], agenda.ravel()[right] = new, NONE, NEVER
            nexts[at], lasts[far] = over, k
            near = lasts[at] * np.int64(n) + c
            p = np.concatenate([at, near])
            found = self.pairs(flat[p], flat[np.concatenate([far, at])])
            piece.ravel()[p] = found
            agenda.ravel()[p] = np.where(found >= 0, self.rank[found] + (p // max(n, 1)).astype(np.int32), NEVER)
        ids, sizes = self.spelled(done, chars, size)
        if keys is not None or not met:
            return ids, sizes, np.zeros(0, np.uint64), np.zeros(len(size), np.int64)
        by = np.concatenate(met_by)
        order = np.argsort(by, kind="stable")
        return ids, sizes, np.concatenate(met)[order], np.bincount(by, minlength=len(size))

    def spelled(self, symbols: np.ndarray, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts, of symbols in columns; a character without a piece gives its bytes."""
        by_part = symbols.T
        col, row = np.nonzero(by_part != NONE)
        ids, owner = by_part[col, row].astype(np.int64), col
        odd = np.flatnonzero(ids >= len(self.pieces))
        if len(odd):
            cps = chars[(size.cumsum() - size)[col[odd]] + row[odd]]
            kinds, of = np.unique(cps, return_inverse=True)
            spelt = [chr(c).encode("utf-8", "replace") for c in kinds.tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = np.array([len(x) for x in spelt])[of]
            start = times.cumsum() - times
            ids, owner = np.repeat(ids, times), np.repeat(col, times)
            ids[ranges(start[odd], times[odd])] = [self.byte[b] for k in of.tolist() for b in spelt[k]]
        return ids, np.bincount(owner, minlength=len(size))

    def heaped(self, part: str, key: int | None) -> list[int]:
        """Ids of a part of any length, in time n log n."""
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        symbol: list[str | None] = list(part)
        n, agenda = len(part), []
        keys = None if key is None else np.array([key], np.uint64)

        def offer(i: int) -> None:
            j = right[i]
            if j < n and symbol[i] is not None and symbol[j] is not None:
                both = symbol[i] + symbol[j]
                if both in self.score:
                    heapq.heappush(agenda, (self.score[both], i, both))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = right[i] if symbol[i] is not None else n
            if j >= n or symbol[j] is None or symbol[i] + symbol[j] != both:
                continue
            if keys is not None and self.skipped(keys, np.uint64(i << 20 | self.number[both]))[0]:
                continue
            symbol[i], symbol[j] = both, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        ids: list[int] = []
        for x in filter(None, symbol):
            k = self.number.get(x)
            ids += [self.byte[b] for b in x.encode("utf-8", "replace")] if k is None else [k]
        return ids

    def parts(self, text: str) -> list[str | tuple | None]:
        """A text's parts: the first space of each is left out, and one without is a tuple; SIGN stands for a SPACE sign of the text itself."""
        if not text:
            return []
        if SPACE not in text:
            out = text.split(" ")
            if "" not in out:
                return out
        out = []
        for k, own in enumerate((" " + text).split(SPACE)):
            out += [SIGN] * (k > 0)
            out += [x[1:] if x[0] == SPACE else (x,) for x in PART.findall(own.replace(" ", SPACE))[:-1]]
        return out

    @staticmethod
    def whole(part: str | tuple) -> str:
        return part[0] if isinstance(part, tuple) else SPACE + part

    def learn(self, new: list[str | tuple]) -> None:
        """Keep the plain ways of parts."""
        texts = [self.whole(x) for x in new]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(size, kind="stable")
        texts, size = [texts[k] for k in order.tolist()], size[order]
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        begin = size.cumsum() - size
        for low, high in zip((0, *LENGTHS), LENGTHS):  # noqa: B905
            a, b = np.searchsorted(size, (low, high), "right")
            if a < b:
                mine = chars[begin[a] : begin[b - 1] + size[b - 1]]
                ids, n_ids, codes, n_codes = self.merged(mine, size[a:b], None)
                self.chars.add(mine, size[a:b])
                self.ids.add(ids, n_ids)
                self.codes.add(codes, n_codes)
        count = len(self.known)
        self.known.update(zip([new[k] for k in order.tolist()], range(count, count + len(new)), strict=True))

    def encoded(self, texts: list[str], keys: list[int] | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of texts with no merge skipped; and with each merge of each part skipped by the text's key, the part's place and the merge (the same, without keys)."""
        parted = [self.parts(t) for t in texts]
        parts = [p for own in parted for p in own]
        number = np.fromiter(map(self.known.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        if number.min(initial=0) < 0:
            at = np.flatnonzero(number < 0).tolist()
            new = [p for p in dict.fromkeys([parts[k] for k in at]) if len(self.whole(p)) <= LONG]
            if len(self.known) + len(new) > KEPT:
                self.forget()
                at = range(len(parts))
                new = [p for p in dict.fromkeys(parts) if p is not SIGN and len(self.whole(p)) <= LONG]
            self.learn(new)
            number[at] = [self.known.get(parts[k], -1) for k in at]
        count = np.fromiter(map(len, parted), np.int64, len(parted))
        kept, long = np.flatnonzero(number >= 0), np.flatnonzero(number < 0).tolist()
        cut = count.cumsum()[:-1]

        def laid_out(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
            """Ids of texts from some parts' places, counts and ids."""
            size = np.zeros(len(parts), np.int64)
            for at, n, _ in found:
                size[at] = n
            end = size.cumsum()
            out = np.zeros(size.sum(), "<u4")
            for at, n, ids in found:
                out[ranges((end - size)[at], n)] = ids
            return np.split(out, np.append(0, end)[cut]) if len(texts) else []

        def heaped(own: np.ndarray | None) -> list[tuple]:
            got = [self.heaped(self.whole(parts[k]), None if own is None else int(own[k])) for k in long]
            return [(np.array(long), np.array([len(x) for x in got]), np.concatenate([np.array(x) for x in got]))] if got else []

        plain = laid_out([(kept, self.ids.size[number[kept]], self.ids.of(number[kept])), *heaped(None)])
        if keys is None:
            return plain, plain
        own = ranges(np.zeros(len(count), np.int64), count).astype(np.uint64) * M1 + np.repeat(np.array(keys, np.uint64), count)
        own = (own ^ own >> np.uint64(31)) * M3
        own ^= own >> np.uint64(33)
        by = np.repeat(kept, self.codes.size[number[kept]])
        changed = np.zeros(len(parts), bool)
        changed[by[self.skipped(own[by], self.codes.of(number[kept]))]] = True
        same, other = kept[~changed[kept]], np.flatnonzero(changed)
        found = [(same, self.ids.size[number[same]], self.ids.of(number[same])), *heaped(own)]
        size = self.chars.size[number[other]]
        for low, high in zip((0, *LENGTHS), LENGTHS):  # noqa: B905
            at = other[(size > low) & (size <= high)]
            if len(at):
                ids, n, _, _ = self.merged(self.chars.of(number[at]), self.chars.size[number[at]], own[at])
                found.append((at, n, ids))
        return plain, laid_out(found)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


DIGEST = "n_ids long, ids_crc32 long, n_plain long, plain_crc32 long, lossless boolean"


def coded(docs: DataFrame, *, rate: float = 0.1, seed: int = 7, model: str | None = None, text: str = "text", ids: str = "ids", digest: bool = False) -> DataFrame:
    """docs with ids (array of int), or with digest columns of the ids with dropout and without.

    A text's segmentation depends on its content, seed and rate alone, so equal
    rows get equal ids. A null text is empty and has no ids; texts may have any
    length, and are encoded whole; ids may be null or tied; an empty table gives
    none. A column of docs that is named like one of these is replaced where ids
    are asked for, and stays beside the digest columns.
    """
    path = model or default_model()

    def rows(batches: Iterator[pd.Series]) -> Iterator[tuple[Codec, list[str], list[np.ndarray], list[np.ndarray]]]:
        codec = Codec(path, rate, seed)
        for batch in batches:
            texts, plain, got, low, size = [], [], [], 0, 0
            for k, b in enumerate(batch):
                texts.append(b.decode("utf-8", "replace"))
                size += len(b)
                if size >= GROUP or k + 1 == len(batch):
                    a, b = codec.encoded(texts[low:], [xxhash.xxh3_64_intdigest(x, seed) for x in batch.iloc[low : k + 1]])
                    plain += a
                    got += b
                    low, size = k + 1, 0
            yield codec, texts, plain, got

    @F.pandas_udf("array<int>")
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for _, _, _, got in rows(batches):
            yield pd.Series([x.view("<i4") for x in got], dtype=object)

    @F.pandas_udf(DIGEST)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for codec, texts, plain, got in rows(batches):
            yield pd.DataFrame(
                {
                    "n_ids": [len(x) for x in got],
                    "ids_crc32": [zlib.crc32(x) for x in got],
                    "n_plain": [len(x) for x in plain],
                    "plain_crc32": [zlib.crc32(x) for x in plain],
                    "lossless": [codec.decode(x) == t for x, t in zip(got, texts, strict=True)],
                }
            )

    code = digests if digest else numbers
    if digest:
        (ids,) = spare(docs, ids)
    out = docs.withColumn(ids, code(utf8(text)))
    return out.select(*docs.columns, f"{ids}.*") if digest else out


def decoded(df: DataFrame, *, model: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the texts of ids; null ids are an empty text."""
    path = model or default_model()

    @F.pandas_udf("string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(path, 0, 0)
        for batch in batches:
            yield pd.Series([codec.decode(np.asarray(x if x is not None else [], "<u4")) for x in batch])

    return df.withColumn(text, code(F.col(ids)))
