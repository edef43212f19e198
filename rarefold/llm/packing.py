"""Packing: documents as token ids, cut and packed into sequences of one length.

First-fit decreasing within randomised groups of pieces; a tournament tree over
the bins' free room finds the first bin that fits in logarithmic time.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import utf8, written

#: Words whose ids a worker keeps at least.
KEPT_WORDS = 250_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent:
    """A memory of values by key: what was asked for last, size of them at least and twice as many at most."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):  # noqa: ANN001, ANN201
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:  # noqa: ANN001
        self.young[key] = value
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}


# How the known tokenizer's file parts a text, and the same for words of printable ASCII and Latin letters in lower case.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LETTERS = "a-z\xdf-\xf6\xf8-\xff"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
PLAIN = re.compile("[!-~\xc0-\xff]+")


class WordIds:
    """Ids of texts by a tokenizer whose pre-tokenizer parts words at blanks, so that a word's ids don't depend on its neighbours.

    Ids are little-endian unsigned 32-bit. Words met lately are kept. Others are
    encoded by the library: as a whole, or, where the file parts texts in the known
    way and the word is plain, its parts by the library's model, of which the
    latest are kept too.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        own = json.loads(self.library.to_str())
        self.parted = own["normalizer"] == NORMALIZER and own["pre_tokenizer"] == PRE_TOKENIZER
        self.tokenize = self.library.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letter = {k: level.pre_tokenize_str(chr(k))[0][0] for k in [*range(33, 127), *range(0xC0, 0x100)]}
        self.words, self.parts = Recent(kept), Recent(kept // 2)

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = array("I", [t.id for t in self.tokenize(part.translate(self.letter))]).tobytes()
            self.parts.put(part, ids)
        return ids

    def word(self, word: bytes) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if self.parted and PLAIN.fullmatch(text) and "<|" not in text:
                ids = b"".join(map(self.part, PARTS.findall(text.lower())))
            else:
                ids = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
            self.words.put(word, ids)
        return ids

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        for text in texts:
            words = text.split()
            found = list(map(self.words.young.get, words))
            if None in found:
                found = [self.word(w) if x is None else x for w, x in zip(words, found)]  # noqa: B905
            yield b"".join(found)


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    return _encoders.setdefault(path, _encoders.get(path) or WordIds(path))


def pieces(docs: DataFrame, *, length: int, end_id: int, tokenizer: str, text: str = "text") -> DataFrame:
    """A row per piece of at most length ids; a document's ids end with end_id. salt, one number a row of docs, deals documents out evenly even if ids repeat."""
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, row = encoder(tokenizer), 0
        for batch in batches:
            for low in range(0, len(batch), 64):
                part, out = batch.iloc[low : low + 64], []
                for doc, ids in zip(part["doc_id"], encode(list(part["bytes_"])), strict=True):
                    whole = memoryview(ids + tail)
                    n = len(whole) // 4
                    for start in range(0, n, length):
                        one = whole[4 * start : 4 * (start + length)]
                        out.append((doc, start, len(one) // 4, zlib.crc32(one), n, row))
                    row += 1
                frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
                yield frame.assign(doc_id=pd.array(frame["doc_id"].where(frame["doc_id"].notna(), None), dtype="Int64"))

    return docs.select(F.col("doc_id").cast("long"), utf8(text).alias("bytes_")).mapInPandas(cut, PIECE)


def first_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, which come in decreasing order, each to the first bin where it fits."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    most = [room] * (2 * leaves)  # most[k]: the most free room of a bin under node k
    used = [0] * n
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, size in enumerate(lengths.tolist()):
        k = 1
        while k < leaves:
            k *= 2
            k += most[k] < size
        b = k - leaves
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        most[k] -= size
        while k > 1:
            k //= 2
            left, right = most[2 * k], most[2 * k + 1]
            best = left if left > right else right
            if most[k] == best:
                break
            most[k] = best
    return bins, offsets


def packed(docs: DataFrame, *, length: int = 2048, end_id: int = 1, tokenizer: str | None = None, group: int = 8192, text: str = "text") -> DataFrame:
    """Every id of every document in exactly one piece of one sequence of at most length ids.

    Documents are dealt at random into groups of about group pieces, whatever the
    input's size, and each group is packed alone; sequence_id is the group's
    number times 2**32 plus the bin's. A null text is empty and has the end id
    alone; rows may repeat, with equal or null ids; an empty table gives none.
    Documents longer than a sequence are cut at its multiples, and equal lengths
    go by id, then start. Other columns of docs, whatever their names, are not read.
    """
    cut = written(pieces(docs, length=length, end_id=end_id, tokenizer=tokenizer or default_tokenizer(), text=text), "pieces")
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("group_", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(groups)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "salt", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit(part["length"].to_numpy(), length)
        return part.assign(sequence_id=bins + (part["group_"].to_numpy() << 32), offset=offsets, doc_id=pd.array(part["doc_id"], dtype="Int64"))[[c.split()[0] for c in PACKED.split(", ")]]

    return dealt.groupBy("group_").applyInPandas(pack, PACKED)
