"""Media columns: types told by signatures, checked by structure, and media carved out of other bytes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import utf8, written

# Signatures, where they stand in a file, and the types they begin.
MAGIC = {
    b"RIFF": (0, "audio/wav"),
    b"\x89PNG\r\n\x1a\n": (0, "image/png"),
    b"GIF87a": (0, "image/gif"),
    b"GIF89a": (0, "image/gif"),
    b"\xff\xd8\xff": (0, "image/jpeg"),
    b"BM": (0, "image/bmp"),
    b"\x1f\x8b\x08": (0, "application/gzip"),
    b"fLaC": (0, "audio/flac"),
}
RATE = 8000
FOUND = "array<struct<type:string,start:long,length:long>>"


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono samples as a WAV file; an odd count is padded, as chunks are."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(samples) + len(pad), b"WAVE") + head + samples + pad


def wav_samples(data: bytes | memoryview) -> bytes:
    """The samples of a WAV file that wav_length has checked."""
    at = 12
    while bytes(data[at : at + 4]) != b"data":
        at += 8 + (n := struct.unpack_from("<I", data, at + 4)[0]) + n % 2
    return bytes(data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]])


def wav_length(b: memoryview) -> int:
    if len(b) < 44 or b[8:12] != b"WAVE":
        return 0
    size = 8 + struct.unpack_from("<I", b, 4)[0]
    at, seen = 12, set()
    while at + 8 <= min(size, len(b)):
        name, n = struct.unpack_from("<4sI", b, at)
        at += 8 + n + n % 2
        seen.add(name)
    return size if at == size <= len(b) and {b"fmt ", b"data"} <= seen else 0


def png_length(b: memoryview) -> int:
    at, first = 8, True
    while at + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, at)
        if at + 12 + n > len(b) or first and (name, n) != (b"IHDR", 13) or zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return 0
        at, first = at + 12 + n, False
        if name == b"IEND":
            return at
    return 0


def gif_length(b: memoryview) -> int:
    if len(b) < 14:
        return 0
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 128 else 0)
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and at + 10 < len(b):
            at += 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0)
        else:
            return 0
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return 0


def jpeg_length(b: memoryview) -> int:
    at = 2
    while at + 4 <= len(b) and b[at] == 255:
        kind = b[at + 1]
        if kind == 0xD9:
            return at + 2
        at += 2 + struct.unpack_from(">H", b, at + 2)[0]
        if kind == 0xDA:  # coded data lasts to a marker that is no restart
            raw = bytes(b[at:])
            k = raw.find(b"\xff")
            while 0 <= k < len(raw) - 1 and (raw[k + 1] == 0 or 0xD0 <= raw[k + 1] <= 0xD7):
                k = raw.find(b"\xff", k + 2)
            if k < 0:
                return 0
            at += k
    return at + 2 if at + 2 <= len(b) and b[at : at + 2] == b"\xff\xd9" else 0


def bmp_length(b: memoryview) -> int:
    if len(b) < 54:
        return 0
    size, zero, begin, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, 2)
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return size if zero == 0 and planes == 1 and head >= 40 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and 54 <= begin and begin + rows <= size <= len(b) and struct.unpack_from("<I", b, 30)[0] == 0 else 0


def gzip_length(b: memoryview) -> int:
    z = zlib.decompressobj(31)
    try:
        at = 0
        while at < len(b) and not z.eof:
            z.decompress(b[at : at + 65536])
            at += 65536
    except zlib.error:
        return 0
    return min(at, len(b)) - len(z.unused_data) if z.eof else 0


def flac_length(b: memoryview) -> int:
    """Frames have no lengths: a stream with good metadata lasts to the end, or to the next medium, as Sniffer sees to."""
    at, first = 4, True
    while at + 4 <= len(b):
        kind, n = b[at], int.from_bytes(b[at + 1 : at + 4], "big")
        if first and (kind & 127, n) != (0, 34):
            return 0
        at, first = at + 4 + n, False
        if kind & 128:
            return len(b) if at + 2 <= len(b) and b[at] == 255 and b[at + 1] >> 2 == 62 else 0
    return 0


VALID: dict[str, Callable[[memoryview], int]] = {"audio/wav": wav_length, "image/png": png_length, "image/gif": gif_length, "image/jpeg": jpeg_length, "image/bmp": bmp_length, "application/gzip": gzip_length, "audio/flac": flac_length}


#: The type whose end isn't told by its structure.
OPEN_ENDED = "audio/flac"


class Sniffer:
    def __init__(self) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for magic, (_, kind) in MAGIC.items():
            self.machine.add_word(magic.decode("latin-1"), (len(magic), kind))
        self.machine.make_automaton()

    def __call__(self, data: bytes) -> list[tuple[str, int, int]]:
        """Type, start and length of each medium whose structure holds, outermost and leftmost first; none overlaps another."""
        out, free, view = [], 0, memoryview(data)
        hits = sorted((end + 1 - n, kind) for end, (n, kind) in self.machine.iter(data.decode("latin-1")))
        for k, (start, kind) in enumerate(hits):
            if start >= free and (length := VALID[kind](view[start:])):
                if kind == OPEN_ENDED:
                    length = next((s for s, other in hits[k + 1 :] if VALID[other](view[s:])), len(data)) - start
                out.append((kind, start, length))
                free = start + length
        return out


def sniffed(df: DataFrame, column: str, declared: str, found: str = "found", corrected: str = "corrected") -> DataFrame:
    """df with found (type, start and length of each valid medium in the bytes) and corrected.

    corrected is the type of the medium that fills the bytes, else the declared
    type where no checked format contradicts it, else application/octet-stream.
    Null bytes hold nothing, and their declared type stays.
    """

    @F.pandas_udf(FOUND)
    def sniff(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Sniffer()
        for batch in batches:
            yield pd.Series([[{"type": k, "start": s, "length": n} for k, s, n in of(b)] if b is not None else [] for b in batch])

    whole = F.get(F.filter(F.col(found), lambda x: (x["start"] == 0) & (x["length"] == F.octet_length(F.col(column)))), F.lit(0))["type"]
    known = F.col(declared).isin(*VALID)
    return df.withColumn(found, sniff(F.col(column))).withColumn(corrected, F.when(F.col(column).isNull(), F.col(declared)).otherwise(F.coalesce(whole, F.when(known, F.lit("application/octet-stream")).otherwise(F.col(declared)))))


def carved(df: DataFrame, column: str, found: str = "found") -> DataFrame:
    """A row per medium of found: df's other columns, media_type and media."""
    one = df.withColumn("medium_", F.explode(found))
    cut = F.substring(F.col(column), (F.col("medium_.start") + 1).cast("int"), F.col("medium_.length").cast("int"))
    return one.withColumns({"media_type": F.col("medium_.type"), "media": cut}).drop("medium_", column, found)


def stored_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, and media: the text's bytes, padded with 0 to a positive multiple of 64, as the samples of a WAV file; declared is a type that needn't be right.

    A null text is empty. Equal texts get equal media and declared types.
    """

    @F.pandas_udf("binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([wav(b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")) for b in batch])

    n = F.octet_length("bytes_")
    kinds = F.array(*map(F.lit, ["audio/wav", "image/png", "application/octet-stream"]))
    return docs.select("doc_id", utf8(text).alias("bytes_")).select("doc_id", n.cast("long").alias("n_bytes"), coded("bytes_").alias("media"), F.get(kinds, (n % 3)).alias("declared"))


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digested(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts through media and back: stored in the shared folder, read, sniffed, decoded and described; a row per row of docs.

    A null text is empty. Texts may have any length that the format's 32-bit sizes
    hold; equal texts get equal values; ids may be null or tied; an empty table
    gives none. Other columns of docs, whatever their names, are not read.
    """
    got = sniffed(written(stored_texts(docs, text), "media"), "media", "declared")

    @F.pandas_udf(DIGEST)
    def described(media: pd.Series, kind: pd.Series) -> pd.DataFrame:
        rows = []
        for data, k in zip(media, kind, strict=True):
            payload = wav_samples(data) if k == "audio/wav" else b""
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{k};{feature(payload)}"))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])

    return got.withColumn("d_", described("media", "corrected")).select("doc_id", "n_bytes", "d_.*", "corrected", F.size("found").alias("n_media"))


def feature(samples: bytes) -> str:
    """Mean, deviation, zero crossings and distinct values of 8-bit samples, in whole numbers of fixed places."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "empty"
    n, s, q = len(x), int(x.sum()), int((x * x).sum())
    return f"rate={RATE};n={n};mean={1000 * s // n};power={1000 * q // n};cross={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};values={len(np.unique(x))}"
