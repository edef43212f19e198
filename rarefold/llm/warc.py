"""WARC archives as a Python data source, to write and to read.

Each record is a gzip member of its own whose extra field "sl" holds the
member's length, and whose compressed stream is flushed after the record's
header: a reader parses headers first, and jumps over what the filters leave
out without decompressing it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from rarefold.llm.common import new_path, utf8
from rarefold.llm.files import listed, store

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
# The format's header names, of the columns that filters reach.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08\x04"
HEAD = struct.Struct("<4sIBBH2sHII")
EPOCH = "1970-01-01T00:00:00Z"


def member(head: bytes, block: bytes, level: int = 6) -> bytes:
    """A gzip member that can be skipped, and whose head can be read alone."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(head) + z.flush(zlib.Z_FULL_FLUSH) + z.compress(block) + z.flush()
    size = len(head) + len(block)
    return HEAD.pack(MAGIC, 0, 0, 255, 12, b"sl", 8, HEAD.size + len(body) + 8, size & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(block, zlib.crc32(head)), size & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """The member of a row of SCHEMA. A revisit keeps the payload's digest and length, but no payload."""
    payload, kind = row["payload"] or b"", row["record_type"] or "response"
    digest = row.get("payload_digest") or hashlib.sha1(payload).hexdigest()
    length = row.get("payload_length")
    safe = lambda s: quote(s, safe="".join(map(chr, range(33, 127))))
    lines = ["WARC/1.1", f"WARC-Type: {safe(kind)}", f"WARC-Record-ID: <{safe(row['record_id'] or '')}>", f"WARC-Date: {safe(row.get('date') or EPOCH)}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {safe(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if row.get("refers_to") is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{safe(row['refers_to'])}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return member(("\r\n".join(lines) + "\r\n\r\n").encode(), block + b"\r\n\r\n")


def parsed(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if v}


def records(file: io.IOBase, start: int, end: int, wanted: Callable[[dict[str, str]], bool]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the wanted records that begin in [start, end) of an archive, whose kind its first bytes tell."""
    file.seek(0)
    first = file.read(HEAD.size)
    if first.startswith(b"WARC/"):
        yield from plain(file, start, end, wanted)
    elif first[:4] == MAGIC and first[12:14] == b"sl":
        yield from skippable(file, start, end, wanted)
    elif start == 0:  # members of unknown lengths: one reader takes the whole file, bit by bit
        file.seek(0)
        yield from streamed(Inflated(file), wanted)


class Inflated:
    """The bytes of a file of gzip members, of which no more are held than asked for."""

    def __init__(self, file: io.IOBase, step: int = 1 << 18) -> None:
        self.file, self.step, self.z = file, step, zlib.decompressobj(31)
        self.left, self.held = b"", b""

    def more(self) -> bytes:
        """Some bytes more, none at the end."""
        while True:
            if self.z.eof:
                self.left, self.z = self.z.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
            data = self.left or self.file.read(self.step)
            if not data:
                return b""
            out = self.z.decompress(data, self.step)
            self.left = self.z.unconsumed_tail
            if out:
                return out

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next mark, which is passed; None where there is none."""
        while (k := self.held.find(mark)) < 0:
            data = self.more()
            if not data:
                return None
            self.held += data
        out, self.held = self.held[:k], self.held[k + len(mark) :]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next n bytes, or, without keep, none of them, as they are passed."""
        parts = []
        while n > 0:
            data = self.held or self.more()
            if not data:
                break
            if keep:
                parts.append(data[:n])
            self.held = data[n:]
            n -= len(data)
        return b"".join(parts)


def streamed(source: Inflated, wanted: Callable) -> Iterator:
    """Records in order: headers first, and the blocks of unwanted ones are passed by without being held."""
    while (head := source.until(b"\r\n\r\n")) is not None:
        own = parsed(head)
        good = wanted(own)
        block = source.take(int(own.get("content-length", 0)), good)
        source.take(4, False)
        if good:
            yield own, block


def plain(file: io.IOBase, start: int, end: int, wanted: Callable) -> Iterator:
    """Of an archive that isn't compressed: the reader of [start, end) looks for the first record's version line there."""
    at = synced(file, start, b"WARC/1.", lambda b, k: k == 0 or b[max(0, k - 4) : k] == b"\r\n\r\n")
    while at is not None and at < end:
        file.seek(at)
        head = b""
        while b"\r\n\r\n" not in head and (more := file.read(4096)):
            head += more
        head, found, _ = head.partition(b"\r\n\r\n")
        if not found:
            return
        own = parsed(head)
        length, body = int(own.get("content-length", 0)), at + len(head) + 4
        if wanted(own):
            file.seek(body)
            yield own, file.read(length)
        at = body + length + 4


def synced(file: io.IOBase, start: int, mark: bytes, good: Callable[[bytes, int], bool]) -> int | None:
    """The first place from start on where mark stands and good agrees."""
    base = max(0, start - 4)
    file.seek(base)
    held = file.read(1 << 20)
    k = start - base
    while held:
        while (k := held.find(mark, k)) >= 0 and k + HEAD.size <= len(held):
            if good(held, k):
                return base + k
            k += 1
        more = file.read(1 << 20)
        if not more:
            return base + k if k >= 0 and good(held, k) else None
        keep = max(0, len(held) - 64)
        base, held, k = base + keep, held[keep:] + more, max(4, (k - keep) if k >= 0 else 4)
    return None


def skippable(file: io.IOBase, start: int, end: int, wanted: Callable) -> Iterator:
    at = start and synced(file, start, MAGIC, lambda b, k: b[k + 10 : k + 16] == b"\x0c\x00sl\x08\x00")
    while at is not None and at < end:
        file.seek(at)
        held = file.read(2048)
        if len(held) < HEAD.size:
            return
        size = HEAD.unpack_from(held)[-2]
        z = zlib.decompressobj(-15)
        out = z.decompress(held[HEAD.size : size])
        while b"\r\n\r\n" not in out and len(held) < size:  # a header of more than 2 KB
            more = file.read(min(4096, size - len(held)))
            held += more
            out += z.decompress(more)
        head, _, rest = out.partition(b"\r\n\r\n")
        own = parsed(head)
        if wanted(own):
            if size > len(held):
                rest += z.decompress(file.read(size - len(held)))
            rest += z.flush()
            yield own, rest[: int(own["content-length"])]
        at += size


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    """Options: path; payload (false: no payload is decompressed beyond its HTTP header's start); split_bytes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("split_bytes", 32 << 20))
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In | StringStartsWith):
                self.tests.append((HEADERS[column], type(f).__name__, f.value))
            yield f  # Spark tests once more: nothing is lost if a header is odd

    def partitions(self) -> list[Split]:
        return [Split(path, k, min(size, k + self.split)) for path, size in listed(self.path) for k in range(0, size, self.split)] or [Split("", 0, 0)]

    def wanted(self, own: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            have = own.get(name, "").strip("<>") if name in own else None
            if have is None or not (have == value if kind == "EqualTo" else have in value if kind == "In" else have.startswith(value)):
                return False
        return True

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SCHEMA.split(", ")])
        rows, held = [], 0
        if partition.path:
            at, own_path = store(partition.path)
            with at.open_input_file(own_path) as file:
                for own, block in records(file, partition.start, partition.end, self.wanted):
                    rows.append(self.row(own, block))
                    held += len(block)
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    def row(self, own: dict[str, str], block: bytes) -> dict:
        out = {c: own[h].strip("<>") if h in own else None for c, h in HEADERS.items()}
        payload, length = block, len(block)
        if own.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            length = int(parsed(http).get("content-length", len(payload)))
        digest = own.get("warc-payload-digest", "")
        out["payload_digest"] = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
        return out | {"payload_length": length, "payload": payload if self.payload and out["record_type"] != "revisit" else None}


@dataclass
class Written(WriterCommitMessage):
    temporary: str


class Writer(DataSourceArrowWriter):
    """A file per task, in place only once all are done: lost or repeated attempts leave nothing that is read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"{self.path}/_{uuid.uuid4().hex}"
        at, own = store(name)
        at.create_dir(own.rpartition("/")[0], recursive=True)
        with at.open_output_stream(own) as file:
            for batch in iterator:
                for row in batch.to_pylist():
                    file.write(record(row))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        for k, m in enumerate(x for x in messages if x):
            at, own = store(m.temporary)
            at.move(own, f"{own.rpartition('/')[0]}/part-{k:06d}.warc.gz")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                at, own = store(m.temporary)
                at.delete_file(own)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, *, least: int = 1000, html: str = "html") -> DataFrame:
    """Rows of SCHEMA, one per page: of equal payloads of at least so many bytes, the largest page_id's is the response that others refer to.

    Only digests and ids are grouped. Payloads alone in their group, and smaller
    ones, are responses; so are rows that share the largest id, and groups whose
    ids are all null. A null html is empty.
    """
    rows = pages.select("page_id", "url", utf8(html).alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    best = rows.where(large).groupBy(F.col("payload_digest").alias("digest_")).agg(F.max("page_id").alias("best_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    joined = rows.join(best, F.col("payload_digest") == F.col("digest_"), "left")
    again = F.col("best_").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best_")) & large
    return joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(EPOCH).alias("date"),
        F.when(again, urn(F.col("best_"))).alias("refers_to"),
        "payload_digest",
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(again, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
    )


def page_of(urn: Column) -> Column:
    return F.substring(urn, len("urn:page:") + 1, 30).try_cast("long")


def archived(pages: DataFrame, *, least: int = 1000, html: str = "html") -> DataFrame:
    """The records of pages after a round through archives in the shared folder: page_id, record_type, refers_to, payload_bytes, payload_digest.

    Responses' figures come from the payload that was read, revisits' from their
    headers; each kind is read by its own pushed-down predicate. Null html is empty;
    pages may repeat and ids be null, as page_records has it; payloads may have any
    length that a task can hold; an empty table gives none. Other columns of pages,
    whatever their names, are not read.
    """
    spark = pages.sparkSession
    register(spark)
    path = new_path(spark, "warc")
    page_records(pages, least=least, html=html).write.format("warc").mode("append").save(path)
    read = lambda kind, payload: spark.read.format("warc").option("payload", payload).load(path).where(F.col("record_type") == kind)
    # of revisits, headers alone are decompressed: they have no payload
    full, again = read("response", "true"), read("revisit", "false")
    columns = lambda n, digest, refers: [page_of(F.col("record_id")).alias("page_id"), n.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", refers.alias("refers_to")]
    responses = full.select(*columns(F.octet_length("payload"), F.sha1("payload"), F.lit(None).cast("long")))
    return responses.unionByName(again.select(*columns(F.col("payload_length"), F.col("payload_digest"), page_of(F.col("refers_to")))))
