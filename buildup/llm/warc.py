"""WARC archives: one gzip member a record, written by Spark and read by byte ranges.

Writing. Records with equal payloads (SHA-256) of at least ``min_bytes`` bytes are stored once: the record
with the largest id is the response, the others are revisits that refer to it. Spark's own text writer
stores the members, so its commit protocol covers lost and repeated tasks and any Hadoop file system
serves. The line separator it adds is the last byte of each member: a member ends with the
highest byte of its length, which is zero below 16 MB; to a longer one an empty member is added.

Reading. Files are cut into byte ranges. A task looks for the gzip magic in its range, accepts a
candidate if it decodes to a WARC header, and owns the records that start inside its range, even if they end
behind it. A payload may itself hold an archive that the compression left as it was, so a range
could begin inside a record and see records there. A first pass therefore notes where the last record
of each range ends; the second looks for records only behind the ends of all earlier ranges.

Defined cases: null payloads are empty, null ids and urls are left out of the record and read back as null;
line breaks in urls are escaped; rows that repeat the largest id with its payload are all responses;
an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildup.llm.common import prepare
from buildup.session import stage

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
PIECE = 1 << 18
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes | None, sha1: str, size: int, refers_to, date: str) -> bytes:
    """The bytes of one record; a null payload makes a revisit."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member that ends with a zero byte."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        empty = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += empty.flush()
    return out


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Write a record for each row below ``path``."""
    prepare(pages.sparkSession)
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("body")
    ).withColumn("key", F.sha2("body", 256))
    large = F.octet_length("body") >= min_bytes
    first = rows.where(large).groupBy("key").agg(F.max("id").alias("first"))
    joined = rows.join(first, "key", "left")
    again = large & ~F.col("id").eqNullSafe(F.col("first"))
    parts = joined.select(
        "id",
        "url",
        F.when(~again, F.col("body")).alias("body"),
        F.sha1("body").alias("sha1"),
        F.octet_length("body").alias("size"),
        F.when(again, F.col("first")).alias("refers_to"),
    )

    def pack(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        none = lambda values: [None if pd.isna(v) else int(v) for v in values]
        for ids, urls, bodies, sha1, size, refers in batches:
            items = zip(none(ids), urls, bodies, sha1, size, none(refers))
            yield pd.Series([member(record(*item, date))[:-1] for item in items], dtype=object)

    packed = F.pandas_udf(pack, T.BinaryType())("id", "url", "body", "sha1", "size", "refers_to")
    # the writer copies the bytes as they are; its separator is each member's last byte
    parts.select(packed.cast("string")).write.option("lineSep", "\0").text(path)


class Archive:
    """Random access to one file; what was read last is kept."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            store, inner = pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        else:
            store, inner = pafs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        self.base, self.data = 0, b""

    def load(self, start: int, size: int) -> None:
        self.file.seek(start)
        self.base, self.data = start, self.file.read(size)

    def at(self, start: int, size: int) -> bytes:
        if self.base <= start and start + size <= self.base + len(self.data):
            return self.data[start - self.base : start - self.base + size]
        self.file.seek(start)
        return self.file.read(size)


def decode(archive: Archive, start: int) -> tuple[bytes, int] | None:
    """Record and member size at ``start``, or None if no member with a WARC header begins there."""
    unpack = zlib.decompressobj(31)
    out, at, head = [], start, b""
    try:
        while not unpack.eof:
            data = archive.at(at, 4096 if at == start else PIECE)
            if not data:
                return None
            at += len(data)
            out.append(unpack.decompress(data))
            if len(head) < 5:
                head += out[-1][:5]
                if not b"WARC/".startswith(head[:5]):
                    return None
    except zlib.error:
        return None
    return (b"".join(out), at - len(unpack.unused_data) - start) if head[:5] == b"WARC/" else None


def owned(path: str, start: int, end: int, behind: int) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, size, record)`` of the records that start in [start, end) and not before ``behind``."""
    at = max(start, behind)
    if at >= end:
        return
    archive = Archive(path)
    archive.load(at, end - at + len(MAGIC) - 1)
    base, data = archive.base, archive.data
    while (found := data.find(MAGIC, at - base)) >= 0 and base + found < end:
        at = base + found
        whole = decode(archive, at)
        if whole is None:
            at += 1
        else:
            yield at, whole[1], whole[0]
            at += whole[1]


def _number(value: str | None) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value else None


def parse(data: bytes) -> dict:
    """Fields of one record; the payload of a revisit is null."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if not revisit and (digest32(body) != digest or len(body) != size):
        raise ValueError(f"payload of {fields.get('WARC-Record-ID')} does not match its digest")
    return {
        "record_type": fields["WARC-Type"],
        "record_id": _number(fields.get("WARC-Record-ID")),
        "target_uri": fields.get("WARC-Target-URI"),
        "refers_to": _number(fields.get("WARC-Refers-To")),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": None if revisit else body,
    }


_FIELDS = (
    "record_type string, record_id bigint, target_uri string, refers_to bigint, "
    "payload_digest string, payload_bytes bigint"
)


def ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, start, end, behind)`` of every byte range; records of earlier ranges end at ``behind``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    cuts = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {int(split_bytes)}L)")).alias("start"))
    cuts = stage(cuts.select("path", "start", F.least("length", F.col("start") + split_bytes).alias("end")), "ranges")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [
                max((at + size for at, size, _ in owned(p, s, e, 0)), default=0)
                for p, s, e in zip(batch["path"], batch["start"], batch["end"])
            ]
            yield batch.assign(last=ends)

    noted = _dealt(cuts).mapInPandas(last, "path string, start bigint, end bigint, last bigint")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.max("last").over(before), F.lit(0)).alias("behind")
    return stage(noted.select("path", "start", "end", behind), "ranges")


def _dealt(cuts: DataFrame) -> DataFrame:
    """A task for every few ranges; the rows say little about the work behind them."""
    return cuts.repartition(max(1, min(cuts.count(), 10_000)))


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records below ``path`` with file, offset and member size; payloads may be left out."""
    prepare(spark)
    schema = "path string, offset bigint, size bigint, " + _FIELDS + (", payload binary" if payloads else "")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, s, e, b in batch[["path", "start", "end", "behind"]].itertuples(index=False):
                rows, held = [], 0
                for at, size, data in owned(p, s, e, b):
                    row = {"path": p, "offset": at, "size": size} | parse(data)
                    if not payloads:
                        row.pop("payload")
                    rows.append(row)
                    held += len(data)
                    if held > SPLIT_BYTES:
                        yield _frame(rows)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return _dealt(ranges(spark, path, split_bytes)).mapInPandas(load, schema)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    return out.astype({"record_id": "Int64", "refers_to": "Int64"})
