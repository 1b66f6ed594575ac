"""WARC writing with revisit records, and a splittable reader of gzip members.

Writer: every task writes archives of its own into the shared folder, one gzip
member per record, under a temporary name that is renamed when complete, and
returns the archive's path and length; a retried task writes a new archive and
only the returned ones are read. Of records with equal payloads (by SHA-1) of at
least ``min_revisit_bytes`` the one with the smallest id is a response, the
others are revisits that name it; the choice needs one shuffle of (digest, id),
pre-aggregated, and one of the pages by digest and id, so that a very common payload
is spread over all tasks.

Reader: an archive is cut into byte ranges without looking at it. The task of a
range looks for the gzip magic from its start on, takes a place for a member only
if what it inflates to begins with a WARC version line and has its mandatory
headers, and owns the members that start inside its range; it reads on beyond
the range's end to finish the last one. After a member it goes on at that member's
end, so an archive inside a payload gives no records. A range may start inside such a
payload; then the members found in it do not follow one another up to CHUNK bytes
beyond the range's end, and that range's members are told by a walk from the
archive's start. (An inner archive that is stored without compression and goes on for
longer cannot be told from a real one this way.) Otherwise the ranges need not know each other.

Edge cases: a null payload or url is empty; pages with the same id and payload
are all responses if theirs is the smallest id; a null id is written as such and
comes back null, and is never named by a revisit unless all ids of that payload
are null; an empty table writes no archive and reads as no row; other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import Batches, filesystem, map_batches, prepare, shared_path

MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
#: Bytes read at once, and bytes inflated at once (what is left of those is copied).
CHUNK, PIECE = 1 << 20, 16 << 10
MANDATORY = (b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length")
DATE = b"2024-01-01T00:00:00Z"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "page_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string, "
    "payload binary, archive string, offset bigint"
)
GZIP_LEVEL = 1


def record(page_id: int | None, url: bytes, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not compressed. A revisit has the HTTP head but no payload."""
    name = b"null" if page_id is None else str(page_id).encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % name,
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url),
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Payload-Digest: sha1:" + digest,
        b"Content-Length: %d" % len(block),
    ]
    if revisit:
        target = b"null" if refers_to is None else str(refers_to).encode()
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: <urn:page:%s>" % target]
    return CRLF.join(head) + CRLF * 2 + block + CRLF * 2


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def with_revisits(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """pages (page_id, url, payload) with refers_to and revisit."""
    pages = pages.withColumn("digest", F.unhex(F.sha1("payload")))
    ids = pages.filter(F.length("payload") >= min_revisit_bytes).select("page_id", "digest")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = ids.distinct().join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "first", F.lit(True).alias("again"))
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))
    return pages.join(again, same, "left").select(
        "page_id", "url", "payload", "digest", F.col("first").alias("refers_to"), F.coalesce("again", F.lit(False)).alias("revisit")
    )


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0
) -> DataFrame:
    """Write the archives; a row per archive: path, bytes, records. Lazy: run it once only."""
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def write(batches: Batches) -> Batches:
        fs, base = filesystem(folder)
        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
        at, n, out = 0, 0, None
        for b in batches:
            for page_id, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = out or fs.open_output_stream(name + ".part", compression=None)
                packed = member(record(page_id, url, payload, base64.b32encode(digest), refers_to, revisit))
                out.write(packed)
                at, n = at + len(packed), n + 1
        if out:
            out.close()
            fs.move(name + ".part", name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).cast("binary").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    )
    return map_batches(with_revisits(rows, min_revisit_bytes), write, "path string, bytes bigint, records bigint")


class Blocks:
    """An archive read in blocks of CHUNK bytes, of which the last few are kept."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.kept = file, {}

    def block(self, k: int) -> bytes:
        if k not in self.kept:
            if len(self.kept) >= 8:
                self.kept.pop(next(iter(self.kept)))
            self.file.seek(k * CHUNK)
            self.kept[k] = self.file.read(CHUNK)
        return self.kept[k]

    def rest(self, at: int) -> memoryview:
        """Up to PIECE bytes from a place on, of its block; nothing at the archive's end."""
        return memoryview(self.block(at // CHUNK))[at % CHUNK : at % CHUNK + PIECE]

    def magic(self, at: int, end: int) -> int | None:
        """The first place of the magic in [at, end)."""
        while at < end:
            k = at // CHUNK
            data = self.block(k)
            found = data.find(MAGIC, at % CHUNK)
            if found < 0 and len(data) == CHUNK:  # it may go on in the next block
                edge = max(at % CHUNK, CHUNK - len(MAGIC) + 1)
                found = (data[edge:] + self.block(k + 1)[: len(MAGIC) - 1]).find(MAGIC)
                found = found + edge if found >= 0 else found
            if found >= 0:
                return k * CHUNK + found if k * CHUNK + found < end else None
            at = (k + 1) * CHUNK
        return None


def inflate(blocks: Blocks, at: int) -> tuple[bytes, int] | None:
    """The member at a place and where it ends, or None if there is no WARC record."""
    unpack, out, pos, judged = zlib.decompressobj(31), [], at, False
    try:
        while not unpack.eof:
            if not (data := unpack.unconsumed_tail):
                if not (data := blocks.rest(pos)):
                    return None
                pos += len(data)
            out.append(unpack.decompress(data, 0 if judged else 16))
            if not judged:
                head = b"".join(out)
                if not head.startswith(b"WARC/"[: len(head)]):
                    return None
                judged = len(head) >= 5
    except zlib.error:
        return None
    return b"".join(out), pos - len(unpack.unused_data)


def parse(data: bytes) -> dict | None:
    """The record's fields, or None where mandatory headers are missing."""
    head, _, rest = data.partition(CRLF * 2)
    fields = dict(x.split(b": ", 1) for x in head.split(CRLF)[1:] if b": " in x)
    if any(x not in fields for x in MANDATORY) or not fields[b"Content-Length"].isdigit():
        return None
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    size = re.search(rb"(?i)\r\nContent-Length: (\d+)", http)

    def number(name: bytes) -> int | None:
        m = re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(name, b""))
        return int(m[1]) if m else None

    return {
        "page_id": number(b"WARC-Record-ID"),
        "record_type": fields[b"WARC-Type"].decode(),
        "refers_to": number(b"WARC-Refers-To"),
        "url": fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"),
        "payload_bytes": int(size[1]) if size else len(payload),
        "payload_digest": fields.get(b"WARC-Payload-Digest", b"").decode().removeprefix("sha1:"),
        "payload": payload,
    }


def walk(blocks: Blocks, at: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """(offset, end, record) of the members that start in [at, end), each looked for from the end of the one before."""
    while (at := blocks.magic(at, end)) is not None:
        member = inflate(blocks, at)
        if member and (found := parse(member[0])):
            yield at, member[1], found
            at = member[1]
        else:
            at += 1


def members(path: str, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the members that start in [start, end)."""
    fs, name = filesystem(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(name) as f:
        blocks = Blocks(f)
        if start:
            beyond = min(end + CHUNK, f.size())
            at = [(a, z) for a, z, _ in walk(blocks, start, end)]
            at += [(a, z) for a, z, _ in walk(blocks, at[-1][1], beyond)] if at else []
            if any(z != a for (_, z), (a, _) in zip(at, at[1:], strict=False)) or (at and at[-1][1] < beyond):
                yield from ((a, found) for a, _, found in walk(blocks, 0, end) if a >= start)
                return
            start = at[0][0] if at else end
        yield from ((a, found) for a, _, found in walk(blocks, start, end))


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """The records of the archives (path, bytes), read in byte ranges of split_bytes."""
    prepare(spark)
    ranges = archives.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start")
    ).select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))

    def read(batches: Batches) -> Batches:
        names = ["page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload", "archive", "offset"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list[dict] = []
                held = 0
                for offset, row in members(path, start, end):
                    rows.append(row | {"archive": os.path.basename(path), "offset": offset})
                    held += len(row["payload"])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    # a stated number of partitions, as ranges are too few bytes for Spark to keep them apart
    return map_batches(ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start"), read, RECORD)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder (path, bytes), listed through Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path", F.col("length").alias("bytes"))


def roundtrip(pages: DataFrame, min_revisit_bytes: int = 0, split_bytes: int = 4 << 20) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    listing = shared_path(spark, "warc-list")
    write_warc(pages, folder, min_revisit_bytes=min_revisit_bytes).write.parquet(listing)
    return read_warc(spark, spark.read.parquet(listing), split_bytes)


def digest(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
