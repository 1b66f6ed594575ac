"""Verses of JSON documents of any size, also of ones that no task could hold.

``verses_of_files`` gives what ``passages.extract_verses`` gives, without ever having a tree: a file
is cut into ranges of bytes. A first pass counts each range's quotes, and its brackets for
both cases (that it begins within a string, and that it does not); running sums over the
ranges (``ordered.running``) tell in which case each range is, and how deep. A second pass
goes over each range by itself and gives an event for every object that begins in it, and for every key there
that a verse is made of, each with its depth. A key belongs to the object that was last begun at its
depth, which is a running maximum; the objects with a text, in the order of their beginnings, are the verses.

A string that is begun in a range is read to its end, wherever that is.

Edge cases: an empty file has no verses, and neither has one whose quotes or brackets do not close, or that is
no UTF-8; apart from that, documents must be well-formed, which is not checked. Of a key that an object has
twice the last value counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import ordered, passages
from attesta.sources.readers import full_uri

RANGE, MORE = 32 << 20, 1 << 16
STRING = rb'"(?:[^"\\]++|\\.)*+"'
TOKEN = re.compile(STRING + rb"|[{}\[\]]|\"", re.DOTALL)
COLON = re.compile(rb"[\x20\t\r\n]*+(:?)")
VALUE = re.compile(rb"[\x20\t\r\n]*+(?:(" + STRING + rb")|([-+.0-9A-Za-z]++)|([{\[])[\x20\t\r\n]*+([}\]]?))", re.DOTALL)
ESCAPED = re.compile(rb"\\.", re.DOTALL)
KEYS = {k.encode(): k for k in ("text", *passages.NUMBER_KEYS, *passages.REFERENCE_KEYS)}
EVENT = "path string, depth bigint, at bigint, key string, value string, is_text boolean, truthy boolean"


class Reader:
    """Bytes of a file by their places."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(full_uri(path))
        self.file = fs.open_input_file(at)
        self.size = self.file.size()

    def get(self, a: int, z: int) -> bytes:
        return self.file.read_at(max(0, min(z, self.size) - a), a)

    def escaped(self, at: int) -> bool:
        """Whether an odd number of backslashes stands before a place."""
        n, step = 0, 64
        while at - n > 0:
            some = self.get(max(0, at - n - step), at - n)
            kept = len(some) - len(some.rstrip(b"\\"))
            n += kept
            if kept < len(some):
                break
            step *= 2
        return n % 2 == 1


def counted(reader: Reader, a: int, z: int) -> tuple[int, int, int]:
    """(quotes, brackets opened less closed if the range begins outside of a string, and if within)."""
    start = a + reader.escaped(a)
    parts = ESCAPED.sub(b"", reader.get(start, z)).split(b'"')
    depth = [sum(p.count(b"{") + p.count(b"[") - p.count(b"}") - p.count(b"]") for p in parts[k::2]) for k in (0, 1)]
    return len(parts) - 1, depth[0], depth[1]


def events(reader: Reader, a: int, z: int, inside: bool, depth: int) -> Iterator[tuple]:
    """(depth, at, key, value, is_text, truthy) of the objects (without a key) and of the keys of a range."""
    held = reader.get(a, z + MORE)
    whole = a + len(held) >= reader.size
    at = int(reader.escaped(a))

    def more() -> None:
        nonlocal held, whole
        held += reader.get(a + len(held), a + 2 * len(held) + MORE)
        whole = a + len(held) >= reader.size

    if inside:
        end = ESCAPED.sub(b"__", held[at : z - a]).find(b'"')
        if end < 0:
            return
        at += end + 1
    while (m := TOKEN.search(held, at)) and a + m.start() < z:
        token = m[0]
        if token == b'"':  # a string that goes on beyond what is held
            if whole:
                return
            more()
            continue
        if token in b"{[":
            depth += 1
            if token == b"{":
                yield depth, a + m.start(), None, None, False, False
        elif token in b"}]":
            depth -= 1
        else:
            colon = COLON.match(held, m.end())
            if colon.end() == len(held) and not whole:
                more()
                continue
            if colon[1] and token[1:-1] in KEYS:
                value = VALUE.match(held, colon.end())
                if (value is None or value.end() == len(held)) and not whole:
                    more()
                    continue
                if value is not None:
                    yield depth, a + m.start(), KEYS[token[1:-1]], *told(value)
            at = colon.end() if colon[1] else m.end()
            continue
        at = m.end()


def told(value: re.Match) -> tuple[str | None, bool, bool]:
    """(a string, or a whole number as text; whether it is a string; whether the value is truthy)."""
    if value[1] is not None:
        text = json.loads(value[1])
        return text, True, bool(text)
    if value[3] is not None:
        return None, False, not value[4]
    plain = json.loads(value[2])
    return str(int(plain)) if isinstance(plain, int) else None, False, bool(plain)


def verses_of_files(files: DataFrame, size: int = RANGE, strict_zero: bool = True, most: int = ordered.MOST) -> DataFrame:
    """path, pos, verse_number, text and reference_from_api of the verses in files (path, length), in ranges of `size` bytes."""
    ranges = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("a"), "length")
    ranges = ranges.select("path", "a", F.least(F.col("a") + size, "length").alias("z"), "length")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches):
        for b in batches:
            for path, a, z, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                columns = [path, a, z, length, *counted(Reader(path), a, z)]
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("path", "a", "z", "length", "quotes", "outside", "within"), columns, strict=True)})

    first = ranges.repartition(tasks, "path", "a").mapInArrow(count, "path string, a bigint, z bigint, length bigint, quotes bigint, outside bigint, within bigint")
    first = ordered.running(first, ["path"], ["a"], most, sum_quotes=("sum", F.col("quotes")))
    first = first.withColumn("inside", (F.col("sum_quotes") - F.col("quotes")) % 2 == 1)
    first = first.withColumn("change", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    first = ordered.running(first, ["path"], ["a"], most, depth=("sum", F.col("change")))
    broken = first.filter((F.col("z") == F.col("length")) & ((F.col("depth") != 0) | (F.col("sum_quotes") % 2 == 1))).select("path")
    known = first.join(broken, "path", "left_anti").select("path", "a", "z", "inside", (F.col("depth") - F.col("change")).alias("depth"))

    def walk(batches):
        names = [x.split()[0] for x in EVENT.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
        for b in batches:
            for path, a, z, inside, depth in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows = [(path, *e) for e in events(Reader(path), a, z, inside, depth)]
                except ValueError:  # no UTF-8, or no JSON, within a string
                    rows = [(path, -1, a, None, None, False, False)]
                for s in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[s : s + 10_000], strict=True), kinds, strict=True)], names)

    found = known.repartition(tasks, "path", "a").mapInArrow(walk, EVENT)
    found = ordered.running(found, ["path", "depth"], ["at"], most, object=("max", F.when(F.col("key").isNull(), F.col("at"))))
    bad = found.filter("depth < 0").select("path").distinct()
    fields = found.filter("key IS NOT NULL").groupBy("path", "object", "key").agg(F.max_by(F.struct("value", "is_text", "truthy"), "at").alias("v"))
    nodes = fields.groupBy("path", "object").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("f"))  # a few keys

    def of(key: str):
        return F.try_element_at(F.col("f"), F.lit(key))

    text = F.when(of("text")["is_text"], of("text")["value"])
    nodes = nodes.filter(F.length(tx.strip(text)) > 0).join(bad, "path", "left_anti")
    given = F.when(of("reference")["truthy"], of("reference")).otherwise(of("ref"))
    numbers = F.array_compact(F.array(*[of(k)["value"] for k in passages.NUMBER_KEYS]))
    cited = F.array_compact(F.array(*[F.when(of(k)["is_text"], of(k)["value"]) for k in passages.REFERENCE_KEYS]))
    rows = nodes.select("path", "object", tx.strip(text).alias("text"), F.when(given["is_text"] & given["truthy"], given["value"]).alias("reference_from_api"), numbers.alias("numbers"), cited.alias("references"))
    placed = ordered.place(rows, ["path"], ["object"], "pos", most)
    number = F.coalesce(passages.number_of(F.col("numbers"), F.col("references"), strict_zero), F.col("pos"))
    return placed.select("path", "pos", number.alias("verse_number"), "text", "reference_from_api")
