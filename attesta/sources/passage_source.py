"""A Spark data source of passages: ``spark.read.format("passages")`` and ``readStream``.

A row per chapter: book, chapter, status, payload and error, as ``http.responses`` gives
them. Spark plans the requests: a partition is a range of chapters of one book, and
filters on book and chapter are pushed down, so only chapters that a query can use
are asked for. Responses with a status are kept in the folder `store`, if one is
named: a chapter that is there is not asked for again, by a retried task, another query
or a stream that is taken up again.

Options: url (where chapters are asked for by ?ref=, or the address of recorded
responses with {book} and {chapter} in it, of any file system that Arrow knows), books
(name:chapters, joined by commas), version, accessKey (sent as X-Key), store,
timeout (seconds), chaptersPerPartition and, for streams, chaptersPerBatch.

A stream goes through the chapters in the order of books. Its offset is the number of
chapters before it. A batch begins after the chapters that the store has from the first on,
so it needs a store to take up where it stopped; without one, all chapters are one batch.

Load a frame for each filter: Spark 4.1 keeps what a loaded frame has planned, also for a
later query over the same frame that pushes no filter down.

Edge cases: a book without chapters has no partition; a chapter that is filtered away is
not asked for; a response that never came has no status, is not stored, and is asked for
the next time; a null in a filter matches nothing.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from attesta.sources.http import ask
from attesta.sources.readers import full_uri

SCHEMA = "book string, chapter int, status int, payload string, error string"
PER_PARTITION, PER_BATCH, SECONDS = 10, 50, 30
Chapter = tuple[str, int]


@dataclass
class Chapters(InputPartition):
    """Chapters first to last of a book."""

    book: str
    first: int
    last: int

    def listed(self) -> list[Chapter]:
        return [(self.book, c) for c in range(self.first, self.last + 1)]


def catalogue(books: str) -> list[tuple[str, int]]:
    """(book, number of its chapters) from name:chapters,..."""
    out = []
    for part in filter(None, (x.strip() for x in books.split(","))):
        name, _, n = part.rpartition(":")
        if not name.strip() or not n.strip().isdigit():
            raise ValueError(f"books are given as name:chapters, not {part!r}")
        out.append((name.strip(), int(n)))
    return out


def ranges(chapters: Iterable[Chapter], size: int) -> list[Chapters]:
    """Runs of following chapters of one book, of `size` at most."""
    out: list[Chapters] = []
    for book, c in chapters:
        if out and out[-1].book == book and out[-1].last + 1 == c and c - out[-1].first < size:
            out[-1].last = c
        else:
            out.append(Chapters(book, c, c))
    return out


class Requests:
    """How a chapter is asked for, and where its response is kept."""

    def __init__(self, options: dict[str, str]):
        if not options.get("url"):
            raise ValueError("the passages source needs a url")
        self.url, self.version, self.key = options["url"], options.get("version", ""), options.get("accessKey", "")
        self.store, self.timeout = options.get("store", "").rstrip("/"), float(options.get("timeout", SECONDS))
        self.books = catalogue(options.get("books", ""))
        self.per_partition = max(1, int(options.get("chaptersPerPartition", PER_PARTITION)))
        self.per_batch = max(1, int(options.get("chaptersPerBatch", PER_BATCH)))

    def chapters(self) -> list[Chapter]:
        return [(book, c) for book, n in self.books for c in range(1, n + 1)]

    def address(self, book: str, chapter: int) -> str:
        if "{book}" in self.url or "{chapter}" in self.url:
            return self.url.replace("{book}", urllib.parse.quote(book)).replace("{chapter}", str(chapter))
        return f"{self.url}?{urllib.parse.urlencode({'ref': f'{book} {chapter}', 'version': self.version})}"

    def kept(self, book: str, chapter: int) -> str:
        """Where a chapter's response is kept: under a digest of what was asked for, without the key."""
        return f"{self.store}/{hashlib.sha256(self.address(book, chapter).encode()).hexdigest()}.json"

    def known(self, book: str, chapter: int) -> bool:
        fs, path = pafs.FileSystem.from_uri(full_uri(self.kept(book, chapter)))
        return fs.get_file_info(path).type == pafs.FileType.File

    def response(self, book: str, chapter: int) -> tuple[int | None, str | None, str | None]:
        """(status, payload, error), from the store if it has it."""
        if not self.store:
            return self.asked(book, chapter)
        fs, path = pafs.FileSystem.from_uri(full_uri(self.kept(book, chapter)))
        if fs.get_file_info(path).type == pafs.FileType.File:
            with fs.open_input_stream(path) as f:
                return tuple(json.loads(f.read()))
        found = self.asked(book, chapter)
        if found[0] is not None:
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            part = f"{path}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(json.dumps(found).encode())
            fs.move(part, path)
        return found

    def asked(self, book: str, chapter: int) -> tuple[int | None, str | None, str | None]:
        address = self.address(book, chapter)
        if address.startswith(("http:", "https:")):
            return ask(address, None, {"X-Key": self.key} if self.key else {}, self.timeout)
        try:
            fs, path = pafs.FileSystem.from_uri(full_uri(address))
            with fs.open_input_stream(path) as f:
                return 200, f.read().decode(), None
        except FileNotFoundError:
            return 404, None, "no recorded response"
        except (OSError, ValueError) as e:
            return None, None, str(e)

    def rows(self, part: Chapters | None) -> Iterator[tuple]:
        """The rows of a partition; where there are none, Spark reads None."""
        for book, c in part.listed() if part else ():
            yield (book, c, *self.response(book, c))


def pushed(f: Filter) -> Callable[[Chapter], bool] | None:
    """Whether a chapter passes a filter; None if this source cannot tell."""
    column = getattr(f, "attribute", None)
    if column not in (("book",), ("chapter",)):
        return None
    at = 0 if column == ("book",) else 1
    if isinstance(f, IsNotNull):
        return lambda c: True
    if isinstance(f, In):
        values = {v for v in f.value if v is not None}
        return lambda c: c[at] in values
    tests = {EqualTo: "__eq__", EqualNullSafe: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
    test = tests.get(type(f))
    if test is None or f.value is None or (at == 0 and test != "__eq__"):
        return None
    return lambda c: getattr(c[at], test)(f.value)


class PassageReader(DataSourceReader):
    def __init__(self, requests: Requests):
        self.requests = requests
        self.tests: list[Callable[[Chapter], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (test := pushed(f)) is not None:
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[Chapters]:
        wanted = [c for c in self.requests.chapters() if all(test(c) for test in self.tests)]
        self.tests = []  # what partitions are read by needs no tests
        return ranges(wanted, self.requests.per_partition)

    def read(self, partition: Chapters | None) -> Iterator[tuple]:
        return self.requests.rows(partition)


class PassageStream(DataSourceStreamReader):
    def __init__(self, requests: Requests):
        self.requests = requests

    def initialOffset(self) -> dict:
        return {"chapters": 0}

    def latestOffset(self) -> dict:
        every = self.requests.chapters()
        if not self.requests.store:
            return {"chapters": len(every)}
        done = next((i for i, c in enumerate(every) if not self.requests.known(*c)), len(every))
        return {"chapters": min(len(every), done + self.requests.per_batch)}

    def partitions(self, start: dict, end: dict) -> list[Chapters]:
        return ranges(self.requests.chapters()[start["chapters"] : end["chapters"]], self.requests.per_partition)

    def read(self, partition: Chapters | None) -> Iterator[tuple]:
        return self.requests.rows(partition)


class PassageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "passages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PassageReader(Requests(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PassageStream(Requests(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PassageSource)
