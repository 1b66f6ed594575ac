"""The store of users' progress: a log of batches that can be written again, cleared, merged and compacted.

A store is a folder of Parquet tables. ``append`` adds the records of one batch of one writer
(user_id, raw, version; a null raw clears the user's record); a batch that is there already
changes nothing, so a stream may give it again. ``records`` gives the record of
each user: that of the highest version, then of the latest batch, then of the last writer by name.
Writers never write the same files, so none can lose another's rows. ``compact`` merges what there
is into one table; a list of what it holds is created by exactly one of several that try, and
readers follow the latest list. Batches and tables that the list before no longer named are deleted by the
next compaction, so a reader that has begun can end.

Edge cases: a folder that isn't there, or is empty, has no records; an unfinished batch is not read; a batch
without rows counts as written; cleared users keep a mark with its version, so that an older record
that comes later does not bring them back; a null user or version is refused.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "user_id bigint, raw string, version bigint"
KEPT = f"{RECORD}, batch bigint, writer string"


class Folder:
    """File operations in a store's folder, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        at = self.at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def there(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one."""
        if self.there(name):
            return False
        part = f"{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.at(part), False)
        out.write(text.encode())
        out.close()
        done = not self.there(name) and self.fs.rename(self.at(part), self.at(name))
        if not done:
            self.delete(part)
        return done

    def read(self, name: str) -> str:
        source = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()


def listed(folder: Folder) -> tuple[int, dict]:
    """(number, content) of the latest list: a base table, and the batches that it holds."""
    lists = [int(n[:-5]) for n in folder.names("lists") if re.match(r"\d+\.json$", n)]
    return (max(lists), json.loads(folder.read(f"lists/{max(lists):08d}.json"))) if lists else (0, {"base": None, "holds": [], "gone": []})


def batches(folder: Folder) -> list[str]:
    """The finished batches of the log."""
    return [n for n in folder.names("log") if folder.there(f"log/{n}/_SUCCESS")]


def append(states: DataFrame, path: str, writer: str, batch: int) -> bool:
    """Add the records (user_id, raw, version) of a writer's batch; False if they were there already."""
    if not re.match(r"[A-Za-z0-9_]+$", writer) or batch < 0:
        raise ValueError("a writer is named by letters and digits, a batch by a number from 0 on")
    folder, name = Folder(states.sparkSession, path), f"{writer}-{batch:012d}"
    if folder.there(f"log/{name}/_SUCCESS") or name in listed(folder)[1]["holds"]:
        return False
    checked = [F.coalesce(F.col(c).cast("bigint"), F.raise_error(F.lit(f"a record needs its {c}")).cast("bigint")).alias(c) for c in ("user_id", "version")]
    rows = states.select(checked[0], F.col("raw").cast("string").alias("raw"), checked[1], F.lit(batch).cast("bigint").alias("batch"), F.lit(writer).alias("writer"))
    rows.write.mode("overwrite").parquet(f"{folder.path}/log/{name}")  # what a run that failed has left goes
    return True


def merged(spark: SparkSession, folder: Folder, base: str | None, names: list[str]) -> DataFrame:
    """The latest row of each user, of a base table and batches; cleared ones have a null raw."""
    paths = [f"{folder.path}/{base}"] if base else []
    paths += [f"{folder.path}/log/{n}" for n in names]
    rows = spark.read.schema(KEPT).parquet(*paths) if paths else spark.createDataFrame([], KEPT)
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("raw", "version", "batch", "writer"), F.struct("version", "batch", "writer")).alias("r"))
    return last.select("user_id", "r.*")


def records(spark: SparkSession, path: str) -> DataFrame:
    """user_id, raw and version of every user that has a record."""
    folder = Folder(spark, path)
    _, known = listed(folder)
    fresh = [n for n in batches(folder) if n not in set(known["holds"])]
    return merged(spark, folder, known["base"], fresh).filter("raw IS NOT NULL").select("user_id", "raw", "version")


def compact(spark: SparkSession, path: str) -> bool:
    """Merge the base table and the batches into a new base table; False if another compaction was faster."""
    folder = Folder(spark, path)
    number, known = listed(folder)
    fresh = [n for n in batches(folder) if n not in set(known["holds"])]
    base = f"base-{uuid.uuid4().hex}"
    merged(spark, folder, known["base"], fresh).write.parquet(f"{folder.path}/{base}")
    gone = [f"log/{n}" for n in fresh] + ([known["base"]] if known["base"] else [])
    text = json.dumps({"base": base, "holds": [*known["holds"], *fresh], "gone": gone})
    if not folder.create(f"lists/{number + 1:08d}.json", text):
        folder.delete(base)
        return False
    for name in known["gone"]:
        folder.delete(name)
    return True
