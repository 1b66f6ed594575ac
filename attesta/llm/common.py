"""Helpers shared by the corpus operators: reading tables, shared storage, Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
#: Rows and bytes of one Arrow batch, which both the executor and its Python worker hold.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

Batches = Iterator[pa.RecordBatch]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make this package importable on executors and bound Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64MB") in ("67108864b", "67108864", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if os.getcwd() == str(ROOT) or str(ROOT) in on_path:
        return
    sc = spark.sparkContext
    if any(str(f).endswith("attesta_src.zip") for f in sc.listFiles):
        return
    target = Path(tempfile.mkdtemp(prefix="attesta")) / "attesta_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "attesta").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    if str(ROOT) not in sys.path:
        sys.path.insert(0, str(ROOT))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of
    our own where a session with a local master has none (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='attesta-shared-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def hadoop_delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(hadoop_delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage is cut, and a
    lost executor costs a reread only."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[id(table)] = (table, path)
    return table


#: Written tables that may be dropped before the interpreter ends, with their paths.
_tables: dict[int, tuple[DataFrame, str]] = {}


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written(), once what was made from them is written itself."""
    for table in tables:
        if entry := _tables.pop(id(table), None):
            hadoop_delete(table.sparkSession, entry[1])


#: Rows of a few numbers that may be sent to every task: some MB.
SMALL_ROWS = 200_000


def join_small(rows: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """rows joined to a table that is mostly small but has no bound: it is written, counted, and
    broadcast only up to SMALL_ROWS rows, so that a very common key stays spread."""
    few = written(few, "few")
    return rows.join(F.broadcast(few) if few.count() <= SMALL_ROWS else few, on)


_held: dict[str, Callable[[], None]] = {}


def holding(name: str, drop: Callable[[], None]) -> None:
    """Say that this module keeps things in a worker; drop() is called before other modules' tasks."""
    _held[name] = drop


def lean(keep: str | None = None) -> None:
    """A worker lives on from task to task: drop what other modules keep in it, and let the
    C library return large blocks to the system (where it is glibc)."""
    for name, drop in _held.items():
        if name != keep:
            drop()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        for option, value in ((-3, 16 << 20), (-1, 16 << 20), (-8, 2)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            libc.mallopt(option, value)
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema, keep: str | None = None) -> DataFrame:
    """fn over the Arrow batches of each partition; what the module `keep` holds stays."""
    prepare(df.sparkSession)

    def run(batches: Batches) -> Batches:
        lean(keep)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def columns(rows: np.ndarray) -> bytes:
    """Packed rows, column by column, which compress better."""
    return b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in rows.dtype.names)


def rows_from(data: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(data) // kind.itemsize, 0
    out = np.zeros(n, kind)
    for name in kind.names:
        out[name] = np.frombuffer(data, kind[name], n, at)
        at += n * kind[name].itemsize
    return out


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a folder that executors share."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def slices(b: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (bytes) or lists (items) come to about `most`."""
    values = b.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    at = held = 0
    for i, n in enumerate(pc.coalesce(length(values), 0).to_pylist()):
        held += n
        if held >= most:
            yield b.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < b.num_rows:
        yield b.slice(at)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none is among the columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out
