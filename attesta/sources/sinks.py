"""Sinks: JSON documents with nulls kept, and the guard that keeps source text out of them."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from attesta.functions import text as tx
from attesta.operators.copies import verbatim_copies

MIN_COPY = 40


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where a session with a
    local master has none a temporary one, which goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "local" not in _own:
        _own["local"] = tempfile.mkdtemp(prefix="attesta-shared-")
        atexit.register(shutil.rmtree, _own["local"], ignore_errors=True)
    return f"file://{_own['local']}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver's interpreter ends, as long as the session is there."""

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            delete_folder(spark, path)

    atexit.register(drop)


def json_document(row: DataFrame) -> DataFrame:
    """A one-row frame as one pretty JSON text, explicit nulls kept."""
    return row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def write_json_document(row: DataFrame, path: str) -> None:
    json_document(row).coalesce(1).write.mode("overwrite").text(path)


def write_findings(findings: DataFrame, path: str, by: str = "check_name") -> None:
    """Findings as JSON lines, a folder for each check; folders of a former run go."""
    findings.withColumn("__by", F.col(by)).write.mode("overwrite").partitionBy("__by").json(path)


def write_report(header: DataFrame, results: DataFrame, path: str, order: str) -> None:
    """A report of any size: the one-row header as a JSON document in path/header, and the results
    as JSON lines in order, in as many files as they need, in path/results."""
    write_json_document(header, f"{path}/header")
    results.orderBy(order).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/results")


def leaks(output: DataFrame, sources: DataFrame, text: str = "text") -> DataFrame:
    """(column, found): text columns of output that hold a source text of MIN_COPY characters
    or more, in normal form. An empty result lets the output pass.

    Texts are known by a digest while they are compared, and each different one is
    compared once; see copies.verbatim_copies.
    """
    source = sources.select(tx.normalize_spaces(F.col(text)).alias("s")).filter(F.length("s") >= MIN_COPY).distinct().withColumn("source_key", F.sha2("s", 256))
    texts = []
    for f in output.schema.fields:
        if isinstance(f.dataType, StringType):
            texts.append(output.select(F.lit(f.name).alias("column"), F.col(f.name).alias("t")))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType):
            texts.append(output.select(F.lit(f.name).alias("column"), F.explode(f.name).alias("t")))
    if not texts:
        return output.sparkSession.createDataFrame([], "column string, found string")
    rows = texts[0]
    for t in texts[1:]:
        rows = rows.unionByName(t)
    rows = rows.filter("t IS NOT NULL").withColumn("text_key", F.sha2("t", 256)).distinct()
    found = verbatim_copies(rows.select("text_key", "t").distinct(), source, "text_key", "source_key", "t", "s")
    # the columns of a text are few and its copies one row, so what is long is joined last
    return found.join(rows.select("column", "text_key"), "text_key").select("column", "source_key").distinct().join(source, "source_key").select("column", F.col("s").alias("found"))


def redacted(df: DataFrame, *columns: str) -> DataFrame:
    """df without the columns that hold source text, marked as such."""
    return df.drop(*columns).withColumn("source_text_persisted", F.lit(False))
