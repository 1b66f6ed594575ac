"""Readers of the file formats: question banks, audit specs, responses, repository files."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.sinks import drop_at_exit, shared_folder

QUESTION = (
    "id STRING, version INT, status STRING, language STRING, category STRING, difficulty STRING, contentType STRING, prompt STRING, "
    "options ARRAY<STRUCT<id: STRING, text: STRING>>, correctOptionId STRING, explanation STRING, "
    "references ARRAY<STRUCT<book: STRING, chapter: INT, verseStart: INT, verseEnd: INT, display: STRING, translation: STRING, note: STRING>>, "
    "tags ARRAY<STRING>, review STRUCT<referenceChecked: BOOLEAN, singleCorrectAnswerChecked: BOOLEAN, doctrinalSensitivity: STRING, notes: STRING>"
)
AUDIT_SPEC = (
    "source STRING, version STRING, book STRING, chapter INT, questions ARRAY<STRUCT<id: STRING, verse_start: INT, verse_end: INT, question: STRING, "
    "correct_answer: STRING, distractors: ARRAY<STRING>, support_terms: ARRAY<STRING>, explanation_terms: ARRAY<STRING>>>"
)
PAGE_EVENT = "ts TIMESTAMP, viewport STRING, request_id BIGINT, url STRING, kind STRING, origin STRING, status INT, bytes BIGINT, message STRING, level STRING, location STRING"
SNAPSHOT = "dom_nodes BIGINT, dom_ready_ms BIGINT, load_ms BIGINT, h1 STRING, main_visible BOOLEAN"
EVENT = "user_id bigint, ts timestamp, event_id bigint, event string, option string"
#: Tasks that list the folders of one level.
LISTING_TASKS, LISTED = 2000, "path string, folder boolean"
TEXT_SUFFIXES = ("html", "css", "js", "json", "md", "xml", "yml", "yaml", "py", "txt", "svg")


def question_bank(spark: SparkSession, path: str) -> DataFrame:
    """A row per question of a JSON array, with its place; a file that is no array has none."""
    rows = spark.read.schema(QUESTION).option("multiLine", True).json(path)
    return rows.filter(F.col("id").isNotNull())


def audit_spec(spark: SparkSession, path: str) -> DataFrame:
    """A row per question of an audit spec; none if it has no questions."""
    spec = spark.read.schema(AUDIT_SPEC).option("multiLine", True).json(path)
    rows = spec.select("book", "chapter", F.upper(F.trim(F.coalesce("version", F.lit("")))).alias("version"), F.posexplode("questions").alias("pos", "q"))
    return rows.select("book", "chapter", "version", "pos", "q.*")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """A row (path, payload) per recorded response."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def listed_files(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """uri and path (from root) of all files under root, hidden and empty ones included, which
    Spark's own file sources pass over, but for those with a skipped folder in their path.

    Folders are listed level by level, those of one level by as many tasks as there are (up to
    LISTING_TASKS); each level is written, so that nothing is listed twice."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    work = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    drop_at_exit(spark, work)

    def listing(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(full_uri(top))
                start = at.rstrip("/")
                found = [x for x in fs.get_file_info(pafs.FileSelector(f"{start}/{path}" if path else start)) if x.base_name not in skip]
                paths = [x.path[len(start) + 1 :] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([x.type == pafs.FileType.Directory for x in found], pa.bool_())], ["path", "folder"])

    folders, level, count = spark.createDataFrame([("",)], "path string"), 0, 1
    while count:
        dealt = folders.repartition(min(count, LISTING_TASKS), "path") if level else folders
        dealt.mapInArrow(listing, LISTED).write.parquet(f"{work}/level={level}")
        folders = spark.read.schema(LISTED).parquet(f"{work}/level={level}").filter("folder").select("path")
        level, count = level + 1, folders.count()
    files = spark.read.schema(LISTED).parquet(*[f"{work}/level={i}" for i in range(level)]).filter("NOT folder")
    return files.select(F.concat(F.lit(f"{top}/"), "path").alias("uri"), "path")


def full_uri(uri: str) -> str:
    """Arrow wants file:///path where Hadoop says file:/path."""
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def repository_files(spark: SparkSession, root: str, skip: tuple[str, ...]) -> DataFrame:
    """path (from root), content, text (null if not UTF-8) and suffix of files under root, but
    for those with a skipped folder anywhere in their path. Executors read the contents."""

    def read(batches):
        for b in batches:
            for uri, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, folder = pafs.FileSystem.from_uri(full_uri(uri[: len(uri) - len(path)]))  # a file's own name may hold what URIs escape
                with fs.open_input_stream(f"{folder.rstrip('/')}/{path}", compression=None) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    rows = listed_files(spark, root, skip)
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(read, "path string, content binary")
    return rows.select(
        "path",
        "content",
        F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"),
        F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)).alias("suffix"),
    )


def page_events(spark: SparkSession, path: str) -> DataFrame:
    """What a browser logged, as JSON lines: responses, page errors, console errors, failed requests."""
    return spark.read.schema(PAGE_EVENT).json(path)


def page_event_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The same log as a stream of the files that arrive in a folder."""
    return spark.readStream.schema(PAGE_EVENT).option("maxFilesPerTrigger", per_trigger).json(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """What was measured on a page, as JSON lines."""
    return spark.read.schema(SNAPSHOT).json(path)


def event_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of UI events (EVENT) from JSON lines that arrive in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(path)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet folder or one file of it."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    parent, _, file = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema)
    return source.parquet(path) if folder else source.option("pathGlobFilter", file).parquet(parent)


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """A row (xml, locs, error) for a sitemap file; error tells of one that is not well-formed."""
    from attesta.operators.site import parsed_sitemap

    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("xml"), parsed_sitemap(F.col("value")).alias("s"))
    return rows.select("xml", "s.locs", "s.error")
