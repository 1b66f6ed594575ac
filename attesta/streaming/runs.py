"""Running a stream to the end of what its source has."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from attesta.sources.sinks import delete_folder, drop_at_exit, shared_folder


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drained(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All rows that the stream gives until its source has no more, with the number of their micro-batch
    (batch), as a table in the shared folder that goes when the driver ends. A batch that is
    run again replaces its own rows. The stream's checkpoint goes at once, unless it is named."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    at = checkpoint or f"{folder}/checkpoint"
    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    if checkpoint is None:
        delete_folder(spark, at)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    return spark.read.schema(f"{names}, batch bigint").parquet(f"{folder}/rows")
