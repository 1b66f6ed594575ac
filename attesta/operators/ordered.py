"""Running sums, maxima and places in order, also where one key holds most of all rows.

A window over a key is one task, however many rows it has. Keys of up to `most` rows
go that way. Those of more are scanned in two passes: their rows are range-partitioned by
key and order and written, so that each part is a share of them; each part is summed up
by itself; the sums of the parts before are added to those within. What is summed must
be a monoid: sums, counts, maxima and minima are.

Edge cases: null keys are one group, as in a window; a null value adds nothing; rows that tie
in order may come in any order, so order should be total; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.sources.sinks import drop_at_exit, shared_folder

#: Rows of one key that a task may get, and rows of a small table that goes to all tasks.
MOST, SMALL_ROWS = 5_000_000, 200_000
#: What is summed up, how it goes on from the parts before.
MONOIDS = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns], F.lit(True))


def large_keys(rows: DataFrame, keys: list[str], most: int) -> list:
    """The keys with more than `most` rows, with their number: by a partial aggregate, and no more of them than all rows by most."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    return found.collect() if keys else [r for r in found.collect() if r["__n"]]


def parts(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """rows in n ranges of keys and order (__part), written, so that a task that is run again has the same ranges."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    placed = rows.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id())
    placed.write.parquet(folder)
    return spark.read.schema(placed.schema).parquet(folder)


def running(rows: DataFrame, keys: list[str], order: list[str], most: int = MOST, **of: tuple[str, Column]) -> DataFrame:
    """rows with a column for each of `of` (its name: one of MONOIDS and a value): the values
    summed up over the rows of the key up to and including each, in order."""
    names = {f"__v{i}": (name, kind) for i, (name, (kind, _)) in enumerate(of.items())}
    columns = [c for c in rows.columns if c not in of]
    valued = rows.select(*rows.columns, *[value.alias(v) for v, (_, value) in zip(names, of.values(), strict=True)])
    until = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def windowed(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumns({f"__r{v}": MONOIDS[kind][0](v).over(until(Window.partitionBy(*by))) for v, (_, kind) in names.items()})

    def result(df: DataFrame) -> DataFrame:
        return df.select(*columns, *[F.col(f"__r{v}").alias(name) for v, (name, _) in names.items()])

    large = large_keys(rows, keys, most)
    if not large:
        return result(windowed(valued, keys))
    spark = rows.sparkSession
    hot = spark.createDataFrame([tuple(r)[:-1] for r in large], rows.select(*keys).schema) if keys else None
    if hot is not None:
        hot = F.broadcast(hot) if len(large) <= SMALL_ROWS else hot
    n = max(2, math.ceil(sum(r["__n"] for r in large) / most))
    mine = valued.join(hot, same(valued, hot, keys), "left_semi") if hot is not None else valued
    placed = parts(mine, keys, order, n)
    totals = placed.groupBy("__part", *keys).agg(*[MONOIDS[kind][0](v).alias(f"__t{v}") for v, (_, kind) in names.items()])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = totals.select("__part", *keys, *[MONOIDS[kind][0](f"__t{v}").over(earlier).alias(f"__b{v}") for v, (_, kind) in names.items()])
    # a row for each part and key in it: parts and keys with over `most` rows are few
    before = F.broadcast(before) if n + len(large) <= SMALL_ROWS else before
    within = windowed(placed, ["__part", *keys])
    joined = within.join(before, same(within, before, ["__part", *keys]), "left")
    added = joined.select(*[within[c] for c in columns], *[MONOIDS[kind][1](F.col(f"__r{v}"), F.col(f"__b{v}")).alias(f"__r{v}") for v, (_, kind) in names.items()])
    if hot is None:
        return result(added)
    rest = valued.join(hot, same(valued, hot, keys), "left_anti")
    return result(windowed(rest, keys)).unionByName(result(added))


def place(rows: DataFrame, keys: list[str], order: list[str], name: str, most: int = MOST) -> DataFrame:
    """rows with their place under their key, from 1."""
    return running(rows, keys, order, most, **{name: ("sum", F.lit(1).cast("bigint"))})


def islands(rows: DataFrame, keys: list[str], number: str, most: int = MOST) -> DataFrame:
    """keys, first, last and size: the runs of consecutive numbers under a key; repeated ones count once."""
    each = rows.filter(F.col(number).isNotNull()).select(*keys, F.col(number).cast("bigint").alias("__number")).distinct()
    placed = place(each, keys, ["__number"], "__place", most)
    runs = placed.groupBy(*keys, (F.col("__number") - F.col("__place")).alias("__run"))
    return runs.agg(F.min("__number").alias("first"), F.max("__number").alias("last"), F.count("*").alias("size")).drop("__run")
