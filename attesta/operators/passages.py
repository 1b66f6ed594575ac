"""Passages: ordered, numbered rows, and text assembled over ranges of them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import ordered

# Keys that may hold a number, in order of preference.
NUMBER_KEYS = ("verse", "verseNumber", "verse_number", "number", "verseId", "verse_id")
REFERENCE_KEYS = ("reference", "ref", "id")


def numbers(start: Column, end: Column) -> Column:
    """start..end, empty if end < start (sequence would count down)."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<bigint>"))


def blocks(start: Column, end: Column, short: int) -> Column:
    """array<struct<level, i>>: the blocks of 2**level numbers, from i * 2**level on, that make up start..end,
    in order. A range of up to `short` numbers is its numbers; a longer one has about two blocks for each
    doubling of its length."""
    kind = "array<struct<level:int,i:bigint>>"
    none = F.array().cast(kind)

    def block(level: Column, i: Column) -> Column:
        return F.array(F.struct(level.cast("int").alias("level"), i.cast("bigint").alias("i"))).cast(kind)

    def step(at: Column, level: Column) -> Column:
        # what a block of the next level does not hold is taken off at both ends
        left = (at["l"] <= at["r"]) & (F.pmod(at["l"], F.lit(2)) == 1)
        low = F.when(left, at["l"] + 1).otherwise(at["l"])
        right = (low <= at["r"]) & (F.pmod(at["r"], F.lit(2)) == 0)
        high = F.when(right, at["r"] - 1).otherwise(at["r"])
        return F.struct(
            F.when(low <= high, F.shiftright(low, 1)).otherwise(1).alias("l"), F.when(low <= high, F.shiftright(high, 1)).otherwise(0).alias("r"),
            F.when(left, F.concat(at["head"], block(level, at["l"]))).otherwise(at["head"]).alias("head"),
            F.when(right, F.concat(block(level, at["r"]), at["tail"])).otherwise(at["tail"]).alias("tail"),
        )

    levels = F.sequence(F.lit(0), F.ceil(F.log2((end - start + 2).cast("double"))).cast("int") + 1)
    first = F.struct(start.cast("bigint").alias("l"), end.cast("bigint").alias("r"), none.alias("head"), none.alias("tail"))
    long = F.aggregate(levels, first, step, lambda at: F.concat(at["head"], at["tail"]))
    single = F.transform(F.sequence(start, end), lambda n: F.struct(F.lit(0).alias("level"), n.cast("bigint").alias("i"))).cast(kind)
    return F.when(start > end, none).when(end - start < short, single).otherwise(long)


def gap(n: Column) -> Column:
    """n spaces."""
    return F.repeat(F.lit(" "), n.cast("int"))


def passages(ranges: DataFrame, verses: DataFrame, keys: list[str], id_col: str = "id", short: int = 32) -> DataFrame:
    """The range join: id, passage, found (all numbers exist), size and n_found, for ranges (id, keys,
    verse_start, verse_end) over verses (keys, verse_number, text). The texts are joined by spaces; a missing
    number, or a null text, is empty between two of them.

    A range is cut into blocks (see blocks) and joined to them by equality, so that a long
    one costs as many rows as its length has binary digits, twice. Only blocks that a range has are
    put together, each once, however many ranges have it.
    """
    start, end = F.col("verse_start").cast("bigint"), F.col("verse_end").cast("bigint")
    laid = ranges.select(id_col, *keys, F.explode_outer(blocks(start, end, short)).alias("b")).select(id_col, *keys, "b.level", "b.i")
    by = verses.select(*keys, F.col("verse_number").cast("bigint").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    one = by.select(*keys, F.lit(0).alias("level"), F.col("n").alias("i"), "text", F.lit(1).cast("bigint").alias("found"))
    wanted = laid.filter("level > 0").select(*keys, "level", "i").distinct()
    levels = [r["level"] for r in wanted.select("level").distinct().collect()]  # 63 at most
    made = one
    for level in sorted(levels):
        size = 1 << level
        of = by.select(*keys, F.shiftright("n", level).alias("i"), "n", "text").join(wanted.filter(F.col("level") == level).drop("level"), [*keys, "i"], "left_semi")
        rows = of.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("ts"), F.count("*").alias("found"))
        before = F.concat(F.array(F.col("i") * size), F.transform("ts", lambda t: t["n"]))
        spaced = F.zip_with("ts", F.slice(before, F.lit(1), F.size("ts")), lambda t, b: F.concat(gap(t["n"] - b), t["text"]))
        text = F.concat(F.array_join(spaced, ""), gap((F.col("i") + 1) * size - 1 - F.element_at(before, -1)))
        made = made.unionByName(rows.select(*keys, F.lit(level).alias("level"), "i", text.alias("text"), "found"))
    joined = laid.join(made, [*keys, "level", "i"], "left")
    slots = F.expr("shiftleft(CAST(1 AS BIGINT), level)")
    piece = F.struct((F.col("i") * slots).alias("at"), F.coalesce("text", gap(slots - 1)).alias("text"))
    return joined.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), piece))), lambda x: x["text"]), " ").alias("passage"),
        (F.coalesce(F.sum("found"), F.lit(0)) == F.coalesce(F.sum(slots), F.lit(0))).alias("found"),
        F.coalesce(F.sum(slots), F.lit(0)).alias("size"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("n_found"),
    )


def last_wins(rows: DataFrame, keys: list[str], order: Column, *values: str) -> DataFrame:
    """The row of each key that comes last."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def duplicate_numbers(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Numbers that occur more than once under a key, sorted."""
    many = rows.groupBy(*keys, number).count().filter("count > 1")
    return many.groupBy(*keys).agg(F.array_sort(F.collect_list(number)).alias("duplicates"))


def sequential(rows: DataFrame, keys: list[str], number: str, order: str, most: int = ordered.MOST) -> DataFrame:
    """Whether the numbers, in order, are 1..n: whether each is its place. Nothing is gathered, and
    a key of any size is spread."""
    placed = ordered.place(rows.select(*keys, F.col(number).alias("__number"), F.col(order).alias("__order")), keys, ["__order", "__number"], "__place", most)
    return placed.groupBy(*keys).agg(F.min(F.coalesce(F.col("__number") == F.col("__place"), F.lit(False))).alias("sequential"))


def with_ordinals(rows: DataFrame, keys: list[str], number: str, order: list[str], most: int = ordered.MOST) -> DataFrame:
    """number where it is positive, else the row's place under its key."""
    placed = ordered.place(rows, keys, order, "__place", most)
    return placed.withColumn(number, F.when(F.col(number) > 0, F.col(number)).otherwise(F.col("__place"))).drop("__place")


def reference(given: Column, book: Column, chapter: Column, number: Column) -> Column:
    """The given reference, trimmed, if it isn't blank; else book chapter:number."""
    made = F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), number.cast("string"))
    return F.coalesce(F.nullif(tx.strip(given), F.lit("")), made)


def prepared(book: Column, chapter: Column, default: str) -> tuple[Column, Column]:
    """(book, chapter) as they were typed: the book trimmed and without angle brackets, the default if
    nothing is left before that; the chapter as a number of 1 or more."""
    name = F.coalesce(F.nullif(tx.strip(book), F.lit("")), F.lit(default))
    number = F.coalesce(F.nullif(chapter.try_cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.translate(name, "<>", ""), F.greatest(F.lit(1.0), F.when(F.isnan(number), 1.0).otherwise(number))


def candidates(verses: DataFrame, *keep: str) -> DataFrame:
    """Empty question rows for verses (book, chapter, verse_number, reference_from_api), without text, after the columns to keep."""
    none = F.lit(None).cast("string")
    return verses.select(
        *keep,
        "verse_number",
        reference(F.col("reference_from_api"), F.col("book"), F.col("chapter"), F.col("verse_number")).alias("reference"),
        none.alias("question"),
        F.array().cast("array<string>").alias("options"),
        *[none.alias(c) for c in ("correct_answer", "explanation", "difficulty", "category")],
        F.lit("pending_generation").alias("status"),
        F.lit(False).alias("source_text_persisted"),
    )


def number_of(numbers: Column, references: Column, strict_zero: bool = True) -> Column:
    """A node's number: the first positive one that a number key holds or ends with, else the first
    at the end of a reference.

    With strict_zero a reference that ends with 0 is passed over for the next one;
    otherwise the search ends there without a number.
    """
    direct = F.get(F.array_compact(F.transform(numbers, lambda x: tx.trailing_int(x))), F.lit(0))
    ends = F.filter(F.transform(references, lambda r: tx.trailing_digits(r, needs_separator=True)), lambda x: x != "")
    values = F.transform(ends, lambda x: x.try_cast("bigint"))
    positive = F.filter(values, lambda x: x > 0) if strict_zero else values
    cited = F.get(positive, F.lit(0))
    return F.coalesce(direct, F.when(cited > 0, cited))


def walk(tree: Any) -> Iterator[dict[str, Any]]:
    """All objects of a JSON tree, parents first, in document order."""
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
            stack += list(node.values())[::-1]
        elif isinstance(node, list):
            stack += node[::-1]


def written_out(node: dict[str, Any], keys: tuple[str, ...]) -> list[str]:
    """What the keys hold, as text, in order: whole numbers (true is 1) and texts; nothing else."""
    return [str(int(v)) if isinstance(v, int) else v for k in keys if isinstance(v := node.get(k), int | str)]


def verse_nodes(payload: str) -> list[dict[str, Any]]:
    """The nodes of a payload with a text that isn't blank: text, reference_from_api, and what may number them."""
    out = []
    for node in walk(json.loads(payload)):
        text = node.get("text")
        if isinstance(text, str) and text.strip():
            given = node.get("reference") or node.get("ref")
            cited = [x for k in REFERENCE_KEYS if isinstance(x := node.get(k), str)]
            out.append({"text": text.strip(), "reference_from_api": given if isinstance(given, str) else None, "numbers": written_out(node, NUMBER_KEYS), "references": cited})
    return out


def text_nodes(payload: str) -> tuple[int, int]:
    """Number and characters of all text nodes, blank ones included."""
    found = [n["text"] for n in walk(json.loads(payload)) if isinstance(n.get("text"), str)]
    return len(found), sum(map(len, found))


def count_text_nodes(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """key, nodes and chars: the text nodes of each payload; null and unreadable ones have none."""

    def run(batches):
        for b in batches:
            counts = []
            for p in b.column(1).to_pylist():
                try:
                    counts.append(text_nodes(p) if p is not None else (0, 0))
                except ValueError:
                    counts.append((0, 0))
            nodes, chars = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(chars, pa.int64())], [key, "nodes", "chars"])

    kind = payloads.schema[key].dataType.simpleString()
    return payloads.select(key, payload).mapInArrow(run, f"{key} {kind}, nodes bigint, chars bigint")


NODES = "pos bigint, text string, reference_from_api string, numbers array<string>, references array<string>"


def extract_verses(payloads: DataFrame, key: str, payload: str = "payload", strict_zero: bool = True) -> DataFrame:
    """key, pos, verse_number, text and reference_from_api: a row per verse of each payload; payloads
    that are null or no JSON give none. A verse without a number has its place.

    The tree has no fixed shape and its key order counts, so it is walked in Python, by
    Arrow batches; what a verse's number is, expressions decide.
    """
    names = [x.split()[0] for x in NODES.split(", ")]

    def run(batches):
        strings = pa.list_(pa.string())
        kinds = (pa.int64(), pa.string(), pa.string(), strings, strings)
        for b in batches:
            keys, rows = [], []
            for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = verse_nodes(p) if p is not None else []
                except ValueError:
                    found = []
                keys += [k] * len(found)
                rows += [{"pos": i, **x} for i, x in enumerate(found, 1)]
            columns = [pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *columns], [key, *names])

    kind = payloads.schema[key].dataType.simpleString()
    nodes = payloads.select(key, payload).mapInArrow(run, f"{key} {kind}, {NODES}")
    number = F.coalesce(number_of(F.col("numbers"), F.col("references"), strict_zero), F.col("pos"))
    return nodes.select(key, "pos", number.alias("verse_number"), "text", "reference_from_api")


def succeeded(payload: Column) -> Column:
    """The payload's success flag; true if there is none or it isn't an object."""
    flag = F.get_json_object(payload, "$.success")
    return F.coalesce(flag != "false", F.lit(True))
