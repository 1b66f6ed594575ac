"""Verbatim copies: texts that hold the whole of another text, in normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx

MIN_COPY, ANCHOR = 40, 3
#: Most bytes of anchors for which they are sent to every task.
SMALL = 8 << 20


def verbatim_copies(texts: DataFrame, sources: DataFrame, text_key: str, source_key: str, text: str = "text", source: str = "text") -> DataFrame:
    """(text_key, source_key) where the text holds the source's normal form of MIN_COPY characters or more.

    A substring may begin and end inside a word, but its inner words must be whole
    words of the text. So a source's second to fourth words are its anchor, and texts
    are joined to sources by their word triples; sources of three or four words have
    their longest inner word, and texts their words. A match is then checked as a
    substring. A source of one or two words has a part of at least half its length in
    one word; texts with a word so long are cut at every place into pieces of MIN_COPY
    characters, which are joined to the source's first ones.
    """
    left = texts.select(text_key, tx.normalize_spaces(F.col(text)).alias("__t"))
    right = sources.select(source_key, tx.normalize_spaces(F.col(source)).alias("__s")).filter(F.length("__s") >= MIN_COPY)
    words = F.split("__s", " ")
    inner = F.slice(words, F.lit(2), F.size(words) - 2)
    longest = F.element_at(F.array_sort(F.transform(inner, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), 1)["w"]
    kind = F.when(F.size(words) >= ANCHOR + 2, 0).when(F.size(words) >= ANCHOR, 1).otherwise(2)
    anchor = F.when(kind == 0, F.array_join(F.slice(words, 2, ANCHOR), " ")).when(kind == 1, longest).otherwise(F.substring("__s", 1, MIN_COPY))
    anchored = right.select(source_key, kind.alias("__kind"), F.xxhash64(anchor).alias("__k"))

    def triples(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - ANCHOR + 1))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, ANCHOR), " "))))

    def pieces(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - MIN_COPY + 1))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(t, i, F.lit(MIN_COPY)))))

    long_word = F.exists(F.split("__t", " "), lambda x: F.length(x) >= MIN_COPY // 2)
    made = {
        0: lambda: left.select(text_key, F.explode(tx.let(F.split("__t", " "), triples)).alias("__k")),
        1: lambda: left.select(text_key, F.explode(F.transform(F.array_distinct(F.split("__t", " ")), lambda x: F.xxhash64(x))).alias("__k")),
        2: lambda: left.filter(long_word).select(text_key, F.explode(tx.let(F.col("__t"), pieces)).alias("__k")),
    }
    counts = {r["__kind"]: r["n"] for r in anchored.groupBy("__kind").agg(F.count("*").alias("n")).collect()}  # three rows at most
    pairs = None
    for of, n in sorted(counts.items()):
        mine = anchored.filter(F.col("__kind") == of).select(source_key, "__k")
        # texts meet only those sources whose anchor they hold; the long columns stay out of the first join
        met = made[of]().join(F.broadcast(mine) if n * 24 <= SMALL else mine, "__k").select(text_key, source_key)
        pairs = met if pairs is None else pairs.unionByName(met)
    if pairs is None:
        return texts.select(text_key).join(sources.select(source_key), F.lit(False))
    found = pairs.distinct().join(left, text_key).join(right.select(source_key, "__s"), source_key)
    return found.filter(F.contains("__t", "__s")).select(text_key, source_key).distinct()
