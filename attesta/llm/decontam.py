"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short, documents may be long; what counts is the containment, the
share of an item's shingles that a document holds. Items are partitioned by the
size of their shingle set. The index of a partition holds, for every item, its
bottom-k MinHash sketch: the k smallest shingle hashes with k = size -
ceil(threshold * size) + 1. A document that holds the required share of an item
misses fewer than k of its shingles, so it holds one of any k: sketches sized
like this find every match, which banded MinHash tables would only do with some
probability. A document looks up its shingles in the partitions that are small
enough for it; candidates are verified by exact shingle containment.

An item of fewer words than a shingle counts as its whole sequence of words,
which is looked for among the document's sequences of that length.

The index is broadcast where its size is proven to be at most MAX_INDEX hashes;
beyond that, documents' shingles are joined to the index by a shuffle
(`_by_shuffle`), with the same results. Then a bitmap of FILTER_BITS bits, of a fixed size however
large the index is, keeps shingles that are in no item out of the shuffle; texts never enter it.

Edge cases: null and empty texts match nothing; an item without words is held by
no document; an id with several texts is held if one of them is, and counts once; repeated rows are searched row by row;
an empty benchmark leaves all documents clean; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Batches, map_batches, texts
from attesta.llm.words import _COMBINE, buffers, mixed, word_hashes

N, THRESHOLD = 5, 0.75
#: Hashes of an index that is broadcast: 16 bytes each, 32 MB in all.
MAX_INDEX = 2_000_000
#: Bits of the filter before the shuffle: 16 MB, in pieces of 32,768 bits.
FILTER_BITS, PIECE = 1 << 27, 1 << 15
FOUND = "id bigint, items array<struct<item_id:bigint,shared:bigint,size:bigint>>"
ITEMS = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("size", pa.int64())]))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word sequences, in order; lengths differ in their hashes."""
    total = len(words) - n + 1
    h = np.full(max(0, total), np.uint64(n), np.uint64)
    for k in range(n):
        h = h * np.uint64(_COMBINE) + words[k : total + k] if total > 0 else h
    return mixed(h)


def item_set(text: bytes, n: int = N) -> tuple[int, np.ndarray]:
    """(length of its sequences, their sorted distinct hashes)."""
    words = word_hashes([text])[0]
    n = min(n, len(words))
    return n, np.unique(ngrams(words, n)) if n else np.zeros(0, np.uint64)


def least_shared(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


class Index:
    """Partitions by size; of each, sketch hashes with their item, and the items' whole sets."""

    def __init__(self, items: list[tuple[int, bytes]], n: int = N, threshold: float = THRESHOLD):
        self.sets, self.ids, self.lengths, self.threshold = [], [], [], threshold
        parts: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            length, hashes = item_set(text, n)
            if not length:
                continue
            k = len(hashes) - least_shared(len(hashes), threshold) + 1
            parts.setdefault((length, len(hashes).bit_length()), []).append((hashes[:k], len(self.ids)))
            self.ids.append(item_id)
            self.sets.append(hashes)
            self.lengths.append(length)
        self.parts = []
        for (length, _), rows in sorted(parts.items()):
            keys = np.concatenate([h for h, _ in rows])
            owner = np.concatenate([np.full(len(h), i) for h, i in rows])
            order = np.argsort(keys, kind="stable")
            least = min(least_shared(len(self.sets[i]), threshold) for _, i in rows)
            self.parts.append((length, least, keys[order], owner[order]))

    def search(self, words: np.ndarray) -> list[dict]:
        """Items that the sequence of words holds."""
        hashes: dict[int, np.ndarray] = {}
        found: list[int] = []
        for length, least, keys, owner in self.parts:
            if len(words) - length + 1 < least:
                continue
            if length not in hashes:
                hashes[length] = np.unique(ngrams(words, length))
            mine = hashes[length]
            if len(mine) < len(keys):  # the shorter side is looked up in the longer one
                low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                for a, z in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    found += owner[a:z].tolist()
            else:
                at = np.searchsorted(mine, keys)
                at[at == len(mine)] = 0
                found += owner[mine[at] == keys].tolist()
        out = []
        for i in sorted(set(found)):
            mine, item = hashes[self.lengths[i]], self.sets[i]
            at = np.searchsorted(mine, item)
            at[at == len(mine)] = 0
            shared = int((mine[at] == item).sum())
            if shared >= least_shared(len(item), self.threshold):
                out.append({"item_id": self.ids[i], "shared": shared, "size": len(item)})
        # of the texts of one id, the one that shares most
        best = {x["item_id"]: x for x in sorted(out, key=lambda x: (x["shared"], x["size"]))}
        return sorted(best.values(), key=lambda x: x["item_id"])


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, max_index: int = MAX_INDEX) -> DataFrame:
    """id and the items (item_id, shared, size) held by every document."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).filter(F.col("item_id").isNotNull()).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # an upper bound of the shingles: one for each run of blanks and one more for each item
    bound = items.select(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0)).cast("long").alias("n")).first()["n"]
    if bound > max_index:
        return _by_shuffle(rows, items, threshold)
    index = Index([(r["item_id"], r["text"].encode()) for r in items.orderBy("item_id", "text").collect()], N, threshold)

    def run(batches: Batches) -> Batches:
        for b in batches:
            out: list[list[dict]] = []
            for _, part in buffers(texts(b.column(1))):
                words, counts = word_hashes(part)
                ends = np.cumsum(counts).tolist()
                out += [index.search(words[e - c : e]) for e, c in zip(ends, counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, ITEMS)], ["id", "items"])

    return map_batches(rows, run, FOUND)


def _by_shuffle(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same search for an index of any size: all of it by joins on hashes.

    Rows, and items, are told apart by the digest of their text besides their id."""

    def sets(batches: Batches) -> Batches:
        for b in batches:
            every = [item_set(t) for t in texts(b.column(1))]
            sizes = [len(h) for _, h in every]
            keep = [h[: len(h) - least_shared(len(h), threshold) + 1] if n else h for n, h in every]
            flat = np.concatenate([h for _, h in every]) if every else np.zeros(0, np.uint64)
            sketch = np.concatenate([np.arange(n) < len(k) for n, k in zip(sizes, keep, strict=True)]) if every else np.zeros(0, bool)
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            length = np.repeat([n for n, _ in every], sizes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(owner), b.column(2).take(owner), pa.array(flat.view(np.int64)), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(sketch), pa.array(length, pa.int32())],
                ["item_id", "item_key", "hash", "size", "sketch", "length"],
            )

    index = map_batches(items.select("item_id", "text", F.xxhash64("text").alias("item_key")), sets, "item_id bigint, item_key bigint, hash bigint, size bigint, sketch boolean, length int").distinct()

    lengths = sorted(r["length"] for r in index.select("length").distinct().collect())  # N at most
    place = F.pmod("hash", F.lit(FILTER_BITS)) + 1
    pieces = index.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    known = np.zeros((FILTER_BITS // PIECE, PIECE // 8), np.uint8)
    for r in pieces.collect():  # FILTER_BITS / PIECE rows at most
        known[r["piece"] - 1] = np.frombuffer(r["bits"], np.uint8)
    known = known.reshape(-1)

    def shingles(batches: Batches) -> Batches:
        for b in batches:
            for at, part in buffers(texts(b.column(2))):
                words, counts = word_hashes(part)
                ends = np.cumsum(counts).tolist()
                for i, (e, c) in enumerate(zip(ends, counts.tolist(), strict=True)):
                    h = np.concatenate([np.zeros(0, np.uint64), *(np.unique(ngrams(words[e - c : e], n)) for n in lengths if n)])
                    bit = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    h = h[(known[bit >> 3] >> (bit & 7)) & 1 > 0]
                    for s in range(0, len(h), 1 << 16):
                        some = h[s : s + (1 << 16)]
                        owner = pa.array(np.full(len(some), at + i))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), pa.array(some.view(np.int64))], ["id", "key", "hash"])

    keyed = rows.select("id", F.xxhash64("text").alias("key"), "text")
    mine = map_batches(keyed, shingles, "id bigint, key bigint, hash bigint")
    shared = mine.join(index, "hash").groupBy("id", "key", "item_id", "item_key", "size").agg(F.count("*").alias("counted"), F.max("sketch").alias("candidate"))
    # a row has each hash once; rows that repeat count as often as they do
    repeats = keyed.groupBy(F.col("id").alias("r_id"), F.col("key").alias("r_key")).agg(F.count("*").alias("times")).filter("times > 1")
    same = F.col("id").eqNullSafe(F.col("r_id")) & F.col("key").eqNullSafe(F.col("r_key"))
    shared = shared.join(repeats, same, "left").withColumn("shared", F.expr("counted div coalesce(times, 1)")).drop("r_id", "r_key", "counted", "times")
    held = shared.filter(F.col("candidate") & (F.col("shared") >= F.greatest(F.lit(1), F.ceil(F.round(F.col("size") * threshold, 9)))))
    held = held.groupBy("id", "key", "item_id").agg(F.max(F.struct("shared", "size")).alias("most")).select("id", "key", "item_id", "most.*")
    by_row = held.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("item_id", F.col("shared"), "size"))).alias("items"))
    joined = keyed.select("id", "key").alias("k").join(by_row.alias("f"), F.col("k.id").eqNullSafe(F.col("f.id")) & F.col("k.key").eqNullSafe(F.col("f.key")), "left")
    return joined.select("k.id", F.coalesce("f.items", F.array().cast("array<struct<item_id:bigint,shared:bigint,size:bigint>>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_items, the items' ids joined by commas, contaminated."""
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",").alias("items"),
        (F.size("items") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold a test item; all columns stay."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("item_id").isNotNull()).distinct()
    bound = items.select(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0)).cast("long").alias("n")).first()["n"]
    if bound > MAX_INDEX:
        keyed = docs.select(F.xxhash64(text_col).alias("id"), F.col(text_col).alias("text"))
        bad = _by_shuffle(keyed, items, threshold).filter(F.size("items") > 0).select(F.col("id").alias("bad")).distinct()
        return docs.join(bad, F.xxhash64(docs[text_col]) == bad["bad"], "left_anti")
    index = Index([(r["item_id"], r["text"].encode()) for r in items.orderBy("item_id", "text").collect()], N, threshold)
    place = docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        for b in batches:
            keep: list[bool] = []
            for _, part in buffers(texts(b.column(place))):
                words, counts = word_hashes(part)
                keep += [not index.search(words[e - c : e]) for e, c in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)
