"""Exact metric range join of vectors: pivots, boundary replication, independent cells.

The metric is the angle between vectors; a cosine of at least `threshold` is an
angle of at most r. Equal vectors are one row first (with their number), so copies
cost nothing below. Pivots are vectors chosen by a hash, about one for BLOCK vectors,
in two levels: the first ones head groups, every other one is in the group of the
nearest head. A vector belongs to the group of its nearest head, and there to the
cell of its nearest pivot. By the triangle inequality it can only have a partner in
another group if its angle to that head is at most the group's radius plus r, and at
most its angle to its own head plus 2 r; and in a cell of such a group likewise, by
the angles to the cell's pivot and to the group's nearest pivot. It is replicated
there, each pair of cells meeting in the cell with the smaller number only. A cell's
vectors are dealt into blocks of about BLOCK rows; a block is held in memory while
all rows replicated to it stream past in batches, so memory does not depend on
the size of a cell.

Vectors travel as packed numbers of their own precision and are normalised where they
are compared. Products are taken in single precision with a margin and those near or above the
threshold again in double precision, so no link is lost or invented. A block
reports counts and a spanning forest of the links it found, never the pairs.

The number of cells grows with the vectors up to MAX_PIVOTS, which bounds what is
broadcast. Where the vectors have no clusters (as random ones in many dimensions) the
triangle inequality spares little and the join is a blocked comparison of all rows,
which is then what exactness costs.

Edge cases: null vectors, null or non-finite components, zero vectors and empty
arrays link with nothing and are their own component; vectors of different
length never link; repeated ids are separate rows that count as vectors of
their own, also with different vectors; a null id counts as a vector and names a
component only if no other id is in it; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from attesta.llm.common import Batches, map_batches, written
from attesta.llm.components import components

THRESHOLD = 0.95
#: Pivots go to every task: so many at most, and of so many bytes.
BLOCK, MAX_PIVOTS, PIVOT_BYTES = 8192, 16_384, 8 << 20
#: Blocks beyond this number share tasks, one after another.
TASKS = 20_000
#: Single precision errs by less than this in a product of unit vectors.
MARGIN = 1e-4
STREAM = 1024
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def unpacked(vectors: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors, in double precision, from packed ones of one length."""
    rows = vectors.to_pylist()
    return unit(np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64))


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id and v: the vector's numbers one after another, null where it is not fit."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(size)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            full = np.concatenate(([0], np.cumsum(values != 0)))
            fit = (bad[ends] == bad[ends - size]) & (full[ends] > full[ends - size])
            out = [values[z - n : z].tobytes() if ok else None for z, n, ok in zip(ends.tolist(), size.tolist(), fit.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    return map_batches(rows, run, "vec_id bigint, v binary")


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ids left and right: every id but the
    smallest of its component, and that smallest id."""
    nodes, both = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = both[: len(left)], both[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:  # pointers jump to their roots
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    single = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    rows = packed(given, kind)
    # copies of a vector are one class; written, so that its number stays the same
    grouped = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = classes.groupBy(F.octet_length("v").alias("size")).agg(F.count("*").alias("n")).collect()
    counted = None
    for size in sizes:  # vectors of different length never link; one length is the rule
        most = max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * size["size"] // int(kind[-1]))))
        part = _link_classes(classes.filter(F.octet_length("v") == size["size"]), kind, size["n"], threshold, block, most)
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        counted = spark.createDataFrame([], "node bigint, links bigint, root bigint")
    found = written(counted, "found")
    named = components(found.filter("root IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.filter("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    key = F.unhex(F.sha2("v", 256)).alias("key")
    by_class = classes.select("node", "least", "copies", key).join(links, "node", "left").join(named, "node", "left").withColumn("root", F.coalesce("component", "node"))
    by_root = by_class.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = by_class.join(by_root, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    fit = rows.filter("v IS NOT NULL").select("vec_id", key).join(by_class, "key").select("vec_id", "n_links", "component_id")
    rest = rows.filter("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fit.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _link_classes(classes: DataFrame, kind: str, n: int, threshold: float, block: int, most: int) -> DataFrame:
    """node, links (a count in one block) or root (a link of a block's forest)."""
    r = math.acos(min(1.0, max(-1.0, threshold)))
    k = max(1, min(most, math.ceil(n / block)))
    chosen = classes.orderBy(F.xxhash64("v"), "node").limit(k).select("v").toArrow().column("v").combine_chunks()
    pivots = unpacked(chosen, kind)  # at most MAX_PIVOTS rows and PIVOT_BYTES: bounded
    heads = pivots[: math.isqrt(len(pivots) - 1) + 1]
    group_of = angles(pivots, heads).argmin(axis=1)
    groups = [np.flatnonzero(group_of == g) for g in range(len(heads))]

    def assign(batches: Batches) -> Batches:
        for b in batches:
            x = unpacked(b.column("v"), kind)
            to_heads = angles(x, heads)
            group = to_heads.argmin(axis=1)
            cell, angle = np.zeros(len(x), np.int32), np.zeros(len(x))
            for g in np.unique(group).tolist():
                mine = np.flatnonzero(group == g)
                t = angles(x[mine], pivots[groups[g]])
                cell[mine], angle[mine] = groups[g][t.argmin(axis=1)], t.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("copies"), b.column("v"), pa.array(cell), pa.array(angle), pa.array(to_heads.min(axis=1))],
                ["node", "copies", "v", "cell", "angle", "outer"],
            )

    placed = written(map_batches(classes.select("node", "copies", "v"), assign, "node bigint, copies bigint, v binary, cell int, angle double, outer double"), "cells")
    cells = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.max("outer").alias("outer"), F.count("*").alias("n")).collect()
    radius, outer, parts = np.full(len(pivots), -10.0), np.full(len(heads), -10.0), np.zeros(len(pivots), np.int64)
    for row in cells:
        radius[row["cell"]], parts[row["cell"]] = row["radius"], math.ceil(row["n"] / block)
        outer[group_of[row["cell"]]] = max(outer[group_of[row["cell"]]], row["outer"])
    first = np.cumsum(parts) - parts
    total = max(1, int(parts.sum()))
    tasks = min(total, TASKS)

    def near_cells(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells with a smaller number than its own that a row may have partners in."""
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        to_heads = angles(x, heads)
        close = (to_heads <= outer[None, :] + r + SLACK) & (to_heads <= to_heads.min(axis=1)[:, None] + 2 * r + SLACK)
        for g, members in enumerate(groups):
            mine = np.flatnonzero(close[:, g])
            if not len(mine) or not len(members):
                continue
            t = angles(x[mine], pivots[members])
            near = (t <= radius[members][None, :] + r + SLACK) & (t <= t.min(axis=1)[:, None] + 2 * r + SLACK) & (own[mine][:, None] > members[None, :])
            i, j = np.nonzero(near)
            rows.append(mine[i])
            found.append(members[j])
        return np.concatenate(rows), np.concatenate(found)

    def replicate(batches: Batches) -> Batches:
        """A row to its own block, to those of its cell before it, and to all blocks of near cells."""
        for b in batches:
            x, own, mine = unpacked(b.column("v"), kind), b.column("cell").to_numpy(), b.column("node").to_numpy()
            home = (((mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.maximum(parts[own], 1).astype(np.uint64)).astype(np.int64)
            every = np.arange(len(x))
            other, cell = near_cells(x, own)
            # (row, its place's first block, number of blocks)
            row, start, many = np.concatenate([every, other]), np.concatenate([first[own], first[cell]]), np.concatenate([home, parts[cell]])
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row = np.concatenate([every, np.repeat(row, many)])
            place = np.concatenate([first[own] + home, np.repeat(start, many) + nth])
            role = np.concatenate([np.zeros(len(x), np.int32), np.ones(len(nth), np.int32)])
            for s in range(0, len(row), STREAM * 8):
                take, to = pa.array(row[s : s + STREAM * 8]), place[s : s + STREAM * 8]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((to * tasks // total).astype(np.int32)), pa.array(to), pa.array(role[s : s + STREAM * 8]),
                        b.column("node").take(take), b.column("copies").take(take), b.column("v").take(take),
                    ],
                    ["task", "place", "role", "node", "copies", "v"],
                )

    def compare(batches: Batches) -> Batches:
        held_place = None
        base: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            place, role = b.column("place").to_numpy(), b.column("role").to_numpy()
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(role) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
                if a == z:
                    continue
                x = unpacked(b.column("v").slice(a, z - a), kind)
                rows = (b.column("node").to_numpy()[a:z], b.column("copies").to_numpy()[a:z], x, x.astype(np.float32))
                if held_place != place[a]:
                    held_place, base = place[a], []
                for held in base:
                    yield from linked(held, rows, False)
                if role[a] == 0:
                    yield from linked(rows, rows, True)
                    base.append(rows)

    def linked(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], same: bool) -> Batches:
        (rep_a, copies_a, x_a, f_a), (rep_b, copies_b, x_b, f_b) = left, right
        for s in range(0, len(rep_b), STREAM):
            i, j = np.nonzero(f_a @ f_b[s : s + STREAM].T >= threshold - MARGIN)
            j = j + s
            if same:
                i, j = i[i < j], j[i < j]
            sure = np.zeros(len(i), bool)
            for c in range(0, len(i), 1 << 15):
                cut = slice(c, c + (1 << 15))
                sure[cut] = np.einsum("ij,ij->i", x_a[i[cut]], x_b[j[cut]]) >= threshold
            i, j = i[sure], j[sure]
            if not len(i):
                continue
            ids = np.concatenate([rep_a, rep_b])
            count = np.concatenate([np.bincount(i, copies_b[j], len(rep_a)), np.bincount(j, copies_a[i], len(rep_b))]).astype(np.int64)
            some = np.flatnonzero(count)
            node, root = forest(rep_a[i], rep_b[j])
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.nulls(len(some), pa.int64())], ["node", "links", "root"])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(root)], ["node", "links", "root"])

    sent = map_batches(placed, replicate, "task int, place bigint, role int, node bigint, copies bigint, v binary")
    dealt = sent.repartitionById(tasks, F.col("task")).sortWithinPartitions("place", "role")
    return map_batches(dealt, compare, "node bigint, links bigint, root bigint")
