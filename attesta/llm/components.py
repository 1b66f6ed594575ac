"""Connected components of a graph of links, by alternating large and small stars.

Each round is an aggregate to the smallest neighbour and a join back over one
shuffle by node; no neighbourhood is ever gathered. A node with over a thousandth
of all link ends (there are fewer than a thousand such nodes) gets its smallest
neighbour by a broadcast, so that its links stay where they are. A round's result is
written to the shared folder, which cuts the lineage. The graph shrinks to stars
whose centres are the smallest ids in a number of rounds that grows like the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import dropped, written

COMMON = 1000


def _state(edges: DataFrame) -> tuple[int, int]:
    """(number of links, a digest of all)."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def with_least(rows: DataFrame, most: int) -> DataFrame:
    """(u, v, m): m is the smallest v of u. Nodes in more than `most` rows are aggregated apart and
    joined by a broadcast; with over a thousandth of all rows each, they are fewer than a thousand."""
    common = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).filter(F.col("n") > most).select("u", "m").collect()
    hubs = F.broadcast(rows.sparkSession.createDataFrame(common, "u bigint, m bigint")) if common else None
    dealt = (rows.join(hubs, "u", "left_anti") if common else rows).repartition("u")
    found = dealt.join(dealt.groupBy("u").agg(F.min("v").alias("m")), "u")
    return found.unionByName(rows.join(hubs, "u")) if common else found


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Null ends, loops, repeated and mirrored links are allowed and change nothing.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    edges = written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links")
    state = _state(edges)
    while state[0]:
        most = max(1, 2 * state[0] // COMMON)
        # large star: each node's larger neighbours are linked to its smallest one
        both = with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), most)
        large = both.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # small star: each node and its smaller neighbours are linked to the smallest of them
        dealt = large.repartition("u")
        small = dealt.join(dealt.groupBy("u").agg(F.min("v").alias("m")), "u")
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = small.select(F.explode(ends).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        last, edges = edges, written(small, "links")
        dropped(last)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
