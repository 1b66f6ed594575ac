"""N-gram Jaccard join by universe partition and pigeonhole, verified exactly.

A document is the set of its distinct n-word shingles. Two sets of sizes s and r
reach Jaccard similarity 3/4 only if their symmetric difference is at most
H = floor((s + r) / 7) (in general (1 - t) / (1 + t) of s + r).

Sizes are cut into bands. In the scheme of a band the universe of shingles is
hashed into M segments; a set's share of a segment, if not empty, is one
signature. Sets of the band, and smaller ones that may have partners in it, put
all their signatures in the index. If two sets agree in none of U segments that
are not empty in one of them, they differ in at least U elements; so a pair
within the limit shares a signature if either set has U > H (and shares at least
U - H of them, by which candidates are filtered). Allocation by cost: an exact
segment gives one unit for one signature, its one-deletion neighbourhood a second
unit for as many as it has elements. M is the number that costs a band the fewest
signatures: with few segments many sets fall short of units, with many segments
all have more than they need. A set that falls short indexes the one-deletion
neighbourhoods of its segments, too, and if that is too little, the s - ceil(3/4 s)
+ 1 smallest of its elements, which two such sets within the limit must share.

Signatures are shuffled in packed blocks of a bucket each, the key of a set once a
block; buckets are sorted within a bounded number of tasks. A signature that at most
HOT sets share gives candidate pairs at once. One that more sets share (a common
line, a large group of near copies) gives none; its sets lose that unit. A set that
thereby falls to U <= H is set aside: such sets are compared with the set that most
of their hot signatures have as smallest member. Families (the sets that hot
signatures connect) that are not one component by then are indexed a second time, in
the finest scheme: each element is a segment. There a set has far more units than a
linked one can differ in, so it may lose two thirds of them: only texts made mostly of
common passages are set aside again. They make families in turn, and what is not yet
in the largest component of such a family is compared with the whole of it, in blocks
against a stream, reporting forests of links, never pairs. So no link is lost and no
group is expanded into its pairs.

Equal sets are one node throughout, named by a 63-bit digest of the set.

Edge cases: null, empty and blank texts have empty sets and are linked with
nothing; a text of fewer than n words is one shingle, its whole sequence; rows
with equal ids are separate rows; a null id keeps its row and names a component
only if no other id is in it; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Batches, columns, dropped, fresh, join_small, map_batches, rows_from, texts, written
from attesta.llm.components import components
from attesta.llm.embed_join import forest
from attesta.llm.words import mixed, shingle_sets

N, THRESHOLD = 5, Fraction(3, 4)
HOT = 32
BAND = 2.0
BUCKET_SIGNATURES, BLOCK = 1_000_000, 256
#: Buckets beyond this number share tasks, one after another.
TASKS = 20_000
PREFIX_SCHEME, FINEST = 63, 62
#: The lowest bits of a signature tell its scheme.
SCHEMES = np.uint64(63)
#: A set in a block: its name, its size in steps of an eighth of the limit, and its signatures (255: goes on in the next row).
MEMBER = np.dtype([("key", "<i8"), ("size", "<u2"), ("count", "u1")])
#: What is known of a set in a scheme; sent once.
INFO = np.dtype([("key", "<i8"), ("scheme", "<i4"), ("n", "<i8"), ("units", "<i8"), ("spare", "<i8")])


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1


def band_edges() -> np.ndarray:
    edges = [1, 2, 3]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return np.array(edges)


EDGES = band_edges()


def limit(a: int, b: int, t: Fraction) -> int:
    """The largest symmetric difference of sets of sizes a and b that are linked."""
    return math.floor((1 - t) / (1 + t) * (a + b))


def linked(shared: int, a: int, b: int, t: Fraction) -> bool:
    return t.denominator * shared >= t.numerator * (a + b - shared)


@lru_cache(maxsize=4096)
def segments_of(low: int, top: int, t: Fraction) -> int:
    """Segments of the band of sizes low to top: the number that costs the fewest signatures."""
    shares = {math.ceil(top * f / 100) for f in range(20, 100)}
    return min(sorted(shares | set(range(1, min(2 * top, 40) + 1))), key=lambda m: expected_signatures(m, low, top, t))


def expected_signatures(m: int, low: int, top: int, t: Fraction) -> float:
    """Signatures of a set, on average over the sizes of a band: one for each of m segments that is
    not empty, and one for each element where those are too few (about normally distributed) and
    the neighbourhoods are needed, too."""
    sizes = sorted({low + (top - low) * i // 8 for i in range(9)})
    total = 0.0
    for n in sizes:
        empty = (1 - 1 / m) ** n
        mean = m * (1 - empty)
        spread = m * empty * (1 - empty) + (m * (m - 1) * ((1 - 2 / m) ** n - empty * empty) if m > 1 else 0)
        most = limit(n, min(math.floor(n / t), top), t)
        short = 0.5 * math.erfc((mean - most - 0.5) / math.sqrt(2 * max(spread, 1e-9)))
        total += mean + short * n
    return total / len(sizes)


def signatures(s: np.ndarray, t: Fraction) -> list[tuple[int, int, int, np.ndarray]]:
    """(scheme, units, spare units, signatures) of one set, in its own scheme and in the next
    one if it may have partners there.

    A segment that is not empty costs one signature for one unit. A set that has no unit to
    spare that way buys a second one for each segment of two elements or more, by the
    segment's one-deletion neighbourhood; and if that is too little, indexes single elements.
    """
    n = len(s)
    band = int(np.searchsorted(EDGES, n, side="right")) - 1
    out, short = [], False
    for scheme in (band, band + 1):
        low, top = int(EDGES[scheme]), int(EDGES[scheme + 1]) - 1
        if scheme > band and n < t * low:
            continue
        m = segments_of(low, top, t)
        segment = (s >> np.uint64(20)) % np.uint64(m)
        order = np.argsort(segment, kind="stable")
        segment = segment[order]
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        salt = np.uint64((scheme * 0x9E3779B97F4A7C15) % 2**64)
        # a segment's signature is made from the sum of its elements' hashes, so that of a
        # neighbour is the sum without one of them
        element = mixed(s[order] ^ salt)
        total, place = np.add.reduceat(element, first), mixed(segment[first] + salt)
        found = mixed(total ^ place)
        most = limit(n, min(math.floor(n / t), top), t)
        spare = len(found) - most
        if spare < 1:
            size = np.diff(np.append(first, n))
            of = np.repeat(np.arange(len(first)), size)
            deep = (size > 1)[of]
            near = mixed((total[of] - element) ^ place[of])[deep]
            short |= len(first) + int((size > 1).sum()) - most < 1
            out.append((scheme, len(found), spare, np.concatenate([found, near])))
        else:
            out.append((scheme, len(found), spare, found))
    if short:
        keep = n - math.ceil(t * n) + 1
        out.append((PREFIX_SCHEME, 0, 0, mixed(s[:keep] ^ np.uint64(0xD6E8FEB86659FD93))))
    return [(scheme, units, spare, (found & ~SCHEMES) | np.uint64(scheme)) for scheme, units, spare, found in out]


def single_elements(s: np.ndarray, t: Fraction) -> list[tuple[int, int, int, np.ndarray]]:
    """signatures() in the finest scheme."""
    n = len(s)
    found = mixed(s ^ np.uint64(0xA24BAED4963EE407))
    return [(FINEST, n, n - limit(n, math.floor(n / t), t), (found & ~SCHEMES) | np.uint64(FINEST))]


def size_step(n: int, t: Fraction) -> int:
    """Sizes of linked sets are at most 9 steps apart."""
    return int(math.log(n) * 8 / -math.log(t))


def node_sets(docs: DataFrame, n: int) -> DataFrame:
    """id, digest (of the text), n_shingles and node (null for an empty set) of every row."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            sets = list(shingle_sets(texts(b.column(2)), n))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())],
                ["id", "digest", "n_shingles", "node"],
            )

    rows = docs.select("id", F.xxhash64("text").alias("digest"), "text")
    return map_batches(rows, run, "id bigint, digest bigint, n_shingles bigint, node bigint")


def sets_of_texts(n: int):
    def read(batch: pa.RecordBatch):
        for s in shingle_sets(texts(batch.column(0)), n):
            if len(s):
                yield set_key(s), s

    return read


def sets_of_nodes(batch: pa.RecordBatch):
    for node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield node, np.frombuffer(raw, np.uint64)


def indexed(rows: DataFrame, read, sign, t: Fraction, buckets: int, tasks: int) -> DataFrame:
    """Blocks of signatures: task, bucket, members (packed, column by column), signatures (six
    bytes each); and in bucket -1 what is known of the sets."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            seen: set[int] = set()
            known: list[tuple] = []
            steps: list[int] = []
            signed: list[np.ndarray] = []
            for key, s in read(b):
                if key in seen:
                    continue
                seen.add(key)
                for scheme, units, spare, found in sign(s, t):
                    known.append((key, scheme, len(s), units, spare))
                    steps.append(size_step(len(s), t))
                    signed.append(found)
            if not known:
                continue
            info = np.array(known, INFO)
            sigs = np.concatenate(signed)
            owner = np.repeat(np.arange(len(info)), [len(x) for x in signed])
            bucket = ((sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            bucket, owner, sigs = bucket[order], owner[order], sigs[order]
            packed = sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            # runs of one set in one bucket, of 255 at most
            run_of = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]))))
            size = np.diff(np.append(run_of, len(owner)))
            pieces = -(-size // 255)
            place = np.repeat(run_of, pieces)
            nth = np.arange(len(place)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            count = np.minimum(255, np.repeat(size, pieces) - 255 * nth)
            key, step = info["key"][owner[place]], np.array(steps, "<u2")[owner[place]]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            cuts = np.append(first, len(bucket)).tolist()
            member_cuts = np.searchsorted(bucket[place], np.append(bucket[first], np.uint64(buckets))).tolist()
            rows: tuple[list, list, list, list] = ([int(info["key"][0]) % tasks], [-1], [info.tobytes()], [None])
            for i, k in enumerate(bucket[first].tolist()):
                x, z = member_cuts[i], member_cuts[i + 1]
                part = np.empty(z - x, MEMBER)
                part["key"], part["size"], part["count"] = key[x:z], step[x:z], count[x:z]
                rows[0].append(k * tasks // buckets)
                rows[1].append(k)
                rows[2].append(columns(part))
                rows[3].append(packed[cuts[i] : cuts[i + 1]].tobytes())
            for at in range(0, len(rows[0]), 1 << 14):
                some = [r[at : at + (1 << 14)] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), pa.array(some[1], pa.int32()), pa.array(some[2], pa.binary()), pa.array(some[3], pa.binary())], ["task", "bucket", "members", "sigs"])

    return map_batches(rows, run, "task int, bucket int, members binary, sigs binary")


#: kind 0: a and b share so many signatures of a scheme; 1: a is in so many hot ones whose smallest
#: member is b; 2: what is known of a (shared: its size).
CANDIDATES = "kind int, a bigint, b bigint, scheme int, shared bigint, units bigint, spare bigint"
NAMES = [x.split()[0] for x in CANDIDATES.split(", ")]


def counted(kind: int, a: np.ndarray, b: np.ndarray, scheme: np.ndarray) -> pa.RecordBatch:
    """(a, b, scheme) with how often they occur."""
    order = np.lexsort((scheme, b, a))
    a, b, scheme = a[order], b[order], scheme[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (scheme[1:] != scheme[:-1])))) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(a))).astype(np.int64)
    none = pa.nulls(len(new), pa.int64())
    kinds = pa.array(np.full(len(new), kind, np.int32))
    return pa.RecordBatch.from_arrays([kinds, pa.array(a[new]), pa.array(b[new]), pa.array(scheme[new].astype(np.int32)), pa.array(count), none, none], NAMES)


def met(members: np.ndarray, sigs: np.ndarray) -> list[pa.RecordBatch]:
    """Candidate pairs with their number of shared signatures, and memberships in hot signatures."""
    owner = np.repeat(np.arange(len(members)), members["count"])
    order = np.argsort(sigs, kind="stable")
    sigs, owner = sigs[order], owner[order]
    first = np.concatenate(([True], sigs[1:] != sigs[:-1]))
    more = ~(first & np.concatenate((first[1:], [True])))
    sigs, owner = sigs[more], owner[more]
    order = np.lexsort((members["key"][owner], sigs))
    sigs, owner = sigs[order], owner[order]
    key = members["key"][owner]
    if len(sigs):  # the same set from several batches
        new = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (key[1:] != key[:-1])))
        sigs, owner, key = sigs[new], owner[new], key[new]
    step, scheme = members["size"][owner].astype(np.int64), (sigs & SCHEMES).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1]))) if len(sigs) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(sigs)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(2, HOT + 1):
        rows = start[size == k]
        if len(rows):
            i, j = np.triu_indices(k, 1)
            i, j = (rows[:, None] + i[None, :]).ravel(), (rows[:, None] + j[None, :]).ravel()
            near = np.abs(step[i] - step[j]) <= 9
            left.append(i[near])
            right.append(j[near])
    i, j = np.concatenate(left), np.concatenate(right)
    # keys are sorted within a signature, so a < b always
    pairs = counted(0, key[i], key[j], scheme[i])
    # of a hot signature, each member's smallest fellow; members are summed up by that
    hot = np.repeat(size > HOT, size)
    return [pairs, counted(1, key[hot], key[np.repeat(start, size)[hot]], scheme[hot])]


def meet(blocks: DataFrame, tasks: int) -> DataFrame:
    """Candidates and hot members of all buckets; a bucket is what is held at once."""

    def run(batches: Batches) -> Batches:
        bucket, members, sigs = None, [], []

        def flush():
            if members:
                packed = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, 6)
                wide = np.zeros((len(packed), 8), np.uint8)
                wide[:, :6] = packed
                for out in met(np.concatenate(members), wide.view("<u8").ravel()):
                    for at in range(0, out.num_rows, 1 << 16):
                        yield out.slice(at, 1 << 16)

        for b in batches:
            for k, m, s in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                if k < 0:
                    x = np.frombuffer(m, INFO)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), 2, np.int32)), pa.array(x["key"]), pa.nulls(len(x), pa.int64()), *(pa.array(np.ascontiguousarray(x[f])) for f in ("scheme", "n", "units", "spare"))], NAMES
                    )
                    continue
                if k != bucket:
                    yield from flush()
                    bucket, members, sigs = k, [], []
                members.append(rows_from(m, MEMBER))
                sigs.append(s)
        yield from flush()

    dealt = blocks.repartitionById(tasks, F.col("task")).sortWithinPartitions("bucket")
    return map_batches(dealt, run, CANDIDATES)


def needed_sets(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(node, elements) for the needed (node, rep): the set made again from one row's text."""
    rows = docs.select(F.coalesce("id", F.lit(-(2**63))).alias("rep"), "text").join(needed, "rep")

    def run(batches: Batches) -> Batches:
        for b in batches:
            node, packed = [], []
            for want, s in zip(b.column(1).to_pylist(), shingle_sets(texts(b.column(0)), n), strict=True):
                if len(s) and set_key(s) == want:
                    node.append(want)
                    packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(packed, pa.binary())], ["node", "elements"])

    return map_batches(rows.select("text", "node"), run, "node bigint, elements binary")


def compared(dealt: DataFrame, t: Fraction) -> DataFrame:
    """Links between the sets of role 0 and all later ones of the same task: rows (place,
    part, role, node, elements), sorted; the former are held, the latter stream past."""

    def run(batches: Batches) -> Batches:
        place, held, tokens, owner, sizes = None, [], None, None, None
        left: list[int] = []
        right: list[int] = []

        def out():
            a, b = forest(np.array(left, np.int64), np.array(right, np.int64))
            left.clear()
            right.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for p, part, role, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if (p, part) != place:
                    place, held, tokens = (p, part), [], None
                if role == 0:
                    held.append((node, s))
                    continue
                if not held:
                    continue
                if tokens is None:
                    sizes = np.array([len(x) for _, x in held])
                    tokens = np.concatenate([x for _, x in held])
                    owner = np.repeat(np.arange(len(held)), sizes)
                    order = np.argsort(tokens, kind="stable")
                    tokens, owner = tokens[order], owner[order]
                lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
                many = hi - lo
                lo, many = lo[many > 0], many[many > 0]
                at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
                shared = np.bincount(owner[at], minlength=len(held))
                for k in np.flatnonzero(shared * t.denominator >= t.numerator * (sizes + len(s) - shared)).tolist():
                    if held[k][0] != node:
                        left.append(held[k][0])
                        right.append(node)
                if len(left) >= 1 << 16:
                    yield out()
        if left:
            yield out()

    return map_batches(dealt.select("place", "part", "role", "node", "elements"), run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that are linked. A node is dealt over tasks by its number of partners."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("parts"))
    salted = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    held = salted.select("a", "part").distinct().join(sets, F.col("a") == F.col("node"))
    stream = salted.join(sets, F.col("b") == F.col("node"))
    rows = held.select(F.col("a").alias("place"), "part", F.lit(0).alias("role"), "node", "elements").unionByName(
        stream.select(F.col("a").alias("place"), "part", F.lit(1).alias("role"), "node", "elements")
    )
    return compared(rows.repartition("place", "part").sortWithinPartitions("place", "part", "role"), t)


def family_links(aside: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Links of the sets set aside (node, family, label) with those of their family that have
    another label: all but the family's largest label are held in blocks, the family streams past."""
    by_label = aside.groupBy("family", "label").agg(F.count("*").alias("n"))
    largest = by_label.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), (F.sum("n") - F.max("n")).alias("rest"))
    marked = join_small(aside, largest.filter("rest > 0"), "family").withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rest") / BLOCK)).cast("int"))
    base = marked.filter("label <> largest").select(
        F.col("family").alias("place"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"), "node"
    )
    stream = marked.select(F.col("family").alias("place"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "node")
    rows = base.unionByName(stream).join(sets, "node")
    return compared(rows.repartition("place", "part").sortWithinPartitions("place", "part", "role"), t)


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: Fraction = THRESHOLD) -> DataFrame:
    """id, n_shingles and component (the smallest id reachable by links) of every row; also
    digest (of the text) and root (a name of the component, null for an empty set)."""
    t = Fraction(threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(node_sets(docs, n), "sets")
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    pairs, low, star = candidates(docs.select("text"), sets_of_texts(n), signatures, t, total * 0.7)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(low).distinct()
    classes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    needed = classes.join(nodes, "node").select("node", F.coalesce("least", F.lit(-(2**63))).alias("rep"))
    sets = written(needed_sets(docs, needed, n), "elements")
    links = written(verified(pairs, sets, t), "verified")
    dropped(pairs)
    named = components(links)
    if not low.isEmpty() and (more := _links_aside(low, star, named, sets, t)) is not None:
        named = components(more.unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    dropped(sets, low, star)
    by_node = classes.join(named, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    by_root = by_node.groupBy("root").agg(F.min("least").alias("component"))
    by_node = by_node.join(by_root, "root").select("node", "root", "component")
    out = ("id", "digest", "root", "n_shingles", "component")
    empty = rows.filter("node IS NULL").select("id", "digest", F.lit(None).cast("long").alias("root"), "n_shingles", F.col("id").alias("component"))
    return rows.filter("node IS NOT NULL").join(by_node, "node").select(*out).unionByName(empty)


def candidates(rows: DataFrame, read, sign, t: Fraction, expected: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the sets that read() finds in rows: candidate pairs (a, b), among them those of sets set
    aside with their centres; the sets set aside (node); and their memberships (node, centre).
    expected: about how many signatures there will be."""
    buckets = max(8, math.ceil(expected / BUCKET_SIGNATURES))
    tasks = min(buckets, TASKS)
    found = written(meet(indexed(rows, read, sign, t, buckets, tasks), tasks), "candidates")
    hot = found.filter("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("centre"), "scheme", "shared")
    known = found.filter("kind = 2").groupBy(F.col("a").alias("node"), "scheme").agg(F.max("shared").alias("n"), F.max("units").alias("units"), F.max("spare").alias("spare"))
    known = known.join(hot.groupBy("node", "scheme").agg(F.sum("shared").alias("lost")), ["node", "scheme"], "left")
    known = written(known, "known")
    low = written(known.filter("lost >= spare").select("node").distinct(), "aside")
    star = hot.groupBy("node", "centre").agg(F.sum("shared").alias("n")).join(low, "node").filter(F.col("node") != F.col("centre"))
    star = written(star, "stars")
    modal = star.groupBy("node").agg(F.max_by("centre", F.struct("n", "centre")).alias("centre"))

    pairs = found.filter("kind = 0").groupBy("a", "b", "scheme").agg(F.sum("shared").alias("shared"))
    left = F.col("units") - F.coalesce("lost", F.lit(0))
    share = 1 - 2 * t / (1 + t)  # of both sizes: the largest symmetric difference of linked sets
    most = F.floor((F.col("n_a") + F.col("n_b")) * share.numerator / share.denominator + 1e-9)
    pairs = (
        pairs.join(known.select(F.col("node").alias("a"), "scheme", F.col("n").alias("n_a"), left.alias("left_a")), ["a", "scheme"])
        .join(known.select(F.col("node").alias("b"), "scheme", F.col("n").alias("n_b"), left.alias("left_b")), ["b", "scheme"])
        .filter(F.least("n_a", "n_b") * t.denominator >= F.greatest("n_a", "n_b") * t.numerator)
        .filter(F.col("shared") >= F.greatest("left_a", "left_b") - most)
        .select("a", "b")
    )
    pairs = written(pairs.unionByName(modal.select(F.col("centre").alias("a"), F.col("node").alias("b"))).distinct(), "pairs")
    dropped(found, known)
    return pairs, low, star


def _links_aside(low: DataFrame, star: DataFrame, named: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame | None:
    """Links between sets that were set aside (low), beyond the components (named) that links to
    their centres make; None where there can be none."""
    rest = _in_parts(low, star, named)
    if rest.isEmpty():
        return None
    mine = written(sets.join(rest, "node").select("node", "elements"), "elements")
    size = mine.agg(F.sum(F.octet_length("elements") / 8)).first()[0]
    pairs, low, star = candidates(mine, sets_of_nodes, single_elements, t, size)
    more = written(verified(pairs, mine, t), "verified")
    dropped(pairs)
    if low.isEmpty():
        return more
    named = components(more.unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    stuck = _in_parts(low, star, named)
    if stuck.isEmpty():
        return more
    family = components(star.join(stuck, "node").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    marked = stuck.join(family, "node", "left").select("node", F.coalesce("component", "node").alias("family"))
    marked = marked.join(named, "node", "left").select("node", "family", F.coalesce("component", "node").alias("label"))
    return more.unionByName(written(family_links(marked, mine, t), "family"))


def _in_parts(low: DataFrame, star: DataFrame, named: DataFrame) -> DataFrame:
    """The sets of those groups (of a hot signature's smallest member) that are in several components.
    A missing link is one of two sets that are set aside and share a hot signature."""
    label = F.coalesce("component", "node").alias("label")
    group = star.select("node", "centre").unionByName(star.select(F.col("centre").alias("node"), "centre").distinct().join(low, "node"))
    group = group.join(named, "node", "left").select("node", "centre", label)
    several = group.groupBy("centre").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("centre")
    return written(join_small(group, several, "centre").select("node").distinct(), "parts")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest id, null ids last; of
    rows with that id the first by text digest, and of equal ones the least as a struct of
    all columns. Rows without words are in no component and stay."""
    names = docs.columns
    key, mark, row = fresh(names, "__id", "__digest", "__row")
    linked = link_documents(docs, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("digest"))
    kept = linked.filter("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("k")).select("k.id", "k.digest")
    keys = kept.select(F.coalesce("id", F.lit(-(2**63))).alias(key), F.col("digest").alias(mark)).distinct()
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.filter(worded).withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), mark: F.xxhash64(text_col)})
    found = keyed.join(keys, [key, mark]).groupBy(key, mark).agg(F.min(F.struct(*names)).alias(row)).select(f"{row}.*")
    return found.unionByName(docs.filter(~worded))


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
