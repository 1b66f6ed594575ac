"""Removal of repeated byte strings by prefix-free parsing.

Every string of WIDTH bytes that also starts earlier in the corpus (in a document
of smaller id, or earlier in the same one) is removed from where it repeats.

Parsing. A trigger is a window of TRIGGER bytes whose rolling hash is the least
(the leftmost of equals) among those inside some string of WIDTH bytes, so each
such string picks exactly one trigger, by its content alone. (Triggers by a
residue of the hash, the usual choice, leave some strings without any.) The bytes
of all strings that pick one trigger are a phrase; phrases overlap, as in
prefix-free parsing, so that every string of WIDTH bytes lies whole in a phrase.

Dictionary. Phrases are compared by hash, in packed blocks by their trigger; of
equal ones the first in corpus order is the dictionary's, all strings of the
others are repeats. Highly repetitive text is thereby settled phrase by phrase.

Corpus order. Strings may also repeat in unequal phrases, at the ends of repeated
passages. Phrases with one trigger but unequal text are cut at the trigger: what
follows it is sorted (the parse's suffix order), what precedes it is sorted from
its end (the dictionary's suffix order), each with the lengths of the common
prefixes of neighbours. A string is a length before and a length after the
trigger; equal strings are those in the same class of both orders at these
lengths, and the first of a class in corpus order stays. This compares bytes, not
hashes. A trigger with over SPREAD distinct phrases, or over LOCAL in one chunk (the
edges of a very common line), is settled string by string instead, by 128-bit hashes,
which deals it over all tasks. A chunk that has over LOCAL of one trigger sends their
strings at once, and for the trigger no more than a mark; so a trigger's block gets at
most LOCAL rows of a chunk, however many documents have it.

Where things are. Texts never pass through a shuffle: the first pass writes them
in chunks to the shared folder, named by their content so that a retried task
writes the same; what is shuffled are packed records of phrases, and per chunk
the places to remove. A task holds one block or one chunk at a time, and sorts the
ones it has; their numbers grow with the corpus, that of tasks only up to TASKS.

Edge cases: null and empty texts have nothing to remove; texts of fewer than
WIDTH bytes are kept whole; rows with the same id and start are no repeats of one
another; a null id comes before all others; repeated rows give equal results;
long texts are parsed in overlapping pieces; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Batches, columns, filesystem, map_batches, rows_from, shared_path, slices, texts, written
from attesta.llm.words import mixed

WIDTH, TRIGGER = 100, 32
CHOICE = WIDTH - TRIGGER + 1
BUFFER = 1 << 20
CHUNK_BYTES = 6 << 20
SPREAD, LOCAL = 128, 16
#: Blocks and chunks beyond this number share tasks, one after another.
TASKS = 20_000
#: Documents of a chunk are numbered by 16 bits.
CHUNK_ROWS = 1 << 16
#: In place of at: the trigger's strings are sent by themselves.
MARK = 255
#: Bytes of text whose phrases make a block, of which a task holds one.
BLOCK_BYTES = 16 << 20
NULL_ID = -(2**63)

PHRASE = np.dtype([("seed", "<u8"), ("phrase", "<u8"), ("lo", "<u4"), ("doc", "<u2"), ("more", "u1"), ("at", "u1")])
PLACE = np.dtype([("doc", "<u2"), ("lo", "<u4"), ("more", "u1")])
ASKED = np.dtype([("seed", "<u8"), ("lo", "<u4"), ("doc", "<u2"), ("more", "u1"), ("at", "u1"), ("spread", "u1")])
PART = np.dtype([("seed", ">u8"), ("id", "<i8"), ("lo", "<u4"), ("doc", "<u2"), ("more", "u1"), ("at", "u1"), ("right", f"S{WIDTH}"), ("left", f"S{CHOICE}")])
STRING = np.dtype([("hash", "<u8"), ("check", "<u8"), ("id", "<i8"), ("lo", "<u4"), ("doc", "<u2")])

_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _tables:
        both = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            column = np.full(BUFFER + 1, np.uint64(base))
            column[0] = 1
            both.append(np.multiply.accumulate(column))
        _tables[0] = (both[0], both[1])
    return _tables[0]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    up, _ = powers()
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def hash_between(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (prefix[hi] - prefix[lo]) * powers()[1][lo]


def parse(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of one buffer of texts, bounds being their ends: (text, lo, hi, trigger, seed,
    phrase); lo and hi are the first and the last start of a string with that trigger."""
    none = np.zeros(0, np.int64)
    if len(raw) < WIDTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    _, down = powers()
    prefix = prefix_hashes(raw)
    n = len(raw) - TRIGGER + 1
    rolling = mixed((prefix[TRIGGER:] - prefix[:n]) * down[:n])
    # the high bits order the windows, the low ones are their place: the leftmost of equals is least
    low = np.uint64(BUFFER - 1)
    least = (rolling & ~low) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= CHOICE:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = CHOICE - span
    least = np.minimum(least[:-rest], least[rest:]) if rest else least
    trigger = (least & low).astype(np.int64)
    sizes = np.diff(np.concatenate(([0], bounds)))
    ends = np.repeat(bounds, sizes)[: len(trigger)]
    start = np.flatnonzero(np.arange(WIDTH, WIDTH + len(trigger)) <= ends)
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    cut = np.flatnonzero(np.diff(trigger[start])) + 1
    lo, hi = start[np.concatenate(([0], cut))], start[np.concatenate((cut - 1, [len(start) - 1]))]
    at = trigger[lo]
    shape = ((hi - lo).astype(np.uint64) << np.uint64(8)) | (at - lo).astype(np.uint64)
    phrase = mixed(hash_between(prefix, lo, hi + WIDTH) ^ mixed(shape))
    return np.searchsorted(bounds, lo, side="right"), lo, hi, at, rolling[at], phrase


def phrases(documents: list[bytes]) -> np.ndarray:
    """The phrases of the texts, in order (PHRASE rows; at: trigger - lo, more: hi - lo)."""
    if len(documents) > CHUNK_ROWS:
        raise ValueError(f"a chunk has {CHUNK_ROWS} documents at most")
    out = []
    i = 0
    while i < len(documents):
        j, size = i, 0
        while j < len(documents) and size + len(documents[j]) < BUFFER - WIDTH:
            size += len(documents[j])
            j += 1
        if j == i:  # one long text: pieces that overlap, each with the strings that start in it
            step = BUFFER - 2 * WIDTH
            pieces = [(documents[i][s : s + step + WIDTH - 1], s) for s in range(0, len(documents[i]), step)]
            j = i + 1
        else:
            pieces = [(b"".join(documents[i:j]), None)]
        for raw, offset in pieces:
            bounds = np.array([len(raw)]) if offset is not None else np.cumsum([len(x) for x in documents[i:j]])
            text, lo, hi, at, seed, phrase = parse(np.frombuffer(raw, np.uint8), bounds)
            rows = np.zeros(len(lo), PHRASE)
            first = np.concatenate(([0], bounds))[text] if len(lo) else lo
            rows["doc"], rows["lo"] = text + i, lo - first + (offset or 0)
            rows["seed"], rows["phrase"], rows["more"], rows["at"] = seed, phrase, hi - lo, at - lo
            out.append(rows)
        i = j
    return np.concatenate(out) if out else np.zeros(0, PHRASE)


def firsts(rank: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys and then rank, first of its keys for each in that order)."""
    order = np.lexsort((rank, *keys[::-1]))
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    if len(new):
        new[0] = True
    return order, order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(new) else order


def chunk_name(folder: str, chunk: int) -> str:
    return f"{folder}/{chunk & (2**64 - 1):016x}.arrow"


def write_chunk(folder: str, ids: pa.Array, documents: list[bytes]) -> int:
    """Store the texts under a name made from them; the same name means the same bytes."""
    digest = hashlib.blake2b(digest_size=8)
    digest.update(str(ids.to_pylist()).encode())
    for x in documents:
        digest.update(b"%d:" % len(x) + x)
    chunk = int.from_bytes(digest.digest(), "little", signed=True)
    fs, base = filesystem(folder)
    name = chunk_name(base, chunk)
    if fs.get_file_info(name).type.name == "NotFound":
        table = pa.table({"id": ids, "text": pa.array(documents, pa.large_binary())})
        part = f"{name}.{hashlib.blake2b(str(id(table)).encode() + np.random.bytes(8)).hexdigest()[:12]}"
        with fs.open_output_stream(part) as sink, ipc.new_file(sink, table.schema, options=ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        fs.move(part, name)
    return chunk


def read_chunk(folder: str, chunk: int) -> tuple[pa.Array, list[bytes]]:
    fs, base = filesystem(folder)
    with fs.open_input_file(chunk_name(base, chunk)) as f:
        table = ipc.open_file(f).read_all().combine_chunks()
    return table.column("id").combine_chunks(), table.column("text").to_pylist()


def known_ids(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


ROWS = "block int, chunk bigint, kind int, ids binary, data binary"
FIELDS = ["block", "chunk", "kind", "ids", "data"]
CHUNK, REMOVE, ASK, PARTS, STRINGS = range(5)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], FIELDS)


def emitted(rows: list[tuple]):
    """Batches of about 8 MB."""
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += len(r[3] or b"") + len(r[4] or b"")
        if held > 8 << 20:
            yield batch_of(some)
            some, held = [], 0
    if some:
        yield batch_of(some)


def cut_up(batch: pa.RecordBatch):
    """Chunks of a batch: of about CHUNK_BYTES of text, and of CHUNK_ROWS rows at most."""
    for at in range(0, batch.num_rows, CHUNK_ROWS):
        yield from slices(batch.slice(at, CHUNK_ROWS), 1, CHUNK_BYTES)


def dealt_out(hashes: np.ndarray, blocks: int):
    """(block, indices) of the blocks that occur."""
    block = (hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True) if len(first) else ():
        yield int(block[a]), order[a:z]


def parsed(docs: DataFrame, folder: str, blocks: int, local: int = LOCAL) -> DataFrame:
    """First pass: chunks are written; phrases that are the first of their chunk go to the
    block of their trigger, the other ones are repeats already."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for b in cut_up(whole):
                order = np.argsort(known_ids(b.column(0)), kind="stable")
                b = b.take(pa.array(order))
                documents = texts(b.column(1))
                chunk = write_chunk(folder, b.column(0), documents)
                ids = known_ids(b.column(0))
                found = phrases(documents)
                place = np.lexsort((found["lo"], ids[found["doc"]]))
                rank = np.empty(len(place), np.int64)
                rank[place] = np.arange(len(place))
                # by phrase alone, as within the corpus: the trigger's hash is part of the phrase
                order, first = firsts(rank, found["phrase"], found["seed"])
                again = (ids[found["doc"][order]] != ids[found["doc"][first]]) | (found["lo"][order] != found["lo"][first])
                out = [(-1, chunk, CHUNK, None, None)]
                places = removed_places(found[order[again]])
                if len(places):
                    out.append((-1, chunk, REMOVE, None, places.tobytes()))
                kept = found[np.sort(order[~again])]
                _, seed, times = np.unique(kept["seed"], return_inverse=True, return_counts=True)
                if (common := times[seed] > local).any():
                    marked = kept[common]
                    start = np.cumsum([0, *map(len, documents)])[marked["doc"]]
                    raw = np.frombuffer(b"".join(documents), np.uint8)
                    out += spread_strings(chunk, marked, start + marked["lo"], marked["more"].astype(np.int64), ids, raw, blocks)
                    marked = marked[np.unique(marked["seed"], return_index=True)[1]]
                    marked["at"] = MARK
                    kept = np.concatenate([kept[~common], marked])
                # a trigger's hash is the least of many, so it is mixed again to be even
                for block, at in dealt_out(mixed(kept["seed"]), blocks):
                    part = kept[at]
                    used, part["doc"] = np.unique(part["doc"], return_inverse=True)
                    table = np.zeros(len(used), [("id", "<i8"), ("doc", "<u2")])
                    table["id"], table["doc"] = ids[used], used
                    out.append((block, chunk, ASK, table.tobytes(), columns(part)))
                yield from emitted(out)

    return map_batches(docs, run, ROWS)


def removed_places(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), PLACE)
    for name in PLACE.names:
        out[name] = rows[name]
    return out


def by_chunk(chunk_of: np.ndarray, chunks: list[int], kind: int, rows: np.ndarray) -> list[tuple]:
    order = np.argsort(chunk_of, kind="stable")
    cuts = np.searchsorted(chunk_of[order], np.arange(len(chunks) + 1))
    return [(-1, chunks[c], kind, None, rows[order[cuts[c] : cuts[c + 1]]].tobytes()) for c in range(len(chunks)) if cuts[c + 1] > cuts[c]]


def streamed(batches: Batches, key: str):
    """(value of key, rows) of each run of rows, the input being sorted by key; rows of no block
    come in pieces, as they belong together in nothing."""
    value, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            if rows and (row[key] != value or (key == "block" and value < 0 and len(rows) >= 64)):
                yield value, rows
                rows = []
            value = row[key]
            rows.append(row)
    if rows:
        yield value, rows


def by_block(rows: DataFrame, blocks: int) -> DataFrame:
    """Each block in one of at most TASKS partitions, sorted; rows of no block are dealt by chunk, to pass through."""
    tasks = min(blocks, TASKS)
    part = F.when(F.col("block") >= 0, F.floor(F.col("block").cast("long") * tasks / blocks)).otherwise(F.pmod("chunk", F.lit(tasks))).cast("int")
    return rows.repartitionById(tasks, part).sortWithinPartitions("block")


def dictionary(blocked: DataFrame, blocks: int, spread: int = SPREAD) -> DataFrame:
    """Of equal phrases the first stays; unequal ones with one trigger are asked for."""

    def run(batches: Batches) -> Batches:
        for block, rows in streamed(batches, "block"):
            if block < 0:
                yield from emitted([tuple(r[f] for f in FIELDS) for r in rows])
                continue
            chunks, parts, ids, chunk_of = [], [], [], []
            later = [tuple(r[f] for f in FIELDS) for r in rows if r["kind"] == STRINGS]
            yield from emitted(later)
            if len(later) == len(rows):
                continue
            for r in rows:
                if r["kind"] == STRINGS:
                    continue
                part = rows_from(r["data"], PHRASE)
                table = np.frombuffer(r["ids"], [("id", "<i8"), ("doc", "<u2")])
                ids.append(table["id"][part["doc"]])
                part["doc"] = table["doc"][part["doc"]]
                chunk_of.append(np.full(len(part), len(chunks)))
                chunks.append(r["chunk"])
                parts.append(part)
            rows = []
            found, ids, chunk_of = np.concatenate(parts), np.concatenate(ids), np.concatenate(chunk_of)
            parts = []
            mark = found["at"] == MARK
            marked = np.unique(found["seed"][mark])
            found, ids, chunk_of = found[~mark], ids[~mark], chunk_of[~mark]
            if len(marked):  # a chunk's only phrase of such a trigger is asked for, too
                to = np.minimum(np.searchsorted(marked, found["seed"]), len(marked) - 1)
                elsewhere = marked[to] == found["seed"]
            else:
                elsewhere = np.zeros(len(found), bool)
            # triggers that occur once are done with
            order = np.argsort(found["seed"], kind="stable")
            seed = found["seed"][order]
            same = seed[1:] == seed[:-1]
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False])) | elsewhere[order]] if len(order) else order
            found, ids, chunk_of, elsewhere = found[order], ids[order], chunk_of[order], elsewhere[order]
            place = np.lexsort((found["lo"], ids))
            rank = np.empty(len(place), np.int64)
            rank[place] = np.arange(len(place))
            order, first = firsts(rank, found["seed"], found["phrase"])
            again = (ids[order] != ids[first]) | (found["lo"][order] != found["lo"][first])
            out = by_chunk(chunk_of[order[again]], chunks, REMOVE, removed_places(found[order[again]]))
            head = order[~again]  # in order of seed; rows that tie with a first one stay, too
            seed = found["seed"][head]
            distinct = first[~again]
            new = np.concatenate(([True], seed[1:] != seed[:-1])) if len(seed) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            step = np.concatenate(([0], (distinct[1:] != distinct[:-1]).astype(np.int64))) if len(seed) else np.zeros(0, np.int64)
            step[new] = 1
            many = np.bincount(group, step, minlength=len(seed)).astype(np.int64)[group] if len(seed) else group
            many[elsewhere[head]] = spread + 1
            wanted = many > 1
            asked = head[wanted]
            rows_out = np.zeros(len(asked), ASKED)
            for name in ("seed", "lo", "doc", "more", "at"):
                rows_out[name] = found[name][asked]
            rows_out["spread"] = many[wanted] > spread
            out += by_chunk(chunk_of[asked], chunks, ASK, rows_out)
            yield from emitted(out)

    return map_batches(by_block(blocked, blocks), run, ROWS)


def answered(asked: DataFrame, folder: str, blocks: int, chunks: int) -> DataFrame:
    """Second pass over the chunks: the text of phrases that are asked for, cut at the
    trigger; or, for triggers that are spread, each string by itself."""

    def run(batches: Batches) -> Batches:
        for chunk, rows in streamed(batches, "chunk"):
            want = np.concatenate([np.frombuffer(r["data"], ASKED) for r in rows])
            ids, documents = read_chunk(folder, chunk)
            known = known_ids(ids)
            out: list[tuple] = []
            sizes = np.array([len(x) for x in documents])
            raw = np.frombuffer(b"".join(documents) + bytes(WIDTH), np.uint8)
            start = (np.cumsum(sizes) - sizes)[want["doc"]]
            lo, at, more = start + want["lo"], want["at"].astype(np.int64), want["more"].astype(np.int64)
            near = want["spread"] == 0
            rows_out = np.zeros(int(near.sum()), PART)
            for name in ("seed", "lo", "doc", "more", "at"):
                rows_out[name] = want[name][near]
            rows_out["id"] = known[want["doc"][near]]
            t, a, m = lo[near] + at[near], at[near], more[near]
            k = np.arange(WIDTH)
            # bytes from the trigger to the end of the last string, and back to the start of the first
            right = np.where(k[None, :] < (WIDTH - (a - m))[:, None], raw[np.minimum(t[:, None] + k, len(raw) - 1)], 0).astype(np.uint8)
            k = np.arange(CHOICE)
            left = np.where(k[None, :] < a[:, None], raw[np.maximum(t[:, None] - 1 - k, 0)], 0).astype(np.uint8)
            rows_out["right"], rows_out["left"] = right.view(f"S{WIDTH}").ravel(), left.view(f"S{CHOICE}").ravel()
            out += [(b, chunk, PARTS, None, rows_out[of].tobytes()) for b, of in dealt_out(mixed(rows_out["seed"].astype(np.uint64)), blocks)]
            if not near.all():
                out += spread_strings(chunk, want[~near], lo[~near], more[~near], known, raw, blocks)
            yield from emitted(out)

    asked = asked.filter(F.col("kind") == ASK)
    return map_batches(asked.repartition(min(chunks, TASKS), "chunk").sortWithinPartitions("chunk"), run, ROWS)


def spread_strings(chunk: int, want: np.ndarray, lo: np.ndarray, more: np.ndarray, known: np.ndarray, raw: np.ndarray, blocks: int) -> list[tuple]:
    """Every string of the phrases by its hash; those seen before in this chunk are repeats."""
    of = np.repeat(np.arange(len(want)), more + 1)
    k = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    rows = np.zeros(len(of), STRING)
    rows["doc"], rows["lo"], rows["id"] = want["doc"][of], want["lo"][of] + k, known[want["doc"][of]]
    start = lo[of] + k
    h = np.zeros(len(of), np.uint64)
    g = np.zeros(len(of), np.uint64)
    for j in range(WIDTH):
        b = raw[start + j].astype(np.uint64) + np.uint64(1)
        h = h * np.uint64(_BASE) + b
        g = (g ^ b) * np.uint64(0x100000001B3)
    rows["hash"], rows["check"] = mixed(h), mixed(g)
    place = np.lexsort((rows["lo"], rows["id"]))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    order, first = firsts(rank, rows["hash"], rows["check"])
    again = (rows["id"][order] != rows["id"][first]) | (rows["lo"][order] != rows["lo"][first])
    out = []
    if again.any():
        out.append((-1, chunk, REMOVE, None, strings_removed(rows[order[again]]).tobytes()))
    rows = rows[order[~again]]
    return out + [(b, chunk, STRINGS, None, rows[of].tobytes()) for b, of in dealt_out(rows["hash"], blocks)]


def strings_removed(rows: np.ndarray) -> np.ndarray:
    """Single strings as places, neighbours joined."""
    rows = rows[np.lexsort((rows["lo"], rows["doc"]))]
    if not len(rows):
        return np.zeros(0, PLACE)
    lo = rows["lo"].astype(np.int64)
    run = np.cumsum(np.concatenate(([True], (rows["doc"][1:] != rows["doc"][:-1]) | (lo[1:] > lo[:-1] + 1)))) - 1
    # a place holds up to 128 starts
    head = np.concatenate(([True], run[1:] != run[:-1]))
    begin = lo[head][run]
    piece = (lo - begin) // 128
    cut = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (piece[1:] != piece[:-1]))))
    last = np.concatenate((cut[1:] - 1, [len(rows) - 1]))
    out = np.zeros(len(cut), PLACE)
    out["doc"], out["lo"], out["more"] = rows["doc"][cut], lo[cut], lo[last] - lo[cut]
    return out


def common(rows: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix of each row of bytes with the one before."""
    out = np.zeros(len(rows), np.int64)
    for s in range(1, len(rows), 1 << 14):
        a, b = rows[s - 1 : s - 1 + (1 << 14)], rows[s : s + (1 << 14)]
        differ = a[: len(b)] != b
        out[s : s + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return out


def ordered(parts: np.ndarray) -> np.ndarray:
    """The strings (PART row, length before the trigger) that repeat an earlier one."""
    n = len(parts)
    seed = np.ascontiguousarray(parts["seed"]).view(np.uint8).reshape(n, 8)
    orders, common_lengths = [], []
    for name, width in (("right", WIDTH), ("left", CHOICE)):
        whole = np.concatenate([seed, np.ascontiguousarray(parts[name]).view(np.uint8).reshape(n, width)], axis=1)
        order = np.argsort(whole.view(f"S{width + 8}").ravel(), kind="stable")
        orders.append(order)
        common_lengths.append(common(whole[order], width + 8) - 8)
    place = np.lexsort((parts["lo"].astype(np.int64) + parts["at"], parts["id"]))
    rank = np.empty(n, np.int64)
    rank[place] = np.arange(n)
    at, more = parts["at"].astype(np.int64), parts["more"].astype(np.int64)
    # rank orders by the trigger's place, which orders the strings of one length before it alike
    moment = np.stack([parts["id"], parts["lo"].astype(np.int64) + at], axis=1)
    out = []
    for before in range(CHOICE):
        here = np.flatnonzero((at >= before) & (at - more <= before))
        if len(here) < 2:
            continue
        classes = []
        for order, shared, length in ((orders[0], common_lengths[0], WIDTH - before), (orders[1], common_lengths[1], before)):
            c = np.empty(n, np.int64)
            c[order] = np.cumsum(shared < length)
            classes.append(c[here])
        order, first = firsts(rank[here], *classes)
        differs = (moment[here[order]] != moment[here[first]]).any(axis=1)
        again = here[order[differs]]
        out.append(np.stack([again, np.full(len(again), before)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def settled(answers: DataFrame, blocks: int) -> DataFrame:
    """Places to remove, from the answers of all chunks."""

    def run(batches: Batches) -> Batches:
        for block, rows in streamed(batches, "block"):
            if block < 0:
                yield from emitted([tuple(r[f] for f in FIELDS) for r in rows])
                continue
            out = []
            for kind, shape in ((PARTS, PART), (STRINGS, STRING)):
                mine = [r for r in rows if r["kind"] == kind]
                if not mine:
                    continue
                some = [np.frombuffer(r["data"], shape) for r in mine]
                chunks = [r["chunk"] for r in mine]
                chunk_of = np.repeat(np.arange(len(chunks)), [len(x) for x in some])
                found = np.concatenate(some)
                if kind == PARTS:
                    repeats = ordered(found)
                    strings = np.zeros(len(repeats), STRING)
                    of = repeats[:, 0]
                    strings["doc"], strings["lo"] = found["doc"][of], found["lo"][of].astype(np.int64) + found["at"][of] - repeats[:, 1]
                    chunk_of = chunk_of[of]
                else:
                    place = np.lexsort((found["lo"], found["id"]))
                    rank = np.empty(len(place), np.int64)
                    rank[place] = np.arange(len(place))
                    order, first = firsts(rank, found["hash"], found["check"])
                    again = order[(found["id"][order] != found["id"][first]) | (found["lo"][order] != found["lo"][first])]
                    strings, chunk_of = found[again], chunk_of[again]
                order = np.argsort(chunk_of, kind="stable")
                cuts = np.searchsorted(chunk_of[order], np.arange(len(chunks) + 1))
                for c in range(len(chunks)):
                    if cuts[c + 1] > cuts[c]:
                        out.append((-1, chunks[c], REMOVE, None, strings_removed(strings[order[cuts[c] : cuts[c + 1]]]).tobytes()))
            yield from emitted(out)

    return map_batches(by_block(answers, blocks), run, ROWS)


def spans_of(size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Maximal removed runs (start, end) of a text from the places' starts and ends."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return np.stack([lo[first], reach[np.concatenate((first[1:] - 1, [len(lo) - 1]))]], axis=1)


RESULT = "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def assembled(places: DataFrame, folder: str, chunks: int) -> DataFrame:
    """Last pass over the chunks: every text without its removed runs."""

    def run(batches: Batches) -> Batches:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for chunk, rows in streamed(batches, "chunk"):
            times = sum(r["kind"] == CHUNK for r in rows)
            data = [np.frombuffer(r["data"], PLACE) for r in rows if r["kind"] == REMOVE]
            rows = []
            found = np.concatenate(data) if data else np.zeros(0, PLACE)
            found = found[np.argsort(found["doc"], kind="stable")]
            ids, documents = read_chunk(folder, chunk)
            cuts = np.searchsorted(found["doc"], np.arange(len(documents) + 1))
            spans, kept = [], []
            for d, text in enumerate(documents):
                mine = found[cuts[d] : cuts[d + 1]]
                if not len(mine):
                    spans.append([])
                    kept.append(text)
                    continue
                lo = mine["lo"].astype(np.int64)
                runs = spans_of(len(text), lo, lo + mine["more"] + WIDTH).tolist()
                spans.append([{"start": a, "end": z} for a, z in runs])
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept.append(b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
            sizes = pa.array([len(x) for x in documents], pa.int64())
            whole = pa.RecordBatch.from_arrays([ids, sizes, pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])
            for _ in range(times):
                yield whole

    dealt = places.filter(F.col("kind").isin(CHUNK, REMOVE)).repartition(min(chunks, TASKS), "chunk").sortWithinPartitions("chunk")
    return map_batches(dealt, run, RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD, local: int = LOCAL) -> DataFrame:
    """id, n_bytes, spans (maximal removed runs, in bytes) and kept (the remaining bytes)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(8, math.ceil(size / BLOCK_BYTES))
    folder = shared_path(spark, "chunks")
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    first = written(dictionary(parsed(docs, folder, blocks, local), blocks, spread), "phrases")
    chunks = max(1, first.filter(F.col("kind") == CHUNK).count())
    answers = answered(first, folder, blocks, chunks).unionByName(first.filter(F.col("kind") == STRINGS))
    second = written(settled(answers, blocks), "places")
    return assembled(first.unionByName(second), folder, chunks)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
