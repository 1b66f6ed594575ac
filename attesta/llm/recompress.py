"""Removal of repeated word sequences by recompression.

A window is WIDTH consecutive words of one document. Every word covered by a window whose
words also start anywhere else (in any row, same document included) is removed; all
copies go, and windows are judged on the input.

Rounds. The symbols of round 0 are the words. A round first gives each maximal run of one
symbol a name of its own, then each pair of neighbours of which the first has a 0 and the
second a 1 at this round's bit of their names. A name is a digest of what it stands for
(symbol and count, or both symbols), so all tasks name alike, without a dictionary that
they would have to exchange, and equal sequences get equal symbols everywhere, but for some
at their ends: what a run or a pair at the edge becomes depends on words outside. `anchors`
follows, for every window at once, which symbols of each round are decided by the words of
the window alone. Of those of the last round that has any, the longest symbol (of equals
that with the least name, and the leftmost) is the window's anchor, so that equal
windows have equal anchors at equal places.

Revealing. Neighbouring windows with one anchor are a phrase. Phrases are dealt by the
name of their anchor, in packed blocks. A phrase that occurs twice or more is repeated
with all its windows, and a long repeat is settled by as many rows as it has anchors. An
anchor that occurs once, or only in phrases that are all repeated, is done with.

Verifying. Where unequal phrases share an anchor, each of their windows is compared with
all others by 128 bits made from the names of its words, and dealt by these, so that an
anchor in very many places is spread. One row stands for all occurrences of a
phrase, as long as it is marked as repeated. A chunk with over LOCAL unequal phrases of one
anchor sends their windows at once, and for the anchor no more than a mark: its block
gets at most LOCAL rows of a chunk, however many documents have it.

Where things are: as in suffix_dedup. Texts never pass through a shuffle: they are written
once, in chunks that are named by their content, and read again where phrases are asked for
and where the result is put together. A task holds one block or one chunk at a time.

Edge cases: null and blank texts have no words; texts of fewer than WIDTH words stay whole
(with one space between words); repeated rows, also those with equal ids or none, are
documents of their own, and so repeat each other; long texts are parsed in overlapping
pieces and long words named by a digest; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Batches, columns, filesystem, map_batches, rows_from, shared_path, texts, written
from attesta.llm.suffix_dedup import (
    ASK, BLOCK_BYTES, CHUNK, FIELDS, MARK, REMOVE, ROWS, STRINGS, TASKS,
    by_block, by_chunk, cut_up, dealt_out, emitted, read_chunk, streamed, write_chunk,
)
from attesta.llm.words import BLANK, mixed, powers

WIDTH, ROUNDS, LOCAL = 35, 3, 4
#: Words that are parsed at once, and bytes that are cut into words at once.
PIECE, BUFFER = 1 << 17, 2 << 20
#: Longer words are named by a digest of their own.
LONG_WORD = 4096

PHRASE = np.dtype([("seed", "<u8"), ("phrase", "<u8"), ("lo", "<u4"), ("doc", "<u2"), ("more", "u1"), ("many", "u1")])
PLACE = np.dtype([("doc", "<u2"), ("lo", "<u4"), ("more", "u1"), ("many", "u1")])
WINDOW = np.dtype([("hash", "<u8"), ("check", "<u8"), ("lo", "<u4"), ("doc", "<u2"), ("many", "u1")])
_RUN, _PAIR, _FIRST, _SECOND = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93


def edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    inside = np.concatenate(([False], ~BLANK[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def names_of(raw: np.ndarray) -> np.ndarray:
    """A name for each word of a buffer, made from its bytes."""
    start, end = edges(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    long = np.flatnonzero(size > LONG_WORD)
    short = np.where(size > LONG_WORD, 1, size)
    first = np.cumsum(short) - short
    place = np.arange(int(short.sum())) - np.repeat(first, short)
    values = raw[np.repeat(start, short) + place].astype(np.uint64) + np.uint64(1)
    values *= powers(int(short.max()))[place]
    names = mixed(np.add.reduceat(values, first))
    for i in long.tolist():
        names[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return names


def buffers(documents: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of runs of texts of about BUFFER bytes; a longer text comes in
    parts that end at white space, each under its index."""
    at = held = 0
    for i, text in enumerate(documents):
        if held and held + len(text) > BUFFER:
            yield at, documents[at:i]
            at, held = i, 0
        held += len(text) + 1
        if len(text) > BUFFER:
            begin = 0
            while begin < len(text):
                end = min(len(text), begin + BUFFER)
                while end < len(text) and not BLANK[text[end]]:
                    blank = np.flatnonzero(BLANK[np.frombuffer(text, np.uint8, min(BUFFER, len(text) - end), end)])
                    end += int(blank[0]) if len(blank) else min(BUFFER, len(text) - end)
                yield i, [text[begin:end]]
                begin = end
            at, held = i + 1, 0
    if at < len(documents):
        yield at, documents[at:]


def named(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(names of the words of all texts, number of words of each text)."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(documents), np.int64)
    for at, part in buffers(documents):
        raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        found.append(names_of(raw))
        ends = np.searchsorted(edges(raw)[0], np.cumsum([len(x) + 1 for x in part]))
        counts[at : at + len(part)] += np.diff(np.concatenate(([0], ends)))
    return np.concatenate(found), counts


def next_round(sym: np.ndarray, first: np.ndarray, size: np.ndarray, r: int) -> tuple[np.ndarray, ...]:
    """The symbols of the next round (name, first word, number of words), and how to get there: the
    run of each old symbol, the new symbol of each run, and the bit of each run."""
    head = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1])))
    run = np.zeros(len(sym), np.int32)
    run[head[1:]] = 1
    run = np.cumsum(run, dtype=np.int32)
    times = np.diff(np.append(head, len(sym)))
    name, first, size = sym[head], first[head], size[head] * times
    long = times > 1
    name[long] = mixed(name[long] * np.uint64(_RUN) + times[long].astype(np.uint64))
    bit = ((name >> np.uint64(3 + 7 * r)) & np.uint64(1)).astype(np.int32)
    second = np.zeros(len(name), bool)
    second[1:] = bit[1:] > bit[:-1]
    pair = np.cumsum(~second, dtype=np.int32) - 1
    stay = np.flatnonzero(~second)
    of = np.flatnonzero(second)
    new, size = name[stay], np.add.reduceat(size, stay)
    new[pair[of]] = mixed(name[of - 1] * np.uint64(_PAIR) + name[of])
    return new, first[stay], size, run, pair, bit


def least(sym: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The index of the longest symbol in each range lo to hi; of equals that of least name, the leftmost."""
    low = np.uint64((1 << 20) - 1)
    key = (np.uint64(63) - np.minimum(size, 63).astype(np.uint64)) << np.uint64(58)
    key |= ((sym >> np.uint64(26)) << np.uint64(20)) | np.arange(len(sym), dtype=np.uint64)
    depth = np.frexp(hi - lo)[1] - 1  # the largest power of two within
    table = np.full((int(depth.max()) + 1, len(key)), np.iinfo(np.uint64).max, np.uint64)
    table[0] = key
    for k in range(1, len(table)):
        half = 1 << (k - 1)
        np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, :-half])
    return (np.minimum(table[depth, lo], table[depth, hi - (1 << depth)]) & low).astype(np.int64)


def anchors(names: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(name, first word) of the anchor of every window of the sequence."""
    m = len(names) - width + 1
    anchor, place = np.zeros(m, np.uint64), np.zeros(m, np.int64)
    live = np.arange(m)
    lo, hi = live.copy(), live + width  # the symbols of this round that a window decides
    sym, first, size = names, np.arange(len(names)), np.ones(len(names), np.int64)
    for r in range(rounds + 1):
        on = np.zeros(len(live), bool)
        if r < rounds:
            new, new_first, new_size, run, pair, bit = next_round(sym, first, size, r)
            # the runs at the edges may go on outside; then the first may be a pair's second, the last its first
            a, z = run[lo] + 1, run[hi - 1]
            inner = np.flatnonzero(a < z)
            a, z = a[inner], z[inner]
            a, z = a + bit[a], z - 1 + bit[z - 1]
            some = a < z
            on[inner[some]] = True
        over = ~on
        if over.any():
            at = least(sym, size, lo[over], hi[over])
            anchor[live[over]], place[live[over]] = sym[at], first[at]
        if not on.any():
            break
        live, lo, hi = live[on], pair[a[some]], pair[z[some] - 1] + 1
        sym, first, size = new, new_first, new_size
    return anchor, place


def phrases(names: np.ndarray, counts: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> np.ndarray:
    """The phrases of a chunk (PHRASE rows; lo and more: its windows' starts in the document)."""
    out = [np.zeros(0, PHRASE)]
    ends = np.cumsum(counts)
    up, _ = weights()
    for begin in range(0, len(names) - width + 1, PIECE):
        some = names[begin : begin + PIECE + width - 1]
        doc = np.searchsorted(ends, np.arange(begin, begin + len(some) - width + 1), side="right")
        fits = np.flatnonzero(np.arange(begin + width, begin + len(some) + 1) <= ends[doc])
        if not len(fits):
            continue
        anchor, place = anchors(some, width, rounds)
        own, at = anchor[fits], place[fits]  # symbols of several rounds may begin at one place
        new = np.concatenate(([True], (np.diff(fits) > 1) | (at[1:] != at[:-1]) | (own[1:] != own[:-1])))
        at = np.flatnonzero(new)
        lo, hi = fits[at], fits[np.append(at[1:], len(fits)) - 1]
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(some * up[: len(some)])))
        shape = ((hi - lo).astype(np.uint64) << np.uint64(16)) | (place[lo] - lo).astype(np.uint64)
        rows = np.zeros(len(lo), PHRASE)
        rows["seed"] = anchor[lo]
        rows["phrase"] = mixed((prefix[hi + width] - prefix[lo]) * weights()[1][lo] ^ mixed(shape))
        rows["doc"], rows["more"] = doc[lo], hi - lo
        rows["lo"] = begin + lo - (ends - counts)[doc[lo]]
        out.append(rows)
    return np.concatenate(out)


_weights: list[np.ndarray] = []


def weights() -> list[np.ndarray]:
    """Powers of a number and of its inverse modulo 2**64, for a piece."""
    if not _weights:
        for base in (_FIRST, pow(_FIRST, -1, 2**64)):
            column = np.full(PIECE + 256, np.uint64(base))
            column[0] = 1
            _weights.append(np.multiply.accumulate(column))
    return _weights


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys, number of each one's group in that order)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


def heads(group: np.ndarray) -> np.ndarray:
    """The first place of each group."""
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else group


def places(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), PLACE)
    for name in PLACE.names:
        out[name] = rows[name] if name in rows.dtype.names else 0
    return out


def windows(names: np.ndarray, begin: np.ndarray, want: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the wanted phrases (begin: their first words among names). Those that occur
    again among them are returned as places to remove, and once to be compared elsewhere."""
    times = want["more"].astype(np.int64) + 1
    of = np.repeat(np.arange(len(want)), times)
    k = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    rows = np.zeros(len(of), WINDOW)
    rows["doc"], rows["lo"], rows["many"] = want["doc"][of], want["lo"][of] + k, want["many"][of]
    start = begin[of] + k
    h, g = np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64)
    for j in range(width):
        w = names[start + j]
        h = h * np.uint64(_FIRST) + w
        g = (g ^ w) * np.uint64(_SECOND)
        g ^= g >> np.uint64(32)
    rows["hash"], rows["check"] = mixed(h), mixed(g)
    order, group = groups(rows["hash"], rows["check"])
    rows, head = rows[order], heads(group)
    total = np.add.reduceat(rows["many"].astype(np.int64) + 1, head) if len(head) else head
    gone = rows[(total[group] > 1) & (rows["many"] == 0)] if len(rows) else rows
    rows = rows[head]
    rows["many"] = total > 1
    return joined(gone), rows


def joined(rows: np.ndarray) -> np.ndarray:
    """Single windows as places, neighbours in one."""
    rows = rows[np.lexsort((rows["lo"], rows["doc"]))]
    lo, doc = rows["lo"].astype(np.int64), rows["doc"].astype(np.int64)
    run = np.cumsum(np.concatenate((np.zeros(min(1, len(lo)), bool), (np.diff(doc) != 0) | (np.diff(lo) > 1))))
    head = heads(run)
    piece = (lo - lo[head][run]) // 200 if len(lo) else lo
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(run) != 0) | (np.diff(piece) != 0)))) if len(lo) else lo
    last = np.append(cut[1:], len(lo))[: len(cut)] - 1
    out = np.zeros(len(cut), PLACE)
    out["doc"], out["lo"], out["more"] = doc[cut], lo[cut], lo[last] - lo[cut]
    return out


def parsed(docs: DataFrame, folder: str, blocks: int, width: int, rounds: int, local: int) -> DataFrame:
    """First pass: chunks are written; of each phrase one row goes to the block of its anchor."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for b in cut_up(whole):
                documents = texts(b.column(1))
                chunk = write_chunk(folder, b.column(0), documents)
                names, counts = named(documents)
                found = phrases(names, counts, width, rounds)
                order, group = groups(found["seed"], found["phrase"])
                found, head = found[order], heads(group)
                times = np.diff(np.append(head, len(found)))
                out: list[tuple] = [(-1, chunk, CHUNK, None, None)]
                if (times > 1).any():
                    out.append((-1, chunk, REMOVE, None, places(found[times[group] > 1]).tobytes()))
                kept = found[head]
                kept["many"] = times > 1
                new = heads(kept["seed"])
                distinct = np.repeat(np.diff(np.append(new, len(kept))), np.diff(np.append(new, len(kept)))) if len(kept) else new
                common = distinct > local
                if common.any():
                    some = kept[common]
                    begin = (np.cumsum(counts) - counts)[some["doc"]] + some["lo"]
                    gone, rows = windows(names, begin, some, width)
                    if len(gone):
                        out.append((-1, chunk, REMOVE, None, gone.tobytes()))
                    out += [(block, chunk, STRINGS, None, rows[at].tobytes()) for block, at in dealt_out(rows["hash"], blocks)]
                    marks = some[heads(some["seed"])]
                    marks["many"] = MARK
                    kept = np.concatenate((kept[~common], marks))
                # the anchor is a least name among several, so it is mixed again to be even
                out += [(block, chunk, ASK, None, columns(kept[at])) for block, at in dealt_out(mixed(kept["seed"].astype(np.uint64)), blocks)]
                yield from emitted(out)

    return map_batches(docs, run, ROWS)


def dictionary(blocked: DataFrame, blocks: int) -> DataFrame:
    """Phrases that occur again are repeated; the unequal ones of an anchor are asked for."""

    def run(batches: Batches) -> Batches:
        for block, rows in streamed(batches, "block"):
            if block < 0:
                yield from emitted([tuple(r[f] for f in FIELDS) for r in rows])
                continue
            yield from emitted([tuple(r[f] for f in FIELDS) for r in rows if r["kind"] == STRINGS])
            parts = [rows_from(r["data"], PHRASE) for r in rows if r["kind"] == ASK]
            chunks = [r["chunk"] for r in rows if r["kind"] == ASK]
            rows = []
            if not parts:
                continue
            found, chunk_of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            parts = []
            mark = found["many"] == MARK
            marked = np.unique(found["seed"][mark])
            found, chunk_of = found[~mark], chunk_of[~mark]
            order, group = groups(found["seed"], found["phrase"])
            found, chunk_of, head = found[order], chunk_of[order], heads(group)
            if not len(found):
                continue
            total = np.add.reduceat(found["many"].astype(np.int64) + 1, head)
            again = (total[group] > 1) & (found["many"] == 0)
            out = by_chunk(chunk_of[again], chunks, REMOVE, places(found[again]))
            # one phrase stands for all equal ones; an anchor is open if a phrase of it is single and not its only one
            found, chunk_of = found[head], chunk_of[head]
            found["many"] = total > 1
            new = heads(found["seed"])
            of = np.cumsum(np.concatenate(([0], (found["seed"][1:] != found["seed"][:-1]).astype(np.int64))))
            several = np.diff(np.append(new, len(found)))[of] > 1
            single = np.add.reduceat((total == 1).astype(np.int64), new)[of] > 0
            asked = (several & single) | np.isin(found["seed"], marked)
            out += by_chunk(chunk_of[asked], chunks, ASK, places(found[asked]))
            yield from emitted(out)

    return map_batches(by_block(blocked, blocks), run, ROWS)


def answered(asked: DataFrame, folder: str, blocks: int, chunks: int, width: int) -> DataFrame:
    """Second pass over the chunks: the windows of the phrases that are asked for."""

    def run(batches: Batches) -> Batches:
        for chunk, rows in streamed(batches, "chunk"):
            want = np.concatenate([np.frombuffer(r["data"], PLACE) for r in rows])
            _, documents = read_chunk(folder, chunk)
            used, doc = np.unique(want["doc"], return_inverse=True)
            names, counts = named([documents[i] for i in used.tolist()])
            gone, found = windows(names, (np.cumsum(counts) - counts)[doc] + want["lo"], want, width)
            out = [(-1, chunk, REMOVE, None, gone.tobytes())] if len(gone) else []
            yield from emitted(out + [(block, chunk, STRINGS, None, found[at].tobytes()) for block, at in dealt_out(found["hash"], blocks)])

    asked = asked.filter(F.col("kind") == ASK)
    return map_batches(asked.repartition(min(chunks, TASKS), "chunk").sortWithinPartitions("chunk"), run, ROWS)


def settled(answers: DataFrame, blocks: int) -> DataFrame:
    """The windows that occur again, as places to remove."""

    def run(batches: Batches) -> Batches:
        for block, rows in streamed(batches, "block"):
            if block < 0:
                yield from emitted([tuple(r[f] for f in FIELDS) for r in rows])
                continue
            parts, chunks = [np.frombuffer(r["data"], WINDOW) for r in rows], [r["chunk"] for r in rows]
            rows = []
            found, chunk_of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            parts = []
            order, group = groups(found["hash"], found["check"])
            found, chunk_of = found[order], chunk_of[order]
            total = np.add.reduceat(found["many"].astype(np.int64) + 1, heads(group))
            again = (total[group] > 1) & (found["many"] == 0)
            found, chunk_of = found[again], chunk_of[again]
            order = np.argsort(chunk_of, kind="stable")
            cuts = np.searchsorted(chunk_of[order], np.arange(len(chunks) + 1)).tolist()
            yield from emitted([(-1, c, REMOVE, None, joined(found[order[a:z]]).tobytes()) for c, a, z in zip(chunks, cuts, cuts[1:], strict=False) if z > a])

    return map_batches(by_block(answers, blocks), run, ROWS)


RESULT = "id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string"


def without(text: bytes, gone: np.ndarray) -> tuple[int, list[dict], bytes]:
    """(number of words, removed runs of words, the other words joined by a space) of a text."""
    raw = np.frombuffer(text + b" ", np.uint8).copy()
    start, end = edges(raw)
    step = np.zeros(len(start) + 1, np.int64)
    lo = gone["lo"].astype(np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, gone["end"], -1)
    removed = np.cumsum(step)[:-1] > 0
    turn = np.flatnonzero(np.diff(np.concatenate(([False], removed, [False])).astype(np.int8)))
    spans = [{"start": a, "end": z} for a, z in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
    raw[end] = 32  # the white space after each word, of which one byte stays
    step = np.zeros(len(raw) + 1, np.int8)
    step[start[~removed]] += 1
    step[end[~removed] + 1] -= 1
    return len(start), spans, raw[np.cumsum(step[:-1], dtype=np.int8) > 0][:-1].tobytes()


def assembled(rows: DataFrame, folder: str, chunks: int, width: int) -> DataFrame:
    """Last pass over the chunks: every text without its repeated words."""

    def run(batches: Batches) -> Batches:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kind = np.dtype([("lo", "<i8"), ("end", "<i8")])
        for chunk, rows in streamed(batches, "chunk"):
            times = sum(r["kind"] == CHUNK for r in rows)
            data = [np.frombuffer(r["data"], PLACE) for r in rows if r["kind"] == REMOVE]
            rows = []
            found = np.concatenate([np.zeros(0, PLACE), *data])
            found = found[np.argsort(found["doc"], kind="stable")]
            gone = np.zeros(len(found), kind)
            gone["lo"] = found["lo"]
            gone["end"] = gone["lo"] + found["more"] + width
            ids, documents = read_chunk(folder, chunk)
            cuts = np.searchsorted(found["doc"], np.arange(len(documents) + 1)).tolist()
            out = [without(text, gone[a:z]) for text, a, z in zip(documents, cuts, cuts[1:], strict=False)]
            columns_ = [ids, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], span), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())]
            whole = pa.RecordBatch.from_arrays(columns_, ["id", "n_words", "spans", "kept"])
            for _ in range(times):
                yield whole

    dealt = rows.filter(F.col("kind").isin(CHUNK, REMOVE)).repartition(min(chunks, TASKS), "chunk").sortWithinPartitions("chunk")
    return map_batches(dealt, run, RESULT)


def remove_repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, rounds: int = ROUNDS, local: int = LOCAL
) -> DataFrame:
    """A row per document: id, n_words, spans (maximal removed runs of words) and kept (the other words,
    joined by a space)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(8, math.ceil(size / BLOCK_BYTES))
    folder = shared_path(spark, "chunks")
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    first = written(dictionary(parsed(docs, folder, blocks, width, rounds, local), blocks), "phrases")
    chunks = max(1, first.filter(F.col("kind") == CHUNK).count())
    answers = answered(first, folder, blocks, chunks, width).unionByName(first.filter(F.col("kind") == STRINGS))
    second = written(settled(answers, blocks), "places")
    return assembled(first.unionByName(second), folder, chunks, width)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
