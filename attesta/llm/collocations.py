"""Phrases whose words belong together, mined from all texts of a language.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and these into
words. A candidate is a phrase of two to four words that occurs at least `least` times.
It is as good as its worst cut: with l and r the occurrences of the parts before and
after it, a cut scores floor(2000000 * a / (l + r)). Candidates that are mostly a part of
one longer candidate go, and the first `top` of each language are reported.

Encoding. The first pass writes each chunk of texts to the shared folder as numbers of its
own words, and sends every different word once, with its count, to the word's block. Blocks
add up exactly, by the words' bytes, and answer with a number for each word that occurs
often enough (a phrase is never more frequent than its words); all others end a piece, too.
So the dictionary is never in one place: a chunk learns the numbers of its own words only.

Counting. The numbers of two, three or four neighbours are packed into a key of fixed width
(32 bits a word; 64 if there are more words than that). A chunk sorts its keys by a radix
sort and sends each different one with its count to the range that the key lies in. The
first 64 bits of a key are scrambled by a bijection first, so ranges of equal width hold about equally
many keys, without a sample, and what starts with a common word is spread over all. A range is sorted by the same
radix sort, runs of equal keys are added up, and each chunk is told by one bit a key which of its keys are
frequent. Only where two frequent phrases overlap a longer one is looked for, so each
step carries less than the one before. A very common phrase is one row a chunk.

Scoring is done by joins and aggregates over the frequent phrases. All products are exact (decimals).

Edge cases: a null text is empty; a null language is `und`; an empty table has no phrases;
repeated rows count as often as they occur; ties of score and count are ordered by the
phrase's bytes; whole texts are read, long ones in parts that end at white space; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.common import Batches, filesystem, join_small, map_batches, shared_path, texts, written
from attesta.llm.recompress import buffers, heads, names_of
from attesta.llm.suffix_dedup import BLOCK_BYTES, FIELDS, ROWS, TASKS, by_block, cut_up, emitted, read_chunk, streamed, write_chunk
from attesta.llm.words import mixed

LEAST, SHARE, TOP, LONGEST, SCALE = 30, 80, 2000, 4, 2_000_000
#: Parts in which the first phrases of a language are looked for.
SPREAD = 64
UNKNOWN = "und"
#: A-Z become lower case, ends of pieces a full stop, tabs spaces.
FOLD = bytes.maketrans(bytes([*range(65, 91), *b",;:!?", *range(10, 14), 9]), bytes([*range(97, 123), *b"." * 9, 32]))
CHUNK, WORDS, IDS, FREQUENT, TOTAL, KEYS, BITS, GRAMS = range(8)
_SALT = 0x9E3779B97F4A7C15


def unmixed(h: np.ndarray) -> np.ndarray:
    """The inverse of mixed()."""
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9)):
        h = h ^ (h >> np.uint64(shift)) ^ (h >> np.uint64(2 * shift))
        h = h * np.uint64(pow(factor, -1, 2**64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def salted(rest: list[np.ndarray]) -> np.ndarray:
    h = np.uint64(0)
    for c in rest:
        h = mixed(c + np.uint64(_SALT) + h)
    return h


def pack(ids: list[np.ndarray], wide: bool) -> list[np.ndarray]:
    """The numbers of the words of phrases as columns of 64 bits, the first one scrambled."""
    cols = list(ids) if wide else [(a << np.uint64(32)) | b for a, b in zip(ids[::2], [*ids[1::2], np.zeros_like(ids[0])], strict=False)]
    return [mixed(cols[0] ^ salted(cols[1:])), *cols[1:]]


def unpack(cols: list[np.ndarray], n: int, wide: bool) -> list[np.ndarray]:
    cols = [unmixed(cols[0]) ^ salted(cols[1:]), *cols[1:]]
    return cols if wide else [x for c in cols for x in (c >> np.uint64(32), c & np.uint64(2**32 - 1))][:n]


def width(n: int, wide: bool) -> int:
    """Columns of a key of n words."""
    return n if wide else (n + 1) // 2


def radix_order(cols: list[np.ndarray]) -> np.ndarray:
    """The order of keys, 16 bits at a time from the last ones (numpy sorts these by radix)."""
    order = np.arange(len(cols[0]))
    for c in reversed(cols):
        for shift in range(0, 64, 16):
            digit = ((c >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order of keys, number of each one's run in that order)."""
    order = radix_order(cols)
    new = np.zeros(len(order), np.int64)
    for c in cols:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.cumsum(new)


def numbered(documents: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(the words of the texts as numbers from 1 on, with 0 where a piece ends; the words)."""
    index = {b".": 0}
    out, last = [np.zeros(1, np.int32)], -1
    for at, part in buffers(documents):
        words = b".".join(part).translate(FOLD).replace(b".", b" . ").split()
        if at != last:  # the next part of a long text goes on where the last one ends
            out.append(np.zeros(1, np.int32))
        number = index.setdefault
        out.append(np.fromiter((number(w, len(index)) for w in words), np.int32, len(words)))
        last = at + len(part) - 1
    return np.concatenate(out), list(index)[1:]


def strings(words: list[bytes]) -> tuple[bytes, bytes]:
    """(lengths, bytes) of words."""
    return np.fromiter(map(len, words), "<u4", len(words)).tobytes(), b"".join(words)


def blocks_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def encoded(docs: DataFrame, folder: str, blocks: int) -> DataFrame:
    """First pass: chunks as numbers of their own words; each different word goes to its block."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for b in cut_up(whole):
                langs, documents = b.column(0).to_pylist(), texts(b.column(1))
                numbers, rows, begin, digest = [], [], 1, []
                for lang in sorted(set(langs)):
                    ids, words = numbered([t for x, t in zip(langs, documents, strict=True) if x == lang])
                    if not words:
                        continue
                    counts = np.bincount(ids, minlength=len(words) + 1)[1:]
                    block = blocks_of(names_of(np.frombuffer(b" ".join(words), np.uint8)), blocks)
                    order = np.argsort(block, kind="stable")  # words of one block are numbered one after another
                    number = np.zeros(len(words) + 1, np.int32)
                    number[1 + order] = np.arange(begin, begin + len(words))
                    numbers.append(number[ids])
                    block, words = block[order], [words[i] for i in order.tolist()]
                    cuts = [*heads(block).tolist(), len(block)]
                    digest.append(lang.encode() + b"\n" + b" ".join(words))
                    for a, z in zip(cuts, cuts[1:], strict=False):
                        size, data = strings(words[a:z])
                        name = lang.encode()
                        head = np.array([begin + a, len(name), z - a], "<u4").tobytes()
                        rows.append((int(block[a]), WORDS, head + name + size + counts[order[a:z]].astype("<u4").tobytes(), data))
                    begin += len(words)
                flat = np.concatenate([np.zeros(1, np.int32), *numbers])
                # chunks with the same numbers but other words are kept apart
                own = int.from_bytes(hashlib.blake2b(b"\n".join(digest), digest_size=8).digest(), "little", signed=True)
                chunk = write_chunk(folder, pa.array([begin, own], pa.int64()), [flat.tobytes(), b""])
                out = [(-1, chunk, CHUNK, np.array([1], "<u4").tobytes(), None), *((block, chunk, kind, head, data) for block, kind, head, data in rows)]
                yield from emitted(out)

    return map_batches(docs, run, ROWS)


def learned(words: DataFrame, blocks: int, least: int) -> DataFrame:
    """Word blocks: counts are added up; chunks are told the numbers of their frequent words. Also a
    row of the frequent words of each block and language, and one of the number of all words."""

    def run(batches: Batches) -> Batches:
        for block, rows in streamed(batches, "block"):
            if block < 0:
                yield from emitted([tuple(r[f] for f in FIELDS) for r in rows])
                continue
            by_lang: dict[bytes, list[tuple]] = {}
            for r in rows:
                begin, n_lang, n = np.frombuffer(r["ids"], "<u4", 3).tolist()
                lang = r["ids"][12 : 12 + n_lang]
                size, count = np.frombuffer(r["ids"], "<u4", 2 * n, 12 + n_lang).reshape(2, n)
                by_lang.setdefault(lang, []).append((r["chunk"], begin, size, count, r["data"]))
            rows, out, known = [], [], 0
            for lang in sorted(by_lang):
                some = by_lang[lang]
                offsets = np.concatenate([np.zeros(1, np.int64), *(x[2] for x in some)]).cumsum()
                given = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(x[4] for x in some))])
                coded = given.dictionary_encode()
                of = coded.indices.to_numpy()
                total = np.zeros(len(coded.dictionary), np.int64)
                np.add.at(total, of, np.concatenate([x[3] for x in some]).astype(np.int64))
                often = np.flatnonzero(total >= least)
                ids = np.zeros(len(total), np.int64)
                ids[often] = 1 + (known + np.arange(len(often))) * blocks + block
                known += len(often)
                cuts = np.cumsum([0, *(len(x[2]) for x in some)]).tolist()
                for (chunk, begin, *_), a, z in zip(some, cuts, cuts[1:], strict=False):
                    found = ids[of[a:z]]
                    if found.any():
                        out.append((block, chunk, IDS, np.array([begin], "<u4").tobytes(), found.tobytes()))
                out.append((block, int(total.sum()), TOTAL, lang, None))
                if len(often):
                    frequent = coded.dictionary.take(pa.array(often)).to_pylist()
                    size, data = strings(frequent)
                    head = np.array([len(lang), len(often)], "<u4").tobytes()
                    out.append((block, int(ids.max()), FREQUENT, head + lang + size + ids[often].tobytes() + total[often].tobytes(), data))
            yield from emitted(out)

    return map_batches(by_block(words, blocks), run, ROWS)


def sent(chunk: int, cols: list[np.ndarray], times: int, blocks: int) -> list[tuple]:
    """Each different key of a chunk with its count, to its range."""
    order, run = runs(cols)
    head = heads(run)
    counts = (np.diff(np.append(head, len(run))) * times).astype("<u4")
    cols = [c[order[head]] for c in cols]
    block = blocks_of(cols[0], blocks)
    cuts = [*heads(block).tolist(), len(block)]
    return [(int(block[a]), chunk, KEYS, None, b"".join([*(c[a:z].tobytes() for c in cols), counts[a:z].tobytes()])) for a, z in zip(cuts, cuts[1:], strict=False)]


def flags(cols: list[np.ndarray], answers: list[dict]) -> np.ndarray:
    """Whether each key is frequent, by the answers of the ranges, one bit for each different key."""
    order, run = runs(cols)
    head = heads(run)
    answers = sorted(answers, key=lambda r: r["block"])
    bits = [np.unpackbits(np.frombuffer(r["data"], np.uint8))[: int.from_bytes(r["ids"], "little")] for r in answers]
    often = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(often, np.diff(np.append(head, len(run))))
    return out


def global_ids(folder: str, chunk: int, rows: list[dict]) -> np.ndarray:
    """The words of a chunk by their numbers in the corpus; 0 is an end of a piece or a rare word."""
    head, data = read_chunk(folder, chunk)
    known = np.zeros(head[0].as_py(), np.uint64)
    for r in rows:
        if r["kind"] == IDS:
            begin = int.from_bytes(r["ids"], "little")
            found = np.frombuffer(r["data"], "<u8")
            known[begin : begin + len(found)] = found
    return known[np.frombuffer(data[0], "<i4")]


def at_work(rows: list[dict], kind: int) -> tuple[int, list[dict]]:
    """(how often the chunk occurs, rows of the kind)."""
    return sum(int.from_bytes(r["ids"], "little") for r in rows if r["kind"] == CHUNK), [r for r in rows if r["kind"] == kind]


def by_chunk(rows: DataFrame, chunks: int) -> DataFrame:
    return rows.repartition(min(chunks, TASKS), "chunk").sortWithinPartitions("chunk")


def pairs_sent(rows: DataFrame, folder: str, blocks: int, chunks: int, wide: bool) -> DataFrame:
    """Phrases of two words."""

    def run(batches: Batches) -> Batches:
        for chunk, some in streamed(batches, "chunk"):
            times, _ = at_work(some, IDS)
            ids = global_ids(folder, chunk, some)
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            if len(at):
                yield from emitted(sent(chunk, pack([ids[at], ids[at + 1]], wide), times, blocks))

    return map_batches(by_chunk(rows.filter(F.col("kind").isin(CHUNK, IDS)), chunks), run, ROWS)


def triples_sent(rows: DataFrame, folder: str, blocks: int, chunks: int, wide: bool) -> DataFrame:
    """Phrases of three words, where frequent pairs overlap. Their places are written for the next step."""

    def run(batches: Batches) -> Batches:
        for chunk, some in streamed(batches, "chunk"):
            times, answers = at_work(some, BITS)
            ids = global_ids(folder, chunk, some)
            some = []
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            if not len(at):
                continue
            frequent = np.zeros(len(ids), bool)
            frequent[at] = flags(pack([ids[at], ids[at + 1]], wide), answers)
            at = np.flatnonzero(frequent[:-1] & frequent[1:])
            if not len(at):
                continue
            words = [ids[at], ids[at + 1], ids[at + 2]]
            name = write_chunk(folder, pa.array([chunk, 0], pa.int64()), [at.tobytes(), np.concatenate(words).tobytes()])
            mark = (-1, name, CHUNK, np.array([times], "<u4").tobytes(), None)
            yield from emitted([mark, *sent(name, pack(words, wide), times, blocks)])

    return map_batches(by_chunk(rows, chunks), run, ROWS)


def fours_sent(rows: DataFrame, folder: str, blocks: int, chunks: int, wide: bool) -> DataFrame:
    """Phrases of four words, where frequent triples overlap."""

    def run(batches: Batches) -> Batches:
        for chunk, some in streamed(batches, "chunk"):
            times, answers = at_work(some, BITS)
            _, (at, words) = read_chunk(folder, chunk)
            at = np.frombuffer(at, "<i8")
            words = list(np.frombuffer(words, "<u8").reshape(3, len(at)))
            on = np.flatnonzero(flags(pack(words, wide), answers))
            both = np.flatnonzero(np.diff(at[on]) == 1)
            if len(both):
                first, second = on[both], on[both + 1]
                yield from emitted(sent(chunk, pack([w[first] for w in words] + [words[2][second]], wide), times, blocks))

    return map_batches(by_chunk(rows, chunks), run, ROWS)


def counted(keys: DataFrame, blocks: int, n: int, wide: bool, least: int) -> DataFrame:
    """Ranges: keys are sorted and runs added up; chunks are told which of theirs are frequent."""
    of = width(n, wide)

    def run(batches: Batches) -> Batches:
        for block, rows in streamed(batches, "block"):
            if block < 0:
                yield from emitted([tuple(r[f] for f in FIELDS) for r in rows])
                continue
            sizes = [len(r["data"]) // (8 * of + 4) for r in rows]
            cols = [np.concatenate([np.frombuffer(r["data"], "<u8", n_, 8 * n_ * j) for r, n_ in zip(rows, sizes, strict=True)]) for j in range(of)]
            counts = np.concatenate([np.frombuffer(r["data"], "<u4", n_, 8 * n_ * of) for r, n_ in zip(rows, sizes, strict=True)]).astype(np.int64)
            chunks = [r["chunk"] for r in rows]
            rows = []
            order, run = runs(cols)
            head = heads(run)
            total = np.add.reduceat(counts[order], head)
            often = np.zeros(len(order), bool)
            often[order] = (total >= least)[run]
            cuts = np.cumsum([0, *sizes]).tolist()
            out = [(block, c, BITS, np.array([z - a], "<u4").tobytes(), np.packbits(often[a:z]).tobytes()) for c, a, z in zip(chunks, cuts, cuts[1:], strict=False)]
            keep = np.flatnonzero(total >= least)
            if len(keep):
                found = unpack([c[order[head[keep]]] for c in cols], n, wide)
                out.append((block, n, GRAMS, None, b"".join(x.tobytes() for x in [*found, total[keep]])))
            yield from emitted(out)

    return map_batches(by_block(keys, blocks), run, ROWS)


WORD_KEYS = [f"w{i}" for i in range(1, LONGEST + 1)]


def phrases_of(rows: DataFrame) -> DataFrame:
    """w1 to w4 (numbers of words, 0 where there is none), size and f of the frequent phrases."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cols = np.frombuffer(data, "<i8").reshape(n + 1, -1)
                none = np.zeros(cols.shape[1], np.int64)
                words = [cols[i] if i < n else none for i in range(LONGEST)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in [*words, none + n, cols[n]]], [*WORD_KEYS, "size", "f"])

    some = rows.filter(F.col("kind") == GRAMS).select(F.col("chunk").alias("n"), "data")
    return map_batches(some, run, ", ".join(f"{c} bigint" for c in [*WORD_KEYS, "size", "f"]))


def words_of(rows: DataFrame) -> DataFrame:
    """w1 (number), lang, word and f of the frequent words."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            for head, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n_lang, n = np.frombuffer(head, "<u4", 2).tolist()
                lang, at = head[8 : 8 + n_lang].decode(), 8 + n_lang
                offsets = np.concatenate(([0], np.frombuffer(head, "<u4", n, at))).cumsum().astype(np.int32)
                ids, f = np.frombuffer(head, "<i8", 2 * n, at + 4 * n).reshape(2, n)
                word = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pc.cast(pa.array([lang] * n), pa.string()), word, pa.array(f)], ["w1", "lang", "word", "f"])

    return map_batches(rows.filter(F.col("kind") == FREQUENT).select("ids", "data"), run, "w1 bigint, lang string, word string, f bigint")


def part(a: int, z: int) -> list[Column]:
    """The key of the words a to z of a phrase."""
    return [F.col(f"w{a + i}").alias(c) if a + i <= z else F.lit(0).cast("long").alias(c) for i, c in enumerate(WORD_KEYS)]


def by_size(items: dict[int, list[Column]]) -> Column:
    """The array of items for a phrase of this size."""
    return F.coalesce(*[F.when(F.col("size") == n, F.array(*some)) for n, some in items.items()])


def scored(phrases: DataFrame, words: DataFrame, share: int) -> DataFrame:
    """w1 to w4, size, lang, a, l, r and score of the candidates that are no mere part of a longer one."""
    sizes = range(2, LONGEST + 1)
    known = phrases.select(*WORD_KEYS, "f").unionByName(words.select(*[F.col("w1") if c == "w1" else F.lit(0).cast("long").alias(c) for c in WORD_KEYS], "f"))
    within = {n: [F.struct(*part(i, i + k - 1), "f") for k in range(2, n) for i in range(1, n - k + 2)] for n in sizes if n > 2}
    longer = phrases.filter("size > 2").select(F.explode(by_size(within)).alias("p")).groupBy(*[F.col(f"p.{c}").alias(c) for c in WORD_KEYS]).agg(F.max("p.f").alias("most"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kept = phrases.join(longer, WORD_KEYS, "left").filter(F.col("most").isNull() | (F.lit(100) * exact("most") < F.lit(share) * exact("f"))).drop("most")
    ways = {n: [F.struct(F.lit(k).alias("k"), F.struct(*part(1, k)).alias("head"), F.struct(*part(k + 1, n)).alias("rest")) for k in range(1, n)] for n in sizes}
    cut = kept.select(*WORD_KEYS, "size", F.col("f").alias("a"), F.explode(by_size(ways)).alias("c"))
    for side, name in (("head", "l"), ("rest", "r")):
        looked = known.select(F.struct(*WORD_KEYS).alias("key"), F.col("f").alias(name))
        cut = cut.join(looked, F.col(f"c.{side}") == F.col("key")).drop("key")
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = F.min(F.struct(score.alias("score"), F.col("c.k").alias("k"), "l", "r")).alias("best")
    found = cut.groupBy(*WORD_KEYS, "size", "a").agg(best).select(*WORD_KEYS, "size", "a", "best.l", "best.r", "best.score")
    return found.join(words.select("w1", "lang"), "w1")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP, wide: bool | None = None
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first phrases of each language."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(8, math.ceil(size / BLOCK_BYTES))
    folder = shared_path(spark, "chunks")
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    first = written(learned(encoded(docs, folder, blocks), blocks, least), "words")
    chunks = max(1, first.filter(F.col("kind") == CHUNK).count())
    if wide is None:
        wide = (first.filter(F.col("kind") == FREQUENT).agg(F.max("chunk")).first()[0] or 0) >= 2**32
    two = written(counted(pairs_sent(first, folder, blocks, chunks, wide), blocks, 2, wide, least), "phrases2")
    to_chunks = first.filter(F.col("kind").isin(CHUNK, IDS)).unionByName(two.filter(F.col("kind") == BITS))
    three = written(counted(triples_sent(to_chunks, folder, blocks, chunks, wide), blocks, 3, wide, least), "phrases3")
    to_chunks = three.filter(F.col("kind").isin(CHUNK, BITS))
    four = written(counted(fours_sent(to_chunks, folder, blocks, chunks, wide), blocks, 4, wide, least), "phrases4")
    words = words_of(first)
    found = written(scored(phrases_of(two.unionByName(three).unionByName(four)), words, share), "candidates")
    # words are looked up for what can be among the first only: all that is no worse than the last of them
    scores = found.select("lang", "score", "a", F.pmod(F.xxhash64(*WORD_KEYS), F.lit(SPREAD)).alias("s"))
    for keys in (["lang", "s"], ["lang"]):  # a language's candidates are many, the first of each of its parts few
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"))
        scores = scores.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= top).drop("k")
    last = scores.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    some = join_small(found, last, "lang").filter(F.struct("score", "a") >= F.col("last")).drop("last")
    for c in WORD_KEYS:
        some = some.join(words.select(F.col("w1").alias(c), F.col("word").alias(f"{c}_word")), c, "left" if c != "w1" else "inner")
    some = some.withColumn("phrase", F.concat_ws(" ", *[f"{c}_word" for c in WORD_KEYS]))
    totals = first.filter(F.col("kind") == TOTAL).groupBy(F.col("ids").cast("string").alias("lang")).agg(F.sum("chunk").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = some.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return join_small(ranked, totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
