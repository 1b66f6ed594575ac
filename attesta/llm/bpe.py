"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Encoding: the pre-tokens of a batch that the worker has not met are laid out as
token-position rows (word, position, token); a recursive query joins each row and
its right neighbour to the merge table and contracts every word's leftmost pair
of minimum rank, until no word has a pair left. The merge table holds each way to
cut a vocabulary entry into two others, keyed by token ids; ranks are token ids.
A pre-token that is itself in the vocabulary is that token, as in the public
library. Decoding joins token-position rows to the vocabulary and concatenates by
an ordered aggregate.

Long pre-tokens. The recursion keeps all its rounds, so a query goes on for so many rounds
only that rounds times rows stay under STATE_ROWS; words that are done leave, and the rest is the
next query's input. A pre-token longer than WINDOW bytes is first cut at barriers (pairs of bytes that stand
side by side in no vocabulary entry, which no merge can cross), and parts that are still
longer into windows of WINDOW bytes, which all go through the query by themselves, together. Two
encoded neighbours are put together where that is the encoding of both: tokens are what
merging gives if and only if each two neighbours by themselves are merged to just these two
tokens (the first merge across a boundary in the whole would be one in the two tokens as
well). So only the two tokens at a seam are looked at; where they are merged otherwise,
two, four, eight ... tokens on both sides are merged anew, until the outer ones come out as
they were. Neighbours are joined in pairs, then pairs of pairs, each step for all
pre-tokens in a few queries.

Edge cases: null or empty text has no tokens and decodes to nothing; repeated
rows are encoded row by row; whole texts are encoded; special tokens do not
exist, their strings are ordinary text; other columns are not read. Memory: a
worker keeps about two times CACHE_WORDS words, each of LONG_WORD bytes at most, and a query handles at most QUERY_BYTES
of pre-tokens and about STATE_ROWS rows in all its rounds. There is no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Batches, holding, map_batches, slices, texts

#: Bytes that are merged by themselves, longest word that is remembered, and rows of a recursion.
WINDOW, LONG_WORD, STATE_ROWS = 24, 1024, 1_500_000
CACHE_WORDS, QUERY_BYTES, DECODE_TOKENS, SLICE_BYTES = 400_000, 150_000, 250_000, 2 << 20

#: Positions count on over all pieces of a query; a key holds a rank and a position.
MERGE = """
WITH RECURSIVE state(word, pos, token, next_pos, next_token, round) AS (
    SELECT word, pos, token, next_pos, next_token, 0 FROM pieces
    UNION ALL
    SELECT s.word, s.pos,
           CASE WHEN s.pos = b.pos THEN b.merged ELSE s.token END,
           CASE WHEN s.pos = b.pos THEN b.after_pos ELSE s.next_pos END,
           CASE WHEN s.pos = b.pos THEN b.after_token WHEN s.next_pos = b.pos THEN b.merged ELSE s.next_token END,
           s.round + 1
    FROM state s JOIN (
        SELECT f.word, f.best % 67108864 AS pos, f.best // 67108864 AS merged, p.next_pos AS gone,
               q.next_pos AS after_pos, q.next_token AS after_token
        FROM (
            SELECT s.word, min(m.merged::BIGINT * 67108864 + s.pos) AS best
            FROM state s JOIN merges m ON m.left_token = s.token AND m.right_token = s.next_token
            GROUP BY s.word
        ) f JOIN state p ON p.pos = f.best % 67108864 JOIN state q ON q.pos = p.next_pos
    ) b ON b.word = s.word
    WHERE s.pos <> b.gone AND s.round < {rounds}
)
SELECT s.word, s.pos, s.token, s.next_pos, s.next_token, s.round = {rounds} AS unfinished
FROM state s JOIN (SELECT word, max(round) AS round FROM state GROUP BY word) l ON l.word = s.word AND l.round = s.round
"""
DECODE = """
SELECT doc, string_agg(v.piece, '' ORDER BY pos) AS piece
FROM tokens JOIN vocabulary v USING (token) GROUP BY doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def batches_of(pieces: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of pieces of about QUERY_BYTES; a longer one is a run by itself."""
    some, size = [], 0
    for p in pieces:
        if some and size + len(p) > QUERY_BYTES:
            yield some
            some, size = [], 0
        some.append(p)
        size += len(p)
    if some:
        yield some


class Engine:
    """Vocabulary, merge table, a DuckDB connection and the words met so far."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        pairs = [
            (self.ranks[k[:i]], self.ranks[k[i:]], v)
            for k, v in self.ranks.items()
            for i in range(1, len(k))
            if k[:i] in self.ranks and k[i:] in self.ranks
        ]
        table = pa.table({n: pa.array([x[i] for x in pairs], pa.int32()) for i, n in enumerate(("left_token", "right_token", "merged"))})
        vocabulary = pa.table(
            {"token": pa.array(list(self.ranks.values()), pa.int32()), "piece": pa.array([k.decode("latin-1") for k in self.ranks])}
        )
        for name, rows in (("merges", table), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.side_by_side = np.zeros((256, 256), bool)
        for k in self.ranks:
            b = np.frombuffer(k, np.uint8)
            self.side_by_side[b[:-1], b[1:]] = True
        self.whole = {k: np.int32(v).tobytes() for k, v in self.ranks.items()}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.seams: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian int32 ids of each piece, by the recursive query."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        token, pos = self.single[flat], np.arange(len(flat), dtype=np.int32)
        next_pos, next_token = pos + 1, np.append(token[1:], -1)
        for of in (next_pos, next_token):
            of[np.cumsum(lens) - 1] = -1
        names = ("word", "pos", "token", "next_pos", "next_token")
        rows = pa.table(dict(zip(names, (np.repeat(np.arange(len(pieces), dtype=np.int32), lens), pos, token, next_pos, next_token), strict=True)))
        done = []
        while rows.num_rows:
            self.db.register("pieces", rows)
            found = self.db.sql(MERGE.format(rounds=max(2, STATE_ROWS // rows.num_rows))).to_arrow_table()
            self.db.unregister("pieces")
            on = found.column("unfinished").to_numpy()
            columns = [found.column(n).to_numpy() for n in names]
            done.append(np.stack([c[~on] for c in columns[:3]]))
            rows = pa.table(dict(zip(names, (c[on].astype(np.int32) for c in columns), strict=True)))
        word, pos, token = np.concatenate(done, axis=1) if done else np.zeros((3, 0), np.int64)
        order = np.argsort(pos, kind="stable")
        ids, word = token[order].astype("<i4").tobytes(), word[order]
        ends = np.searchsorted(word, np.arange(len(pieces)), side="right").tolist()
        return [ids[4 * a : 4 * z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]

    def merged(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of different pieces, in queries of about QUERY_BYTES."""
        out: dict[bytes, list[int]] = {}
        for some in batches_of(dict.fromkeys(pieces)):
            out |= {p: np.frombuffer(x, "<i4").tolist() for p, x in zip(some, self.merge(some), strict=True)}
        return out

    def parts(self, piece: bytes) -> list[bytes]:
        """A piece cut at its barriers."""
        b = np.frombuffer(piece, np.uint8)
        cuts = (np.flatnonzero(~self.side_by_side[b[:-1], b[1:]]) + 1).tolist()
        return [piece[a:z] for a, z in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    def merge_long(self, pieces: list[bytes]) -> list[bytes]:
        """The same as merge, for pieces of any length: by windows that are joined."""
        cut = [[[x[i : i + WINDOW] for i in range(0, len(x), WINDOW)] for x in self.parts(p)] for p in pieces]
        known = self.merged(w for p in cut for x in p for w in x)
        ids = [[[known[w] for w in x] for x in p] for p in cut]
        while any(len(x) > 1 for p in ids for x in p):
            pairs = iter(self.joined([(x[i], x[i + 1]) for p in ids for x in p for i in range(0, len(x) - 1, 2)]))
            ids = [[[next(pairs) for _ in range(len(x) // 2)] + x[len(x) & ~1 :] for x in p] for p in ids]
        return [np.array([t for x in p for t in x[0]], "<i4").tobytes() for p in ids]

    def joined(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The encodings of neighbours put together."""
        if len(self.seams) > CACHE_WORDS:
            self.seams.clear()
        unknown = {(a[-1], z[0]) for a, z in pairs} - self.seams.keys()
        both = {s: self.bytes_of[s[0]] + self.bytes_of[s[1]] for s in unknown}
        found = self.merged(both.values())
        self.seams |= {s: found[both[s]] == list(s) for s in unknown}
        out = [a + z if self.seams[a[-1], z[0]] else [] for a, z in pairs]
        todo, k = [i for i, x in enumerate(out) if not x], 2
        while todo:
            inner = {i: b"".join(map(self.bytes_of.__getitem__, pairs[i][0][-k:] + pairs[i][1][:k])) for i in todo}
            found, left = self.merged(inner.values()), []
            for i in todo:
                (a, z), m = pairs[i], found[inner[i]]
                if (k >= len(a) or m[0] == a[-k]) and (k >= len(z) or m[-1] == z[k - 1]):
                    out[i] = a[:-k] + m + z[k:]
                else:
                    left.append(i)
            todo, k = left, 2 * k
        return out

    def learn(self, found: Iterable[str]) -> dict[str, bytes]:
        """Ids of every piece in found. The cache has two generations: a full one becomes
        the old one, and words of the old one that are met again move to the new."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.old = {}, self.words
        out, old, short, long = self.words, self.old, {}, {}
        for w in found:
            if w not in out:
                if (known := old.get(w)) is not None:
                    out[w] = known
                elif (known := self.whole.get(b := w.encode())) is not None:
                    out[w] = known
                else:
                    (short if len(b) <= WINDOW else long)[b] = w
        for merge, fresh in ((self.merge, short), (self.merge_long, long)):
            for some in batches_of(fresh):
                out.update(zip(map(fresh.__getitem__, some), merge(some), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        ids = self.learn({w for c in cut for w in c})
        out = [b"".join(map(ids.__getitem__, c)) for c in cut]
        for w in [w for w in ids if len(w) > LONG_WORD]:
            del ids[w]
        return out

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Bytes of each list of ids; offsets as in an Arrow list array."""
        n = len(offsets) - 1
        out: list[bytes] = [b""] * n
        lens = np.diff(offsets)
        self.db.register(
            "tokens",
            pa.table(
                {
                    "doc": np.repeat(np.arange(n, dtype=np.int32), lens),
                    "pos": np.arange(len(ids), dtype=np.int32),
                    "token": ids.astype(np.int32, copy=False),
                }
            ),
        )
        for doc, piece in self.db.execute(DECODE).fetchall():
            out[doc] = piece.encode("latin-1")
        self.db.unregister("tokens")
        return out

    def both_ways(self, documents: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(offsets, ids, bytes decoded from the ids) of the texts."""
        packed = self.encode(documents)
        offsets = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
        ids = np.frombuffer(b"".join(packed), "<i4")
        raw: list[bytes] = []
        at = 0
        while at < len(packed):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + DECODE_TOKENS, side="right")) - 1)
            raw += self.decode(offsets[at : end + 1] - offsets[at], ids[offsets[at] : offsets[end]])
            at = end
        return offsets, ids, raw


_engines: dict[tuple[str, str], Engine] = {}
holding("bpe", _engines.clear)


def engine(path: str, pattern: str) -> Engine:
    """The worker's engine; one is kept."""
    if (path, pattern) not in _engines:
        _engines.clear()
        _engines[path, pattern] = Engine(path, pattern)
    return _engines[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of token ids) of every document."""

    def run(batches: Batches) -> Batches:
        own = engine(path, pattern)
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                ids = own.encode([t or "" for t in b.column(1).to_pylist()])
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "ids"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, "id bigint, ids array<int>", keep="bpe")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """id, ids and the decoded bytes."""

    def run(batches: Batches) -> Batches:
        own = engine(path, pattern)
        for whole in batches:
            for b in slices(whole, 1, DECODE_TOKENS):
                lists = b.column(1)
                offsets = lists.offsets.to_numpy()
                ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                raw = own.decode(offsets - offsets[0], ids)
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(raw, pa.binary())], ["id", "ids", "decoded"])

    return map_batches(encoded.select("id", "ids"), run, "id bigint, ids array<int>, decoded binary", keep="bpe")


def roundtrip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one worker: id, ids and the bytes decoded from ids."""

    def run(batches: Batches) -> Batches:
        own = engine(path, pattern)
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                offsets, ids, raw = own.both_ways([t or "" for t in b.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(raw, pa.binary())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "id bigint, ids array<int>, decoded binary", keep="bpe")


def encode_checked(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decodes (whether the ids decode to the text's bytes)."""

    def run(batches: Batches) -> Batches:
        own = engine(path, pattern)
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                offsets, ids, raw = own.both_ways([t or "" for t in b.column(1).to_pylist()])
                same = [x == y for x, y in zip(raw, texts(b.column(1)), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets), pa.int64()), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "decodes"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id bigint, n_tokens bigint, ids array<int>, decodes boolean", keep="bpe")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
