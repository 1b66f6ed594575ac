"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another. The model of each is a logistic
regression over hashed words and word beginnings (presence, not count) and the
probabilities of the categories before it; only features that tell the classes
apart beyond chance get a weight. In training those probabilities come
from out-of-fold predictions: the labelled rows are dealt into FOLDS parts by a
hash of their id, and a row's probability comes from a model that has not seen
its part; in scoring they come from the model of all parts. The out-of-fold probabilities
also set each category's threshold: one half, or less where that finds too few of the
positive rows (RECALL), as long as not too many others (FALSE) are found with them.

Training takes a bounded sample of labelled rows that are among the documents, `max_labelled`, the first by a
hash of the id and then of the text, so that it behaves alike at every size; only
their features come to the driver, at most `max_labelled` rows also where ids repeat. Scoring is a map over all rows with the weights (a fixed size) in
the closure; nothing is shuffled.

Edge cases: null and empty texts have no features and get the prior's
probability, and are never rejected, whatever the prior; a row whose label is null trains no
model of that category; repeated rows are scored row by row; rows that
repeat with the same labels train once; without labels, or with labels of one class only,
the probability is that class's share and nothing is rejected unless labelled so
throughout; an empty table gives an empty result; other columns are kept by
`reject_toxic` and not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Batches, lean, map_batches, texts
from attesta.llm.words import NOT_ALNUM, buffers, word_hashes

BITS = 19
MAX_LABELLED = 8000
FOLDS, STEPS, RATE, L2 = 3, 200, 0.1, 0.1
#: Likelihood ratio (G) of a feature that gets a weight: by chance one in 600 has it.
TELLING = 10.0
#: Share of the positive rows that are to be found, share of the others that may be found with them.
RECALL, FALSE = 0.9, 0.01
PREFIXES = (5, 4)


def features(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, offsets): the distinct hashed features of each text, one after another."""
    parts, counts = [], []
    for _, some in buffers(documents):
        words, n, *heads = word_hashes(some, NOT_ALNUM, PREFIXES)
        doc = np.repeat(np.arange(len(some), dtype=np.uint64), n)
        kinds = (words, *heads)
        size = np.uint64((1 << BITS) // 4)
        key = np.unique(np.concatenate([(doc << np.uint64(BITS)) | (h % size + np.uint64(k) * size) for k, h in enumerate(kinds)]))
        parts.append((key & np.uint64((1 << BITS) - 1)).astype(np.int32))
        counts.append(np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=len(some)))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


@dataclass
class Linear:
    weights: np.ndarray
    chain: np.ndarray
    bias: float
    threshold: float = 0.5

    def margins(self, indices: np.ndarray, offsets: np.ndarray, before: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not n:
            return np.zeros(0)
        total = np.concatenate([[0.0], np.cumsum(self.weights[indices], dtype=np.float64)])
        return total[offsets[1:]] - total[offsets[:-1]] + before @ self.chain + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def rows_of(indices: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offsets)[keep]
    take = np.repeat((offsets[:-1][keep] - (np.cumsum(size) - size)).astype(np.int32), size)
    take += np.arange(len(take), dtype=np.int32)
    return indices[take], np.concatenate([[0], np.cumsum(size)])


def telling(indices: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The features whose presence depends on the label beyond chance: their likelihood ratio (G) exceeds TELLING."""
    n, pos = len(y), float(y.sum())
    df = np.bincount(indices, minlength=1 << BITS)
    hit = np.bincount(indices[np.repeat(y > 0, np.diff(offsets))], minlength=1 << BITS).astype(float)

    def part(seen: np.ndarray, total: np.ndarray | float, share: float) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(total * share, 1e-12))

    share, off = pos / n, n - df
    g = 2 * (part(hit, df, share) + part(df - hit, df, 1 - share) + part(pos - hit, off, share) + part(off - (pos - hit), off, 1 - share))
    return np.flatnonzero((df >= 3) & (g > TELLING))


def fit(indices: np.ndarray, offsets: np.ndarray, before: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression on the telling features, by accelerated gradient steps with an L2 penalty."""
    n, share = len(y), float(y.mean()) if len(y) else 0.0
    w, c = np.zeros(1 << BITS), np.zeros(before.shape[1])
    if n == 0 or share in (0.0, 1.0):
        return Linear(w.astype(np.float32), c, 30.0 if n and share == 1 else -30.0)
    kept = telling(indices, offsets, y)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    local = place[indices]
    on = local >= 0
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))[on]
    local = local[on]
    del on, place
    v = np.zeros(len(kept) + before.shape[1] + 1)
    v[-1] = np.log(share / (1 - share))
    m, s = np.zeros_like(v), np.zeros_like(v)
    penalty = np.concatenate([np.full(len(kept), L2 / n), np.full(before.shape[1], L2 / n), [0.0]])
    for step in range(1, STEPS + 1):
        p = sigmoid(np.bincount(doc, v[local], n) + before @ v[len(kept) : -1] + v[-1])
        error = (p - y) / n
        g = np.concatenate([np.bincount(local, error[doc], len(kept)), error @ before, [error.sum()]]) + penalty * v
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    w[kept] = v[: len(kept)]
    return Linear(w.astype(np.float32), v[len(kept) : -1], float(v[-1]))


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The highest probability up to one half from which RECALL of the positive rows are found; at least
    that from which no more than FALSE of the others are."""
    pos, neg = np.sort(p[y > 0])[::-1], np.sort(p[y == 0])[::-1]
    if not len(pos) or not len(neg):
        return 0.5
    wanted = pos[math.ceil(RECALL * len(pos)) - 1]
    allowed = np.nextafter(neg[int(FALSE * len(neg))], 1)
    return float(min(0.5, max(wanted, allowed)))


def fit_chain(indices: np.ndarray, offsets: np.ndarray, fold: np.ndarray, labels: np.ndarray) -> list[Linear]:
    """labels: rows x categories, NaN where unknown. A model for each category, in order."""
    n, k = labels.shape
    before, models = np.zeros((n, 0)), []
    for j in range(k):
        known = ~np.isnan(labels[:, j])
        held_out = np.zeros(n)
        for f in range(FOLDS):
            train, test = np.flatnonzero(known & (fold != f)), np.flatnonzero(fold == f)
            if len(test):
                part = fit(*rows_of(indices, offsets, train), before[train], labels[train, j])
                held_out[test] = sigmoid(part.margins(*rows_of(indices, offsets, test), before[test]))
        train = np.flatnonzero(known)
        model = fit(*rows_of(indices, offsets, train), before[train], labels[train, j])
        model.threshold = threshold(held_out[train], labels[train, j])
        models.append(model)
        before = np.column_stack([before, held_out])
    return models


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> list[Linear]:
    """Fit the chain on the bounded sample of labelled rows."""
    sample = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"label_{i}") for i, c in enumerate(categories)])
    known = docs.select(F.col(id_col).alias("id"))  # ids only: the sample is taken of labels whose documents are there
    sample = sample.join(known, "id", "left_semi").orderBy(F.xxhash64("id"), *sample.columns).limit(max_labelled)
    # at most max_labelled rows of a few numbers: a bounded broadcast
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample.distinct()), "id")

    def extract(batches: Batches) -> Batches:
        for b in batches:
            indices, offsets = features(texts(b.column(2)))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(indices))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, *b.columns[3:]], ["id", "digest", "features", *names])

    names = [f"label_{i}" for i in range(len(categories))]
    keyed = found.select("id", F.xxhash64("text").alias("digest"), "text", *names)
    rows = map_batches(keyed, extract, "id bigint, digest bigint, features array<int>, " + ", ".join(f"{n} double" for n in names))
    rows = rows.dropDuplicates(["id", "digest", *names]).orderBy(F.xxhash64("id"), "digest", *names).limit(max_labelled)
    table = rows.toArrow().combine_chunks()
    if not table.num_rows:
        return fit_chain(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros((0, len(names))))
    ids = table.column("id").to_numpy()
    y = np.column_stack([table.column(n).to_numpy().astype(float) for n in names])
    lists = table.column("features").combine_chunks()
    indices, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    # rows come in any order: by id, label and length they make the same model each time
    order = np.lexsort((np.diff(offsets), *np.nan_to_num(y.T), ids))
    indices, offsets = rows_of(indices, offsets, order)
    ids, y = ids[order], y[order]
    del rows, table, lists
    fold = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(FOLDS)
    lean()  # the driver lives on after training: what it took goes back to the system, before and after
    models = fit_chain(indices, offsets, fold, y)
    del indices, offsets
    lean()
    return models


def probabilities(models: list[Linear], documents: list[bytes]) -> np.ndarray:
    """rows x categories."""
    return scored(models, documents)[0]


def scored(models: list[Linear], documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (rows x categories), and whether a row has features."""
    indices, offsets = features(documents)
    before = np.zeros((len(documents), 0))
    for m in models:
        before = np.column_stack([before, sigmoid(m.margins(indices, offsets, before))])
    return before, np.diff(offsets) > 0


def score(docs: DataFrame, models: list[Linear], categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and p_<category> of every row."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            p = probabilities(models, texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, j]) for j in range(len(categories)))], ["id", *names])

    names = [f"p_{c}" for c in categories]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "id bigint, " + ", ".join(f"{n} double" for n in names))


def reject_toxic(docs: DataFrame, models: list[Linear], toxic: int, text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs without the rows whose probability of category number `toxic` is at least `least`, by default
    its threshold; rows without features stay."""
    least = models[toxic].threshold if least is None else least
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Batches) -> Batches:
        for b in batches:
            p, known = scored(models, texts(b.column(place)))
            yield b.filter(pa.array((p[:, toxic] < least) | ~known))

    return map_batches(docs, run, docs.schema)
