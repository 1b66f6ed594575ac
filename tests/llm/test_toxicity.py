import math
import random
import re

import numpy as np

from attesta.llm import toxicity as tox


#: Share of the toxic rows of sf0.1 that are found by models of the other half.
CAUGHT = 0.9


def corpus(n=1200, seed=1):
    rnd = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 80))]
        bad, low = rnd.random() < 0.15, rnd.random() < 0.3
        if bad:
            text += rnd.sample(["vile", "nasty", "rotten"], 2)
        if low:
            text += ["spam", "spam2"]
        rnd.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(not low), int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = tox.train(docs, table.filter("doc_id < 800"), ["quality", "toxic"])
    p = {r.id: r for r in tox.score(docs, models, ["quality", "toxic"]).collect()}
    held = [x for x in labels if x[0] >= 800]
    assert np.mean([(p[i].p_toxic >= 0.5) == bool(t) for i, _, t in held]) > 0.98
    assert np.mean([(p[i].p_quality >= 0.5) == bool(q) for i, q, _ in held]) > 0.95
    kept = {r.doc_id for r in tox.reject_toxic(docs, models, 1).collect()}
    assert kept == {i for i, r in p.items() if r.p_toxic < models[1].threshold}
    assert {r.doc_id for r in tox.reject_toxic(docs, models, 1, least=0.9).collect()} == {i for i, r in p.items() if r.p_toxic < 0.9}


def test_real_rows(spark):
    from tests.conftest import DATA

    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    caught, clean = [], []
    for part in (0, 1):  # each half by the other
        models = tox.train(docs, labels.filter(f"doc_id % 2 = {part}"), ["quality", "toxic"])
        rest = labels.filter(f"doc_id % 2 = {1 - part} AND toxic IS NOT NULL").collect()
        p = {r.id: r.p_toxic for r in tox.score(docs, models, ["quality", "toxic"]).collect()}
        caught += [p[r.doc_id] >= models[1].threshold for r in rest if r.toxic]
        clean += [p[r.doc_id] >= models[1].threshold for r in rest if not r.toxic]
    # a part of the labels here has no ground in the text: runs of one ordinary word, or nothing but prose
    assert np.mean(caught) >= CAUGHT and np.mean(clean) <= 0.02, (np.mean(caught), np.mean(clean))


def test_thresholds():
    y = np.array([1.0] * 10 + [0.0] * 100)
    low = np.array([0.9] * 8 + [0.3, 0.1] + [0.01] * 100)
    assert tox.threshold(low, y) == 0.3
    assert tox.threshold(np.where(low == 0.3, 0.6, low), y) == 0.5
    crowded = np.concatenate([low[:10], np.linspace(0.4, 0.2, 100)])
    assert crowded[10 + 1] < tox.threshold(crowded, y) <= crowded[10] and tox.threshold(low, np.zeros(110)) == tox.threshold(low, np.ones(110)) == 0.5


def test_the_sample_is_of_labels_with_documents(spark):
    """Labels of other corpora take no place in the sample."""
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    others = [(i, 1, 0) for i in range(10_000, 20_000)]
    seen, keep = [], tox.fit_chain
    tox.fit_chain = lambda indices, offsets, fold, y: seen.append(len(y)) or keep(indices, offsets, fold, y)
    try:
        tox.train(docs, spark.createDataFrame(labels + others, "doc_id long, quality int, toxic int"), ["quality", "toxic"], max_labelled=200)
    finally:
        tox.fit_chain = keep
    assert seen == [200]


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(0)
    n = 600
    first = rng.integers(0, 2, n).astype(float)
    docs = [(b"mark " if f else b"") + b"filler%d" % (i % 50) for i, f in enumerate(first)]
    indices, offsets = tox.features(docs)
    models = tox.fit_chain(indices, offsets, np.arange(n) % 3, np.column_stack([first, first]))
    assert len(models[0].chain) == 0 and len(models[1].chain) == 1 and models[1].chain[0] > 0


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, 1), (4, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0), labels.filter("toxic = 1")):
        models = tox.train(odd, table, ["quality", "toxic"])
        scored = tox.score(odd, models, ["quality", "toxic"]).collect()
        assert len(scored) == odd.count() and all(0 <= r.p_toxic <= 1 for r in scored)
        assert tox.reject_toxic(odd, models, 1).columns == odd.columns
    models = tox.train(odd, labels.limit(0), ["quality", "toxic"])
    assert tox.reject_toxic(odd, models, 1).count() == odd.count()
    assert tox.score(empty, models, ["quality", "toxic"]).collect() == []
    assert tox.train(empty, labels, ["quality", "toxic"]) is not None


def test_texts_without_features_stay_where_most_labels_are_toxic(spark):
    docs = spark.createDataFrame([(i, f"some word{i % 7}") for i in range(84)] + [(90, None), (91, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 > 0)) for i in range(84)], "doc_id long, quality int, toxic int")
    models = tox.train(docs, labels, ["quality", "toxic"])
    p = {r.id: r.p_toxic for r in tox.score(docs, models, ["quality", "toxic"]).collect()}
    assert p[90] == p[91] >= 0.5 and p[0] >= 0.5
    kept = {r.doc_id for r in tox.reject_toxic(docs, models, 1).collect()}
    assert {90, 91} <= kept and 0 not in kept


def test_the_sample_is_bounded_by_rows(spark):
    """One labelled id with very many rows: no more rows than max_labelled come to the driver."""
    docs = spark.createDataFrame([(i % 3, f"word{i} common") for i in range(3000)] + [(0, "word0 common")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    keep = tox.fit_chain
    tox.fit_chain = lambda indices, offsets, fold, y: seen.append(y) or keep(indices, offsets, fold, y)
    try:
        tox.train(docs, labels, ["quality", "toxic"], max_labelled=500)
        tox.train(docs, labels, ["quality", "toxic"])
    finally:
        tox.fit_chain = keep
    assert [len(y) for y in seen] == [500, 3000]


def plain_hash(data: bytes) -> int:
    """The mixed polynomial hash of a word, in plain Python."""
    base, h = 0x9E3779B97F4A7C15 | 1, 0
    for i, b in enumerate(data):
        h = (h + (b + 1) * pow(base, i, 2**64)) % 2**64
    return h


def mix(h: int) -> int:
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
    return h ^ (h >> 31)


def test_query_against_a_plain_chain(spark, sf):
    """op10 on the whole table: words by a pattern, features by plain integers, sums by a loop, category
    after category; and a later model's input is the earlier probability."""
    from attesta.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    models = tox.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), queries.CATEGORIES)
    size = (1 << tox.BITS) // 4
    for r in queries.op10_toxicity(spark, sf).collect():
        seen = set()
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", docs[r.doc_id].encode()):
            w = w.lower()
            seen.add(mix(plain_hash(w)) % size)
            for kind, n in enumerate(sorted(tox.PREFIXES, reverse=True), 1):
                seen.add(mix(plain_hash(w[:n]) ^ (0x5851F42D4C957F2D * n % 2**64)) % size + kind * size)
        before = []
        for m in models:
            margin = m.bias + sum(float(m.weights[i]) for i in seen) + sum(c * p for c, p in zip(m.chain, before, strict=True))
            before.append(1 / (1 + math.exp(-max(-30, min(30, margin)))))
        assert abs(before[0] - r.p_quality) < 1e-5 and abs(before[1] - r.p_toxic) < 1e-5
        assert r.toxic == (r.p_toxic >= models[1].threshold) or abs(before[1] - models[1].threshold) < 1e-5
