import random
from fractions import Fraction

import numpy as np

from attesta.llm import ngram_join as nj


def sets_of(text, n=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset((n, *words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(df):
    return sorted((tuple(r) for r in nj.digest(nj.link_documents(df)).collect()), key=str)


def near_copies(seed, groups=6, copies=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 8, 20, 60, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows


def test_against_brute_force(spark):
    rows = near_copies(5)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_hot_groups(spark):
    """Groups far larger than HOT: many near copies of one text, and a line that many texts share."""
    rnd = random.Random(2)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rnd.choice(vocabulary) for _ in range(80)]
    line = " ".join(rnd.choice(vocabulary) for _ in range(12))
    rows = []
    for _ in range(150):
        words = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((len(rows), " ".join(words)))
    for _ in range(150):
        rows.append((len(rows), line + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([2, 4, 8, 60])))))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_templates(spark):
    """Texts that share most of their passages without being linked, with near copies among them:
    the first index sets them aside, the finest one finds the copies."""
    rnd = random.Random(8)
    vocabulary = [f"v{i}" for i in range(9000)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows = []
    for share in (30, 55, 85):  # words of 100 that a template has; 85: also the finest one sets them aside
        template = some(share)
        for _ in range(70):
            rows.append((len(rows), " ".join(template + some(100 - share))))
    for i in rnd.sample(range(len(rows)), 40):
        words = rows[i][1].split()
        words[rnd.randrange(90, 100)] = "changed"
        rows.append((len(rows), " ".join(words)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_single_elements_guarantee_a_shared_one():
    """A set that lost no more than its spare units still shares one with each linked set."""
    t = Fraction(3, 4)
    for n in range(1, 200):
        ((scheme, units, spare, found),) = nj.single_elements(np.arange(n, dtype=np.uint64), t)
        assert units == n == len(found) and set(found & nj.SCHEMES) == {scheme}
        for m in range(-(-3 * n // 4), 4 * n // 3 + 1):
            most = nj.limit(n, m, t)
            assert units - most >= spare and (most < n or n == 0)


def test_allocation_costs_least():
    """The estimate is near what sets really take, and fewer or more segments take more."""
    t, rng = Fraction(3, 4), np.random.default_rng(1)
    low, top = 96, 191
    m = nj.segments_of(low, top, t)
    sets = [np.unique(rng.integers(0, 2**63, int(rng.integers(low, top + 1)), dtype=np.int64).astype(np.uint64)) for _ in range(300)]
    band = int(np.searchsorted(nj.EDGES, low, side="right")) - 1
    taken = np.mean([next(len(found) for scheme, _, _, found in nj.signatures(s, t) if scheme == band) for s in sets])
    assert abs(taken / nj.expected_signatures(m, low, top, t) - 1) < 0.1
    assert all(nj.expected_signatures(x, low, top, t) > nj.expected_signatures(m, low, top, t) for x in (m // 2, m * 3 // 2, m * 2))


def test_odd_rows(odd):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_empty(empty):
    assert found(empty) == [] and nj.keep_first(empty).collect() == []


def test_keep_first(odd):
    kept = nj.keep_first(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    texts = {t for _, t in got}
    assert "alone with no id at all" in texts and "same id but another text" in texts
    assert sum(1 for _, t in got if t == "one two") == 1
    assert sum(1 for d, t in got if t and t.startswith("alpha0")) == 1
    assert {t for d, t in got if d in (1, 2, 3)} == {None, "", " \t\n "}


def test_signatures_guarantee_a_shared_one():
    """Any two sets within the limit share a signature, unless both count as short."""
    rng = np.random.default_rng(0)
    t = Fraction(3, 4)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        b = a[rng.random(len(a)) > rng.choice([0, 0.05, 0.12])]
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8)), dtype=np.int64).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and nj.linked(shared, len(a), len(b), t):
            x = {int(s) for *_, sigs in nj.signatures(a, t) for s in sigs}
            y = {int(s) for *_, sigs in nj.signatures(b, t) for s in sigs}
            assert x & y
