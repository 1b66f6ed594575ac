import numpy as np

from attesta.llm import embed_join as ej


def brute(rows, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, links[i], least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df, **more):
    return sorted((tuple(r) for r in ej.link_vectors(df, **more).collect()), key=str)


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(40):
        base = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (base + rng.normal(size=8) * rng.choice([0, 0.05, 0.2])).astype(np.float32).tolist()))
    hot = rng.normal(size=8)
    rows += [(len(rows) + k, (hot + rng.normal(size=8) * 0.15).astype(np.float32).tolist()) for k in range(80)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] + [1.0] * 7), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] + [1.0] * 7)]
    return rows + [(0, rows[0][1]), (908, rows[0][1]), (1, rows[200][1]), (None, rows[3][1]), (None, [0.5] * 4 + [-9.0] * 4), (None, None)]


def test_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for block in (16, 64, 4096):
        assert found(df, block=block) == brute(rows)


def test_double_precision_and_extreme_sizes(spark):
    rows = [(i, [x * 10.0**e for x in v]) for i, (v, e) in enumerate([([1.0, 0.1], 200), ([1.0, 0.1000001], -200), ([0.1, 1.0], 0), ([1.0, 0.2], 300), ([-1.0, 0.0], 0)])]
    want = [(0, 2, 0, True), (1, 2, 0, False), (2, 0, 2, True), (3, 2, 0, False), (4, 0, 4, True)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == want


def test_many_vectors_that_are_not_fit(spark):
    rows = [(i, None if i % 2 else [0.0, 0.0]) for i in range(500)] + [(600, [1.0, 0.0]), (601, [1.0, 0.0])]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got == brute(rows)


def test_clusters_in_many_groups(spark):
    """Tight clusters in 16 dimensions over dozens of pivots, so that groups and cells are left out."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + rng.normal(size=16) * rng.choice([0.01, 0.1, 0.3])).astype(np.float32).tolist()) for i in range(900)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), block=20) == brute(rows)


def test_clash_and_empty(spark):
    schema = "vec_id long, embedding array<float>, v int, rep int, key string, fit boolean"
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 1, "k", True), (2, [1.0, 0.1], 1, 1, "k", True)], schema)
    assert found(df) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert found(spark.createDataFrame([], schema)) == []


def test_forest():
    a, b = ej.forest(np.array([3, 5, 9, 4]), np.array([5, 7, 8, 3]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(4, 3), (5, 3), (7, 3), (9, 8)]
