from attesta.llm import decontam as dc


def brute(docs, items, n=5):
    def grams(words, k):
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    out = []
    for d, t in docs:
        words = (t or "").encode().lower().split()
        held = []
        for i, s in items:
            other = (s or "").encode().lower().split()
            k = min(n, len(other))
            if i is not None and k:
                want = grams(other, k)
                if 100 * len(want & grams(words, k)) >= 75 * len(want):
                    held.append(i)
        out.append((d, len(held), ",".join(map(str, sorted(held))), bool(held)))
    return sorted(out, key=str)


def found(docs, items, **more):
    return sorted((tuple(r) for r in dc.digest(dc.find_items(docs, items, **more)).collect()), key=str)


def table(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    odd = spark.createDataFrame([(900, "the of"), (901, ""), (902, None), (903, "Thntandti"), (0, "one two"), (904, "one two three four five six")], items.schema)
    return items.unionByName(odd)


def test_both_ways_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = table(spark, sf)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items) == want
    assert found(docs, items, max_index=0) == want
    assert any(r[1] for r in want)


def test_odd_rows(spark, sf, odd, empty):
    items = table(spark, sf)
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(odd, items) == want and found(odd, items, max_index=0) == want
    assert found(empty, items) == []
    assert not any(r[1] for r in found(odd, items.limit(0)))


def test_stage_drops_what_is_found(odd, spark, sf, monkeypatch):
    items = table(spark, sf)
    bad = {(r.id, len(r["items"])) for r in dc.find_items(odd, items).collect() if r["items"]}
    for most in (dc.MAX_INDEX, 0):
        monkeypatch.setattr(dc, "MAX_INDEX", most)
        kept = dc.drop_contaminated(odd, items)
        assert kept.columns == odd.columns
        assert kept.count() == odd.count() - 2 and {i for i, _ in bad} == {4}


def test_repeated_ids_both_ways(spark):
    a = [f"a{i}" for i in range(12)]
    b = [f"b{i}" for i in range(12)]
    rows = [(5, a), (5, a), (6, a), (6, b), (7, [*a[:6], *b[:6]]), (7, [*b[6:], *a[6:]])]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join([*a[:9], "x", *b[:9]])), (3, " ".join(a + b))], "doc_id long, text string")
    want = [(1, 2, "5,6", True), (2, 0, "", False), (3, 2, "5,6", True)]
    assert found(docs, items) == want and found(docs, items, max_index=0) == want
    both = [sorted(dc.find_items(docs, items, max_index=m).collect()) for m in (dc.MAX_INDEX, 0)]
    assert both[0] == both[1]


def test_either_side_is_looked_up_in_the_longer(spark):
    """A short text against a large index and a long text against a small one find the same as brute force."""
    import random

    rnd = random.Random(5)
    items = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 30)))) for i in range(300)]
    docs = [(i, " ".join([f"x{i}", items[rnd.randrange(300)][1], *(f"w{rnd.randrange(400)}" for _ in range(rnd.choice([0, 3, 4000])))])) for i in range(40)]
    index = dc.Index([(i, t.encode()) for i, t in items])
    want = {d: (n, found) for d, n, found, _ in brute(docs, items)}
    for d, t in docs:
        got = index.search(dc.word_hashes([t.encode()])[0])
        assert (len(got), ",".join(str(x["item_id"]) for x in got)) == want[d]


def test_the_shuffle_gets_no_more_than_what_items_have(spark, sf, monkeypatch):
    """Repeated rows in many copies, a filter that is almost full, and one that lets hardly anything pass: all give the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.filter("doc_id % 10 = 0")).unionByName(docs.filter("doc_id % 10 = 0"))
    items = table(spark, sf)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items, max_index=0) == want
    monkeypatch.setattr(dc, "FILTER_BITS", dc.PIECE)
    assert found(docs, items, max_index=0) == want
    plan = dc.find_items(docs, items, max_index=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "any_value" not in plan
