import random

from attesta.operators import copies


def test_matches_may_begin_inside_a_word(spark, monkeypatch):
    source = "lmost every word of this sentence is copied from it"
    texts = spark.createDataFrame([(1, "Almost  every word of THIS sentence is copied from items"), (2, "every word of this sentence is copied"), (3, None), (4, ""), (5, "x" * 60)], "t long, text string")
    sources = spark.createDataFrame([(7, source), (8, "short"), (9, "x" * 45), (10, None)], "s long, text string")
    for small in (copies.SMALL, -1):
        monkeypatch.setattr(copies, "SMALL", small)
        assert sorted(map(tuple, copies.verbatim_copies(texts, sources, "t", "s").collect())) == [(1, 7), (5, 9)]


def test_sources_of_few_words(spark):
    """One to four long words, anywhere in a text, also inside its words; against all pairs."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    sources = [(k, " ".join(word(rnd.randrange(8, 24)) for _ in range(1 + k % 4)) + word(40 if k % 4 == 0 else 0)) for k in range(24)]
    texts = [(k, " ".join([word(9), word(2) + sources[k % 24][1] + word(rnd.randrange(4)), word(30)])) for k in range(24)]
    texts += [(100 + k, s[1:]) for k, s in sources] + [(200, sources[0][1]), (201, word(500)), (202, "a " * 60)]
    df = spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(sources, "s long, text string")
    want = sorted((t, s) for t, x in texts for s, y in sources if len(y) >= copies.MIN_COPY and y in " ".join(x.split()))
    assert sorted(map(tuple, copies.verbatim_copies(*df, "t", "s").collect())) == want and {s % 4 for _, s in want} == {0, 1, 2, 3}
    assert copies.verbatim_copies(df[0], df[1].limit(0), "t", "s").collect() == []
