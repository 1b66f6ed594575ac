import hashlib
import unicodedata

from attesta.functions import text as tx
from attesta.operators import audit as au
from attesta.operators import passages
from attesta.sources import sinks

QUESTION = "id string, book string, chapter int, verse_start int, verse_end int, support_terms array<string>, explanation_terms array<string>, distractors array<string>"
VERSES = [("Gen", 1, 1, "En el principio creó Dios"), ("Gen", 1, 2, "y la tierra estaba vacía"), ("Gen", 1, 3, "sea la luz")]


def run(spark, *questions):
    verses = spark.createDataFrame(VERSES, "book string, chapter int, verse_number int, text string")
    rows = au.audit(spark.createDataFrame(questions, QUESTION), verses).collect()
    return {r.id: r for r in rows}


def test_verdicts(spark):
    got = run(
        spark,
        ("ok", "Gen", 1, 1, 2, ["Creó Dios", "tierra"], ["vacía"], ["el mar", "de la"]),
        ("one", "Gen", 1, 3, None, ["LUZ"], [], []),
        ("conflict", "Gen", 1, 3, 3, ["luz"], [], ["la luz"]),
        ("lacking", "Gen", 1, 1, 1, ["mar"], ["cielo", "Dios"], None),
    )
    assert got["ok"].verdict == au.VERIFIED and got["ok"].reference == "Gen 1:1-2"
    assert got["ok"].passage_sha256 == hashlib.sha256(f"{VERSES[0][3]} {VERSES[1][3]}".encode()).hexdigest()
    assert got["one"].verdict == au.VERIFIED and got["one"].reference == "Gen 1:3"
    assert got["conflict"].verdict == au.REVIEW and got["conflict"].distractor_conflicts == ["la luz"]
    assert got["lacking"].missing_support_terms == ["mar"] and got["lacking"].missing_explanation_terms == ["cielo"]
    assert not any(r.source_text_persisted for r in got.values())


def test_empty_and_partial_ranges(spark):
    got = run(spark, ("empty", "Gen", 1, 5, 3, ["luz", "¡!"], [], ["luz"]), ("part", "Gen", 1, 3, 5, ["luz"], ["noche"], []), ("none", "Ex", 1, 1, 2, [], [], []))
    e = got["empty"]
    assert e.reference_exists and e.passage_sha256 == hashlib.sha256(b"").hexdigest()
    assert e.missing_support_terms == ["luz"] and e.distractor_conflicts == [] and e.reference == "Gen 1:5-3"
    p = got["part"]
    assert not p.reference_exists and p.passage_sha256 is None and p.missing_support_terms == [] and p.missing_explanation_terms == ["noche"]
    assert not p.direct_answer_support and not got["none"].reference_exists


def test_containment_is_of_substrings(spark):
    assert run(spark, ("s", "Gen", 1, 1, 2, ["dios y la"], ["princip"], []))["s"].verdict == au.VERIFIED


def test_summary_report_and_redaction(spark):
    verses = spark.createDataFrame(VERSES, "book string, chapter int, verse_number int, text string")
    questions = spark.createDataFrame([("a", "Gen", 1, 1, 1, ["Dios"], [], []), ("b", "Gen", 1, 1, 1, ["mar"], [], [])], QUESTION)
    results = au.audit(questions, verses)
    assert tuple(au.summary(results).first()) == (2, 1, 1)
    text = sinks.json_document(au.report(results, book="Gen", chapter=1)).first().value
    assert '"passage_sha256"' in text and "principio" not in text and text.startswith("{\n")
    assert sinks.leaks(results, verses).count() == 0
    long = spark.createDataFrame([("x" * 10 + " some words that are copied from the source text here " + "y",)], "note string")
    source = spark.createDataFrame([("Some  words that are COPIED from the source text here",), ("short",)], "text string")
    assert [r.column for r in sinks.leaks(long, source).collect()] == ["note"]
    assert sinks.redacted(source, "text").columns == ["source_text_persisted"]


def test_last_wins_and_numbers(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 3, "c", 3), (2, 1, "d", 1), (2, 2, "e", 2)], "k int, n int, text string, pos int")
    from pyspark.sql import functions as F

    assert sorted(map(tuple, passages.last_wins(rows, ["k", "n"], F.col("pos"), "text").collect())) == [(1, 1, "b"), (1, 3, "c"), (2, 1, "d"), (2, 2, "e")]
    assert [(r.k, r.duplicates) for r in passages.duplicate_numbers(rows, ["k"], "n").collect()] == [(1, [1])]
    assert {r.k: r.sequential for r in passages.sequential(rows, ["k"], "n", "pos").collect()} == {1: False, 2: True}


def test_decomposed_and_other_scripts(spark):
    """Verdicts do not depend on the form of the text, nor on its script."""
    verses = [("D", 1, 1, unicodedata.normalize("NFD", "la canción según José")), ("D", 1, 2, "ΕΝ ΑΡΧΗ και Йод 12"), ("D", 1, 3, "el ﬁn de la ofﬁcina")]
    texts = spark.createDataFrame(verses, "book string, chapter int, verse_number int, text string")
    asked = [
        ("nfd", "D", 1, 1, 1, ["canción", unicodedata.normalize("NFD", "según")], ["JOSÉ"], [unicodedata.normalize("NFD", "canción")]),
        ("greek", "D", 1, 2, 2, ["12", "αρχη"], [], ["λογος"]),
        ("ligature", "D", 1, 3, 3, ["fin", "oﬃcina"], ["officina"], ["ﬁn"]),
    ]
    got = {r.id: r for r in au.audit(spark.createDataFrame(asked, QUESTION), texts).collect()}
    for q in asked:
        norm = tx.normalize_one(next(v[3] for v in verses if v[2] == q[3]))
        assert got[q[0]].missing_support_terms == [t for t in q[5] if tx.normalize_one(t) and tx.normalize_one(t) not in norm] == []
        tokens = {d: [t for t in tx.normalize_one(d).split() if len(t) >= 3 and t not in tx.STOPWORDS] for d in q[7]}
        assert got[q[0]].distractor_conflicts == [d for d, ts in tokens.items() if ts and all(t in norm for t in ts)]
    assert got["nfd"].distractor_conflicts and not got["greek"].distractor_conflicts
