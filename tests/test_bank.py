import json

import pytest

from pyspark.sql import functions as F

from attesta.operators import bank
from attesta.plans import flows
from attesta.plans import content
from attesta.sources import readers

GOOD = {
    "id": "qb-a-001", "version": 1, "status": "approved", "language": "es", "category": "eventos", "difficulty": "beginner", "contentType": "textual_fact",
    "prompt": "¿Quién hizo la luz?", "options": [{"id": x, "text": f"t{x}"} for x in "abc"], "correctOptionId": "a", "explanation": "Una explicación de veinte letras.",
    "references": [{"book": "Génesis", "chapter": 1, "verseStart": 3, "display": "Génesis 1:3", "translation": "Una"}], "tags": ["luz"],
    "review": {"referenceChecked": True, "singleCorrectAnswerChecked": True, "doctrinalSensitivity": "none", "notes": ""},
}
BAD = {
    "status": {"status": "draft"}, "two_options": {"options": GOOD["options"][:2]}, "no_answer": {"correctOptionId": "d"}, "blank_prompt": {"prompt": "  "},
    "blank_explanation": {"explanation": ""}, "no_references": {"references": []}, "blank_display": {"references": [{"display": " "}]}, "null_options": {"options": None},
    "null_answer": {"correctOptionId": None},
}


@pytest.fixture(scope="module")
def questions(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bank") / "bank.json"
    rows = [GOOD] + [GOOD | {"id": f"qb-{k.replace('_', '-')}"} | v for k, v in BAD.items()]
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    return readers.question_bank(spark, str(path))


def test_playable(questions):
    assert [r.id for r in questions.filter(bank.is_playable()).collect()] == ["qb-a-001"]
    assert questions.filter(~bank.is_playable()).count() == len(BAD)


def test_content_rules(questions):
    found = {}
    for r in bank.violations(questions, bank.content_rules()).collect():
        found.setdefault(r.id, set()).add(r.rule)
    assert "qb-a-001" not in found
    assert found["qb-two-options"] == {"options_count"} and found["qb-no-references"] == {"has_reference"}
    assert found["qb-blank-explanation"] == {"explanation_length"} and "reference_fields" in found["qb-blank-display"]
    assert bank.violations(questions, bank.policy_rules()).filter("id = 'qb-a-001'").count() == 0


ITEM = "b int, verse_number int, question string, explanation string, category string, difficulty string, correct_answer string, options array<string>, source string"
TEXT = "este es un versículo bastante largo que no debe copiarse"


def test_rules_in_order(spark):
    ok = ("¿Qué?", "porque", "eventos", "easy", "uno", [" uno", "dos", "tres", "cuatro"], TEXT)

    def but(**change):
        names = ("question", "explanation", "category", "difficulty", "correct_answer", "options", "source")
        return tuple(change.get(n, v) for n, v in zip(names, ok, strict=True))

    rows = [
        ok, but(question=" "), but(question="Juan 3:16 ¿qué?"), but(question=" ¿QUÉ? "), but(question="q5", options=["a", "b", "c"]), but(question="q6", options=["a", "A ", "c", "d"]),
        but(question="q7", correct_answer="Uno"), but(question="q8", difficulty="x"), but(question=f"q9 {TEXT.upper()}"), but(question="q10", explanation=f"  {TEXT}  ."),
        but(question="Juan 3:16 otra vez", options=[]), but(question="q12", source="corto"), but(question="q13", options=None),
    ]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ITEM)
    got = [r.error for r in bank.item_errors(df, ["b"]).orderBy("verse_number").collect()]
    assert got == [
        None, "missing_field", "citation_in_question", "duplicate_question", "option_count", "duplicate_option", "answer_not_in_options", "unknown_difficulty",
        "source_copied", "source_copied", "citation_in_question", None, "option_count",
    ]
    assert bank.first_error(bank.item_errors(df, ["b"]), ["b"]).first().error == "missing_field"
    assert bank.first_error(bank.item_errors(df.limit(1), ["b"]), ["b"]).first().error is None


def test_items_that_are_no_objects(spark):
    """They come before all other rules of the item; the numbers of the objects alone are compared."""
    good = {"verse_number": 1, "question": "q", "options": list("abcd"), "correct_answer": "a", "explanation": "e", "difficulty": "easy", "category": "c"}
    two = json.dumps([{"text": "uno"}, {"text": "dos"}])
    raws = {1: [good, {**good, "verse_number": 2, "question": "r"}], 2: [good, "text", {**good, "verse_number": 2}], 3: [good, {**good, "verse_number": 2, "question": None}], 4: [good, {**good, "verse_number": 2, "question": "None"}]}
    passages = spark.createDataFrame([("B", c, two) for c in raws], "book string, chapter int, payload string")
    answers = spark.createDataFrame([("B", c, recorded(x)) for c, x in raws.items()], "book string, chapter int, raw string")
    rows, errors = flows.generation_flow(passages, answers)
    assert {(r.chapter, r.error) for r in errors.collect()} == {(2, "not_an_object")}
    assert {(r.id, r.question) for r in rows.collect()} == {("B_001_001", "q"), ("B_001_002", "r"), ("B_003_001", "q"), ("B_003_002", "None"), ("B_004_001", "q"), ("B_004_002", "None")}


def test_number_lists(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 3), (3, 1, 1)], "k int, pos int, verse_number int")
    b = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 1)], "k int, pos int, verse_number int")
    assert {r.k: r.equal for r in bank.number_lists_equal(a, b, ["k"]).collect()} == {1: True, 2: False, 3: False}


def recorded(items):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": items if isinstance(items, str) else json.dumps({"items": items})}]}}]})


def test_recorded_response(spark):
    item = {"verse_number": 1.0, "question": " q ", "options": ["a ", None, 3, True], "correct_answer": None, "explanation": 5, "difficulty": False, "category": ["x"]}
    rows = [recorded([item, "text", None, {"verse_number": "1", "options": "no"}, [1]]), recorded('{"items": {}}'), recorded("{"), "{}", None]
    got = [r.g for r in spark.createDataFrame([(x,) for x in rows], "raw string").select(bank.generated_items(F.col("raw")).alias("g")).collect()]
    assert got[1:] == [None] * 4 and [x.is_object for x in got[0]] == [True, False, False, True, False]
    first, odd = got[0][0], got[0][3]
    assert (first.verse_number, first.question, first.options, first.correct_answer, first.explanation, first.difficulty, first.category) == (1, "q", ["a", "None", "3", "True"], "None", "5", "False", '["x"]')
    assert (odd.verse_number, odd.options, odd.question) == (None, None, "")


def test_bank_rows_and_guards(spark):
    df = spark.createDataFrame([("1 Reyes", 2, 7, " q ", [" a"], "a ", "e", "easy", "c")], "book string, chapter int, verse_number int, question string, options array<string>, correct_answer string, explanation string, difficulty string, category string")
    r = bank.bank_rows(df).first()
    assert (r.id, r.reference, r.question, r.options, r.correct_answer) == ("1_REYES_002_007", "1 Reyes 2:7", "q", ["a"], "a")
    bank.parameters_ok(1, " rvr ", "RVR", "key")
    for bad in ((0, "RVR", "RVR", "k"), (1, "X", "RVR", "k"), (1, "RVR", "RVR", " ")):
        with pytest.raises(ValueError):
            bank.parameters_ok(*bad)


def test_audit_spec(spark, tmp_path):
    spec = {"book": "Gen", "chapter": 1, "version": " rvr ", "questions": [{"id": "x", "verse_start": 1, "support_terms": ["a"]}]}
    (tmp_path / "a.json").write_text(json.dumps(spec))
    (tmp_path / "b.json").write_text(json.dumps({"book": "Gen", "chapter": 2}))
    rows = readers.audit_spec(spark, str(tmp_path)).collect()
    assert [(r.book, r.version, r.id, r.verse_start, r.verse_end) for r in rows] == [("Gen", "RVR", "x", 1, None)]


def test_items_of_whole_texts(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(100))
    far = {1: words + " a", 2: words + " 3:16 " + words + " " * 800, 13: words * 2, 16: words * 2, 17: words + words.upper()}
    spark.createDataFrame([(i, t, "en", "s") for i, t in far.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.error for r in content.QUERIES["q16_validate_first_error"](spark, str(tmp_path)).collect()}
    assert got[2] == "citation_in_question" and got[16] == "duplicate_question" and got[1] is None


def test_ids_are_not_taken_up_again(spark):
    schema = "version int, id string, status string, text string"
    banks = [
        (1, "a", "approved", "x"), (1, "b", "approved", "x"), (1, "c", "retired", "x"), (1, "d", "approved", "x"), (1, "e", "draft", "x"),
        (2, "a", "approved", "y"), (2, "b", "retired", "x"), (2, "c", "retired", "x"), (2, "e", "draft", "x"),
        (4, "a", "approved", "y"), (4, "c", "retired", "x"), (4, "e", "approved", "x"),
    ]
    former = bank.history(spark.createDataFrame(banks, schema), ["text"])
    got = {(r.id, r.status, r.since, r.until) for r in former.collect()}
    assert got == {
        ("a", "approved", 1, 2), ("a", "approved", 2, None), ("b", "approved", 1, 2), ("b", "retired", 2, 4), ("c", "retired", 1, None), ("d", "approved", 1, 2), ("e", "draft", 1, 4), ("e", "approved", 4, None),
    }
    new = [(5, "a", "approved", "z"), (5, "b", "retired", "x"), (5, "c", "approved", "x"), (5, "d", "approved", "other"), (5, "e", "approved", "x"), (5, "f", "approved", "x")]
    rows = spark.createDataFrame(new, schema)
    assert {(r.id, r.rule) for r in bank.reused_ids(former, rows, 5, ["text"]).collect()} == {("c", "retired_id_reused"), ("d", "withdrawn_id_reused")}
    again = rows.withColumn("text", F.lit("x")).filter("id IN ('b', 'd')").withColumn("status", F.lit("draft"))
    assert {(r.id, r.rule) for r in bank.reused_ids(former, again, 5, ["text"]).collect()} == {("b", "retired_id_reused")}
    assert bank.reused_ids(former, rows, 1, ["text"]).count() == 0
