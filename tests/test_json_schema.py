import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import json_schema as js
from attesta.plans import question_schema as qs


def found(spark, schema, *documents):
    rows = [(i, d if isinstance(d, str) or d is None else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(documents)]
    out = [[] for _ in documents]
    for r in js.violations(spark.createDataFrame(rows, "k int, raw string"), schema, "k").collect():
        out[r.k].append((r.pointer, r.keyword, r.detail))
    return [sorted(x) for x in out]


GOOD = {
    "id": "qb-a-1", "version": 1, "status": "draft", "language": "es", "category": "ab", "difficulty": "advanced", "contentType": "contextual", "prompt": "¿" * 10,
    "options": [{"id": x, "text": x} for x in "abc"], "correctOptionId": "a", "explanation": "x" * 20,
    "references": [{"book": "Gé", "chapter": 1, "verseStart": 1, "display": "Gé 1"}], "tags": [], "review": {"referenceChecked": True, "singleCorrectAnswerChecked": False, "doctrinalSensitivity": "none", "notes": ""},
}


def but(**change):
    return {k: v for k, v in (GOOD | change).items() if v is not ...}


def test_the_published_schema(spark):
    more = {"book": "Gé", "chapter": 1, "verseStart": 1.0, "verseEnd": 0, "display": "Gé 1", "note": None, "x/y~z": 1}
    cases = [
        (GOOD, []), (but(version=1.0), []), (but(version=True), [("/version", "const", "")]), (but(id=...), [("", "required", "id")]), (but(id=None), [("/id", "type", "null")]),
        (but(options=GOOD["options"] + [{"id": "e"}]), [("/options/3", "required", "text"), ("/options/3/id", "pattern", "")]), (but(options=GOOD["options"][:1] * 3), [("/options", "uniqueItems", "")]),
        (but(options="abc"), [("/options", "type", "string")]), (but(references=[more]), [("/references/0", "additionalProperties", "x/y~z"), ("/references/0/note", "type", "null"), ("/references/0/verseEnd", "minimum", "")]),
        (but(references=[3, {}]), [("/references/0", "type", "integer"), *(("/references/1", "required", k) for k in ("book", "chapter", "display", "verseStart"))]),
        (but(review={**GOOD["review"], "who": "me", "notes": "n" * 501}), [("/review", "additionalProperties", "who"), ("/review/notes", "maxLength", "")]),
        (but(prompt="\U0001f600" * 240), []), (but(prompt="\U0001f600" * 241), [("/prompt", "maxLength", "")]), ([], [("", "type", "array")]), ("{", [("", "json", "")]), (None, [("", "json", "")]),
        (but(tags=["ab", 5, "A"]), [("/tags/1", "type", "integer"), ("/tags/2", "minLength", ""), ("/tags/2", "pattern", "")]),
    ]
    assert found(spark, qs.QUESTION, *(d for d, _ in cases)) == [sorted(w) for _, w in cases]


def test_keywords(spark):
    schema = {
        "type": ["object", "null"],
        "properties": {
            "n": {"type": "number", "minimum": 0.5, "maximum": 2}, "e": {"enum": ["a", 1, None, True, [1, "x"]]}, "it's": {"type": "boolean"}, "a": {"type": "array", "items": {"type": "array", "maxItems": 1, "items": {"type": "integer"}}},
        },
    }
    cases = [
        ({}, []), ("null", []), ({"n": 1, "other": 1}, []), ({"n": 0.4}, [("/n", "minimum", "")]), ({"n": 2.5}, [("/n", "maximum", "")]), ({"n": "2"}, [("/n", "type", "string")]),
        *(({"e": v}, []) for v in ("a", 1, 1.0, None, True, [1, "x"])), *(({"e": v}, [("/e", "enum", "")]) for v in ("b", 2, False, [1], {})),
        ({"it's": "no"}, [("/it's", "type", "string")]), ({"a": [[1], [1, 2.5], "x"]}, [("/a/1", "maxItems", ""), ("/a/1/1", "type", "number"), ("/a/2", "type", "string")]),
    ]
    assert found(spark, schema, *(d for d, _ in cases)) == [sorted(w) for _, w in cases]


def test_what_cannot_be_compiled(spark):
    for wrong in ({"oneOf": []}, {"$ref": "other.json"}, {"$ref": "#"}, {"additionalProperties": {"type": "string"}}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "items": {"$ref": "#/$defs/a"}}):
        with pytest.raises(ValueError):
            js.compiled(wrong, F.lit("{}"))


def test_no_python_in_the_plan(spark):
    df = js.violations(spark.createDataFrame([(1, "{}")], "k int, raw string"), qs.QUESTION, "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
