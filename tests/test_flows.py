import json

from pyspark.sql import functions as F

from attesta.plans import flows
from attesta.sources import readers

PAYLOAD = json.dumps({"data": {"verses": [{"verse": 1, "text": "En el principio creó Dios los cielos"}, {"text": "y la tierra estaba sin orden, y muy vacía entonces"}, {"verse": 2, "text": "otra"}]}})


def payloads(spark, *more):
    return spark.createDataFrame([("Gen", 1, PAYLOAD), ("Gen", 2, '{"success": false}'), *more], "book string, chapter int, payload string")


def test_audit_flow(spark):
    q = spark.createDataFrame(
        [("a", "Gen", 1, 1, 1, ["Dios"], [], []), ("b", "Gen", 1, 2, 2, ["otra"], [], []), ("c", "Gen", 2, 1, 1, ["x"], [], [])],
        "id string, book string, chapter int, verse_start int, verse_end int, support_terms array<string>, explanation_terms array<string>, distractors array<string>",
    )
    got = {r.id: r.verdict for r in flows.audit_flow(q, payloads(spark)).collect()}
    assert got == {"a": "VERIFICADO_DIRECTO", "b": "VERIFICADO_DIRECTO", "c": "REQUIERE_REVISION"}


def test_extraction_report(spark):
    rows = {r.chapter: r for r in flows.extraction_report(payloads(spark)).collect()}
    assert (rows[1].verse_count, rows[1].duplicates, rows[1].sequential) == (3, [2], False)
    assert (rows[2].verse_count, rows[2].duplicates, rows[2].sequential) == (0, [], False)
    assert (rows[1].text_nodes_detected, rows[1].character_count_detected, rows[1].code) == (3, sum(len(v["text"]) for v in json.loads(PAYLOAD)["data"]["verses"]), 0)
    assert (rows[2].text_nodes_detected, rows[2].code) == (0, 22) and rows[1].processed_at_utc.endswith("+00:00")
    assert flows.stage_code(flows.extraction_report(payloads(spark))) == 22 and flows.stage_code(flows.extraction_report(payloads(spark).filter("chapter = 1"))) == 0
    none = spark.createDataFrame([("Gen", 3, '{"data": {"text": "  "}}'), ("Gen", 3, "no JSON")], "book string, chapter int, payload string")
    assert [(r.code, r.text_nodes_detected, r.character_count_detected) for r in flows.extraction_report(none).collect()] == [(30, 1, 2)]


def test_consolidated_report(spark):
    files = spark.createDataFrame([("a.js", "js", "x\neval (y)"), ("b.css", "css", "a{}")], "path string, suffix string, text string")
    metrics = spark.createDataFrame([(10, 200)], "bytes long, requests long")
    scenarios = spark.createDataFrame([("storage", False, "gone"), ("fine", True, None)], "scenario string, success boolean, error string")
    header, found = flows.consolidated_report(files, metrics, scenarios)
    row = header.first()
    assert (row.files, row.n_findings) == (2, 1) and [(f.subject, f.line) for f in found.collect()] == [("a.js", 2)]
    assert [(f.label, f.message) for f in row.failures] == [("security", "1 findings"), ("performance", "requests 200 over 100"), ("resilience-storage", "gone")]
    assert flows.consolidated_report(files.filter("path = 'b.css'"))[0].first().failures == []


def response(*items):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": json.dumps({"items": list(items)})}]}}]})


def item(n, **change):
    return {"verse_number": n, "question": f"¿Pregunta {n}?", "options": ["a", "b", "c", "d"], "correct_answer": "a", "explanation": "e", "difficulty": "easy", "category": "c"} | change


def test_generation_flow(spark):
    two = json.dumps([{"text": "uno"}, {"text": "dos"}])
    passages = spark.createDataFrame([("1 Rey", c, two) for c in range(1, 6)], "book string, chapter int, payload string")
    raws = [response(item(1), item(2)), response(item(2), item(1)), response(item(1), item(2, difficulty="x")), "{}", response(item(1))]
    responses = spark.createDataFrame([("1 Rey", c, r) for c, r in enumerate(raws, 1)], "book string, chapter int, raw string")
    rows, errors = flows.generation_flow(passages, responses)
    assert [r.id for r in rows.orderBy("verse_number").collect()] == ["1_REY_001_001", "1_REY_001_002"]
    assert {r.chapter: r.error for r in errors.collect()} == {2: "verse_numbers", 3: "unknown_difficulty", 4: "no_items", 5: "verse_numbers"}


def test_restore(spark):
    q = spark.createDataFrame([(i, f"q{i}", [(o,) for o in "abc"]) for i in (1, 2, 3)], "pos int, id string, options array<struct<id:string>>")

    def record(current, completed, **answers):
        return json.dumps({"version": 1, "currentQuestionId": current, "answers": answers, "completed": completed})

    cases = {
        "next": (record("q2", False, q1="a"), (1, 1, False, True)), "last": (record("q1", False, q1="a"), (1, 0, False, True)), "gap": (record("q3", False, q1="a", q3="b"), (1, 1, False, True)),
        "unknown": (record("q9", False, q1="z"), (0, 0, False, False)), "rejected": (record("q3", False), (0, 0, False, True)), "all": (record("q3", False, q1="a", q2="b", q3="c"), (3, 2, False, True)),
        "done": (record("q1", True, q1="a", q2="b", q3="c"), (3, 2, True, True)), "early": (record("q2", True, q1="a"), (1, 1, False, True)), "broken": ("{", (0, 0, False, False)),
    }
    stored = spark.createDataFrame([(k, raw) for k, (raw, _) in cases.items()], "user_id string, raw string")
    got = {r.user_id: tuple(r)[1:] for r in flows.restore(q, stored).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}
    made = spark.range(1).select(flows.progress_record(F.lit("q1"), F.create_map(F.lit("q1"), F.lit("a")), F.lit(False)).alias("raw")).first().raw
    assert json.loads(made) == {"version": 1, "currentQuestionId": "q1", "answers": {"q1": "a"}, "completed": False}


GOOD = {
    "index.html": '<html><head><title>t</title><link rel="canonical" href="https://s/"><link rel="icon" href="favicon.svg">'
    + "".join(f'<meta name="{n}" content="c">' for n in ("description", "twitter:card", "twitter:title", "twitter:description"))
    + '<meta name="twitter:image" content="i.png">'
    + "".join(f'<meta property="og:{n}" content="c">' for n in ("site_name", "title", "description", "url"))
    + '<meta property="og:image" content="i.png"></head><body id="top"><a href="privacy/#p">p</a><a href="#top">t</a></body></html>',
    "privacy/index.html": '<html><head><title>p</title><meta name="description" content="d"><link rel="canonical" href="https://s/privacy/"></head><body id="p"><a href="../index.html#top">h</a></body></html>',
    "sitemap.xml": '<urlset xmlns="http://s"><url><loc>https://s/</loc></url><url><loc>https://s/privacy/</loc></url></urlset>',
    "favicon.svg": "<svg/>", "README.md": "r", ".nojekyll": "", "i.png": "", "a.css": "a{background:url('i.png')} b{src:url(#x)}",
}


def site_of(spark, tmp_path, **change):
    for name, text in (GOOD | change).items():
        if text is not None:
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(text)
    files = readers.repository_files(spark, str(tmp_path), (".git", "build"))
    return sorted((r.check_name, r.subject, r.detail) for r in flows.site_findings(files).collect())


def test_a_good_site_has_no_findings(spark, tmp_path):
    assert site_of(spark, tmp_path) == []
    files = readers.repository_files(spark, str(tmp_path), (".git",))
    assert flows.exit_code(flows.site_findings(files)) == 0
    counts, found = flows.security_report(files)
    assert tuple(counts.first()) == (3, 0) and found.count() == 0


def test_findings(spark, tmp_path):
    change = {
        "README.md": "<<<<<<< HEAD\n", "favicon.svg": None, "a.css": "a{background:url( gone.png )}", "bad.html": '<p id=x></p><p id=x><a href="/root">r</a><a href="../up">u</a><a href="index.html#no">n</a>',
        "sitemap.xml": "<urlset><url><loc>http://s/</loc></url><url><loc>https://s/</loc></url><url><loc>https://s/</loc></url></urlset>",
    }
    assert site_of(spark, tmp_path, **change) == [
        ("conflict", "README.md", "merge-conflict marker"), ("css", "a.css", "broken url() gone.png"), ("html", "bad.html", "broken href ../up"), ("html", "bad.html", "duplicate id x"),
        ("html", "bad.html", "missing <body>"), ("html", "bad.html", "missing <head>"), ("html", "bad.html", "missing <html>"), ("html", "bad.html", "missing fragment #no"),
        ("html", "bad.html", "missing or empty <title>"), ("html", "index.html", "broken href favicon.svg"), ("required", "favicon.svg", "missing file"),
        ("sitemap", "privacy/index.html", "canonical not listed: https://s/privacy/"), ("sitemap", "sitemap.xml", "duplicate_loc https://s/"), ("sitemap", "sitemap.xml", "not_https http://s/"),
    ]


def test_the_sites_own_address(spark, tmp_path):
    """With a host: absolute links to the site are followed, and the home page's canonical and og:url must be its address."""
    site_of(spark, tmp_path, **{"a.css": "a{background:url(https://s/gone.png)} b{background:url(https://else/gone.png)}"})
    files = readers.repository_files(spark, str(tmp_path), (".git", "build"))
    found = {(r.check_name, r.subject, r.detail) for r in flows.site_findings(files, "s").collect()}
    plain = {(r.check_name, r.subject, r.detail) for r in flows.site_findings(files).collect()}
    assert ("css", "a.css", "broken url() https://s/gone.png") in found - plain
    other = {(r.check_name, r.detail) for r in flows.site_findings(files, "t", "/p/").collect()} - {(c, d) for c, _, d in plain}
    assert {c for c, _ in other} == {"seo"} and all(" mismatch: " in d for _, d in other) and len(other) == 2


def test_an_empty_sitemap(spark, tmp_path):
    assert ("sitemap", "sitemap.xml", "no loc entries") in site_of(spark, tmp_path, **{"sitemap.xml": "<urlset/>"})
