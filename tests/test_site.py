import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.operators import scan, site
from attesta.plans import flows, sites
from attesta.sources import readers

PAGE = """<!DOCTYPE html><html><head><title> A
 &amp;  b</title><meta name="Description" content=" d "><meta property="og:title" content="t"><meta property="og:title" content="">
<link rel="Canonical" href="https://x/"><link rel="shortcut icon" href="i.png"></head><body id="top"><a href="#top">t</a><a id=top href="a/b.html#s">b</a>
<img src="p.png" srcset="q.png 1x, r.png 2x"><video src="v.mp4" poster="w.png"></video></body></html>"""


def test_facts():
    found = site.facts_of(PAGE)
    refs = [(k, v) for kind, k, v in found if kind == "ref"]
    assert refs == [("href", "https://x/"), ("href", "i.png"), ("href", "#top"), ("href", "a/b.html#s"), ("src", "p.png"), ("srcset", "q.png"), ("srcset", "r.png"), ("src", "v.mp4"), ("poster", "w.png")]
    assert ("canonical", "", "https://x/") in found and ("icon", "", "i.png") in found and ("name", "description", "d") in found
    assert [k for kind, k, _ in found if kind == "id"] == ["top", "top"] and found[-1] == ("title", "", "A & b")


def test_fact_tables(spark):
    pages = spark.createDataFrame([("i.html", PAGE), ("e.html", None)], "path string, html string")
    facts = site.html_facts(pages, "path", "html")
    assert [(r.path, r.id) for r in site.duplicate_ids(facts, "path").collect()] == [("i.html", "top")]
    meta = {r.key: r.value for r in site.last_value(facts, "path", "property").collect()}
    assert meta == {"og:title": ""}
    names = facts.filter("kind = 'name' AND value <> ''")
    lacking = {r.key for r in site.missing(pages.filter("path = 'i.html'"), "path", names, "key", site.REQUIRED_NAMES).collect()}
    assert lacking == set(site.REQUIRED_NAMES) - {"description"}


CASES = [
    ("a/x.html", "y.html", ("a/y.html", "", False)), ("a/x.html", "../y.html#s%20t", ("y.html", "s t", False)), ("a/x.html", "../../y.html", (None, "", True)),
    ("a/x.html", "b/", ("a/b/index.html", "", False)), ("a/x.html", "#f", ("a/x.html", "f", False)), ("a/x.html", "", ("a/x.html", "", False)), ("a/x.html", "/y", (None, "", False)),
    ("a/x.html", "mailto:a@b", (None, "", False)), ("a/x.html", "https://h/p/z.html", (None, "", False)), ("x.html", "./", ("index.html", "", False)), ("x.html", "?q=1", ("x.html", "", False)),
    ("x.html", " 'y.html' ", ("y.html", "", False)), ("x.html", "a+b%2Bc.html", ("a+b+c.html", "", False)), ("x.html", "100%.html#50%25", ("100%.html", "50%", False)), ("x.html", "%C3%A9.html", ("é.html", "", False)),
    ("a/b/c/x.html", "../.././d//e/../f.html?x=/../#g", ("a/d/f.html", "g", False)), ("a/x.html", "..", ("index.html", "", False)), ("a/x.html", "../..", (None, "", True)), ("a/x.html", "b/../../../c/d", (None, "", True)),
    ("x.html", "//h/y", (None, "", False)), ("x.html", "JavaScript:void(0)", (None, "", False)), ("a/x.html", "y/?q#z", ("a/y/index.html", "z", False)), ("x.html", "%2e%2e/y", (None, "", True)),
    (None, "y", None), ("x.html", None, None),
]


def test_resolution(spark):
    df = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(CASES)], "i int, source string, reference string").withColumn("t", site.resolve("source", "reference"))
    got = {r.i: tuple(r.t) if r.t is not None else None for r in df.collect()}
    assert {i: (CASES[i][:2], got[i]) for i in got if got[i] != CASES[i][2]} == {}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_own_absolute_links(spark):
    df = spark.createDataFrame([("https://h/p/z.html#k",), ("https://h/q/z.html",), ("//h/p/",), ("https://other/p/z.html",), ("https://h/p/a/../../b",)], "r string")
    got = [tuple(r.t) for r in df.select(site.resolve(F.lit("d/a.html"), F.col("r"), "h", "/p/").alias("t")).collect()]
    assert got == [("z.html", "k", False), (None, "", False), ("index.html", "", False), (None, "", False), (None, "", True)]


def test_link_checks(spark):
    edges = spark.createDataFrame([("i.html", "href", r) for r in ("b.html", "c.html", "d/", "d", "../e", "/root", "#no", "b.html#yes", "b.html#no")], "source string, attribute string, reference string")
    files = spark.createDataFrame([("i.html",), ("b.html",), ("d/index.html",)], "path string")
    ids = spark.createDataFrame([("b.html", "yes")], "path string, id string")
    assert {r.reference for r in site.broken_links(edges, files).collect()} == {"c.html", "../e"}
    assert {r.reference for r in site.missing_fragments(edges, ids).collect()} == {"#no", "b.html#no"}


def test_link_kinds_and_origins(spark):
    df = spark.createDataFrame([("tel:1", "other"), ("HTTP://a", "remote"), ("//a/b", "remote"), ("/a", "root"), ("#a", "fragment"), ("", "fragment"), ("a/b", "local")], "r string, k string")
    assert df.filter(site.link_kind(F.col("r")) != F.col("k")).count() == 0
    urls = spark.createDataFrame([("https://a.b/c", True), ("http://a.b/c", False), ("https://a.b:1/c", False), ("not a url", False), (None, False)], "u string, same boolean")
    assert urls.filter(site.same_origin(F.col("u"), "https://a.b") != F.col("same")).count() == 0


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://s"><url><loc> https://a/ </loc></url><url><loc>http://b/</loc></url><url><loc> </loc></url><url><loc>http://b/</loc></url></urlset>')
    locs = readers.sitemap(spark, str(tmp_path / "s.xml")).select(F.explode("locs").alias("loc"))
    assert [r.loc for r in locs.collect()] == ["https://a/", "http://b/", "http://b/"]
    assert sorted(tuple(r) for r in site.sitemap_findings(locs).collect()) == [("duplicate_loc", "http://b/"), ("not_https", "http://b/"), ("not_https", "http://b/")]


def test_malformed_sitemaps(spark, tmp_path):
    """A broken document is a finding; the job goes on."""
    cases = ["<urlset><url><loc>a</loc>", "<a><loc>x</loc></a>tail", "no xml", "", None, "<a>&unknown;</a>", "<s><loc>https://k/</loc></s>", "\x00"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, xml string").select("i", site.parsed_sitemap(F.col("xml")).alias("s")).collect()
    assert {r.i: (list(r.s.locs), r.s.error is not None) for r in rows} == {0: ([], True), 1: ([], True), 2: ([], True), 3: ([], False), 4: ([], False), 5: ([], True), 6: (["https://k/"], False), 7: ([], True)}
    (tmp_path / "s.xml").write_text(cases[0])
    assert readers.sitemap(spark, str(tmp_path / "s.xml")).first().error.startswith("malformed XML")
    files = spark.createDataFrame([("sitemap.xml", cases[0], "xml"), ("index.html", PAGE, "html")], "path string, text string, suffix string")
    found = flows.site_findings(files).filter("check_name = 'sitemap'").collect()
    assert any(r.detail.startswith("malformed XML") for r in found)


def test_repository_files(spark, tmp_path):
    for name, data in (("a.html", b"<p>"), ("build/b.html", b"x"), ("c/build.css", b"y"), ("c/bad.js", b"\xff\xfe"), (".git/d", b"z")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = readers.repository_files(spark, str(tmp_path), site.SKIPPED_FOLDERS).collect()
    assert {r.path: (r.suffix, r.text) for r in rows} == {"a.html": ("html", "<p>"), "c/build.css": ("css", "y"), "c/bad.js": ("js", None)}


def test_folders_are_listed_by_levels(spark, tmp_path):
    names = [f"d{i}/e{j}/f{k}.txt" for i in range(4) for j in range(3) for k in range(2)] + ["top.js", ".hidden", "artifacts/x.js", "d0/artifacts/y.js", "d0/artifacts.js", "a b/100%/ñ.css"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "empty/inner").mkdir(parents=True)
    kept = lambda skip: {r.path for r in readers.listed_files(spark, str(tmp_path), skip).collect()}
    assert kept(site.SKIPPED_FOLDERS) == set(names)
    assert kept(site.SKIPPED_BY_SCAN) == {n for n in names if "artifacts/" not in n}
    texts = {r.path: r.text for r in readers.repository_files(spark, str(tmp_path), site.SKIPPED_BY_SCAN).collect()}
    assert texts["a b/100%/ñ.css"] == "a b/100%/ñ.css"
    assert readers.listed_files(spark, str(tmp_path / "empty/inner")).count() == 0


def test_security_scan(spark):
    html = 'l1\n<a href="http://evil.org/x">\n<img src="http://localhost/x" onclick = "y">\n<a target="_blank" rel="noopener">\n<a target="_blank" rel="noopener">\n<a target="_blank" rel="NoReferrer noopener">'
    js = "ok\neval (1)\nnew  Function('x'); document.write(1)\nmedieval(2)\n// ghp_" + "a1" * 12
    key = "-----BEGIN " + "RSA PRIVATE KEY-----"
    rows = [("a.html", html), ("b.js", js), ("c.css", key), ("scripts/d.js", "eval(1)"), ("e.md", key)]
    found = sorted((r.check_name, r.subject, r.line) for r in scan.security_findings(spark.createDataFrame(rows, "path string, text string")).collect())
    assert found == [
        ("blank-target", "a.html", 4), ("blank-target", "a.html", 4), ("document-write", "b.js", 3), ("eval", "b.js", 2), ("github-token", "b.js", 5),
        ("inline-handler", "a.html", 3), ("insecure-resource", "a.html", 2), ("new-function", "b.js", 3), ("private-key", "c.css", 1),
    ]


def test_budgets_geometry_and_partitions(spark):
    m = spark.createDataFrame([(3_000_001, 100, None)], "bytes long, requests long, dom_nodes long")
    assert {r.metric: r.over for r in scan.over_budget(m).collect()} == {"bytes": True, "requests": False, "dom_nodes": False}
    df = spark.createDataFrame([(-1.5, -1), (-2.5, -2), (2.5, 3), (0.49, 0)], "x double, y long")
    assert df.filter(scan.rounded(F.col("x")) != F.col("y")).count() == 0
    boxes = spark.createDataFrame([(-2, 10, False), (-3, 10, True), (0, 902, False), (0, 903, True)], "l int, r int, o boolean")
    assert boxes.filter(scan.overflows(F.col("l"), F.col("r"), F.lit(900)) != F.col("o")).count() == 0
    kinds = spark.createDataFrame([("critical", "blocking"), ("minor", "advisory"), (None, "advisory")], "i string, k string")
    assert kinds.filter(scan.severity(F.col("i")) != F.col("k")).count() == 0
    errors = spark.createDataFrame([("a", "x"), ("a", "w")], "label string, message string")
    assert [tuple(r) for r in scan.failures(errors, "label").collect()] == [("a", ["w", "x"])]


def test_every_finding_has_its_line(spark, tmp_path):
    texts = {1: "1.2.3.4 a@b.c\n\n5.6.7.8 x 1.2.3.4\n11.2.3.4", 2: "none", 3: None, 4: "a@b.c\na@b.cd a@b.c"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in sites.QUERIES["q37_scan_with_line"](spark, str(tmp_path)).collect())
    kinds = (("ipv4", sites.IPV4), ("email", sites.EMAIL))
    assert got == sorted((i, k, t.count("\n", 0, m.start()) + 1, m[0]) for i, t in texts.items() for k, p in kinds for m in re.finditer(p, t or ""))


def plain_scan(rule, text):
    """The matches of a pattern, as the pattern says."""
    return [(m.start(), m.end()) for m in re.finditer(rule.pattern, text, re.ASCII)]


RULES = [r for of in scan.security_rules().values() for r in of] + [scan.Rule("ipv4", sites.IPV4, (".",), "[0-9]", 3), scan.Rule("email", sites.EMAIL, ("@",), "[A-Za-z0-9._]", 1 << 30)]
PIECES = [
    "<a ", "<a", "<A\n", "target='_blank'", 'TARGET = "_blank"', ">", " href=", 'src="http://x"', "src='http://localhost/'", ' onclick="', "\tonX = '", "eval (", "eval(", "new Function(", "new  Function (", "document.write(",
    "ghp_" + "a" * 20, "ghs_" + "b1" * 11, "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "x", "_", "é", " ", "\n", "1.2.3.4", "1234.5.6.7", "..", "a.b@c.d", "@", "a@@b", "12", ".", "İ",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_one_pass_finds_what_the_patterns_say(text):
    for rule in RULES:
        assert [(a, z) for _, a, z in scan.Scanner([rule]).matches(text)] == plain_scan(rule, text), rule.name
    for rules in scan.security_rules().values():
        found = sorted((rules[i].name, a, z) for i, a, z in scan.Scanner(rules).matches(text))
        assert found == sorted((r.name, a, z) for r in rules for a, z in plain_scan(r, text))


def test_scan_is_linear():
    rules = scan.security_rules()["html"]
    for piece in ('<img src="http://x.y/z" onclick="a">\n', "<a <a target='_blank' \n", "<a href=x ", "src = "):
        def took(n, piece=piece):
            began = time.process_time()
            scanner = scan.Scanner(rules)
            list(scanner.matches(piece * n))
            return time.process_time() - began

        took(1000)
        assert took(100_000) < 3 * took(50_000) + 0.3
    email = scan.Scanner([scan.Rule("email", sites.EMAIL, ("@",), "[A-Za-z0-9._]", 1 << 30)])
    began = time.process_time()
    assert len(list(email.matches("a@b.c\n" * 100_000))) == 100_000 and list(email.matches("a" * 3_000_000)) == []
    assert time.process_time() - began < 5


def test_many_findings_in_one_text(spark):
    """100,000 findings of a text, each with its line; one scan of the files."""
    text = "\n".join("x eval(1)" for _ in range(100_000))
    df = spark.createDataFrame([("a.js", text), ("b.html", "<p>"), ("c.css", None)], "path string, text string")
    found = scan.security_findings(df)
    rows = found.agg(F.count("*").alias("n"), F.sum("line").alias("s"), F.max("line").alias("m")).first()
    assert tuple(rows) == (100_000, 100_000 * 100_001 // 2, 100_000)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1


def test_repeated_links_report_the_first_line(spark):
    tag = "<a target='_blank'>"
    text = f"<a <a target='_blank'>\n\n{tag}\n{tag}\n<a target=\"_blank\">\n{tag}"
    rows = scan.security_findings(spark.createDataFrame([("a.html", text)], "path string, text string")).collect()
    lines = [text[: text.index(r.detail)].count("\n") + 1 for r in rows]
    assert [r.line for r in rows] == lines and sorted(lines) == [1, 1, 1, 1, 5]
