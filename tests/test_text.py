import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_normal_forms(spark):
    cases = {"  Él,  LA Straße—ñandú! ": "el la strasse nandu", "": "", "¿?": "", "a b\tc": "a b c"}
    for raw, want in cases.items():
        assert one(spark, tx.normalize(F.col("v")), v=raw) == want == tx.normalize_one(raw)
    assert one(spark, tx.normalize_spaces(F.col("v")), v="  Él  y\n Ella ") == "él y ella"
    assert one(spark, tx.strip(F.col("v")), v="\t x \n") == "x"


def test_native_equals_python_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", tx.normalize(F.col("text")).alias("n"), tx.fold(F.col("text")).alias("f")).collect()
    assert all(r.n == tx.normalize_one(r.text) and r.f == r.text.casefold() for r in docs)


def test_native_equals_python_on_any_script(spark):
    rnd = random.Random(3)
    scripts = "aeiouáéíóúñçßÀÖ .,-1", "ΑάΐΣςώᾳᾧ\u0345", "ЙйЁёїЖ", "ﬁﬂﬃﬆŉẚǆǅʼ\u212a\u212bİı", "한국어 조선글", "漢字かなガ", "\U00010400\U00010428\U0001d400\U0001f600", "אָ עִבְרִית", "हिन्दी", "éüñ"
    texts = ["".join(rnd.choice(rnd.choice(scripts)) for _ in range(rnd.randrange(40))) for _ in range(800)]
    texts += [unicodedata.normalize(form, t) for t in texts[:400] for form in ("NFD", "NFC", "NFKD")]
    texts += ["la canción según José", unicodedata.normalize("NFD", "la canción según José"), "Ǆ ﬁn", "STRAẞE"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", tx.normalize(F.col("v")).alias("n"), tx.fold(F.col("v")).alias("f")).collect()
    for r in rows:
        assert r.n == tx.normalize_one(r.v) and r.f == r.v.casefold(), repr(r.v)


def test_every_character(spark):
    """Both forms of each character between two letters, over all of Unicode."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    texts = ["a" + "b".join(every[i : i + 500]) + "c" for i in range(0, len(every), 500)]
    for r in spark.createDataFrame([(t,) for t in texts], "v string").select("v", tx.normalize(F.col("v")).alias("n"), tx.fold(F.col("v")).alias("f")).collect():
        assert r.n == tx.normalize_one(r.v) and r.f == r.v.casefold()


@pytest.mark.parametrize(
    ("raw", "any_place", "separated"),
    [("12", 12, None), ("Gen 1:3", 3, 3), ("a.7 ", 7, 7), ("abc5", None, None), ("x 0", None, None), (" 4", 4, 4), ("", None, None), ("1:2b", None, None)],
)
def test_trailing_int(spark, raw, any_place, separated):
    assert one(spark, tx.trailing_int(F.col("v")), v=raw) == any_place
    assert one(spark, tx.trailing_int(F.col("v"), needs_separator=True), v=raw) == separated


def test_citation(spark):
    for raw, want in (("Juan 3:16", True), ("3 : 16?", True), ("a3:16", False), ("a las tres", False)):
        assert one(spark, tx.has_citation(F.col("v")), v=raw) is want


def test_identifiers_and_labels(spark):
    assert one(spark, tx.item_id(F.col("b"), F.col("c"), F.col("n")), b="1 Reyes", c=2, n=1234) == "1_REYES_002_1234"
    label = tx.range_label(F.col("b"), F.col("c"), F.col("s"), F.col("e"))
    assert one(spark, label, b="Gen", c=1, s=2, e=2) == "Gen 1:2"
    assert one(spark, label, b="Gen", c=1, s=2, e=4) == "Gen 1:2-4"
    names = {"a": "Alpha", "b": ""}
    assert [one(spark, tx.label(F.col("v"), names), v=v) for v in ("a", "b", "c")] == ["Alpha", "b", "c"]


def test_css_and_srcset(spark):
    css = "a{background:URL( 'x.png' )} b{src:url(data:1)} c{src:url(#p)} d{src:url(var(--q))}"
    assert one(spark, tx.css_urls(F.col("v")), v=css)[0] == "'x.png'"
    checked = [one(spark, tx.is_checked_css_url(F.col("v")), v=v) for v in ("x.png", "", "#a", "data:1", "var(x")]
    assert checked == [True, False, False, False, False]
    assert one(spark, tx.srcset_urls(F.col("v")), v=" a.png 1x, ,b.png 2x") == ["a.png", "b.png"]


def test_conflict_markers(spark):
    for raw, want in (("x\n<<<<<<< HEAD\n", True), ("x <<<<<<< HEAD", False), (">>>>>>> b", True), ("<<<<<<<", False)):
        assert one(spark, tx.has_conflict_marker(F.col("v")), v=raw) is want


def test_evidence(spark):
    missing = tx.terms_missing(F.col("p"), F.array(F.lit("Luz"), F.lit("¡!"), F.lit("cielo"), F.lit("Tierra")))
    assert one(spark, missing, p="hubo luz en la tierranueva") == ["cielo"]
    conflicts = tx.conflicts(F.col("p"), F.array(F.lit("de la"), F.lit("la Luz"), F.lit("luz y agua")))
    assert one(spark, conflicts, p="hubo luz") == ["la Luz"]
