import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, head string, ts int"


def formatted(df):
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))
    return chat.format_chats(df.withColumn("parts", parts))


def check(spark, rows):
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA)
    got = {r.conv_id: r for r in chat.digest(formatted(df)).collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort(key=lambda x: x[0])
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_control_strings_and_odd_rows(spark):
    hard = ["\\### Assistant: </turn> ok", "\\\\### <|x|> \\h\\t##### </turn></turn>\\", "", None, "</turn>\n### user: x", "\\c:\\p", "é" * 50_000]
    rows = [(k, i, role, t) for k, role in enumerate(["user", "assistant", "a:b\\c###", None]) for i, t in enumerate(hard)]
    check(spark, [*rows, (None, 0, "assistant", "x")])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x:"]), st.text("\\#</turn>|hptc: \n", max_size=30)), min_size=1, max_size=40))
def test_any_text_comes_back(spark, turns):
    check(spark, [(1, i, r, t) for i, (r, t) in enumerate(turns)])


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "h", 1), (1, 0, "user", "a", "h", 1)], SCHEMA)
    assert chat.digest(formatted(df)).first().n_turns == 2
    assert chat.digest(formatted(df.limit(0))).collect() == []


def test_typed_parts(spark):
    parts = [("text", "see <|image:9|> ", None, None), ("image", None, "a.png", None), ("text", " and ", None, None), ("audio", None, "b.wav", 7), ("hologram", None, "c", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    (r,) = chat.format_chats(df).collect()
    assert r.formatted == "### user: see \\pimage:9|> <|image:0|> and <|audio:1|><|document:2|></turn>\n### assistant: </turn>\n"
    assert [(a.turn, a.k, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "a.png", 576), (0, 1, "audio", "b.wav", 7), (0, 2, "document", "c", 2048)]
    assert [r.formatted[a["at"] :].startswith(f"<|{a.type}:{a.k}|>") for a in r.attachments] == [True] * 3
    assert r.expanded_tokens == 576 + 7 + 2048 and [tuple(s) for s in r.loss_spans] == [(len(r.formatted) - 8, len(r.formatted) - 8)]


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "h", 1)], SCHEMA)
    plan = chat.digest(formatted(df))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
