"""Catalogue: passages, audit and bank validation over the tables at hand.

A conversation stands for a chapter, its turns for verses; orders and their lines
for questions and their options.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import text as tx
from attesta.operators import audit as au
from attesta.operators import bank, copies, json_schema, ordered, passages
from attesta.plans import question_schema
from attesta.plans.sql import norm, norm_ws, tokens

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def audit_questions(turns: DataFrame) -> DataFrame:
    """A question per turn: the range of three turns from it, the tokens of the turn as
    support, those of the turn after the range as explanation, those of the next
    conversation's first turn as distractors."""
    toks = turns.select("conv_id", "turn", tx.significant_tokens(F.col("text")).alias("k"))
    after = toks.select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("k").alias("explanation_terms"))
    first = toks.filter("turn = 0").select((F.col("conv_id") - 1).alias("conv_id"), F.col("k").alias("distractors"))
    rows = toks.join(after, ["conv_id", "turn"], "left").join(first, "conv_id", "left")
    return rows.select(
        F.format_string("%d:%d", "conv_id", "turn").alias("id"),
        F.lit("C").alias("book"),
        F.col("conv_id").alias("chapter"),
        F.col("turn").alias("verse_start"),
        (F.col("turn") + 2).alias("verse_end"),
        F.col("k").alias("support_terms"),
        "explanation_terms",
        "distractors",
    )


def audited(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    verses = turns.select(F.lit("C").alias("book"), F.col("conv_id").alias("chapter"), F.col("turn").alias("verse_number"), "text")
    return au.audit(audit_questions(turns), verses)


AUDIT_SQL = f"""
    t AS (SELECT conv_id, turn, text, {tokens(norm("text"))} AS k FROM conversations),
    q AS (
        SELECT t.conv_id, t.turn, coalesce(t.k, []) AS support, coalesce(e.k, []) AS expl, coalesce(d.k, []) AS dis
        FROM t LEFT JOIN t e ON e.conv_id = t.conv_id AND e.turn = t.turn + 3 LEFT JOIN t d ON d.conv_id = t.conv_id + 1 AND d.turn = 0
    ), p AS (
        SELECT q.conv_id, q.turn, count(t.turn) = 3 AS found, string_agg(coalesce(t.text, ''), ' ' ORDER BY n.i) AS passage
        FROM q CROSS JOIN (SELECT unnest(range(0, 3)) AS i) n LEFT JOIN t ON t.conv_id = q.conv_id AND t.turn = q.turn + n.i
        GROUP BY q.conv_id, q.turn
    ), m AS (SELECT *, {norm("passage")} AS n FROM p JOIN q USING (conv_id, turn)),
    a AS (
        SELECT conv_id, turn, found, passage,
               list_filter(support, lambda x: NOT contains(n, x)) AS ms, list_filter(expl, lambda x: NOT contains(n, x)) AS me,
               list_filter(dis, lambda x: contains(n, x)) AS c
        FROM m
    ), r AS (
        SELECT printf('%d:%d', conv_id, turn) AS id, printf('C %d:%d-%d', conv_id, turn, turn + 2) AS reference, found AS reference_exists,
               found AND len(ms) = 0 AS direct_answer_support, len(ms) AS n_missing_support, found AND len(me) = 0 AS explanation_claims_supported,
               len(me) AS n_missing_explanation, len(c) AS n_conflicts, len(c) = 0 AS unique_answer_signal,
               CASE WHEN found THEN sha256(passage) END AS passage_sha256,
               CASE WHEN found AND len(ms) = 0 AND len(me) = 0 AND len(c) = 0 THEN 'VERIFICADO_DIRECTO' ELSE 'REQUIERE_REVISION' END AS verdict
        FROM a
    )
"""


@query("q01_audit_verdict", f"WITH {AUDIT_SQL} SELECT * FROM r")
def q01(spark, sf):
    return audited(spark, sf).select(
        "id", "reference", "reference_exists", "direct_answer_support", F.size("missing_support_terms").cast("bigint").alias("n_missing_support"),
        "explanation_claims_supported", F.size("missing_explanation_terms").cast("bigint").alias("n_missing_explanation"),
        F.size("distractor_conflicts").cast("bigint").alias("n_conflicts"), "unique_answer_signal", "passage_sha256", "verdict",
    )


@query("q02_normalize_strip", f"SELECT doc_id, sha256({norm('text')}) AS norm_sha256 FROM documents")
def q02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.normalize(F.col("text")), 256).alias("norm_sha256"))


@query("q03_normalize_ws", f"SELECT doc_id, sha256({norm_ws('text')}) AS norm_sha256 FROM documents")
def q03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.normalize_spaces(F.col("text")), 256).alias("norm_sha256"))


@query("q04_significant_tokens", f"SELECT doc_id, len(k) AS n_tokens, sha256(array_to_string(k, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {tokens(norm('text'))} AS k FROM documents)")
def q04(spark, sf):
    k = table(spark, sf, "documents").select("doc_id", tx.significant_tokens(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("k", " "), 256).alias("tokens_sha256"))


def paired(spark, sf) -> DataFrame:
    """Every document with one benchmark item: that of its id modulo their number."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    n = items.count()
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("item_id"))
    return docs.join(items, "item_id")


PAIRED_SQL = "(SELECT d.doc_id, d.text, b.item_id, b.text AS item FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"


@query(
    "q05_terms_missing",
    f"""SELECT doc_id, item_id, len(m) AS n_missing, array_to_string(m, ' ') AS missing
        FROM (SELECT doc_id, item_id, list_filter(k, lambda x: NOT contains(n, x)) AS m
              FROM (SELECT doc_id, item_id, {norm("text")} AS n, {tokens(norm("item"))} AS k FROM {PAIRED_SQL}))""",
)
def q05(spark, sf):
    rows = paired(spark, sf).select("doc_id", "item_id", tx.terms_missing(tx.normalize(F.col("text")), tx.significant_tokens(F.col("item"))).alias("m"))
    return rows.select("doc_id", "item_id", F.size("m").cast("bigint").alias("n_missing"), F.array_join("m", " ").alias("missing"))


@query(
    "q06_distractor_conflict",
    f"""SELECT doc_id, item_id, len(c) AS n_conflicts, array_to_string(c, '|') AS conflicts
        FROM (SELECT doc_id, item_id, list_filter(string_split_regex(item, '[.,]'),
                     lambda d: len({tokens(norm("d"))}) > 0 AND len(list_filter({tokens(norm("d"))}, lambda x: NOT contains(n, x))) = 0) AS c
              FROM (SELECT *, {norm("text")} AS n FROM {PAIRED_SQL}))""",
)
def q06(spark, sf):
    rows = paired(spark, sf).select("doc_id", "item_id", tx.conflicts(tx.normalize(F.col("text")), F.split("item", "[.,]")).alias("c"))
    return rows.select("doc_id", "item_id", F.size("c").cast("bigint").alias("n_conflicts"), F.array_join("c", "|").alias("conflicts"))


@query(
    "q07_passage_sha",
    """SELECT printf('%d:%d', c.conv_id, c.turn) AS id, count(t.turn) AS n_found,
              CASE WHEN count(t.turn) = 3 THEN sha256(string_agg(coalesce(t.text, ''), ' ' ORDER BY n.i)) END AS passage_sha256
       FROM conversations c CROSS JOIN (SELECT unnest(range(0, 3)) AS i) n
       LEFT JOIN conversations t ON t.conv_id = c.conv_id AND t.turn = c.turn + n.i GROUP BY c.conv_id, c.turn""",
)
def q07(spark, sf):
    turns = table(spark, sf, "conversations")
    ranges = turns.select(F.format_string("%d:%d", "conv_id", "turn").alias("id"), "conv_id", F.col("turn").alias("verse_start"), (F.col("turn") + 2).alias("verse_end"))
    verses = turns.select("conv_id", F.col("turn").alias("verse_number"), "text")
    laid = passages.passages(ranges, verses, ["conv_id"])
    return laid.select("id", "n_found", F.when(F.col("found"), F.sha2("passage", 256)).alias("passage_sha256"))


@query(
    "q08_duplicate_ordinals",
    """SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS duplicates
       FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY l_orderkey""",
)
def q08(spark, sf):
    found = passages.duplicate_numbers(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")
    return found.select("l_orderkey", F.array_join(F.col("duplicates").cast("array<string>"), ",").alias("duplicates"))


@query(
    "q09_sequential_ordinals",
    """SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS sequential
       FROM lineitem GROUP BY l_orderkey""",
)
def q09(spark, sf):
    return passages.sequential(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", "l_linenumber")


@query(
    "q10_last_wins",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
)
def q10(spark, sf):
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return passages.last_wins(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order, "l_extendedprice")


@query(
    "q11_trailing_int",
    r"""SELECT l_orderkey, l_linenumber, label, CASE WHEN n > 0 THEN n END AS number
        FROM (SELECT *, TRY_CAST(regexp_extract(trim(label), '(?:^|[.:\s])(\d+)$', 1) AS BIGINT) AS n
              FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN printf('O %d:%d ', l_orderkey, l_linenumber) WHEN 1 THEN printf('abc%d', l_orderkey)
                           WHEN 2 THEN printf('%d', l_orderkey) ELSE printf('v.%d', l_linenumber - 3) END AS label FROM lineitem))""",
)
def q11(spark, sf):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    label = F.when(n % 4 == 0, F.format_string("O %d:%d ", k, n)).when(n % 4 == 1, F.format_string("abc%d", k)).when(n % 4 == 2, k.cast("string")).otherwise(F.format_string("v.%d", n - 3))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))
    return rows.withColumn("number", tx.trailing_int(F.col("label")))


@query(
    "q12_ordinal_fallback",
    "SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS verse_number FROM conversations",
)
def q12(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("turn").alias("verse_number"))
    return passages.with_ordinals(rows, ["conv_id"], "verse_number", ["turn"]).withColumn("verse_number", F.col("verse_number").cast("bigint"))


@query(
    "q13_candidates",
    """SELECT turn AS verse_number, CASE WHEN turn % 2 = 1 THEN printf('T %d', turn) ELSE printf('C %d:%d', conv_id, turn) END AS reference,
              'pending_generation' AS status, 0 AS n_options, false AS source_text_persisted, question FROM conversations, (SELECT NULL::VARCHAR AS question)""",
)
def q13(spark, sf):
    verses = table(spark, sf, "conversations").select(
        F.lit("C").alias("book"), F.col("conv_id").alias("chapter"), F.col("turn").alias("verse_number"),
        F.when(F.col("turn") % 2 == 1, F.format_string(" T %d ", "turn")).otherwise("  ").alias("reference_from_api"),
    )
    return passages.candidates(verses).select("verse_number", "reference", "status", F.size("options").alias("n_options"), "source_text_persisted", "question")


@query(
    "q77_islands",
    """SELECT k, min(n) AS first, max(n) AS last, count(*) AS size
       FROM (SELECT *, n - row_number() OVER (PARTITION BY k ORDER BY n) AS run FROM (SELECT DISTINCT o_custkey % 50 AS k, o_orderkey // 3 AS n FROM orders)) GROUP BY k, run""",
)
def q77(spark, sf):
    """Runs of consecutive numbers under a key."""
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("k"), F.floor(F.col("o_orderkey") / 3).alias("n"))
    return ordered.islands(rows, ["k"], "n").select("k", "first", "last", "size")


@query(
    "q78_long_passages",
    """WITH v AS (SELECT l_orderkey % 20 AS k, l_orderkey // 20 AS n, string_agg(l_linenumber || l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY ALL),
            q AS (SELECT p_partkey AS id, p_partkey % 20 AS k, p_size AS a, p_size + p_partkey % 300 AS z FROM part)
       SELECT id, count(v.n) = max(z - a + 1) AS found, CAST(max(z - a + 1) AS BIGINT) AS size, count(v.n) AS n_found, sha256(string_agg(coalesce(text, ''), ' ' ORDER BY u.n)) AS passage_sha256
       FROM q, unnest(range(a, z + 1)) AS u(n) LEFT JOIN v ON v.k = q.k AND v.n = u.n GROUP BY id""",
)
def q78(spark, sf):
    """Passages of up to 300 numbers over orders as verses, by blocks."""
    line = F.concat(F.col("l_linenumber").cast("string"), "l_returnflag")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", line.alias("t")))), lambda x: x["t"]), "").alias("text"))
    verses = lines.select((F.col("l_orderkey") % 20).alias("k"), F.floor(F.col("l_orderkey") / 20).alias("verse_number"), "text")
    p = F.col("p_partkey")
    ranges = table(spark, sf, "part").select(p.alias("id"), (p % 20).alias("k"), F.col("p_size").alias("verse_start"), (F.col("p_size") + p % 300).alias("verse_end"))
    return passages.passages(ranges, verses, ["k"]).select("id", "found", "size", "n_found", F.sha2("passage", 256).alias("passage_sha256"))


@query("q14_text_node_count", "SELECT conv_id, count(text) AS nodes, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def q14(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("text").alias("nodes"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query(
    "q15_playable",
    """SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '5%'
       GROUP BY o_orderkey, o_custkey HAVING count(*) >= 3 AND bool_or(l_linenumber = o_custkey % 4 + 1)""",
)
def q15(spark, sf):
    options = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("id"), F.col("l_returnflag").alias("text"))).alias("options"))
    rows = table(spark, sf, "orders").join(options, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("status"),
        "options",
        (F.col("o_custkey") % 4 + 1).cast("string").alias("correctOptionId"),
        F.when(F.startswith("o_orderpriority", F.lit("5")), " ").otherwise(F.col("o_orderpriority")).alias("prompt"),
        F.col("o_orderpriority").alias("explanation"),
        F.array(F.struct(F.lit(" ").alias("display")), F.struct(F.col("o_orderstatus").alias("display"))).alias("references"),
    )
    return rows.filter(bank.is_playable()).select("o_orderkey")


WHOLE_ITEMS_SQL = """
    SELECT doc_id, lang, source, left(text, half) AS question, substr(text, half + 1) AS explanation, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE lang END AS category,
           [left(text, quarter), substr(text, quarter + 1, quarter), substr(text, 2 * quarter + 1, quarter), substr(text, 3 * quarter + 1)] AS options,
           CASE WHEN doc_id % 7 = 0 THEN 'zz' ELSE left(text, quarter) END AS correct, CASE doc_id % 5 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' WHEN 3 THEN ' easy ' ELSE 'x' END AS difficulty,
           CASE doc_id % 3 WHEN 0 THEN substr(text, 3 * quarter + 1) WHEN 1 THEN substr(text, quarter + 1, 2 * quarter) ELSE text END AS verse
    FROM (SELECT *, length(text) // 2 AS half, length(text) // 4 AS quarter FROM documents)
"""


@query(
    "q16_validate_first_error",
    f"""WITH i AS ({WHOLE_ITEMS_SQL}), n AS (SELECT *, {norm_ws("question")} AS qn, {norm_ws("explanation")} AS en, {norm_ws("verse")} AS vn FROM i),
        d AS (SELECT *, row_number() OVER (PARTITION BY source, qn ORDER BY doc_id) > 1 AS again FROM n)
        SELECT doc_id, CASE
            WHEN qn = '' OR en = '' OR trim(category) = '' THEN 'missing_field'
            WHEN regexp_matches(question, '\\d+\\s*:\\s*\\d+') THEN 'citation_in_question'
            WHEN again THEN 'duplicate_question'
            WHEN len(list_distinct(list_transform(options, lambda x: {norm_ws("x")}))) <> 4 THEN 'duplicate_option'
            WHEN NOT list_contains(list_transform(options, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), regexp_replace(correct, '^\\s+|\\s+$', '', 'g')) THEN 'answer_not_in_options'
            WHEN trim(difficulty) NOT IN ('easy', 'medium', 'hard') THEN 'unknown_difficulty'
            WHEN length(vn) >= 40 AND (contains(qn, vn) OR contains(en, vn)) THEN 'source_copied' END AS error
        FROM d""",
)
def q16(spark, sf):
    """Items made of whole texts: question and explanation are the halves, the options the quarters."""
    t, d = F.col("text"), F.col("doc_id")
    half, quarter = F.floor(F.length(t) / 2).cast("int"), F.floor(F.length(t) / 4).cast("int")
    rest, one = F.length(t), F.lit(1)
    items = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("bank"), F.substring(t, one, half).alias("question"), F.substring(t, half + 1, rest).alias("explanation"),
        F.when(d % 11 == 0, " ").otherwise(F.col("lang")).alias("category"),
        F.array(*[F.substring(t, quarter * i + 1, quarter if i < 3 else rest) for i in range(4)]).alias("options"),
        F.when(d % 7 == 0, "zz").otherwise(F.substring(t, one, quarter)).alias("correct_answer"),
        F.when(d % 5 == 0, "easy").when(d % 5 == 1, "medium").when(d % 5 == 2, "hard").when(d % 5 == 3, " easy ").otherwise("x").alias("difficulty"),
        F.when(d % 3 == 0, F.substring(t, quarter * 3 + 1, rest)).when(d % 3 == 1, F.substring(t, quarter + 1, quarter * 2)).otherwise(t).alias("source"),
    )
    return bank.item_errors(items, ["bank"], "doc_id").select("doc_id", "error")


@query("q17_duplicate_question", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {norm_ws('text')} ORDER BY doc_id) > 1")
def q17(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", F.sha2(tx.normalize_spaces(F.col("text")), 256).alias("k"))
    return keyed.join(bank.repeated(keyed, [], "k", "doc_id"), "k").filter(F.col("doc_id") > F.col("first")).select("doc_id")


@query(
    "q18_verbatim_copy",
    f"""SELECT doc_id, item_id FROM (SELECT doc_id, {norm_ws("text")} AS t FROM documents) d
        JOIN (SELECT item_id, {norm_ws("text")} AS s FROM benchmark) b ON length(s) >= 40 AND contains(t, s)""",
)
def q18(spark, sf):
    return copies.verbatim_copies(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id")


@query(
    "q19_option_distinct",
    f"""SELECT l_orderkey, count(*) AS n_options, count(DISTINCT o) AS n_distinct FROM (SELECT l_orderkey, {norm_ws("l_returnflag || ' ' || (l_partkey % 9)::VARCHAR")} AS o FROM lineitem)
        GROUP BY l_orderkey HAVING count(DISTINCT o) < count(*)""",
)
def q19(spark, sf):
    o = tx.normalize_spaces(F.concat("l_returnflag", F.lit("  "), (F.col("l_partkey") % 9).cast("string")))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_options"), F.count_distinct(o).alias("n_distinct"))
    return rows.filter("n_distinct < n_options")


@query(
    "q20_schema_violations",
    """SELECT 'd' || doc_id::VARCHAR AS id, rule FROM (
           SELECT doc_id, unnest([CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'language' END, CASE WHEN n_chars < 200 OR n_chars > 5000 THEN 'length' END,
                                  CASE WHEN NOT regexp_full_match(source, 'src[0-9]') THEN 'source_pattern' END]) AS rule FROM documents) WHERE rule IS NOT NULL
       UNION ALL
       SELECT 'p' || p_partkey::VARCHAR, rule FROM (
           SELECT p_partkey, unnest([CASE WHEN p_size < 5 THEN 'size' END, CASE WHEN length(p_name) > 10 THEN 'name_length' END,
                                     CASE WHEN p_brand = 'Brand#2' AND p_type = 'SMALL' THEN 'brand_type' END]) AS rule FROM part) WHERE rule IS NOT NULL""",
)
def q20(spark, sf):
    docs = table(spark, sf, "documents").withColumn("id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    parts = table(spark, sf, "part").withColumn("id", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    a = {"language": F.col("lang").isin("en", "fr", "de"), "length": F.col("n_chars").between(200, 5000), "source_pattern": F.rlike("source", F.lit("^src[0-9]$"))}
    b = {"size": F.col("p_size") >= 5, "name_length": F.length("p_name") <= 10, "brand_type": ~((F.col("p_brand") == "Brand#2") & (F.col("p_type") == "SMALL"))}
    return bank.violations(docs, a).unionByName(bank.violations(parts, b))


@query("q21_generated_id", "SELECT l_orderkey, l_linenumber, printf('%s_%03d_%03d', upper(l_returnflag || '_book'), l_orderkey, l_linenumber) AS id FROM lineitem")
def q21(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tx.item_id(F.concat("l_returnflag", F.lit(" book")), F.col("l_orderkey"), F.col("l_linenumber")).alias("id"))


@query(
    "q43_ref_display",
    "SELECT conv_id, coalesce(string_agg(role, ' · ' ORDER BY turn) FILTER (WHERE turn % 3 <> 1), '') AS display FROM conversations GROUP BY conv_id",
)
def q43(spark, sf):
    shown = F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("role"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", shown.alias("display")))).alias("references"))
    return rows.select("conv_id", bank.reference_display(F.col("references")).alias("display"))


@query(
    "q44_audit_summary",
    f"""WITH {AUDIT_SQL} SELECT count(*) AS questions_audited, count(*) FILTER (WHERE verdict = 'VERIFICADO_DIRECTO') AS verified_count,
        count(*) FILTER (WHERE verdict <> 'VERIFICADO_DIRECTO') AS review_required_count FROM r""",
)
def q44(spark, sf):
    return au.summary(audited(spark, sf))


STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def payloads(spark, sf) -> DataFrame:
    """A nested JSON payload of each conversation; roles are text nodes deeper down, and a heading comes first."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("ts"))
    verse = F.transform("ts", lambda t: F.struct(t["turn"].alias("verse"), t["text"].alias("text")))
    notes = F.transform("ts", lambda t: F.struct(F.array(F.struct(F.struct(F.concat(t["role"], F.lit(" ")).alias("text")).alias("note"))).alias("list")))
    data = F.struct(F.lit("  ").alias("text"), verse.alias("verses"))
    return rows.select("conv_id", F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data"))).alias("payload"), F.to_json(F.struct(data.alias("data"), notes.alias("notes"))).alias("noted"))


@query(
    "q46_json_walk",
    f"""SELECT conv_id, pos, CASE WHEN turn > 0 THEN turn ELSE pos END AS verse_number, sha256(t) AS text_sha256
        FROM (SELECT conv_id, turn, {STRIPPED} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) AS pos FROM conversations WHERE {STRIPPED} <> '')""",
)
def q46(spark, sf):
    """Verses extracted from nested JSON made of the conversations."""
    rows = payloads(spark, sf).filter(passages.succeeded(F.col("payload")))
    return passages.extract_verses(rows, "conv_id").select("conv_id", "pos", "verse_number", F.sha2("text", 256).alias("text_sha256"))


@query(
    "q65_text_nodes",
    "SELECT conv_id, 1 + count(text) + count(role) AS nodes, CAST(2 + coalesce(sum(length(text)), 0) + coalesce(sum(length(role) + 1), 0) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
)
def q65(spark, sf):
    """Text nodes anywhere in nested JSON, blank ones included, and their characters."""
    return passages.count_text_nodes(payloads(spark, sf), "conv_id", "noted")


QUESTIONS_SQL = """
    b AS (SELECT p_partkey AS k, ['draft', 'reviewed', 'approved', 'retired', 'lost'] AS statuses, ['beginner', 'intermediate', 'advanced', 'expert'] AS levels FROM part),
    c AS (
        SELECT k, CASE WHEN k % 7 = 0 THEN 'QB-1' ELSE 'qb-' || k END AS id, CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END AS version, statuses[k % 5 + 1] AS status,
               CASE WHEN k % 13 = 0 THEN 'en' ELSE 'es' END AS language, CASE WHEN k % 9 = 0 THEN 'a--b' ELSE 'cat-' || k % 3 END AS category, levels[k % 4 + 1] AS difficulty,
               repeat('p', k % 30 + 5) AS prompt, k % 6 AS n_options, substr('abcde', CAST(k % 5 + 1 AS INT), 1) AS correct, repeat('e', k % 50) AS explanation, k % 3 AS n_references,
               k % 4 AS chapter, k % 8 <> 0 AS checked, CASE k % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'possible' END AS sensitivity, repeat('n', k % 700) AS notes FROM b)
"""


def published(spark, sf) -> DataFrame:
    """Questions of the published format, by the numbers of the parts, which break one rule or another."""
    k = F.col("p_partkey")

    def nth(values: list, n: int):
        return F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))

    letters = F.array(*map(F.lit, "abcde"))
    text = lambda i: F.when((k % 14 == 0) & (i == 0), "Todas las  ANTERIORES").otherwise(F.concat(F.lit("option "), i.cast("string")))
    options = F.transform(F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(1), (k % 6).cast("int")), lambda i: F.struct(F.element_at(letters, i + 1).alias("id"), text(i).alias("text")))
    reference = F.struct(
        F.lit("Génesis").alias("book"), (k % 4).cast("int").alias("chapter"), F.lit(1).alias("verseStart"), F.lit(None).cast("int").alias("verseEnd"),
        F.lit("Génesis 1:1").alias("display"), F.lit("RV").alias("translation"), F.lit(None).cast("string").alias("note"),
    )
    return table(spark, sf, "part").select(
        k.alias("k"), F.when(k % 7 == 0, "QB-1").otherwise(F.concat(F.lit("qb-"), k.cast("string"))).alias("id"), F.when(k % 11 == 0, 2).otherwise(1).alias("version"),
        nth([*bank.STATUSES, "lost"], 5).alias("status"), F.when(k % 13 == 0, "en").otherwise("es").alias("language"),
        F.when(k % 9 == 0, "a--b").otherwise(F.concat(F.lit("cat-"), (k % 3).cast("string"))).alias("category"), nth([*bank.LEVELS, "expert"], 4).alias("difficulty"),
        F.when(k % 12 == 0, "rumour").otherwise(F.lit(bank.CONTENT_TYPES[0])).alias("contentType"), F.repeat(F.lit("p"), (k % 30 + 5).cast("int")).alias("prompt"), options.alias("options"),
        F.element_at(letters, (k % 5 + 1).cast("int")).alias("correctOptionId"), F.repeat(F.lit("e"), (k % 50).cast("int")).alias("explanation"),
        F.array_repeat(reference, (k % 3).cast("int")).alias("references"), F.when(k % 10 == 0, F.array(F.lit("one"), F.lit("one"))).otherwise(F.array(F.lit("one"), F.lit("two"))).alias("tags"),
        F.struct(
            F.when(k % 8 != 0, True).alias("referenceChecked"), F.lit(False).alias("singleCorrectAnswerChecked"), nth(["none", "possible", None], 3).alias("doctrinalSensitivity"),
            F.repeat(F.lit("n"), (k % 700).cast("int")).alias("notes"),
        ).alias("review"),
    )


@query(
    "q66_published_rules",
    f"""WITH {QUESTIONS_SQL}, r AS (SELECT id, k, unnest([
            CASE WHEN NOT regexp_full_match(id, 'qb-[a-z0-9]+(-[a-z0-9]+)*') THEN 'id_pattern' END, CASE WHEN version <> 1 THEN 'version_is_1' END, CASE WHEN status = 'lost' THEN 'status_known' END,
            CASE WHEN language <> 'es' THEN 'language_es' END, CASE WHEN category = 'a--b' THEN 'category_slug' END, CASE WHEN difficulty = 'expert' THEN 'difficulty_known' END,
            CASE WHEN length(prompt) < 10 THEN 'prompt_length' END, CASE WHEN n_options NOT IN (3, 4) THEN 'options_count' END, CASE WHEN n_options = 5 THEN 'option_ids' END,
            CASE WHEN correct = 'e' THEN 'correct_id' END, CASE WHEN length(explanation) < 20 THEN 'explanation_length' END, CASE WHEN n_references = 0 THEN 'has_reference' END,
            CASE WHEN n_references > 0 AND chapter = 0 THEN 'reference_fields' END, CASE WHEN NOT checked OR sensitivity IS NULL THEN 'review_fields' END, CASE WHEN length(notes) > 500 THEN 'review_notes' END,
            CASE WHEN k % 10 = 0 THEN 'tags' END, CASE WHEN k % 12 = 0 THEN 'content_type_known' END,
            CASE WHEN strpos('abcde', correct) > n_options THEN 'one_correct_option' END, CASE WHEN sensitivity = 'possible' AND status = 'approved' OR sensitivity IS NULL AND status = 'approved' THEN 'sensitive_not_approved' END,
            CASE WHEN n_options > 0 AND k % 14 = 0 THEN 'no_catch_all_option' END]) AS rule FROM c)
        SELECT k, id, rule FROM r WHERE rule IS NOT NULL""",
)
def q66(spark, sf):
    """The rules of the published schema and the editorial rules, on questions made of parts' numbers."""
    keyed = published(spark, sf).withColumn("key", F.struct("k", "id"))
    return bank.violations(keyed, bank.content_rules() | bank.policy_rules(), "key").select("key.k", "key.id", "rule")


@query(
    "q79_schema_violations",
    f"""WITH {QUESTIONS_SQL}, r AS (SELECT k, unnest([
            CASE WHEN NOT regexp_full_match(id, 'qb-[a-z0-9]+(-[a-z0-9]+)*') THEN '/id pattern ' END, CASE WHEN k % 17 = 0 THEN ' required version' WHEN version <> 1 THEN '/version const ' END,
            CASE WHEN status = 'lost' THEN '/status enum ' END, CASE WHEN language <> 'es' THEN '/language const ' END, CASE WHEN category = 'a--b' THEN '/category pattern ' END,
            CASE WHEN difficulty = 'expert' THEN '/difficulty enum ' END, CASE WHEN length(prompt) < 10 THEN '/prompt minLength ' END,
            CASE WHEN n_options < 3 THEN '/options minItems ' WHEN n_options > 4 THEN '/options maxItems ' END, CASE WHEN n_options = 5 THEN '/options/4/id pattern ' END,
            CASE WHEN correct = 'e' THEN '/correctOptionId pattern ' END, CASE WHEN length(explanation) < 20 THEN '/explanation minLength ' END, CASE WHEN n_references = 0 THEN '/references minItems ' END,
            CASE WHEN n_references > 0 AND chapter = 0 THEN '/references/0/chapter minimum ' END, CASE WHEN n_references > 1 AND chapter = 0 THEN '/references/1/chapter minimum ' END,
            CASE WHEN NOT checked THEN '/review required referenceChecked' END, CASE WHEN sensitivity IS NULL THEN '/review required doctrinalSensitivity' END, CASE WHEN length(notes) > 500 THEN '/review/notes maxLength ' END,
            CASE WHEN k % 10 = 0 THEN '/tags uniqueItems ' END, CASE WHEN k % 12 = 0 THEN '/contentType enum ' END, CASE WHEN k % 16 = 0 THEN '/review additionalProperties extra' END,
            CASE WHEN k % 18 = 0 THEN ' additionalProperties zz' END, CASE WHEN k % 19 = 0 THEN '/tags/2 type integer' END]) AS v FROM c WHERE k % 23 <> 0 UNION ALL SELECT k, ' json ' FROM c WHERE k % 23 = 0)
        SELECT k, string_split(v, ' ')[1] AS pointer, string_split(v, ' ')[2] AS keyword, string_split(v, ' ')[3] AS detail FROM r WHERE v IS NOT NULL""",
)
def q79(spark, sf):
    """Questions as JSON texts against the schema as a document: what breaks it, and where. Nulls are missing keys; some
    texts have unknown keys, a value of another type, or are cut off."""
    rows, k = published(spark, sf), F.col("k")
    review = F.struct("review.*", F.when(k % 16 == 0, "x").alias("extra"))
    fields = [F.when(k % 17 != 0, F.col("version")).alias("version") if c == "version" else review.alias("review") if c == "review" else F.col(c) for c in rows.columns if c != "k"]
    whole = F.to_json(F.struct(*fields, F.when(k % 18 == 0, "y").alias("zz")))
    odd = F.when(k % 19 == 0, F.regexp_replace(whole, '("tags":\\[[^\\]]*)\\]', "$1,7]")).otherwise(whole)
    raw = F.when(k % 23 == 0, F.substring(odd, F.lit(1), F.length(odd) - 1)).otherwise(odd)
    return json_schema.violations(rows.select("k", raw.alias("raw")), question_schema.QUESTION, "k")


@query(
    "q80_reused_ids",
    """WITH v AS (SELECT o_orderkey % 4 + 1 AS version, o_custkey AS id, min(o_orderkey) AS m FROM orders GROUP BY ALL),
            b AS (SELECT version, id, CASE WHEN m % 3 = 0 THEN 'retired' ELSE 'approved' END AS status, m // 4000 AS content FROM v)
       SELECT * FROM (SELECT n.id, n.version, CASE WHEN bool_or(f.status = 'retired' AND NOT (f.content = n.content AND n.status = 'retired')) THEN 'retired_id_reused'
                                                   WHEN max(f.version) < n.version - 1 AND arg_max(f.content, f.version) <> n.content THEN 'withdrawn_id_reused' END AS rule
                      FROM b n JOIN b f ON f.id = n.id AND f.version < n.version GROUP BY n.id, n.version, n.status, n.content) WHERE rule IS NOT NULL""",
)
def q80(spark, sf):
    """Orders as four banks, customers as questions: ids that later banks take up again."""
    rows = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 4 + 1).alias("version"), F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("m"))
    banks = rows.select("version", "id", F.when(F.col("m") % 3 == 0, "retired").otherwise("approved").alias("status"), F.floor(F.col("m") / 4000).alias("content"))
    return bank.reused_ids(bank.history(banks, ["content"]), banks, F.col("version"), ["content"])


@query(
    "q83_envelopes",
    """SELECT chapter, '{"schema_version":"v1","requires_human_review":true,"book":"C","chapter":' || chapter || ',"verse_count":' || count(*) || ',"items":[' ||
              string_agg('{"verse_number":' || turn || ',"reference":"C ' || chapter || ':' || turn || '","question":null,"options":[],"status":"pending_generation"}', ',' ORDER BY turn) || ']}' AS document
       FROM (SELECT conv_id AS chapter, turn FROM conversations) GROUP BY chapter""",
)
def q83(spark, sf):
    """The candidates of each conversation as one document."""
    verses = table(spark, sf, "conversations").select(F.lit("C").alias("book"), F.col("conv_id").alias("chapter"), F.col("turn").alias("verse_number"), F.lit(None).cast("string").alias("reference_from_api"))
    rows = passages.candidates(verses, "book", "chapter")
    made = bank.envelope(rows, ["book", "chapter"], "verse_number", "verse_count", ["verse_number", "reference", "question", "options", "status"], schema_version="v1", requires_human_review=True)
    return made.select("chapter", F.to_json(F.struct(*made.columns), {"ignoreNullFields": "false"}).alias("document"))


@query(
    "q71_generated_bank",
    f"""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE {STRIPPED} <> '' GROUP BY conv_id)
        SELECT conv_id, CASE WHEN conv_id % 6 IN (3, 4) THEN 'no_items' WHEN conv_id % 6 = 1 OR conv_id % 7 = 3 THEN 'verse_numbers' WHEN conv_id % 6 = 2 THEN 'option_count'
                             WHEN conv_id % 6 = 5 THEN 'unknown_difficulty' END AS error, CASE WHEN conv_id % 6 = 0 AND conv_id % 7 <> 3 THEN n ELSE 0 END AS n_rows FROM c""",
)
def q71(spark, sf):
    """Recorded model responses for passages made of the conversations: bank rows, or a chapter's first error.
    By the conversation's number, responses lack an option, items or order, and passages failed."""
    from attesta.plans import flows

    c = F.col("conv_id")
    rows = table(spark, sf, "conversations").filter(bank.filled(F.col("text"))).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text", "role")))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("ts"))
    number = lambda t: F.when((c % 6 == 1) & (t["n"] == 1), 99).otherwise(t["n"])
    items = F.transform("ts", lambda t: F.struct(
        number(t).alias("verse_number"), F.format_string("¿Qué dice el turno %d?", t["n"]).alias("question"),
        F.slice(F.array(*map(F.lit, "abcd")), F.lit(1), F.when((c % 6 == 2) & (t["n"] == F.size("ts")), 3).otherwise(4)).alias("options"), F.lit("a").alias("correct_answer"),
        F.lit("porque sí").alias("explanation"), F.when((c % 6 == 5) & (t["n"] == 1), "hardest").otherwise("easy").alias("difficulty"), F.lit("eventos").alias("category"),
    ))
    text = F.when(c % 6 == 4, F.lit('{"other": []}')).otherwise(F.to_json(F.struct(items.alias("items"))))
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    verses = F.transform("ts", lambda t: F.struct(t["n"].alias("verse"), t["text"].alias("text")))
    book = F.lit("Libro")
    given = turns.select(book.alias("book"), c.cast("int").alias("chapter"), F.to_json(F.struct((c % 7 != 3).alias("success"), verses.alias("verses"))).alias("payload"))
    answers = turns.select(book.alias("book"), c.cast("int").alias("chapter"), F.when(c % 6 == 3, "{").otherwise(answer).alias("raw"))
    made, errors = flows.generation_flow(given, answers)
    counts = made.groupBy(F.regexp_extract("id", r"^LIBRO_(\d+)_", 1).cast("int").alias("chapter")).agg(F.count("*").alias("n"))
    every = turns.select("conv_id", c.cast("int").alias("chapter")).join(errors.select("chapter", "error"), "chapter", "left").join(counts, "chapter", "left")
    return every.select("conv_id", "error", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query(
    "q48_positional_join",
    """WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user'),
            a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'assistant')
       SELECT u.conv_id, u.pos, u.turn AS user_turn, a.turn AS assistant_turn FROM u JOIN a USING (conv_id, pos)""",
)
def q48(spark, sf):
    def side(role: str) -> DataFrame:
        rows = table(spark, sf, "conversations").filter(F.col("role") == role).select("conv_id", F.col("turn").alias(f"{role}_turn"))
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(f"{role}_turn")).cast("bigint"))

    return side("user").join(side("assistant"), ["conv_id", "pos"])


@query("q49_answer_in_options", "SELECT o_orderkey, bool_or(l_linenumber = o_custkey % 7) AS contained FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def q49(spark, sf):
    options = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("bigint")).alias("options"))
    rows = table(spark, sf, "orders").join(options, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", bank.sure(F.array_contains("options", F.col("o_custkey") % 7)).alias("contained"))


@query(
    "q58_nested_projection",
    """SELECT o_orderkey, o_orderpriority AS impact, string_agg(l_linenumber::VARCHAR || '/' || l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS nodes
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def q58(spark, sf):
    nodes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("nodes"))
    rows = table(spark, sf, "orders").join(nodes, F.col("l_orderkey") == F.col("o_orderkey"))
    short = F.transform("nodes", lambda n: F.struct(F.concat_ws("/", n["l_linenumber"].cast("string"), n["l_returnflag"]).alias("target")))
    return rows.select("o_orderkey", F.col("o_orderpriority").alias("impact"), F.array_join(F.transform(short, lambda n: n["target"]), " ").alias("nodes"))


@query(
    "q61_report_json",
    """SELECT o_custkey, '{"header":{"customer":' || o_custkey || ',"count":' || count(*) || '},"orders":[' ||
              string_agg('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","note":null}', ',' ORDER BY o_orderkey) || ']}' AS report
       FROM orders GROUP BY o_custkey""",
)
def q61(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note")))).alias("orders"),
        F.count("*").alias("count"),
    )
    header = F.struct(F.col("o_custkey").alias("customer"), "count").alias("header")
    return rows.select("o_custkey", F.to_json(F.struct(header, "orders"), {"ignoreNullFields": "false"}).alias("report"))


@query(
    "q62_prompt_json",
    """SELECT conv_id, sha256('Rules: ' || '[' || string_agg('{"verse_number":' || turn || ',"text":' || to_json(text)::VARCHAR || '}', ',' ORDER BY turn) || ']') AS prompt_sha256
       FROM conversations GROUP BY conv_id""",
)
def q62(spark, sf):
    verses = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("verse_number"), "text")
    return bank.prompt(verses, ["conv_id"], "Rules: ").select("conv_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("q63_superset", "SELECT conv_id, bool_or(role = 'user') AND bool_or(role = 'system') AS has_all FROM conversations GROUP BY conv_id")
def q63(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return rows.select("conv_id", (F.size(F.array_except(F.array(F.lit("user"), F.lit("system")), "roles")) == 0).alias("has_all"))
