"""Question banks: which questions can be played, what is wrong with generated ones, and the content rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import text as tx
from attesta.operators import json_schema

# Fixed values.
DIFFICULTIES = ("easy", "medium", "hard")
STATUSES = ("draft", "reviewed", "approved", "retired")
LEVELS = ("beginner", "intermediate", "advanced")
CONTENT_TYPES = ("textual_fact", "contextual")
SENSITIVITIES = ("none", "possible")
MIN_COPY = 40


def sure(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def filled(c: Column) -> Column:
    return sure(F.length(tx.strip(c)) > 0)


def is_playable() -> Column:
    """For rows of the published schema: approved, three options or more, one of them
    correct, prompt and explanation filled, some reference to display."""
    return sure(
        (F.col("status") == "approved")
        & (F.size("options") >= 3)
        & (F.length("correctOptionId") > 0)
        & F.exists("options", lambda o: sure(o["id"] == F.col("correctOptionId")))
        & filled(F.col("prompt"))
        & filled(F.col("explanation"))
        & F.exists("references", lambda r: filled(r["display"]))
    )


RULES = (
    "not_an_object", "missing_field", "citation_in_question", "duplicate_question", "option_count", "duplicate_option", "answer_not_in_options",
    "unknown_difficulty", "source_copied",
)


def repeated(rows: DataFrame, keys: list[str], digest: str, order: str) -> DataFrame:
    """keys, digest and first: the least order of each digest that occurs more than once under its
    keys. A partial aggregate, so a digest in very many rows is one row a task."""
    found = rows.groupBy(*keys, digest).agg(F.min(order).alias("first"), F.max(order).alias("__last"))
    return found.filter(F.col("first") < F.col("__last")).drop("__last")


def item_errors(items: DataFrame, keys: list[str], order: str = "verse_number") -> DataFrame:
    """keys, order and error: the first rule that each item breaks, null if none.

    items: keys, order, question, explanation, category, difficulty, correct_answer,
    options, source (the verse's text), and is_object if some are none. A question counts as a duplicate if an item of
    lesser order under the same keys has the same normal form; the forms are compared
    by 256-bit digests, so no text leaves its row. Keys and order are not null.
    """
    question = tx.normalize_spaces(F.col("question"))
    options = F.transform("options", tx.strip)
    source = F.coalesce("source", F.lit(""))

    def copied(norm: Column) -> Column:
        explanation = tx.normalize_spaces(F.col("explanation"))
        return tx.let(tx.normalize_spaces(source), lambda s: (F.length(s) >= MIN_COPY) & (F.contains(norm, s) | F.contains(explanation, s)))

    before = (
        ~F.col("is_object") if "is_object" in items.columns else F.lit(False),
        ~(filled(F.col("question")) & filled(F.col("explanation")) & filled(F.col("category"))),
        tx.has_citation(F.col("question")),
    )
    after = (
        F.coalesce(F.size("options"), F.lit(-1)) != 4,
        F.size(F.array_distinct(F.transform(options, tx.normalize_spaces))) != 4,
        ~sure(F.array_contains(options, tx.strip(F.col("correct_answer")))),
        ~sure(tx.strip(F.col("difficulty")).isin(*DIFFICULTIES)),
        copied(F.col("__norm")),
    )

    def broken(rules: tuple[str, ...], checks: tuple[Column, ...]) -> Column:
        return F.coalesce(*[F.when(sure(c), F.lit(r)) for r, c in zip(rules, checks, strict=True)])

    digest = F.sha2("__norm", 256).alias("__digest")
    normal = items.withColumn("__norm", question)
    rows = normal.select(*keys, order, digest, broken(RULES[:3], before).alias("__before"), broken(RULES[4:], after).alias("__after"))
    firsts = repeated(items.withColumn("__norm", question).select(*keys, order, digest), keys, "__digest", order)
    again = F.when(F.col(order) > F.col("first"), RULES[3])
    return rows.join(firsts, [*keys, "__digest"], "left").select(*keys, order, F.coalesce("__before", again, "__after").alias("error"))


def first_error(rows: DataFrame, keys: list[str], order: str = "verse_number") -> DataFrame:
    """The error of the first item that has one, under each key; null if none has."""
    return rows.groupBy(*keys).agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col(order))).alias("error"))


def number_lists_equal(verses: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Whether verses and items hold the same numbers in the same order (both have pos, verse_number):
    whether each place has the same number in both."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "verse_number"))
    a, b = (df.select(*keys, place.alias("__place"), F.struct("verse_number").alias(name)) for df, name in ((verses, "a"), (items, "b")))
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a.verse_number").eqNullSafe(F.col("b.verse_number"))
    return a.join(b, [*keys, "__place"], "full").groupBy(*keys).agg(F.min(same).alias("equal"))


def bank_rows(items: DataFrame) -> DataFrame:
    """Rows of the derived bank for valid items (book, chapter, verse_number, ...)."""
    number = F.col("verse_number")
    return items.select(
        tx.item_id(F.col("book"), F.col("chapter"), number).alias("id"),
        number,
        tx.range_label(F.col("book"), F.col("chapter"), number, number).alias("reference"),
        tx.strip(F.col("question")).alias("question"),
        F.transform("options", tx.strip).alias("options"),
        *[tx.strip(F.col(c)).alias(c) for c in ("correct_answer", "explanation", "difficulty", "category")],
        F.lit("generated_pending_review").alias("status"),
        F.lit(False).alias("source_text_persisted"),
    )


def length_between(c: Column, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def content_rules() -> dict[str, Column]:
    """Rules of the published schema, each true where it holds; a null value breaks it."""
    o, r = F.col("options"), F.col("references")
    return {
        "id_pattern": F.rlike("id", F.lit("^qb-[a-z0-9]+(?:-[a-z0-9]+)*$")),
        "version_is_1": F.col("version") == 1,
        "status_known": F.col("status").isin(*STATUSES),
        "language_es": F.col("language") == "es",
        "category_slug": (F.length("category") >= 2) & F.rlike("category", F.lit(SLUG)),
        "difficulty_known": F.col("difficulty").isin(*LEVELS),
        "content_type_known": F.col("contentType").isin(*CONTENT_TYPES),
        "prompt_length": length_between(F.col("prompt"), 10, 240),
        "options_count": F.size(o).between(3, 4),
        "options_unique": F.size(F.array_distinct(o)) == F.size(o),
        "option_ids": F.forall(o, lambda x: sure(F.rlike(x["id"], F.lit("^[a-d]$")))),
        "option_texts": F.forall(o, lambda x: sure(length_between(x["text"], 1, 160))),
        "correct_id": F.rlike("correctOptionId", F.lit("^[a-d]$")),
        "explanation_length": length_between(F.col("explanation"), 20, 600),
        "has_reference": F.size(r) >= 1,
        "reference_fields": F.forall(
            r,
            lambda x: sure(
                length_between(x["book"], 2, 40)
                & (x["chapter"] >= 1)
                & (x["verseStart"] >= 1)
                & (F.coalesce(x["verseEnd"], F.lit(1)) >= 1)
                & length_between(x["display"], 4, 80)
                & length_between(x["translation"], 2, 80)
                & (F.length(F.coalesce(x["note"], F.lit(""))) <= 300)
            ),
        ),
        "tags": (F.size(F.array_distinct("tags")) == F.size("tags")) & F.forall("tags", lambda x: sure(length_between(x, 2, 40) & F.rlike(x, F.lit(SLUG)))),
        "review_fields": F.col("review.referenceChecked").isNotNull()
        & F.col("review.singleCorrectAnswerChecked").isNotNull()
        & F.col("review.doctrinalSensitivity").isin(*SENSITIVITIES)
        & F.col("review.notes").isNotNull(),
        "review_notes": F.length(F.coalesce(F.col("review.notes"), F.lit(""))) <= 500,
    }


def policy_rules() -> dict[str, Column]:
    """Editorial rules that are stated but not enforced at play time."""
    return {
        "one_correct_option": F.size(F.filter("options", lambda x: x["id"] == F.col("correctOptionId"))) == 1,
        "sensitive_not_approved": ~((F.col("review.doctrinalSensitivity") == "possible") & (F.col("status") == "approved")),
        "no_catch_all_option": ~F.exists("options", lambda x: tx.normalize(x["text"]).isin("todas las anteriores", "ninguna de las anteriores")),
    }


def history(versions: DataFrame, content: list[str]) -> DataFrame:
    """id, status, digest (of content), since and until: the intervals of versions in which a question
    stayed the same. versions (version, id, status, ...) hold all banks published so far, each
    with all its questions; until is the version in which the question changed or was gone, null if it still holds."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    order = versions.select("version").distinct()
    order = order.withColumn("following", F.lead("version").over(Window.orderBy("version")))  # a row for each published bank
    each = versions.select("version", "id", "status", digest.alias("digest")).join(order, "version")
    by_id = Window.partitionBy("id").orderBy("version")  # as many rows as there are banks, at most
    same = (F.lag("status").over(by_id) == F.col("status")) & (F.lag("digest").over(by_id) == F.col("digest")) & (F.lag("following").over(by_id) == F.col("version"))
    runs = each.withColumn("new", F.when(sure(same), 0).otherwise(1)).withColumn("run", F.sum("new").over(by_id))
    return runs.groupBy("id", "run", "status", "digest").agg(F.min("version").alias("since"), F.max_by("following", "version").alias("until")).drop("run")


def reused_ids(former: DataFrame, rows: DataFrame, version: int | Column, content: list[str]) -> DataFrame:
    """id, version and rule of the questions of a bank (id, status, content) of a version that take up an id that
    was retired before (`retired_id_reused`, unless it is the retired question itself, still retired), or one
    that was withdrawn, with another content (`withdrawn_id_reused`). former: the history; what began later is not looked at."""
    version = F.lit(version) if isinstance(version, int) else version
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    mine = rows.select("id", F.col("status").alias("__status"), digest.alias("__digest"), version.alias("__version"))
    before = mine.join(former, "id").filter(F.col("since") < F.col("__version"))
    same = F.col("digest") == F.col("__digest")
    retired = (F.col("status") == "retired") & ~(same & (F.col("__status") == "retired"))
    last = before.groupBy("id", "__version").agg(
        F.max(retired).alias("retired"), F.max_by(same, F.col("since")).alias("same"), F.max_by("until", F.col("since")).alias("gone")
    )
    # a question that a bank lacked has an end before the bank's own version; one that only changed ends with it
    rule = F.when(F.col("retired"), "retired_id_reused").when(sure(F.col("gone") < F.col("__version")) & ~F.col("same"), "withdrawn_id_reused")
    return last.select("id", F.col("__version").alias("version"), rule.alias("rule")).filter("rule IS NOT NULL")


def violations(rows: DataFrame, rules: dict[str, Column], id_col: str = "id") -> DataFrame:
    """A row (id, rule) per broken rule."""
    broken = F.array_compact(F.array(*[F.when(~sure(c), F.lit(name)) for name, c in rules.items()]))
    return rows.select(id_col, F.explode(broken).alias("rule"))


def as_text(v: Column) -> Column:
    """A JSON value as text, stripped: a missing one is empty, an explicit null is None, truth is True or False."""

    def told(p: Column) -> Column:
        of = json_schema.kind(p)
        word = F.when(of == "null", "None").when(of == "boolean", F.initcap(F.to_json(p))).when(of == "string", F.try_variant_get(p, "$", "string")).otherwise(F.to_json(p))
        return F.when(p.isNull(), "").otherwise(tx.strip(word))

    return tx.let(v, told)


def generated_items(raw: Column) -> Column:
    """array<struct>: the items of a recorded model response (JSON text inside JSON): is_object, verse_number (if it
    is a whole number), question, options (null if it is no list), correct_answer, explanation, difficulty and category as text.
    Null if the response cannot be read, or its items are no list."""
    text = F.get_json_object(raw, "$.candidates[0].content.parts[0].text")
    items = F.try_variant_get(F.try_parse_json(text), "$.items", "array<variant>")

    def item(v: Column) -> Column:
        number = F.try_variant_get(v, "$.verse_number", "double")
        given = F.try_variant_get(v, "$.verse_number", "variant")
        whole = json_schema.kind(given) == "integer"
        options = F.transform(F.try_variant_get(v, "$.options", "array<variant>"), as_text)
        fields = [as_text(F.try_variant_get(v, f"$.{c}", "variant")).alias(c) for c in ("question", "correct_answer", "explanation", "difficulty", "category")]
        return F.struct((json_schema.kind(v) == "object").alias("is_object"), F.when(whole, number.cast("bigint")).alias("verse_number"), options.alias("options"), *fields)

    return F.transform(items, item)


def envelope(rows: DataFrame, keys: list[str], order: str, count: str, fields: list[str], **header: str | bool) -> DataFrame:
    """A row for each chapter (keys): the header, the number of items (under the name count) and the items in
    order, as a document has them. A chapter is one cell by its meaning."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__order"), F.struct(*fields).alias("item")))), lambda x: x["item"])
    made = rows.groupBy(*keys).agg(F.count("*").alias(count), items.alias("items"))
    return made.select(*[F.lit(v).alias(k) for k, v in header.items()], *keys, count, "items")


def reference_display(references: Column) -> Column:
    """What the references of a question display, joined; those that display nothing are left out."""
    return F.array_join(F.filter(F.transform(references, lambda r: r["display"]), lambda d: F.length(d) > 0), " · ")


def prompt(verses: DataFrame, keys: list[str], rules: str) -> DataFrame:
    """rules followed by the JSON of the verses (number and text only), in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("verse_number", "text"))), lambda x: F.struct(x["verse_number"].alias("verse_number"), x["text"].alias("text")))
    return verses.groupBy(*keys).agg(F.concat(F.lit(rules), F.to_json(listed)).alias("prompt"))


def parameters_ok(chapter: int, version: str, allowed: str, key: str | None = None) -> None:
    """Guards at the boundary: raises ValueError."""
    if chapter < 1:
        raise ValueError("chapter must be 1 or more")
    if version.strip().upper() != allowed:
        raise ValueError(f"version must be {allowed}")
    if key is not None and not key.strip():
        raise ValueError("a key is needed")
