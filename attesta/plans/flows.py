"""Whole flows from input files' rows to reports, composed of the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import text as tx
from attesta.operators import audit as au
from attesta.operators import bank, passages, progress, scan, site
from attesta.sources.readers import TEXT_SUFFIXES

# Files that a site must have.
REQUIRED_FILES = ("index.html", "favicon.svg", "privacy/index.html", "sitemap.xml", "README.md", ".nojekyll")
#: Codes of outcomes: of the connection, of the response and of what it holds.
CODES = {"key": 10, "network": 11, "status": 12, "chapter": 20, "chapter_network": 21, "response": 22, "verses": 30}
CHECKS = ("required", "conflict", "html", "css", "seo", "sitemap")


def chapter_verses(payloads: DataFrame, strict_zero: bool = True) -> DataFrame:
    """Verses (book, chapter, pos, verse_number, text, reference_from_api) of recorded
    responses (book, chapter, payload); those that report failure give none."""
    keyed = payloads.filter(passages.succeeded(F.col("payload"))).select(F.to_json(F.struct("book", "chapter")).alias("k"), "payload")
    rows = passages.extract_verses(keyed, "k", strict_zero=strict_zero)
    key = F.from_json("k", "book string, chapter int")
    return rows.select(key["book"].alias("book"), key["chapter"].alias("chapter"), "pos", "verse_number", "text", "reference_from_api")


def audit_flow(questions: DataFrame, payloads: DataFrame) -> DataFrame:
    """Verdicts for the questions of audit specs over the responses of their chapters; of verses
    with one number the last counts."""
    verses = passages.last_wins(chapter_verses(payloads), ["book", "chapter", "verse_number"], F.col("pos"), "text")
    return au.audit(questions, verses)


def extraction_report(payloads: DataFrame) -> DataFrame:
    """Per chapter: verses, duplicate numbers, whether they are 1..n, text nodes with their
    characters (blank ones, which are no verses, included), the code of the outcome and when it was made."""
    verses = chapter_verses(payloads)
    keys = ["book", "chapter"]
    tree = payloads.select(F.to_json(F.struct(*keys)).alias("k"), "payload", (~passages.succeeded(F.col("payload"))).alias("failed"))
    tree = passages.count_text_nodes(tree, "k").join(tree.select("k", "failed").distinct(), "k").groupBy("k").agg(F.sum("nodes").alias("nodes"), F.sum("chars").alias("chars"), F.max("failed").alias("failed"))
    key = F.from_json("k", "book string, chapter int")
    tree = tree.select(key["book"].alias("book"), key["chapter"].alias("chapter"), "nodes", "chars", "failed")
    count = verses.groupBy(*keys).agg(F.count("*").alias("verse_count"), F.sum(F.length("text")).cast("bigint").alias("verse_chars"))
    twice = passages.duplicate_numbers(verses, keys, "verse_number")
    ordered = passages.sequential(verses, keys, "verse_number", "pos")
    rows = payloads.select(*keys).distinct().join(count, keys, "left").join(twice, keys, "left").join(ordered, keys, "left").join(tree, keys, "left")
    code = F.when(F.col("failed"), CODES["response"]).when(F.col("verse_count").isNull(), CODES["verses"]).otherwise(0)
    return rows.select(
        *keys,
        F.coalesce("nodes", F.lit(0)).alias("text_nodes_detected"),
        F.coalesce("chars", F.lit(0)).alias("character_count_detected"),
        code.alias("code"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("processed_at_utc"),
        F.coalesce("verse_count", F.lit(0)).alias("verse_count"),
        F.coalesce("verse_chars", F.lit(0)).alias("verse_chars"),
        F.coalesce("duplicates", F.array().cast("array<bigint>")).alias("duplicates"),
        F.coalesce("sequential", F.lit(False)).alias("sequential"),
        F.lit(False).alias("source_text_persisted"),
    )


def generation_flow(payloads: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bank rows, errors) from passages (book, chapter, payload) and recorded model responses
    (book, chapter, raw). A chapter with any error gives its first error and no rows."""
    keys = ["book", "chapter"]
    verses = chapter_verses(payloads, strict_zero=False)
    decoded = responses.select(*keys, bank.generated_items(F.col("raw")).alias("items"))
    items = decoded.select(*keys, F.posexplode("items").alias("p", "i")).select(*keys, (F.col("p") + 1).cast("bigint").alias("pos"), "i.*")
    same = bank.number_lists_equal(verses, items.filter("is_object"), keys)
    joined = items.join(verses.select(*keys, "pos", F.col("text").alias("source")), [*keys, "pos"])
    first = bank.first_error(bank.item_errors(joined, keys, "pos"), keys, "pos")
    unreadable = F.when(F.col("items").isNull(), "no_items")
    errors = (
        decoded.select(*keys, unreadable.alias("e0"))
        .join(same, keys, "left")
        .join(first, keys, "left")
        .select(*keys, F.coalesce("e0", F.when(~F.coalesce("equal", F.lit(False)), "verse_numbers"), "error").alias("error"))
    )
    good = errors.filter("error IS NULL").select(*keys)
    return bank.bank_rows(joined.join(good, keys, "left_semi")), errors.filter("error IS NOT NULL")


def restore(questions: DataFrame, stored: DataFrame) -> DataFrame:
    """user_id, answered, idx, completed, restored for stored records (user_id, raw) over the
    playable questions (pos from 1, id, options). A record that can't be used gives index 0.

    Only the answers a record has are joined to the questions; a gap shows where the places of
    the valid ones do not count on from 1."""
    bank_rows = questions.select("pos", "id", F.transform("options", lambda o: o["id"]).alias("ids"))
    total = bank_rows.agg(F.count("*").alias("total"))  # one row
    records = stored.select("user_id", progress.stored_progress(F.col("raw")).alias("s"))
    given = records.select("user_id", F.explode(F.map_entries("s.answers")).alias("a")).select("user_id", F.col("a.key").alias("id"), F.col("a.value").alias("mine"))
    valid = given.join(bank_rows, "id").filter(bank.sure(F.array_contains("ids", F.col("mine"))))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("pos"))
    prefix = valid.withColumn("n", place).filter(F.col("n") == F.col("pos")).groupBy("user_id").agg(F.count("*").alias("answered"))
    at = records.select("user_id", F.col("s.currentQuestionId").alias("id")).join(bank_rows.select("id", "pos"), "id").groupBy("user_id").agg((F.min("pos") - 1).cast("bigint").alias("stored"))
    rows = records.join(prefix, "user_id", "left").join(at, "user_id", "left").crossJoin(total)
    rows = rows.withColumns({"answered": F.coalesce("answered", F.lit(0)), "stored": F.coalesce("stored", F.lit(-1))})
    index, done, restored = progress.resume(F.col("answered"), F.col("total"), F.col("stored"), F.col("s.completed"))
    usable = F.col("s").isNotNull()
    return rows.select(
        "user_id",
        F.when(usable, F.col("answered")).otherwise(0).alias("answered"),
        F.when(usable, index).otherwise(0).alias("idx"),
        (usable & done).alias("completed"),
        (usable & restored).alias("restored"),
    )


def progress_record(question_id: Column, answers: Column, completed: Column) -> Column:
    """The JSON to store for a user's progress."""
    return F.to_json(F.struct(F.lit(progress.VERSION).alias("version"), question_id.alias("currentQuestionId"), answers.alias("answers"), completed.alias("completed")))


def site_findings(files: DataFrame, host: str | None = None, prefix: str = "/") -> DataFrame:
    """(seq, check_name, subject, detail) for the files of a site (path, text, suffix); text is
    null where it is no UTF-8. seq orders the checks as they are listed in CHECKS. With the host and
    the prefix that the site is published under, absolute links to it are checked, too, and
    what the home page says of its own address."""

    def finding(df: DataFrame, check: str, subject: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(CHECKS.index(check)).alias("seq"), F.lit(check).alias("check_name"), subject.alias("subject"), detail.alias("detail"))

    spark = files.sparkSession
    out = []
    required = spark.range(1).select(F.explode(F.array(*map(F.lit, REQUIRED_FILES))).alias("path"))
    out.append(finding(required.join(files.select("path"), "path", "left_anti"), "required", F.col("path"), F.lit("missing file")))

    plain = files.filter(F.col("suffix").isin(*TEXT_SUFFIXES) | F.endswith("path", F.lit(".nojekyll")))
    out.append(finding(plain.filter(bank.sure(tx.has_conflict_marker(F.col("text")))), "conflict", F.col("path"), F.lit("merge-conflict marker")))

    pages = files.filter(F.col("suffix").isin("html", "htm"))
    out.append(finding(pages.filter("text IS NULL"), "html", F.col("path"), F.lit("not UTF-8")))
    facts = site.html_facts(pages, "path", "text")
    tags = facts.filter("kind = 'tag'")
    lacking = site.missing(pages, "path", tags, "key", site.REQUIRED_TAGS)
    out.append(finding(lacking, "html", F.col("path"), F.concat(F.lit("missing <"), F.col("key"), F.lit(">"))))
    out.append(finding(facts.filter("kind = 'title' AND value = ''"), "html", F.col("path"), F.lit("missing or empty <title>")))
    out.append(finding(site.duplicate_ids(facts, "path"), "html", F.col("path"), F.concat(F.lit("duplicate id "), F.col("id"))))

    ids = facts.filter("kind = 'id'").select("path", F.col("key").alias("id")).distinct()
    css = files.filter("suffix = 'css' AND text IS NOT NULL").select("path", F.explode(tx.css_urls(F.col("text"))).alias("u"))
    css = css.select("path", F.regexp_replace(tx.strip(F.col("u")), "^[\"']+|[\"']+$", "").alias("u")).filter(tx.is_checked_css_url(F.col("u")))
    edges = {
        "html": facts.filter("kind = 'ref'").select(F.col("path").alias("source"), F.col("key").alias("attribute"), F.col("value").alias("reference")),
        "css": css.select(F.col("path").alias("source"), F.lit("url()").alias("attribute"), F.col("u").alias("reference")),
        "seo": facts.filter("path = 'index.html' AND value <> '' AND ((kind = 'property' AND key = 'og:image') OR (kind = 'name' AND key = 'twitter:image'))").select(
            F.col("path").alias("source"), F.col("key").alias("attribute"), F.col("value").alias("reference")
        ),
    }
    for check, e in edges.items():
        detail = F.concat_ws(" ", F.lit("broken"), "attribute", "reference")
        out.append(finding(site.broken_links(e, files.select("path"), host, prefix), check, F.col("source"), detail))
        known = site.missing_fragments(e, ids, host, prefix).join(files.select("path"), "path", "left_semi")
        out.append(finding(known, check, F.col("source"), F.concat(F.lit("missing fragment #"), F.col("fragment"))))

    home = pages.filter("path = 'index.html'")
    for kind, keys in (("name", site.REQUIRED_NAMES), ("property", site.REQUIRED_PROPERTIES)):
        given = site.last_value(facts.filter("path = 'index.html'"), "path", kind).filter("value <> ''")
        out.append(finding(site.missing(home, "path", given, "key", keys), "seo", F.col("path"), F.concat(F.lit("missing metadata "), F.col("key"))))
    checked = pages.filter(F.col("path").isin("index.html", "privacy/index.html"))
    described = site.last_value(facts.filter("path = 'privacy/index.html'"), "path", "name").filter("key = 'description' AND value <> ''")
    out.append(finding(checked.filter("path = 'privacy/index.html'").join(described, "path", "left_anti"), "seo", F.col("path"), F.lit("missing metadata description")))
    canonical = facts.filter("kind = 'canonical'").groupBy("path").agg(F.max_by("value", "pos").alias("canonical"))
    out.append(finding(checked.join(canonical, "path", "left_anti"), "seo", F.col("path"), F.lit("missing canonical")))
    out.append(finding(home.join(facts.filter("kind = 'icon'"), "path", "left_anti"), "seo", F.col("path"), F.lit("missing icon")))

    parsed = files.filter("path = 'sitemap.xml' AND text IS NOT NULL").select(site.parsed_sitemap(F.col("text")).alias("s"))
    out.append(finding(parsed.filter("s.error IS NOT NULL"), "sitemap", F.lit("sitemap.xml"), F.col("s.error")))
    out.append(finding(parsed.filter("s.error IS NULL AND size(s.locs) = 0"), "sitemap", F.lit("sitemap.xml"), F.lit("no loc entries")))
    if host is not None:
        address = f"https://{host}{prefix}"
        told = home.select("path").join(canonical, "path")
        url = site.last_value(facts.filter("path = 'index.html'"), "path", "property").filter("key = 'og:url'").select("path", F.col("value").alias("url"))
        told = told.join(url, "path", "left").withColumn("url", F.coalesce("url", F.lit("")))
        for column, name in (("canonical", "canonical"), ("url", "og:url")):
            out.append(finding(told.filter(F.col(column) != address), "seo", F.col("path"), F.concat(F.lit(f"{name} mismatch: "), F.col(column))))
    locs = parsed.select(F.explode("s.locs").alias("loc"))
    out.append(finding(site.sitemap_findings(locs), "sitemap", F.lit("sitemap.xml"), F.concat_ws(" ", "check_name", "subject")))
    absent = checked.join(canonical, "path").join(locs.select(F.col("loc").alias("canonical")), "canonical", "left_anti")
    out.append(finding(absent, "sitemap", F.col("path"), F.concat(F.lit("canonical not listed: "), F.col("canonical"))))
    return reduce(DataFrame.unionByName, out)


def scanned(files: DataFrame) -> DataFrame:
    """The files that are looked at for unsafe patterns."""
    return files.filter(F.col("suffix").isin(*scan.SCANNED) & ~F.startswith("path", F.lit("scripts/")))


def security_report(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row: files scanned and number of findings, the findings), for sinks.write_report."""
    found = scan.security_findings(files.filter("text IS NOT NULL"))
    counted = scanned(files).agg(F.count("*").alias("files")).crossJoin(found.agg(F.count("*").alias("n_findings")))  # one row by one row
    return counted, found


def connection_code(status: Column, error: Column, chapter: bool = False) -> Column:
    """The code of a request's outcome (CODES), 0 if it was answered as it should be: refused, without
    an answer, or answered with another status than 200 (which a chapter's request may be)."""
    refused, lost = (CODES["chapter"], CODES["chapter_network"]) if chapter else (CODES["key"], CODES["network"])
    other = F.lit(0) if chapter else F.when(status != 200, CODES["status"]).otherwise(0)
    return F.when(status.isNull(), lost).when(error.isNotNull(), refused).otherwise(other)


def measured(events: DataFrame, snapshot: DataFrame, origin: str) -> DataFrame:
    """One row of metrics for scan.over_budget: bytes and number of the responses of the site's own
    origin, and what was measured on the page; with the number of errors and whether the page can be used."""
    own = (F.col("kind") == "response") & (F.col("origin") == origin)
    counts = events.agg(
        F.coalesce(F.sum(F.when(own, F.coalesce("bytes", F.lit(0)))), F.lit(0)).alias("bytes"), F.count_if(own).alias("requests"), F.count_if(F.col("kind") == "pageerror").alias("page_errors")
    )
    usable = bank.sure(F.col("main_visible") & (F.length(tx.strip(F.col("h1"))) > 0))
    return counts.crossJoin(snapshot.select("dom_nodes", "dom_ready_ms", "load_ms", usable.alias("usable")).limit(1))  # one row by one row


def consolidated_report(files: DataFrame, metrics: DataFrame | None = None, scenarios: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(header, findings) for sinks.write_report: one row with the number of findings, the metrics (one row of them)
    against their budgets, the scenarios (scenario, success, error), which are as many as a run has, and the failures by
    label in that order; and the security findings as a table of any size."""
    spark = files.sparkSession
    security, found = security_report(files)
    empty = spark.createDataFrame([], "metric string, value bigint, budget bigint, over boolean")
    measured = scan.over_budget(metrics) if metrics is not None else empty
    scenarios = scenarios if scenarios is not None else spark.createDataFrame([], "scenario string, success boolean, error string")
    performance = measured.agg(F.array_sort(F.collect_list(F.struct("metric", "value", "budget", "over"))).alias("performance"))
    resilience = scenarios.agg(F.array_sort(F.collect_list(F.struct("scenario", "success", "error"))).alias("resilience"))
    report = security.crossJoin(performance).crossJoin(resilience)  # three rows of one
    failure = F.concat(
        F.when(F.col("n_findings") > 0, F.array(F.struct(F.lit("security").alias("label"), F.concat(F.col("n_findings").cast("string"), F.lit(" findings")).alias("message")))).otherwise(F.array().cast(FAILURES)),
        F.transform(F.filter("performance", lambda x: x["over"]), lambda x: F.struct(F.lit("performance").alias("label"), F.concat_ws(" ", x["metric"], x["value"].cast("string"), F.lit("over"), x["budget"].cast("string")).alias("message"))),
        F.transform(F.filter("resilience", lambda x: ~x["success"]), lambda x: F.struct(F.concat(F.lit("resilience-"), x["scenario"]).alias("label"), F.coalesce(x["error"], F.lit("")).alias("message"))),
    )
    return report.withColumn("failures", failure.cast(FAILURES)), found


FAILURES = "array<struct<label:string,message:string>>"


def exit_code(findings: DataFrame) -> int:
    """0 if there are no findings, else 1."""
    return int(not findings.isEmpty())


def stage_code(report: DataFrame) -> int:
    """The code of the first chapter (by book and chapter) that failed in an extraction report, else 0."""
    failed = report.filter("code <> 0").orderBy("book", "chapter").select("code").first()
    return failed["code"] if failed else 0
