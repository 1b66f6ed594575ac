"""What a browser logged while it used a page: which entries are errors, and what a viewport lacks.

Log entries (readers.PAGE_EVENT) have a kind: ``request``, ``response``, ``requestfailed``,
``pageerror`` or ``console`` (then level is its type). A finding is check_name, detail.

Edge cases: a malformed or null address belongs to no origin; a console error without a
location counts as the page's own; unknown kinds and null values are no errors; a failed
request without a reason is `unknown`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import scan, site
from attesta.operators.bank import sure

# The least status that is an error, pixels that do not count, the widest screen with a menu.
BAD_STATUS, SLACK, MENU_WIDTH = 400, 2, 900
ESSENTIAL = ("header", "main", "h1", "footer")
CHECKS = ("page_error", "console_error", "request_failed", "bad_status")


def error_kind(origin: str) -> Column:
    """The check that a log entry fails (CHECKS), null if it is no error of the page at this origin."""
    own = site.same_origin(F.col("url"), origin)
    near = (F.coalesce("location", F.lit("")) == "") | site.same_origin(F.col("location"), origin)
    return (
        F.when(F.col("kind") == "pageerror", CHECKS[0])
        .when((F.col("kind") == "console") & (F.col("level") == "error") & near, CHECKS[1])
        .when((F.col("kind") == "requestfailed") & own, CHECKS[2])
        .when((F.col("kind") == "response") & own & (F.col("status") >= BAD_STATUS), CHECKS[3])
    )


def log_findings(log: DataFrame, origin: str) -> DataFrame:
    """viewport, ts, check_name and detail of every error in a log (a table or a stream)."""
    said = F.coalesce("message", F.lit("unknown"))
    detail = (
        F.when(F.col("check_name") == CHECKS[2], F.format_string("%s (%s)", "url", said))
        .when(F.col("check_name") == CHECKS[3], F.format_string("%d %s", "status", "url"))
        .otherwise(said)
    )
    return log.withColumn("check_name", error_kind(origin)).filter("check_name IS NOT NULL").select("viewport", "ts", "check_name", detail.alias("detail"))


def page_findings(pages: DataFrame) -> DataFrame:
    """viewport, check_name and detail for what was seen of a page in each viewport.

    pages: viewport, width, status (of the page itself, null: no answer), title, elements
    (array of selector, found, visible), scroll_x (how far the page scrolls sideways),
    controls (array of label, left, right of the visible ones), menu (button, nav: both
    are there and the button is visible; expanded, visible, left, right once it is open).
    """
    w = F.col("width")

    def of(check: str, detail: Column) -> Column:
        return F.struct(F.lit(check).alias("check_name"), detail.cast("string").alias("detail"))

    seen = F.coalesce("elements", F.array().cast("array<struct<selector:string,found:boolean,visible:boolean>>"))
    lacking = F.transform(
        F.array(*map(F.lit, ESSENTIAL)),
        lambda s: F.when(~F.exists(seen, lambda e: (e["selector"] == s) & sure(e["found"])), of("missing_element", s)).when(
            ~F.exists(seen, lambda e: (e["selector"] == s) & sure(e["visible"])), of("hidden_element", s)
        ),
    )
    outside = F.filter(F.coalesce("controls", F.array().cast("array<struct<label:string,left:double,right:double>>")), lambda c: sure(scan.overflows(scan.rounded(c["left"]), scan.rounded(c["right"]), w)))
    controls = F.transform(outside, lambda c: of("control_outside", F.format_string("%s [%d, %d]", scan.control_label(c["label"]), scan.rounded(c["left"]), scan.rounded(c["right"]))))
    menu = F.col("menu")
    asked = sure((w <= MENU_WIDTH) & menu["button"] & menu["nav"])
    opened = F.when(~sure(menu["visible"]), of("menu_hidden", w)).when(sure(scan.overflows(menu["left"], menu["right"], w)), of("menu_outside", w))
    single = F.array(
        F.when(F.col("status").isNull() | (F.col("status") >= BAD_STATUS), of("page_not_loaded", F.coalesce(F.col("status").cast("string"), F.lit("no answer")))),
        F.when(~sure(F.length(tx.strip(F.col("title"))) > 0), of("empty_title", F.lit(""))),
        F.when(F.col("scroll_x") > SLACK, of("scrolls_sideways", F.col("scroll_x"))),
        F.when(asked & ~sure(menu["expanded"]), of("menu_not_expanded", w)),
        F.when(asked, opened),
    )
    every = F.array_compact(F.concat(single, lacking, controls))
    return pages.select("viewport", F.explode(every).alias("f")).select("viewport", "f.*")


def violation_summary(violations: Column) -> Column:
    """Of each violation of an accessibility check what a report needs: five fields, and two of each node."""
    return F.transform(
        violations,
        lambda v: F.struct(
            v["id"].alias("id"), v["impact"].alias("impact"), v["help"].alias("help"), v["helpUrl"].alias("helpUrl"),
            F.transform(v["nodes"], lambda n: F.struct(n["target"].alias("target"), n["failureSummary"].alias("failureSummary"))).alias("nodes"),
        ),
    )


def blocking(violations: Column) -> Column:
    """The violations that block; a violation without an impact is advisory."""
    return F.filter(violations, lambda v: sure(scan.severity(v["impact"]) == "blocking"))
