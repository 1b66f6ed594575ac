"""Scans of files for unsafe patterns with line numbers; budgets; partitions of findings; geometry.

All patterns are looked for in one pass: an Aho-Corasick automaton of their literals goes
over a text once, and a pattern is tried only where a literal of its own stands. Lines come
from one table of line ends and a binary search. So a text takes time in proportion to its
length and its matches, however many there are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx

# Kinds, the files they apply to and their patterns (words and spaces are ASCII).
PATTERNS = (
    ("private-key", "any", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    ("github-token", "any", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("insecure-resource", "html", r"(?i)\b(?:src|href)\s*=\s*[\"']http://(?!127\.0\.0\.1|localhost)[^\"']+[\"']"),
    ("inline-handler", "html", r"(?i)\son[a-z]+\s*=\s*[\"']"),
    ("blank-target", "html", r"(?i)<a\b[^>]*target\s*=\s*[\"']_blank[\"'][^>]*>"),
    ("eval", "js", r"\beval\s*\("),
    ("new-function", "js", r"\bnew\s+Function\s*\("),
    ("document-write", "js", r"\bdocument\.write\s*\("),
)
#: The literals, one of which stands at the beginning of each match.
LITERALS = {
    "private-key": ("-----begin ",), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "insecure-resource": ("src", "href"),
    "inline-handler": tuple(f"{c}on" for c in " \t\n\r\f\v"), "blank-target": ("<a",), "eval": ("eval",), "new-function": ("new",), "document-write": ("document.write",),
}
SCANNED = ("html", "js", "css")
REQUIRED_REL = ("noopener", "noreferrer")
BLOCKING = ("critical", "serious")
#: metric -> most that is allowed
BUDGETS = {"bytes": 3_000_000, "requests": 100, "dom_nodes": 4_000, "dom_ready_ms": 3_000, "load_ms": 5_000}


@dataclass(frozen=True)
class Rule:
    """A pattern and its literals, in lower case. A literal begins every match, or stands after
    a run of up to `most` characters of `before` that begins it."""

    name: str
    pattern: str
    literals: tuple[str, ...]
    before: str = ""
    most: int = 0
    run: frozenset[str] = field(init=False, default=frozenset())

    def __post_init__(self) -> None:
        object.__setattr__(self, "run", frozenset(c for c in map(chr, range(128)) if self.before and re.match(rf"{self.before}\Z", c)))


def within_a_tag(text: str) -> Callable[[int], int]:
    """For the pattern of links with a blank target: the end of the one that starts at a place, or -1. What it asks for lies
    before the next >, so links that never end, or that share one end, are not gone through again and again."""
    targets = [(m.start(), m.end()) for m in re.finditer(r"(?ia)target\s*=\s*[\"']_blank[\"']", text)]
    starts = [a for a, _ in targets]
    close = [-1]

    def end(at: int) -> int:
        if at + 2 < len(text) and (text[at + 2].isascii() and (text[at + 2].isalnum() or text[at + 2] == "_")):
            return -1
        if close[0] < at and close[0] != len(text):
            close[0] = k if (k := text.find(">", at)) >= 0 else len(text)
        i = bisect_left(starts, at + 2)
        return close[0] + 1 if close[0] < len(text) and i < len(targets) and targets[i][1] <= close[0] else -1

    return end


class Scanner:
    """The rules of one kind of file, in one automaton."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        at: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for literal in r.literals:
                at.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, of in at.items():
            self.automaton.add_word(literal, (len(literal), of))
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(rule, start, end) of every match; those of one rule in order, without overlaps."""
        if not self.rules:
            return
        found: list[list[int]] = [[] for _ in self.rules]
        low = text.lower() if text.isascii() else text.translate(LOWER)
        for last, (size, of) in self.automaton.iter(low):
            for i in of:
                found[i].append(last - size + 1)
        for i, places in enumerate(found):
            rule, done = self.rules[i], 0
            tag = within_a_tag(text) if places and rule.name == "blank-target" else None
            for at in sorted(places):
                if at < done:
                    continue
                start = at
                while rule.run and start > done and at - start < rule.most and text[start - 1] in rule.run:
                    start -= 1
                if rule.run and start == at:
                    continue
                if tag:
                    end = tag(at)
                else:
                    m = self.patterns[i].match(text, start)
                    end = m.end() if m else -1
                if end > 0:
                    yield i, start, end
                    done = end


LOWER = {i: i + 32 for i in range(65, 91)}
MATCH = "check_name string, line bigint, detail string, first_line bigint"


def matches(rows: DataFrame, key: str, text: str, rules: dict[str, list[Rule]], kind: Column) -> DataFrame:
    """key, check_name, line and detail of every match of the rules for each row's kind, and first_line, that of
    the first place where the same text stands as a match or within one. Rows of other kinds and null texts have none."""
    kinds = sorted(rules)
    names = [key, *[x.split()[0] for x in MATCH.split(", ")]]

    def run(batches):
        scanners = {k: Scanner(rules[k]) for k in kinds}
        for b in batches:
            out: list[tuple] = []
            for k, t, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = None
                first: dict[tuple[int, str], int] = {}
                for i, start, end in scanners[of].matches(t):
                    if lines is None:
                        lines = [m.start() for m in re.finditer("\n", t)]
                    line, detail = bisect_left(lines, start) + 1, t[start:end]
                    if of == "html":
                        remember(first, i, detail, start)
                    at = first.get((i, detail), start)
                    out.append((k, scanners[of].rules[i].name, line, detail, bisect_left(lines, at) + 1))
            kinds_ = (b.column(0).type, pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_, strict=True)], names)

    picked = rows.select(F.col(key), F.col(text).alias("__text"), kind.alias("__kind")).filter(F.col("__kind").isin(kinds) & F.col("__text").isNotNull())
    return picked.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {MATCH}")


def remember(first: dict[tuple[int, str], int], rule: int, detail: str, start: int) -> None:
    """Where a match stands for the first time; a link that another link's tag holds within counts, too."""
    first.setdefault((rule, detail), start)
    inner = [m.start() for m in re.finditer("(?i)<a", detail[2:])]
    for at in inner:
        first.setdefault((rule, detail[at + 2 :]), start + at + 2)


def lacks_rel(tag: Column) -> Column:
    """Whether a link tag lacks one of the required rel tokens."""
    tokens = F.split(F.lower(F.regexp_extract(tag, r"(?i)\brel\s*=\s*[\"']([^\"']*)[\"']", 1)), r"\s+")
    return F.size(F.array_except(F.array(*map(F.lit, REQUIRED_REL)), tokens)) > 0


def security_rules() -> dict[str, list[Rule]]:
    """The rules of each kind of file."""
    return {k: [Rule(name, pattern, LITERALS[name]) for name, where, pattern in PATTERNS if where in ("any", k)] for k in SCANNED}


def security_findings(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """check_name, subject (path), line and detail of every finding in html, js and css files.

    Repeated identical blank-target tags all report the line of the first.
    """
    kind = F.when(~F.startswith(path, F.lit("scripts/")), F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))
    found = matches(files, path, text, security_rules(), kind)
    blank = F.col("check_name") == "blank-target"
    found = found.filter(~blank | lacks_rel(F.col("detail")))
    line = F.when(blank, F.col("first_line")).otherwise(F.col("line")).cast("int")
    return found.select("check_name", F.col(path).alias("subject"), line.alias("line"), F.trim("detail").alias("detail"))


def over_budget(metrics: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """metric, value, budget, over for one row of metrics; a missing value is 0."""
    budgets = budgets or BUDGETS
    stacked = F.explode(
        F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(F.col(k).cast("bigint"), F.lit(0)).alias("value"), F.lit(v).cast("bigint").alias("budget")) for k, v in budgets.items() if k in metrics.columns])
    )
    return metrics.select(stacked.alias("m")).select("m.*", (F.col("m.value") > F.col("m.budget")).alias("over"))


def severity(impact: Column) -> Column:
    return F.when(impact.isin(*BLOCKING), "blocking").otherwise("advisory")


def rounded(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5).cast("bigint")


def control_label(c: Column) -> Column:
    return F.substring(tx.collapse(c), 1, 80)


def overflows(left: Column, right: Column, width: Column) -> Column:
    return (left < -2) | (right > width + 2)


def failures(findings: DataFrame, by: str) -> DataFrame:
    """by and its messages, for those that have any."""
    return findings.groupBy(by).agg(F.array_sort(F.collect_list("message")).alias("errors")).filter(F.size("errors") > 0)
