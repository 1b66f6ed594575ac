"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no evidence.
STOPWORDS = (
    "a", "al", "como", "con", "de", "del", "el", "en", "era", "es", "fue", "la", "las", "le", "les",
    "lo", "los", "o", "para", "por", "que", "se", "segun", "su", "sus", "un", "una", "unas", "unos", "y",
)


def _bare(c: str) -> str:
    """One character case-folded, decomposed and without marks."""
    return "".join(x for x in unicodedata.normalize("NFD", c.casefold()) if unicodedata.category(x) != "Mn")


def _tables() -> tuple[dict[str, str], set[str], dict[str, str]]:
    """By rule over all characters: those whose bare form has ASCII letters or digits, those that
    have none (marks), and those that case folding changes."""
    letters, marks, folds = {}, set(), {}
    for c in map(chr, (*range(0x41, 0x5B), *range(0x80, 0xD800), *range(0xE000, 0x110000))):
        if c > "\uffff" and unicodedata.category(c) not in ("Mn", "Lu"):
            continue
        folded = c.casefold()
        if folded != c:
            folds[c] = folded
        bare = _bare(c)
        if not bare:
            marks.add(c)
        elif any(x.isascii() and x.isalnum() for x in bare):
            letters[c] = "".join(x if x.isascii() else " " for x in bare)
    return letters, marks, folds


_LETTERS, _MARKS, _FOLDS = _tables()


def _one_to_one(table: dict[str, str], gone: set[str] = frozenset()) -> tuple[str, str]:
    """Arguments of translate(): characters without a counterpart are deleted."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    return "".join(one) + "".join(sorted(gone)), "".join(one.values())


def _longer(table: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in table.items() if len(v) > 1}


#: Latin text without these characters takes the short way through lower().
_BEYOND_LATIN = "[\u00b5\u0130\u0149\u017f-\\x{10FFFF}]"
#: Lower-case Latin letters that have a bare letter.
_LATIN = {c: x for c, x in _LETTERS.items() if "\x7f" < c < "\u0180" and c == c.lower() and len(x) == 1}


def _ranges(characters: dict[str, str], gap: int = 64) -> str:
    """A pattern of a few ranges that hold the characters (and others: it is a filter only)."""
    out: list[list[str]] = []
    for c in sorted(characters):
        if out and ord(c) - ord(out[-1][1]) <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"{a}-{z}" for a, z in out) + "]"


def spelled_out(c: Column, longer: dict[str, str]) -> Column:
    """Characters replaced by several ones; texts without them are not touched."""
    known = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    replaced = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    return F.when(F.rlike(c, F.lit(_ranges(longer))), replaced).otherwise(c)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Full case folding; Latin text by lower() alone, but for sharp s."""
    short = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    full = F.translate(spelled_out(c, _longer(_FOLDS)), *_one_to_one(_FOLDS))
    return F.when(F.rlike(c, F.lit(_BEYOND_LATIN)), full).otherwise(short)


def normalize(c: Column) -> Column:
    """Fold, decompose, drop marks; runs of other characters than a-z and 0-9 become one space.
    For text of any script, composed or decomposed; composed Latin text takes a short way."""
    short = F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), *_one_to_one(_LATIN))
    full = F.translate(spelled_out(c, _longer(_LETTERS)), *_one_to_one(_LETTERS, _MARKS))
    bare = F.when(F.rlike(c, F.lit(_BEYOND_LATIN)), full).otherwise(short)
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def normalize_one(value: str) -> str:
    """normalize() of a Python string."""
    bare = "".join(x for x in unicodedata.normalize("NFD", value.casefold()) if unicodedata.category(x) != "Mn")
    return re.sub(r"[^a-z0-9]+", " ", bare).strip()


def normalize_spaces(c: Column) -> Column:
    """Strip, collapse white space and fold; marks stay. The collapsed text is made once."""
    return let(collapse(c), fold)


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def significant_tokens(c: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Tokens of three characters or more that are no stop words."""
    return F.filter(F.split(normalize(c), " "), lambda t: (F.length(t) >= 3) & ~t.isin(*stopwords))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once; an expression that a lambda uses is
    otherwise evaluated for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def terms_missing(passage_norm: Column, terms: Column) -> Column:
    """Terms, as spelled, whose normal form is not empty and not within the passage."""
    listed = F.coalesce(terms, F.array().cast("array<string>"))
    return let(passage_norm, lambda p: F.filter(listed, lambda t: let(normalize(t), lambda n: (n != "") & ~F.contains(p, n))))


def conflicts(passage_norm: Column, distractors: Column) -> Column:
    """Distractors with significant tokens, all of which are within the passage."""
    listed = F.coalesce(distractors, F.array().cast("array<string>"))

    def hit(p: Column, d: Column) -> Column:
        return let(significant_tokens(d), lambda tokens: (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(p, t)))

    return let(passage_norm, lambda p: F.filter(listed, lambda d: hit(p, d)))


def trailing_int(c: Column, needs_separator: bool = False) -> Column:
    """The number at the end of a text, after a separator or alone (unless needs_separator);
    null if there is none or it is 0."""
    number = trailing_digits(c, needs_separator).try_cast("bigint")
    return F.when(number > 0, number)


def trailing_digits(c: Column, needs_separator: bool = False) -> Column:
    """The digits at the end of a text, after a separator or alone (unless needs_separator); empty if there are none."""
    before = r"[.:\s]" if needs_separator else r"(?:^\s*|[.:\s])"
    return F.regexp_extract(c, rf"(?U){before}([0-9]+)\s*$", 1)


def has_citation(c: Column) -> Column:
    return F.rlike(c, F.lit(r"(?U)\b\d+\s*:\s*\d+\b"))


def range_label(book: Column, chapter: Column, start: Column, end: Column) -> Column:
    """book chapter:start, with -end only if it differs."""
    head = F.concat(book, F.lit(" "), chapter.cast("string"), F.lit(":"), start.cast("string"))
    return F.concat(head, F.when(end != start, F.concat(F.lit("-"), end.cast("string"))).otherwise(""))


def item_id(book: Column, chapter: Column, number: Column) -> Column:
    return F.format_string("%s_%03d_%03d", F.replace(F.upper(book), F.lit(" "), F.lit("_")), chapter, number)


# The patterns of references in style sheets, of conflict markers and (above) of citations.
def css_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?i)url\(\s*([^)]+?)\s*\)"), F.lit(1))


def is_checked_css_url(u: Column) -> Column:
    return (u != "") & ~(F.startswith(u, F.lit("#")) | F.startswith(u, F.lit("data:")) | F.startswith(u, F.lit("var(")))


def has_conflict_marker(c: Column) -> Column:
    return F.rlike(c, F.lit(r"(?m)^(<<<<<<< |>>>>>>> )"))


def srcset_urls(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_extract(strip(x), r"^(\S+)", 1)), lambda x: x != "")


def label(c: Column, names: dict[str, str]) -> Column:
    """The name of a code, or the code itself."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.nullif(F.try_element_at(known, c), F.lit("")), c)
