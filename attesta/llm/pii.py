"""PII: format-preserving Feistel pseudonyms.

Found and validated: payment card numbers (13 to 19 digits, Luhn), phone numbers
(+CC (AAA) EEE-NNNN and like groupings with spaces, dots or dashes or none, 10 to 15
digits; without +, US numbers with the area code in brackets or joined by dashes or
dots), IPv4 addresses (octets up to 255), US social security numbers, dates (ISO, also
before a time, and with / or .; day/month/year with . / or -; day/month/year of two
digits, for 1950 to 2049, with /; English month names; real calendar days of 1900 to
2099 only) and e-mail addresses. Each is
replaced by a keyed permutation of itself within its own format, so equal values
get equal pseudonyms in every document, and distinct ones stay distinct:

* digits of a card but the last go through a Feistel network over numbers of that
  length; the check digit is made anew, so that Luhn still holds;
* digits of phones and SSNs likewise, walking the cycle until the value is valid
  in its format again; separators and the country code stay. The country code is
  told by the digits and is 1 where there is none, so that all spellings of a number
  have one pseudonym. Numbers of country 1 whose area and exchange codes exist become
  such numbers, the other ones (as in invented examples) stay apart from them;
* an address is permuted among 32-bit numbers; a date among the days of its range;
* the local part of an e-mail is permuted letter for letter and digit for digit,
  its domain stays. One of over PIECE characters is permuted in pieces: the last one
  under the others, then those under the last.

The key is a secret: pseudonyms can be inverted with it. `session_key` reads it from
the session's setting KEY_SETTING; where that is unset it makes a random key, which
lasts as long as the session.

Edge cases: null text stays null, with no spans; empty text stays empty; texts
of any length are handled whole; repeated rows give equal results; the other
columns of the input are kept as they are. A map over rows, without shuffle.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attesta.llm.common import Batches, map_batches

#: Spark hides settings of such names in its pages and logs.
KEY_SETTING = "spark.attesta.pii.secret"
ROUNDS, PIECE = 8, 512
KINDS = ("email", "ipv4", "ssn", "date", "phone", "card")
MONTHS = "January February March April May June July August September October November December".split()
MONTH = "(?i:" + "|".join(MONTHS + [m[:3] for m in MONTHS]) + ")"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?=T\d{2}(?::?\d{2}|Z|[^\w]|$))|(?:\d{4}(?:-\d{2}-\d{2}|/\d{1,2}/\d{1,2}|\.\d{2}\.\d{2})|\d{1,2}([./-])\d{1,2}\1\d{4}|\d{1,2}/\d{1,2}/\d{2}"
    rf"|\d{{1,2}} {MONTH} \d{{4}}|{MONTH} \d{{1,2}},? \d{{4}})(?![\w]|[./-]\d))",
    "phone": r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w.+-])(?:1[ .-])?\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?!\w|[.-]\d)",
    "card": r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w]|-\d)",
}
FIND = re.compile("|".join(f"(?P<{k}>{v.replace(chr(92) + '1', '(?P=sep)').replace('([./-])', '(?P<sep>[./-])')})" for k, v in PATTERNS.items()), re.ASCII)
#: Calling codes of one and two digits; all others have three.
COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Every finding has a digit with one of these beside it, or an @; texts without are skipped quickly.
HINT = re.compile(r"\d[\d@./ ()-]|@", re.ASCII)
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: The years that two digits stand for.
SHORT_YEARS = range(1950, 2050)


def session_key(spark: SparkSession) -> str:
    """The session's key; a new random one, kept in the session's settings, where it has none."""
    if not (found := spark.conf.get(KEY_SETTING, None)):
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found


def keyed_number(data: bytes, key: bytes, size: int) -> int:
    """A number that depends on data and key, of at least 64 bits more than size has."""
    need = (size.bit_length() + 71) // 8
    raw = b"".join(
        hashlib.blake2b(data, key=key, salt=b"%d" % i, digest_size=min(64, max(16, need - 64 * i))).digest() for i in range(-(-need // 64))
    )
    return int.from_bytes(raw, "big")


def feistel(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): an alternating network over a x b >= size, by cycle walking."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (a.bit_length() + 7) // 8
    while True:
        left, right = divmod(value, b)
        for r in range(ROUNDS):
            if r % 2:
                right = (right + keyed_number(b"%d:" % r + left.to_bytes(width, "big") + tweak, key, b)) % b
            else:
                left = (left + keyed_number(b"%d:" % r + right.to_bytes(width, "big") + tweak, key, a)) % a
        value = left * b + right
        if value < size:
            return value


def walk(value: int, size: int, key: bytes, tweak: bytes, valid: Callable[[int], bool]) -> int:
    """The next valid value on the permutation's cycle; a permutation of the valid ones."""
    while True:
        value = feistel(value, size, key, tweak)
        if valid(value):
            return value


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def filled(pattern: str, digits: str) -> str:
    """pattern with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def spelled_date(text: str) -> tuple[datetime.date, Callable[[datetime.date], str]]:
    """A date with the month's name, before or after the day."""
    name = re.search(r"[A-Za-z]+", text)[0]
    names = MONTHS if name.title() in MONTHS else [m[:3] for m in MONTHS]
    case = str.upper if name.isupper() else str.lower if name.islower() else str
    day, year = re.findall(r"\d+", text)
    shape = re.sub(r"\d+", "{}", text.replace(name, "{}"))
    first = text[0].isdigit()
    width = 2 if day[0] == "0" else 1

    def form(x: datetime.date) -> str:
        d, m = f"{x.day:0{width}d}", case(names[x.month - 1])
        return shape.format(*((d, m) if first else (m, d)), x.year)

    return datetime.date(int(year), names.index(name.title()) + 1, int(day)), form


def parsed_date(text: str) -> tuple[datetime.date, Callable[[datetime.date], str]] | None:
    parts = re.split(r"[./-]", text)
    try:
        if len(parts) == 1:
            d, form = spelled_date(text)
        elif len(parts[0]) == 4:
            d = datetime.date(*map(int, parts))
            sep, width = text[4], 1 if "0" not in (parts[1][0], parts[2][0]) and 1 in (len(parts[1]), len(parts[2])) else 2
            form = lambda x: f"{x.year}{sep}{x.month:0{width}d}{sep}{x.day:0{width}d}"
        else:
            sep = re.search(r"[./-]", text)[0]
            day, month, year = map(int, parts)
            short = len(parts[2]) == 2
            if short:
                year += 2000 if year + 2000 in SHORT_YEARS else 1900
            swapped = month > 12
            d = datetime.date(year, day, month) if swapped else datetime.date(year, month, day)
            width = 1 if "0" != parts[0][0] and (len(parts[0]) == 1 or len(parts[1]) == 1) else 2

            def form(x: datetime.date) -> str:
                a, b = (x.month, x.day) if swapped else (x.day, x.month)
                return sep.join([f"{a:0{width}d}", f"{b:0{width}d}", f"{x.year % 100:02d}" if short else str(x.year)])
    except ValueError:
        return None
    return (d, form) if FIRST_DAY <= d.toordinal() <= LAST_DAY else None


def valid_number(digits: str) -> bool:
    """Whether ten digits of country 1 have an area and an exchange code that can exist."""
    return digits[0] > "1" and digits[1:3] != "11" and digits[3] > "1" and digits[4:6] != "11"


def valid_ssn(n: int) -> bool:
    area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


@lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, found: str, secret: str) -> str | None:
    """The pseudonym of a finding, or None where it isn't valid."""
    key = hashlib.sha256(secret.encode()).digest()
    tweak = kind.encode()
    digits = "".join(c for c in found if c.isdigit())
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        body, n = digits[:-1], len(digits) - 1
        low, span = (10 ** (n - 1), 9 * 10 ** (n - 1)) if body[0] != "0" else (0, 10 ** (n - 1))
        new = str(low + feistel(int(body) - low, span, key, tweak + b"%d" % n)).zfill(n)
        return filled(found, new + luhn_digit(new))
    if kind == "ipv4":
        octets = found.split(".")
        if any(int(o) > 255 for o in octets):
            return None
        new = feistel(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, tweak)
        return ".".join(map(str, new.to_bytes(4, "big")))
    if kind == "ssn":
        return filled(found, f"{walk(int(digits), 10**9, key, tweak, valid_ssn):09d}") if valid_ssn(int(digits)) else None
    if kind == "phone":
        if found[0] == "+":
            lead = next((digits[:n] for n in (1, 2) if digits[:n] in COUNTRIES), digits[:3])
        else:
            lead = digits[:-10]  # a number of country 1, with or without it
        rest = digits[len(lead) :]
        if not 10 <= len(digits) <= 15 or not rest:
            return None
        n, own, country = len(rest), rest, lead or "1"
        alike = lambda x: country != "1" or n != 10 or valid_number(f"{x:010d}") == valid_number(own)
        return filled(found, f"{lead}{walk(int(rest), 10**n, key, tweak + country.encode() + b'%d' % n, alike):0{n}d}")
    if kind == "date":
        if not (d := parsed_date(found)):
            return None
        short = re.fullmatch(r"\d+/\d+/\d\d", found)
        valid = lambda n: not short or datetime.date.fromordinal(FIRST_DAY + n).year in SHORT_YEARS
        new = walk(d[0].toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, tweak, valid)
        return d[1](datetime.date.fromordinal(FIRST_DAY + new))
    local, _, domain = found.rpartition("@")
    pieces = [local[i : i + PIECE] for i in range(0, len(local), PIECE)]
    others = hashlib.sha256("".join(pieces[:-1]).encode()).digest() if pieces[1:] else b""
    pieces[-1] = permuted_name(pieces[-1], key, tweak + others)
    for i in range(len(pieces) - 1):
        pieces[i] = permuted_name(pieces[i], key, tweak + b"%d:" % i + pieces[-1].encode())
    return "".join(pieces) + "@" + domain


def permuted_name(local: str, key: bytes, tweak: bytes) -> str:
    """A permutation of the names with letters, digits and other characters at the same places."""
    value, size = 0, 1
    for c in local:
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value, size = value * base + (int(c) if base == 10 else ord(c.lower()) - 97 if base == 26 else 0), size * base
    shape = re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", local)))
    value = feistel(value, size, key, tweak + shape.encode())
    out = []
    for c in reversed(local):
        base = 10 if c.isdigit() else 26 if c.isalpha() else 1
        value, d = divmod(value, base)
        out.append(str(d) if base == 10 else chr((97 if c.islower() else 65) + d) if base == 26 else c)
    return "".join(reversed(out))


def pseudonymised(text: str, secret: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The new text, and (start, end, kind) of the findings in the old one."""
    if not HINT.search(text):
        return text, []
    out, spans, last, at = [], [], 0, 0
    while m := FIND.search(text, at):
        kind, found = m.lastgroup if m.lastgroup != "sep" else "date", m[0]
        new = pseudonym(kind, found, secret)
        while new is None and kind == "card" and (cut := max(found.rfind(" "), found.rfind("-"))) > 0:
            found = found[:cut]  # a number may follow a card
            new = pseudonym(kind, found, secret)
        if new is None:
            at = m.start() + 1
            while at < m.end() and text[at - 1].isdigit() and text[at].isdigit():
                at += 1  # the rest of a number is no finding of its own
            continue
        out += [text[last : m.start()], new]
        last = at = m.start() + len(found)
        spans.append((m.start(), at, kind))
    return "".join([*out, text[last:]]), spans


def pseudonymise(docs: DataFrame, secret: str, text_col: str = "text", spans_col: str | None = "pii_spans") -> DataFrame:
    """docs with text_col rewritten under the key `secret`; spans_col (if named) holds the findings' places in
    the old text. A column of the input called spans_col is replaced."""
    names = [c for c in docs.columns if c != spans_col]
    schema = docs.select(names).schema
    place = names.index(text_col)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Batches) -> Batches:
        for b in batches:
            done = [(None, []) if t is None else pseudonymised(t, secret) for t in b.column(place).to_pylist()]
            columns = list(b.columns)
            columns[place] = pa.array([t for t, _ in done], b.column(place).type)
            labels = list(names)
            if spans_col:
                columns.append(pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for _, x in done], span))
                labels.append(spans_col)
            yield pa.RecordBatch.from_arrays(columns, labels)

    fields = list(schema.fields)
    if spans_col:
        fields += StructType.fromDDL("s array<struct<start:bigint,end:bigint,kind:string>>").fields
        fields[-1].name = spans_col
    return map_batches(docs.select(names), run, StructType(fields))


def digest(done: DataFrame) -> DataFrame:
    """doc_id, counts by kind, spans and the digest of the new text."""

    def count(kind: str):
        return F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return done.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.array_join(F.transform("pii_spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        "text",
    )
