"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

Base findings come from three patterns. The method adds spans of kind ``novel``:
a private key block as a whole, and a token in a sensitive context (a word such as
``credential`` or ``bearer`` before it in the line or the lines up to a blank one)
whose novelty is near that of random characters of its alphabet. It is compressed by zstandard primed with a raw
dictionary made of the surrounding text, the document's own identifiers and a
list of common code identifiers. The bytes that the token adds to the empty
frame, divided by its length, are its novelty; ordinary words and names that
occur nearby cost few bytes, random keys cost about as many as they have.

Edge cases: a null or empty text gives zero counts, the digest of the empty
string and empty spans; repeated rows are scanned row by row; whole texts are
scanned, however long; only the id and text columns are read, so others may
have any name. The scan is a map over rows: nothing is shuffled.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Batches, map_batches

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
KINDS = ("assign", "access", "hex", "novel")

TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
SENSITIVE = re.compile(
    r"(?:pass|pwd|secret|token|credential|auth|bearer|private|signing|session|api|client|key|jwt|salt|cookie)", re.IGNORECASE
)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")
#: Identifiers that are common in code and configuration.
IDENTIFIERS = (
    b"access_key api_key authorization bearer certificate client_id client_secret config connection credential "
    b"database default description development endpoint environment example function hostname identifier import "
    b"localhost parameter password private_key production provider public_key repository request response return "
    b"secret_key service session signature string timeout token username version webhook "
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
)
#: Parts of names, and the pairs of letters that are common in words.
WORD = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch "
    "ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po "
    "we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke ui fr oo ag "
    "av bo ap gr ef if sp qu eq ue".split()
)
SURROUNDING, NOVELTY = 1024, 0.7
BLANK = re.compile(r"\n[^\S\n]*(?=\n)")
#: Alphabets of keys and their bits a character, narrow ones first; all else counts as 64 characters.
ALPHABETS = tuple(
    (re.compile(x), math.log2(n))
    for x, n in (("[0-9]+", 10), ("[0-9a-f]+|[0-9A-F]+", 16), ("[a-z]+|[A-Z]+", 26), ("[A-Z2-7]+|[a-z2-7]+", 32), ("[0-9a-z]+|[0-9A-Z]+", 36), ("[A-Za-z]+", 52))
)
PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
PEM_END = re.compile(r"-----(?:END|BEGIN) [A-Z0-9 ]+-----")
#: Header lines and base64 lines of a block without an end.
PEM_LINES = re.compile(r"(?:(?:\s|\\r|\\n)+(?:[A-Za-z-]+: [^\n]*|[A-Za-z0-9+/=]+))*")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points, by start and kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    # a run of hex digits is one match of [0-9a-f]+, so only runs long enough need a look
    found += [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def wordlike(letters: str) -> bool:
    """Whether most pairs of letters are common ones in words; few pairs of random letters are."""
    pairs = [letters[i : i + 2].lower() for i in range(len(letters) - 1)]
    return sum(x in PAIRS for x in pairs) >= 0.6 * len(pairs)


def around(text: str, token: str, a: int, z: int, width: int = SURROUNDING) -> str:
    """The surroundings of text[a:z], of width characters on both sides, without other occurrences of token, also without those that their ends cut."""
    n, start, end = len(token), max(0, a - width), min(len(text), z + width)
    if (p := text.find(token, max(0, start - n + 1), min(a, start + n - 1))) >= 0:
        start = p + n
    if (p := text.rfind(token, max(z, end - n + 1), end + n - 1)) >= 0:
        end = p
    return f"{text[start:a]}\n{text[z:end]}".replace(token, " ")


def novelty(token: str, surroundings: str) -> float:
    """Marginal compressed bytes of token, per byte, given its surroundings; its words cost nothing."""
    names = " ".join(dict.fromkeys(x for x in IDENTIFIER.findall(surroundings)))
    prime = IDENTIFIERS + names.encode() + b" " + surroundings.encode()
    packer = zstandard.ZstdCompressor(
        level=3, dict_data=zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False
    )
    raw = WORD.sub(lambda m: "" if wordlike(m[0]) else m[0], token).encode()
    return (len(packer.compress(raw)) - len(packer.compress(b""))) / len(token)


def bits(token: str) -> float:
    """Bits a character of a random token over the token's alphabet."""
    body = token.replace("-", "").replace("_", "").rstrip("=")
    return next((b for x, b in ALPHABETS if x.fullmatch(body)), 6.0)


def private_keys(text: str) -> list[tuple[int, int, str]]:
    """Private key blocks, as a whole; one without an end goes as far as its lines do."""
    out, at = [], 0
    while m := PEM_BEGIN.search(text, at):
        end = PEM_END.search(text, m.end())
        at = end.end() if end and end[0].startswith("-----END") else PEM_LINES.match(text, m.end()).end()
        out.append((m.start(), at, "novel"))
    return out


def novel_spans(text: str, base: list[tuple[int, int, str]], least: float = NOVELTY, width: int = SURROUNDING) -> list[tuple[int, int, str]]:
    """Private key blocks, and tokens in a sensitive context (a word earlier in the line or in
    the lines before it, as far as a blank one) that do not compress, apart from those in
    base spans or blocks.
    least is in bytes a character for 64 characters, and less for narrower alphabets; width is
    what a token is compared with on both sides."""
    out = private_keys(text)
    starts, reach = [], []  # where spans start, in order, and how far those up to each go
    for s, e in sorted((s, e) for s, e, _ in [*base, *out]):
        starts.append(s)
        reach.append(max(e, reach[-1]) if reach else e)
    ends = blanks = None
    for m in TOKEN.finditer(text):
        a, z = m.span()
        token = m[0].strip(".-=")
        if len(token) < 16 or not any(c.isalpha() for c in token):
            continue
        if ends is None:  # many texts have no such token
            ends, blanks = [m.end() for m in SENSITIVE.finditer(text)], [m.start() for m in BLANK.finditer(text)]
        last = bisect.bisect_right(ends, a)
        if not last or bisect.bisect_left(blanks, ends[last - 1]) < bisect.bisect_left(blanks, a):
            continue
        before = bisect.bisect_left(starts, z)
        if before and reach[before - 1] > a:
            continue
        if novelty(token, around(text, token, a, z, width)) >= least * bits(token) / 6:
            out.append((a, z, "novel"))
    return sorted(out)


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NOVELTY, width: int = SURROUNDING) -> DataFrame:
    """A row per document: id, base (array of spans), novel (array of spans)."""

    def scan(batches: Batches) -> Batches:
        for b in batches:
            rows: tuple[list, list] = ([], [])
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                novel = novel_spans(text or "", base, least, width)
                for out, spans in zip(rows, (base, novel), strict=True):
                    out.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows[0], kind), pa.array(rows[1], kind)], ["id", "base", "novel"]
            )

    span = "array<struct<start:bigint,end:bigint,kind:string>>"
    return map_batches(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), scan, f"id bigint, base {span}, novel {span}"
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    both = F.array_sort(
        F.transform(F.concat("base", "novel"), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    )
    return found.select(
        F.col("id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(both).alias("spans"),
    )


def digest_of(text: str) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(told(base_spans(text)).encode()).hexdigest()
