"""Fill-in-the-middle transformation of texts held as ropes.

A text is cut into units: a word with the white space before it, or the white space at
the end. A rope is a balanced tree whose leaves hold up to LEAF units of text; leaves and
inner nodes cache how many units and code points they have. A split at a unit rank (or
at a code point) walks down the tree, cuts one leaf and joins the parts, so prefix,
middle and suffix share all other leaves with the document. The result is a rope of
these subtrees and the sentinels. It is undone from the output and the form alone: the
output becomes a rope, is split where the sentinels are, and the parts are joined again.

A text that holds a sentinel itself stays as it is, so the first occurrence of a sentinel
in an output is the one that was put there (no end of a sentinel is the beginning of one).

Edge cases: a null or empty text has no units and stays empty, its form is plain; a null
id counts as no digits; repeated rows are transformed row by row, and rows with one id are
cut by the same numbers; whole texts are transformed, leaf by leaf, so a long text needs
a small multiple of its size; other columns are not read. There is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Batches, map_batches, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = re.compile("<[PSM]>")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Units of a leaf. Possessive, so that long runs are looked at once.
LEAF = 256
LEAVES = re.compile(rf"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{1,{LEAF}}}|[\x20\x09-\x0D]++")
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
SLICE_BYTES = 2 << 20


class Node:
    """A leaf (text) or an inner node (left, right); both know their units, code points and height."""

    __slots__ = ("text", "left", "right", "units", "chars", "height")

    def __init__(self, text: str = "", units: int = 0, left: Node | None = None, right: Node | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None or right is None:
            self.units, self.chars, self.height = units, len(text), 0
        else:
            self.units, self.chars = left.units + right.units, left.chars + right.chars
            self.height = 1 + max(left.height, right.height)

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.text
            else:
                todo += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Node()


def rope(text: str) -> Node:
    """A balanced rope of a text."""
    level = [Node(m[0], len(UNIT.findall(m[0]))) for m in LEAVES.finditer(text)]
    while len(level) > 1:
        level = [Node(left=a, right=b) for a, b in zip(level[::2], level[1::2], strict=False)] + level[len(level) & ~1 :]
    return level[0] if level else EMPTY


def concat(a: Node, b: Node) -> Node:
    """One rope after another; the higher one is gone down, so that heights stay balanced."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        return balanced(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return balanced(concat(a, b.left), b.right)
    return Node(left=a, right=b)


def balanced(a: Node, b: Node) -> Node:
    """A node of two ropes whose heights differ by two at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Node(left=a.left, right=Node(left=a.right, right=b))
        return Node(left=Node(left=a.left, right=a.right.left), right=Node(left=a.right.right, right=b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Node(left=Node(left=a, right=b.left), right=b.right)
        return Node(left=Node(left=a, right=b.left.left), right=Node(left=b.left.right, right=b.right))
    return Node(left=a, right=b)


def unit_offset(text: str, rank: int) -> int:
    """Code points of the first `rank` units of a leaf."""
    ends = (m.end() for m in UNIT.finditer(text))
    return next((e for i, e in enumerate(ends, 1) if i == rank), len(text)) if rank else 0


def split(node: Node, rank: int, by: str = "units") -> tuple[Node, Node]:
    """The first `rank` units (or code points, by="chars") of a rope, and the rest. A cut at a code
    point may go through a unit; its halves then count as the units that they are by themselves."""
    if rank <= 0:
        return EMPTY, node
    if rank >= getattr(node, by):
        return node, EMPTY
    if node.left is None:
        at = unit_offset(node.text, rank) if by == "units" else rank
        a, b = node.text[:at], node.text[at:]
        return Node(a, len(UNIT.findall(a))), Node(b, len(UNIT.findall(b)))
    first = getattr(node.left, by)
    if rank < first:
        a, b = split(node.left, rank, by)
        return a, concat(b, node.right)
    a, b = split(node.right, rank - first, by)
    return concat(node.left, a), b


def find(node: Node, sentinel: str) -> int:
    """The code point where a sentinel first stands, leaf by leaf with what may span two of them."""
    at, tail = 0, ""
    for leaf in node.leaves():
        if (k := (tail + leaf).find(sentinel)) >= 0:
            return at - len(tail) + k
        at += len(leaf)
        tail = (tail + leaf)[-(len(sentinel) - 1) :]
    raise ValueError(f"no {sentinel} in the output")


def numbers(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that a document's id and the seed decide."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc: Node, has_sentinel: bool, h: list[int], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[str, Node, Node, Node]:
    """(form, output, prefix, middle) of a document."""
    if not doc.chars or has_sentinel or h[2] % 100 >= fim_percent:
        return "plain", doc, EMPTY, EMPTY
    cuts = sorted((h[0] % (doc.units + 1), h[1] % (doc.units + 1)))
    head, suffix = split(doc, cuts[1])
    prefix, middle = split(head, cuts[0])
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    order = [(SUFFIX, suffix), (PREFIX, prefix)] if form == "spm" else [(PREFIX, prefix), (SUFFIX, suffix)]
    out = EMPTY
    for sentinel, part in [*order, (MIDDLE, middle)]:
        out = concat(concat(out, Node(sentinel, 1)), part)
    return form, out, prefix, middle


def restore(output: str, form: str) -> Node:
    """The document, from an output and its form."""
    whole = rope(output)
    if form == "plain":
        return whole
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    _, rest = split(whole, len(first), "chars")
    a, rest = split(rest, find(rest, second), "chars")
    _, rest = split(rest, len(second), "chars")
    b, rest = split(rest, find(rest, MIDDLE), "chars")
    _, middle = split(rest, len(MIDDLE), "chars")
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return concat(concat(prefix, middle), suffix)


RESULT = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """A row per document: id, n (units), form, prefix_chars and middle_chars (null if plain), output, and
    restored (what the output and the form give back)."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    doc = rope(text or "")
                    form, output, prefix, middle = transform(doc, bool(SENTINEL.search(text or "")), numbers(doc_id, seed), fim_percent, spm_percent)
                    chars = (None, None) if form == "plain" else (prefix.chars, middle.chars)
                    told = str(output)
                    rows.append((doc_id, doc.units, form, *chars, told, str(restore(told, form))))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [x.split()[0] for x in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, RESULT)


def digest(done: DataFrame) -> DataFrame:
    return done.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
