"""Chat formatting with typed content parts, by DataFrame functions only.

A message holds an array of parts ``struct<type, text, ref, tokens>``. The
visitor walks the parts in order: a text part contributes its escaped text; an
image, audio or document part contributes a placeholder ``<|type:k|>`` (k counts
the attachments of the message from 0) and is recorded as an attachment with its
reference, the placeholder's place and its expanded token count.

Template of a turn: ``### role: body</turn>\\n``. Inside roles and texts the
control strings are escaped, so none of them occurs in escaped text:

    \\  -> \\\\      ###  -> \\h      </turn>  -> \\t      <|  -> \\p

and, in roles only, ``:`` becomes ``\\c``. Unescaping splits at double
backslashes and replaces the rest, which inverts the above for every string.

Edge cases: null text, role or parts count as empty; a null conversation id is
a conversation of its own; rows that tie in turn are ordered by role, then by
body; repeated rows are repeated turns; an empty table gives an empty result;
columns other than those named are not read. A conversation is one output cell,
so its turns must fit in one task; rows are pre-rendered before the shuffle and
carry only what is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates turns; the first three characters of a header.
END, HEAD = "</turn>\n", "### "
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"), ("<|", "\\p"))
#: Tokens that a part takes if it does not say so itself.
DEFAULT_TOKENS = {"image": 576, "audio": 1500, "document": 2048}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"


def escaped(c: Column, role: bool = False) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.replace(c, F.lit(":"), F.lit("\\c")) if role else c


def unescaped(c: Column) -> Column:
    def plain(x: Column) -> Column:
        for raw, safe in (*ESCAPES[1:], (":", "\\c")):
            x = F.replace(x, F.lit(safe), F.lit(raw))
        return x

    return F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")


def visit_parts(parts: Column) -> Column:
    """struct<body, attachments, tokens>: parts flattened to text with placeholders.

    The order of parts is kept; an unknown type is treated as a document.
    """
    start = F.struct(
        F.lit("").alias("body"),
        F.array().cast("array<struct<k:int,type:string,ref:string,at:int,tokens:bigint>>").alias("attachments"),
    )

    def step(acc: Column, p: Column) -> Column:
        kind = F.when(p["type"].isin("text", *DEFAULT_TOKENS), p["type"]).otherwise(F.lit("document"))
        k = F.size(acc["attachments"])
        default = F.coalesce(*[F.when(kind == t, F.lit(n)) for t, n in DEFAULT_TOKENS.items()]).cast("long")
        mark = F.concat(F.lit("<|"), kind, F.lit(":"), k.cast("string"), F.lit("|>"))
        item = F.struct(
            k.alias("k"), kind.alias("type"), p["ref"].alias("ref"), F.length(acc["body"]).alias("at"),
            F.coalesce(p["tokens"], default).alias("tokens"),
        )
        text = p["type"].eqNullSafe("text") | p["type"].isNull()
        return F.struct(
            F.concat(acc["body"], F.when(text, escaped(F.coalesce(p["text"], F.lit("")))).otherwise(mark)).alias("body"),
            F.when(text, acc["attachments"]).otherwise(F.array_append(acc["attachments"], item)).alias("attachments"),
        )

    return F.aggregate(F.coalesce(parts, F.array().cast(PARTS)), start, step)


def format_chats(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    train_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens per conversation.

    loss_spans are (start, end) code points of the bodies of train_roles in
    formatted; attachments give the turn, k, type, ref, the offset in formatted
    and the tokens; expanded_tokens is their sum.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    turns = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        visit_parts(F.col(parts_col)).alias("v"),
        F.concat(F.lit(HEAD), escaped(role, role=True), F.lit(": ")).alias("head"),
    ).select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            F.col("v.body").alias("body"),
            "head",
            F.col("v.attachments").alias("attachments"),
            (F.length("head") + F.length("v.body") + F.lit(len(END))).alias("size"),
            F.col("role").isin(*train_roles).alias("train"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    starts = F.aggregate(
        "ts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, t: F.struct((a["at"] + t["size"]).alias("at"), F.array_append(a["all"], a["at"]).alias("all")),
        lambda a: a["all"],
    )
    placed = grouped.select("conv_id", "ts", F.arrays_zip(F.col("ts").alias("t"), starts.alias("at")).alias("z"))
    spans = F.transform(
        F.filter("z", lambda x: x["t"]["train"]),
        lambda x: F.struct(
            (x["at"] + F.length(x["t"]["head"])).alias("start"),
            (x["at"] + F.length(x["t"]["head"]) + F.length(x["t"]["body"])).alias("end"),
        ),
    )
    attached = F.flatten(
        F.transform(
            "z",
            lambda x: F.transform(
                x["t"]["attachments"],
                lambda a: F.struct(
                    x["t"]["turn"].alias("turn"), a["k"].alias("k"), a["type"].alias("type"), a["ref"].alias("ref"),
                    (x["at"] + F.length(x["t"]["head"]) + a["at"]).alias("at"), a["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    return placed.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
        attached.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0))))


def parse_chats(formatted: Column) -> Column:
    """array<struct<role, text>> read back from formatted text."""
    pieces = F.split(formatted, F.lit(END))
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parse(p: Column) -> Column:
        return F.struct(
            unescaped(F.regexp_extract(p, r"(?s)^### ([^:]*): ", 1)).alias("role"),
            unescaped(F.regexp_extract(p, r"(?s)^### [^:]*: (.*)$", 1)).alias("text"),
        )

    return F.transform(turns, parse)


def digest(chats: DataFrame) -> DataFrame:
    """The digest columns, read back from formatted and loss_spans alone."""
    turns = parse_chats(F.col("formatted"))
    trained = F.array_join(
        F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), ""
    )
    return chats.select("conv_id", "formatted", turns.alias("turns"), trained.alias("trained")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
