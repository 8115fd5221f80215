"""Chat formatting: typed content parts flattened into one string per conversation.

A message has a role and an array of parts. A visitor, one entry for each kind of part,
says which placeholder stands for the part and how many tokens it expands to. Text
parts are written with control strings escaped; image, audio and document parts become
placeholders in their order and are recorded as attachments.

A turn is written as ``<turn ROLE>BODY</turn>`` and a line end. Texts and roles have
``&``, ``<`` and ``>`` replaced by ``&amp;``, ``&lt;`` and ``&gt;``, so every ``<`` of the
output is a control string and reading back is exact. The loss mask has one entry for
each turn: code points to skip from the turn's start, then code points under the loss.

One shuffle by conversation, JVM functions only. A conversation is one value of the
output, so its turns meet in one row; that is the size limit of a value, about 2 GB.

Defined cases: null text, role and parts are empty; a null turn number comes first;
equal turn numbers are ordered by role and body; repeated rows are repeated turns; rows
with a null conversation form one conversation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

# Fixed values of the template, and of expansion: pixels of a patch's side, tokens a second, tokens a page.
OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


@dataclass(frozen=True)
class Visit:
    """What a kind of part becomes: its text in the output and its expanded tokens."""

    written: Callable[[Column], Column]
    tokens: Callable[[Column], Column]


def _at_least_one(count: Column) -> Column:
    return F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)).cast("bigint")


VISITOR: dict[str, Visit] = {
    "text": Visit(
        lambda part: escape(F.coalesce(part["text"], F.lit(""))),
        lambda part: F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"),
    ),
    "image": Visit(
        lambda part: F.lit("<image>"),
        lambda part: _at_least_one(F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)),
    ),
    "audio": Visit(lambda part: F.lit("<audio>"), lambda part: _at_least_one(F.ceil(part["seconds"] * PER_SECOND))),
    "document": Visit(lambda part: F.lit("<document>"), lambda part: _at_least_one(part["pages"] * PER_PAGE)),
}


def _dispatch(part: Column, visitor: dict[str, Visit], what: Callable[[Visit], Callable[[Column], Column]], other: Column) -> Column:
    chosen = None
    for kind, visit in visitor.items():
        case = what(visit)(part)
        chosen = F.when(part["kind"] == kind, case) if chosen is None else chosen.when(part["kind"] == kind, case)
    return other if chosen is None else chosen.otherwise(other)


def text_parts(text: Column) -> Column:
    """A plain text as an array of one text part."""
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *nothing))


def format_chat(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    loss_role: str = "assistant",
    visitor: dict[str, Visit] = VISITOR,
) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_mask``, ``attachments``, ``expanded_tokens``.

    An attachment records its turn number, kind, reference and tokens; the i-th one belongs
    to the i-th placeholder. Parts of a kind that the visitor does not know are written as
    text and count no tokens.
    """
    listed = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    said = F.coalesce(F.col(role), F.lit(""))
    body = F.array_join(
        F.transform(listed, lambda p: _dispatch(p, visitor, lambda v: v.written, escape(F.coalesce(p["text"], F.lit(""))))), ""
    )
    tokens = F.transform(listed, lambda p: _dispatch(p, visitor, lambda v: v.tokens, F.lit(0).cast("bigint")))
    attached = F.filter(
        F.transform(
            F.arrays_zip(listed.alias("part"), tokens.alias("tokens")),
            lambda z: F.struct(
                F.col(turn).cast("bigint").alias("turn"),
                z["part"]["kind"].alias("kind"),
                z["part"]["ref"].alias("ref"),
                z["tokens"].alias("tokens"),
            ),
        ),
        lambda a: a["kind"].isin([k for k in visitor if k != "text"]),
    )
    rows = messages.select(
        F.col(conversation).alias("conversation"),
        F.struct(
            F.col(turn).cast("bigint").alias("turn"),
            said.alias("role"),
            body.alias("body"),
            attached.alias("attached"),
            F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("tokens"),
        ).alias("said"),
    )
    # Sorting the collected structs orders by turn, role and body.
    turns = rows.groupBy("conversation").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE), t["body"], F.lit(END)))
    mask = F.transform(
        "turns",
        lambda t: F.struct(
            (F.length(escape(t["role"])) + len(OPEN) + len(CLOSE)).cast("bigint").alias("skip"),
            F.when(t["role"] == loss_role, F.length(t["body"])).otherwise(0).cast("bigint").alias("keep"),
        ),
    )
    return turns.select(
        F.col("conversation").alias(conversation),
        F.array_join(written, "").alias("formatted"),
        mask.alias("loss_mask"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
        F.aggregate(F.transform("turns", lambda t: t["tokens"]), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("expanded_tokens"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), placeholders left in the text."""
    head = f"^{OPEN}([^>]*){CLOSE}"
    return F.transform(
        turn_strings(formatted),
        lambda t: F.struct(
            unescape(F.regexp_extract(t, head, 1)).alias("role"), unescape(F.regexp_replace(t, head, "")).alias("text")
        ),
    )


def turn_strings(formatted: Column) -> Column:
    """The written turns without their end marks."""
    cut = F.split(formatted, END, -1)
    return F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))


def loss_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, in order and unescaped."""
    cut = F.zip_with(turn_strings(formatted), mask, lambda t, m: F.substring(t, (m["skip"] + 1).cast("int"), m["keep"].cast("int")))
    return F.transform(cut, unescape)
