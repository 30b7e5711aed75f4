"""Chat formatting with typed content parts, as DataFrame operations only.

A turn reads ``### role: body </turn>`` and a line feed. Text inside a turn may
hold anything: each control string in it becomes a two-character escape, and a
backslash itself is one, so every backslash of the output starts an escape and
the way back is unambiguous. Parts other than text become placeholders,
``<|kind:tokens|>``, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SPLIT, CLOSE = "### ", ": ", " </turn>\n"
#: What stands for what, in the order of escaping; unescaping goes backwards.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), ("<|", "\\p"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: Turns of one conversation that are put together before all of it is.
BLOCK_TURNS = 64

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Side of an image patch, tokens of a second of sound and of a document page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512


def _swap(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, pairs=ESCAPES) -> Column:
    return _swap(text, pairs)


def unescape(text: Column, pairs=ESCAPES) -> Column:
    return _swap(text, [(new, old) for old, new in reversed(pairs)])


def text_part(text: Column) -> Column:
    """The parts of a turn that is text alone; null counts as empty."""
    empty = {"kind": F.lit("text"), "text": F.coalesce(text.cast("string"), F.lit(""))}
    names = [f.split(":") for f in PART.removeprefix("struct<").removesuffix(">").split(",")]
    return F.array(F.struct(*[empty.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in names]))


def _tokens(part: Column) -> Column:
    """Places that an attachment takes once expanded; at least one."""
    whole = lambda x: F.greatest(F.coalesce(F.ceil(x), F.lit(1)), F.lit(1)).cast("long")
    return (
        F.when(part.kind == "image", whole(part.width / PATCH) * whole(part.height / PATCH))
        .when(part.kind == "audio", whole(part.seconds * PER_SECOND))
        .when(part.kind == "document", whole(part.pages) * PER_PAGE)
        .otherwise(F.lit(1).cast("long"))
    )


def _visit(part: Column) -> Column:
    kind = F.replace(escape(F.coalesce(part.kind, F.lit("unknown"))), F.lit("|"), F.lit(""))
    holder = F.concat(F.lit("<|"), kind, F.lit(":"), _tokens(part).cast("string"), F.lit("|>"))
    return F.when(part.kind == "text", escape(F.coalesce(part.text, F.lit("")))).otherwise(holder)


def format_chat(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, parts).

    Returns conv_id, formatted, loss_spans, attachments, attachment_tokens.
    ``loss_spans`` (turn, start, length) marks the bodies of ``trained_role``:
    the place of the turn in the conversation, and code points from that turn's
    first one. ``attachments`` (turn, part, kind, uri, tokens) lists what the
    placeholders stand for, ``turn`` being the column's value.

    Turns go by ``turn`` (null first), ties by role, then body. Null role, text
    or parts count as empty, a null part or kind as kind ``unknown`` of one
    token; a null conv_id is a conversation of its own. Other columns are not
    read; no rows give no rows.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(SPLIT))
    refs = F.filter(
        F.transform(parts, lambda p, i: F.struct(F.col("turn").alias("turn"), i.alias("part"), F.coalesce(p.kind, F.lit("unknown")).alias("kind"), p.uri.alias("uri"), _tokens(p).alias("tokens"))),
        lambda r: r.kind != "text",
    )
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), F.array_join(F.transform(parts, _visit), "").alias("body"), head.alias("head"), refs.alias("refs"), (role == trained_role).alias("trained")
    )
    row = F.struct(
        "turn", "role", "body",
        F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
        F.when(F.col("trained"), F.struct(F.length("head").alias("start"), F.length("body").alias("length"))).alias("loss"),
        "refs",
    )
    ordered = F.array_sort(F.collect_list(row), lambda a, b: _order(a, b))
    blocks = (
        rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
        .groupBy("conv_id", "block")
        .agg(ordered.alias("rows"))
        .select(
            "conv_id", "block",
            F.array_join(F.transform("rows", lambda r: r.piece), "").alias("piece"),
            F.transform("rows", lambda r: r.loss).alias("losses"),
            F.flatten(F.transform("rows", lambda r: r.refs)).alias("refs"),
        )
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "piece", "losses", "refs"))).alias("blocks"))
    losses = F.flatten(F.transform("blocks", lambda b: b.losses))
    spans = F.filter(F.transform(losses, lambda s, i: F.struct(i.alias("turn"), s.start.alias("start"), s.length.alias("length"))), lambda s: s.start.isNotNull())
    return whole.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: b.piece), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("blocks", lambda b: b.refs)).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, r: n + r.tokens))


def _order(a: Column, b: Column) -> Column:
    def by(x: Column, y: Column, then: Column) -> Column:
        return F.when(x.eqNullSafe(y), then).when(x.isNull() | (x < y), F.lit(-1)).otherwise(F.lit(1))

    return by(a.turn, b.turn, by(a.role, b.role, by(a.body, b.body, F.lit(0))))


def read_turns(formatted: Column) -> Column:
    """The turns' own strings, without their ends."""
    pieces = F.split(formatted, F.lit(CLOSE.replace("\n", "\\n")), -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def read_role(piece: Column) -> Column:
    return unescape(F.substr(piece, F.lit(len(OPEN) + 1), F.instr(piece, F.lit(SPLIT)) - len(OPEN) - 1), ROLE_ESCAPES)


def read_body(piece: Column) -> Column:
    return unescape(F.substr(piece, F.instr(piece, F.lit(SPLIT)) + len(SPLIT)))


def read_loss(formatted_turns: Column, loss_spans: Column) -> Column:
    """All text under the mask, in order."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(F.element_at(formatted_turns, s.turn + 1), s.start + 1, s.length))), "")
