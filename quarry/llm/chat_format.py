r"""Chat formatting as relational algebra.

Turns are sorted within their conversation, neighbouring turns of one role are
merged into a block, and blocks are concatenated, by Spark expressions only. One
shuffle, on the conversation.

The format. A block is ``### <role>: `` , its texts divided by ``<turn>``, and
``</turn>`` with a line feed. Within a text (and a role) every ``\`` becomes
``\s``, every ``<`` ``\l``, every ``#`` ``\h`` and every ``:`` of a role ``\c``. So
each ``<`` in the output begins a mark, no control string can arise inside a text,
and read_back() undoes it exactly. The loss mask covers the escaped texts of
assistant turns, marks excluded.

Defined cases: a null text is empty; a null role is written as empty; ties of
(conversation, turn) are sorted by role and text, and repeated rows stay; a null
turn comes first; a null conversation is a conversation of its own; an empty table
gives an empty result; other columns are not read. A conversation is one output
text, so it has to fit in a task; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, DIVIDE, CLOSE = "### ", "<turn>", "</turn>\n"
#: What is escaped and the letter it gets; the backslash comes first.
MARKS = (("\\", "s"), ("<", "l"), ("#", "h"), (":", "c"))


def escaped(text: Column, role: bool = False) -> Column:
    for m, letter in MARKS if role else MARKS[:3]:
        text = F.replace(text, F.lit(m), F.lit("\\" + letter))
    return text


def unescaped(text: Column) -> Column:
    """Escapes never overlap, as each backslash in the output begins one; the backslash itself comes last."""
    for m, letter in reversed(MARKS):
        text = F.replace(text, F.lit("\\" + letter), F.lit(m))
    return text


def blocks_of(turns: Column) -> Column:
    """Sorted turns (role, text) to blocks (role, texts): neighbours of one role come together, each cut out once."""
    role = lambda i: F.get(turns, i)["role"]
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (role(i) != role(i - 1)))
    return F.transform(
        starts,
        lambda s, k: F.struct(
            role(s).alias("role"),
            F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - s), lambda t: t["text"]).alias("texts"),
        ),
    )


#: Numbers that are added up at once; so no array grows beyond it step by step.
STEP = 256


def sums_before(numbers: Column) -> Column:
    """For each of an array of numbers, the sum of those before it."""
    kind = "struct<at:bigint,sums:array<bigint>>"
    none = F.struct(F.lit(0).alias("at"), F.array().alias("sums")).cast(kind)
    add = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["sums"], F.array(a["at"])).alias("sums")).cast(kind)
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(numbers) / F.lit(STEP)).cast("int") - 1, F.lit(0)))
    own = F.transform(steps, lambda k: F.aggregate(F.slice(numbers, k * STEP + 1, F.lit(STEP)), none, add))
    bases = F.aggregate(F.transform(own, lambda c: c["at"]), none, add, lambda a: a["sums"])
    return F.flatten(F.zip_with(own, bases, lambda c, base: F.transform(c["sums"], lambda x: x + base)))


def chat_format(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted and loss_spans (start and length of each assistant text in formatted, in characters and in bytes of UTF-8)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    # Each step is a column of its own, so that it is computed once and not for each turn.
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    safe = sorted_turns.select("conv_id", F.transform("turns", lambda t: F.struct(escaped(t["role"], role=True).alias("role"), escaped(t["text"]).alias("text"))).alias("turns"))
    blocks = safe.select("conv_id", blocks_of(F.col("turns")).alias("blocks"))
    parts = F.transform(
        "blocks",
        lambda b: F.struct(
            F.concat(F.lit(OPEN), b["role"], F.lit(": ")).alias("head"),
            b["texts"].alias("texts"),
            (b["role"] == "assistant").alias("loss"),
        ),
    )
    # Pieces in order, each with whether the loss mask covers it.
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            parts,
            lambda p: F.concat(
                F.array(piece(p["head"], F.lit(False))),
                F.flatten(F.transform(p["texts"], lambda x, i: F.array(piece(F.when(i > 0, F.lit(DIVIDE)).otherwise(F.lit("")), F.lit(False)), piece(x, p["loss"])))),
                F.array(piece(F.lit(CLOSE), F.lit(False))),
            ),
        )
    )
    laid = blocks.select("conv_id", pieces.alias("pieces"))
    before = lambda size: sums_before(F.transform("pieces", lambda p: size(p["s"])))
    placed = laid.select("conv_id", "pieces", before(F.length).alias("start"), before(F.octet_length).alias("byte_start"))
    rows = F.arrays_zip("pieces", "start", "byte_start")
    spans = F.transform(F.filter(rows, lambda x: x["pieces"]["loss"]), lambda x: F.struct(x["start"].cast("int").alias("start"), F.length(x["pieces"]["s"]).alias("length"), x["byte_start"].cast("int").alias("byte_start"), F.octet_length(x["pieces"]["s"]).alias("byte_length")))
    return placed.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text of each turn as it came), loss_text (all text under the loss mask, unescaped) and formatted_chars."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, F.lit(": ")) + 2, F.length(b)), DIVIDE, -1),
                lambda x: F.struct(unescaped(F.substring(b, F.lit(len(OPEN) + 1), F.instr(b, F.lit(": ")) - len(OPEN) - 1)).alias("role"), unescaped(x).alias("text")),
            ),
        )
    )
    # Bytes are cut out where they stand; characters would be counted from the text's start for each span.
    cut_out = lambda raw: F.transform("loss_spans", lambda s: unescaped(F.substring(raw, s["byte_start"] + 1, s["byte_length"]).cast("string")))
    loss = F.array_join(F.flatten(F.transform(F.array(F.col("formatted").cast("binary")), cut_out)), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
