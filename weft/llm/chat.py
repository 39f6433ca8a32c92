"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered once, with that speaker's turns as
``assistant`` and the others' as ``user`` under their names; the mask covers what the assistant says.
Turns of a context role (``system``) are rendered as they are and are nobody's perspective.

A dialogue is gathered once, map tasks first putting together the turns that they hold, so a long one
reaches its task as one row per map task. Places in a rendered text are summed up in blocks of turns, so
time and memory follow the dialogue's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
HEAD, NAME, BODY, TAIL = "<|im_start|>", " name=", "\n", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    """A text can't open or close a turn: the marks' first two characters are parted."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


#: Turns whose places are summed up together.
BLOCK = 256
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _pieces(turns: Column, speaker: Column, context_roles: tuple[str, ...]) -> Column:
    """Of each turn what opens it, its text and whether the assistant speaks."""

    def piece(t: Column) -> Column:
        context = t["role"].isin(*context_roles) if context_roles else F.lit(False)
        who = F.when(context, t["role"]).when(t["role"] == speaker, "assistant").otherwise(
            F.concat(F.lit("user" + NAME), t["role"])
        )
        return F.struct(
            F.concat(F.lit(HEAD), who, F.lit(BODY)).alias("head"), t["text"].alias("body"),
            (~context & (t["role"] == speaker)).alias("own")
        )

    return F.transform(turns, piece)


def _placed(pieces: Column) -> Column:
    """Blocks of turns, each with its length and the spans of the assistant's words within it."""

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.when(p["own"], F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast(_SPANS))
        return F.struct((end + len(TAIL)).alias("at"), F.concat(s["spans"], span).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))
    firsts = F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK))
    return F.transform(firsts, lambda i: F.aggregate(F.slice(pieces, i, BLOCK), start, step))


def _mask(blocks: Column) -> Column:
    """The spans ``start, end`` (characters, end excluded) in the whole text."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    ends = F.aggregate(
        blocks, start,
        lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))
    )
    moved = lambda b, at: F.transform(b["spans"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end")))
    return F.flatten(F.zip_with(blocks, ends["starts"], moved))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    context_roles: tuple[str, ...] = CONTEXT_ROLES
) -> DataFrame:
    """Rows ``conv_id, speaker, n_turns, rendered, mask``, one per speaker of a dialogue, the whole dialogue in each.

    Turns are ordered by number (null first), then role, then text; repeated rows are repeated turns.
    A null role is the speaker ``unknown``, a null text is an empty one; rows with a null dialogue id
    form one dialogue. A dialogue with context turns only has no speaker and no rows. Texts and dialogues
    may be of any length that a row can hold. Other columns are not read; an empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
            _safe(F.col(text_col).cast("string")).alias("text")
        ).alias("t")
    )
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    roles = F.array_distinct(F.transform("turns", lambda t: t["role"]))
    spoken = F.filter(roles, lambda r: ~r.isin(*context_roles)) if context_roles else roles
    seen = whole.select("conv", "turns", F.explode(spoken).alias("speaker"))
    drawn = seen.select(
        "conv", "speaker", F.size("turns").cast("long").alias("n_turns"),
        _pieces(F.col("turns"), F.col("speaker"), context_roles).alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "")
    drawn = drawn.select("conv", "speaker", "n_turns", text.alias("rendered"), _placed(F.col("pieces")).alias("blocks"))
    return drawn.select(F.col("conv").alias(conv_col), "speaker", "n_turns", "rendered", _mask(F.col("blocks")).alias("mask"))
