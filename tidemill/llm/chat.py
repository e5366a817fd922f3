"""Conversations as training text with a loss mask. DataFrame functions only.

A template declares the turn markers, which roles bear loss, and the turn orders as a finite-state machine. Texts are
escaped so that no marker can stand inside a turn, and can be read back from the formatted text alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opening: str = "### "
    named: str = ": "
    closing: str = "</turn>"
    after: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a conversation is valid if it ends in an accepted state
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    accepted: tuple[str, ...] = ("user", "assistant")
    #: control string -> what stands for it; the backslash itself comes first
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"), (":", "\\c"))


def _swap(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column, template: Template, role: bool = False) -> Column:
    return _swap(text, template.escapes if role else template.escapes[:-1])


def unescaped(text: Column, template: Template) -> Column:
    return _swap(text, [(new, old) for old, new in reversed(template.escapes)])


def final_state(turns: Column, template: Template) -> Column:
    """The machine's state after all roles; 'error' once a role isn't allowed, and ever after."""
    moves = F.create_map(*[F.lit(x) for a, to in template.moves.items() for role, b in to.items() for x in (f"{a}>{role}", b)])
    return F.aggregate(turns, F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), t["role"])), F.lit("error")))


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, valid, segments (array of text, loss), formatted: one row per conversation, its rows in order of turn.

    Null roles and texts count as empty; a null turn comes first; rows of the same turn follow each other by role,
    then text, repeated rows stay. Rows with a null conv_id are one conversation. Conversations whose roles the
    machine refuses are formatted too, with valid false. A conversation is put together in one task, since its
    result is one text. Columns besides conv_id, turn, role and text are ignored.
    """
    t = template or Template()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", blank("role").alias("role"), blank("text").alias("text")).alias("row"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def parts(row: Column) -> Column:
        head = F.concat(F.lit(t.opening), escaped(row["role"], t, role=True), F.lit(t.named))
        pieces = ((head, F.lit(False)), (escaped(row["text"], t), row["role"].isin(*t.loss_roles)), (F.lit(t.closing + t.after), F.lit(False)))
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in pieces])

    out = turns.select("conv_id", final_state(F.col("turns"), t).isin(*t.accepted).alias("valid"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return out.withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (array of role, text) of a formatted text."""
    t = template or Template()
    pieces = F.split(formatted, r"\Q" + t.closing + t.after + r"\E", -1)
    head = r"^\Q" + t.opening + r"\E([^:]*)\Q" + t.named + r"\E"
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        turns, lambda x: F.struct(unescaped(F.regexp_extract(x, head, 1), t).alias("role"), unescaped(F.regexp_replace(x, head, ""), t).alias("text"))
    )


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    t = template or Template()
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)))
