"""Chat formatting: a declarative template, a state machine over roles, and loss flags by segment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written and which order of roles is valid.

    A turn is ``begin + role + between + text + end``. ``learn`` has the roles whose texts count for
    the loss. ``moves`` maps (state, role) to the next state; a conversation starts in ``start`` and
    is complete in ``final`` states.
    """

    begin: str = "<|im_start|>"
    between: str = "\n"
    end: str = "<|im_end|>\n"
    learn: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


#: "<", any number of backslashes and "|" get one backslash more, so that no text holds "<|".
_OPEN, _ESCAPED = r"<(\\*)\|", r"<\\(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN, r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1|")


#: What a role can't hold as it is, and how it is written; "%" comes first, and last when read back.
_IN_ROLE = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))


def escape_role(role: Column) -> Column:
    """On one line and without control strings."""
    for plain, written in _IN_ROLE:
        role = F.replace(role, F.lit(plain), F.lit(written))
    return role


def unescape_role(role: Column) -> Column:
    for plain, written in reversed(_IN_ROLE):
        role = F.replace(role, F.lit(written), F.lit(plain))
    return role


def format_chat(
    turns: DataFrame,
    template: Template = Template(),
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row for each conversation: ``conv_id, formatted, segments, valid, bad_turn``.

    ``segments`` has (text, loss) in order and joins to ``formatted``. The state machine runs over the roles in order of the
    turns and says of each whether its text carries the loss: those of the template's ``learn`` roles do, also where the order is wrong. ``bad_turn`` is the place of the first turn that it can't take (null if there is none),
    ``valid`` whether it took all and ended in a final state. Control strings in texts and roles are
    escaped so that :func:`read_chat` gives back what was there.
    Cases: null texts and roles are empty; turns with equal numbers go by role and text, those
    without number come first; rows without ``conv_id`` are one conversation; repeated rows are repeated
    turns; an empty table gives an empty table. A conversation is one row, as it is one training example; the machine's list of
    flags is copied at each turn, 8 bytes a turn so far, so some 50 MB of copying for 3,500 turns.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.select(F.col(conv_id).alias("conv_id"), one.alias("t")).groupBy("conv_id")
    all_turns = F.sort_array(F.collect_list("t"))
    segment = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def of_turn(t: Column, learn: Column) -> Column:
        return F.array(
            segment(F.concat(F.lit(template.begin), escape_role(t["role"]), F.lit(template.between)), no),
            segment(escape(t["text"]), learn),
            segment(F.lit(template.end), no),
        )

    key = lambda state, role: F.concat(state, F.lit("\n"), role)
    moves = F.create_map(*(F.lit(x) for (a, b), c in template.moves.items() for x in (f"{a}\n{b}", c)))
    begin = F.struct(
        F.lit(template.start).alias("state"),
        F.lit(None).cast("int").alias("bad"),
        F.array().cast("array<boolean>").alias("learn"),
    )

    def move(acc: Column, t: Column) -> Column:
        there = F.try_element_at(moves, key(acc["state"], t["role"]))
        bad = F.when(acc["bad"].isNull() & there.isNull(), F.size(acc["learn"])).otherwise(acc["bad"])
        learn = F.array_append(acc["learn"], t["role"].isin(*template.learn))
        return F.struct(F.coalesce(there, acc["state"]).alias("state"), bad.alias("bad"), learn.alias("learn"))

    grouped = rows.agg(all_turns.alias("turns"))
    out = grouped.select("conv_id", "turns", F.aggregate("turns", begin, move).alias("machine"))
    out = out.select("conv_id", F.flatten(F.zip_with("turns", "machine.learn", of_turn)).alias("segments"), "machine")
    return out.select(
        "conv_id",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        (F.col("machine.bad").isNull() & F.col("machine.state").isin(*template.final)).alias("valid"),
        F.col("machine.bad").alias("bad_turn"),
    )


def read_chat(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    quoted = lambda x: "\\Q" + x + "\\E"
    parts = F.split(formatted, quoted(template.begin), -1)
    turns = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def parse(part: Column) -> Column:
        role = F.substring_index(part, template.between, 1)
        rest = F.substr(part, F.length(role) + len(template.between) + 1)
        body = F.left(rest, F.length(rest) - len(template.end))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, parse)


def learned_text(segments: Column) -> Column:
    """The text under the loss mask, without escapes."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
