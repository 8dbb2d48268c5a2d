"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a template.

A template says, for each role, what stands before and after its text and whether the text is trained on.
Control strings inside texts are escaped reversibly. Output is one row per conversation: the formatted
text, its segments (text, loss), the loss spans, whether the turn order is valid, and the state the order
ended in. ``read_back`` recovers the turns from the formatted text alone. All are built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Doubled in texts; placed single after the first letter of a control string to break it.
ESCAPE = "\\"


@dataclass(frozen=True)
class Role:
    """What stands before and after a role's text; whether the text is under the loss mask."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turn marks by role, the strings that must not appear in texts, and the order of turns.

    Every turn opens with ``turn`` and its role's ``before``. A role that ``roles`` lacks is written
    out between ``other.before`` and ``name_end``. order: state -> {role: next state}; a role without
    an entry leads to ``error``, which nothing leaves.

    A template whose texts could not be told from its marks is refused with ValueError: marks have no
    escape character in them; those that parsing looks for have two characters or more and do not overlap
    themselves; none of the strings before a text begins like another; and no mark meets a text's end in a
    way that could read as a turn or as the end of a name.
    """

    turn: str = "<s>"
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("[SYS]", "[/SYS]</s>"),
            "user": Role("[INST]", "[/INST]</s>"),
            "assistant": Role("[OUT]", "[/OUT]</s>", loss=True),
        }
    )
    other: Role = Role("[ROLE]", "[/TURN]</s>")
    name_end: str = "[/ROLE]"
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("asked", "answered")

    def __post_init__(self):
        every = [*self.roles.values(), self.other]
        marks = {self.turn, self.name_end} | {m for r in every for m in (r.before, r.after)}
        if any(ESCAPE in m for m in marks):
            raise ValueError("marks must not hold the escape character")
        if any(len(m) < 2 or _overlaps(m, m) for m in (self.turn, self.name_end)):
            raise ValueError("the turn mark and the end of a name need two characters or more and must not overlap themselves")
        opened = [r.before for r in every]
        if any(a.startswith(b) for i, a in enumerate(opened) for j, b in enumerate(opened) if i != j):
            raise ValueError("a role's mark must not begin like another's")
        # A mark in front of a text must not end as a parsed mark begins, nor one behind it begin as one ends.
        if any(self.turn in m or _overlaps(m, self.turn) for m in (*opened, self.name_end)) or any(self.turn in r.after or _overlaps(self.turn, r.after) for r in every):
            raise ValueError("marks beside a text must not read as part of a turn")
        if _overlaps(self.turn, self.name_end) or self.name_end in self.other.before or _overlaps(self.other.before, self.name_end):
            raise ValueError("the marks around a name must not read as its end")

    @property
    def controls(self) -> list[str]:
        """Strings that are escaped inside texts: the marks of two characters or more, and the common ones they are made of."""
        marks = {self.turn, "</s>", self.name_end, self.other.before, "[/TURN]"}
        for role in self.roles.values():
            marks |= {role.before, role.after.replace("</s>", "")}
        return sorted(m for m in marks if len(m) > 1 and not _overlaps(m, m))


def _overlaps(a: str, b: str) -> bool:
    """Whether a proper end of a is a proper beginning of b."""
    return any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))))


def escape(text: Column, controls: list[str]) -> Column:
    """text with escapes doubled and each control string broken by an escape after its first letter."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + ESCAPE + c[1:])), controls, doubled)


def unescape(text: Column, controls: list[str]) -> Column:
    """Inverse of escape, last control string first: a single escape stands only where one was broken."""
    whole = reduce(lambda t, c: F.replace(t, F.lit(c[0] + ESCAPE + c[1:]), F.lit(c)), reversed(controls), text)
    return F.replace(whole, F.lit(ESCAPE * 2), F.lit(ESCAPE))


def _final_state(roles: Column, template: Template) -> Column:
    def step(state: Column, role: Column) -> Column:
        out = F.lit("error")
        for name, moves in template.order.items():
            for on, to in moves.items():
                out = F.when((state == name) & (role == on), F.lit(to)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), step)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conv_id: conv_id, n_turns, valid, state, formatted, segments, spans.

    turns needs conv_id, turn, role and text; other columns are ignored. Turns are ordered by turn
    (null first), ties by role and text, so repeated rows are repeated turns. A null role or text counts
    as empty; a null conv_id is a conversation. segments: array of (text, loss), whose texts joined are
    ``formatted``; spans: array of (begin, length) in code points of the segments under the loss mask.
    valid: the order is accepted by the template's state machine; invalid ones are formatted too. A
    conversation is one row, its texts whole; an empty table gives an empty result.
    """
    template = template or Template()
    controls = template.controls
    role = F.coalesce("role", F.lit(""))
    text = F.coalesce("text", F.lit(""))
    listed = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), role.alias("role"), text.alias("text")))).alias("t")
    )

    def pieces(t: Column) -> Column:
        before = F.concat(F.lit(template.turn + template.other.before), escape(t["role"], controls), F.lit(template.name_end))
        after = F.lit(template.other.after)
        loss = F.lit(template.other.loss)
        for name, r in template.roles.items():
            is_it = t["role"] == name
            before = F.when(is_it, F.lit(template.turn + r.before)).otherwise(before)
            after = F.when(is_it, F.lit(r.after)).otherwise(after)
            loss = F.when(is_it, F.lit(r.loss)).otherwise(loss)
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], controls).alias("text"), loss.alias("loss")),
            F.struct(after.alias("text"), F.lit(False).alias("loss")),
        )

    state = _final_state(F.transform("t", lambda t: t["role"]), template)
    made = listed.select("conv_id", F.size("t").cast("long").alias("n_turns"), state.alias("state"), F.flatten(F.transform("t", pieces)).alias("segments"))
    sized = F.transform("segments", lambda s: F.struct(F.length(s["text"]).cast("long").alias("n"), s["loss"].alias("loss")))
    none = F.array().cast("array<struct<begin:long,length:long>>")
    walk = F.aggregate(
        sized,
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["n"]).alias("at"),
            F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("begin"), s["n"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return made.select(
        "conv_id",
        "n_turns",
        F.col("state").isin(*template.accepting).alias("valid"),
        "state",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        walk.alias("spans"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Turns (array of role, text) from a formatted text."""
    template = template or Template()
    controls = template.controls
    parts = F.split(formatted, F.concat(F.lit("\\Q"), F.lit(template.turn), F.lit("\\E")))
    parts = F.slice(parts, F.lit(2), F.size(parts))

    def turn(p: Column) -> Column:
        end = F.position(F.lit(template.name_end), p)
        start = len(template.other.before)
        named = F.substr(p, F.lit(start + 1), end - F.lit(1 + start))
        rest = F.substr(p, end + F.lit(len(template.name_end)), F.length(p))
        role, text = unescape(named, controls), F.substr(rest, F.lit(1), F.length(rest) - F.lit(len(template.other.after)))
        for name, r in template.roles.items():
            is_it = F.startswith(p, F.lit(r.before))
            role = F.when(is_it, F.lit(name)).otherwise(role)
            inner = F.substr(p, F.lit(len(r.before) + 1), F.length(p) - F.lit(len(r.before) + len(r.after)))
            text = F.when(is_it, inner).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, controls).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    controls = (template or Template()).controls
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["begin"] + 1).cast("int"), s["length"].cast("int")), controls)), ""
    )
