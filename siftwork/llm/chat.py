r"""Chat formatting with DataFrame functions only.

A template declares a machine over roles: for each state and role the next state, for each state the segments that a turn
entering it emits, with their loss flags. The machine runs over a conversation's turns in order; what it emits, joined, is
the formatted conversation, and loss_spans names the bytes of it that are under the loss mask. A move that is not declared
makes the order invalid; the machine goes on in the state that the template recovers to for that role, so every
conversation is formatted and every assistant text emitted. Texts are escaped so that no control string of the template
can come from a text: the escape character is doubled and put inside each control opener. read_back() parses a formatted
string to the same turns, for every template that the class accepts: it refuses those whose strings could not be told
from texts.

Edge cases: a null text or role is empty; turns sort by (turn, role, text), nulls first, and repeated rows are turns of
their own; a role without a rule makes the order invalid and carries no loss; an empty table gives an empty result; a
null conversation id is a conversation. A conversation is one row of the output, so its turns meet in one task: its size
is that of the string asked for, nothing else is gathered. Columns that are not named do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TEXT, END = "head", "text", "end"
_PLAIN = ((HEAD, False), (TEXT, False), (END, False))
#: Turns that a fold looks at before it starts a new list: what it appends to stays short.
CHUNK = 1024


@dataclass(frozen=True)
class Template:
    """opener, closer, after: the control strings of a turn; control: what they begin with and texts never hold.

    start: the machine's first state. moves: (state, role) to the next state. recover: role to the state after a move that
    is not declared; stray: that of other roles. final: states in which a conversation may end. emits: state to the
    segments of the turn that enters it, each a part and its loss flag; a state without an entry emits all without loss.
    """

    opener: str = "<|im_start|>"
    closer: str = "<|im_end|>"
    after: str = "\n"
    control: str = "<|"
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "primed",
            ("start", "user"): "asked",
            ("primed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    recover: dict[str, str] = field(default_factory=lambda: {"system": "primed", "user": "asked", "assistant": "answered"})
    stray: str = "stray"
    final: tuple[str, ...] = ("asked", "answered")
    emits: dict[str, tuple[tuple[str, bool], ...]] = field(default_factory=lambda: {"answered": ((HEAD, False), (TEXT, True), (END, False))})

    def __post_init__(self) -> None:
        wrong = []
        if len(self.control) < 2 or self.control[0] in self.control[1:]:
            wrong.append("control needs two characters or more, the first of which does not come again in it")
        if any("\\" in x or "\n" in x for x in (self.control, self.opener, self.closer)) or "\\" in self.after:
            wrong.append("control strings hold no backslash and no line break")
        if not (self.opener.startswith(self.control) and self.closer.startswith(self.control)):
            wrong.append("opener and closer begin with control")
        if self.opener.startswith(self.closer) or self.closer.startswith(self.opener):
            wrong.append("neither of opener and closer begins with the other")
        if any(self.control in x[1:] for x in (self.opener, self.closer)) or self.control[0] in self.after:
            wrong.append("control stands at the beginning of opener and closer only")
        if any(tuple(part for part, _ in parts) != (HEAD, TEXT, END) for parts in self.emits.values()):
            wrong.append("a turn emits its head, its text and its end, in this order")
        if wrong:
            raise ValueError("; ".join(wrong))


CHATML = Template()


def escape(text: Column, template: Template = CHATML, line_breaks: bool = False) -> Column:
    r"""Doubles each backslash and splits each control opener by one; line_breaks: puts one before each line break too."""
    head, tail = template.control[:1], template.control[1:]
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(template.control), F.lit(f"{head}\\{tail}"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if line_breaks else out


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): each conversation's turns in order."""
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.groupBy(F.col(conv).alias(conv)).agg(F.array_sort(F.collect_list(item)).alias("turns"))


def running(items: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The values that a fold of items takes after each of them. Lists of CHUNK values grow and are then put together, so
    a long array does not cost its length squared."""
    last = lambda values: F.element_at(values, -1)

    def whole(lists: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(items, k * CHUNK + 1, CHUNK), F.array(last(last(lists))), lambda values, x: F.concat(values, F.array(step(last(values), x))))
        return F.concat(lists, F.array(own))

    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / CHUNK).cast("int") - 1, F.lit(0)))
    lists = F.slice(F.aggregate(chunks, F.array(F.array(first)), whole), F.lit(2), F.size(chunks))
    return F.flatten(F.transform(lists, lambda values: F.slice(values, F.lit(2), F.size(values))))


def states_of(turns: Column, template: Template = CHATML) -> Column:
    """array<struct<state, valid>>: the machine after each turn; valid: whether all moves so far are declared."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    recover = F.create_map(*[F.lit(x) for pair in template.recover.items() for x in pair])

    def step(now: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(now["state"], F.lit("\n"), t["role"]))
        state = F.coalesce(to, F.try_element_at(recover, t["role"]), F.lit(template.stray))
        return F.struct(state.alias("state"), (now["valid"] & to.isNotNull()).alias("valid"))

    return running(turns, F.struct(F.lit(template.start).alias("state"), F.lit(True).alias("valid")), step)


def segments_of(turns: Column, states: Column, template: Template = CHATML) -> Column:
    """array<struct<text, loss>>: what the machine emits for each turn and the state that it enters."""

    def of(t: Column, now: Column) -> Column:
        texts = {
            HEAD: F.concat(F.lit(template.opener), escape(t["role"], template, line_breaks=True), F.lit("\n")),
            TEXT: escape(t["text"], template),
            END: F.lit(template.closer + template.after),
        }
        loss = {part: [state for state, parts in template.emits.items() if dict(parts)[part]] for part in texts}
        return F.array(*[F.struct(texts[part].alias("text"), (now["state"].isin(loss[part]) if loss[part] else F.lit(False)).alias("loss")) for part, _ in _PLAIN])

    return F.flatten(F.zip_with(turns, states, of))


def spans_of(segments: Column) -> Column:
    """array<struct<at, size>>: the segments under the loss mask, in bytes of the formatted conversation, from 1."""
    ends = running(segments, F.lit(0).cast("long"), lambda end, s: end + F.octet_length(s["text"]))
    both = F.zip_with(segments, ends, lambda s, end: F.struct((end - F.octet_length(s["text"]) + 1).alias("at"), F.octet_length(s["text"]).alias("size"), s["loss"].alias("loss")))
    return F.transform(F.filter(both, lambda s: s["loss"]), lambda s: F.struct(s["at"].alias("at"), s["size"].alias("size")))


def format_chats(rows: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, valid_order, segments (text with loss flag), loss_spans, formatted."""
    out = turns_of(rows, conv, turn, role, text)
    out = out.select(conv, "turns", states_of(F.col("turns"), template).alias("states"))
    end = F.try_element_at("states", F.lit(-1))
    out = out.select(conv, (end["valid"] & end["state"].isin(*template.final)).alias("valid_order"), segments_of(F.col("turns"), F.col("states"), template).alias("segments"))
    return out.withColumn("loss_spans", spans_of(F.col("segments"))).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> parsed from a formatted string."""
    end = re.escape(template.closer + template.after)
    pieces = F.filter(F.split(formatted, end, -1), lambda p: p != "")
    head = re.escape(template.opener) + r"((?:[^\\\n]|\\.)*+)\n"
    of = lambda p: F.struct(
        unescape(F.regexp_extract(p, rf"(?s)\A{head}", 1)).alias("role"),
        unescape(F.regexp_replace(p, rf"(?s)\A{head}", "")).alias("text"),
    )
    return F.transform(pieces, of)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text of a formatted conversation under the loss mask, unescaped, nothing between."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(raw, s["at"].cast("int"), s["size"]).cast("string"))), "")
