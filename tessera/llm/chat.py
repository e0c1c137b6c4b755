"""Chat formatting: a finite-state machine over roles and a declarative template.

Main path: DataFrame functions only. A template gives each role an opening and a closing marker and a
loss flag. Each conversation becomes an ordered list of segments (text, loss): marker, escaped text,
marker, for every turn. ``parse`` reads the formatted string back.

Escaping: a backslash is doubled, and each marker's string inside a text becomes a backslash and a letter.
So no marker's string is left in an escaped text, and ``unescape`` restores the text exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers per role, those of any other role, and the machine's transitions."""

    roles: dict[str, Role]
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    accept: frozenset[str] = frozenset()

    def __post_init__(self):
        marks = self.markers()
        if len(marks) > 26 or any(not m or "\\" in m for m in marks) or len(set(marks)) != len(marks):
            raise ValueError("markers must be distinct, not empty, without backslash, 26 at most")
        if any(a != b and a in b for a in marks for b in marks):
            raise ValueError("no marker may be part of another")

    def markers(self) -> list[str]:
        return [m for r in self.roles.values() for m in (r.opening, r.closing)] + list(self.other)


INSTRUCTION_TEMPLATE = Template(
    roles={
        "system": Role("<<SYS>>", "<</SYS>>"),
        "user": Role("[INST]", "[/INST]"),
        "assistant": Role("<s>", "</s>", loss=True),
    },
    moves={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    accept=frozenset({"assistant"}),
)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for k, mark in enumerate(template.markers()):
        out = F.replace(out, F.lit(mark), F.lit("\\" + chr(97 + k)))
    return out


def unescape(text: Column, template: Template) -> Column:
    def restore(piece: Column) -> Column:
        for k, mark in enumerate(template.markers()):
            piece = F.replace(piece, F.lit("\\" + chr(97 + k)), F.lit(mark))
        return piece

    return F.when(
        F.contains(text, F.lit("\\")), F.array_join(F.transform(F.split(text, r"\\\\", -1), restore), "\\")
    ).otherwise(text)


def by_role(role: Column, template: Template, what) -> Column:
    """CASE over the template's roles; null for any other."""
    out = F.lit(None)
    for name, r in reversed(list(template.roles.items())):
        out = F.when(role == name, F.lit(what(r))).otherwise(out)
    return out


def format_chat(
    turns: DataFrame, template: Template = INSTRUCTION_TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conversation, segments array<struct<text, loss>>, formatted, n_turns, valid, state) per conversation.

    Turns are ordered by turn number (null first), ties by role and text; a repeated row is a turn of its
    own. Null role and null text count as empty. A conversation that the machine rejects, or that ends
    outside its accepting states, is formatted all the same, with ``valid`` false and the last state (or
    ``error``). Rows with a null conversation form one conversation. A conversation's turns meet in one
    task, because its formatted text is one value.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("c"), F.struct(F.col(turn_col).alias("n"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def segments(t: Column) -> Column:
        opening = F.coalesce(
            by_role(t["role"], template, lambda r: r.opening),
            F.concat(F.lit(template.other[0]), escape(t["role"], template), F.lit(template.other[1])),
        )
        closing = F.coalesce(by_role(t["role"], template, lambda r: r.closing), F.lit(template.other[2]))
        loss = F.coalesce(by_role(t["role"], template, lambda r: r.loss), F.lit(False))
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), loss.alias("loss")),
            F.struct(closing.alias("text"), F.lit(False).alias("loss")),
        )

    moves = F.create_map(*[F.lit(x) for (a, b), c in template.moves.items() for x in (f"{a}>{b}", c)])
    state = F.aggregate(
        "ts", F.lit(template.start), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), t["role"])), F.lit("error"))
    )
    out = convs.select(
        F.col("c").alias(conv_col), F.size("ts").cast("long").alias("n_turns"), state.alias("state"),
        F.flatten(F.transform("ts", segments)).alias("segments"),
    )
    return out.select(
        conv_col, "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "n_turns",
        F.col("state").isin(*sorted(template.accept)).alias("valid"), "state",
    )


def parse(formatted: Column, template: Template = INSTRUCTION_TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted conversation: the inverse of ``format_chat``."""
    closings = [r.closing for r in template.roles.values()] + [template.other[2]]
    parts = F.split(formatted, "(?<=" + "|".join(_literal(c) for c in closings) + ")", -1)

    def turn(p: Column) -> Column:
        out = F.lit(None)
        head, middle, tail = template.other
        body = F.substring(p, F.lit(len(head) + 1), F.length(p) - len(head) - len(tail))
        cut = F.locate(middle, body)
        out = F.struct(
            unescape(F.substring(body, F.lit(1), cut - 1), template).alias("role"),
            unescape(F.substring(body, cut + len(middle), F.length(body)), template).alias("text"),
        )
        for name, r in template.roles.items():
            inner = F.substring(p, F.lit(len(r.opening) + 1), F.length(p) - len(r.opening) - len(r.closing))
            out = F.when(F.startswith(p, F.lit(r.opening)), F.struct(F.lit(name).alias("role"), unescape(inner, template).alias("text"))).otherwise(out)
        return out

    return F.transform(F.filter(parts, lambda p: p != ""), turn)


def _literal(mark: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in mark)


def loss_text(segments: Column, template: Template = INSTRUCTION_TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
