"""Chat formatting from a declarative template, with DataFrame functions only.

The template names, for every role, the strings before and after its text and whether its text
counts for the loss. A finite-state machine over roles (the state is the role last seen) says
which turn may follow which. Control strings inside texts are broken up by a backslash after
their first character and backslashes are doubled, which ``unescape`` undoes exactly.

Work is dealt by conversation and block of turns, so one huge conversation is formatted in many
tasks; the machine's state passes from block to block by ``lag`` over one small row a block, which
holds no text. ``read_back`` gathers a conversation's text for its digest, so that must fit a row.

Defined cases: null text is empty; null role is the empty role; roles outside the template get
the generic marks with their name, and no transition allows them; rows of one conversation are
ordered by turn (null first), then role, then text; repeated rows are repeated turns; a null
conv_id is a conversation of its own; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RoleMarks:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    roles: dict[str, RoleMarks] = field(
        default_factory=lambda: {
            "system": RoleMarks("<<SYS>>", "<</SYS>>"),
            "user": RoleMarks("[INST] ", " [/INST]"),
            "assistant": RoleMarks("<s>", "</s>", loss=True),
        }
    )
    #: marks for any other role, around and after its escaped name
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    #: state -> roles that may come next; "" is the start
    turns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    last: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        marks = [m.strip() for r in self.roles.values() for m in (r.before, r.after)]
        return sorted({*marks, *self.other}, key=lambda s: (-len(s), s))


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|" else c for c in s)


def escape(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """No control string of the template occurs in the result."""
    out = F.regexp_replace(text, r"\\", r"\\\\")
    ahead = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in template.controls())
    return F.regexp_replace(out, ahead, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _segments(role: Column, text: Column, template: ChatTemplate) -> Column:
    """Segments of one turn: struct(text, loss), marks before and after the text included."""

    def pieces(before, loss: bool, after) -> Column:
        three = ((before, False), (escape(text, template), loss), (after, False))
        return F.array(*(F.struct(c.alias("text"), F.lit(b).alias("loss")) for c, b in three))

    a, b, c = template.other
    out = pieces(F.concat(F.lit(a), escape(role, template), F.lit(b)), False, F.lit(c))
    for name, m in template.roles.items():
        out = F.when(role == name, pieces(F.lit(m.before), m.loss, F.lit(m.after))).otherwise(out)
    return out


def format_conversations(
    df: DataFrame, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 64
) -> DataFrame:
    """Rows (conv_id, block, n_turns, segments, formatted, bad_turns, last_role): a conversation's
    text is its blocks in order. ``segments`` are the formatted pieces with their loss flags;
    ``bad_turns`` are the numbers (from 1, in the block) of turns that the machine does not allow."""
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.floor(F.col(turn_col).cast("long") / block).alias("block"),  # null first, as null turns are
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("t"),
    )
    # the machine goes from block to block over the last roles alone, no texts
    ends = turns.groupBy("conv_id", "block").agg(F.max(F.struct("t.turn", "t.role"))["role"].alias("last_role"))
    states = ends.select("conv_id", "block", F.lag("last_role").over(Window.partitionBy("conv_id").orderBy("block")).alias("state"))
    both = turns.unionByName(states, allowMissingColumns=True)
    blocks = both.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("t"), F.max("state").alias("state"))
    roles = F.transform("t", lambda x: x["role"])
    prior = F.concat(F.array(F.coalesce("state", F.lit(""))), roles)

    def allowed(state: Column, role: Column) -> Column:
        rules = [(state == s) & role.isin(*nxt) for s, nxt in template.turns.items()]
        return reduce(lambda x, y: x | y, rules)

    moves = F.transform(roles, lambda r, i: F.when(~allowed(F.get(prior, i), r), i + 1))
    bad = F.filter(moves, lambda x: x.isNotNull())
    segments = F.flatten(F.transform("t", lambda x: _segments(x["role"], x["text"], template)))
    out = blocks.select("conv_id", "block", F.size("t").cast("long").alias("n_turns"), bad.alias("bad_turns"), F.element_at("t", -1)["role"].alias("last_role"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _ends_well(template: ChatTemplate) -> Column:
    return F.max(F.struct("block", "last_role"))["last_role"].isin(*template.last).alias("ends_well")


def validate_turns(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, n_turns, n_bad (turns the machine refused), ends_well (its last role may end)."""
    return formatted.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sum(F.size("bad_turns")).cast("long").alias("n_bad"),
        _ends_well(template),
    )


def parse_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Array of struct(role, text) read back from formatted text."""
    a, b, c = template.other
    forms = [(None, a, c), *((n, m.before, m.after) for n, m in template.roles.items())]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(f"{_quoted(x)}.*?{_quoted(y)}" for _, x, y in forms)), F.lit(0))

    def inner(x: Column, before: str, after: str) -> Column:
        return F.substr(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))

    def turn(x: Column) -> Column:
        body = inner(x, a, c)
        cut = F.instr(body, b)
        role, text = F.substr(body, F.lit(1), cut - 1), F.substr(body, cut + len(b))
        for name, before, after in forms[1:]:
            mine = F.startswith(x, F.lit(before))
            role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, inner(x, before, after)).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(found, turn)


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests per conversation, from the formatted text and its loss mask, and what the machine
    says of its turns (n_bad, ends_well)."""
    turns = parse_turns(F.col("formatted"), template)
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = formatted.select("conv_id", "block", F.size(turns).cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"), said.alias("said"), learnt.alias("learnt"), F.size("bad_turns").alias("bad"), "last_role")

    def whole(c: str) -> Column:
        parts = F.sort_array(F.collect_list(F.struct("block", c)))
        return F.array_join(F.transform(parts, lambda p: p[c]), "")

    out = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), whole("said").alias("said"), whole("learnt").alias("learnt"), F.sum("bad").alias("n_bad"), _ends_well(template))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars", "n_bad", "ends_well")
