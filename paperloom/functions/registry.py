"""What a job can be told: renderers, rules, code tables, settings and options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Unknown(ValueError):
    """A name that is not registered; the message lists those that are."""


@dataclass(frozen=True)
class Renderers:
    """Names, file extensions and aliases of renderers; registering gives a new registry."""

    entries: dict[str, tuple[Callable[..., DataFrame], str, tuple[str, ...]]] = field(default_factory=dict)

    def register(self, name: str, render: Callable[..., DataFrame], extension: str, aliases: tuple[str, ...] = ()) -> Renderers:
        return replace(self, entries={**self.entries, name: (render, extension, aliases)})

    def resolve(self, name: str) -> str:
        wanted = name.lower()
        for known, (_, _, aliases) in self.entries.items():
            if wanted == known or wanted in aliases:
                return known
        raise Unknown(f"unknown format {name!r}; known: {', '.join(self.names())}")

    def render(self, name: str, *frames: DataFrame, **options) -> DataFrame:
        return self.entries[self.resolve(name)][0](*frames, **options)

    def names(self) -> list[str]:
        return sorted({n for known, (_, _, aliases) in self.entries.items() for n in (known, *aliases)})


@dataclass(frozen=True)
class Rule:
    name: str
    description: str
    auto: bool
    detector: Column
    transform: Callable[[Column], Column]


@dataclass
class Rules:
    """Rules by name; one that is registered again keeps its place."""

    rules: dict[str, Rule] = field(default_factory=dict)

    def register(self, rule: Rule) -> None:
        self.rules[rule.name] = rule

    def decisions(self, docs: DataFrame, **choices) -> DataFrame:
        from paperloom.operators.rules import rule_decisions

        return rule_decisions(docs, [{"name": r.name, "auto": r.auto, "detector": r.detector} for r in self.rules.values()], **choices)

    def apply(self, lines: DataFrame, decisions: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
        """Each rule's transform where it is enabled for the document, in the order of registration."""
        wide = decisions.filter("enabled").groupBy(key).agg(F.collect_set("name").alias("_on"))
        out, t = lines.join(wide, key, "left"), F.col(text)
        for rule in self.rules.values():
            t = F.when(F.coalesce(F.array_contains("_on", rule.name), F.lit(False)), rule.transform(t)).otherwise(t)
        return out.withColumn(text, t).drop("_on")


def code_table(chars: Column, table: dict[int, str]) -> Column:
    """A caller's own printer codes: byte values to text."""
    out = chars
    for code, text in sorted(table.items()):
        out = F.replace(out, F.lit(chr(code)), F.lit(text))
    return out


#: Settings by preset name.
PRESETS = {"default": {"length": 66, "top": 3, "bottom": 8, "offset": 8}, "legal": {"length": 84, "top": 3, "bottom": 8, "offset": 8}, "plain": {"length": 66, "top": 0, "bottom": 0, "offset": 0}}


def settings(text: str) -> dict[str, int]:
    """A preset's name, or ``key=value`` pairs parted by commas; keys and numbers are checked."""
    if text in PRESETS:
        return dict(PRESETS[text])
    out = {}
    for pair in text.split(","):
        key, equals, value = (x.strip() for x in pair.partition("="))
        if not equals or key not in PRESETS["default"]:
            raise Unknown(f"unknown preset or key {pair.strip()!r}; presets: {', '.join(PRESETS)}; keys: {', '.join(PRESETS['default'])}")
        if not value.isdigit():
            raise ValueError(f"{key} needs a whole number, not {value!r}")
        out[key] = int(value)
    return out


@dataclass(frozen=True)
class Options:
    """Options of an export job."""

    notes: tuple[str, ...] = ("footnote", "endnote", "annotation")
    headers: bool = True
    toc: bool = False
    page_numbers: str = "auto"
    spacing: str = "auto"
    pictures: bool = True

    def __post_init__(self):
        if self.page_numbers not in ("auto", "on", "off") or self.spacing not in ("auto", "keep", "single"):
            raise ValueError("page_numbers is auto, on or off; spacing is auto, keep or single")
