"""State that is set at one position and holds until the next.

As-of lookups are a union of both sides and one window per document, so no range join is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _names(order: list[str] | str) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def change_log(marks: DataFrame, name: str, keep: str = "changes", seed=None, key: str = "doc", order: list[str] | str = "pos", name_col: str = "name", value_col: str = "value") -> DataFrame:
    """Entries of one command's timeline.

    ``keep="changes"`` keeps a command only where its value differs from the one in force (the
    first is compared with ``seed``; without a seed it is kept); ``keep="all"`` keeps every
    command, and where several stand at one position (all of ``order`` but its last) the later.
    """
    order = _names(order)
    own = marks.filter(F.col(name_col) == name)
    if keep == "all":
        place = Window.partitionBy(key, *order[:-1]).orderBy(F.col(order[-1]).desc())
        return own.withColumn("_rank", F.row_number().over(place)).filter("_rank = 1").drop("_rank")
    before = F.lag(value_col).over(Window.partitionBy(key).orderBy(*order))
    prior = before if seed is None else F.coalesce(before, F.lit(seed))
    return own.withColumn("_prior", prior).filter(~F.col(value_col).eqNullSafe(F.col("_prior"))).drop("_prior")


def state_at(targets: DataFrame, timeline: DataFrame, key: str = "doc", order: list[str] | str = "pos", value_col: str = "value", out: str = "state", strict: bool = False) -> DataFrame:
    """As-of join: each target with the last value at or before it (``strict``: before it)."""
    order, keep = _names(order), targets.columns
    side = F.lit(1 if not strict else 0)
    left = targets.withColumns({"_side": side, "_value": F.lit(None).cast(timeline.schema[value_col].dataType), "_target": F.lit(True)})
    right = timeline.select(key, *order, F.col(value_col).alias("_value")).withColumns({"_side": F.lit(1) - side, "_target": F.lit(False)})
    both = left.unionByName(right, allowMissingColumns=True)
    until = Window.partitionBy(key).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_value", ignorenulls=True).over(until)).filter("_target").select(*keep, out)


def page_checkpoint(pages: DataFrame, timeline: DataFrame, key: str = "doc", order: list[str] | str = "pos", out: str = "checkpoint") -> DataFrame:
    """The number of checkpoints strictly before each page's read position; never falls."""
    order = _names(order)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return state_at(pages, timeline.withColumn("_nth", nth.cast("long")), key, order, "_nth", out, strict=True).withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def replay_events(lines: DataFrame, changes: DataFrame, key: str = "doc", block: str = "bi", line: str = "li") -> DataFrame:
    """Where change events fall in the flow: (doc, bi, place, kind, ref), place 0 before the
    block, n inside before line n, and the block's line count at its end."""
    sizes = lines.groupBy(key, block).agg(F.max(line).alias("_last"))
    placed = changes.join(sizes, [key, block], "left").withColumn("place", F.least(F.greatest(F.col(line), F.lit(0)), F.coalesce(F.col("_last") + 1, F.lit(0))))
    events = placed.select(key, block, "place", F.lit(0).alias("kind"), F.col("seq").alias("ref"))
    return events.unionByName(lines.select(key, block, F.col(line).alias("place"), F.lit(1).alias("kind"), F.col(line).alias("ref")))


def page_numbers(pages: DataFrame, checkpoint: str = "checkpoint", start: str = "start", key: str = "doc", page: str = "page") -> DataFrame:
    """A restart value holds on the first page of its checkpoint; later pages count on."""
    seg = Window.partitionBy(key, checkpoint).orderBy(page)
    return pages.withColumn("number", F.coalesce(F.first(start).over(seg), F.lit(1)) + F.row_number().over(seg) - 1)


def number_visibility(pages: DataFrame, switches: DataFrame, key: str = "doc", order: list[str] | str = "pos", on: str = "on") -> DataFrame:
    """Whether numbers show on each page: the last switch before it, on where there is none."""
    out = state_at(pages, switches, key, order, on, "visible", strict=True)
    return out.withColumn("visible", F.coalesce("visible", F.lit(True)))


@dataclass(frozen=True)
class Named:
    """A timeline's commands, or for ``says`` what each of them says; its seeds, if it has any; which
    commands make an entry (those that change the value, or all); and when the page's own facts
    replace the seeds (always, never, or where there is no entry)."""

    commands: tuple[str, ...]
    seeds: tuple[int | None, ...] | None = None
    keep: str = "changes"
    page: str = "never"
    says: tuple[int, ...] | None = None


#: The named timelines with their seeds (orientation 0 is portrait, auto_number 1 is on,
#: a null line interval is off). Each parity has an offset of its own.
TIMELINES = {
    "orientation": Named(("PR",), (0,)),
    "top_bottom": Named(("MT", "MB"), (3, 8), page="always"),
    "page_length": Named(("PL",), (66,), page="no entry"),
    "head_foot": Named(("HM", "FM"), (2, 2), page="no entry"),
    "offset": Named(("PO",), (8,), page="no entry"),
    "even_offset": Named(("POE",)),
    "odd_offset": Named(("POO",)),
    "page_start": Named(("PN",), (1,), keep="all", page="no entry"),
    "auto_number": Named(("PN", "PG", "OP"), (1,), says=(1, 1, 0)),
    "line_interval": Named(("L#",), (None,)),
}


def all_timelines(marks: DataFrame, page: DataFrame | None = None, timelines: dict[str, Named] = TIMELINES, key: str = "doc", order: list[str] | str = "pos", name_col: str = "name", value_col: str = "value") -> DataFrame:
    """(key, timeline, order, v0, v1): the entries of all timelines, and for seeded ones the value before
    any command, in a row without a place. v1 is the other half of a pair, null elsewhere.

    ``page`` has what a document's page geometry says, rows (key, timeline, v0, v1); documents without
    marks are known from there. Commands without a value are passed over, but for ``says``. In a
    restarting timeline (``keep="all"``) the later of two commands at one position (all of ``order``
    but its last) counts. One exchange by (key, timeline) serves all."""
    order = _names(order)
    kind = marks.schema[value_col].dataType
    rules: dict[str, list] = {}
    for name, t in timelines.items():
        for slot, command in enumerate(t.commands):
            own = F.col(value_col) if t.says is None else F.lit(t.says[slot]).cast(kind)
            rules.setdefault(command, []).append(F.struct(F.lit(name).alias("timeline"), F.lit(slot if t.says is None else 0).alias("slot"), own.alias("value")))
    hits = F.array().cast(f"array<struct<timeline:string,slot:int,value:{kind.simpleString()}>>")
    for command, structs in rules.items():
        hits = F.when(F.col(name_col) == command, F.array(*structs)).otherwise(hits)
    m = marks.select(key, *order, F.explode(hits).alias("h")).select(key, *order, "h.*").filter("value is not null")

    def of(field) -> Column:
        out = F.lit(None)
        for name, t in timelines.items():
            out = F.when(F.col("timeline") == name, F.lit(field(t))).otherwise(out)
        return out

    def seeds(rows: DataFrame) -> DataFrame:
        """Adds seed0, seed1: the page's facts where they always count, else the fixed ones."""
        fixed = [of(lambda t, i=i: t.seeds[i] if t.seeds and i < len(t.seeds) else None).cast(kind) for i in (0, 1)]
        if page is None:
            return rows.withColumns({"seed0": fixed[0], "seed1": fixed[1]})
        facts = page.select(key, "timeline", *(F.col(f"v{i}").cast(kind).alias(f"page{i}") for i in (0, 1)))
        always = of(lambda t: t.page) == "always"
        both = rows.join(facts, [key, "timeline"], "left")
        return both.withColumns({f"seed{i}": F.when(always, F.coalesce(f"page{i}", fixed[i])).otherwise(fixed[i]) for i in (0, 1)})

    m = seeds(m)
    by = Window.partitionBy(key, "timeline").orderBy(*order)
    until = by.rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumns({f"v{i}": F.coalesce(F.last(F.when(F.col("slot") == i, F.col("value")), ignorenulls=True).over(until), F.col(f"seed{i}")) for i in (0, 1)})
    before, seeded = F.lag(F.struct("v0", "v1")).over(by), of(lambda t: t.seeds is not None)
    m = m.withColumn("_before", F.coalesce(before, F.when(seeded, F.struct(F.col("seed0").alias("v0"), F.col("seed1").alias("v1")))))
    newest = F.row_number().over(Window.partitionBy(key, "timeline", *order[:-1]).orderBy(F.col(order[-1]).desc())) == 1
    restarts = of(lambda t: t.keep) == "all"
    m = m.withColumn("_newest", newest).filter(F.when(restarts, F.col("_newest")).otherwise(~F.struct("v0", "v1").eqNullSafe(F.col("_before"))))
    entries = m.select(key, "timeline", *order, "v0", "v1")

    docs = marks.select(key) if page is None else marks.select(key).unionByName(page.select(key))
    every = docs.distinct().select(key, F.explode(F.array(*(F.lit(n) for n, t in timelines.items() if t.seeds is not None))).alias("timeline"))
    first = seeds(every)
    if page is not None:
        some = entries.select(key, "timeline").distinct().withColumn("_some", F.lit(True))
        swap = (of(lambda t: t.page) == "no entry") & F.col("_some").isNull()
        first = first.join(some, [key, "timeline"], "left").withColumns({f"seed{i}": F.when(swap, F.coalesce(f"page{i}", f"seed{i}")).otherwise(F.col(f"seed{i}")) for i in (0, 1)})
    places = {c: F.lit(None).cast(marks.schema[c].dataType) for c in order}
    return entries.unionByName(first.select(key, "timeline", *(v.alias(c) for c, v in places.items()), F.col("seed0").alias("v0"), F.col("seed1").alias("v1")))


def latest_n(df: DataFrame, n: int, order: list[str] | str, key: str | None = None) -> DataFrame:
    """The newest n rows (of each key), by ``order`` descending."""
    descending = [F.col(c).desc() for c in _names(order)]
    if key is None:
        return df.orderBy(*descending).limit(n)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*descending)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def line_numbers(lines: DataFrame, interval: Column | str, key: str = "doc", page: str = "page", order: list[str] | str = "line") -> DataFrame:
    """Line numbers per page: the counter k restarts on a new page and wherever the interval changes,
    from and to none (null) included; a label is shown where k is a multiple of the interval."""
    step = F.col(interval) if isinstance(interval, str) else interval
    own = Window.partitionBy(key, page).orderBy(*_names(order))
    changed = ~F.col("_step").eqNullSafe(F.lag("_step").over(own))
    marked = lines.withColumn("_step", step).withColumn("_island", F.sum(F.when(changed, 1).otherwise(0)).over(own))
    k = F.row_number().over(Window.partitionBy(key, page, "_island").orderBy(*_names(order))) - 1
    marked = marked.withColumn("k", k.cast("long"))
    label = F.when(F.col("_step") > 0, F.when(F.col("k") % F.col("_step") == 0, F.expr("k div _step") + 1))
    return marked.withColumn("label", label).drop("_step", "_island")
