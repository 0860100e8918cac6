"""Pages: filling, numbering, trimming and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.fold import fold_out
from paperloom.operators.timeline import state_at


def page_starts(lines: DataFrame, budget: int | Column, key: str = "doc", order: list[str] = ("bi", "li"), cost: str = "cost", forced: str = "forced", keep: Column | None = None, blank: Column | None = None) -> DataFrame:
    """(key, order, start, page) of every line that starts a page: a forced break, a line whose
    cost no longer fits the budget, or one that is to stay with the next lines (``keep`` of them,
    itself included, up to a forced break) and does not fit with them. A page's budget is that in
    force at its first line. A ``blank`` line at the top of a page is not printed: it is listed with
    ``start`` false.

    Filling is sequential inside a document, so its lines are folded in order; the state is the
    room used, and only starts are given out, never a page for each line.
    """
    no = F.lit(False)
    one = F.struct(*(F.col(c) for c in order), F.col(cost).cast("long").alias("cost"), F.coalesce(F.col(forced).cast("boolean"), no).alias("forced"), F.coalesce(F.lit(0) if keep is None else keep.cast("int"), F.lit(0)).alias("keep"), F.coalesce(no if blank is None else blank, no).alias("blank"), (F.lit(budget) if isinstance(budget, int) else budget).cast("long").alias("budget"))
    kinds = dict(lines.dtypes)
    place = "struct<" + ",".join(f"{c}:{kinds[c]}" for c in order) + ",start:boolean>"
    folded = lines.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("_l"))
    need = "cost"
    if keep is not None:

        def together(x: Column, i: Column) -> Column:
            none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"))
            more = lambda acc, y: F.struct(F.when(acc["open"] & ~y["forced"], acc["n"] + y["cost"]).otherwise(acc["n"]).alias("n"), (acc["open"] & ~y["forced"]).alias("open"))
            return F.when(x["keep"] > 1, x["cost"] + F.aggregate(F.slice("_l", i + 2, x["keep"] - 1), none, more, lambda a: a["n"])).otherwise(x["cost"])

        need = "need"
        folded = folded.withColumn("_l", F.transform("_l", lambda x, i: x.withField("need", together(x, i))))

    def step(page: Column, x: Column) -> tuple[Column, Column]:
        fresh = (page["used"] < 0) | x["forced"] | (page["used"] + x[need] > page["room"])
        skipped = fresh & x["blank"]
        here = F.array(F.struct(*(x[c].alias(c) for c in order), (~skipped).alias("start")))
        used = F.when(skipped, -1).when(fresh, x["cost"]).otherwise(page["used"] + x["cost"])
        after = F.struct(used.cast("long").alias("used"), F.when(fresh, x["budget"]).otherwise(page["room"]).alias("room"))
        return after, F.when(fresh, here).otherwise(F.array().cast(f"array<{place}>"))

    nothing = F.struct(F.lit(-1).cast("long").alias("used"), F.lit(0).cast("long").alias("room"))
    out = folded.select(key, F.explode(fold_out(F.col("_l"), nothing, step, place)).alias("_p")).select(key, "_p.*")
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("page", F.sum(F.col("start").cast("long")).over(upto))


def paginate(lines: DataFrame, budget: int | Column, key: str = "doc", order: list[str] = ("bi", "li"), cost: str = "cost", forced: str = "forced", keep: Column | None = None, blank: Column | None = None) -> DataFrame:
    """Each printed line with its page: the last page start at or before it."""
    starts = page_starts(lines, budget, key, order, cost, forced, keep, blank)
    if blank is not None:
        lines = lines.join(starts.filter(~F.col("start")).select(key, *order), [key, *order], "left_anti")
    return state_at(lines, starts.filter("start"), key, list(order), "page", "page")


def page_prefix(lines: DataFrame, n: int, budget: int | Column, key: str = "doc", order: list[str] = ("bi", "li"), cost: str = "cost", forced: str = "forced", keep: Column | None = None, blank: Column | None = None) -> DataFrame:
    """The lines of each document that its first n pages can need, and no more than a bound of others.

    A page holds at most its budget, or one line that is larger: so a line by whose end more than n
    times the largest budget or line has been spent is on a later page, as is one behind more than
    n forced breaks. Lines that may be left out at the top of a page are counted as free. Where
    lines look ahead (``keep``), as many more are kept. Running sums pass over a document's lines;
    none of them are gathered."""
    room = (F.lit(budget) if isinstance(budget, int) else budget).cast("long")
    free = F.lit(False) if blank is None else F.coalesce(blank, F.lit(False))
    spent = F.when(free, 0).otherwise(F.col(cost).cast("long"))
    breaks = F.when(F.coalesce(F.col(forced).cast("boolean"), F.lit(False)) & ~free, 1).otherwise(0)
    most = lines.groupBy(key).agg(F.max(F.greatest(room, F.col(cost).cast("long"))).alias("_most"), F.max(F.lit(1) if keep is None else F.coalesce(keep.cast("int"), F.lit(1))).alias("_ahead"))
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    m = lines.withColumns({"_spent": F.sum(spent).over(upto), "_breaks": F.sum(breaks).over(upto), "_nth": F.row_number().over(w)}).join(most, key)
    later = (F.col("_spent") > n * F.col("_most")) | (F.col("_breaks") > n)
    # the first line known to be later; a few lines on are looked at from before it
    m = m.withColumn("_first", F.min(F.when(later, F.col("_nth"))).over(upto))
    return m.filter(F.col("_first").isNull() | (F.col("_nth") < F.col("_first") + F.col("_ahead"))).drop("_spent", "_breaks", "_nth", "_most", "_ahead", "_first")


def first_pages(lines: DataFrame, n: int, budget: int | Column, key: str = "doc", order: list[str] = ("bi", "li"), cost: str = "cost", forced: str = "forced", keep: Column | None = None, blank: Column | None = None) -> DataFrame:
    """Lines of the first n pages, as the full run has them; only ``page_prefix`` of the lines is folded."""
    own = (budget, key, order, cost, forced, keep, blank)
    return paginate(page_prefix(lines, n, *own), *own).filter(F.col("page") <= n)


def wrap_words(df: DataFrame, width: int, text: str = "text") -> DataFrame:
    """Rows (..., row, text) of greedily filled lines; spaces at a line's end are dropped and a word
    longer than the width has a line of its own."""
    words = F.filter(F.split(F.trim(F.col(text)), " +"), lambda w: w != "")

    def step(line: Column, w: Column) -> tuple[Column, Column]:
        fits = (line == "") | (F.length(line) + 1 + F.length(w) <= width)
        joined = F.when(line == "", w).otherwise(F.concat(line, F.lit(" "), w))
        return F.when(fits, joined).otherwise(w), F.when(fits, F.array().cast("array<string>")).otherwise(F.array(line))

    rows = fold_out(words, F.lit(""), step, "string", F.array)
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(rows).alias("row", text)).withColumn("row", F.col("row").cast("long"))


def break_reasons(lines: DataFrame, forced: Column, form_feed: Column | None = None, key: str = "doc", page: str = "page", order: list[str] = ("bi", "li")) -> DataFrame:
    """First line of each page with the reason: start, form feed, explicit (another forced break) or
    overflow."""
    w = Window.partitionBy(key).orderBy(*order)
    m = lines.withColumns({"_was": F.lag(page).over(w), "_forced": forced, "_feed": F.lit(False) if form_feed is None else F.coalesce(form_feed, F.lit(False))})
    m = m.filter(F.col("_was").isNull() | (F.col("_was") != F.col(page)))
    reason = F.when(F.col("_was").isNull(), "start").when(F.col("_feed"), "form feed").when(F.col("_forced"), "explicit").otherwise("overflow")
    return m.select(key, page, *order, reason.alias("reason"))


def trailing_trim(lines: DataFrame, keys: list[str], order: str = "li", text: str = "text") -> DataFrame:
    """Lines without the blank ones at the end of each page; ``trailing`` counts those dropped."""
    after = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    m = lines.withColumn("_full", F.max((F.trim(text) != "").cast("int")).over(after))
    m = m.withColumn("trailing", F.count_if(F.col("_full") == 0).over(Window.partitionBy(*keys)))
    return m.filter("_full = 1").drop("_full")


def trailing_pages(pages: DataFrame, full: Column, explicit: Column, key: str = "doc", page: str = "page") -> DataFrame:
    """Pages without the empty ones at a document's end, unless they were asked for."""
    after = Window.partitionBy(key).orderBy(F.col(page).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("_stays", F.max((full | explicit).cast("int")).over(after)).filter("_stays = 1").drop("_stays")


def trailing_break(blocks: DataFrame, blank_after: Column, key: str = "doc", order: str = "bi", kind: str = "kind") -> DataFrame:
    """Blocks without a page break that ends a document, unless a blank line followed it."""
    last = F.lead(order).over(Window.partitionBy(key).orderBy(order)).isNull()
    return blocks.withColumn("_last", last).filter(~(F.col("_last") & (F.col(kind) == "pagebreak") & ~blank_after)).drop("_last")


def machine_margin(lines: DataFrame, key: str = "doc", page: str = "page", order: str = "line", text: str = "text") -> DataFrame:
    """Lines without the machine's own top margin: the fewest leading blanks of pages two and on
    (of the first page if there is only one)."""
    full = F.min(F.when(F.trim(text) != "", F.col(order)))
    lead = lines.groupBy(key, page).agg(F.coalesce(full - F.min(order), F.count("*")).alias("_lead"))
    least = lead.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(page) > 1, F.col("_lead"))), F.min("_lead")).alias("margin"))
    first = Window.partitionBy(key, page)
    m = lines.join(least, key).withColumn("_at", F.col(order) - F.min(order).over(first))
    return m.filter(F.col("_at") >= F.col("margin")).drop("_at")


def geometry_summary(df: DataFrame, key: str, orientation: str, width: str) -> DataFrame:
    return df.groupBy(key).agg((F.countDistinct(orientation) > 1).alias("orientation_varies"), (F.countDistinct(width) > 1).alias("width_varies"), F.countDistinct(orientation).alias("orientations"))


def column_sheets(pages: DataFrame, key: str = "doc", page: str = "page", columns: str = "columns", gutter: str = "gutter", width: int = 65) -> DataFrame:
    """Sub-pages of one (columns, gutter) region in groups of n: sheet number, column index, offset."""
    w = Window.partitionBy(key).orderBy(page)
    changed = F.coalesce((F.col(columns) != F.lag(columns).over(w)) | (F.col(gutter) != F.lag(gutter).over(w)), F.lit(True))
    m = pages.withColumn("_region", F.sum(changed.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy(key, "_region").orderBy(page)) - 1
    m = m.withColumn("_at", at).withColumn("column", (F.col("_at") % F.col(columns)).cast("long"))
    m = m.withColumn("sheet", F.sum((F.col("column") == 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    column_width = F.expr(f"({width} - ({columns} - 1) * {gutter}) div {columns}")
    return m.withColumn("x_offset", F.col("column") * (column_width + F.col(gutter))).drop("_region", "_at")


def region_breaks(blocks: DataFrame, key: str = "doc", order: str = "bi", kind: str = "kind", columns: str = "columns") -> DataFrame:
    """Break rows (key, order, before) where a multi-column region ends or changes between
    paragraph blocks, unless a page break is already between."""
    w = Window.partitionBy(key).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    para = F.col(kind) == "para"
    m = blocks.withColumns({"_was": F.last(F.when(para, F.col(columns)), ignorenulls=True).over(past), "_at": F.last(F.when(para, F.col(order)), ignorenulls=True).over(past), "_break": F.last(F.when(F.col(kind) == "pagebreak", F.col(order)), ignorenulls=True).over(past)})
    changes = para & (F.col("_was") > 1) & (F.col(columns) != F.col("_was")) & (F.col("_break").isNull() | (F.col("_break") < F.col("_at")))
    return m.filter(changes).select(key, F.col(order).alias("before"), F.col("_was").alias("was"), F.col(columns).alias("now"))


def toc_page_join(entries: DataFrame, pages: DataFrame, key: str = "doc", block: str = "bi", number: str = "number", order: str = "page") -> DataFrame:
    """Entries with the number of the first page that carries their block; none stays null."""
    first = pages.groupBy(key, block).agg(F.min_by(number, order).alias("number"))
    return entries.join(first, [key, block], "left")
