"""Regrouping of lines: logical lines, paragraphs, lists, scenes and item streams.

All windows of a job are partitioned by document, so one exchange serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.fold import fold_out

CLOSING, OPENING = "\"'’”", "\"'‘“"


def _doc(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order)


def _blank(c: Column | str) -> Column:
    return F.trim(c) == ""


def indent_of(text: Column) -> Column:
    return F.length(text) - F.length(F.ltrim(text))


def ends_terminal(text: Column) -> Column:
    """Ends in a full stop, question or exclamation mark, closing quotes set aside."""
    return F.rtrim(text).rlike(rf"[.!?][{CLOSING}]*$")


def break_kinds(lines: DataFrame, margin: Column, key: str = "doc", order: str = "li", text: str = "text", term: str = "terminator") -> DataFrame:
    """separator after each line: for blank lines blank_soft or blank_hard; else from the blanks
    that follow: eof (nothing but blanks left), over, para (a hard break and two breaks or more),
    line (hard, or the next word would have fitted below the margin), wrap."""
    w = _doc(key, order)
    m = lines.withColumns({"_blank": _blank(text), "_hard": (F.col(term) == "hard").cast("long"), "_one": (F.col(term) != "eof").cast("long")})
    m = m.withColumn("_run", F.sum(F.when(F.col("_blank"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "_run")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(~F.col("_blank"), F.ltrim(F.col(text))), ignorenulls=True).over(after)
    m = m.withColumns({"_nhard": F.sum("_hard").over(run), "_n": F.sum("_one").over(run), "_next": nxt, "_margin": margin})
    fits = F.length(F.rtrim(F.col(text))) + 1 + F.length(F.substring_index("_next", " ", 1)) < F.col("_margin")
    kind = (
        F.when(F.col("_blank"), F.when(F.col(term) == "soft", "blank_soft").otherwise("blank_hard"))
        .when(F.col(term) == "over", "over")
        .when(F.col("_next").isNull(), "eof")
        .when((F.col("_nhard") >= 1) & (F.col("_n") >= 2), "para")
        .when((F.col("_nhard") >= 1) | fits, "line")
        .otherwise("wrap")
    )
    return m.withColumn("separator", kind).drop("_blank", "_hard", "_one", "_run", "_nhard", "_n", "_next", "_margin")


def logical_lines(lines: DataFrame, soft: Column, key: str = "doc", order: str = "li", text: str = "text") -> DataFrame:
    """(key, line, first, text): soft-wrapped lines joined, continuation indents stripped, one
    space between unless the part before ends in a space or hyphen; soft blanks are dropped and
    hard blanks stand alone."""
    w = _doc(key, order)
    m = lines.withColumns({"_soft": soft, "_blank": _blank(text)}).filter(~(F.col("_soft") & F.col("_blank")))
    starts = F.coalesce(~F.lag("_soft").over(w), F.lit(True)) | F.col("_blank")
    m = m.withColumn("line", F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    grouped = m.groupBy(key, "line").agg(F.min(order).alias("first"), parts.alias("_p"))
    joined = F.aggregate(
        F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))),
        F.element_at("_p", 1)["t"],
        lambda a, p: F.concat(a, F.when((a == "") | a.rlike("[ -]$"), "").otherwise(" "), F.ltrim(p["t"])),
    )
    return grouped.select(key, "line", "first", joined.alias("text"))


def paragraph_units(lines: DataFrame, key: str = "doc", order: str = "li", text: str = "text", indent: int = 5, short: int = 45, margin: int = 65, nowrap: Column | None = None) -> DataFrame:
    """unit number of each line: an indented line starts one, flush lines continue. Neighbouring
    units of one short line each, and a line within the margin boxed in by them, are one unit if
    together they are verse. Neighbouring lines set by hand (``nowrap``) are one unit."""
    w = _doc(key, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    no = F.lit(False)
    m = lines.withColumn("_by_hand", no if nowrap is None else F.coalesce(nowrap, no))
    was = F.coalesce(F.lag("_by_hand").over(w), no)
    fresh = (indent_of(F.col(text)) >= indent) | F.coalesce(_blank(F.lag(text).over(w)), F.lit(True)) | (was != F.col("_by_hand"))
    m = m.withColumn("_start", fresh & ~(was & F.col("_by_hand")))
    m = m.withColumn("_unit", F.sum(F.col("_start").cast("long")).over(upto))
    m = m.withColumn("_single", (F.count("*").over(Window.partitionBy(key, "_unit")) == 1) & ~_blank(text) & ~F.col("_by_hand"))
    size = F.length(F.rtrim(F.col(text)))
    m = m.withColumn("_short", F.col("_single") & (size <= short))
    boxed = F.coalesce(F.lag("_short").over(w), no) & F.coalesce(F.lead("_short").over(w), no) & F.col("_single") & (size < margin)
    m = m.withColumn("_candidate", F.col("_short") | boxed)
    m = m.withColumn("_after", F.coalesce(F.lag("_candidate").over(w), no))
    m = m.withColumn("_run", F.sum((F.col("_candidate") & ~F.col("_after")).cast("long")).over(upto))
    verse = verse_test(m.filter("_candidate"), [key, "_run"], text).filter("is_verse").select(key, "_run", F.lit(True).alias("_verse"))
    m = m.join(verse, [key, "_run"], "left").withColumn("short_run", F.col("_candidate") & F.coalesce("_verse", no))
    m = m.withColumn("unit", F.sum((F.col("_start") & ~(F.col("short_run") & F.col("_after"))).cast("long")).over(upto))
    return m.select(*lines.columns, "unit", "short_run")


def wrap_margin(lines: DataFrame, key: str = "doc", text: str = "text", floor: int = 65, soft: Column | None = None) -> DataFrame:
    """Element int(0.9 n) of the sorted lengths of a document's soft-wrapped lines (an order
    statistic), blank ones aside, at least ``floor``; ``soft`` says which lines are (by default those
    whose ``terminator`` is soft).

    Counted by length first, so a document's lines are never gathered."""
    wrapped = (F.col("terminator") == "soft") if soft is None else soft
    size = F.when(wrapped & ~_blank(text), F.length(F.rtrim(F.col(text))))
    counts = lines.select(key, size.alias("_len")).groupBy(key, "_len").agg(F.count("_len").alias("_n"))
    by = Window.partitionBy(key)
    upto = F.sum("_n").over(by.orderBy("_len").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(by)})
    at = F.min(F.when(F.col("_upto") > F.expr("_all * 9 div 10"), F.col("_len")))
    return ranked.groupBy(key).agg(F.greatest(F.lit(floor), F.coalesce(at, F.lit(0))).cast("long").alias("margin"))


def modal_value(df: DataFrame, value: Column, key: str = "doc", order: str = "li") -> DataFrame:
    """(key, value, count): the commonest value, the first seen on ties."""
    counts = df.select(key, order, value.alias("value")).filter("value is not null").groupBy(key, "value").agg(F.count("*").alias("count"), F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("count").desc(), "_first"))
    return counts.withColumn("_rank", rank).filter("_rank = 1").select(key, "value", "count")


def terminal_fraction(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Share of lettered lines that end a sentence; 1.0 where no line has a letter."""
    scored = F.when(F.col(text).rlike(r"\p{L}"), ends_terminal(F.col(text)).cast("double"))
    return lines.groupBy(*keys).agg(F.coalesce(F.avg(scored), F.lit(1.0)).alias("fraction"))


#: Block, shade, card and box-drawing signs that make a row graphic.
GRAPHIC = "█░▒▓▀▄▌▐■♦♥♠♣☻☼≡─│┌┐└┘├┤┬┴┼═║╔╗╚╝╠╣╦╩╬╒╓╕╖╘╙╛╜╞╟╡╢╤╥╧╨╪╫"


def verse_test(lines: DataFrame, keys: list[str], text: str = "text", shifted: Column | None = None) -> DataFrame:
    """is_verse per run of lines, blank ones aside: two lines or more of which half hold a graphic sign
    and no letter; or two lettered lines or more, of these under a third self-quoted and under 0.9
    ending a sentence, and either over half of all lines in a shifted style or under 0.8 of the
    lettered ones ending a sentence."""
    t = F.col(text)
    full, letters = ~_blank(t), t.rlike(r"\p{L}")
    quoted = F.ltrim(t).rlike(rf"^[{OPENING}].*[{CLOSING}]")
    c = lines.groupBy(*keys).agg(
        F.count_if(full).alias("_n"),
        F.count_if(full & ~letters & t.rlike(f"[{GRAPHIC}]")).alias("_graphic"),
        F.count_if(full & letters).alias("_scored"),
        F.count_if(full & letters & quoted).alias("_quoted"),
        F.count_if(full & letters & ends_terminal(t)).alias("_terminal"),
        F.count_if(full & (F.lit(False) if shifted is None else shifted)).alias("_shifted"),
    )
    graphic = (F.col("_n") >= 2) & (2 * F.col("_graphic") >= F.col("_n"))
    shape = (2 * F.col("_shifted") > F.col("_n")) | (10 * F.col("_terminal") < 8 * F.col("_scored"))
    prose = (F.col("_scored") >= 2) & (3 * F.col("_quoted") < F.col("_scored")) & (10 * F.col("_terminal") < 9 * F.col("_scored")) & shape
    return c.select(*keys, (graphic | prose).alias("is_verse"))


def discover_bullets(lines: DataFrame, key: str = "doc", order: str = "li", text: str = "text") -> DataFrame:
    """Rows (key, li, col, glyph) of list items: a glyph and one space at a column where the same
    glyph stands at least twice in the document, and not again in its own text."""
    rule = r"^( *)([^\sA-Za-z0-9]) (\S.*)$"
    m = lines.filter(F.col(text).rlike(rule)).select(key, order, F.length(F.regexp_extract(text, rule, 1)).alias("col"), F.regexp_extract(text, rule, 2).alias("glyph"), F.regexp_extract(text, rule, 3).alias("_rest"))
    m = m.filter(~F.contains("_rest", F.col("glyph")))
    many = F.count("*").over(Window.partitionBy(key, "col", "glyph"))
    return m.withColumn("_many", many).filter("_many >= 2").drop("_many", "_rest")


LABEL = r"^( *)(\S[^:]*):  +\S"


def discover_label_lists(lines: DataFrame, key: str = "doc", order: str = "li", text: str = "text") -> DataFrame:
    """Rows ``word:  text`` of label lists: at least two rows and two labels at one column between
    blank lines."""
    w = _doc(key, order).rowsBetween(Window.unboundedPreceding, 0)
    m = lines.withColumn("island", F.sum(_blank(text).cast("long")).over(w)).filter(F.col(text).rlike(LABEL))
    m = m.select(key, order, "island", F.length(F.regexp_extract(text, LABEL, 1)).alias("col"), F.regexp_extract(text, LABEL, 2).alias("label"))
    own = Window.partitionBy(key, "island", "col")
    m = m.withColumns({"_n": F.count("*").over(own), "_lo": F.min("label").over(own), "_hi": F.max("label").over(own)})
    return m.filter("_n >= 2 and _lo <> _hi").drop("_n", "_lo", "_hi")


def coalesce_runs(spans: DataFrame, style: str, order: str, keys: list[str], text: str = "text", mark: Column | None = None) -> DataFrame:
    """Neighbouring spans of one style become one (keys, first, style, text); a reference mark
    never joins."""
    w = Window.partitionBy(*keys).orderBy(order)
    is_mark = F.lit(False) if mark is None else mark
    m = spans.withColumn("_mark", is_mark)
    new = ~F.col(style).eqNullSafe(F.lag(style).over(w)) | F.lag("_mark").over(w).isNull() | F.col("_mark") | F.lag("_mark").over(w)
    m = m.withColumn("_run", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    out = m.groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.first(style).alias(style), parts.alias("_p"))
    return out.select(*keys, "first", style, F.array_join(F.transform("_p", lambda p: p["t"]), "").alias("text"))


def toggle_events(spans: DataFrame, key: str, order: list[str], styles: str = "styles", bits: int = 8) -> DataFrame:
    """(key, order, seq, bit, on): style bits switched off, then on, between neighbouring spans."""
    before = F.coalesce(F.lag(styles).over(Window.partitionBy(key).orderBy(*order)), F.lit(0))
    m = spans.withColumn("_was", before)
    off, on = F.col("_was").bitwiseAND(F.bitwise_not(styles)), F.col(styles).bitwiseAND(F.bitwise_not("_was"))
    each = [F.struct(F.lit(k + n * bits).alias("seq"), F.lit(1 << k).alias("bit"), F.lit(bool(n)).alias("on"), c.bitwiseAND(F.lit(1 << k)).alias("has")) for n, c in enumerate((off, on)) for k in range(bits)]
    x = m.select(key, *order, F.explode(F.filter(F.array(*each), lambda e: e["has"] != 0)).alias("e"))
    return x.select(key, *order, F.col("e.seq").alias("seq"), F.col("e.bit").alias("bit"), F.col("e.on").alias("on"))


def nesting_level(rows: DataFrame, key: str = "doc", order: str = "li", col: str = "col", island: str = "island", item: Column | None = None) -> DataFrame:
    """level and container (its column, null outside any) of each row.

    A stack of columns: every row closes what is deeper than itself; a list item (``item``, all rows by
    default) opens a container unless the innermost one has its column; other rows take the level
    they stand in. An island between hard breaks is folded in order; the stack is the only state."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).cast("int").alias("c"), (F.lit(True) if item is None else F.coalesce(item, F.lit(False))).alias("i"))))
    grouped = rows.groupBy(key, island).agg(parts.alias("_rows"))
    kind = "struct<o:bigint,level:bigint,container:int>"

    def step(stack: Column, r: Column) -> tuple[Column, Column]:
        kept = F.filter(stack, lambda x: x <= r["c"])
        opens = r["i"] & ~F.coalesce(F.try_element_at(kept, F.lit(-1)) == r["c"], F.lit(False))
        now = F.when(opens, F.concat(kept, F.array(r["c"]))).otherwise(kept)
        row = F.struct(r["o"].cast("bigint").alias("o"), F.size(now).cast("bigint").alias("level"), F.try_element_at(now, F.lit(-1)).alias("container"))
        return now, F.array(row)

    levels = fold_out(F.col("_rows"), F.array().cast("array<int>"), step, kind)
    out = grouped.select(key, island, F.explode(levels).alias("r"))
    return out.select(key, island, F.col("r.o").alias(order), F.col("r.level").alias("level"), F.col("r.container").alias("container"))


def centred_rows(lines: DataFrame, width: Column, tagged: Column | None = None, body_indent: Column | None = None, continues: Column | None = None, text: str = "text") -> DataFrame:
    """Lines tagged as centred, or set by spaces: lead within 1.5 of the ideal, slack of four and
    more, not the body's indent, fewer than two wide gaps inside, not one that ``continues`` a list."""
    t = F.col(text)
    size, lead = F.length(F.trim(t)), indent_of(t)
    slack = width - size
    spaces = (lead > 0) & (F.abs(lead - slack / 2) <= 1.5) & (slack >= 4) & (F.regexp_count(F.trim(t), F.lit(" {3,}")) < 2)
    if body_indent is not None:
        spaces &= ~lead.eqNullSafe(body_indent)
    if continues is not None:
        spaces &= ~F.coalesce(continues, F.lit(False))
    return lines.withColumn("centred", (spaces | tagged) if tagged is not None else spaces)


def front_matter(blocks: DataFrame, reset: Column, hit: Column, key: str = "doc", order: str = "bi") -> DataFrame:
    """True from the start, a heading or a page break until the first block at the usual indent."""
    w = _doc(key, order)
    m = blocks.withColumns({"_part": F.sum(reset.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_hit": hit})
    seen = F.max("_hit").over(Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("front", ~F.coalesce(seen, F.lit(False))).drop("_part", "_hit")


def quote_groups(blocks: DataFrame, quote: Column, indent: str, key: str = "doc", order: str = "bi") -> DataFrame:
    """Consecutive quote blocks take the first one's indent."""
    w = _doc(key, order)
    m = blocks.withColumn("_q", quote)
    m = m.withColumn("_run", F.sum((F.col("_q") & ~F.coalesce(F.lag("_q").over(w), F.lit(False))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(indent).over(Window.partitionBy(key, "_run", "_q").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return m.withColumn("group_indent", F.when(F.col("_q"), first)).drop("_q", "_run")


def spacing_blanks(lines: DataFrame, declared: Column | None = None, key: str = "doc", block: str = "block", order: str = "li", text: str = "text") -> DataFrame:
    """(key, block, mode): double spacing is confirmed by a block whose full lines alternate with
    single blanks (two such blanks, one where spacing is declared) and carried to later blocks
    until one that does not fit."""
    w = Window.partitionBy(key, block).orderBy(order)
    b = _blank(text)
    m = lines.withColumns({"_b": b, "_clash": (b & F.coalesce(F.lag(b).over(w), F.lit(False))) | (~b & F.coalesce(~F.lag(b).over(w), F.lit(False)))})
    need = F.lit(2) if declared is None else F.when(F.max(declared.cast("int")) == 1, 1).otherwise(2)
    flags = m.groupBy(key, block).agg((F.count_if("_b") >= need).alias("_enough"), (F.count_if("_clash") == 0).alias("_fits"))
    doc = _doc(key, block)
    flags = flags.withColumn("_part", F.sum((~F.col("_fits")).cast("long")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    sure = F.max(F.col("_enough") & F.col("_fits")).over(Window.partitionBy(key, "_part").orderBy(block).rowsBetween(Window.unboundedPreceding, 0))
    return flags.select(key, block, (F.col("_fits") & sure).alias("double_spaced"))


#: Fixed value: how a scene heading begins.
SLUGLINE = r"^[ \t]*[0-9]{0,4}[ \t]*(?:&[^&\r\n]{1,24}&[ \t]*)?(?:INT\.|EXT\.|INT\.?/EXT\.|I/E\.)[ \t]"


def scene_regions(blocks: DataFrame, anchor: Column, stop: Column, key: str = "doc", order: str = "bi", most: int = 40) -> DataFrame:
    """Blocks of scenes: an anchor and up to ``most`` blocks after it, cut at the next anchor or at
    a block that stops it. Adds ``scene``, the position of the anchor."""
    w = _doc(key, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    m = blocks.withColumns({"_n": F.row_number().over(w), "_anchor": anchor, "_stop": stop & ~anchor})
    m = m.withColumns(
        {
            "scene": F.last(F.when(F.col("_anchor"), F.col(order)), ignorenulls=True).over(upto),
            "_at": F.last(F.when(F.col("_anchor"), F.col("_n")), ignorenulls=True).over(upto),
            "_end": F.last(F.when(F.col("_stop"), F.col("_n")), ignorenulls=True).over(upto),
        }
    )
    inside = (F.col("_n") - F.col("_at") <= most) & (F.col("_end").isNull() | (F.col("_end") < F.col("_at")))
    return m.filter(inside).drop("_n", "_anchor", "_stop", "_at", "_end")


def flow_items(parts: dict[str, DataFrame], notes: DataFrame, key: str = "doc", order: list[str] = ("bi", "li")) -> DataFrame:
    """One typed stream per document: all parts (key, order, ref) in a shared order, kinds of one
    place in the order given, then a separator and each referenced note once by first reference."""
    stream = None
    for rank, (kind, part) in enumerate(parts.items()):
        rows = part.select(key, *order, F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.col("ref").cast("string").alias("ref"))
        stream = rows if stream is None else stream.unionByName(rows)
    first = notes.groupBy(key, "ref").agg(F.min(F.struct(*order)).alias("_p"))
    last = (1 << 62) - 1
    tail = first.select(key, F.lit(last).cast("long").alias(order[0]), F.row_number().over(Window.partitionBy(key).orderBy("_p", "ref")).cast("long").alias(order[1]), F.lit(100).alias("rank"), F.lit("note").alias("kind"), F.col("ref").cast("string").alias("ref"))
    rule = notes.select(key).distinct().select(key, F.lit(last).cast("long").alias(order[0]), F.lit(0).cast("long").alias(order[1]), F.lit(99).alias("rank"), F.lit("separator").alias("kind"), F.lit("").alias("ref"))
    both = stream.unionByName(tail).unionByName(rule)
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order, "rank", "ref")).cast("long")
    return both.withColumn("seq", at).select(key, "seq", "kind", "ref")
