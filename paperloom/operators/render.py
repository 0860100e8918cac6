"""Rendering of whole corpora: text, Markdown and HTML, one row per document."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.fold import fold_out
from paperloom.functions.ranks import rank_in
from paperloom.functions.registry import Options
from paperloom.operators.text import STYLE, note_filter, single_sentence_space
from paperloom.operators.timeline import state_at

#: Markdown marks and HTML tags of style bits, outermost first.
MARKS = (("bold", "**", "strong"), ("italic", "*", "em"), ("underline", "__", "u"), ("strike", "~~", "s"), ("sup", "^", "sup"), ("sub", "~", "sub"))

FORMATS = ("text", "markdown", "html", "rtf", "pdf")
#: Options and the formats that they mean something for.
ALLOWED = {"headers": ("rtf", "pdf"), "page_numbers": ("rtf", "pdf"), "inline_styling": ("rtf", "html"), "pictures": ("markdown", "html", "rtf", "pdf"), "toc": FORMATS, "sentence_spacing": FORMATS}


def ordered_join(order: str, text: Column, separator: str) -> Column:
    """The group's texts in order, as one string."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(parts, lambda p: p["t"]), separator)


def render_text(paragraphs: DataFrame, mode: str = "modern", notes: DataFrame | None = None, key: str = "doc", order: str = "line", text: str = "text", page_break: Column | None = None) -> DataFrame:
    """(key, body): paragraphs parted by a blank line (modern), or lines with form feeds before
    page breaks (facsimile); notes follow by kind under a heading."""
    t = F.col(text) if page_break is None else F.when(page_break, F.concat(F.lit("\f"), F.col(text))).otherwise(F.col(text))
    body = paragraphs.groupBy(key).agg(ordered_join(order, t, "\n" if mode == "facsimile" else "\n\n").alias("body"))
    if notes is None:
        return body
    kinds = notes.groupBy(key, "kind").agg(ordered_join("idx", F.concat(F.lit("["), "label", F.lit("] "), text), "\n").alias("_n"))
    section = F.concat(F.initcap("kind"), F.lit("s\n"), F.col("_n"))
    tail = kinds.groupBy(key).agg(ordered_join("kind", section, "\n\n").alias("_tail"))
    return body.join(tail, key, "left").withColumn("body", F.concat_ws("\n\n", "body", "_tail")).drop("_tail")


def _escaped(text: Column, markup: str) -> Column:
    if markup == "markdown":
        return F.regexp_replace(text, r"([\\`*_#\[\]<&])", r"\\$1")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def styled(text: Column, styles: Column, markup: str) -> Column:
    """Escaped text between the marks or tags of its style bits; blank text has none."""
    out = _escaped(text, markup)
    for name, mark, tag in reversed(MARKS):
        a, b = (mark, mark) if markup == "markdown" else (f"<{tag}>", f"</{tag}>")
        out = F.when(styles.bitwiseAND(F.lit(STYLE[name])) != 0, F.concat(F.lit(a), out, F.lit(b))).otherwise(out)
    return F.when(F.trim(text) == "", text).otherwise(out)


def _with_marks(spans: DataFrame, markup: str) -> Column:
    """A span's rendering; a reference mark is its note's key or anchor."""
    mark = F.trim("text")
    note = F.concat(F.lit("[^"), mark, F.lit("]")) if markup == "markdown" else F.concat(F.lit('<sup><a href="#fn-'), mark, F.lit('">'), mark, F.lit("</a></sup>"))
    return F.when(F.col("styles").bitwiseAND(F.lit(STYLE["fnref"])) != 0, note).otherwise(styled(F.col("text"), F.col("styles"), markup))


def _with_notes(body: DataFrame, notes: DataFrame | None, markup: str, key: str) -> DataFrame:
    """``body`` with the texts of its notes (key, idx, label, text) after it, under their keys."""
    if notes is None:
        return body
    text = _escaped(F.col("text"), markup)
    one = F.concat(F.lit("[^"), "label", F.lit("]: "), text) if markup == "markdown" else F.concat(F.lit('<p id="fn-'), "label", F.lit('">'), "label", F.lit(". "), text, F.lit("</p>"))
    tail = notes.groupBy(key).agg(ordered_join("idx", one, "\n").alias("_tail"))
    return body.join(tail, key, "left").withColumn("body", F.concat_ws("\n\n" if markup == "markdown" else "\n", "body", "_tail")).drop("_tail")


#: Markdown's delimiters and tags of style bits, outermost first where runs are equally long.
MARKDOWN_MARKS = (("sub", "<sub>", "</sub>"), ("sup", "<sup>", "</sup>"), ("underline", "<u>", "</u>"), ("strike", "~~", "~~"), ("italic", "*", "*"), ("bold", "**", "**"))


def nested_marks(spans: DataFrame, keys: list[str], order: str = "li", text: str = "text", styles: str = "styles", marks: tuple[tuple[str, str, str], ...] = MARKDOWN_MARKS) -> DataFrame:
    """(keys, marked): the spans of each line, escaped, with marks around runs of a style.

    A run goes on from span to span without being closed and opened again. Of runs that begin together
    the longest is outermost; where runs cross, the inner one is cut. Marks stand inside the white
    space at a run's ends; a span of white space only, and a reference mark (``[^key]``), end all runs.
    """
    bits = [(STYLE[name], a, b) for name, a, b in marks]
    w = Window.partitionBy(*keys).orderBy(order)
    t, is_ref = F.col(text), F.col(styles).bitwiseAND(F.lit(STYLE["fnref"])) != 0
    ref = F.concat(F.lit("[^"), F.trim(t), F.lit("]"))
    m = spans.withColumns({
        "_i": F.row_number().over(w),
        "_s": F.when(is_ref | (F.trim(t) == ""), 0).otherwise(F.col(styles)),
        "_lead": F.when(is_ref, "").otherwise(F.regexp_extract(t, r"^\s*", 0)),
        "_trail": F.when(is_ref | (F.regexp_extract(t, r"^\s*", 0) == t), "").otherwise(F.regexp_extract(t, r"\s*$", 0)),
    })
    core = F.substr(t, F.length("_lead") + 1, F.length(t) - F.length("_lead") - F.length("_trail"))
    m = m.withColumn("_core", F.when(is_ref, ref).otherwise(_escaped(core, "markdown")))
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    # a style's place: how far its run goes (further first), then the fixed order
    runs = [F.when(F.col("_s").bitwiseAND(F.lit(bit)) != 0, F.struct((F.col("_i") - F.coalesce(F.min(F.when(F.col("_s").bitwiseAND(F.lit(bit)) == 0, F.col("_i"))).over(ahead), F.lit(1 << 30))).alias("r"), F.lit(n).alias("n"), F.lit(bit).alias("bit"))) for n, (bit, _, _) in enumerate(bits)]
    m = m.withColumn("_opens", F.transform(F.array_sort(F.array_compact(F.array(*runs))), lambda x: x["bit"]))
    one = F.struct("_i", "_s", "_opens", "_lead", "_core", "_trail")
    lines = m.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_x"))

    def said(which: Column, place: int) -> Column:
        out = F.lit("")
        for entry in bits:
            out = F.when(which == entry[0], entry[place]).otherwise(out)
        return out

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        stack = state["stack"]
        gone = F.array_position(F.transform(stack, lambda b: x["_s"].bitwiseAND(b) == 0), True)
        kept = F.when(gone > 0, F.slice(stack, F.lit(1), (gone - 1).cast("int"))).otherwise(stack)
        closed = F.when(gone > 0, F.reverse(F.slice(stack, gone.cast("int"), F.size(stack)))).otherwise(F.array().cast("array<int>"))
        opened = F.filter(x["_opens"], lambda b: ~F.array_contains(kept, b))
        piece = F.concat(F.array_join(F.transform(closed, lambda b: said(b, 2)), ""), state["trail"], x["_lead"], F.array_join(F.transform(opened, lambda b: said(b, 1)), ""), x["_core"])
        return F.struct(F.concat(kept, opened).alias("stack"), x["_trail"].alias("trail")), F.array(piece)

    start = F.struct(F.array().cast("array<int>").alias("stack"), F.lit("").alias("trail"))
    end = lambda state: F.array(F.concat(F.array_join(F.transform(F.reverse(state["stack"]), lambda b: said(b, 2)), ""), state["trail"]))
    return lines.select(*keys, F.array_join(fold_out(F.col("_x"), start, step, "string", end), "").alias("marked"))


def hard_break_paragraphs(lines: Column) -> Column:
    """Lines as Markdown paragraphs: neighbours are joined by a hard break, a blank line parts."""
    start = F.struct(F.lit("").alias("said"), F.lit(False).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        joint = F.when(acc["said"] == "", "").when(acc["open"], "  \n").otherwise("\n\n")
        blank = F.trim(line) == ""
        return F.struct(F.when(blank, acc["said"]).otherwise(F.concat(acc["said"], joint, line)).alias("said"), (~blank).alias("open"))

    return F.aggregate(lines, start, step, lambda acc: acc["said"])


def render_markdown(spans: DataFrame, blocks: DataFrame, notes: DataFrame | None = None, key: str = "doc", block: str = "bi", order: str = "li", line: str | None = None) -> DataFrame:
    """(key, body): headings by level, quotes prefixed, lines of verse with hard breaks, other lines of
    a block flowing together, runs of styles in nested marks, notes under their keys.

    ``blocks`` has heading, quote, and perhaps verse and page_break (a rule; not at the end). Spans of
    one ``line`` are a line; without it a block is one line."""
    keys = [key, block] if line is None else [key, block, line]
    marked = nested_marks(spans, keys, order)
    at = F.lit(0) if line is None else F.col(line)
    texts = marked.groupBy(key, block).agg(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("o"), F.trim("marked").alias("t")))), lambda x: x["t"]).alias("_t"))
    have = {c: F.col(c) if c in blocks.columns else F.lit(False) for c in ("verse", "page_break")}
    both = blocks.select(key, block, "heading", "quote", *(c.alias(n) for n, c in have.items())).join(texts, [key, block], "full_outer")
    full = F.filter(F.col("_t"), lambda t: t != "")
    lines = F.when((F.size("_t") > 1) & ~F.coalesce("verse", F.lit(False)), F.array(F.array_join(full, " "))).otherwise(F.col("_t"))
    last = F.last(F.when(F.size(full) > 0, F.col(block)), ignorenulls=True).over(Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    body = (
        F.when(F.coalesce("page_break", F.lit(False)), F.when(F.col(block) < last, "---"))
        .when(F.coalesce(F.size(full), F.lit(0)) <= 0, F.lit(None))
        .when(F.col("heading") > 0, F.concat(F.repeat(F.lit("#"), F.col("heading").cast("int")), F.lit(" "), F.array_join(full, "  \n")))
        .when(F.col("quote"), F.array_join(F.transform(lines, lambda t: F.when(t == "", ">").otherwise(F.concat(F.lit("> "), t))), "\n"))
        .otherwise(hard_break_paragraphs(lines))
    )
    pages = both.withColumn("_b", body).groupBy(key).agg(ordered_join(block, F.col("_b"), "\n\n").alias("body"))
    return _with_notes(pages, notes, "markdown", key)


def render_html(spans: DataFrame, blocks: DataFrame, notes: DataFrame | None = None, key: str = "doc", block: str = "bi", order: str = "li") -> DataFrame:
    """(key, body): paragraphs, headings and nested lists, notes under their anchors. A row opens as
    many lists as its level is deeper than the row's before; an item stays open while deeper rows follow."""
    inline = spans.groupBy(key, block).agg(ordered_join(order, _with_marks(spans, "html"), "").alias("_t"))
    w = Window.partitionBy(key).orderBy(block)
    m = inline.join(blocks.select(key, block, "heading", "level"), [key, block], "left")
    m = m.withColumns({"_up": F.coalesce(F.lag("level").over(w), F.lit(0)), "_down": F.coalesce(F.lead("level").over(w), F.lit(0))})
    level, up, down = F.col("level"), F.col("_up"), F.col("_down")
    opened = F.when(level > up, F.concat(F.lit("<ul>"), F.repeat(F.lit("<li><ul>"), (level - up - 1).cast("int")))).otherwise("")
    closed = F.when(down > level, "").when(down == level, "</li>").otherwise(F.concat(F.repeat(F.lit("</li></ul>"), (level - down).cast("int")), F.when(down > 0, "</li>").otherwise("")))
    tag = F.when(F.col("heading") > 0, F.concat(F.lit("h"), F.col("heading").cast("string"))).otherwise("p")
    row = F.when(level > 0, F.concat(opened, F.lit("<li>"), F.col("_t"), closed)).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), F.col("_t"), F.lit("</"), tag, F.lit(">")))
    body = _with_notes(m.groupBy(key).agg(ordered_join(block, row, "\n").alias("body")), notes, "html", key)
    return body.withColumn("body", F.concat(F.lit("<html><body>\n"), "body", F.lit("\n</body></html>")))


def export_plan(docs: DataFrame, formats: list[str], options: list[str], key: str = "doc") -> DataFrame:
    """(key, format, options): every document in every wanted format with the options that the
    format allows."""
    unknown = set(formats) - set(FORMATS) | set(options) - set(ALLOWED)
    if unknown:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    each = F.array(*(F.struct(F.lit(f).alias("format"), F.lit(",".join(o for o in sorted(options) if f in ALLOWED[o])).alias("options")) for f in formats))
    return docs.select(key, F.explode(each).alias("x")).select(key, F.col("x.format").alias("format"), F.col("x.options").alias("options"))


def _free_numbers(batches: Iterator[pa.RecordBatch], separator: str, first: int) -> Iterator[pa.RecordBatch]:
    """(box, o, at) of rows that come family by family (``box``), names that exist (turn 0) before stems."""
    now, taken, following = None, set(), {}
    for batch in batches:
        out, keep = [], []
        for n, (box, turn, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("box", "turn", "k")))):
            if box != now:
                now, taken, following = box, set(), {}
            if not turn:
                taken.add(k)
                continue
            at = following.get(k, 1)
            while (name := k if at == 1 else f"{k}{separator}{at + first - 2}") in taken:
                at += 1
            taken.add(name)
            following[k] = at + 1
            out.append(at)
            keep.append(n)
        chosen = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("box").take(chosen), batch.column("o").take(chosen), pa.array(out, pa.int64())], ["box", "o", "at"])


def unique_names(names: DataFrame, stem: str, extension: str, order: str, existing: DataFrame | None = None, keys: list[str] = (), separator: str = " ", first: int = 2, fold_case: bool = True) -> DataFrame:
    """name: ``A.md``, ``A 2.md`` ... Rows in ``order`` (unique) take the first name of their stem
    that neither exists nor was taken by an earlier row of the same ``keys``.

    ``existing`` has the ``keys`` and ``stem``, names without extension; upper and lower case are
    the same name unless ``fold_case`` is off. A stem's n-th row takes its n-th free number; its rank
    is counted by ranges of ``order`` (a number), so a stem of very many rows is dealt to many tasks.
    Only stems that look like another stem's numbered name (``A 2`` beside ``A``) are named in order
    together: such a family streams through one task, which keeps its taken names and, for each
    stem, the next number that may be free."""
    digits = "[1-9][0-9]*" if first == 1 else "(?:[2-9]|[1-9][0-9]+)"
    numbered = f"^(.*){separator}({digits})$"
    folded = (lambda c: F.lower(c)) if fold_case else (lambda c: c)
    root = F.regexp_replace(folded(F.col(stem)), f"(?:{separator}{digits})+$", "")
    m = names.withColumns({"_k": folded(F.col(stem)), "_root": root})
    family = Window.partitionBy(*keys, "_root")
    m = m.withColumn("_mixed", F.min("_k").over(family) != F.max("_k").over(family))
    plain = rank_in(m.filter(~F.col("_mixed")), [*keys, "_k"], order, "_n").withColumn("_n", F.col("_n").cast("long"))
    mixed = m.filter("_mixed")
    if existing is None:
        plain, held = plain.withColumn("_taken", F.lit(0)), None
    else:
        e = existing.select(*keys, folded(F.col("stem")).alias("_e")).distinct()
        after = F.regexp_extract("_e", numbered, 2)
        whole = F.struct(F.col("_e").alias("k"), F.lit(1).cast("long").alias("i"))
        one = F.when(after != "", F.struct(F.regexp_extract("_e", numbered, 1).alias("k"), (after.cast("long") - first + 2).alias("i")))
        e = e.select(*keys, "_e", F.explode(F.array_compact(F.array(whole, one))).alias("x")).select(*keys, "_e", F.col("x.k").alias("_k"), F.col("x.i").alias("_i"))
        rank = F.row_number().over(Window.partitionBy(*keys, "_k").orderBy("_i"))
        gaps = e.withColumn("_r", rank).groupBy(*keys, "_k", (F.col("_i") - F.col("_r")).alias("_n")).agg(F.max("_r").alias("_r"))
        pack = F.concat_ws("\x00", *keys, "_k")
        plain = state_at(plain.withColumn("_g", pack), gaps.withColumn("_g", pack), "_g", "_n", "_r", "_taken", strict=True)
        held = e.select(*keys, F.regexp_replace("_e", f"(?:{separator}{digits})+$", "").alias("_root"), "_e").distinct()
    plain = plain.withColumn("_at", F.col("_n") + F.coalesce("_taken", F.lit(0)))

    def called(k: Column, i: Column) -> Column:
        return F.concat(k, F.when(i > 1, F.concat(F.lit(separator), (i + (first - 2)).cast("string"))).otherwise(""))

    box = F.struct(*(F.col(k) for k in keys), F.col("_root")).alias("box")
    kind = dict(names.dtypes)[order]
    rows = mixed.select(box, F.lit(1).alias("turn"), F.col(order).alias("o"), F.col("_k").alias("k"))
    if held is not None:
        families = mixed.select(box).distinct()
        rows = rows.unionByName(held.select(box, F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("o"), F.col("_e").alias("k")).join(families, "box", "left_semi"))
    rows = rows.repartition("box").sortWithinPartitions("box", "turn", "o")
    named = rows.mapInArrow(partial(_free_numbers, separator=separator, first=first), f"box {rows.schema['box'].dataType.simpleString()}, o {kind}, at long")
    given = named.select(*(F.col(f"box.{k}").alias(k) for k in keys), F.col("o").alias(order), F.col("at").alias("_at"))
    out = plain.select(*names.columns, "_at").unionByName(mixed.join(given, [*keys, order]).select(*names.columns, "_at"))
    return out.withColumn("name", F.concat(called(F.col(stem), F.col("_at")), F.lit(extension))).drop("_at")


def picture_names(refs: DataFrame, key: str = "doc", order: str = "idx", raw_path: str = "raw_path") -> DataFrame:
    """name of each picture of a document: its tag's own file name as ``.png``, ``-1``, ``-2`` ...
    where tags share one, ``image`` and its number where there is none."""
    base = F.regexp_replace(F.regexp_extract(raw_path, r"([^/\\\\]*)$", 1), r"\.[^.]*$", "")
    stem = F.when(base == "", F.concat(F.lit("image"), F.col(order).cast("string"))).otherwise(base)
    named = unique_names(refs.withColumn("_stem", stem), "_stem", ".png", order, None, [key], "-", 1, False)
    return named.drop("_stem")


def render_with(lines: DataFrame, notes: DataFrame, options: Options, key: str = "doc", order: str = "line", text: str = "text") -> DataFrame:
    """(key, body): text as the options ask for it: kinds of notes, sentence spacing, a contents
    section of the headings (lines with ``heading``) before the text, page numbers of page breaks."""
    out = lines.withColumn(text, single_sentence_space(F.col(text), options.spacing))
    if options.page_numbers == "on":
        out = out.withColumn(text, F.when(F.col("page").isNotNull(), F.concat_ws("\n", text, F.concat(F.lit("- "), F.col("page").cast("string"), F.lit(" -")))).otherwise(F.col(text)))
    kept = note_filter(notes, list(options.notes))
    body = render_text(out, "modern", kept, key, order, text)
    if options.toc:
        heads = lines.filter("heading > 0").withColumn("_t", F.concat(F.repeat(F.lit("  "), (F.col("heading") - 1).cast("int")), F.col(text)))
        toc = heads.groupBy(key).agg(ordered_join(order, F.col("_t"), "\n").alias("_toc"))
        body = body.join(toc, key, "left").withColumn("body", F.concat_ws("\n\n", F.concat(F.lit("Contents\n"), "_toc"), "body")).drop("_toc")
    return body
