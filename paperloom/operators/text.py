"""Column jobs over the text of a whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Style names and their bits.
STYLE = {"bold": 1, "italic": 2, "underline": 4, "sup": 8, "sub": 16, "strike": 32, "fnref": 64, "alt_font": 128}


def single_sentence_space(text: Column, mode: str = "auto", facsimile: bool = False) -> Column:
    """After a full stop, question or exclamation mark two and more spaces become one."""
    if mode == "keep" or (mode == "auto" and facsimile):
        return text
    return F.regexp_replace(text, r"([.?!]) {2,}", "$1 ")


def single_sentence_spans(spans: DataFrame, keys: list[str], order: str = "li", text: str = "text", mode: str = "auto", facsimile: bool = False) -> DataFrame:
    """The same over the spans of a line (``keys``): a stop that ends one span and spaces that open the
    next, or fill spans between, count as neighbours.

    What a span must know of those before it is the last sign that is no space, and whether a space has
    followed it; a window carries both over span borders."""
    if mode == "keep" or (mode == "auto" and facsimile):
        return spans
    t = F.coalesce(F.col(text), F.lit(""))
    w = Window.partitionBy(*keys).orderBy(order)
    filled = F.sum((t != "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.regexp_extract(t, r"([^ ]) *$", 1)
    m = spans.withColumns({"_filled": filled, "_empty": (t == "").cast("int")})
    seen = F.struct(last.isin(".", "?", "!").alias("stop"), F.endswith(t, F.lit(" ")).alias("spaced"), F.col("_filled").alias("filled"))
    m = m.withColumn("_seen", F.last(F.when(last != "", seen), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    after_stop = F.coalesce(F.col("_seen.stop"), F.lit(False))
    spaced = F.col("_seen.spaced") | (F.col("_filled") - 1 + F.col("_empty") > F.col("_seen.filled"))
    lead = F.regexp_extract(t, "^ *", 0)
    opening = F.when(~after_stop | (lead == ""), lead).when(spaced, "").otherwise(" ")
    rest = F.regexp_replace(F.substr(t, F.length(lead) + 1), r"([.?!]) {2,}", "$1 ")
    return m.withColumn(text, F.when(F.col(text).isNotNull(), F.concat(opening, rest))).select(*spans.columns)


def command_marks(lines: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(marks, text lines): lines ``.`` + up to three letters become (name, arg) rows; comments
    (``..`` and ``.ig``) are neither."""
    t = F.col(text_col)
    comment = t.startswith("..") | F.lower(t).rlike(r"^\.ig(\W|$)")
    rule = r"^\.([A-Za-z][A-Za-z#]{0,2})\s*(.*)$"
    marks = lines.filter(t.rlike(rule) & ~comment).withColumns({"name": F.upper(F.regexp_extract(t, rule, 1)), "arg": F.trim(F.regexp_extract(t, rule, 2))}).drop(text_col)
    return marks, lines.filter(~t.rlike(rule) & ~comment)


def substitute(spans: DataFrame, decisions: DataFrame, key: str = "doc", text_col: str = "text", skip: Column | None = None) -> DataFrame:
    """Character rules where the document's decision and the span's face (``skip``) allow them:
    euro, typography (quotes and dashes), corners."""
    flags = decisions.groupBy(key).agg(*(F.coalesce(F.bool_or(F.when(F.col("name") == r, F.col("enabled"))), F.lit(False)).alias(f"_{r}") for r in ("euro", "typography", "corners")))
    out = spans.join(flags, key, "left")
    free, t = F.lit(True) if skip is None else ~skip, F.col(text_col)
    t = F.when(F.col("_euro") & free, F.translate(t, "¤", "€")).otherwise(t)
    t = F.when(F.col("_typography") & free, F.regexp_replace(F.regexp_replace(t, "--", "—"), "'", "’")).otherwise(t)
    t = F.when(F.col("_corners") & free, F.translate(t, "┌┐└┘", "╭╮╰╯")).otherwise(t)
    return out.withColumn(text_col, t).drop("_euro", "_typography", "_corners")


def effective_styles(spans: DataFrame, blocks: DataFrame, keys: list[str], heading_bold: bool = True) -> DataFrame:
    """Span bits with the block's style bits, bold for headings, and the style's colour as the
    default unless it is 0. Blocks have style_attrs, style_colour and heading."""
    both = spans.join(blocks.select(*keys, "style_attrs", "style_colour", "heading"), keys, "left")
    styles = F.col("styles").bitwiseOR(F.coalesce("style_attrs", F.lit(0)))
    if heading_bold:
        styles = F.when(F.coalesce("heading", F.lit(0)) != 0, styles.bitwiseOR(F.lit(STYLE["bold"]))).otherwise(styles)
    return both.withColumns({"styles": styles, "colour": F.coalesce("colour", F.nullif("style_colour", F.lit(0)))}).drop("style_attrs", "style_colour", "heading")


#: Fixed value: the page number variable, with or without a modifier.
PAGE_VARIABLE = "&#(?:/[A-Za-z]+)?&"


def bind_page_variables(lines: DataFrame, pages: DataFrame | None, keys: list[str], text_col: str = "text") -> DataFrame:
    """``&#&`` and its forms with a modifier (``&#/r&``) become the number of the page their line is
    on, and are dropped without pages."""
    if pages is None:
        return lines.withColumn(text_col, F.regexp_replace(text_col, PAGE_VARIABLE, ""))
    both = lines.join(pages.select(*keys, "number"), keys, "left")
    return both.withColumn(text_col, F.regexp_replace(F.col(text_col), F.lit(PAGE_VARIABLE), F.coalesce(F.col("number").cast("string"), F.lit("")))).drop("number")


#: Tags that start a new line of text.
BLOCK_TAGS = ("address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")
#: Entities and their text, in the order in which they are replaced.
ENTITIES = (("&nbsp;", " "), ("&#x27;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def html_to_text(html: Column) -> Column:
    """Text of the body: block tags become line feeds, other tags go, entities are unescaped."""
    body = F.regexp_extract(html, r"(?s)<body>(.*)</body>", 1)
    body = F.regexp_replace(body, rf"(?is)</?(?:{'|'.join(BLOCK_TAGS)})(?![A-Za-z0-9])[^>]*>", "\n")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", "")
    for entity, plain in ENTITIES:
        body = F.replace(body, F.lit(entity), F.lit(plain))
    return body


def note_filter(notes: DataFrame, kinds: list[str], facsimile: bool = False, kind_col: str = "kind") -> DataFrame:
    """Notes of the wanted kinds; comments are never part of facsimile output."""
    out = notes.filter(F.col(kind_col).isin(*kinds))
    return out.filter(F.col(kind_col) != "comment") if facsimile else out
