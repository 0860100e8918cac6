"""Comparison of runs and gates over export tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.fold import let
from paperloom.operators.structure import verse_test
from paperloom.operators.text import STYLE


def drift(left: DataFrame, right: DataFrame, keys: list[str] = ("doc", "format", "mode")) -> DataFrame:
    """(keys, state): missing, new, source changed, changed or same. Both sides have sha256, bytes
    and source_sha256, and pages are compared where both have them."""
    keys = list(keys)
    facts = ["sha256", "bytes", *(c for c in ("pages",) if c in left.columns and c in right.columns)]
    a, b = (x.select(*keys, F.struct(*facts).alias(n), F.col("source_sha256").alias(f"{n}_source")) for x, n in ((left, "a"), (right, "b")))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(~F.col("a_source").eqNullSafe(F.col("b_source")), "source changed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def coverage(recorded: DataFrame, present: DataFrame, refused: DataFrame, key: str = "doc") -> DataFrame:
    """(key, state): unrecorded, gone, or refused as known."""
    k, p, r = (x.select(key).distinct() for x in (recorded, present, refused))
    new = p.exceptAll(k)
    return new.exceptAll(r).withColumn("state", F.lit("unrecorded")).unionByName(k.exceptAll(p).withColumn("state", F.lit("gone"))).unionByName(new.intersect(r).withColumn("state", F.lit("refused")))


def corpus_union(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """All parts with their name; keys met in more than one part are marked."""
    out = None
    for name, part in parts.items():
        rows = part.withColumn("part", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    own = Window.partitionBy(key)
    return out.withColumn("clash", F.min("part").over(own) != F.max("part").over(own))


def format_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    return names.toDF("name").union(aliases.toDF("name")).distinct().orderBy("name")


def style_set_algebra(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a), F.col(b)
    return df.withColumns({"both": x.bitwiseOR(y), "shared": x.bitwiseAND(y), "only_a": x.bitwiseAND(F.bitwise_not(y))})


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    clean = F.regexp_replace(text, r"(?m)^\s*(?:[•*-]|\d+\.?)\s+|\f", " ")
    words = F.filter(F.split(F.trim(clean), r"\s+"), lambda w: w != "")
    return df.select(key, F.posexplode(words).alias("pos", "word"))


def word_parity(a: DataFrame, b: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(key, pos, left, right): the first word where two renderings differ, page marks, bullets
    and spacing aside."""
    one, two = _words(a, key, text).withColumnRenamed("word", "left"), _words(b, key, text).withColumnRenamed("word", "right")
    off = one.join(two, [key, "pos"], "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))
    first = off.groupBy(key).agg(F.min(F.struct("pos", "left", "right")).alias("x"))
    return first.select(key, F.col("x.pos").cast("long").alias("pos"), F.col("x.left").alias("left"), F.col("x.right").alias("right"))


def balanced_markup(df: DataFrame, allowed: list[str], key: str = "doc", text: str = "text") -> DataFrame:
    """(key, depth_ok, words_ok): braces (escaped ones aside) never close more than was opened and
    end level; control words are in the list."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"\\[\\{}]|\\[a-z]+|[{}]"), F.lit(0))
    rows = df.select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    m = rows.withColumns({"_step": step, "_depth": depth, "_word": F.col("token").rlike(r"^\\[a-z]+$") & ~F.coalesce(F.substring("token", 2, 99).isin(*allowed), F.lit(True))})
    return m.groupBy(key).agg(((F.min("_depth") >= 0) & (F.sum("_step") == 0)).alias("depth_ok"), (~F.coalesce(F.bool_or("_word"), F.lit(False))).alias("words_ok"))


#: Elements that never have an end, and references that XML knows (with nbsp).
VOID = ("br", "hr", "img", "meta", "link", "input")
_QUOTED = r"""[^<>"']*(?:(?:"[^"]*"|'[^']*')[^<>"']*)*"""
MARKUP_TOKEN = rf"<!--(?s:.*?)-->|</?[A-Za-z]{_QUOTED}>|<|&[A-Za-z0-9#]*;?"
_GOOD_TAG = r"""^<[A-Za-z][A-Za-z0-9:._-]*(?:\s+[A-Za-z_:][A-Za-z0-9:._-]*\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*/?>$"""
_GOOD_END = r"^</[A-Za-z][A-Za-z0-9:._-]*\s*>$"
_GOOD_REFERENCE = r"^&(?:amp|lt|gt|quot|apos|nbsp|#[0-9]+|#x[0-9A-Fa-f]+);$"


def well_formed_tags(df: DataFrame, void: tuple[str, ...] = VOID, key: str = "doc", text: str = "text") -> DataFrame:
    """(key, place, tag, problem): why the body of a page is no well-formed XML; no row if it is.

    The body lies between the first ``<body>`` and the last ``</body>``; without them that is the one
    problem. Tags are matched like brackets: the depth is a running sum over opens and closes, and a
    close belongs to the last open of its depth. ``place`` numbers the tags and references from 1.
    Problems: no body, never opened, never closed, other name (the close of another element, at the
    close), bad tag (attributes without quotes or value), stray sign (a bare ``<``), bad reference.
    """
    first, last = F.locate("<body>", F.col("_t")), F.length("_t") - F.position(F.lit("</body>"[::-1]), F.reverse("_t")) - 5
    whole = (first > 0) & (last > first) & F.contains("_t", F.lit("</body>"))
    bodies = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_body", F.when(whole, F.substr("_t", first + 6, last - first - 6)))
    none = bodies.filter("_body is null").select(key, F.lit(0).cast("long").alias("place"), F.lit("").alias("tag"), F.lit("no body").alias("problem"))
    tokens = F.filter(F.regexp_extract_all("_body", F.lit(MARKUP_TOKEN), F.lit(0)), lambda t: ~F.startswith(t, F.lit("<!--")))
    t = bodies.filter("_body is not null").select(key, F.posexplode(tokens).alias("_p", "_k"))
    name = F.regexp_extract("_k", r"^</?([A-Za-z][^\s/>]*)", 1)
    t = t.withColumns({"place": (F.col("_p") + 1).cast("long"), "tag": name})
    is_tag, is_end = F.col("tag") != "", F.startswith("_k", F.lit("</"))
    alone = ~is_end & (F.endswith("_k", F.lit("/>")) | F.lower("tag").isin(*void))
    t = t.withColumn("_step", F.when(~is_tag | alone, 0).when(is_end, -1).otherwise(1))
    depth = F.sum("_step").over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("_level", F.when(F.col("_step") != 0, depth + (F.col("_step") < 0).cast("int")))
    same = Window.partitionBy(key, "_level").orderBy("place")
    t = t.withColumns({"_open": F.lag(F.struct("_step", "tag")).over(same), "_next": F.lead("_step").over(same)})
    unmatched = (
        F.when((F.col("_step") == -1) & ~F.coalesce(F.col("_open._step") == 1, F.lit(False)), "never opened")
        .when((F.col("_step") == -1) & (F.col("_open.tag") != F.col("tag")), "other name")
        .when((F.col("_step") == 1) & ~F.coalesce(F.col("_next") == -1, F.lit(False)), "never closed")
    )
    form = (
        F.when(is_tag & ~is_end & ~F.col("_k").rlike(_GOOD_TAG), "bad tag")
        .when(is_end & ~F.col("_k").rlike(_GOOD_END), "bad tag")
        .when(F.col("_k") == "<", "stray sign")
        .when(F.startswith("_k", F.lit("&")) & ~F.col("_k").rlike(_GOOD_REFERENCE), "bad reference")
    )
    found = t.select(key, "place", "tag", F.explode(F.array_compact(F.array(unmatched, form))).alias("problem"))
    return none.unionByName(found)


def lint_lines(lines: DataFrame, key: str = "doc", order: str = "li", text: str = "text") -> DataFrame:
    """(key, place, rule) of Markdown lines: an odd number of backslashes at the end, an indent of
    four and more."""
    t = F.col(text)
    rules = {"trailing backslash": t.rlike(r"(?<!\\)(?:\\\\)*\\$"), "deep indent": F.startswith(t, F.lit("    "))}
    each = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    return lines.select(key, F.col(order).cast("long").alias("place"), F.explode(each).alias("rule"))


def lint_spans(spans: DataFrame, keys: list[str], order: str, styles: str = "styles") -> DataFrame:
    """(first key, place, rule): neighbouring spans of a line with the same style, reference marks aside."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = (F.col(styles) == F.lag(styles).over(w)) & (F.col(styles).bitwiseAND(F.lit(STYLE["fnref"])) == 0)
    return spans.withColumn("_same", same).filter("_same").select(keys[0], F.col(order).cast("long").alias("place"), F.lit("equal neighbours").alias("rule"))


def lint_units(lines: DataFrame, unit: str = "unit", key: str = "doc", order: str = "li", text: str = "text") -> DataFrame:
    """(key, place, rule): lines inside a paragraph unit, not its first, that open with five spaces
    though the unit is no verse."""
    m = lines.withColumn("_nth", F.row_number().over(Window.partitionBy(key, unit).orderBy(order)))
    verse = verse_test(lines, [key, unit], text)
    glued = m.filter((F.col("_nth") > 1) & F.startswith(text, F.lit("     "))).join(verse.filter("is_verse"), [key, unit], "left_anti")
    return glued.select(key, F.col(order).cast("long").alias("place"), F.lit("glued paragraphs").alias("rule"))


def lint_pages(bodies: DataFrame, key: str = "doc", html: str = "body") -> DataFrame:
    """(key, place, rule): a quote that ends where another begins; place counts them from 1."""
    met = F.regexp_extract_all(F.col(html), F.lit(r"</blockquote>\s*<blockquote>"), F.lit(0))
    return bodies.select(key, F.posexplode(met).alias("place", "_m")).select(key, (F.col("place") + 1).cast("long").alias("place"), F.lit("adjacent quotes").alias("rule"))


#: Style names and what shows them in Markdown and HTML.
MARKERS = {
    "html": {"bold": ("<strong", "font-weight:bold"), "italic": ("<em", "font-style:italic"), "underline": ("<u>",), "strike": ("<s>", "text-decoration:line-through"), "sub": ("<sub", "vertical-align:sub"), "sup": ("<sup", "vertical-align:super")},
    "markdown": {"bold": ("**",), "italic": ("*",), "strike": ("~~",), "underline": ("<u>",), "sub": ("<sub>",), "sup": ("<sup>",)},
}


def lint_markers(spans: DataFrame, bodies: DataFrame, markup: str, key: str = "doc", styles: str = "styles", body: str = "body") -> DataFrame:
    """(key, place, rule): styles that a document's spans have and its rendering nowhere shows;
    place is the style's bit."""
    plain = spans.filter(F.col(styles).bitwiseAND(F.lit(STYLE["fnref"])) == 0)
    present = plain.groupBy(key).agg(F.bit_or(styles).alias("_p")).join(bodies.select(key, F.col(body).alias("_b")), key)
    each = []
    for name, marks in MARKERS[markup].items():
        shown = reduce(lambda a, b: a | b, (F.contains("_b", F.lit(m)) for m in marks))
        each.append(F.when((F.col("_p").bitwiseAND(F.lit(STYLE[name])) != 0) & ~shown, F.lit(STYLE[name]).cast("long")))
    return present.select(key, F.explode(F.array_compact(F.array(*each))).alias("place"), F.lit("missing attribute").alias("rule"))


#: Families of private matter.
PATTERNS = (("home path", r"/(?:Users|home)/[A-Za-z0-9._-]+"), ("private address", r"\b(?:10\.\d{1,3}|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.\d{1,3}\.\d{1,3}\b"), ("mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"))


def sensitive_scan(df: DataFrame, allow: tuple[str, ...] = ("example.com", "/Users/you"), patterns=PATTERNS, key: str = "doc", text: str = "text", control: str | None = None) -> DataFrame:
    """(key, family, hit): matches outside the allow list, in the text and in base64 payloads of it.

    ``control`` is a text that every scan must hit: its rows come back under a null key, and a scan
    that misses it stops the job."""
    base = df.select(key, F.col(text).alias("_t"), F.lit(False).alias("_control"))
    payload = F.regexp_extract_all("_t", F.lit(r"base64,([A-Za-z0-9+/]{8,}={0,2})"), F.lit(1))
    decoded = F.array_join(F.transform(payload, lambda p: F.coalesce(F.try_to_binary(p, F.lit("base64")).cast("string"), F.lit(""))), "\n")
    base = base.withColumn("_t", F.concat_ws("\n", "_t", decoded))
    if control is not None:
        spark = df.sparkSession
        kind = df.schema[key].dataType.simpleString()
        base = base.unionByName(spark.createDataFrame([(None, control, True)], f"{key} {kind}, _t string, _control boolean"))
    each = F.flatten(F.array(*(F.transform(F.regexp_extract_all("_t", F.lit(rule), F.lit(0)), lambda h: F.struct(F.lit(family).alias("family"), h.alias("hit"))) for family, rule in patterns)))
    for word in allow:
        each = F.filter(each, lambda h: ~F.contains(h["hit"], F.lit(word)))  # noqa: B023
    each = let(each, lambda e: F.when(F.col("_control") & (F.size(e) == 0), F.raise_error(F.lit("the control text has no hit"))).otherwise(e))
    return base.select(key, F.explode(each).alias("x")).select(key, "x.family", "x.hit")


def named_divergences(found: DataFrame, allowed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(differences without a named cause, counts by cause)."""
    return found.join(allowed.select(*keys), keys, "left_anti"), found.join(allowed, keys).groupBy("cause").agg(F.count("*").alias("n"))
