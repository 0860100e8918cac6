"""What each file is, from counts over its bytes (one character per byte)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.codepage import bytes_as_chars
from paperloom.sources.archive import record_fields


def byte_profile(df: DataFrame, chars: str = "chars") -> DataFrame:
    """size, soft_returns (8D 0A), hard_returns (0D 0A), high_bit, text_pct (capped at 100).

    A byte is text-like if printable ASCII or tab, line feed, return; the two frame bytes of a
    wrapped character ``1B x 1C`` count as text too."""
    c = F.col(chars)

    def count(rule: str) -> Column:
        return F.regexp_count(c, F.lit(rule)).cast("long")

    size = F.length(c).cast("long")
    text = count(r"[\x20-\x7E\t\n\r]") + 2 * count(r"(?s)\x1B.\x1C")
    pct = F.when(size > 0, F.least(F.lit(100).cast("long"), F.expr("try_divide(100 * _text, _size)").cast("long"))).otherwise(F.lit(100).cast("long"))
    out = df.withColumns({"_text": text, "_size": size})
    return out.withColumns({"size": size, "soft_returns": count(r"\x8D\n"), "hard_returns": count(r"\r\n"), "high_bit": count(r"[\x80-\xFF]"), "text_pct": pct}).drop("_text", "_size")


def true_end(chars: Column, pad: str = "\x1a", least: int = 8) -> Column:
    """Characters before the padding: the start of a run of at least ``least`` pad bytes, else the
    first pad byte that is not wrapped as ``1B x 1C``, else the length."""
    run = F.regexp_instr(chars, F.lit(f"{pad}{{{least},}}"))
    bare = F.regexp_instr(chars, F.lit(f"(?<!\x1b){pad}|(?<=\x1b){pad}(?!\x1c)"))
    return F.when(run > 0, run - 1).when(bare > 0, bare - 1).otherwise(F.length(chars)).cast("long")


def framed_block_count(df: DataFrame, chars: str = "chars", key: str = "doc", mark: str = "\x1d") -> DataFrame:
    """(key, blocks): frames ``1D lo hi ... lo hi 1D`` whose jump lengths agree, outermost only.

    Only positions of the opening byte are exploded."""
    blanked = F.regexp_replace(F.col(chars), "(?s)\x1b.\x1c", "   ")
    pieces = df.select(key, blanked.alias("_c"), F.posexplode(F.split(blanked, mark, -1)).alias("_i", "_piece"))
    before = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    marks = pieces.withColumn("_at", F.coalesce(F.sum(F.length("_piece") + 1).over(before), F.lit(0)).cast("int")).filter("_i > 0").withColumn("_at", F.col("_at") - 1)

    def byte(at: Column) -> Column:
        return F.ascii(F.substr("_c", at + 1, F.lit(1)))

    jump = byte(F.col("_at") + 1) + 256 * byte(F.col("_at") + 2)
    marks = marks.withColumn("_jump", jump).withColumn("_end", F.col("_at") + F.col("_jump") + 2)
    again = byte(F.col("_end") - 2) + 256 * byte(F.col("_end") - 1)
    framed = marks.filter((F.col("_jump") >= 3) & (again == F.col("_jump")) & (F.substr("_c", F.col("_end") + 1, F.lit(1)) == mark))
    upto = F.max("_end").over(Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    outer = framed.withColumn("_upto", upto).filter("_upto is null or _at > _upto")
    return df.select(key).distinct().join(outer.groupBy(key).agg(F.count("*").alias("blocks")), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(0).cast("long")))


def classify(df: DataFrame) -> DataFrame:
    """variant and reason from a profile with: declared, framed, triples and the counts above."""
    c = {n: F.col(n) for n in ("size", "soft_returns", "hard_returns", "high_bit", "text_pct", "framed", "triples")}

    def dense(n: Column) -> Column:
        return (n >= 3) & (n * 16384 >= c["size"])

    soft_ok, high = dense(c["soft_returns"]), (c["high_bit"] * 20 >= c["size"]) & (c["text_pct"] >= 70)
    rules = [
        (F.col("declared"), "ws5+", "declared header"),
        (c["text_pct"] < 40, "binary", "under 40% text"),
        ((c["framed"] > 0) | (dense(c["triples"])), "ws5+", "framed blocks or wrapped characters"),
        ((soft_ok | high) & soft_ok & (c["high_bit"] * 4 < c["soft_returns"]), "ws5+", "soft returns without high bits"),
        (soft_ok | high, "ws4", "soft returns or high bits"),
        ((c["text_pct"] >= 90) & (c["hard_returns"] >= 2), "printstream", "text with hard returns"),
        (c["text_pct"] >= 90, "text", "plain text"),
    ]
    variant, reason = F.lit("binary"), F.lit("none of the rules")
    for test, name, why in reversed(rules):
        variant, reason = F.when(test, name).otherwise(variant), F.when(test, why).otherwise(reason)
    return df.withColumns({"variant": variant, "reason": reason})


def convertible(files: DataFrame, n: int = 65536, key: str = "path", content: str = "content") -> DataFrame:
    """variant, reason and ``is_convertible`` of files by their first n bytes: what reads as binary, or
    could not be read, is skipped. Files with one ``key`` must be one file."""
    chars = bytes_as_chars(F.substring(F.coalesce(content, F.lit(b"")), 1, n))
    seen = files.select(F.col(key).alias("doc"), chars.alias("chars"))
    facts = seen.withColumns({"triples": F.regexp_count("chars", F.lit(r"(?s)\x1B.\x1C")).cast("long"), "declared": F.startswith("chars", F.lit("\x1d}"))})
    profile = byte_profile(facts).drop("chars").join(framed_block_count(seen).withColumnRenamed("blocks", "framed"), "doc")
    kinds = classify(profile).select(F.col("doc").alias(key), "variant", "reason")
    return files.join(kinds, key).withColumn("is_convertible", (F.col("variant") != "binary") & F.col(content).isNotNull())


def detect_record_lists(lines: DataFrame, key: str = "doc", text_col: str = "text", framed: DataFrame | None = None) -> DataFrame:
    """(key, records, fields, is_list): at least two records, every non-blank line of one field
    count of two or more, half of the fields quoted, and no command lines."""
    t = F.col(text_col)
    full = lines.filter(F.trim(t) != "")
    fields = F.size(record_fields(t)).cast("long")
    quoted = F.regexp_count(F.concat(F.lit(","), t), F.lit(',"[^"]*"(?=,|$)')).cast("long")
    parses = t.rlike(r'^(?:"[^"]*"|[^,"]*)(?:,(?:"[^"]*"|[^,"]*))*$')
    marked = full.select(key, fields.alias("_f"), quoted.alias("_q"), parses.alias("_p"), t.rlike(r"^\.[A-Za-z]").alias("_cmd"))
    out = marked.groupBy(key).agg(F.count("*").alias("records"), F.min("_f").alias("fields"), F.max("_f").alias("_most"), F.sum("_f").alias("_all"), F.sum("_q").alias("_quoted"), F.bool_and("_p").alias("_ok"), F.bool_or("_cmd").alias("_any"))
    test = (F.col("records") >= 2) & F.col("_ok") & (F.col("fields") == F.col("_most")) & (F.col("fields") >= 2) & (2 * F.col("_quoted") >= F.col("_all")) & ~F.col("_any")
    out = out.withColumn("is_list", test)
    if framed is not None:
        out = out.join(framed, key, "left").withColumn("is_list", F.col("is_list") & (F.coalesce("blocks", F.lit(0)) == 0))
    return out.select(key, "records", "fields", "is_list")


def damage_signature(df: DataFrame, chars: str = "chars", stray: str = "\x14") -> DataFrame:
    """Line feeds without a return: count and first offset; and whether a stray byte is there."""
    bare = r"(?<!\r)\n"
    first = F.regexp_instr(F.col(chars), F.lit(bare))
    return df.withColumns({"bare_feeds": F.regexp_count(chars, F.lit(bare)).cast("long"), "first_bare": F.when(first > 0, first - 1).cast("long"), "has_stray": F.col(chars).contains(stray)})


#: Fixed values: (variant, high bit ends words, has notes, column unit, default number column).
ERAS = (("ws4", True, False, "font", 28), ("ws5+", False, True, "tenth-inch", 28), ("printstream", False, False, "tenth-inch", 28), ("text", False, False, "tenth-inch", 28), ("binary", False, False, "tenth-inch", 28))


def era_flags(df: DataFrame, variant: str = "variant") -> DataFrame:
    """Constants of each variant; an unknown one gets the ws5+ row."""
    dim = df.sparkSession.createDataFrame(list(ERAS), "_v string, high_bit_wrap boolean, has_notes boolean, column_unit string, number_column int")
    known = F.when(F.col(variant).isin(*(e[0] for e in ERAS)), F.col(variant)).otherwise("ws5+")
    return df.withColumn("_v", known).join(F.broadcast(dim), "_v", "left").drop("_v")  # five rows


def forced_variant(docs: DataFrame, overrides: DataFrame, key: str = "doc") -> DataFrame:
    """A caller's variant beats detection; ``variant_source`` says which. Of several for one document
    the first by name holds."""
    forced = overrides.groupBy(key).agg(F.min("variant").alias("_forced"))
    out = docs.join(forced, key, "left").withColumn("variant_source", F.when(F.col("_forced").isNotNull(), "manual").otherwise("detected"))
    return out.withColumn("variant", F.coalesce("_forced", "variant")).drop("_forced")


def archive_summary(df: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """Counts (and other sums) by group, with a total over all rows at the end of each level."""
    aggregates = [F.count("*").alias("documents"), *(F.sum(c).alias(n) for n, c in sums.items())]
    return df.rollup(*by).agg(*aggregates)


def name_filter(files: DataFrame, names: DataFrame, name_col: str = "name", wanted: str = "wanted") -> tuple[DataFrame, DataFrame]:
    """(files whose name or stem is wanted, wanted names that match nothing), letter case aside."""
    stem = F.regexp_replace(F.lower(name_col), r"\.[^.]*$", "")
    keys = files.select(name_col, F.explode(F.array_distinct(F.array(F.lower(name_col), stem))).alias("_k"))
    asked = names.select(wanted, F.lower(wanted).alias("_k")).distinct()
    hit = keys.join(asked, "_k").select(name_col).distinct()
    return files.join(hit, name_col, "left_semi"), asked.join(keys, "_k", "left_anti").select(wanted)
