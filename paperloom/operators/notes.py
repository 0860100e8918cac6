"""Notes: labels, references and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Note kinds in output order and the letters of their keys.
KINDS = {"footnote": "", "endnote": "e", "annotation": "a", "comment": "c"}


def _rank(key: str, kind: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(key, kind).orderBy(order)).cast("long")


def note_labels(notes: DataFrame, start: int = 1, key: str = "doc", kind: str = "kind", order: str = "idx") -> DataFrame:
    """label: the tag, else the note's own number or its rank in its kind plus ``start`` - 1."""
    number = F.coalesce(F.col("number").cast("long"), _rank(key, kind, order) + (start - 1))
    return notes.withColumn("label", F.coalesce("tag", number.cast("string")))


def collision_renumber(notes: DataFrame, key: str = "doc", kind: str = "kind", order: str = "idx", label: str = "label") -> DataFrame:
    """Untagged footnotes, and untagged endnotes, are numbered through where two of them have one
    label; tags are marks without a number, and other kinds keep their labels."""
    member = F.col("tag").isNull() & F.col(kind).isin("footnote", "endnote")
    m = notes.withColumn("_member", member)
    own = Window.partitionBy(key, kind, "_member")
    m = m.withColumn("_alike", F.count("*").over(Window.partitionBy(key, kind, "_member", label)))
    m = m.withColumns({"_clash": F.max("_alike").over(own) > 1, "_rank": F.row_number().over(own.orderBy(order)).cast("string")})
    return m.withColumn(label, F.when(F.col("_member") & F.col("_clash"), F.col("_rank")).otherwise(F.col(label))).drop("_member", "_alike", "_clash", "_rank")


def prefixed_labels(notes: DataFrame, key: str = "doc", kind: str = "kind", order: str = "idx") -> DataFrame:
    """e1, a1, c1 by kind and rank; footnotes have plain numbers."""
    letter = F.lit("")
    for name, mark in KINDS.items():
        letter = F.when(F.col(kind) == name, mark).otherwise(letter)
    return notes.withColumn("label", F.concat(letter, _rank(key, kind, order).cast("string")))


#: Parts of roman numbers, largest first.
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(number: Column) -> Column:
    """Lower-case roman form of a whole number above 0; anything else as it is."""
    left, out = number.cast("long"), F.lit("")
    for value, mark in _ROMAN:
        out = F.concat(out, F.repeat(F.lit(mark), F.floor(left / value).cast("int")))
        left = left % value
    return F.when(number.cast("long") > 0, out).otherwise(number.cast("string"))


def roman_labels(notes: DataFrame, of: str = "endnote", kind: str = "kind", label: str = "label") -> DataFrame:
    """Labels of one kind in roman form where they are numbers."""
    number = F.col(label).rlike("^[0-9]+$") & (F.col(kind) == of)
    return notes.withColumn(label, F.when(number, roman(F.col(label))).otherwise(F.col(label)))


def note_order(notes: DataFrame, key: str = "doc", kind: str = "kind", order: str = "idx") -> DataFrame:
    """seq by kind order, then document order."""
    place = F.lit(len(KINDS))
    for n, name in enumerate(KINDS):
        place = F.when(F.col(kind) == name, n).otherwise(place)
    return notes.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(place, order)).cast("long"))


def note_for_reference(references: DataFrame, notes: DataFrame, excluded: tuple[str, ...] = (), key: str = "doc", kind: str = "kind", order: str = "idx") -> DataFrame:
    """The k-th reference shows the k-th note: status shown, dropped (kind excluded) or invalid."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(order))
    both = references.withColumn("_k", k).join(notes.select(key, k.alias("_k"), F.col(kind).alias("note_kind")), [key, "_k"], "left")
    status = F.when(F.col("note_kind").isNull(), "invalid").when(F.col("note_kind").isin(*excluded), "dropped").otherwise("shown")
    return both.withColumn("status", status).drop("_k")


def comment_beside_reference(items: DataFrame, comments: DataFrame, key: str = "doc", order: str = "idx", text: str = "text") -> DataFrame:
    """Items with each comment right after its reference, as (key, seq, kind, text)."""
    a = items.select(key, F.col(order).alias("_o"), F.lit(0).alias("_s"), F.lit("item").alias("kind"), F.col(text).alias("text"))
    b = comments.select(key, F.col(order).alias("_o"), F.lit(1).alias("_s"), F.lit("comment").alias("kind"), F.col(text).alias("text"))
    seq = F.row_number().over(Window.partitionBy(key).orderBy("_o", "_s", "text")).cast("long")
    return a.unionByName(b).select(key, seq.alias("seq"), "kind", "text")
