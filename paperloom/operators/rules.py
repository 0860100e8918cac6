"""Rules, settings, styles and fonts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_decisions(docs: DataFrame, rules: list[dict], enable: tuple[str, ...] = (), disable: tuple[str, ...] = (), mode: str = "auto", retired: dict[str, str] | None = None, key: str = "doc") -> DataFrame:
    """(key, name, reason, enabled): one row for each document and rule whose detector gives a
    reason. ``rules`` has name, auto (bool) and detector (a string column, null: not applicable).

    Disabled names win over enabled ones, then the rule's class in automatic mode decides.
    Retired names are mapped first; an unknown name is an error."""
    mapped = [{(retired or {}).get(n, n) for n in names} for names in (enable, disable)]
    unknown = (mapped[0] | mapped[1]) - {r["name"] for r in rules}
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}; known: {', '.join(r['name'] for r in rules)}")

    def decided(r: dict) -> bool:
        return r["name"] not in mapped[1] and (r["name"] in mapped[0] or (mode == "auto" and r["auto"]))

    each = F.array(*(F.struct(F.lit(r["name"]).alias("name"), r["detector"].alias("reason"), F.lit(decided(r)).alias("enabled")) for r in rules))
    out = docs.select(key, F.explode(each).alias("r"))
    return out.select(key, F.col("r.name").alias("name"), F.col("r.reason").alias("reason"), F.col("r.enabled").alias("enabled")).filter("reason is not null")


def overlay_overrides(defaults: DataFrame, overrides: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per-document values over defaults; an empty override removes the setting."""
    both = defaults.withColumnRenamed(value, "_d").join(overrides.withColumnRenamed(value, "_o"), keys, "full_outer")
    return both.withColumn(value, F.coalesce("_o", "_d")).filter(F.col(value) != "").drop("_d", "_o")


def effective_settings(docs: DataFrame, preset: dict, factory: dict, derived: dict[str, Callable[[dict[str, Column]], Column]] | None = None, key: str = "doc") -> DataFrame:
    """(key, name, value, source): document value, else preset, else the factory's; the source is
    file, machine-default or default. ``derived`` settings are computed anew from the others."""
    each = [
        F.struct(
            F.lit(n).alias("name"),
            F.coalesce(F.col(n).cast("string"), F.lit(preset.get(n)).cast("string"), F.lit(factory[n]).cast("string")).alias("value"),
            F.when(F.col(n).isNotNull(), "file").otherwise("machine-default" if n in preset else "default").alias("source"),
        )
        for n in factory
    ]
    values = {n: F.coalesce(F.col(n).cast("long"), F.lit(preset.get(n)).cast("long"), F.lit(factory[n]).cast("long")) for n in factory} if derived else {}
    for name, of in (derived or {}).items():
        each.append(F.struct(F.lit(name).alias("name"), of(values).cast("string").alias("value"), F.lit("derived").alias("source")))
    return docs.select(key, F.explode(F.array(*each)).alias("s")).select(key, "s.*")


def style_lookup(blocks: DataFrame, library: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with style_name and attrs of their slot; an unknown slot stays null."""
    return blocks.join(library.select(*keys, "style_name", "attrs"), keys, "left")


#: Families and what may stand in for them, in order.
FONT_ALTERNATES = {
    "avant garde": ["Century Gothic", "ITC Avant Garde Gothic"],
    "bookman": ["Bookman Old Style"],
    "cntry schlbk": ["Century Schoolbook", "New Century Schoolbook"],
    "newcntschlbk": ["Century Schoolbook", "New Century Schoolbook"],
    "new century schoolbook": ["Century Schoolbook"],
    "century": ["Century Schoolbook"],
    "helv": ["Helvetica", "Arial"],
    "helvetica": ["Arial", "Helvetica Neue"],
    "helv cond.": ["Arial Narrow", "Helvetica Neue Condensed"],
    "helv narrow": ["Arial Narrow", "Helvetica Neue Condensed"],
    "helvetica narrow": ["Arial Narrow", "Helvetica Neue Condensed"],
    "palatino": ["Palatino", "Palatino Linotype", "Book Antiqua"],
    "tms rmn": ["Times New Roman", "Times"],
    "times": ["Times New Roman"],
    "zapfchancery": ["Apple Chancery", "Monotype Corsiva"],
    "zapf chancery": ["Apple Chancery", "Monotype Corsiva"],
    "zapfdingbats": ["Zapf Dingbats"],
    "zapf dingbats": ["Zapf Dingbats"],
    "symbol": ["Symbol"],
    "courier": ["Courier New"],
    "pica": ["Courier New"],
    "elite": ["Courier New"],
    "lineprinter": ["Courier New"],
    "letter gothic": ["Letter Gothic", "Courier New"],
    "gothic": ["Letter Gothic", "Courier New"],
    "prestige": ["Prestige Elite", "Courier New"],
    "univers": ["Helvetica Neue", "Arial"],
    "antique olive": ["Optima", "Verdana"],
    "cg times": ["Times New Roman"],
    "cg triumvirate": ["Arial", "Helvetica"],
    "triumvirate": ["Arial", "Helvetica"],
    "garamond": ["Garamond", "EB Garamond"],
    "optima": ["Optima", "Candara"],
    "clarendon": ["Clarendon", "Rockwell"],
    "aachen": ["Rockwell", "Courier New"],
    "bodoni": ["Bodoni 72", "Bodoni MT", "Didot"],
    "broadway": ["Broadway"],
    "univ. roman": ["University Roman", "Georgia"],
    "ps sansser qual": ["Arial", "Helvetica"],
    "american classic": ["Century Schoolbook", "Georgia"],
    "rockwell": ["Rockwell", "Courier New"],
    "coronet": ["Coronet", "Apple Chancery", "Monotype Corsiva"],
    "albertus": ["Herculanum", "Colonna MT", "Rockwell"],
    "marigold": ["Apple Chancery", "Monotype Corsiva", "Coronet"],
}


#: Generic faces by style.
GENERIC = {"sans": "sans-serif", "serif": "serif", "script": "cursive", "display": "fantasy"}


def font_resolution(fonts: DataFrame, alternates: DataFrame, family: Column, fixed: Column, style: Column | None = None) -> DataFrame:
    """choices: the family, its alternates (family, names) and the generic face, each once.
    Fixed-pitch faces end at monospace, others at the face of their ``style`` (serif without a
    ``style`` column, none where it is not known)."""
    table = alternates.select(F.lower("family").alias("_f"), F.col("names").alias("_n"))
    both = fonts.withColumn("_f", F.lower(family)).join(table, "_f", "left")  # Spark sends the small table to all tasks by its own size check
    face = F.lit("serif") if style is None else F.create_map(*(F.lit(x) for pair in GENERIC.items() for x in pair))[style]
    generic = F.when(fixed, "monospace").otherwise(face)
    names = F.concat(F.array(F.nullif(family, F.lit(""))), F.coalesce("_n", F.array().cast("array<string>")), F.array(generic))
    return both.withColumn("choices", F.array_distinct(F.array_compact(names))).drop("_f", "_n")
