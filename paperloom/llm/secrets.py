"""Secret scans with DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal runs. Beside them a battery of
randomness tests looks at every unbroken token of 20 and more encoding characters. From the
token's characters an encoding is inferred (hex, base32, base36, base62, base64, base64url;
letters and digits must both occur). Under the hypothesis that its symbols are drawn evenly and
independently, three statistics have known moments: chi-squared over the alphabet, runs above
and below the alphabet's middle, and serial correlation at lag one. Fisher's method makes one
p-value of them. Tokens are dismissed as not random by Benjamini-Hochberg within bins of length
(powers of two) over the whole corpus; the others are reported as ``random`` unless a base span
overlaps them. What the procedure bounds is the share of random tokens among those dismissed: at
most ``rate``, whatever the mix of lengths. The share of structured tokens among those reported
depends on how structured they are; the tests plant both kinds and measure it.

The corpus-wide step needs only counts by bin and p-value level (a bounded table). All else is
one map over whole texts; positions come from running sums over the pieces between matches.

Defined cases: null text is empty and has no spans; repeated rows are scanned alike; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.scratch import settle

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

_ENCODINGS = (
    ("hex", r"[0-9a-f]+", string.digits + "abcdef"),
    ("hex", r"[0-9A-F]+", string.digits + "ABCDEF"),
    ("base32", r"[A-Z2-7]+", string.ascii_uppercase + "234567"),
    ("base36", r"[a-z0-9]+", string.digits + string.ascii_lowercase),
    ("base36", r"[A-Z0-9]+", string.digits + string.ascii_uppercase),
    ("base62", r"[A-Za-z0-9]+", string.ascii_letters + string.digits),
    ("base64", r"[A-Za-z0-9+/]+", string.ascii_letters + string.digits + "+/"),
    ("base64url", r"[A-Za-z0-9_-]+", string.ascii_letters + string.digits + "-_"),
)
_SPAN = "array<struct<start:int,order:int,kind:string,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def running(steps: Column, block: int = 64) -> Column:
    """Running sums of an array, in blocks so that long arrays stay cheap."""

    def of_block(part: Column, before: Column) -> Column:
        return let(before, lambda b: F.transform(part, lambda _, i: b + total(F.slice(part, F.lit(1), i + 1))))

    def whole(s: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(s, k * block + 1, F.lit(block)))
        return let(parts, lambda p: let(F.transform(p, total), lambda sums: F.flatten(F.transform(p, lambda part, k: of_block(part, total(F.slice(sums, F.lit(1), k)))))))

    return let(steps, whole)


def found(text: Column, rule: str, kind: str, keep: Callable[[Column], Column], group: int = 0) -> Column:
    """Spans of a rule's matches whose ``group`` satisfies ``keep``, in code points."""
    order = KINDS.index(kind)

    def spans(matches: Column) -> Column:
        gaps = F.transform(F.split(text, rule, -1), F.length)
        lengths = F.transform(matches, F.length)
        steps = F.zip_with(gaps, F.concat(F.array(F.lit(0)), lengths), lambda g, n: (g + n).cast("long"))
        starts = running(steps)
        return F.zip_with(F.slice(starts, F.lit(1), F.size(matches)), matches, lambda s, m: F.struct(s.cast("int").alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (s + F.length(m)).cast("int").alias("end")))

    def kept(matches: Column) -> Column:
        if not group:
            return F.filter(spans(matches), lambda x: keep(x["end"] - x["start"]))
        parts = F.regexp_extract_all(text, F.lit(rule), F.lit(group))
        both = F.zip_with(spans(matches), parts, lambda x, part: F.when(keep(F.length(part)), x))
        return F.filter(both, lambda x: x.isNotNull())

    return let(F.regexp_extract_all(text, F.lit(rule), F.lit(0)), kept).cast(_SPAN)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.lit(1e-280), F.exp(-z * z / 2) / 2.5066282746310002 * poly)


def battery(token: Column) -> Column:
    """Struct (encoding, length, p, p_uniform, p_runs, p_serial) of a token; null without an encoding."""
    body = F.rtrim(token, F.lit("="))

    def tests(name: Column, alphabet: Column, b: Column) -> Column:
        n, a = F.length(b), F.length(alphabet)
        counts = F.transform(F.filter(F.split(alphabet, ""), lambda c: c != ""), lambda c: (n - F.length(F.replace(b, c, F.lit("")))).cast("double"))
        # chi-squared over equal cells rises with the pairs of equal symbols, whose first three
        # moments are exact; a gamma distribution with these (Wilson and Hilferty) gives the tail
        q, pairs = 1 / a, n * (n - 1) / 2
        equal = (F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) - n) / 2
        variance = pairs * q * (1 - q)
        skew = (variance * (1 - 2 * q) + n * (n - 1) * (n - 2) * q * q * (1 - q)) / F.pow(variance, F.lit(1.5))
        z_chi = (equal - F.lit(0.5) - pairs * q) / F.sqrt(variance)
        w_chi = (F.cbrt(F.greatest(F.lit(0.0), 1 + z_chi * skew / 2)) - (1 - skew * skew / 36)) * 6 / skew
        p_chi = F.when(w_chi >= 0, _tail(w_chi)).otherwise(1 - _tail(-w_chi))
        values = F.transform(F.filter(F.split(b, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))

        def ordered(v: Column) -> Column:
            middle = (a - 1) / 2
            high = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(x > middle, 1.0).otherwise(0.0))
            low = n - high
            nxt = F.slice(v, F.lit(2), n - 1)
            turns = F.aggregate(F.zip_with(F.slice(v, F.lit(1), n - 1), nxt, lambda x, y: F.when((x > middle) != (y > middle), 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
            mean = 2 * high * low / n + 1
            spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
            p_runs = F.least(F.lit(1.0), 2 * _tail(F.abs(turns + 1 - mean) / spread))
            product = F.aggregate(F.zip_with(F.slice(v, F.lit(1), n - 1), nxt, lambda x, y: (x - middle) * (y - middle)), F.lit(0.0), lambda s, x: s + x)
            p_serial = F.least(F.lit(1.0), 2 * _tail(F.abs(product) * 12 / (a * a - 1) / F.sqrt((n - 1).cast("double"))))
            half = -(F.log(F.greatest(F.lit(1e-280), p_chi)) + F.log(p_runs) + F.log(p_serial))
            p = F.exp(-half) * (1 + half + half * half / 2)
            return F.struct(name.alias("encoding"), n.alias("length"), p.alias("p"), p_chi.alias("p_uniform"), p_runs.alias("p_runs"), p_serial.alias("p_serial"))

        return let(values, ordered)

    def inferred(b: Column) -> Column:
        code = F.lit(None).cast("struct<name:string,alphabet:string>")
        for name, rule, alphabet in reversed(_ENCODINGS):
            code = F.when(b.rlike(f"^{rule}$"), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))).otherwise(code)
        code = F.when(b.rlike("[0-9]") & b.rlike("[A-Za-z]"), code)
        return let(code, lambda c: F.when(c.isNotNull(), tests(c["name"], c["alphabet"], b)))

    return let(body, inferred)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base spans, and tested tokens (start, end, encoding, bin, level, p ...)."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    t, none = F.col("body"), F.array().cast(_SPAN)
    base = F.concat(
        F.when(t.rlike(ASSIGN), found(t, ASSIGN, "assign", lambda n: n >= 8, group=2)).otherwise(none),
        F.when(t.contains("AKIA"), found(t, ACCESS, "access", lambda n: n >= 16)).otherwise(none),
        F.when(t.rlike("[0-9a-f]{32}"), found(t, HEX, "hex", lambda n: n >= 32)).otherwise(none),
    )
    tokens = F.when(t.rlike(TOKEN), found(t, TOKEN, "random", lambda n: n >= 20)).otherwise(none)
    words = F.when(t.rlike(TOKEN), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    tested = F.zip_with(tokens, words, lambda s, w: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(w).alias("test")))
    tested = F.filter(tested, lambda x: x["test"].isNotNull())
    return docs.select("id", F.array_sort(base).alias("base"), tested.alias("tested"))


def length_bin(length: Column) -> Column:
    return F.floor(F.log2(length.cast("double"))).cast("int")


def p_level(p: Column) -> Column:
    """Tenths of a power of ten, rounded so that the p-value is at most 10 ** (-level / 10)."""
    return F.floor(-10 * F.log10(F.greatest(F.lit(1e-280), p))).cast("int")


def dismissal_levels(scanned: DataFrame, rate: float) -> dict[int, int]:
    """Per bin of length: the level from which tokens are dismissed (Benjamini-Hochberg)."""
    tests = scanned.select(F.explode("tested").alias("x")).select(length_bin(F.col("x.test.length")).alias("bin"), p_level(F.col("x.test.p")).alias("level"))
    counts = tests.groupBy("bin", "level").agg(F.count("*").alias("n"))  # some 30 bins of at most 2,800 levels
    beyond = F.sum("n").over(Window.partitionBy("bin").orderBy(F.col("level").desc()))
    counts = counts.withColumns({"beyond": beyond, "all": F.sum("n").over(Window.partitionBy("bin"))})
    passed = counts.filter(F.pow(F.lit(10.0), -F.col("level") / 10) <= F.lit(rate) * F.col("beyond") / F.col("all"))
    return {r["bin"]: r["level"] for r in passed.groupBy("bin").agg(F.min("level").alias("level")).collect()}


def find_secrets(df: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base spans and all spans, each an array of (start, order, kind, end)."""
    scanned = settle(scan(df, id_col, text_col), "secret-scan")
    levels = dismissal_levels(scanned, rate)

    def random(x: Column) -> Column:
        dismissed = F.lit(False)
        for b, level in levels.items():
            dismissed |= (length_bin(x["test"]["length"]) == b) & (p_level(x["test"]["p"]) >= level)
        overlaps = F.exists("base", lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"]))
        return ~dismissed & ~overlaps

    extra = F.transform(F.filter("tested", random), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("order"), F.lit("random").alias("kind"), x["end"].alias("end")))
    return scanned.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", extra.cast(_SPAN))).alias("spans"), "tested")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
