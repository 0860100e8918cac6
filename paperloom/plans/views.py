"""Relations that the queries run on, derived from the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, li, text): physical lines of the documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("li", "text")).select("doc", F.col("li").cast("long").alias("li"), "text")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with shapes of typed manuscripts planted by arithmetic on (doc, li)."""
    n = F.col("doc") + F.col("li")
    base = F.when(F.col("li") % 3 == 0, F.replace("text", F.lit(". "), F.lit(".  "))).otherwise(F.col("text"))
    names = F.element_at(F.array(*(F.lit(x) for x in (".pn", ".mt", ".po", ".lh"))), (n % 4 + 1).cast("int"))
    text = (
        F.when(n % 17 == 0, F.concat(names, F.lit(" "), (n % 9).cast("string")))
        .when(n % 11 == 0, F.lit(""))
        .when(n % 7 == 0, F.concat(F.lit("- "), base))
        .when(n % 5 == 0, F.concat(F.lit("     "), base))
        .when(n % 13 == 0, F.concat(F.lit("word"), (n % 4).cast("string"), F.lit(":  "), base))
        .otherwise(base)
    )
    return lines(spark, sf_dir).select("doc", "li", text.alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, ts, seq, name, arg): event_type as a command, value as its argument in cents."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("doc"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.round(F.col("value") * 100).cast("long").alias("arg"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, bi, li, height, kind, part, style): lineitem as block lines of a supplier's document."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("bi"), F.col("l_linenumber").cast("long").alias("li"), F.col("l_quantity").cast("long").alias("height"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("part"), (F.col("l_partkey") % 256).cast("int").alias("style"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items`` with one row for each place: (doc, bi, li, height, kind, style)."""
    return items(spark, sf_dir).groupBy("doc", "bi", "li").agg(F.max("height").alias("height"), F.max("kind").alias("kind"), F.max("style").alias("style"))


SQL = {
    "L": "select doc_id as doc, unnest(range(len(p))) as li, unnest(p) as text from (select doc_id, string_split(text, chr(10)) as p from documents)",
    "LP": """select doc, li, case when n % 17 = 0 then (['.pn', '.mt', '.po', '.lh'])[n % 4 + 1] || ' ' || (n % 9) when n % 11 = 0 then '' when n % 7 = 0 then '- ' || base
        when n % 5 = 0 then '     ' || base when n % 13 = 0 then 'word' || (n % 4) || ':  ' || base else base end as text
        from (select doc, li, doc + li as n, case when li % 3 = 0 then replace(text, '. ', '.  ') else text end as base from L)""",
    "EV": "select user_id as doc, ts, event_id as seq, event_type as name, cast(round(value * 100) as bigint) as arg from events",
    "LI": "select l_suppkey as doc, l_orderkey as bi, cast(l_linenumber as bigint) as li, cast(l_quantity as bigint) as height, l_returnflag as kind, l_partkey as part, cast(l_partkey % 256 as integer) as style from lineitem",
    "PL": "select doc, bi, li, max(height) as height, max(kind) as kind, max(style) as style from LI group by doc, bi, li",
}


def with_views(body: str, *names: str) -> str:
    """A query over the named views; further CTEs may follow, starting with a comma."""
    order = [n for n in SQL if n in names or (n == "L" and "LP" in names) or (n == "LI" and "PL" in names)]
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in order) + (body if body.lstrip().startswith(",") else " " + body)
