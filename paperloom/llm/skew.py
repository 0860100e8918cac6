"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 256


def join_dealt(many: DataFrame, one: DataFrame, key: str | list[str], counts: DataFrame, total: int, spread: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined to ``one`` on ``key``, hot keys dealt to several tasks.

    ``counts`` has a row (key, n) for every key of ``many`` that may be hot, ``total`` is the sum
    of all n. Keys with more than 1/PARTS of all rows, of which there are fewer than PARTS, so that
    their list may be broadcast, are split by a hash of the ``spread`` columns; their rows of
    ``one`` are copied to each part. The result does not depend on it. Null keys do not match.
    """
    keys = [key] if isinstance(key, str) else key
    hot = counts.filter(F.col("n") * PARTS > F.lit(total)).select(*keys, F.ceil(F.col("n") * PARTS / F.lit(max(total, 1))).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    copied = one.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")
