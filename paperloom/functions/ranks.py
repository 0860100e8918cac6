"""Ranks from counts of ranges, so that no table and no group is ranked in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_bins(df: DataFrame, order: str, bins: int = 1024) -> DataFrame | None:
    """``df`` with ``_bin``, rising with the number column ``order``: its ranges are cut where its
    approximate quantiles lie, so clustered values fill them alike. None where there is no value."""
    wide = max(1, int(bins**0.5))
    cuts = df.agg(F.percentile_approx(order, [k / bins for k in range(1, bins)], 10 * bins).alias("c")).first()["c"]  # at most ``bins`` numbers
    if cuts is None:
        return None
    cuts = sorted(set(cuts))
    every, coarse = (F.lit(c) if c else F.array().cast("array<double>") for c in (cuts, cuts[wide - 1 :: wide]))

    def below(of: Column) -> Column:
        return F.size(F.filter(of, lambda c: c < F.col(order)))

    return df.withColumn("_bin", below(coarse)).withColumn("_bin", F.col("_bin") * wide + below(F.slice(every, F.col("_bin") * wide + 1, F.lit(wide))))


def rank_in(df: DataFrame, keys: list[str], order: str, out: str, bins: int = 256) -> DataFrame:
    """``out``: each row's rank by the number column ``order`` within its ``keys``; a group is dealt by
    ranges of ``order``. Null keys are a group."""
    binned = order_bins(df, order, bins)
    if binned is None:
        return df.withColumn(out, F.lit(None).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    counts = counts.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_bin").alias("_bin2"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_bin") == F.col("_bin2")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(order))
    return binned.join(counts, same).withColumn(out, rank).select(*df.columns, out)
