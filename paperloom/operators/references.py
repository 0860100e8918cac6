"""References to other files, resolved by ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders probed for a bare name, in order.
PROBES = ("", "inset/pix/", "inset/", "media/", "attachments/", "images/")


def _folders(path: Column, most: int) -> Column:
    """The folder of a path and its parents, nearest first."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(most))), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))


def candidates(refs: DataFrame, doc_path: str = "doc_path", raw: str = "raw_path", most: int = 8) -> DataFrame:
    """refs with (rank, candidate): every ancestor with every suffix of the path, longest first,
    then every ancestor with each probe folder and the bare name; lower case."""
    clean = F.regexp_replace(F.trim(F.substring_index(F.col(raw), "\x00", 1)), "^.:", "")
    parts = F.filter(F.split(F.lower(clean), r"[\\/]"), lambda p: p != "")
    suffixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/")))
    m = refs.withColumns({"_a": _folders(F.lower(doc_path), most), "_s": suffixes, "_base": F.element_at(parts, -1)})

    def under(folder: Column, rest: Column) -> Column:
        return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))

    one = F.flatten(F.transform("_a", lambda a: F.transform("_s", lambda s: under(a, s))))
    two = F.flatten(F.transform("_a", lambda a: F.transform(F.array(*(F.lit(p) for p in PROBES)), lambda p: under(a, F.concat(p, F.col("_base"))))))
    return m.withColumn("_c", F.concat(one, two)).select(*refs.columns, F.posexplode("_c").alias("rank", "candidate"))


def resolve_references(refs: DataFrame, files: DataFrame, keys: list[str], doc_path: str = "doc_path", raw: str = "raw_path", path: str = "path", most: int = 8) -> DataFrame:
    """refs with ``resolved``: the first candidate that is a file, letter case aside, else null."""
    there = files.groupBy(F.lower(path).alias("candidate")).agg(F.min(path).alias("_path"))
    hit = candidates(refs, doc_path, raw, most).join(there, "candidate")
    best = hit.groupBy(*keys).agg(F.min_by("_path", "rank").alias("resolved"))
    return refs.join(best, keys, "left")


def probe_report(refs: DataFrame, resolved: DataFrame, keys: list[str], doc_path: str = "doc_path", raw: str = "raw_path", show: int = 20, most: int = 8) -> DataFrame:
    """Unresolved references with the first places probed and how many more there were."""
    open_ = refs.join(resolved.filter("resolved is not null").select(*keys), keys, "left_anti")
    probed = candidates(open_, doc_path, raw, most).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]).alias("_all"))
    more = F.greatest(F.size("_all") - show, F.lit(0))
    return probed.select(*keys, F.array_join(F.slice("_all", 1, show), "\n").alias("probed"), F.when(more > 0, F.concat(F.lit("+"), more.cast("string"), F.lit(" more"))).alias("more"))
