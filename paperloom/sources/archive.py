"""Reading archives of files and writing exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.sources import files
from paperloom.sources.files import ArchiveSource, ExportsSink

#: File name extensions that documents go by, and pictures.
CLAIMED = ("ws", "wsd", "ws3", "ws4", "ws5", "ws6", "ws7", "wst", "doc", "txt", "man", "prn", "nt", "bak", "let", "pix")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def read_archive(spark: SparkSession, paths: list[str], recursive: bool = False, prefix: int | None = None, content: bool = True) -> DataFrame:
    """Files of folders, and single files, as (path, modificationTime, length, content, error).

    Each path comes once; hidden names (beginning with a dot) are left out, all others are listed.
    Sub-folders are read only when ``recursive``. With ``prefix`` no more than that many bytes of a
    file are read, without ``content`` none. A file that cannot be read has its ``error``."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format(ArchiveSource.name()).option("addresses", json.dumps(paths)).option("recursive", str(recursive).lower()).option("content", str(content).lower())
    return (reader if prefix is None else reader.option("prefix", prefix)).load()


def claimed_files(df: DataFrame, name_col: str = "path", claimed: tuple[str, ...] = CLAIMED) -> DataFrame:
    return df.filter(extension(F.col(name_col)).isin(*claimed))


def sniff_prefix(df: DataFrame, n: int = 65536, content: str = "content") -> DataFrame:
    """Only the first n bytes of each file, for classification."""
    return df.withColumn(content, F.substring(content, 1, n))


def lines_of(df: DataFrame, text_col: str = "text", key: str = "doc", keep_terminator: bool = True) -> DataFrame:
    """(key, li, text, terminator): soft for ``8D 0A``, hard for ``0D 0A`` or a bare line feed,
    over for a bare carriage return, eof for what no terminator follows."""
    rule = r"\x8D\n|\r\n|\n|\r"
    ends = F.regexp_extract_all(F.col(text_col), F.lit(rule), F.lit(0))
    pieces = F.split(text_col, rule, -1)
    both = F.arrays_zip(pieces.alias("t"), ends.alias("e"))
    out = df.select(key, F.posexplode(both).alias("li", "x")).select(key, F.col("li").cast("long").alias("li"), F.col("x.t").alias("text"), F.col("x.e").alias("end"))
    if not keep_terminator:
        return out.drop("end").filter("li = 0 or text <> ''")
    kind = F.when(F.col("end").isNull(), "eof").when(F.col("end") == "\x8d\n", "soft").when(F.col("end") == "\r", "over").otherwise("hard")
    return out.withColumn("terminator", kind).drop("end").filter("terminator <> 'eof' or text <> ''")


def read_print_stream(df: DataFrame, text_col: str = "chars", key: str = "doc") -> DataFrame:
    """(key, page, li, text) of printer output: bit 7 dropped, all after the first 1A dropped,
    a form feed ends a page, control bytes other than line ends and tabs are left out."""
    high, low = "".join(map(chr, range(128, 256))), "".join(map(chr, range(128)))
    body = F.translate(F.substring_index(F.col(text_col), "\x1a", 1), high, low)
    body = F.regexp_replace(body, r"[\x00-\x08\x0B\x0E-\x1F\x7F]", "")
    pages = df.select(key, F.posexplode(F.split(body, "\f", -1)).alias("page", "_page"))
    return pages.select(key, F.col("page").cast("long").alias("page"), F.posexplode(F.split("_page", r"\r?\n", -1)).alias("li", "text")).withColumn("li", F.col("li").cast("long"))


def record_fields(line: Column) -> Column:
    """Fields of a comma record; quoted fields may hold commas."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(?:"([^"]*)"|([^,"]*))'), F.lit(0))
    return F.transform(fields, lambda f: F.regexp_replace(F.substring(f, 2, 1 << 30), '^"|"$', ""))


def read_record_list(lines: DataFrame, lists: DataFrame | None = None, key: str = "doc", order: str = "li", text_col: str = "text", pad: str = "\x1a") -> DataFrame:
    """(key, record, fields): one row per non-blank comma record, of the files that ``lists`` (key,
    is_list) takes for lists. The padding at a file's end is dropped, and where lines have a
    ``terminator`` a record goes on after a soft return."""
    if lists is not None:
        lines = lines.join(lists.filter("is_list").select(key), key, "left_semi")
    lines = lines.withColumn(text_col, F.regexp_replace(text_col, f"{pad}+$", ""))
    if "terminator" in lines.columns:
        w = Window.partitionBy(key).orderBy(order)
        new = F.coalesce(F.lag("terminator").over(w) != "soft", F.lit(True))
        m = lines.withColumn("_r", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))), lambda p: p["t"]), "")
        lines = m.groupBy(key, "_r").agg(F.min(order).alias(order), parts.alias(text_col))
    full = lines.filter(F.trim(text_col) != "")
    return full.select(key, F.col(order).alias("record"), record_fields(F.col(text_col)).alias("fields"))


def _failures(df: DataFrame, name: Column, body: Column) -> Column:
    """Why a row cannot be written, or null."""
    return F.when(name.isNull() | (F.trim(name) == ""), "no name").when(name.rlike(r"[/\\\x00]"), "the name is a path").when(body.isNull(), "nothing to write")


def write_exports(df: DataFrame, outdir: str, format_col: str = "format", name_col: str = "name", body_col: str = "body", mode: str = "overwrite") -> DataFrame:
    """Write every (format, name, body) below ``outdir`` by format; rows that cannot be written are
    returned with a reason each, and the run goes on."""
    rows = df.select(F.col(format_col).alias("format"), F.col(name_col).alias("name"), F.col(body_col).alias("body"), _failures(df, F.col(name_col), F.col(body_col)).alias("reason"))
    rows.filter("reason is null").drop("reason").write.mode(mode).partitionBy("format").parquet(outdir)
    return rows.filter("reason is not null").select("format", "name", "reason")


def write_files(df: DataFrame, outdir: str, collision: str = "refuse", run: str = "0", format_col: str = "format", name_col: str = "name", body_col: str = "body") -> DataFrame:
    """Write each row as one file ``outdir/format/name`` and return (format, name, reason) of those that
    could not be written; the others are written all the same.

    Files that exist are refused one by one, or replaced (``collision="replace"``). Of several rows of
    one name the least body is written. Nothing is left of a run that fails as a whole."""
    spark = df.sparkSession
    spark.dataSource.register(ExportsSink)
    body = F.col(body_col).cast("binary")
    rows = df.select(F.col(format_col).cast("string").alias("format"), F.col(name_col).cast("string").alias("name"), body.alias("body"))
    rows = rows.repartition("format", "name").sortWithinPartitions("format", "name", "body")  # rows of one name meet in one task
    staging = files.new_staging()
    rows.write.format(ExportsSink.name()).option("path", outdir).option("collision", collision).option("staging", staging).mode("append").save()
    try:  # tasks move what was staged, the driver knows no file
        staged = files.attempts(outdir, staging)
        if staged:
            spark.sparkContext.parallelize(staged, min(len(staged), 1024)).foreach(lambda a: files.place(outdir, staging, run, a))
        files.make_folder(outdir, f"_failures/run={run}")
    finally:
        files.clear(outdir, staging)
    return spark.read.schema("format string, name string, reason string").json(f"{outdir}/_failures/run={run}")


def write_replacing(df: DataFrame, outdir: str, run: int, format_col: str = "format", name_col: str = "name", body_col: str = "body") -> DataFrame:
    """Write exports that replace those of the same (format, name): each run has partitions of its
    own, written anew if the run is repeated; ``read_exports`` shows the newest."""
    rows = df.select(F.col(format_col).alias("format"), F.lit(run).alias("run"), F.col(name_col).alias("name"), F.col(body_col).alias("body"), _failures(df, F.col(name_col), F.col(body_col)).alias("reason"))
    good = rows.filter("reason is null").drop("reason")
    good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("format", "run").parquet(outdir)
    return rows.filter("reason is not null").select("format", "name", "reason")


def read_exports(spark: SparkSession, outdir: str) -> DataFrame:
    """(format, name, body) of the newest run of each name."""
    rows = spark.read.schema("name string, body string, format string, run int").parquet(outdir)
    return rows.groupBy("format", "name").agg(F.max_by("body", "run").alias("body"))


def without_overwrite(planned: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(to write, refused): targets that exist are refused one by one."""
    there = existing.select(*keys).distinct()
    return planned.join(there, keys, "left_anti"), planned.join(there, keys, "left_semi")


def dedupe_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows not already listed, each key once: of several rows the least."""
    others = [c for c in incoming.columns if c not in keys]
    once = incoming.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, "_r.*") if others else incoming.select(*keys).distinct()
    return once.join(existing.select(*keys).distinct(), keys, "left_anti")
