"""The corpus pipeline: five operators of ``paperloom.llm``, each on what its predecessor kept.

Every row is judged by its own text, whatever its doc_id, null and repeated ids included. A stage
returns the columns of ``documents``, and extra ones as they came, whatever their names: operators
see only ``row`` (a packed row or its number), ``doc_id``, ``text`` and ``source``. The last stage
returns what was read back from the token store.

Defined cases: null and empty texts are kept until mixing, which takes no row without words;
repeated rows are near copies of each other; no rows give no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import mixing, near_dedup, phrase_index, token_store, toxicity
from paperloom.llm.queries import held_out, tokenizer_json
from paperloom.llm.scratch import forget, settle

TOXIC_FROM = 0.7


def _packed(docs: DataFrame) -> Column:
    """A whole row with its columns numbered: names of any kind do no harm."""
    return F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row")


def _place(docs: DataFrame, column: str) -> str:
    return f"c{docs.columns.index(column)}"


def _unpacked(docs: DataFrame, prefix: str = "") -> list[Column]:
    """The columns of ``docs`` from numbered ones."""
    return [F.col(f"{prefix}c{k}").alias(c) for k, c in enumerate(docs.columns)]


def _numbered(docs: DataFrame) -> DataFrame:
    """Numbered columns and a number ``n`` of the row, the same at every use.

    A row of a file is named by its file and place (a hash of 64 bits); other rows are written down
    with numbers first. Numbers are in no order."""
    try:
        return docs.select(_packed(docs), F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("n")).select("row.*", "n")
    except AnalysisException:
        return settle(docs.select(_packed(docs)).select("row.*", F.xxhash64(F.monotonically_increasing_id()).alias("n")), "rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores stays under 0.7; a third of the labels is held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = toxicity.score(docs.select(_packed(docs)), model, id_col="row", text_field=_place(docs, "text"))
    return scored.filter(F.col("score") < TOXIC_FROM).select(*_unpacked(docs, "row."))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies: that of the smallest id, of one without id only if none has one.

    Rows without shingles are in no group.
    """
    rows, doc_id, text = _numbered(docs), F.col(_place(docs, "doc_id")), _place(docs, "text")
    found = near_dedup.near_duplicates(rows, id_col="n", text_col=text).select("n", "component_id")
    order = F.struct(doc_id.isNull().alias("without"), doc_id.alias("doc_id"), F.xxhash64(text).alias("digest"), "n")
    first = rows.select("n", order.alias("order")).join(found, "n").groupBy("component_id").agg(F.min("order").alias("order"))
    return rows.join(first.select(F.col("order.n").alias("n")), "n", "left_semi").select(*_unpacked(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no word window of the benchmark.

    Proximity is no ground to reject, as the rare words of an item also meet in texts that do not
    quote it. A text goes by two hashes of 64 bits.
    """
    text = F.col("row." + _place(docs, "text"))
    rows = docs.select(_packed(docs)).withColumn("key", F.struct(F.xxhash64(text).alias("k0"), F.xxhash64(F.lit(1), text).alias("k1")))
    bad = phrase_index.contaminated(rows.withColumn("text", text), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return rows.join(bad, "key", "left_anti").select(*_unpacked(docs, "row."))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times."""
    mixed = mixing.mix_sources(docs.select(_packed(docs), "doc_id", "text", "source"), keep=["row"])
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return mixed.select("row", copies).select(*_unpacked(docs, "row."))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a content-addressed store, checked by reading it back."""
    store = token_store.write_store(docs, tokenizer_json(), end_id=2)
    return token_store.verify(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32", "root")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_store", tokenize),
]

#: hashes, a fitted model and a tokenizer: not for SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
