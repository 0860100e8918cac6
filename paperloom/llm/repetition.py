"""Repetition coverage: how much of a text lies inside repeated word runs and lines.

Rolling hashes of several run lengths are compared inside each document, in numpy, and the
characters (code points) of the covered words are measured. Every text is read whole and each
document is judged by itself, so nothing is shuffled.

Defined cases: a null or empty text has no words and fails the word minimum; repeated rows give
repeated rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W


@dataclass(frozen=True)
class RepetitionRules:
    min_words: int = 10
    base_length: int = 5
    max_repeat_percent: int = 20
    #: run length -> largest share of characters inside runs of that length found twice or more
    max_gram_share: dict[int, float] = field(default_factory=lambda: {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15})
    max_line_share: float = 0.30


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_LENGTHS = RepetitionRules().max_gram_share


def _found_twice(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    ordered = np.sort(keys)
    twice = W.distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _covered(w: W.Words, n: int) -> np.ndarray:
    """Words that lie in a run of n words found twice or more in their text."""
    at, gram = w.grams(n)
    at = at[_found_twice(W.mix(gram + w.doc[at].astype(np.uint64)))]
    step = np.zeros(len(w.hash) + 1, dtype=np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def _measure(w: W.Words, rules: RepetitionRules) -> dict[str, np.ndarray]:
    point = (w.data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(point)])
    first = w.first()
    chars = points[w.end] - points[w.start]
    out = {"n_words": np.diff(first), "word_chars": W.per_row(chars, first), "n_symbols": W.per_row(_SYMBOL[w.data], w.offsets)}

    doc, start, end = W.runs(w.data != 10, w.offsets)  # lines; an empty line has no word
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    doc, start, end = doc[worded], start[worded], end[worded]
    key = W.mix(w.hashed(start, end) + W.mix(doc.astype(np.uint64)) + (end - start).astype(np.uint64))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), dtype=bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(doc, weights=later, minlength=w.rows).astype(np.int64)
    inside = points[end] - points[start]
    out["dup_line_chars"] = np.bincount(doc, weights=np.where(later, inside, 0), minlength=w.rows).astype(np.int64)

    for n in sorted({rules.base_length, *rules.max_gram_share}):
        covered = _covered(w, n)
        if n == rules.base_length:
            out["n_repeat_words"] = W.per_row(covered, first)
        if n in rules.max_gram_share:
            out[f"dup_chars_{n}"] = W.per_row(np.where(covered, chars, 0), first)
    return out


def repetition_coverage(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per input row: its id, counts, characters inside repeats, and the verdict ``kept``."""
    lengths = sorted(rules.max_gram_share)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in lengths)]
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for w in W.blocks(batch.column("body"), W.SPACED):
                found = _measure(w, rules)
                yield pa.RecordBatch.from_arrays([ids.slice(w.lo, w.rows), *(pa.array(found[c], type=pa.int64()) for c in names)], ["id", *names])

    measured = slim.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in names))
    base_failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    over = F.col("dup_line_chars") > rules.max_line_share * F.col("word_chars")
    for n in lengths:
        over |= F.col(f"dup_chars_{n}") > rules.max_gram_share[n] * F.col("word_chars")
    return measured.withColumnRenamed("id", id_col).withColumns({"base_failed": base_failed, "kept": ~base_failed & ~over})
