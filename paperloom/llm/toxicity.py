"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A sentence's probability is a logistic function of the weights of its words; a document's is the
noisy-or of its sentences, 1 - prod(1 - p). Only documents have labels; training moves the word
weights until the noisy-or agrees with them, so the weights settle on the sentences that explain
the label, and those sentences can be pointed out. Weights are never negative and carry an L1
price; labels are taken to be wrong at a small rate, which keeps single odd documents from
teaching anything.

The model is fitted in one task on a bounded sample: the ``max_docs`` labelled documents that
come first in a hash order, read until ``max_words`` words; labelled texts above ``max_doc_bytes``
are not learnt from. Only the sample moves to that task. The model has at most ``max_features``
weights: an equal part for whole words and for each length of beginnings, those most surely commoner
in toxic documents first; a word beyond them has no weight. Scoring reads every whole text.

Defined cases: null and empty texts have no sentences and score 0; labels that are null are not
used; a document labelled more than once counts as toxic if any label says so; without toxic
labels nothing is learnt and all scores are near 0; repeated rows are scored alike; extra columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.workers import giving_back

_STOP = np.zeros(256, dtype=bool)
_STOP[np.frombuffer(b".!?\n", dtype=np.uint8)] = True


@dataclass(frozen=True)
class MilSettings:
    max_docs: int = 12_000
    max_words: int = 4_000_000
    max_doc_bytes: int = 1_000_000
    min_docs: int = 4
    max_features: int = 20_000
    prior: float = -12.0
    label_noise: float = 0.02
    price: float = 0.2
    steps: int = 400
    rate: float = 0.25
    offending: float = 0.5


@dataclass
class MilModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    settings: MilSettings


def _sentence_of(w: W.Words) -> np.ndarray:
    """A number for each word's sentence, rising through the block and new in every row."""
    stops = np.concatenate([[0], np.cumsum(_STOP[w.data])])
    number = stops[w.start] + w.doc
    return np.concatenate([[0], np.cumsum(number[1:] != number[:-1])]) if len(number) else number


PREFIXES = (4, 5, 6, 7, 8, 9)


_KINDS = range(1 + len(PREFIXES))


def _feature(kind: int, hashed: W.RangeHash, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, feature hashes) of a kind: whole words, or beginnings of words of some byte length,
    which carry over to inflected and compound forms."""
    if kind == 0:
        return np.arange(len(start)), hashed(start, end)
    n = PREFIXES[kind - 1]
    long = np.flatnonzero(end - start > n)
    return long, W.mix(hashed(start[long], start[long] + n) + np.uint64(n))


def _features(w: W.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for kind in _KINDS:
        yield _feature(kind, w.hashed, w.start, w.end)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(batches: Iterator[pa.RecordBatch], s: MilSettings) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and weights from (label, body) batches."""
    labels, docs, sentences, blocks, n_docs, n_sentences, n_words = [], [], [], [], 0, 0, 0
    for batch in batches:
        for w in W.blocks(batch.column("body"), W.LETTERS, lower=True):
            if n_words > s.max_words:
                break
            sentence = _sentence_of(w)
            labels.append(batch.column("label").slice(w.lo, w.rows).to_numpy(zero_copy_only=False))
            docs.append((w.doc + n_docs).astype(np.int32))
            sentences.append((sentence + n_sentences).astype(np.int32))
            blocks.append((n_words, w.data, w.start.astype(np.int32), w.end.astype(np.int32)))
            n_docs, n_words = n_docs + w.rows, n_words + len(w.hash)
            n_sentences += int(sentence[-1]) + 1 if len(sentence) else 0
    none = np.empty(0, dtype=np.uint64), np.empty(0)
    if not n_words:
        return none
    label, doc, sentence = np.concatenate(labels) > 0, np.concatenate(docs), np.concatenate(sentences)
    del docs, sentences, w
    floor = min(0.5, 2 * label.mean())
    names, seen_in, feature = [], [], []
    for kind in _KINDS:  # one kind of feature at a time, made from the texts when it is its turn
        own_at, own_code = [], []
        for base, data, start, end in blocks:
            places, codes = _feature(kind, W.RangeHash(data), start, end)
            own_at.append((places + base).astype(np.int32))
            own_code.append(codes)
        vocabulary = W.distinct(np.concatenate(own_code), spent=True)
        code = np.concatenate([np.searchsorted(vocabulary, codes).astype(np.int32) for codes in own_code])
        at = np.concatenate(own_at)
        del own_at, own_code, places, codes
        pair = code.astype(np.int64)
        pair *= n_docs
        pair += doc[at]
        pair = W.distinct(pair, spent=True)
        toxic = np.bincount(pair // n_docs, weights=label[pair % n_docs], minlength=len(vocabulary))
        every = np.bincount(pair // n_docs, minlength=len(vocabulary))
        # clearly commoner in toxic documents: lower end of the rate's normal interval
        centre = (toxic + 2) / (every + 4)
        low = centre - 2 * np.sqrt(centre * (1 - centre) / (every + 4))
        chosen = np.flatnonzero((every >= s.min_docs) & (low > floor))
        chosen = np.sort(chosen[np.argsort(-low[chosen], kind="stable")][: s.max_features // len(_KINDS)])
        if len(chosen):
            place = np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)
            used = chosen[place] == code
            seen_in.append(sentence[at[used]])
            feature.append(place[used] + sum(map(len, names)))
            names.append(vocabulary[chosen])
    if not names:
        return none
    vocabulary = np.concatenate(names)
    seen = W.distinct(np.concatenate(seen_in).astype(np.int64) * len(vocabulary) + np.concatenate(feature))  # once a sentence
    s_of, f_of = seen // len(vocabulary), seen % len(vocabulary)
    s_ids, s_row = np.unique(s_of, return_inverse=True)
    doc_of_sentence = np.zeros(n_sentences, dtype=np.int64)
    doc_of_sentence[sentence] = doc
    d_row = doc_of_sentence[s_ids]
    weight, mean, square = np.full(len(vocabulary), -s.prior / 2), np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for step in range(1, s.steps + 1):
        p = _sigmoid(s.prior + np.bincount(s_row, weights=weight[f_of], minlength=len(s_ids)))
        clean = np.exp(np.bincount(d_row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs))
        said = s.label_noise + (1 - 2 * s.label_noise) * (1 - clean)
        slope = (1 - 2 * s.label_noise) * np.where(label, 1 / said, -1 / (1 - said)) * clean
        gradient = s.price - np.bincount(f_of, weights=(slope[d_row] * p)[s_row], minlength=len(vocabulary))
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        move = (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weight = np.maximum(0, weight - s.rate * move / np.sqrt(1 + step / 100))
    kept = weight > 0.5
    return vocabulary[kept], weight[kept]


def _sample(docs: DataFrame, labels: DataFrame, settings: MilSettings, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(order, label, body) of the sample in one partition; the corpus is scanned and joined in many."""
    named = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = named.withColumn("order", F.xxhash64(F.lit(11), "id")).orderBy("order", "id").limit(settings.max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).filter(F.octet_length("body") <= settings.max_doc_bytes)
    known = texts.join(F.broadcast(sample), "id").select("order", "label", "body")  # at most max_docs ids
    return known.repartition(1).sortWithinPartitions("order", "body")


def train(docs: DataFrame, labels: DataFrame, settings: MilSettings = MilSettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> MilModel:
    """Fit on labelled documents; ``labels`` has the rows that may be learnt from."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = _fit(batches, settings)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(weights)], ["word", "weight"])

    rows = _sample(docs, labels, settings, id_col, text_col, label_col).mapInArrow(giving_back(fit), "word long, weight double").collect()  # at most max_features rows
    rows = sorted((np.int64(r["word"]).view(np.uint64), r["weight"]) for r in rows)
    return MilModel(np.array([w for w, _ in rows], dtype=np.uint64), np.array([x for _, x in rows]), settings)


def score(df: DataFrame, model: MilModel, id_col: str = "doc_id", text_col: str = "text", text_field: str | None = None) -> DataFrame:
    """Per row: id, score, n_sentences and offending (start, end in code points, score).

    With ``text_field`` the id is a struct, and that string field of it is the text."""
    docs = df.select(F.col(id_col).alias("id")) if text_field else df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kind = docs.schema["id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    s, shipped = model.settings, df.sparkSession.sparkContext.broadcast((model.words, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = shipped.value
        prior = float(_sigmoid(np.array([s.prior]))[0])
        for batch in batches:
            texts = batch.column("id").field(text_field) if text_field else batch.column("body")
            for w in W.blocks(texts, W.LETTERS, lower=True):
                sentence = _sentence_of(w)
                begin = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(sentence) else np.empty(0, dtype=np.int64)
                count = np.bincount(w.doc[begin], minlength=w.rows)
                spans: list[list] = [[] for _ in range(w.rows)]
                log_clean = count * np.log1p(-prior)
                if len(words) and len(sentence):
                    hits = []
                    for at, code in _features(w):
                        place = np.minimum(np.searchsorted(words, code), len(words) - 1)
                        hit = words[place] == code
                        hits.append(sentence[at[hit]].astype(np.int64) * len(words) + place[hit])
                    once = W.distinct(np.concatenate(hits))
                    own, row = np.unique(once // len(words), return_inverse=True)
                    p = _sigmoid(s.prior + np.bincount(row, weights=weights[once % len(words)], minlength=len(own)))
                    doc = w.doc[begin[own]]
                    log_clean = log_clean + np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)) - np.log1p(-prior), minlength=w.rows)
                    bad = np.flatnonzero(p >= s.offending)
                    if len(bad):
                        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                        last = np.append(begin[1:], len(sentence)) - 1
                        for k in bad.tolist():
                            d, base = doc[k], points[w.offsets[doc[k]]]
                            spans[d].append({"start": int(points[w.start[begin[own[k]]]] - base), "end": int(points[w.end[last[own[k]]]] - base), "score": float(p[k])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(w.lo, w.rows), pa.array(np.clip(-np.expm1(log_clean), 0, 1)), pa.array(count, pa.int64()), pa.array(spans, spans_type)],
                    ["id", "score", "n_sentences", "offending"],
                )

    out = docs.mapInArrow(giving_back(run), f"id {kind}, score double, n_sentences long, offending array<struct<start:bigint,end:bigint,score:double>>")
    return out.withColumnRenamed("id", id_col)
