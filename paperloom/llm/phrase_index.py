"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores, for every shard of documents, each term with the sorted list of its
positions. The shards are rows of a table, so the index is dealt out by document: queries go to
all shards and no posting is shuffled. ``search`` takes the benchmark's word windows to every
shard. Inside a shard a window is dropped if any of its terms has no list; else it starts from
its rarest term's list and is intersected with the others, next rarest first, each shifted by
its offset in the window. What is left are exact phrase matches. ``near`` asks for the rarest
terms of an item (by their counts over the whole index, then by their place in the item) within a
stretch of ``near_span`` consecutive words of a document, in any order. Terms that the index lacks
are passed over, and shorter items ask for all their terms; an item of which the index has no more
than half the distinct terms matches nothing.

The benchmark is a query set, not a corpus: its distinct items go to the shards in blocks of at
most ``max_query_words`` counted words, one pass over the index for each. An item of more than half
as many words goes in pieces that overlap by a window less a word, so it loses no phrase; its
proximity is looked for piece by piece.

Defined cases: null and empty texts have no words; an item without words matches nothing and one
under the window length is one window; items that share an id count once; a null item id is
shown as an empty string; repeated document rows are separate rows; empty tables give no matches;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.scratch import forget, settle
from paperloom.llm.workers import giving_back

#: small rows keep arrays under what a JVM heap treats as huge, and batches of them short
SHARD_BYTES = 256 << 10
#: a reader's batch of these wide rows ends with the row group, so groups are small
_ROW_GROUPS = {"parquet.block.size": 8 << 20}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_FAR = np.int64(1) << 40


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (shard, ids, first, terms, starts, postings), one per shard of documents.

    ``first`` has the position of each document's first word and the number of words; ``terms``
    are sorted term hashes; ``starts`` says where each term's positions begin in ``postings``.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for w in W.blocks(batch.column("body"), W.LETTERS, lower=True, limit=SHARD_BYTES):
                order = np.argsort(w.hash, kind="stable")
                ordered = w.hash[order]
                new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, dtype=np.int64)
                parts = (w.first().astype(np.int32), ordered[new], np.append(new, len(ordered)).astype(np.int32), order.astype(np.int32))
                ids = batch.column("id").slice(w.lo, w.rows)
                held = pa.ListArray.from_arrays(pa.array([0, w.rows], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{number}"]), held, *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["shard", "ids", "first", "terms", "starts", "postings"])
                number += 1

    return docs.mapInArrow(giving_back(run), f"shard string, ids array<{kind}>, first binary, terms binary, starts binary, postings binary")


def _read(batch: pa.RecordBatch, column: str, row: int, kind: type) -> np.ndarray:
    """A binary field as numbers, without a copy."""
    return np.frombuffer(batch.column(column)[row].as_buffer(), dtype=kind)


@dataclass
class Query:
    """A block of items. Terms are numbers of ``vocabulary``, -1 where there is none.

    ``base`` has the words of each item before the piece of it that is here. A row of ``terms`` is a window, rarest term of the whole index first, and ``shift`` has each
    term's place in it. A row of ``close`` has the terms an item is looked for by proximity.
    """

    items: list[str]
    base: np.ndarray
    vocabulary: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    terms: np.ndarray
    shift: np.ndarray
    distinct: list[np.ndarray]
    close: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, str, int]], length: int) -> Query:
        words = [w.hash[a:b] for w in W.blocks(pa.array([t for _, t, _ in items], pa.string()), W.LETTERS, lower=True) for a, b in itertools.pairwise(w.first())]
        every = np.concatenate([np.empty(0, dtype=np.uint64), *words])
        vocabulary = W.distinct(every)
        count = np.array([len(x) for x in words], dtype=np.int64)
        begin = np.cumsum(count) - count
        n = np.minimum(count, 1) * np.maximum(count - length + 1, 1)
        item = np.repeat(np.arange(len(items)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = (begin[item] + offset)[:, None] + np.arange(length)
        inside = at < (begin + count)[item][:, None]
        numbers = np.searchsorted(vocabulary, every).astype(np.int32)
        terms = np.where(inside, numbers[np.minimum(at, max(len(every) - 1, 0))], -1) if len(item) else np.empty((0, length), dtype=np.int32)
        distinct = [x[np.sort(np.unique(x, return_index=True)[1])] for x in np.split(numbers, begin[1:])] if items else []
        shift = np.broadcast_to(np.arange(length, dtype=np.int16), terms.shape)
        return cls([i for i, _, _ in items], np.array([b for _, _, b in items], dtype=np.int64), vocabulary, item, offset, terms, shift, distinct, np.full((len(items), 1), -1, dtype=np.int32))

    def ranked(self, counts: np.ndarray, near_terms: int) -> Query:
        """The same query with the terms of windows and items in order of their counts."""
        rank = np.argsort(_counted(counts, self.terms, _FAR), axis=1, kind="stable")
        close = np.full((len(self.items), max(near_terms, 1)), -1, dtype=np.int32)
        for k, own in enumerate(self.distinct):
            known = own[counts[own] > 0]
            if 2 * len(known) > len(own):
                rarest = known[np.argsort(counts[known], kind="stable")][:near_terms]
                close[k, : len(rarest)] = rarest
        return replace(self, terms=np.take_along_axis(self.terms, rank, axis=1), shift=np.take_along_axis(self.shift, rank, axis=1), distinct=[], close=close)


def _counted(counts: np.ndarray, terms: np.ndarray, absent: int) -> np.ndarray:
    return np.where(terms >= 0, counts[terms], absent) if len(counts) else np.full(terms.shape, absent, dtype=np.int64)


class Shard:
    """One row of the index, with the lists of a query's vocabulary looked up."""

    def __init__(self, batch: pa.RecordBatch, row: int, vocabulary: np.ndarray):
        self.first = _read(batch, "first", row, np.int32)
        self.postings = _read(batch, "postings", row, np.int32)
        self.begin, self.count = _lists(batch, row, vocabulary)
        #: (term, position) of the query's terms as one sorted list of numbers
        self.keys = (np.repeat(np.arange(len(vocabulary)), self.count) << 32) | self.postings[self._spread(self.begin, self.count)]

    @staticmethod
    def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term.astype(np.int64) << 32) | position
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return self.keys[at] == key if len(self.keys) else np.zeros(len(key), dtype=bool)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def _from_rarest(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, order of its terms by their counts here, position of the first of them), for rows
        all of whose terms have lists, some million positions at a time."""
        row = np.arange(len(terms))
        for j in range(terms.shape[1]):  # rarest over the whole index first: few rows pass
            row = row[_counted(self.count, terms[row, j], 1) > 0]
        rank = np.argsort(_counted(self.count, terms[row], _FAR), axis=1, kind="stable")
        n = self.count[terms[row, rank[:, 0]]] if len(row) else np.empty(0, dtype=np.int64)
        for part in np.array_split(np.arange(len(row)), 1 + int(n.sum()) // 1_000_000):
            if len(part):
                rare, times = terms[row[part], rank[part, 0]], n[part]
                yield np.repeat(row[part], times), np.repeat(rank[part], times, axis=0), self.postings[self._spread(self.begin[rare], times)].astype(np.int64)

    def phrases(self, q: Query) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first word) of all exact occurrences."""
        found = [(np.empty(0, dtype=np.int64),) * 2]
        for window, rank, start in self._from_rarest(q.terms):
            start = start - q.shift[window, rank[:, 0]]
            length = (q.terms[window] >= 0).sum(axis=1)
            inside = (start >= 0) & (start + length <= self.first[-1])
            inside[inside] = self.doc_of(start[inside]) == self.doc_of(start[inside] + length[inside] - 1)
            window, start, rank, length = window[inside], start[inside], rank[inside], length[inside]
            for j in range(1, q.terms.shape[1]):
                at = rank[:, j]
                ok = (length <= j) | self.holds(q.terms[window, at], start + q.shift[window, at])
                window, start, rank, length = window[ok], start[ok], rank[ok], length[ok]
            found.append((window, start))
        return tuple(np.concatenate(x) for x in zip(*found))

    def near(self, q: Query, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, position of its rarest term) where all the item's close terms lie in some ``span``
        consecutive words of one document.

        Around a position of the rarest term only the nearest occurrence of each other term on
        either side matters: a stretch that reaches so far to the left must reach right to all
        terms it has not met.
        """
        found = [(np.empty(0, dtype=np.int64),) * 2]
        some = np.flatnonzero((q.close >= 0).any(axis=1))
        for row, rank, at in self._from_rarest(q.close[some]):
            item, doc = some[row], self.doc_of(at)
            terms = np.take_along_axis(q.close[item], rank, axis=1).astype(np.int64)
            left, right = np.zeros((2, *terms.shape), dtype=np.int64)
            for j in range(1, terms.shape[1]):
                term = terms[:, j]
                k = np.searchsorted(self.keys, (term << 32) | at)
                after, before = self.keys[np.minimum(k, len(self.keys) - 1)], self.keys[np.maximum(k - 1, 0)]
                place = after & 0xFFFFFFFF
                right[:, j] = np.where((after >> 32 == term) & (place > at) & (place < self.first[doc + 1]), place - at, _FAR)
                place = before & 0xFFFFFFFF
                left[:, j] = np.where((before >> 32 == term) & (place < at) & (place >= self.first[doc]), at - place, _FAR)
                left[term < 0, j] = right[term < 0, j] = 0
                ok = np.minimum(left[:, j], right[:, j]) < span
                item, doc, at, terms, left, right = item[ok], doc[ok], at[ok], terms[ok], left[ok], right[ok]
            least = np.full(len(at), _FAR)
            for j in range(terms.shape[1]):
                reach = left[:, j : j + 1]
                least = np.minimum(least, reach[:, 0] + np.where(left > reach, right, 0).max(axis=1))
            found.append((item[least < span], at[least < span]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _lists(batch: pa.RecordBatch, row: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term's positions begin, and how many there are."""
    terms, starts = _read(batch, "terms", row, np.uint64), _read(batch, "starts", row, np.int32)
    if not len(terms):
        return np.zeros((2, len(vocabulary)), dtype=np.int64)
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    known = terms[at] == vocabulary
    return np.where(known, starts[at], 0).astype(np.int64), np.where(known, starts[at + 1] - starts[at], 0).astype(np.int64)


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of a query block stands in the whole index; one row a known term."""
    shipped = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shipped.value), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                total += _lists(batch, k, shipped.value)[1]
        known = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total[known])], ["term", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for r in index.select("terms", "starts").mapInArrow(giving_back(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def _spans(shard: Shard, q: Query, window: np.ndarray, start: np.ndarray) -> dict[int, list[dict]]:
    """Matches by document row; windows that continue each other are one span."""
    length = (q.terms[window] >= 0).sum(axis=1)
    order = np.lexsort((start, start - q.offset[window], q.item[window]))
    window, start, length = window[order], start[order], length[order]
    item, shift, doc = q.item[window], start - q.offset[window], shard.doc_of(start)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(window)) - 1
    out: dict[int, list[dict]] = {}
    for a, b in zip(at, last):
        d = int(doc[a])
        out.setdefault(d, []).append({"item_id": q.items[item[a]], "start": int(start[a] - shard.first[d]), "end": int(start[b] + length[b] - shard.first[d]), "item_start": int(q.base[item[a]] + q.offset[window[a]])})
    return out


def _pieces(items: DataFrame, most: int, window: int) -> DataFrame:
    """(item, body, base, n): items of more than ``most`` words are cut into pieces that share all but
    one word of a window, so that every window lies whole in one piece; ``base`` counts the words before."""
    counted = items.withColumn("n", F.regexp_count(F.lower("body"), F.lit(WORD)).cast("long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column("item").to_pylist(), batch.column("body").to_pylist()):
                places = [m.span() for m in re.finditer(WORD, body.translate(_LOW))]
                for lo in range(0, max(len(places) - window + 1, 1), most - window + 1):
                    hi = min(lo + most, len(places))
                    piece = body[places[lo][0] : places[hi - 1][1]]
                    yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([piece]), pa.array([lo], pa.int64()), pa.array([hi - lo], pa.int64())], ["item", "body", "base", "n"])

    whole = counted.filter(F.col("n") <= most).select("item", "body", F.lit(0).cast("long").alias("base"), "n")
    return whole.unionByName(counted.filter(F.col("n") > most).select("item", "body").mapInArrow(giving_back(cut), "item string, body string, base long, n long"))


def _blocks(items: DataFrame, most: int, window: int) -> Iterator[DataFrame]:
    """Distinct items in blocks of at most ``most`` counted words; longer items come in pieces."""
    items = _pieces(items.distinct(), max(most // 2, 2 * window), window).withColumn("deal", F.xxhash64("item", "body", "base"))
    most = max(most, 4 * window)
    parts = 1 + 2 * (items.agg(F.sum("n")).first()[0] or 0) // most
    while True:
        dealt = items.withColumn("block", F.pmod("deal", F.lit(parts)))
        if (dealt.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
            break
        parts *= 2
    for b in range(parts):
        yield dealt.filter(F.col("block") == b).select("item", "body", "base")


_SPAN = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("item_start", pa.int64())]))


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10, near_terms: int = 4, near_span: int = 30, max_query_words: int = 1_000_000) -> DataFrame:
    """Per document row: id, n_words, spans (item_id, start, end, item_start, in words) of exact
    matches, and near (item ids whose rarest terms lie close together; none with near_terms=0)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    blocks = list(_blocks(items, max_query_words, window))
    kind = index.schema["ids"].dataType.elementType.simpleString()
    if len(blocks) > 1:  # the passes meet by shard, so shard names must be fixed
        index = settle(index, "phrase-index", **_ROW_GROUPS)
    found = None
    for block in blocks:
        query = Query.of(sorted(tuple(r) for r in block.collect()), window)  # at most max_query_words
        query = index.sparkSession.sparkContext.broadcast(query.ranked(term_counts(index, query.vocabulary), near_terms))

        def run(batches: Iterator[pa.RecordBatch], query=query) -> Iterator[pa.RecordBatch]:
            q = query.value
            for batch in batches:
                for k in range(batch.num_rows):
                    shard = Shard(batch, k, q.vocabulary)
                    spans = _spans(shard, q, *shard.phrases(q))
                    close: dict[int, set[str]] = {}
                    item, at = shard.near(q, near_span)
                    for i, d in zip(item.tolist(), shard.doc_of(at).tolist()):
                        close.setdefault(d, set()).add(q.items[i])
                    rows = np.arange(len(shard.first) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("shard")[k].as_py()] * len(rows), pa.string()),
                            pa.array(rows, pa.int64()),
                            batch.column("ids")[k].values,
                            pa.array(np.diff(shard.first), pa.int64()),
                            pa.array([spans.get(r, []) for r in range(len(rows))], _SPAN),
                            pa.array([sorted(close.get(r, ())) for r in range(len(rows))], pa.list_(pa.string())),
                        ],
                        ["shard", "row", "id", "n_words", "spans", "near"],
                    )

        part = index.mapInArrow(giving_back(run), f"shard string, row long, id {kind}, n_words long, spans array<struct<item_id:string,start:bigint,end:bigint,item_start:bigint>>, near array<string>")
        found = part if found is None else found.unionByName(part)
    if len(blocks) > 1:
        found = found.groupBy("shard", "row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("near")).alias("near"))
    return found.drop("shard", "row")


def words_hit(spans: Column) -> Column:
    """Words inside any span."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        upto = F.greatest(acc["upto"], s["end"])
        return F.struct(upto.alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"))

    return F.aggregate(ordered, start, step)["n"]


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, near_terms: int = 4, near_span: int = 30) -> DataFrame:
    """Index ``df``, search the benchmark, and count per document row."""
    index = settle(build_index(df, id_col, text_col), "phrase-index", **_ROW_GROUPS)
    found = search(index, benchmark, window=window, near_terms=near_terms, near_span=near_span)
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    near = F.array_sort(F.array_distinct("near"))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        words_hit(F.col("spans")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        F.size(near).cast("long").alias("n_near"),
        near.alias("near"),
        "spans",
    )


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """Distinct ids of rows that hold an exact window of the benchmark; the index is removed again."""
    index = settle(build_index(df, id_col, text_col), "phrase-index", **_ROW_GROUPS)
    found = search(index, benchmark, window=window, near_terms=0)
    ids = settle(found.filter(F.size("spans") > 0).select(F.col("id").alias(id_col)).distinct(), "contaminated")
    forget(index)
    return ids
