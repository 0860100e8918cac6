"""MinHash near-duplicates with sequential Bayesian verification.

1. Every whole text becomes its set of 5-word shingles (64-bit hashes), a fingerprint of the
   set, a signature of 128 minima and 48 band keys of five further minima each. At similarity 0.75 a
   pair shares no band with probability 2e-6.
2. Texts with the same set form one class; one document stands for it.
3. Members of a band bucket are paired with its smallest member. Signatures are compared a batch
   at a time and a pair is given up when the posterior probability of similarity >= 0.75 falls
   below ``miss``. Survivors are confirmed on the full shingle sets of the texts.
4. Buckets whose members still lie in more than one component hold the pairs that cross
   components. Buckets up to ``small`` members give them directly. Members of larger buckets are joined exactly by prefix and position: with shingles ordered from the
   rarest, a pair of similarity 0.75 shares one so early in both sets that what follows can still
   make up the overlap. Heavily edited copies share only common shingles with their group, behind
   their own, so they make no rows. Survivors are verified likewise.

Step 4 keeps the work in proportion: members of one group of copies are joined by its star, so
no bucket is expanded into all pairs, and no partner is dropped by a cap.

Defined cases: null and empty texts have no shingles and link with nothing; under five words the
whole sequence is the one shingle; rows that share an id count as one document; rows without an
id are returned with component null and kept true; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.components import components
from paperloom.llm.scratch import forget, settle
from paperloom.llm.skew import join_dealt
from paperloom.llm.workers import giving_back

WORDS, BANDS, ROWS = 5, 48, 5
HASHES = BANDS * ROWS
COMPARED = 128
_RANDOM = np.random.default_rng(20240501)
_FACTOR = (_RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND = W.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for w in W.blocks(texts, W.SPACED, lower=True):
        first = w.first()
        at, gram = w.grams(n)
        lo = np.searchsorted(at, first)
        for k in range(w.rows):
            a, b = first[k], first[k + 1]
            if b - a >= n:
                yield w.lo + k, W.distinct(gram[lo[k] : lo[k + 1]])
            elif b > a:
                short = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for h in w.hash[a:b]:
                        short = short * np.uint64(W._BASE) + h
                yield w.lo + k, W.mix(np.array([short]))
            else:
                yield w.lo + k, np.empty(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima under random linear maps of 32 bits."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), 2048):
        np.minimum(out, (low[None, k : k + 2048] * _FACTOR + _ADD).min(axis=1), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    m = minima.reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND
    for k in range(ROWS):
        key = W.mix(key * np.uint64(W._BASE) + m[:, k])
    return key.view(np.int64)


def least_matches(threshold: float, miss: float, batch: int) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): with a uniform prior the posterior probability
    of similarity >= t after m of n matches is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(batch, COMPARED + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("id"), []
            for row, shingles in shingle_sets(batch.column("body")):
                if len(shingles):
                    print_ = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=np.int64)
                    minima = signature(shingles)
                    rows.append((row, len(shingles), int(print_[0]), int(print_[1]), minima[:COMPARED].astype(np.uint16).tobytes(), band_keys(minima)))
                else:
                    rows.append((row, 0, None, None, None, None))
                if len(rows) >= 4096:
                    yield _signed_batch(ids, rows)
                    rows = []
            if rows:
                yield _signed_batch(ids, rows)

    return docs.mapInArrow(giving_back(run), "id long, n long, p1 long, p2 long, sig binary, bands array<long>")


def _signed_batch(ids: pa.Array, rows: list) -> pa.RecordBatch:
    row, n, p1, p2, sig, bands = zip(*rows)
    numbers = (pa.array(c, pa.int64()) for c in (n, p1, p2))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *numbers, pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "p1", "p2", "sig", "bands"])


def _likely(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float, batch: int = 16) -> DataFrame:
    """Pairs (a, b), read from a table, that the sequential test does not give up."""
    steps = least_matches(threshold, miss, batch)
    led = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    both = join_dealt(pairs, led, "a", pairs.groupBy("a").agg(F.count("*").alias("n")), pairs.count(), ["b"]).join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(0, rows.num_rows, 4096):
                part = rows.slice(k, 4096)
                one, two = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint16).reshape(-1, COMPARED) for c in ("sig_a", "sig_b"))
                alive, got = np.arange(len(one)), np.zeros(len(one), dtype=np.int64)
                for n, least in steps:
                    got = got + (one[alive, n - batch : n] == two[alive, n - batch : n]).sum(axis=1)
                    alive, got = alive[got >= least], got[got >= least]
                yield part.select(["a", "b"]).take(pa.array(alive))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(giving_back(run), "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, per_task: int = 256) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the similarity.

    Members b travel to their leader a; a leader with many members is copied to one place for
    every ``per_task`` of them, so no group meets in one task.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / per_task).cast("int"))
    roles = join_dealt(pairs, many.drop("n"), "a", many.drop("parts"), pairs.count(), ["b"]).select(F.col("b").alias("id"), F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"))
    heads = many.select(F.col("a").alias("id"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    placed = texts.join(roles.unionByName(heads), "id").select("leader", "part", "member", "id", "body")
    placed = placed.repartition("leader", "part").sortWithinPartitions("leader", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sets = None, []
        for rows in batches:
            keys = list(zip(rows.column("leader").to_pylist(), rows.column("part").to_pylist()))
            member, ids, found = rows.column("member").to_pylist(), rows.column("id").to_pylist(), []
            for k, own in shingle_sets(rows.column("body")):
                if keys[k] != head:
                    head, sets = keys[k], []
                if not member[k]:
                    sets.append(own)
                    continue
                for lead in sets:
                    at = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
                    common = int((lead[at] == own).sum())
                    if 100 * common >= percent * (len(lead) + len(own) - common):
                        found.append((keys[k][0], ids[k]))
                        break
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.mapInArrow(giving_back(run), "a long, b long")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows, read from a table, whose key is met in more than one component, with its row count ``many``."""
    found = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("many")).filter("lo != hi")
    found = settle(found.select("key", "many"), "mixed-keys")
    return join_dealt(rows, found, "key", found.select("key", F.col("many").alias("n")), rows.count(), ["id"])


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket and of different components."""
    one, two = (rows.select("key", F.col("id").alias(i), F.col("c").alias(f"c_{i}")) for i in "ab")
    return one.join(two, "key").filter("a < b and c_a != c_b").select("a", "b")


def _early_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle early enough in both orders.

    At similarity p/100 the overlap is at least p * (n_a + n_b) / (100 + p); a shingle at ranks
    r_a and r_b leaves room for 1 + min(n_a - r_a, n_b - r_b). The shorter set's rank is bounded
    by its own length alone, which keeps most rows out of the join's left side.
    """
    facts = ["id", "c", "n", "rank"]
    one, two = (rows.select("key", *(F.col(x).alias(f"{x}_{i}") for x in facts)) for i in "ab")
    one = one.filter((100 + percent) * (F.col("n_a") - F.col("rank_a") + 1) >= 2 * percent * F.col("n_a"))
    shorter = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    room = 1 + F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b"))
    enough = ((100 + percent) * room >= percent * (F.col("n_a") + F.col("n_b"))) & (100 * F.col("n_a") >= percent * F.col("n_b"))
    both = one.join(two, (one.key == two.key) & (F.col("c_a") != F.col("c_b")) & shorter & enough)
    return both.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def _rare_shingles(texts: DataFrame, percent: int) -> DataFrame:
    """(key, id, c, n, rank): the prefix of each set, its rarest shingles, as far as others have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own in shingle_sets(batch.column("body")):
                ids, c = (np.full(len(own), batch.column(x)[k].as_py(), dtype=np.int64) for x in ("id", "c"))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(ids), pa.array(c), pa.array(np.full(len(own), len(own), dtype=np.int64))], ["key", "id", "c", "n"])

    rows = settle(texts.select("id", "c", "body").mapInArrow(giving_back(run), "key long, id long, c long, n long"), "shingles")
    shared = settle(rows.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "shared-shingles")
    counted = join_dealt(rows, shared, "key", shared.select("key", F.col("df").alias("n")), rows.count(), ["id"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "key"))
    length = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1
    early = settle(counted.withColumn("rank", rank).filter((F.col("rank") <= length) & (F.col("df") > 1)).select("key", "id", "c", "n", "rank"), "rare-shingles")
    for table in (rows, shared):
        forget(table)
    return early


def _crossing(buckets: DataFrame, group: DataFrame, texts: DataFrame, small: int, percent: int) -> DataFrame:
    """Pairs that lie in one bucket but in different components and may be alike."""
    named = buckets.join(group, buckets.id == group.node, "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    named = settle(named, "named-buckets")
    mixed = settle(_mixed(named), "mixed-buckets")
    forget(named)
    few = _pairs(mixed.filter(F.col("many") <= small))
    crowded = mixed.filter(F.col("many") > small).select("id", "c").distinct()
    early = _rare_shingles(texts.join(crowded, "id"), percent)
    rare = settle(_mixed(early), "mixed-shingles")
    forget(early)
    out = settle(few.unionByName(_early_pairs(rare, percent)).distinct(), "crossing")
    for table in (mixed, rare):
        forget(table)
    return out


def _bucketed(entries: DataFrame, total: int) -> DataFrame:
    """(key, id, a) of buckets with two rows or more; a is the bucket's head.

    The head is the row that meets most rows over all its buckets (of equal ones the smallest id), so
    the buckets of a group of near copies mostly have one head, and few pairs are to be compared."""
    met = settle(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    sized = settle(join_dealt(entries, met.withColumnRenamed("n", "size"), "key", met, total, ["id"]), "sized-buckets")
    weights = sized.groupBy("id").agg(F.sum("size").alias("meets"))
    ranked = sized.join(weights, "id").groupBy("key").agg(F.max(F.struct("meets", (-F.col("id")).alias("low"))).alias("top"))
    heads = ranked.select("key", (-F.col("top.low")).alias("a"))
    buckets = settle(join_dealt(sized.drop("size"), heads, "key", met, total, ["id"]), "buckets")
    for table in (met, sized):
        forget(table)
    return buckets


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, miss: float = 1e-6, small: int = 8
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable) and kept."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    signed = settle(_signed(docs), "signatures")
    facts = settle(signed.select("id", "n", "p1", "p2"), "shingle-counts")
    classes = facts.filter("n > 0 and id is not null").groupBy("p1", "p2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = settle(classes, "classes")
    reps = signed.filter("n > 0").select("id", "sig", "bands").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    # of rows that share an id and differ in text, one: the same on every run
    reps = reps.groupBy("id").agg(F.max(F.struct("sig", "bands")).alias("r")).select("id", "r.sig", "r.bands")
    reps = settle(reps, "representatives")
    forget(signed)

    entries = reps.select("id", F.explode("bands").alias("key"))
    buckets = _bucketed(entries, BANDS * reps.count())
    candidates = buckets.select("id").distinct()
    texts = settle(docs.join(candidates, "id", "left_semi"), "candidate-texts")

    star = settle(buckets.filter("id != a").select("a", F.col("id").alias("b")).distinct(), "star")
    likely = settle(_likely(star, reps, percent / 100, miss), "likely")
    links = settle(_confirmed(likely, texts, percent), "links")
    group = settle(components(links), "components")
    crossing = _crossing(buckets, group, texts, small, percent)
    cross = settle(_likely(crossing, reps, percent / 100, miss), "likely")
    more = settle(_confirmed(cross, texts, percent), "links")
    if not more.isEmpty():
        joined = group.select(F.col("component").alias("a"), F.col("node").alias("b"))
        before, group = group, settle(components(joined.unionByName(more)), "components")
        forget(before)
    for table in (reps, buckets, texts, star, likely, links, crossing, cross, more):
        forget(table)

    named = classes.join(group, classes.rep == group.node, "left").select("p1", "p2", F.coalesce("component", "rep").alias("component_id"))
    rows, linked = facts, (F.col("n") > 0) & F.col("id").isNotNull()
    out = join_dealt(rows.filter(linked), named, ["p1", "p2"], classes.select("p1", "p2", "n"), facts.count(), ["id"])
    out = out.unionByName(rows.filter(~linked).withColumn("component_id", F.col("id")))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
