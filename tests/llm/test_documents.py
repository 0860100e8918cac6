"""Operators on documents against brute force, with odd rows."""

import collections
import glob
import os
import random
import re
import shutil
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import licenses, mixing, near_dedup, phrase_index, queries, repetition, token_store, toxicity
from paperloom.llm import words as W
from paperloom.llm.components import components

SPACED = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_words_and_runs_equal_regular_expressions(odd_docs):
    texts = [t for _, t in texts_of(odd_docs)] + ["\x00a\x1cb", "é ́x", "a\x0bb"]
    for table, rule in ((W.SPACED, SPACED), (W.LETTERS, LETTERS)):
        for limit in (1, 64, 1 << 20):
            got = []
            for w in W.blocks(pa.array(texts, pa.string()), table, limit=limit):
                body, first = w.data.tobytes(), w.first()
                got += [[body[w.start[k] : w.end[k]].decode() for k in range(first[r], first[r + 1])] for r in range(w.rows)]
            assert got == [re.findall(rule, t) for t in texts]


def test_repetition_equals_brute_force(odd_docs, empty_docs):
    def expect(t):
        w = re.findall(SPACED, t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(SPACED, x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    got = sorted(((r.doc_id is None, r.doc_id or 0), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in repetition.repetition_coverage(odd_docs).collect())
    assert got == sorted(((d is None, d or 0), expect(t)) for d, t in texts_of(odd_docs))
    assert repetition.repetition_coverage(empty_docs).count() == 0


def shingles(t):
    w = re.findall(SPACED, low(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def reachable(docs):
    """Smallest id that each id reaches over links and shared ids."""
    parent = {d: d for d, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in docs]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                parent[hi] = lo
    return {d: top(d) for d in parent}


def test_near_duplicates_equal_brute_force(spark, odd_docs, empty_docs):
    rng = random.Random(3)
    origin = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    copies = []
    for k in range(80):  # copies from light to heavy edits, so that only some links hold
        words = list(origin)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        copies.append((1000 + k, " ".join(words)))
    extra = spark.createDataFrame(copies, "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "n").unionByName(extra, allowMissingColumns=True)
    rows = [(d, t) for d, t in texts_of(docs) if d is not None]
    expect = reachable(rows)
    got = near_dedup.near_duplicates(docs, small=4).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expect[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t in texts_of(docs))
    assert near_dedup.near_duplicates(empty_docs).count() == 0


def test_hot_keys_are_dealt(spark):
    """A key with most rows meets its partner in many parts, and the join's rows are the same."""
    from paperloom.llm.skew import join_dealt

    many = spark.range(3000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(7).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, -1)], "k long, v long"))
    one = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        dealt = join_dealt(many, one, "k", counts, many.count(), ["v"], how)
        assert sorted(map(str, dealt.collect())) == sorted(map(str, many.join(one, "k", how).select(*dealt.columns).collect()))
    plan = join_dealt(many, one, "k", counts, many.count(), ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan


def test_planted_copies_are_found(spark):
    """Recall of near copies measured on planted pairs beside a given table, by their true similarity."""
    rng = random.Random(11)
    origin = [[f"q{rng.randrange(30_000)}" for _ in range(rng.choice([40, 90, 300]))] for _ in range(250)]
    rows, want = [], 0
    for k, words in enumerate(origin):
        copy = list(words)
        for _ in range(rng.randrange(0, 1 + len(words) // 45)):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
        rows += [(10**7 + 2 * k, " ".join(words)), (10**7 + 2 * k + 1, " ".join(copy).upper())]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).filter("doc_id >= 10000000").collect()}
    for k in range(len(origin)):
        a, b = shingles(rows[2 * k][1]), shingles(rows[2 * k + 1][1])
        alike = 100 * len(a & b) >= 75 * len(a | b)
        want += alike
        assert (got[10**7 + 2 * k] == got[10**7 + 2 * k + 1]) == alike
    assert want > 100


def test_sequential_test_keeps_similar_pairs():
    steps = near_dedup.least_matches(0.75, 1e-6, 16)
    assert [n for n, _ in steps] == list(range(16, 129, 16)) and all(0 <= m < 0.75 * n for n, m in steps)


def test_components_of_paths_and_stars(spark):
    for edges in ([(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(k, 99) for k in range(30)] + [(5, 5), (None, 3)]):
        parent = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                lo, hi = sorted((top(a), top(b)))
                parent[hi] = lo
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: top(x) for x in parent}


@pytest.mark.parametrize("block", [25, 10**6])
def test_contamination_equals_brute_force(spark, odd_docs, empty_docs, block):
    docs = texts_of(odd_docs)
    words = re.findall(LETTERS, low(docs[34][1]))
    items = [(1, " ".join(words[50:75])), (2, " ".join(words[60:70]).upper()), (3, "word"), (4, None), (5, "!!"), (6, "not there at all"), (2, "x"), (None, "and the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(LETTERS, low(t or ""))
        for k in range(max(min(len(w), 1), len(w) - 9)):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))

    def expect(t):
        w, hit, found = re.findall(LETTERS, low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        return len(w), len(hit), sorted(found)

    index = phrase_index.build_index(odd_docs)
    found = phrase_index.search(index, bench, max_query_words=block)
    items_ = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    got = sorted((r.d is None, r.d or 0, r.n_words, r.hit, r.found) for r in found.select(F.col("id").alias("d"), "n_words", phrase_index.words_hit(F.col("spans")).alias("hit"), items_.alias("found")).collect())
    assert got == sorted((d is None, d or 0, *expect(t)) for d, t in docs)
    assert phrase_index.contamination(empty_docs, bench).count() == 0
    assert all(r.n_hit == 0 for r in phrase_index.contamination(odd_docs, bench.limit(0)).collect())


def test_items_longer_than_a_block_are_searched_in_pieces(spark):
    rng = random.Random(5)
    item = [f"w{rng.randrange(300)}" for _ in range(400)]
    docs = [(k, " ".join([*(f"x{k}" for _ in range(3)), *item[a : a + n], "end"])) for k, (a, n) in enumerate([(0, 400), (5, 60), (90, 10), (391, 9), (210, 11), (0, 9)])]
    index = phrase_index.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(item).title()), (1, "w1"), (2, "short one")], "item_id long, text string")
    hit = {}
    for most in (10**6, 200):
        found = phrase_index.search(index, bench.filter("text <> 'w1'"), max_query_words=most, near_terms=0)
        rows = found.select("id", phrase_index.words_hit(F.col("spans")).alias("hit"), "spans").collect()
        hit[most] = {r.id: r.hit for r in rows}
        for r in rows:  # every span says where in the whole item it begins
            words = docs[r.id][1].split()
            assert all(words[s.start : s.end] == item[s.item_start : s.item_start + s.end - s.start] for s in r.spans)
    assert hit[10**6] == hit[200] == {0: 400, 1: 60, 2: 10, 3: 0, 4: 11, 5: 0}


def test_proximity_in_any_order(spark):
    docs = spark.createDataFrame([(1, "q w gamma e r alpha t beta y delta"), (2, "alpha " + "z " * 200 + "beta gamma delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string")
    assert {r.id: r.near for r in phrase_index.search(phrase_index.build_index(docs), bench).collect()} == {1: ["9"], 2: []}


def test_proximity_equals_brute_force(spark):
    rng = random.Random(8)
    names = [f"v{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choice(names[: rng.choice([4, 12, 40])]) for _ in range(rng.choice([0, 3, 30, 200])))) for k in range(60)] + [(60, None), (61, "v1 " * 5000)]
    items = [(k, " ".join(rng.choice([*names, "lost"]) for _ in range(rng.randrange(7)))) for k in range(80)] + [(80, None)]
    words = {k: (t or "").split() for k, t in docs}
    counts = collections.Counter(w for own in words.values() for w in own)

    def close(item, span):
        own = list(dict.fromkeys((item or "").split()))
        known = sorted((w for w in own if counts[w]), key=lambda w: counts[w])[:4] if 2 * sum(counts[w] > 0 for w in own) > len(own) else []
        return {d for d, w in words.items() if known and any(set(known) <= set(w[k : k + span]) for k in range(len(w)))}

    index = phrase_index.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for span, block in ((1, 10**6), (5, 10**6), (30, 50)):
        got = {(r.id, i) for r in phrase_index.search(index, bench, near_span=span, max_query_words=block).collect() for i in r.near}
        assert got == {(d, str(k)) for k, t in items for d in close(t, span)}


def test_token_store_round_trip(spark, odd_docs, empty_docs):
    from tokenizers import Tokenizer

    json = queries.tokenizer_json()
    tokenizer = Tokenizer.from_str(json)
    store = token_store.write_store(odd_docs, json, end_id=2)
    expect = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for _, t in texts_of(odd_docs)]
    docs = {r.start: (r.doc_id, r.ids) for r in token_store.read_documents(spark, store).collect()}
    facts = {r.start: (r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.verify(spark, store).collect()}
    assert docs.keys() == facts.keys() and len(docs) == odd_docs.count()
    assert sorted(ids for _, ids in docs.values()) == sorted(expect)
    at, ids_before = 0, None
    for start in sorted(docs):
        doc, ids = docs[start]
        assert start == at and facts[start] == (doc, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert ids_before is None or doc is None or ids_before <= doc
        at, ids_before = at + len(ids), doc if doc is not None else ids_before
    chunks = token_store._chunks(spark, store)
    assert chunks.count() == chunks.select("address").distinct().count()
    none = token_store.write_store(empty_docs, json, end_id=2)
    assert token_store.verify(spark, none).count() == 0


def test_tokens_of_odd_strings():
    from tokenizers import Tokenizer

    json = queries.tokenizer_json()
    encoder, tokenizer, rng = token_store.WordEncoder(json), Tokenizer.from_str(json), random.Random(5)
    alphabet = [*"abzAZ019 ,.;:!?'\"-_()\n\t\r\x0b\x1c\x85 éÉçßÿ÷ñ̸́<|>~’…中日ıİſK ", "'s", "'re", "<|endoftext|>", "<|EndOfText|>", " the ", "d'un"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for k in range(0, len(texts), 50):
        part = texts[k : k + 50]
        for w, ids, first in encoder.blocks(pa.array(part, pa.string())):
            for r in range(w.rows):
                assert ids[first[r] : first[r + 1]].tolist() == tokenizer.encode(part[w.lo + r], add_special_tokens=False).ids


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49_000, 50_000).astype(np.uint16)
    one, two = token_store.cuts(ids), token_store.cuts(np.concatenate([ids[:7], ids]))
    assert one[-1] == len(ids) and all(b - a <= token_store.MOST for a, b in zip([0, *one], one))
    assert len({e + 7 for e in one} & set(two)) > 0.9 * len(one)
    assert token_store.cuts(np.empty(0, dtype=np.uint16)) == []


def test_checksums_add_up():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 5, 4096, 70_000)]
    total, after = 0, 0
    for p in reversed(parts):
        total ^= int(token_store.crc_shift(np.array([zlib.crc32(p)]), np.array([after]))[0])
        after += len(p)
    assert total == zlib.crc32(b"".join(parts))


def test_mixing_meets_targets(spark, odd_docs, empty_docs):
    mixed = mixing.mix_sources(odd_docs).collect()
    docs = odd_docs.collect()
    assert len(mixed) == len(docs)
    sizes, taken, goal = collections.Counter(), collections.Counter(), {}
    for r in mixed:
        assert r["size"] == len(re.findall(SPACED, r.text or "")) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert goal == pytest.approx(mixing.targets(dict(sizes), mixing.weights_by_order(list(sizes))))
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    assert mixing.mix_sources(odd_docs).select("doc_id", "taken").exceptAll(spark.createDataFrame([(r.doc_id, r.taken) for r in mixed], "doc_id long, taken long")).count() == 0
    assert mixing.mix_sources(empty_docs).count() == 0


def test_registered_mix_comes_near_its_targets(spark):
    """The query on given tables against targets computed here, word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(SPACED, r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    sizes, taken = collections.Counter(), collections.Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight, goal, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, set(names)
    while left:
        rest = sum(sizes.values()) - sum(goal.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > 3 * sizes[s]}
        goal |= {s: 3.0 * sizes[s] for s in above} if above else share
        left = left - above if above else set()
    rows = queries.op2_mix_sources(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r["size"], r.source_size) for r in rows} == {d: (n, sizes[source[d]]) for d, n in size.items()}
    for r in rows:
        assert r.target == pytest.approx(goal[source[r.doc_id]]) and 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= 0.03 * goal[s] + 50


def test_mixing_of_rows_without_ids_or_all_alike(spark):
    """Ties in the id, and rows equal in all, do not throw a source off its target."""
    docs = [(k, " ".join(["w"] * (5 + k % 11)), f"s{k % 4}") for k in range(2000)]
    plain = spark.createDataFrame(docs, "doc_id long, text string, source string")
    cases = {
        "as they are": plain,
        "half without id": plain.withColumn("doc_id", F.when(F.col("doc_id") % 8 < 4, F.col("doc_id"))),
        "no ids": plain.withColumn("doc_id", F.lit(None).cast("long")),
        "one id": plain.withColumn("doc_id", F.lit(1).cast("long")),
        "all alike": plain.withColumns({"doc_id": F.lit(1).cast("long"), "text": F.lit("five words are in here")}),
    }
    for name, df in cases.items():
        rows = mixing.mix_sources(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()
        assert sum(r.n for r in rows) == 2000
        for r in rows:
            assert abs(r.taken - r.target) <= 0.02 * r.target + 20, (name, r)


def test_a_store_that_lost_something_is_refused(spark, tmp_path):

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(k if k % 7 else None, f"words of document {k % 50} and more of them") for k in range(300)], "doc_id long, text string")

    def fresh(name):
        store = token_store.write_store(docs, queries.tokenizer_json(), end_id=2, path=f"{tmp_path}/{name}")
        return store, sorted(glob.glob(f"{store.manifest}/*.parquet"), key=lambda f: -pq.read_metadata(f).num_rows)

    store, _ = fresh("whole")
    assert token_store.verify(spark, store).count() == 300

    def rewritten(file, change):
        table = pq.read_table(file)
        os.remove(file)
        for crc in glob.glob(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")):
            os.remove(crc)
        pq.write_table(change(table), file)

    def swapped(t):
        doc = t.column("doc").to_pylist()
        at = next(k for k in range(len(doc) - 1) if doc[k] != doc[k + 1])
        doc[at], doc[at + 1] = doc[at + 1], doc[at]
        return t.set_column(t.schema.get_field_index("doc"), "doc", pa.array(doc, pa.int64()))

    harm = {
        "a file": lambda store, files: os.remove(files[0]),
        "all files": lambda store, files: [os.remove(f) for f in files],
        "a row": lambda store, files: rewritten(files[0], lambda t: t.slice(1)),
        "documents": lambda store, files: rewritten(files[0], swapped),
        "the seals": lambda store, files: [os.remove(f) for f in glob.glob(f"{store.seals}/*.parquet")],
        "the root": lambda store, files: [os.remove(f) for f in glob.glob(f"{store.root}/*.parquet")],
    }
    for name, act in harm.items():
        store, files = fresh(name)
        act(store, files)
        with pytest.raises(ValueError):
            token_store.verify(spark, store)
    store, _ = fresh("a chunk")
    shutil.rmtree(f"{store.chunks}/kind=chunk")
    os.makedirs(f"{store.chunks}/kind=chunk")
    with pytest.raises(Exception, match="chunk is missing"):
        token_store.verify(spark, store).collect()


def test_flow_of_many_patterns_is_quick_and_meets_quotas():
    rng = random.Random(1)
    sources = [f"s{k}" for k in range(40)]
    members = {p: rng.sample(sources, rng.randrange(1, 4)) for p in range(20_000)}
    capacity = {p: rng.randrange(1, 1000) for p in members}
    quota = {s: 100_000.0 * (1 + k % 3) for k, s in enumerate(sources)}
    used = mixing.route(capacity, members, quota)
    assert sum(used.values()) == pytest.approx(sum(quota.values()), rel=1e-6)
    assert all(0 <= used[p] <= 3 * capacity[p] + 1e-6 for p in members)
    fresh = sum(used[p] <= capacity[p] + 1e-6 for p in members)
    assert fresh == len(members) or sum(min(used[p], capacity[p]) for p in members) == pytest.approx(sum(capacity.values()))


def test_targets_share_what_is_above():
    assert mixing.targets({"a": 10, "b": 100}, {"a": 5, "b": 2}) == {"a": 30.0, "b": 80.0}
    assert mixing.weights_by_order(["b", None, "a"]) == {"a": 5, "b": 2, None: 1}


def test_flow_reroutes_shared_patterns():
    """Words that two sources share are moved to the one that has nothing else."""
    used = mixing.route({0: 10, 1: 10}, {0: ["a", "b"], 1: ["a"]}, {"a": 10.0, "b": 10.0})
    assert used == {0: 10.0, 1: 10.0}
    used = mixing.route({0: 10}, {0: ["a"]}, {"a": 25.0})
    assert used == {0: 25.0}


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(k, " ".join(["w"] * (5 + k % 7)), ["a", "b"] if k % 3 == 0 else ["a" if k % 3 == 1 else "b"]) for k in range(600)], "doc_id long, text string, tags array<string>")
    rows = mixing.mix_sources(docs, member=F.col("tags"), weights=lambda names: {n: 1 for n in names}).collect()
    assert len(rows) == 600 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.02)


def test_toxicity_points_at_sentences(spark, empty_docs):
    rng = random.Random(1)
    plain = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(600):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randrange(2, 9))]
        bad = k % 5 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] += " vile rotten"
        docs.append((k, ". ".join(sentences) + ".", "x"))
        labels.append((k, int(bad), 9))
    docs += [(700, None, "x"), (701, "", "x"), (702, "Vile rotten. " + "fine word " * 3000, "x"), (0, docs[0][1], "x")]
    labels += [(5, None, 9), (5, 1, 9), (None, 1, 9)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, label int")
    model = toxicity.train(d, y.filter("doc_id % 3 <> 1 or doc_id is null"))
    out = toxicity.score(d, model).collect()
    assert len(out) == len(docs)
    text = {k: t for k, t, _ in docs}
    for r in out:
        bad = r.doc_id == 702 or (r.doc_id < 600 and r.doc_id % 5 == 0)
        assert (r.score >= 0.7) == bad
        assert all("rotten" in text[r.doc_id][s.start : s.end].lower() for s in r.offending) and bool(r.offending) == bad
    assert toxicity.score(empty_docs, model).count() == 0
    blank = toxicity.train(d, y.limit(0))
    assert all(r.score < 0.1 for r in toxicity.score(d, blank).collect())


def test_noisy_or_by_hand(spark):
    """Scores against the formula over sentences and words cut by regular expressions."""
    rng = random.Random(4)
    vocabulary = [f"word{k}é" if k % 9 == 0 else f"word{k}" for k in range(60)] + ["x", "yy", "rotten", "rottenness"]

    def hashes(words):
        (w,) = W.blocks(pa.array([" ".join(words)], pa.string()), W.LETTERS, lower=True)
        return dict(zip(words, w.hash.tolist()))

    def features(word):
        out = [hashes([word])[word]]
        data = word.encode()
        for n in toxicity.PREFIXES:
            if len(data) > n:
                value = 0
                for k, b in enumerate(data[:n]):
                    value = (value + (b + 1) * pow(W._BASE, k, 1 << 64)) % (1 << 64)
                value = int(W.mix(np.array([value], dtype=np.uint64))[0])
                out.append(int(W.mix(np.array([(value + n) % (1 << 64)], dtype=np.uint64))[0]))
        return out

    known = {f for w in rng.sample(vocabulary, 25) for f in features(w)}
    weight = {f: rng.uniform(0.5, 9) for f in sorted(known)}
    model = toxicity.MilModel(np.array(sorted(weight), dtype=np.uint64), np.array([weight[f] for f in sorted(weight)]), toxicity.MilSettings())
    texts = ["".join(rng.choice(vocabulary).upper() + rng.choice([" ", ", ", ". ", "!\n", "? "]) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", "...", "Rotten"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for r in toxicity.score(docs, model).collect():
        sentences = [x for x in (re.findall(LETTERS, low(part)) for part in re.split(r"[.!?\n]", texts[r.doc_id] or "")) if x]
        chances = [sigmoid(-12 + sum(weight.get(f, 0) for f in {f for w in own for f in features(w)})) for own in sentences]
        assert r.n_sentences == len(sentences) and r.score == pytest.approx(1 - np.prod([1 - p for p in chances]), abs=1e-9)
        assert len(r.offending) == sum(p >= 0.5 for p in chances)


def test_fit_equals_plain_loops():
    """The same words are chosen and the same weights found, word by word and sentence by sentence."""
    rng = random.Random(9)
    s = toxicity.MilSettings(steps=30, min_docs=3)
    clean, foul = [f"clean{k}" for k in range(30)], ["rotten", "rottenly", "vile", "vilest"]
    docs = []
    for k in range(160):
        label = int(k % 4 == 0)
        words = [rng.choice(clean) for _ in range(rng.randrange(4, 20))]
        if label and rng.random() < 0.95:
            words[rng.randrange(len(words))] = rng.choice(foul)
        docs.append((label, "".join(w + rng.choice([" ", " ", ". "]) for w in words)))
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in docs]), pa.array([t for _, t in docs])], ["label", "body"])
    found, weights = toxicity._fit(iter([batch]), s)

    def name(feature):
        word, n = feature
        (w,) = W.blocks(pa.array([word]), W.LETTERS, lower=True)
        return int(w.hash[0]) if n is None else int(W.mix(w.hashed(np.array([0]), np.array([n])) + np.uint64(n))[0])

    def features(word):
        return {(word, None), *((word[:n], n) for n in toxicity.PREFIXES if len(word) > n)}

    cut = [[set().union(*(features(w) for w in part.split())) for part in t.split(".") if part.split()] for _, t in docs]
    every, toxic = collections.Counter(), collections.Counter()
    for (label, _), sentences in zip(docs, cut):
        for f in set().union(*sentences):
            every[f] += 1
            toxic[f] += label
    floor, chosen = min(0.5, 2 * sum(a for a, _ in docs) / len(docs)), []
    for f, n in every.items():
        centre = (toxic[f] + 2) / (n + 4)
        if n >= s.min_docs and centre - 2 * (centre * (1 - centre) / (n + 4)) ** 0.5 > floor:
            chosen.append(f)
    assert chosen
    weight, mean, square = {f: -s.prior / 2 for f in chosen}, dict.fromkeys(chosen, 0.0), dict.fromkeys(chosen, 0.0)
    for step in range(1, s.steps + 1):
        gradient = dict.fromkeys(chosen, s.price)
        for (label, _), sentences in zip(docs, cut):
            own = [[f for f in chosen if f in sentence] for sentence in sentences]
            chance = [1 / (1 + np.exp(-(s.prior + sum(weight[f] for f in fs)))) for fs in own if fs]
            none = float(np.prod([1 - min(p, 1 - 1e-12) for p in chance]))
            said = s.label_noise + (1 - 2 * s.label_noise) * (1 - none)
            slope = (1 - 2 * s.label_noise) * (1 / said if label else -1 / (1 - said)) * none
            for fs, p in zip([fs for fs in own if fs], chance):
                for f in fs:
                    gradient[f] -= slope * p
        for f in chosen:
            mean[f] = 0.9 * mean[f] + 0.1 * gradient[f]
            square[f] = 0.99 * square[f] + 0.01 * gradient[f] ** 2
            move = (mean[f] / (1 - 0.9**step)) / ((square[f] / (1 - 0.99**step)) ** 0.5 + 1e-8)
            weight[f] = max(0.0, weight[f] - s.rate * move / (1 + step / 100) ** 0.5)
    assert dict(zip(found.tolist(), weights.tolist())) == pytest.approx({name(f): w for f, w in weight.items() if w > 0.5}, rel=1e-6)


def test_fitting_moves_only_the_sample(spark):
    """The corpus is scanned and joined in many tasks; one exchange brings the sample to the fitting task."""
    docs = spark.createDataFrame([(k, f"some text {k % 7}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    plan = toxicity._sample(docs, labels, toxicity.MilSettings(), "doc_id", "text", "toxic")._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "REPARTITION_BY_NUM" in plan and plan.index("REPARTITION_BY_NUM") < plan.index("Join")


def test_licenses_equal_brute_force(spark):
    """Every template is aligned with every stretch of every document."""
    rng = random.Random(6)
    texts = {
        "long": "license to copy and to use this work in any form is given to all who ask for it and name its maker in every copy that they hand on",
        "other": "license to sell and to lend this tool in no form is given to those who ask for it but name another maker in any copy that they keep",
        "short": "Some rights reserved by many.",
        "number": "Licensed under terms version 2.",
    }

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    def brute(text):
        said, found = [w.lower() for w in re.findall("[A-Za-z0-9]+", text)], []
        for name, t in texts.items():
            wanted = [w.lower() for w in re.findall("[A-Za-z0-9]+", t)]
            spare = len(wanted) // 10 if len(wanted) > 20 else 0
            for a in range(len(said)):
                for b in range(a + len(wanted) - spare, min(len(said), a + len(wanted) + spare) + 1):
                    same = common(wanted, said[a:b])
                    if len(wanted) - same <= spare and b - a - same <= spare:
                        found.append((len(wanted) - same + b - a - same, -len(wanted), a, b, name))
        out, taken = [], set()
        for _, _, a, b, name in sorted(found):
            if not taken & set(range(a, b)):
                taken |= set(range(a, b))
                out.append((a, name))
        return [n for _, n in sorted(out)]

    def edited(t):
        words = t.split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], [words[k], "extra"], ["swapped"]]) if len(words) > 8 else words[k : k + 1]
        return " ".join(words)

    docs = ["license note. " + " ".join(rng.choice([edited(t), "filler words here", "more of it"]) for t in rng.choices(list(texts.values()), k=rng.randrange(1, 4))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for r in licenses.scan_licenses(df, texts).collect():
        assert [m.license for m in r.found] == brute(docs[r.doc_id]), docs[r.doc_id]


def test_licenses_are_decided_by_compression(monkeypatch):
    """Without the reductions other templates win; with them the bound loses no notice."""
    rng = random.Random(8)
    matcher = licenses.Matcher(licenses.templates())
    full = licenses.templates()["MIT-full"]
    noise = ["one", "license", "word", "of", "the", "copy", "rights", "and", "software"]
    texts = [full, licenses.NOTICES["BSD-3-Clause"]]
    for _ in range(120):
        base = [rng.choice(noise) for _ in range(rng.choice([5, 40, 300]))] * rng.choice([1, 1, 3])
        for _, t in rng.sample(sorted(licenses.templates().items()), rng.choice([1, 2, 3])):
            k = rng.randrange(len(base) + 1)
            base[k:k] = t.split()
        texts.append(" ".join(base))

    def found():
        return [[(m["license"], m["start"], m["end"]) for m in matcher.scan(t)[1]] for t in texts]

    as_is = found()
    assert [m[0] for m in as_is[0]] == ["MIT-full"] and [m[0] for m in as_is[1]] == ["BSD-3-Clause"]
    monkeypatch.setattr(licenses, "NOISE", 99)
    assert found() == as_is
    monkeypatch.setattr(matcher, "reductions", lambda said, names: dict.fromkeys(names, 0.0))
    assert [m[0] for m in found()[0]] != ["MIT-full"]
    monkeypatch.setattr(licenses, "NOISE", 0.1)
    monkeypatch.setattr(matcher, "reductions", lambda said, names: dict.fromkeys(names, -1.0))
    assert found() == [[]] * len(texts)


def test_spdx_lines_heads_and_long_blocks(spark):
    long = " ".join(f"license w{k}" if k % 5 == 0 else f"w{k}" for k in range(6000))
    rows = [(1, "# SPDX-License-Identifier: MIT\nx = 1"), (2, "// SPDX-License-Identifier: GPL-2.0-or-later\n"), (3, "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright"), (4, long[:20_000] + " Released under the MIT License. " + long[20_000:]), (5, "SPDX-License-Identifier: GPL-2.0"), (6, "Mozilla Public License\nVersion 2.0\n====")]
    got = {r.doc_id: (r.n_blocks, [m.license for m in r.found]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, (_, v) in got.items()} == {1: ["MIT-spdx"], 2: ["GPL-2.0-or-later-spdx"], 3: ["GPL-3.0-head"], 4: ["MIT-short"], 5: ["GPL-2.0-spdx"], 6: ["MPL-2.0-head"]}
    assert got[4][0] > 3


def test_full_license_texts(spark):
    rows = [(1, "Apache", licenses.NOTICES["Apache-2.0"]), (2, "both", textwrap.fill(licenses.NOTICES["ISC"], 60) + "\n\n" + textwrap.fill(licenses.NOTICES["Apache-2.0"], 60)), (3, "mit", licenses.templates()["MIT-full"])]
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string")
    got = {r.doc_id: r.found for r in licenses.scan_licenses(docs).collect()}
    assert {k: [m.license for m in f] for k, f in got.items()} == {1: ["Apache-2.0"], 2: ["ISC", "Apache-2.0"], 3: ["MIT-full"]}
    assert got[2][0].first_line == 0 and got[2][0].last_line < got[2][1].first_line


def test_licenses(spark, empty_docs):
    mit = licenses.NOTICES["MIT"]
    rows = [(1, "text\nLicensed under CC BY-NC 4.0.\nmore"), (2, mit.replace("sublicense", "sublicence").replace(". ", ".\n")), (3, "no notice here"), (4, None), (5, "A licence was lost. Released under the MIT License. End"), (6, "Licensed under CC BY 4.0."), (6, "Licensed under CC BY 4.0.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, found string")
    got = [(r.doc_id, sorted({m.license for m in r.found})) for r in licenses.scan_licenses(docs).collect()]
    assert sorted(got) == [(1, ["CC-BY-NC-4.0"]), (2, ["MIT"]), (3, []), (4, []), (5, ["MIT-short"]), (6, ["CC-BY-4.0"]), (6, ["CC-BY-4.0"])]
    two = next(m for r in licenses.scan_licenses(docs.filter("doc_id = 2")).collect() for m in r.found)
    assert two.missing == ["sublicense"] and "sublicence" in two.added and two.reduction > 0.5
    assert licenses.scan_licenses(empty_docs).count() == 0


def test_licenses_in_their_usual_wrapping(spark):
    texts = licenses.templates()
    wrapped = {n: "\n".join(f" * {x}" for x in textwrap.wrap(t.replace(". ", ". \n\n"), 72)) for n, t in texts.items()}
    names = sorted(texts)
    docs = spark.createDataFrame([(k, "int a;\n/*\n * Part of Tool.\n" + wrapped[n] + "\n */\nint b;\n" + "x y z\n" * 300) for k, n in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r.found for r in licenses.scan_licenses(docs).collect()}
    assert {names[k]: [(m.license, m.missing, m.added, m.first_line) for m in f] for k, f in got.items()} == {n: [(n, [], [], 3)] for n in names}


def test_licenses_by_their_real_wording(spark):
    gpl = licenses.NOTICES["GPL-3.0"]
    said = {
        "AGPL-3.0": gpl.replace("GNU General", "GNU Affero General"),
        "LGPL-3.0": gpl.replace("GNU General", "GNU Lesser General"),
        "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
        "CC-BY-4.0-deed": "This work is licensed under a Creative Commons Attribution 4.0\nInternational License.",
        "CC-BY-NC-SA-3.0-title": "available under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 United States License",
        "CC-BY-ND-2.5-deed": "It is licensed under a Creative Commons Attribution-NoDerivs 2.5 Generic License.",
        "LGPL-2.0": licenses.NOTICES["GPL-2.0"].replace("GNU General", "GNU Library General"),
        "GPL-2.0": licenses.NOTICES["GPL-2.0"].replace("This program", "This library"),
        "BSD-2-Clause": licenses.NOTICES["BSD-2-Clause"].replace("Redistributions of", "\n\n1. Redistributions of").replace("Redistributions in", "\n2. Redistributions in"),
        "": gpl.replace("version 3", "version 4"),
        "Apache-2.0-short,MIT": "Licensed under the Apache License, Version 2.0. Parts: " + licenses.NOTICES["MIT"],
    }
    names = list(said)
    docs = spark.createDataFrame([(k, said[n]) for k, n in enumerate(names)], "doc_id long, text string")
    got = {names[r.doc_id]: ",".join(sorted(m.license for m in r.found)) for r in licenses.scan_licenses(docs).collect()}
    assert got == {n: n for n in names}


def test_proximity_of_unknown_words_and_short_items(spark):
    docs = spark.createDataFrame([(1, "q w gamma e r alpha t beta y delta"), (2, "alpha " + "z " * 200 + "beta gamma delta")], "doc_id long, text string")
    items = [(1, "alpha beta mispeled gamma delta"), (2, "delta beta"), (3, "alpha beta"), (4, "alpha lost"), (5, "none of these"), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.id: r.near for r in phrase_index.search(phrase_index.build_index(docs), bench).collect()} == {1: ["1", "2", "3"], 2: ["2"]}
