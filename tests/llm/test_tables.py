"""Chat, WARC and secret operators, and the registered queries."""

import base64
import collections
import hashlib
import random
import re
import secrets as random_bytes
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from paperloom.llm import chat, queries, secrets, warc

DATA = "/root/testdata/sf0.001"


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<\\s>", "<<SYS>>\\\\[/INST]", "[INST", "<", "/s>", "", None, "a" * 50_000, "<|role|>x<|text|>y<|end|>", "é\n中"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(nasty), "x") for c in range(12) for t in range(rng.randrange(1, 150))]
    rows += [(1, None, "user", "null turn", "x"), (1, -200, "system", "early", "x"), (1, -70, "user", "", "x"), (None, 0, "user", "no id", "x"), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        learnt = "".join(x for *_, r, x in turns if r == "assistant")
        r = got[c]
        assert r.ends_well == (turns[-1][2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert all(r.n_bad == got[r.conv_id].n_bad and r.ends_well == got[r.conv_id].ends_well for r in chat.validate_turns(formatted).collect())
    checks = {r.conv_id: r.n_bad for r in chat.validate_turns(formatted).collect()}
    allowed = chat.ChatTemplate().turns
    for c, turns in by.items():
        states = ["", *(r for *_, r, _ in turns)]
        assert checks[c] == sum(b not in allowed.get(a, ()) for a, b in zip(states, states[1:]))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_the_machine_runs_over_slim_rows(spark):
    """The registered query's plan has the machine's window, and no texts under it."""
    plan = queries.op5_chat_formatting(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("Window [lag(")
    assert "text" not in plan[at:].split("Union")[0].split("Relation")[0]


def test_texts_hold_no_control_strings(spark):
    from pyspark.sql import functions as F

    texts = ["<s></s>", "[INST][/INST]", "<<SYS>> <</SYS>>", "<|end|><|text|><|role|>", "<<s>"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(chat.escape(F.col("t"))).collect()]
    assert not any(c in t for t in out for c in chat.ChatTemplate().controls())


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_warc_round_trip(spark, chunk):
    rng = random.Random(1)
    rows = [(i, None if i % 5 == 0 else f"http://x/{i}\n", bytes(rng.choice([13, 10, 65, 255, 0]) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(1000, None, b"\r\n\r\n"), (1001, "u", b"\r\n\r\n\r\n\r\n"), (1002, "u", None), (None, "u", b"zz"), (None, "u", b"zz"), (1003, "u", b""), (1004, "u", b"\r\r\n\r\n"), (1005, "u", b"WARC/1.1\r\n" * 50), (7, "u", rows[7][2])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html binary, payload string").repartition(3)
    path = warc.write_archives(pages, chunk_bytes=chunk)
    got = warc.read_records(spark, path, chunk).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or b""] = min(i, first.get(h or b"", i))
    payload = {i: h or b"" for i, _, h in rows}
    for r in got:
        h = payload[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        if r.page_id is not None:
            assert (r.record_type, r.refers_to) == (("response", None) if first[h] == r.page_id else ("revisit", first[h]))
    body = collections.defaultdict(bytes)
    for r in sorted((r for r in warc.read_chunks(spark, path, chunk).filter("not is_end").collect()), key=lambda r: r.chunk_no):
        assert len(r.data) <= max(chunk, 1)
        body[r.record_id] += r.data
    assert all(body[f"urn:page:{i}"] == payload[i] for i in first.values() if i != 7)
    assert warc.read_records(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read_records(spark, warc.write_archives(pages, min_revisit_bytes=3)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_secret_spans(spark):
    rule = re.compile(secrets.ASSIGN.replace("(?i)", "", 1), re.I | re.A)
    rng = random.Random(4)
    pieces = ['password: "hunter2hunter2"', "token=token:abcdefghi", "API_KEY = 0123456789", "secret:short", "AKIA" + "A1" * 8, "AKIA12", "deadbeef" * 5, "abc", "é中", "\n", "x" * 30, "passwd=aaaaaaaa=bb"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", " ".join(pieces) * 200]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, base string")
    for r in secrets.find_secrets(docs).collect():
        t = texts[r.doc_id] or ""
        expect = [(m.start(), 0, "assign", m.end()) for m in rule.finditer(t) if len(m[2]) >= 8]
        expect += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        expect += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [tuple(s) for s in r.base] == sorted(expect)
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_battery_tells_random_from_structured(spark):
    rng = random.Random(9)
    random_tokens = [base64.b64encode(random_bytes.token_bytes(30)).decode().rstrip("=") + "1a" for _ in range(40)]
    structured = ["1a" * 20, "abcdefghij0123456789" * 2, "a" * 30 + "1"] + ["".join(rng.choice("etaoin1") for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in enumerate(random_tokens + structured)], "doc_id long, text string")
    found = {r.doc_id for r in secrets.find_secrets(docs).collect() if any(s.kind == "random" for s in r.spans)}
    assert len(found & set(range(40))) >= 34 and not found - set(range(40))


def test_error_shares_of_the_battery(spark):
    """Planted random and structured tokens of several lengths: what is reported and what is lost."""
    rng = random.Random(12)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"]
    syllables = ["the", "ing", "er", "an", "re", "on", "at", "en", "nd", "st"]
    rows = []
    for k in range(900):
        n, letters = rng.choice([20, 24, 31]), rng.choice(alphabets[1:])
        rows.append((k, "".join(rng.choice(letters) for _ in range(n - 2)) + "a1" if letters != alphabets[1] else "".join(rng.choice(letters) for _ in range(n - 2)) + "A2"))
    for k in range(900, 1800):
        n = rng.choice([24, 40, 70])
        word = "".join(rng.choice(syllables) for _ in range(n))[: n - 2] + str(rng.randrange(10, 99))
        rows.append((k, word))
    df = spark.createDataFrame([(k, f"see {t} .") for k, t in rows], "doc_id long, text string")
    out = secrets.find_secrets(df).collect()
    found = {r.doc_id for r in out if any(s.kind == "random" for s in r.spans)}
    reported = [k for k in found]
    false = sum(k >= 900 for k in reported) / len(reported)
    kept = sum(k < 900 for k in reported) / 900
    assert false <= 0.05 and kept >= 0.9
    p = sorted(t.test.p_uniform for r in out if r.doc_id < 900 for t in r.tested)
    for share in (0.01, 0.05, 0.2):  # p-values of random tokens keep their level
        assert sum(x <= share for x in p) / len(p) <= 1.6 * share + 0.01


def test_registered_queries_on_given_tables(spark):
    """op1, op3, op4 and op8 on the smallest tables against their contracts, document by document."""
    from tokenizers import Tokenizer

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    text = dict(docs)
    tokenizer, start = Tokenizer.from_str(queries.tokenizer_json()), 0
    stored = {r.doc_id: r for r in queries.op3_token_store(spark, DATA).collect()}
    for d, t in docs:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        r = stored[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)

    scored = queries.op4_toxicity(spark, DATA).collect()
    assert {r.doc_id: r.held_out for r in scored} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in text}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)

    rule = re.compile(secrets.ASSIGN.replace("(?i)", "", 1), re.I | re.A)
    for r in queries.op8_secret_scan(spark, DATA).collect():
        t = text[r.doc_id]
        base = [(m.start(), 0, "assign", m.end()) for m in rule.finditer(t) if len(m[2]) >= 8]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        names = [f"{k}:{a}:{b}" for a, _, k, b in sorted(base)]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest() and set(names) <= set(r.spans.split(","))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[2] == k for x in base) for k in ("assign", "access", "hex")]

    plain = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT-short", "Licensed under the Apache License, Version 2.0.": "Apache-2.0-short"}
    for r in queries.op1_license_scan(spark, DATA).collect():
        assert {n for s, n in plain.items() if s in text[r.doc_id]} <= set(r.licenses.split(","))


def test_queries_are_registered():
    names = {m[1] for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n))}
    assert names == {str(k) for k in range(1, 14)} and set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


def test_pipeline_on_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    assert out and sorted(r.start for r in out)[0] == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DATA)
        assert after.columns == docs.columns
        kept = after
    assert sum(r.n_tokens for r in out) > 0 and len(out) == kept.count()


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_pipeline_with_odd_rows_and_clashing_columns(spark):
    """Every stage with nulls in all columns, repeated rows, long and empty texts, and extra columns
    named like the operators' own."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(None, None, None, None, None), (None, None, None, None, None), (7, "", "en", "x", 0), (8, " \n", None, None, None), (9, "long words " * 60_000, "en", None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(5))
    names = ["order", "member", "copy", "copies", "gone", "size", "target", "taken", "source_size", "row", "n", "id", "body", "score", "component_id", "n_hit", "key", "a b", "c0", "text_key", "doc"]
    docs = docs.withColumns({n: F.lit(k) if k % 2 else F.lit(None).cast("string") for k, n in enumerate(names)})
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DATA)
        assert after.columns == docs.columns, name
        assert after.filter("size is null").count() == 0 and after.filter("`order` is not null").count() == 0
        assert after.count() > 0
        kept = after
    assert corpus_pipeline.STAGES[-1][1](spark, kept, DATA).count() == kept.count()


def test_pipeline_equals_a_brute_force_version(spark):
    """Near copies, contaminated and repeated rows of a small table, stage by stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = r"[^\x20\x09-\x0D]+"
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    ids = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    def shingles(t):
        w = re.findall(words, low(t))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for k in range(len(rows)):
        for j in range(k):
            if sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= 75 * len(sets[k] | sets[j]) and group[k] != group[j]:
                lo, hi = sorted((group[k], group[j]))
                group = [lo if g == hi else g for g in group]
    assert ids(corpus_pipeline.drop_near_duplicates(spark, docs, DATA)) == [rows[k] for k in range(len(rows)) if group[k] == k]

    letters = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = re.findall(letters, low(r.text))
        for k in range(max(min(len(w), 1), len(w) - 9)):
            windows[len(w[k : k + 10])].add(tuple(w[k : k + 10]))

    def clean(t):
        w = re.findall(letters, low(t))
        return not any(tuple(w[k : k + n]) in own for n, own in windows.items() for k in range(len(w) - n + 1))

    left = [x for x in rows if clean(x[1])]
    assert 0 < len(left) < len(rows)
    assert ids(corpus_pipeline.drop_contaminated(spark, docs, DATA)) == left

    mixed = collections.Counter(ids(corpus_pipeline.mix(spark, docs, DATA)))
    taken = {r.doc_id: r.taken for r in queries.op2_mix_sources(spark, DATA).collect()}
    assert {d: n * len(re.findall(words, t or "")) for (d, t), n in mixed.items()} == {d: n for d, n in taken.items() if n}


def test_pipeline_judges_rows_not_ids(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "pqr")
    texts = [(None, a), (None, a), (None, b), (3, b), (3, b), (2, b + " end"), (None, item), (None, c), (5, item), (5, c), (None, None), (None, "")]
    odd = spark.createDataFrame([(k, t, "en", "x", 1) for k, t in texts], docs.schema)

    def left(stage):
        return collections.Counter((r.doc_id, r.text) for r in stage(spark, odd, DATA).collect())

    assert left(corpus_pipeline.drop_contaminated) == collections.Counter(x for x in texts if x[1] != item)
    assert left(corpus_pipeline.drop_near_duplicates) == collections.Counter([(None, a), (2, b + " end"), (5, item), (5, c), (None, None), (None, "")])
    more = DATA.replace("0.001", "0.01")  # the smallest tables have too few labels for a toxic document
    docs = spark.read.parquet(f"{more}/documents.parquet")
    bad = docs.exceptAll(corpus_pipeline.drop_toxic(spark, docs, more)).orderBy("doc_id").first().text
    mixed = docs.filter("doc_id is not null").union(spark.createDataFrame([(None, bad, "en", "x", 1), (None, a, "en", "x", 1)], docs.schema))
    kept = corpus_pipeline.drop_toxic(spark, mixed, more).filter("doc_id is null").collect()
    assert [r.text for r in kept] == [a]
