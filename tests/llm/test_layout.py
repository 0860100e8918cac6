"""Filter audit, page text and the conversation trie against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import filter_audit, page_text, prefix_trie, queries
from paperloom.llm.html_blocks import Ways, read_blocks
from paperloom.llm.page_layouts import Maker

DATA = "/root/testdata/sf0.001"


def fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text) is not None)
    return sum(t << k for k, t in enumerate(tests))


@pytest.mark.parametrize("parts", [1, 7])
def test_failure_bits_equal_brute_force(spark, odd_docs, empty_docs, parts):
    rng = random.Random(3)
    header = "shared opening " * 200
    texts = [header + "".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(150)] + ["a" * k for k in range(40)] + ["HOT # TEXT"] * 120
    extra = [(rng.randrange(400), t, None, rng.choice(["en", None, "xx"]), 0, "", 0) for t in texts] + [(None, "HOT # TEXT", None, "en", 0, "", 0)] * 3
    df = odd_docs.unionByName(spark.createDataFrame(extra, odd_docs.schema)).repartition(5)
    rows = [(r.doc_id, r.text or "", r.lang or "") for r in df.collect()]
    low = {}
    for own, text, _ in rows:
        if own is not None:
            low[text] = min(low.get(text, own), own)
    expect = collections.Counter((own, part, fails(text) | (16 if own is not None and own > low[text] else 0)) for own, text, part in rows)
    got = collections.Counter()
    for r in filter_audit.failure_bits(df, parts=parts).collect():
        got[r.id, r.part, r.bits] += r.n
    assert got == expect
    assert filter_audit.audit(filter_audit.failure_bits(empty_docs), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_counts_equal_a_walk_through_the_orders(spark):
    rng = random.Random(5)
    bits = [(rng.choice([None, *range(30)]), rng.choice(["", "en"]), rng.randrange(32), rng.randrange(1, 4)) for _ in range(80)]
    marks = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(20)] + [(3, 1, 0), (None, 1, 1)]
    out = filter_audit.audit(spark.createDataFrame(bits, "id long, part string, bits long, n long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    good, toxic = ({k for k, *v in marks if v[c] == 1 and k is not None} for c in (0, 1))
    seen, shapley = {}, collections.Counter()
    for part, order in itertools.product(["", "en"], map("".join, itertools.permutations("ABCDE"))):
        left = every = [b for b in bits if b[1] == part]
        for k, f in enumerate(order):
            bit = 1 << "ABCDE".index(f)
            gone = [b for b in left if b[2] & bit]
            left = [b for b in left if not b[2] & bit]
            n = lambda rows: sum(b[3] for b in rows)
            seen[part, order, k + 1] = (n(left), n(gone), n([b for b in every if b[2] & bit]) - n(gone), n([b for b in every if b[2] == bit]), n([b for b in gone if b[0] in good]), n([b for b in gone if b[0] in toxic]))
            shapley[part, f] += n(gone)
    rows = out.collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for r in rows} == seen
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in rows) and len(rows) == len(seen)


def test_tries_and_ranges():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(9))) for _ in range(500)] + [b"q" * 3000 + bytes([k]) for k in range(99)]
    trie = filter_audit.TextTrie()
    for t in texts:
        node = trie.terminal(t)
        node.value = (node.value or 0) + 1
    assert list(trie.walk()) == sorted(collections.Counter(texts).items())
    entries = trie.frontier(64)
    assert sum(w for _, w in entries) == len(texts) and len(entries) < 80
    bounds = filter_audit.cut_ranges(entries, 8)
    held = collections.Counter(sum(b <= filter_audit.text_key(t) for b in bounds) for t in set(texts))
    assert 4 <= len(held) <= 12 and all(len(b) <= filter_audit.PREFIX + 8 for b in bounds)


def rebuilt(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    by = {c: [(r, t) for *_, r, _, t in sorted(turns)] for c, turns in by.items()}
    out = {}
    for c, turns in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = by.get(c - c % 100, [])[:h] + turns[h:]
    return out


def trie_of(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p)).encode()).hexdigest())
        for p, own in members.items()
    )


def rows_of_trie(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("height", [2, 4])
def test_trie_equals_brute_force(spark, height):
    rng = random.Random(height)
    said = ["", None, "hello", "é" * 20, "x\ny", "hello"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said), "n") for c in [*range(40), 100, 105, 130, 205, 1000, 1001, 10**12] for t in range(rng.choice([1, 2, 3, 8, 25]))]
    rows += [(3, None, "user", "first", "n"), (3, 1, "user", "tie", "n"), (3, 1, "user", "tie", "n"), (None, 0, "user", "none", "n"), *(rows[:1] * 2)]
    rows += [(c, t, "user", "all alike", "n") for c in range(2000, 2100) for t in range(3)]  # a hot way
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string").repartition(3)
    turns = prefix_trie.ordered_turns(df)
    plain = {c: None for c, *_ in rows if c is not None}
    got = rows_of_trie(prefix_trie.prefix_trie(prefix_trie.with_shared_openings(turns), height))
    convs = rebuilt([r[:4] for r in rows])
    assert convs.keys() == plain.keys()
    assert got == trie_of(convs)


def test_trie_of_one_long_conversation_and_of_nothing(spark):
    rows = [(7, t, "user", f"t{t % 3}") for t in range(130)] + [(8, t, "user", f"t{t % 3}") for t in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = {c: [("user", f"t{t % 3}") for t in range(n)] for c, n in ((7, 130), (8, 70))}
    assert rows_of_trie(prefix_trie.prefix_trie(prefix_trie.ordered_turns(df), 3)) == trie_of(convs)  # bands of bands of bands
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_openings(prefix_trie.ordered_turns(df.limit(0)))).count() == 0


@pytest.mark.parametrize(
    "html, expect",
    [
        ("", []),
        ("a < b & c", ["a < b & c"]),
        ("<p>one<p>two <b>x<br>y</b>z</p>tail<", ["one", "two x yz", "tail<"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ('<p>a<!-- <p>b --> c</p><script>var t="</p>";</script>d', ["a c", "d"]),
        ("<div><a href='x>y'>l  i</a>\n m</div>&amp;&am&copy q", ["l i m", "&&am© q"]),
        ("<p>q<a b", ["q"]),
        ("<!--", []),
        ('<p class="x>hi</p><p>z</p>', ["hi", "z"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<style>p{}</style><title>t</title><textarea>x</textarea>y<script>", ["y"]),
        ("</p></div>x</b>", ["x"]),
    ],
)
def test_blocks(html, expect):
    assert [b.text for b in read_blocks(html, Ways())] == expect


def test_blocks_of_deep_and_long_pages():
    deep = "<div class=a>" * 20_000 + "x" + "</div>" * 20_000
    assert [b.text for b in read_blocks(deep, Ways())] == ["x"]
    assert len(read_blocks("<p>a b" * 50_000, Ways())) == 50_000
    read_blocks("<a " * 30_000, Ways())
    read_blocks('<a b="' * 3_000 + ">", Ways())


@pytest.fixture(scope="module")
def labeller(spark):
    return page_text.train(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_slopes_of_the_labeller_equal_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    examples = page_text._examples([], page_text.LabellerSettings(made_pages=3))
    p = page_text.fit([], page_text.LabellerSettings(made_pages=2, rounds=1))
    p = {k: v.astype(float) + rng.normal(0, 0.05, v.shape) for k, v in p.items()}

    class NoDrop:
        def random(self, n):
            return np.ones(n)

    def loss():
        total = 0
        label = np.concatenate([e.label for e in examples])
        found = []
        for e in examples:
            way = np.stack([(p["names"][t] * w[:, None]).sum(0) for t, w in e.tokens])
            x = page_text._inputs(p, way, e.words, e.extra.astype(float))
            h, _ = page_text._run(p, x, np.array([len(e.label)]))
            found.append(h @ p["out"] + p["bias"])
        y = page_text._sigmoid(np.concatenate(found))
        total -= np.mean(label * np.log(y) + (1 - label) * np.log(1 - y))
        return total

    slopes = page_text._slopes(p, examples, NoDrop())
    for name in ("out", "bias", "fore_wx", "aft_wh", "fore_b", "names", "words"):
        at = np.unravel_index(np.argmax(np.abs(slopes[name])), p[name].shape)
        p[name][at] += 1e-5
        up = loss()
        p[name][at] -= 2e-5
        down = loss()
        p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-3 * max(0.01, abs(slopes[name][at])), name


def test_main_text_of_given_pages(spark, labeller):
    """Articles as their own tags mark them, read by regular expressions."""
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in page_text.extract(pages, labeller).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", inside)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_main_text_of_unseen_layouts(labeller):
    """At least 99 of 100 blocks of layouts made with other seeds and words, and hand-written pages."""
    import numpy as np

    def labels(html):
        ways = Ways()
        blocks = read_blocks(html, ways)
        expect = [Maker.MARK in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(Maker.MARK, "").strip() or "x"
        x = page_text._inputs(labeller, page_text.WayVectors(labeller["names"]).of(ways)[[b.way for b in blocks]], page_text.word_buckets(blocks), page_text.measures(blocks))
        return blocks, expect, (page_text._label(labeller, x, np.array([len(blocks)])) >= 0.5).tolist()

    maker = Maker(77, ["Other words stand here, as many as there are.", "Und noch ein Satz mit anderen Wörtern."])
    right = total = 0
    for _ in range(200):
        _, expect, got = labels(maker.page())
        right += sum(a == b for a, b in zip(expect, got))
        total += len(got)
    assert right >= 0.99 * total
    m = Maker.MARK
    page = f"""<body><header id="top"><a href="/">My Site</a><p>All the news</p></header><div class="nav-bar"><a href=1>Home</a> <a href=2>About</a></div>
    <div id="main-col"><div class="breadcrumbs"><a href="/">Home</a> &gt; News</div><h1>{m}Big story</h1><p>{m}First &amp; foremost, this is a paragraph of the story with words.</p><div class="ad-unit">Buy now cheap things here</div>
    <p>{m}Second paragraph with <a href=x>a link</a> inside of it and more.</p><ul><li>{m}point one</li><li>{m}point two</li></ul></div>
    <div id="right-sidebar"><h3>Related stories</h3><ul><li><a href=a>Other story title</a></li></ul></div>
    <section id="comments"><h2>3 Comments</h2><div class="comment"><b>Ann</b><p>I really liked this article, it was well written and had good points.</p></div><form><label>Your name</label><button>Send</button></form></section>
    <div class="cookie-consent-banner">We use cookies. <button>Accept</button></div><footer>© 2024 My Site. All rights reserved.</footer></body>"""
    blocks, expect, got = labels(page)
    assert got == expect, [(b.text, e, g) for b, e, g in zip(blocks, expect, got) if e != g]


def test_pages_with_odd_rows(spark, labeller):
    rows = [(1, "u", None, 3), (1, "u", "", 3), (None, None, "<article><p>Some words of a text, and more of them.</p></article>", 4), (2, "v", "<nav><a href=x>Menu</a></nav>", 0)] * 2 + [(5, "w", "<article>" + "<p>Word after word.</p>" * 3000 + "</article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = page_text.extract(df, labeller).collect()
    assert sorted(r.n_main for r in got) == [0] * 6 + [1, 1, 3000]
    assert [r.text for r in got if r.page_id is None] == ["Some words of a text, and more of them."] * 2
    assert page_text.extract(df.limit(0), labeller).count() == 0


def test_registered_queries(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    assert queries.op12_page_text(spark, DATA).filter("n_chars > 0").count() == pages.count()
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    audit = queries.op11_filter_audit(spark, DATA)
    assert audit.count() == 600 * documents.select(F.coalesce("lang", F.lit(""))).distinct().count()
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    assert rows_of_trie(queries.op13_prefix_trie(spark, DATA)) == trie_of(rebuilt(rows))
