"""Rules of single operators on small fixtures, and what a plan may hold."""

import ast
import math
import pathlib
import random
import re
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from paperloom.functions import codepage, fold, ranks, registry
from paperloom.operators import classify, notes, pages, quality, render, report, structure, text, timeline
from paperloom.sources import archive

ROOT = pathlib.Path(__file__).parent.parent / "paperloom"


def test_as_of_equals_brute_force(spark):
    targets = [(d, p) for d in range(3) for p in range(0, 20, 3)]
    marks = [(d, p, p * 10) for d in range(2) for p in range(1, 20, 4)]
    out = timeline.state_at(spark.createDataFrame(targets, "doc int, pos int"), spark.createDataFrame(marks, "doc int, pos int, value int"))
    for r in out.collect():
        before = [v for d, p, v in marks if d == r.doc and p <= r.pos]
        assert r.state == (before[-1] if before else None)


def test_change_log_keeps_changes_only(spark):
    marks = spark.createDataFrame([(1, k, "PN", v) for k, v in enumerate([1, 1, 2, 2, 1])], "doc int, pos int, name string, value int")
    assert [r.pos for r in timeline.change_log(marks, "PN").orderBy("pos").collect()] == [0, 2, 4]
    assert [r.pos for r in timeline.change_log(marks, "PN", seed=1).orderBy("pos").collect()] == [2, 4]


def test_every_line_on_one_page_and_pages_rise(spark):
    rows = [(1, k, 0, k % 7, k % 19 == 0) for k in range(200)]
    out = pages.paginate(spark.createDataFrame(rows, "doc int, bi int, li int, cost int, forced boolean"), 20).orderBy("bi").collect()
    assert len(out) == 200
    assert all(b.page - a.page in (0, 1) for a, b in zip(out, out[1:]))


def test_wrap_words_is_greedy(spark):
    df = spark.createDataFrame([(1, "aa bb  cc verylongword d"), (2, "")], "doc int, text string")
    got = [(r.doc, r.row, r.text) for r in pages.wrap_words(df, 5).orderBy("doc", "row").collect()]
    assert got == [(1, 0, "aa bb"), (1, 1, "cc"), (1, 2, "verylongword"), (1, 3, "d"), (2, 0, "")]


def test_nesting_as_a_stack(spark):
    """Columns 2 4 4 6 2 stand in containers 2 4 4 6 2; other rows take the level they stand in."""
    rng = random.Random(6)
    rows = [(1, 0, k, c, True) for k, c in enumerate([2, 4, 4, 6, 2])]
    rows += [(2, n // 25, n, rng.randrange(8), rng.random() < 0.6) for n in range(200)]
    out = structure.nesting_level(spark.createDataFrame(rows, "doc int, island int, li long, col int, item boolean"), item=F.col("item"))
    got = {(r.doc, r.li): (r.level, r.container) for r in out.collect()}
    expect, stack, place = {}, [], None
    for doc, island, li, col, item in rows:
        if (doc, island) != place:
            stack, place = [], (doc, island)
        while stack and col < stack[-1]:
            stack.pop()
        if item and (not stack or stack[-1] != col):
            stack.append(col)
        expect[doc, li] = (len(stack), stack[-1] if stack else None)
    assert got == expect
    assert [got[1, k][1] for k in range(5)] == [2, 4, 4, 6, 2]


def test_margin_of_soft_lines_only(spark):
    rng = random.Random(2)
    rows = [(d, k, "x" * rng.randrange(1, 150) if rng.random() < 0.9 else "  ", rng.choice(["soft", "hard", "eof"])) for d in range(8) for k in range(rng.choice([1, 9, 10, 11, 57]))]
    rows += [(99, 0, "y" * 120, "hard")]
    got = {r.doc: r.margin for r in structure.wrap_margin(spark.createDataFrame(rows, "doc int, li long, text string, terminator string")).collect()}
    for d in {r[0] for r in rows}:
        sizes = sorted(len(t.rstrip()) for doc, _, t, term in rows if doc == d and term == "soft" and t.strip())
        assert got[d] == max(65, sizes[int(len(sizes) * 0.9)] if sizes else 0)


def test_verse_line_by_line(spark):
    runs = {
        "box": ["╔═══╗", "║ a caption ║", "╚═══╝"],
        "one graphic row": ["╔═══╗"],
        "dashes are no graphic": ["-----", "-----", "=== ==="],
        "poem": ["the sea", "the sky", "and I."],
        "prose": ["One.", "Two.", "Three.", "four"],
        "quotes": ["“Go,” she said", "“Stay”", "so they did"],
        "few quotes among unlettered lines": ["“Go” she said", "what", "then", "1234", "5678", "99"],
        "shifted": ["One.", "Two.", "Three.", "four", "Five.", "Six."],
        "blank": ["", " "],
    }
    rows = [(name, k, t, name == "shifted") for name, lines in runs.items() for k, t in enumerate(lines)]
    out = structure.verse_test(spark.createDataFrame(rows, "run string, li long, text string, sh boolean"), ["run"], shifted=F.col("sh"))

    def plain(lines, shifted):
        full = [t for t in lines if t.strip()]
        letters = [t for t in full if any(c.isalpha() for c in t)]
        if len(full) >= 2 and sum(t not in letters and any(c in structure.GRAPHIC for c in t) for t in full) / len(full) >= 0.5:
            return True
        if len(letters) < 2:
            return False
        quotes = sum(t.lstrip()[0] in structure.OPENING and any(c in structure.CLOSING for c in t.lstrip()[1:]) for t in letters)
        ends = sum(t.rstrip().rstrip(structure.CLOSING)[-1:] in (".", "!", "?") for t in letters) / len(letters)
        return quotes / len(letters) < 1 / 3 and ends < 0.9 and (shifted or ends < 0.8)

    assert {r.run: r.is_verse for r in out.collect()} == {name: plain(lines, name == "shifted") for name, lines in runs.items()}


def test_collisions_of_untagged_footnotes_and_endnotes(spark):
    rows = [(1, 0, "footnote", "5", "5"), (1, 1, "annotation", None, "2"), (1, 2, "annotation", None, "2"), (1, 3, "footnote", None, "5")]
    rows += [(2, 0, "footnote", None, "1"), (2, 1, "footnote", "*", "*"), (2, 2, "footnote", None, "1"), (2, 3, "endnote", None, "4"), (2, 4, "endnote", None, "7"), (2, 5, "footnote", None, "9")]
    out = notes.collision_renumber(spark.createDataFrame(rows, "doc int, idx int, kind string, tag string, label string"))
    got = {(r.doc, r.idx): r.label for r in out.collect()}
    assert [got[1, k] for k in range(4)] == ["5", "2", "2", "5"]
    assert [got[2, k] for k in range(6)] == ["1", "*", "2", "4", "7", "3"]


def test_line_numbers_start_again_where_the_interval_changes(spark):
    steps = [None, None, None, 2, 2, 2, None, 0, 1, 1, 2, 2]
    rows = [(1, p, k, s) for p in (1, 2) for k, s in enumerate(steps)]
    got = {(r.page, r.line): r.label for r in timeline.line_numbers(spark.createDataFrame(rows, "doc int, page int, line int, step int"), "step").collect()}
    for p in (1, 2):
        now, k = None, 0
        for n, s in enumerate(steps):
            if s != now:
                now, k = s, 0
            assert got[p, n] == (k // s + 1 if s and k % s == 0 else None)
            k += 1


def test_timelines_with_their_seeds(spark):
    marks = [(1, 1, 0, "OP", None), (1, 2, 0, "PN", 7), (1, 2, 1, "PN", 8), (1, 3, 0, "OP", 0), (1, 4, 0, "PG", 5), (1, 5, 0, "PG", 5), (1, 6, 0, "MB", 8), (1, 7, 0, "MT", 4), (1, 8, 0, "PL", 66), (1, 9, 0, "POE", 8), (1, 10, 0, "POE", 8), (1, 11, 0, "PO", None), (1, 12, 0, "L#", 2), (2, 1, 0, "PL", 70)]
    page = [(1, "page_length", 50, None), (2, "page_length", 51, None), (1, "top_bottom", 3, 9), (3, "offset", 1, None), (3, "page_start", 4, None)]
    out = timeline.all_timelines(spark.createDataFrame(marks, "doc int, pos int, seq int, name string, value int"), spark.createDataFrame(page, "doc int, timeline string, v0 int, v1 int"), order=["pos", "seq"])
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.pos or 0, r.seq or 0)):
        got.setdefault((r.doc, r.timeline), []).append((r.pos, r.v0, r.v1))
    assert got[1, "auto_number"] == [(None, 1, None), (1, 0, None), (2, 1, None), (3, 0, None), (4, 1, None)]
    assert got[1, "page_start"] == [(None, 1, None), (2, 8, None)]  # the later of two at one place
    assert got[1, "top_bottom"] == [(None, 3, 9), (6, 3, 8), (7, 4, 8)]
    assert got[1, "page_length"] == [(None, 50, None)]  # a command that repeats the seed makes no entry
    assert got[2, "page_length"] == [(None, 66, None), (1, 70, None)]
    assert got[1, "even_offset"] == [(9, 8, None)] and (1, "odd_offset") not in got
    assert got[1, "offset"] == [(None, 8, None)] and got[3, "offset"] == [(None, 1, None)]
    assert got[3, "page_start"] == [(None, 4, None)]
    assert got[1, "line_interval"] == [(None, None, None), (12, 2, None)]


def test_markup_is_matched_like_brackets(spark):
    bodies = ["<b><i>x</b></i>", "<p>a</p>", "</a><b></b>", "<p>x<br><img src='a'/></p>", "<p class=x>&nbsp;&foo; a < b</p><B></b>", "<!-- <p> --><div>", "", "<a></a></a></a><a>", "<x><y></x></y></x>"]
    rng = random.Random(9)
    bodies += ["".join(rng.choice(["<a>", "</a>", "<b>", "</b>", "<c/>", "t"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = [(k, f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)] + [(-1, "no page"), (-2, None)]
    got = {}
    for r in quality.well_formed_tags(spark.createDataFrame(rows, "doc int, text string")).collect():
        got.setdefault(r.doc, set()).add((r.place, r.tag, r.problem))
    assert got[-1] == got[-2] == {(0, "", "no body")}
    assert got[0] == {(3, "b", "other name"), (4, "i", "other name")} and 1 not in got and 3 not in got
    assert got[4] == {(1, "p", "bad tag"), (3, "", "bad reference"), (4, "", "stray sign"), (7, "b", "other name")}
    for k, body in enumerate(bodies):
        if k in (3, 4, 5):
            continue
        stack, expect = [], set()
        for n, t in enumerate(re.findall(r"</?[a-zA-Z]/?>", body), 1):
            name = t.strip("</>")
            if t.endswith("/>"):
                continue
            if not t.startswith("</"):
                stack.append((n, name))
            elif not stack:
                expect.add((n, name, "never opened"))
            elif stack.pop()[1] != name:
                expect.add((n, name, "other name"))
        expect |= {(n, name, "never closed") for n, name in stack}
        assert got.get(k, set()) == expect, body


def test_scene_stops_at_the_next_anchor_and_at_most(spark):
    lines = ["x", "1 INT. ROOM", "a", "b", "EXT. STREET", "c", "d", "e", "f"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "doc int, bi int, text string")
    out = structure.scene_regions(df, F.col("text").rlike(structure.SLUGLINE), F.lit(False), most=3)
    assert [(r.bi, r.scene) for r in out.orderBy("bi").collect()] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 4)]


def test_profile_of_bytes(spark):
    df = spark.createDataFrame([(1, "ab\x8d\ncd\r\n\x1b\x82\x1c")], "doc int, chars string")
    r = classify.byte_profile(df).first()
    assert (r["size"], r.soft_returns, r.hard_returns, r.high_bit) == (11, 1, 1, 2)
    assert r.text_pct == 100 * (7 + 2) // 11


def test_true_end(spark):
    df = spark.createDataFrame([("ab" + "\x1a" * 9,), ("a\x1ab",), ("a\x1b\x1a\x1cb",), ("ab",)], "c string")
    assert [r[0] for r in df.select(classify.true_end(F.col("c"))).collect()] == [2, 1, 5, 2]


def test_frames_are_counted_not_bytes(spark):
    good = "\x1d\x05\x00ab\x05\x00\x1d"
    rows = [(1, good), (2, good + good), (3, "\x1d x \x1d"), (4, "\x1b\x1d\x1c"), (5, "\x1d\x05\x00ab\x06\x00\x1d")]
    out = classify.framed_block_count(spark.createDataFrame(rows, "doc int, chars string"))
    assert {r.doc: r.blocks for r in out.collect()} == {1: 1, 2: 2, 3: 0, 4: 0, 5: 0}


def test_code_page_round_trip(spark):
    df = spark.createDataFrame([("".join(map(chr, range(32, 256))),)], "c string")
    r = df.select((codepage.encode_cp437(codepage.decode_cp437(F.col("c"))) == F.col("c")).alias("same"), codepage.encode_cp437(F.lit("a漢")).alias("lost")).first()
    assert r.same and r.lost == "a?"


def test_records(spark):
    df = spark.createDataFrame([(1, 0, '"a, b","c",3'), (1, 1, '"d","e",4'), (2, 0, "plain"), (2, 1, ".pn 4")], "doc int, li int, text string")
    assert archive.read_record_list(df).filter("doc = 1 and record = 0").first().fields == ["a, b", "c", "3"]
    assert {r.doc: r.is_list for r in classify.detect_record_lists(df).collect()} == {1: True, 2: False}


def test_html_entities_in_order(spark):
    df = spark.createDataFrame([("<html><body><p>a &amp;lt; b</p>c<br>d</body></html>",)], "h string")
    assert df.select(text.html_to_text(F.col("h"))).first()[0] == "\na &lt; b\nc\nd"


def test_drift_states(spark):
    s = "doc int, format string, mode string, sha256 string, bytes int, source_sha256 string"
    left = spark.createDataFrame([(k, "t", "m", "x", 1, "s") for k in range(4)], s)
    right = spark.createDataFrame([(0, "t", "m", "x", 1, "s"), (1, "t", "m", "y", 1, "s"), (2, "t", "m", "y", 1, "r"), (9, "t", "m", "x", 1, "s")], s)
    assert {r.doc: r.state for r in quality.drift(left, right).collect()} == {0: "same", 1: "changed", 2: "source changed", 3: "missing", 9: "new"}


def test_batches_rank_without_one_task(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "k")
    got = [r.batch for r in report.batches_of(df, 20, "k", bins=7).orderBy("k").collect()]
    assert got == [k // 20 + 1 for k in range(len(got))]


def test_batches_of_clustered_keys(spark):
    """Keys in two far ranges still fill many bins."""
    keys = [*range(500), *range(10**12, 10**12 + 700)]
    got = [r.batch for r in report.batches_of(spark.createDataFrame([(k,) for k in keys], "k long"), 20, "k", bins=16).orderBy("k").collect()]
    assert got == [k // 20 + 1 for k in range(len(keys))]


def test_names_are_unique_as_if_taken_one_by_one(spark):
    rng = random.Random(3)
    for extension, first, separator, fold_case in ((".md", 2, " ", True), (".png", 1, "-", False)):
        stems = [rng.choice(["A", "a", "B", "C"]) + "".join(separator + str(rng.choice([1, 2, 3, 10])) for _ in range(rng.choice([0, 0, 0, 1, 2]))) for _ in range(150)]
        held = [rng.choice(["A", "b", "D"]) + "".join(separator + str(rng.randrange(1, 9)) for _ in range(rng.choice([0, 1, 1]))) for _ in range(20)]
        fold = str.lower if fold_case else str
        taken, expect = {fold(h) for h in held}, []
        for s in stems:
            name, n = s, first
            while fold(name) in taken:
                name, n = f"{s}{separator}{n}", n + 1
            taken.add(fold(name))
            expect.append(name + extension)
        names = spark.createDataFrame(list(enumerate(stems)), "k int, stem string")
        for existing in (spark.createDataFrame([(h,) for h in held], "stem string"), None):
            out = render.unique_names(names, "stem", extension, "k", existing, separator=separator, first=first, fold_case=fold_case).orderBy("k").collect()
            assert len({fold(r.name) for r in out}) == len(stems)
            assert existing is None or [r.name for r in out] == expect


def test_names_of_a_large_family(spark):
    """20,000 names of one family, and one stem of 30,000 rows, in seconds."""
    stems = [["A", "A 2", "A 2 2", "A 3"][k % 4] for k in range(20_000)] + ["B"] * 30_000
    began = time.time()
    out = {r.k: r.name for r in render.unique_names(spark.createDataFrame(list(enumerate(stems)), "k int, stem string"), "stem", ".md", "k").collect()}
    assert time.time() - began < 60
    assert len(set(out.values())) == len(stems)
    assert [out[k] for k in (0, 1, 2, 3, 4, 5, 20_000, 20_001, 49_999)] == ["A.md", "A 2.md", "A 2 2.md", "A 3.md", "A 4.md", "A 2 3.md", "B.md", "B 2.md", "B 30000.md"]


def test_exact_sums(spark):
    rng = random.Random(7)
    groups = {
        0: [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(3000)],
        1: [1e300, 1.0, -1e300, 1e-300] * 50,
        2: [0.1] * 10,
        3: [5e-324, 5e-324, -1e-310, 2.2250738585072014e-308],
        4: [1.7976931348623157e308, 1.7976931348623157e308, -1.7976931348623157e308],
        5: [2.0**53, 1.0, 2.0**-60],
        6: [0.0, -0.0, None],
        7: [None, None],
        8: [1.0, math.inf],
        9: [math.inf, -math.inf, 2.0],
        10: [math.nan, 1.0],
        11: [1.7976931348623157e308] * 2,
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [(None, 1.5), (None, 2.5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, v double")
    for parts in (1, 7):
        got = {r.g: r.total for r in report.exact_total(df.repartition(parts), "v", "g").collect()}
        for g in range(7):
            assert got[g] == float(sum(Fraction(v) for v in groups[g] if v is not None)), g
        assert got[7] is None and got[8] == math.inf and math.isnan(got[9]) and math.isnan(got[10]) and got[11] == math.inf and got[None] == 4.0


def test_ranks_in_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), k) for k in rng.sample(range(10**6), 900)]
    out = ranks.rank_in(spark.createDataFrame(rows, "g string, o long"), ["g"], "o", "n", bins=16)
    assert {(r.g, r.o): r.n for r in out.collect()} == {(g, o): n for key in ("a", "b", None) for n, (g, o) in enumerate(sorted(x for x in rows if x[0] == key), 1)}


def test_first_pages_equal_the_full_run(spark):
    rng = random.Random(12)
    rows = [(d, k // 9, k % 9, rng.choice([0, 1, 2, 5, 30]), rng.random() < 0.05, rng.choice([None, 1, 1, 3, 6]), rng.random() < 0.1, rng.choice([10, 14])) for d in range(12) for k in range(rng.choice([3, 40, 400]))]
    df = spark.createDataFrame(rows, "doc int, bi int, li int, cost int, forced boolean, keep int, blank boolean, room int")
    how = {"plain": {}, "looking ahead": {"keep": F.col("keep")}, "blanks": {"blank": F.col("blank")}, "both": {"keep": F.col("keep"), "blank": F.col("blank")}}
    for extra in how.values():
        for n in (1, 3):
            full = {tuple(r) for r in pages.paginate(df, F.col("room"), **extra).filter(F.col("page") <= n).select("doc", "bi", "li", "page").collect()}
            assert {tuple(r) for r in pages.first_pages(df, n, F.col("room"), **extra).select("doc", "bi", "li", "page").collect()} == full
    plain = [(1, k, 0, 1, False) for k in range(5000)]
    assert pages.page_prefix(spark.createDataFrame(plain, "doc int, bi int, li int, cost int, forced boolean"), 2, 10).count() == 21


def test_spaces_after_a_stop_over_span_borders(spark):
    rng = random.Random(13)
    lines = [["End.", "  Next"], ["End. ", " ", " x"], ["a", "  ", "b"], ["Oh?", "", " ", "", "  y"], ["x.  ", "  ", "  "], [None, ". ", " z"], ["  lead.", "   "], ["tab.\t", "  k"]]
    lines += [["".join(rng.choice("ab. !\t") for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 7))] for _ in range(200)]
    rows = [(n, k, t) for n, line in enumerate(lines) for k, t in enumerate(line)]
    out = text.single_sentence_spans(spark.createDataFrame(rows, "doc int, li int, text string"), ["doc"]).collect()
    got = {(r.doc, r.li): r.text for r in out}
    for n, line in enumerate(lines):
        stop = seen = False
        for k, piece in enumerate(line):
            kept = ""
            for c in piece or "":
                if c != " ":
                    stop, seen = c in ".?!", False
                    kept += c
                elif not (stop and seen):
                    seen = stop
                    kept += c
            assert got[n, k] == (None if piece is None else kept), (line, k)
    assert got[0, 1] == " Next"


def test_marks_go_over_whole_runs(spark):
    b, i, u, s = 1, 2, 4, 32
    lines = [
        ([("alpha", s), ("beta", s | b), ("gamma", s)], "~~alpha**beta**gamma~~"),
        ([("a ", b), (" b", b)], "**a  b**"),
        ([("a", b), ("b", b | i), ("c", i)], "**a*b****c*"),  # runs that cross: the inner one is cut
        ([("one", b), (" ", b), ("two", b)], "**one** **two**"),
        ([(" x ", u), ("y", 0)], " <u>x</u> y"),
        ([("w", b), ("7", 64 | b), ("v", b)], "**w**[^7]**v**"),
        ([("p*q", 0)], r"p\*q"),
    ]
    rows = [(n, 0, k, t, st) for n, (spans, _) in enumerate(lines) for k, (t, st) in enumerate(spans)]
    got = {r.doc: r.marked for r in render.nested_marks(spark.createDataFrame(rows, "doc int, bi int, li int, text string, styles int"), ["doc", "bi"]).collect()}
    for n, (_, expect) in enumerate(lines):
        assert got[n] == expect


def test_markdown_paragraphs(spark):
    spans = [(1, 0, 0, "Head"), (1, 0, 1, "line"), (1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, "v1"), (1, 2, 1, "v2"), (1, 2, 2, " "), (1, 2, 3, "v3"), (1, 3, 0, "q1"), (1, 3, 1, ""), (1, 3, 2, "q2"), (1, 5, 0, "end"), (1, 6, 0, "  ")]
    blocks = [(1, 0, 1, False, False, False), (1, 1, 0, False, False, False), (1, 2, 0, False, True, False), (1, 3, 0, True, True, False), (1, 4, 0, False, False, True), (1, 5, 0, False, False, False), (1, 6, 0, False, False, False), (1, 7, 0, False, False, True)]
    df = spark.createDataFrame([(d, bi, ln, 0, t, 0) for d, bi, ln, t in spans], "doc int, bi int, line int, li int, text string, styles int")
    out = render.render_markdown(df, spark.createDataFrame(blocks, "doc int, bi int, heading int, quote boolean, verse boolean, page_break boolean"), line="line")
    assert out.first().body == "# Head  \nline\n\na b\n\nv1  \nv2\n\nv3\n\n> q1\n>\n> q2\n\n---\n\nend"


def test_symbol_and_dingbat_faces(spark):
    df = spark.createDataFrame([("aBV\"\xa3\xd7\xb7 9\x90", "!J~\xa8\xab \xc0")], "s string, d string")
    r = df.select(codepage.decode_symbol(F.col("s")).alias("s"), codepage.decode_dingbats(F.col("d")).alias("d")).first()
    assert r.s == "αΒς∀≤⋅· 9\x90" and r.d == "✁✪❞♣♠ \xc0"
    every = "".join(map(chr, range(0x20, 0x7F))) + "\xa3\xa5\xf2"
    back = spark.createDataFrame([(every, "漢α♣x")], "s string, t string").select(
        codepage.encode_symbol(codepage.decode_symbol(F.col("s"))).alias("s"), codepage.encode_dingbats(codepage.decode_dingbats(F.substring("s", 1, 95))).alias("d"), codepage.encode_symbol(F.col("t")).alias("x"), codepage.encode_dingbats(F.col("t")).alias("y")
    ).first()
    assert back.s == every and back.d == every[:95] and back.x == "?a?x" and back.y == "??\xa8x"


def test_folds_give_out_in_order(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 5, 600)], "v array<int>")
    step = lambda s, x: (s + x, F.when((s + x) % 2 == 0, F.array(s + x)).otherwise(F.array().cast("array<int>")))
    for r in df.select("v", fold.fold_out(F.col("v"), F.lit(0), step, "int", lambda s: F.array(-s), block=7).alias("o")).collect():
        sums = [sum(r.v[: k + 1]) for k in range(len(r.v))]
        assert r.o == [x for x in sums if x % 2 == 0] + [-sum(r.v)]


def test_a_control_that_is_missed_stops_the_scan(spark):
    df = spark.createDataFrame([(1, "see /home/ann/x")], "doc long, text string")
    assert quality.sensitive_scan(df, control="at /home/control").count() == 2
    with pytest.raises(Exception, match="control"):
        quality.sensitive_scan(df, control="nothing here").collect()


def test_lines_kept_together_and_blanks_at_the_top(spark):
    rows = [(1, k, 0, 1, False, 3 if k == 8 else 1, k in (10, 11, 19)) for k in range(24)]
    df = spark.createDataFrame(rows, "doc int, bi int, li int, cost int, forced boolean, keep int, blank boolean")
    out = {r.bi: r.page for r in pages.paginate(df, 10, keep=F.col("keep"), blank=F.col("blank")).collect()}
    assert out[7] == 1 and out[8] == 2 and {10, 11} <= out.keys() and out[17] == 2 and out[18] == 3 and 19 in out
    only = {r.bi: r.page for r in pages.paginate(df, 10, blank=F.col("blank")).collect()}
    assert only[9] == 1 and not {10, 11} & only.keys() and only[12] == 2


def test_roman_numbers(spark):
    df = spark.createDataFrame([("1994",), ("4",), ("0",), ("*",)], "n string")
    assert [r[0] for r in df.select(notes.roman(F.expr("try_cast(n as long)").cast("string"))).collect()] == ["mcmxciv", "iv", "0", None]


def test_registries():
    known = registry.Renderers().register("text", lambda df: df, ".txt", ("plain",))
    assert known.resolve("PLAIN") == "text"
    with pytest.raises(registry.Unknown):
        known.resolve("pdf")
    assert registry.settings("top=2, offset=4") == {"top": 2, "offset": 4}
    for bad in ("nope", "top=x", "left=1"):
        with pytest.raises(ValueError):
            registry.settings(bad)
    with pytest.raises(ValueError):
        registry.Options(spacing="odd")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc long, li long, text string, terminator string")
    assert structure.logical_lines(none, F.col("terminator") == "soft").count() == 0
    assert structure.wrap_margin(none).count() == 0
    assert structure.discover_bullets(none).count() == 0
    assert report.batches_of(spark.createDataFrame([], "k long"), 20, "k").count() == 0


def test_operators_do_not_gather_rows():
    """No operator outside ``llm`` collects, converts to pandas or runs row functions."""
    for path in [*ROOT.glob("operators/*.py"), *ROOT.glob("sources/*.py"), *ROOT.glob("functions/*.py")]:
        calls = {n.func.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)}
        assert not calls & {"collect", "toPandas", "udf", "pandas_udf", "applyInPandas", "crossJoin", "localCheckpoint"}, path


def test_nothing_imports_llm():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.parts:
            assert "paperloom.llm" not in path.read_text(), path


def test_codes_again_sign_by_sign_without_wide_classes(spark):
    """Every character is its code, itself or ?; no regular expression tries the signs one by one."""
    ascii_, printable = [chr(c) for c in range(128)], [chr(c) for c in range(0x20, 0x7F)]
    pages = {
        codepage.encode_cp437: (dict(zip(codepage.CP437_HIGH, map(chr, range(128, 256)))), ascii_),
        codepage.encode_symbol: (dict(reversed([*zip(codepage.SYMBOL_TEXT, codepage.SYMBOL_CODES)])), printable),
        codepage.encode_dingbats: (dict(zip(codepage.DINGBAT_TEXT, codepage.DINGBAT_CODES)), printable),
    }
    texts = ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x2800, 64)] + ["a\U0001f600b\u0000￿", "", "éα✁" * 300]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for encode, (codes, same) in pages.items():
        out = df.select("t", encode(F.col("t")).alias("c"))
        for r in out.collect():
            assert r.c == (r.t if r.t is None else "".join(codes.get(c, c if c in same else "?") for c in r.t))
        classes = re.findall(r"\[\^[^\]]*\]", out._jdf.queryExecution().analyzed().toString())
        assert classes and max(map(len, classes)) < 20
