"""Queries over the structure of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import structure as S
from paperloom.plans.views import lines, placed, planted, with_views


def _typed(spark, d):
    """Planted lines with terminators: soft on even lines, hard else, eof on each last line."""
    last = lines(spark, d).groupBy("doc").agg(F.max("li").alias("last"))
    kind = F.when(F.col("li") == F.col("last"), "eof").when(F.col("li") % 2 == 0, "soft").otherwise("hard")
    return planted(spark, d).join(last, "doc").select("doc", "li", "text", kind.alias("terminator"))


_TYPED = ", T as (select doc, li, text, case when li = max(li) over (partition by doc) then 'eof' when li % 2 = 0 then 'soft' else 'hard' end as terminator from LP)"


def break_kinds(spark, d):
    return S.break_kinds(_typed(spark, d), F.lit(120)).select("doc", "li", "separator")


def logical_lines(spark, d):
    return S.logical_lines(_typed(spark, d), F.col("terminator") == "soft").withColumn("text", F.md5("text"))


def paragraph_units(spark, d):
    return S.paragraph_units(planted(spark, d), nowrap=F.expr("li div 9 % 5 = 4")).select("doc", "li", "unit", "short_run")


def wrap_margin(spark, d):
    return S.wrap_margin(_typed(spark, d))


def modal_value(spark, d):
    return S.modal_value(planted(spark, d), S.indent_of(F.col("text")) + F.length("text") % 3)


def terminal_fraction(spark, d):
    return S.terminal_fraction(lines(spark, d), ["doc"])


def verse_test(spark, d):
    """Runs of six lines, some with boxes around them."""
    n = F.col("doc") + F.col("li")
    text = F.when((F.col("doc") % 5 == 0) & (n % 4 < 2), F.lit("╔═══╗ 12")).when((F.col("doc") % 7 == 0) & (n % 3 == 0), F.concat(F.lit("“"), F.col("text"), F.lit("”"))).otherwise(F.col("text"))
    runs = planted(spark, d).withColumns({"run": F.expr("li div 6"), "text": text})
    return S.verse_test(runs, ["doc", "run"], shifted=F.col("li") % 5 < 3)


def discover_bullets(spark, d):
    return S.discover_bullets(planted(spark, d))


def discover_label_lists(spark, d):
    return S.discover_label_lists(planted(spark, d))


def coalesce_runs(spark, d):
    spans = placed(spark, d).select("doc", "bi", "li", "kind", F.col("height").cast("string").alias("text"))
    return S.coalesce_runs(spans.withColumn("o", F.col("bi") * 10 + F.col("li")), "kind", "o", ["doc"], mark=F.col("text") == "7").withColumn("text", F.md5("text"))


def toggle_events(spark, d):
    return S.toggle_events(placed(spark, d).select("doc", "bi", "li", F.col("style").alias("styles")), "doc", ["bi", "li"])


def nesting_level(spark, d):
    rows = planted(spark, d).filter("text <> ''").withColumns({"island": F.expr("li div 12"), "col": F.length("text") % 7})
    return S.nesting_level(rows.select("doc", "island", "li", "col", (F.length("text") % 3 != 0).alias("item")), item=F.col("item"))


def centred_rows(spark, d):
    rows = planted(spark, d).withColumn("text", F.concat(F.repeat(F.lit(" "), (F.col("li") % 13).cast("int")), "text"))
    return S.centred_rows(rows, F.lit(60), tagged=F.col("li") % 19 == 0, body_indent=F.lit(5), continues=F.col("doc") % 4 == 1).select("doc", "li", "centred")


def front_matter(spark, d):
    return S.front_matter(lines(spark, d), F.col("li") % 8 == 0, F.length("text") > 150, order="li").select("doc", "li", "front")


def quote_groups(spark, d):
    rows = lines(spark, d).withColumn("indent", (F.length("text") % 11).cast("long"))
    return S.quote_groups(rows, F.col("li") % 5 < 3, "indent", order="li").select("doc", "li", "group_indent")


def spacing_blanks(spark, d):
    rows = lines(spark, d).withColumns({"block": F.expr("li div 5"), "text": F.when((F.col("li") % 5 % 2 == 1) & (F.col("doc") % 3 != F.expr("li div 5") % 4), "").otherwise(F.col("text"))})
    return S.spacing_blanks(rows)


def scene_regions(spark, d):
    anchors = F.when((F.col("doc") + F.col("li")) % 23 == 0, F.concat(F.lit("12 INT. "), F.col("text"))).otherwise(F.col("text"))
    rows = lines(spark, d).withColumn("text", anchors)
    return S.scene_regions(rows, F.col("text").rlike(S.SLUGLINE), F.col("li") % 9 == 5, order="li", most=6).select("doc", "li", "scene")


def flow_items(spark, d):
    text = planted(spark, d)
    parts = {"tabs": text.filter("li % 10 = 0"), "break": text.filter("text = ''"), "para": text.filter("text <> ''")}
    parts = {k: v.select("doc", F.expr("li div 4").alias("bi"), F.expr("li % 4").alias("li"), F.md5("text").alias("ref")) for k, v in parts.items()}
    notes = text.filter("li % 6 = 1").select("doc", F.expr("li div 4").alias("bi"), F.expr("li % 4").alias("li"), F.expr("li div 12").alias("ref"))
    return S.flow_items(parts, notes)


QUERIES = {f.__name__: f for f in (break_kinds, logical_lines, paragraph_units, wrap_margin, modal_value, terminal_fraction, verse_test, discover_bullets, discover_label_lists, coalesce_runs, toggle_events, nesting_level, centred_rows, front_matter, quote_groups, spacing_blanks, scene_regions, flow_items)}

_TERM = "regexp_matches(rtrim(text), '[.!?][\"''’”]*$')"
#: whether runs of planted lines are verse, by expressions for the run and for a shifted style
VERSE_BY = """select {keys}, (n >= 2 and 2 * g >= n) or (s >= 2 and 3 * q < s and 10 * t < 9 * s and (2 * h > n or 10 * t < 8 * s)) as is_verse from (select {keys}, count(*) filter (f) as n, count(*) filter (f and not l and regexp_matches(text, '[""" + S.GRAPHIC + """]')) as g, count(*) filter (f and l) as s,
        count(*) filter (f and l and regexp_matches(ltrim(text), '^["\'\'‘“].*["\'\'’”]')) as q, count(*) filter (f and l and """ + _TERM + """) as t, count(*) filter (f and sh) as h from (select doc, li, {run}, text, {shifted} as sh, trim(text) <> '' as f, regexp_matches(text, '\\p{{L}}') as l from {table}) group by {keys})"""
ORACLES = {
    "break_kinds": with_views(_TYPED + """, M as (select *, trim(text) = '' as b, sum(case when trim(text) = '' then 0 else 1 end) over (partition by doc order by li) as run,
        first_value(case when trim(text) <> '' then ltrim(text) end ignore nulls) over (partition by doc order by li rows between 1 following and unbounded following) as nxt from T),
        N as (select *, sum(case when terminator = 'hard' then 1 else 0 end) over (partition by doc, run) as nh, sum(case when terminator <> 'eof' then 1 else 0 end) over (partition by doc, run) as n from M)
        select doc, li, case when b then case when terminator = 'soft' then 'blank_soft' else 'blank_hard' end when nxt is null then 'eof' when nh >= 1 and n >= 2 then 'para'
        when nh >= 1 or length(rtrim(text)) + 1 + length(split_part(nxt, ' ', 1)) < 120 then 'line' else 'wrap' end as separator from N""", "LP"),
    "logical_lines": with_views(_TYPED + """, M as (select doc, li, text, terminator = 'soft' as soft, trim(text) = '' as b from T where not (terminator = 'soft' and trim(text) = '')),
        N as (select *, case when coalesce(not lag(soft) over (partition by doc order by li), true) or b then 1 else 0 end as s from M),
        G as (select *, sum(s) over (partition by doc order by li) - 1 as line from N),
        K as (select *, row_number() over (partition by doc, line order by li) as k, lag(text) over (partition by doc, line order by li) as p from G)
        select doc, cast(line as bigint) as line, min(li) as first, md5(string_agg(case when k = 1 then text else case when p = '' or regexp_matches(p, '[ -]$') then '' else ' ' end || ltrim(text) end, '' order by li)) as text from K group by doc, line""", "LP"),
    "paragraph_units": with_views(""", A0 as (select *, li // 9 % 5 = 4 as nw, coalesce(lag(li // 9 % 5 = 4) over (partition by doc order by li), false) as wn, coalesce(trim(lag(text) over (partition by doc order by li)) = '', true) as pb from LP),
        A as (select *, (length(text) - length(ltrim(text)) >= 5 or pb or nw <> wn) and not (nw and wn) as s, trim(text) = '' as b from A0),
        B as (select *, sum(case when s then 1 else 0 end) over (partition by doc order by li) as u from A),
        C as (select *, count(*) over (partition by doc, u) = 1 and not b and not nw as single from B),
        D as (select *, single and length(rtrim(text)) <= 45 as short from C),
        E as (select *, short or (coalesce(lag(short) over w, false) and coalesce(lead(short) over w, false) and single and length(rtrim(text)) < 65) as cand from D window w as (partition by doc order by li)),
        F0 as (select *, coalesce(lag(cand) over (partition by doc order by li), false) as aft from E),
        F as (select *, sum(case when cand and not aft then 1 else 0 end) over (partition by doc order by li) as rn from F0),
        V as (""" + VERSE_BY.format(run="rn as run", shifted="false", keys="doc, run", table="F where cand") + """),
        G as (select F.*, cand and coalesce(is_verse, false) as verse from F left join V on V.doc = F.doc and V.run = F.rn)
        select doc, li, cast(sum(case when s and not (verse and aft) then 1 else 0 end) over (partition by doc order by li) as bigint) as unit, verse as short_run from G""", "LP"),
    "wrap_margin": with_views(_TYPED + " select doc, greatest(65, coalesce(list_sort(list(length(rtrim(text))) filter (s))[cast((count(*) filter (s)) * 9 // 10 as bigint) + 1], 0)) as margin from (select *, terminator = 'soft' and trim(text) <> '' as s from T) group by doc", "LP"),
    "modal_value": with_views(""", V as (select doc, li, length(text) - length(ltrim(text)) + length(text) % 3 as v from LP), C as (select doc, v, count(*) as n, min(li) as f from V group by 1, 2)
        select doc, cast(v as integer) as value, n as count from (select *, row_number() over (partition by doc order by n desc, f) as r from C) where r = 1""", "LP"),
    "terminal_fraction": with_views(f"select doc, coalesce(avg(case when regexp_matches(text, '\\p{{L}}') then case when {_TERM} then 1.0 else 0.0 end end), 1.0) as fraction from L group by doc", "L"),
    "verse_test": with_views(", B as (select doc, li, case when doc % 5 = 0 and (doc + li) % 4 < 2 then '╔═══╗ 12' when doc % 7 = 0 and (doc + li) % 3 = 0 then '“' || text || '”' else text end as text from LP), V as (" + VERSE_BY.format(run="li // 6 as run", shifted="li % 5 < 3", keys="doc, run", table="B") + ") select * from V", "LP"),
    "discover_bullets": with_views(""", M as (select doc, li, cast(length(regexp_extract(text, '^( *)', 1)) as integer) as col, regexp_extract(text, '^ *([^\\sA-Za-z0-9]) \\S', 1) as glyph, regexp_extract(text, '^ *[^\\sA-Za-z0-9] (\\S.*)$', 1) as rest from LP where regexp_matches(text, '^ *[^\\sA-Za-z0-9] \\S'))
        select doc, li, col, glyph from (select *, count(*) over (partition by doc, col, glyph) as n from M where not contains(rest, glyph)) where n >= 2""", "LP"),
    "discover_label_lists": with_views(""", M as (select *, sum(case when trim(text) = '' then 1 else 0 end) over (partition by doc order by li) as island from LP),
        N as (select doc, li, cast(island as bigint) as island, cast(length(regexp_extract(text, '^( *)', 1)) as integer) as col, regexp_extract(text, '^ *(\\S[^:]*):  +\\S', 1) as label from M where regexp_matches(text, '^ *\\S[^:]*:  +\\S'))
        select doc, li, island, col, label from (select *, count(*) over w as n, min(label) over w as a, max(label) over w as b from N window w as (partition by doc, island, col)) where n >= 2 and a <> b""", "LP"),
    "coalesce_runs": with_views(""", M as (select doc, bi * 10 + li as o, kind, cast(height as varchar) as text, height = 7 as mark from PL),
        N as (select *, case when kind is distinct from lag(kind) over w or mark or lag(mark) over w is null or lag(mark) over w then 1 else 0 end as new from M window w as (partition by doc order by o)),
        R as (select *, sum(new) over (partition by doc order by o) as run from N)
        select doc, min(o) as first, any_value(kind) as kind, md5(string_agg(text, '' order by o)) as text from R group by doc, run""", "PL"),
    "toggle_events": with_views(""", M as (select doc, bi, li, style, coalesce(lag(style) over (partition by doc order by bi, li), 0) as was from PL),
        K as (select unnest(range(8)) as k)
        select doc, bi, li, cast(k as integer) as seq, cast(1 << k as integer) as bit, false as "on" from M, K where (was & ~style & (1 << k)::integer) <> 0
        union all select doc, bi, li, cast(k + 8 as integer), cast(1 << k as integer), true from M, K where (style & ~was & (1 << k)::integer) <> 0""", "PL"),
    "nesting_level": with_views(""", R as (select doc, li // 12 as island, li, cast(length(text) % 7 as integer) as col, length(text) % 3 <> 0 as item from LP where text <> ''),
        P as (select a.doc, a.island, a.li, b.col as c from R a left join R b on a.doc = b.doc and a.island = b.island and b.item and b.li <= a.li
          and not exists (select 1 from R m where m.doc = a.doc and m.island = a.island and m.li > b.li and m.li <= a.li and m.col < b.col))
        select doc, island, li, count(distinct c) as level, max(c) as container from P group by doc, island, li""", "LP"),
    "centred_rows": with_views(""", R as (select doc, li, repeat(' ', li % 13) || text as text from LP), M as (select *, length(trim(text)) as s, length(text) - length(ltrim(text)) as lead from R)
        select doc, li, li % 19 = 0 or (lead > 0 and abs(lead - (60 - s) / 2.0) <= 1.5 and 60 - s >= 4 and len(regexp_extract_all(trim(text), ' {3,}')) < 2 and lead <> 5 and doc % 4 <> 1) as centred from M""", "LP"),
    "front_matter": with_views(""", M as (select doc, li, length(text) > 150 as hit, sum(case when li % 8 = 0 then 1 else 0 end) over (partition by doc order by li) as part from L)
        select doc, li, not bool_or(hit) over (partition by doc, part order by li) as front from M""", "L"),
    "quote_groups": with_views("select a.doc, a.li, case when a.li % 5 < 3 then length(b.text) % 11 end as group_indent from L a left join L b on a.doc = b.doc and b.li = a.li // 5 * 5", "L"),
    "spacing_blanks": with_views(""", R as (select doc, li, li // 5 as block, case when li % 5 % 2 = 1 and doc % 3 <> li // 5 % 4 then '' else text end as text from L),
        M as (select *, trim(text) = '' as b, lag(trim(text) = '') over (partition by doc, block order by li) as p from R),
        F as (select doc, block, count(*) filter (b) >= 2 as enough, count(*) filter (b = p) = 0 as fits from M group by 1, 2),
        G as (select *, sum(case when fits then 0 else 1 end) over (partition by doc order by block) as part from F)
        select doc, block, fits and bool_or(enough and fits) over (partition by doc, part order by block) as double_spaced from G""", "L"),
    "scene_regions": with_views(""", M as (select doc, li, (doc + li) % 23 = 0 or regexp_matches(text, '^[ \\t]*[0-9]{0,4}[ \\t]*(INT\\.|EXT\\.|I/E\\.)[ \\t]') as a from L),
        N as (select a.doc, a.li, max(case when b.a then b.li end) as scene from M a join M b on a.doc = b.doc and b.li <= a.li group by 1, 2)
        select N.doc, N.li, scene from N where li - scene <= 6 and not exists (select 1 from M where M.doc = N.doc and M.li > N.scene and M.li <= N.li and M.li % 9 = 5 and not M.a)""", "L"),
    "flow_items": with_views(""", I as (select doc, li // 4 as bi, li % 4 as li, 0 as r, 'tabs' as kind, md5(text) as ref from LP where li % 10 = 0 union all
          select doc, li // 4, li % 4, case when text = '' then 1 else 2 end, case when text = '' then 'break' else 'para' end, md5(text) from LP),
        N as (select doc, cast(li // 12 as varchar) as ref, min(li) as f from LP where li % 6 = 1 group by 1, 2),
        A as (select * from I union all select distinct doc, 4611686018427387903, 0, 99, 'separator', '' from N
          union all select doc, 4611686018427387903, row_number() over (partition by doc order by f, ref), 100, 'note', ref from N)
        select doc, row_number() over (partition by doc order by bi, li, r, ref) as seq, kind, ref from A""", "LP"),
}
