"""Queries over pages, notes, rules and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.registry import settings
from paperloom.operators import notes as N
from paperloom.operators import pages as P
from paperloom.operators import references as R
from paperloom.operators import rules as U
from paperloom.plans.views import events, lines, placed, planted, table, with_views


def _flow(spark, d):
    return placed(spark, d).withColumns({"cost": F.when(F.col("kind") == "R", 0).otherwise(F.col("height")).cast("long"), "forced": F.col("bi") % 500 == 0})


_FLOW = ", F as (select doc, bi, li, height, kind, style, case when kind = 'R' then 0 else height end as cost, bi % 500 = 0 as forced from PL)"
_PAGES = _FLOW + """, N as (select *, row_number() over (partition by doc order by bi, li) as n from F),
    X as (with recursive W as (select doc, bi, li, n, cost as used, 1 as page from N where n = 1 union all
      select N.doc, N.bi, N.li, N.n, case when forced or used + cost > 800 then cost else used + cost end, page + case when forced or used + cost > 800 then 1 else 0 end from W join N on N.doc = W.doc and N.n = W.n + 1) select * from W)"""


def paginate(spark, d):
    return P.paginate(_flow(spark, d), 800).select("doc", "bi", "li", "page")


def paginate_marks(spark, d):
    """Pages with lines kept together, blank lines that a page does not begin with, and a budget that
    changes on the way."""
    out = P.paginate(_flow(spark, d), 800 - F.expr("bi div 2000 % 3") * 100, keep=F.when(F.col("bi") % 9 == 0, 1 + F.col("height") % 40), blank=F.col("height") % 6 == 0)
    return out.select("doc", "bi", "li", "page")


def trailing_pages(spark, d):
    pages = planted(spark, d).groupBy("doc", F.expr("li div 5").alias("page")).agg(F.max(F.length("text")).alias("size"))
    return P.trailing_pages(pages.select("doc", "page", "size"), F.col("size") % 3 == 0, F.col("page") % 9 == 8)


def trailing_break(spark, d):
    blocks = planted(spark, d).select("doc", F.col("li").alias("bi"), F.when(F.length("text") % 2 == 0, F.lit("pagebreak")).otherwise(F.lit("para")).alias("kind"))
    return P.trailing_break(blocks, F.col("doc") % 3 == 0)


def first_pages(spark, d):
    return P.first_pages(_flow(spark, d), 2, 800).select("doc", "bi", "li", "page")


def first_pages_marks(spark, d):
    """The first three pages of ``paginate_marks``."""
    out = P.first_pages(_flow(spark, d), 3, 800 - F.expr("bi div 2000 % 3") * 100, keep=F.when(F.col("bi") % 9 == 0, 1 + F.col("height") % 40), blank=F.col("height") % 6 == 0)
    return out.select("doc", "bi", "li", "page")


def break_reasons(spark, d):
    return P.break_reasons(P.paginate(_flow(spark, d), 800), F.col("forced"), F.col("bi") % 1000 == 0)


def wrap_words(spark, d):
    return P.wrap_words(lines(spark, d), 60).groupBy("doc", "li").agg(F.count("*").alias("rows"), F.max(F.length("text")).alias("widest"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda r: r["text"]), "|")).alias("digest"))


def trailing_trim(spark, d):
    rows = planted(spark, d).withColumns({"page": F.expr("li div 5"), "text": F.when(F.col("li") % 5 >= 2 + F.col("doc") % 4, " ").otherwise(F.col("text"))})
    return P.trailing_trim(rows, ["doc", "page"]).select("doc", "page", "li", "trailing")


def machine_margin(spark, d):
    rows = planted(spark, d).withColumns({"page": F.expr("li div 6 + 1"), "line": F.col("li") % 6})
    rows = rows.withColumn("text", F.when(F.col("line") < 1 + F.col("page") % 3, "").otherwise(F.col("text")))
    return P.machine_margin(rows).select("doc", "page", "line", "margin")


def geometry_summary(spark, d):
    return P.geometry_summary(placed(spark, d).withColumn("wide", F.col("style") % 3), "bi", "kind", "wide")


def _sub_pages(spark, d):
    x = placed(spark, d).groupBy("doc", F.expr("bi div 200").alias("page")).agg(F.sum("height").alias("h"))
    return x.select("doc", "page", (1 + F.expr("page div 7") % 3).alias("columns"), (2 + F.expr("page div 14") % 2).alias("gutter"))


def column_sheets(spark, d):
    return P.column_sheets(_sub_pages(spark, d))


def region_breaks(spark, d):
    x = _sub_pages(spark, d).withColumnRenamed("page", "bi").withColumn("kind", F.when((F.col("bi") + F.col("doc")) % 5 == 0, "pagebreak").when(F.col("bi") % 6 == 1, "other").otherwise("para"))
    return P.region_breaks(x)


def toc_page_join(spark, d):
    pages = P.paginate(_flow(spark, d), 800).withColumn("number", F.col("page") + 10)
    entries = placed(spark, d).filter("li = 1").select("doc", F.when(F.col("bi") % 80 == 0, -F.col("bi") - 1).otherwise(F.col("bi")).alias("bi"), F.concat(F.lit("entry "), F.col("bi").cast("string")).alias("text"))
    return P.toc_page_join(entries, pages)


def _notes(spark, d):
    c = table(spark, d, "conversations")
    return c.select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("idx"),
        F.when(F.col("role") == "system", "comment").when(F.col("role") == "user", "footnote").otherwise("endnote").alias("kind"),
        F.when(F.length("text") % 3 == 0, F.length("text") % 4 + 1).cast("int").alias("number"), F.when(F.length("text") % 7 == 0, F.lit("*")).alias("tag"), F.md5("text").alias("text"),
    )


_NOTES = """N as (select conv_id as doc, turn as idx, case role when 'system' then 'comment' when 'user' then 'footnote' else 'endnote' end as kind, case when length(text) % 3 = 0 then cast(length(text) % 4 + 1 as integer) end as number, case when length(text) % 7 = 0 then '*' end as tag, md5(text) as text from conversations),
    R as (select *, row_number() over (partition by doc, kind order by idx) as r, coalesce(tag, cast(coalesce(number, row_number() over (partition by doc, kind order by idx)) as varchar)) as label from N)"""


def note_labels(spark, d):
    return N.note_labels(_notes(spark, d)).select("doc", "idx", "kind", "label")


def collision_renumber(spark, d):
    return N.collision_renumber(N.note_labels(_notes(spark, d))).select("doc", "idx", "kind", "label")


def prefixed_labels(spark, d):
    return N.prefixed_labels(_notes(spark, d)).select("doc", "idx", "label")


def roman_labels(spark, d):
    return N.roman_labels(N.note_labels(_notes(spark, d).withColumn("number", F.col("number") * F.col("idx").cast("int") * 7))).select("doc", "idx", "kind", "label")


def note_order(spark, d):
    return N.note_order(_notes(spark, d)).select("doc", "idx", "seq")


def note_for_reference(spark, d):
    refs = _notes(spark, d).select("doc", (F.col("idx") * 2).alias("idx"))
    return N.note_for_reference(refs, _notes(spark, d).filter("doc % 4 <> 0 or idx < 3"), ("comment",)).select("doc", "idx", "note_kind", "status")


def comment_beside_reference(spark, d):
    n = _notes(spark, d)
    return N.comment_beside_reference(n.filter("kind = 'footnote'"), n.filter("kind <> 'footnote'").withColumn("idx", F.col("idx") - 1))


def rule_decisions(spark, d):
    n = F.col("arg")
    rules = [
        {"name": "euro", "auto": True, "detector": F.when(n % 2 == 0, F.lit("even"))},
        {"name": "corners", "auto": True, "detector": F.when(n % 3 == 0, F.lit("by three"))},
        {"name": "spacing", "auto": False, "detector": F.when(n > 10000, F.lit("large"))},
        {"name": "verse", "auto": False, "detector": F.lit("always")},
    ]
    return U.rule_decisions(events(spark, d).select(F.col("seq").alias("doc"), "arg"), rules, enable=("old-spacing",), disable=("corners",), retired={"old-spacing": "spacing"})


def overlay_overrides(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit("lang"), F.lit("source"))).alias("name"), F.col("lang").alias("value"))
    over = table(spark, d, "labels").select(F.col("doc_id").alias("doc"), F.when(F.col("toxic") == 1, "lang").otherwise("mode").alias("name"), F.when(F.col("quality") == 1, "on").otherwise("").alias("value"))
    return U.overlay_overrides(docs, over, ["doc", "name"])


def effective_settings(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("length"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") + 1).alias("top"), F.when(F.col("p_size") > 40, F.lit(7)).alias("offset"))
    return U.effective_settings(p, settings("top=3"), {"length": 66, "top": 2, "offset": 8}, {"rows": lambda v: v["length"] - v["top"] - 8})


def style_lookup(spark, d):
    blocks = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("cast(l_suppkey as long)").alias("doc"), F.expr("l_partkey % 50").alias("slot"))
    library = table(spark, d, "part").select(F.expr("p_partkey % 100").alias("doc"), F.expr("p_partkey div 100").alias("slot"), F.col("p_name").alias("style_name"), F.col("p_size").alias("attrs"))
    return U.style_lookup(blocks, library, ["doc", "slot"])


#: every family with alternates, one without, and a blank one
_FAMILIES = [*(f.title() for f in sorted(U.FONT_ALTERNATES)), "Odd Face", ""]


def font_resolution(spark, d):
    n = F.col("p_partkey")
    names = F.element_at(F.array(*map(F.lit, _FAMILIES)), (n % len(_FAMILIES) + 1).cast("int"))
    fonts = table(spark, d, "part").select("p_partkey", names.alias("family"), (F.col("p_size") % 4 == 0).alias("fixed"), F.element_at(F.array(*(F.lit(x) for x in ("sans", "script", "other"))), (F.col("p_size") % 3 + 1).cast("int")).alias("style"))
    alternates = spark.createDataFrame(sorted(U.FONT_ALTERNATES.items()), "family string, names array<string>")
    out = U.font_resolution(fonts, alternates, F.col("family"), F.col("fixed"), F.col("style"))
    return out.withColumn("choices", F.array_join("choices", ","))


def _font_twin() -> str:
    each = ", ".join("'" + ",".join(dict.fromkeys([*([f] if f else []), *U.FONT_ALTERNATES.get(f.lower(), [])])) + "'" for f in _FAMILIES)
    names = ", ".join(f"'{f}'" for f in _FAMILIES)
    return f"""select p_partkey, ([{names}])[p_partkey % {len(_FAMILIES)} + 1] as family, p_size % 4 = 0 as fixed, (['sans', 'script', 'other'])[p_size % 3 + 1] as style,
        array_to_string(list_filter([([{each}])[p_partkey % {len(_FAMILIES)} + 1], case when p_size % 4 = 0 then 'monospace' else (['sans-serif', 'cursive', ''])[p_size % 3 + 1] end], lambda x: x <> ''), ',') as choices from part"""


def _refs(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("arch/vol"), (F.col("page_id") % 4).cast("string"), F.lit("/box/doc.ws")).alias("doc_path"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("C:\\PIX\\P"), (F.col("page_id") % 40).cast("string"), F.lit(".PIX"))).otherwise(F.concat(F.lit("p"), (F.col("page_id") % 40).cast("string"), F.lit(".pix"))).alias("raw_path"))
    n = F.col("page_id") % 40
    files = table(spark, d, "pages").filter("page_id % 40 < 30").select(F.concat(F.lit("arch/"), F.when(n % 3 == 0, F.lit("pix/P")).when(n % 3 == 1, F.lit("vol1/images/P")).otherwise(F.lit("vol2/box/INSET/P")), n.cast("string"), F.lit(".PIX")).alias("path")).distinct()
    return p, files


def resolve_references(spark, d):
    refs, files = _refs(spark, d)
    return R.resolve_references(refs, files, ["page_id"])


def probe_report(spark, d):
    refs, files = _refs(spark, d)
    return R.probe_report(refs, R.resolve_references(refs, files, ["page_id"]), ["page_id"]).withColumn("probed", F.size(F.split("probed", "\n")).cast("long"))


QUERIES = {f.__name__: f for f in (paginate, paginate_marks, trailing_pages, trailing_break, roman_labels, first_pages, first_pages_marks, break_reasons, wrap_words, trailing_trim, machine_margin, geometry_summary, column_sheets, region_breaks, toc_page_join, note_labels, collision_renumber, prefixed_labels, note_order, note_for_reference, comment_beside_reference, rule_decisions, overlay_overrides, effective_settings, style_lookup, font_resolution, resolve_references, probe_report)}

_SUB = ", S as (select distinct doc, bi // 200 as page from PL), C as (select doc, page, 1 + (page // 7) % 3 as columns, 2 + (page // 14) % 2 as gutter from S)"
_REF = """P as (select page_id, 'arch/vol' || (page_id % 4) || '/box/doc.ws' as doc_path, case when page_id % 3 = 0 then 'C:\\PIX\\P' || (page_id % 40) || '.PIX' else 'p' || (page_id % 40) || '.pix' end as raw_path from pages),
    F as (select distinct 'arch/' || case n % 3 when 0 then 'pix/P' when 1 then 'vol1/images/P' else 'vol2/box/INSET/P' end || n || '.PIX' as path from (select page_id % 40 as n from pages) where n < 30),
    A as (select unnest(range(4)) as a), B as (select unnest(['', 'inset/pix/', 'inset/', 'media/', 'attachments/', 'images/']) as b, unnest(range(6)) as k),
    E as (select *, list_filter(string_split(lower(regexp_replace(raw_path, '^.:', '')), '\\'), lambda x: x <> '') as parts, string_split(doc_path, '/')[1:3] as dirs from P),
    K as (select page_id, a * 100 + s as rank, array_to_string(dirs[1:3 - a], '/') as dir, array_to_string(parts[s:], '/') as rest from E, A, (select unnest([1, 2]) as s) where s <= len(parts)
      union all select page_id, 100000 + a * 100 + k, array_to_string(dirs[1:3 - a], '/'), b || parts[-1] from E, A, B),
    H as (select page_id, rank, case when dir = '' then rest else dir || '/' || rest end as candidate from K),
    Z as (select page_id, arg_min(path, rank) as resolved from H join F on lower(path) = candidate group by page_id)"""
ORACLES = {
    "paginate": with_views(_PAGES + " select doc, bi, li, cast(page as bigint) as page from X", "PL"),
    "paginate_marks": with_views(_FLOW + """, M as (select *, row_number() over w as n, case when bi % 9 = 0 then 1 + height % 40 else 1 end as keep, height % 6 = 0 as blank, 800 - bi // 2000 % 3 * 100 as bud, sum(cost) over w as upto, sum(case when forced then 1 else 0 end) over w as part from F window w as (partition by doc order by bi, li)),
        Z as (select doc, part, max(n) as last from M group by 1, 2),
        N as (select a.*, e.upto - a.upto + a.cost as need from M a join Z on Z.doc = a.doc and Z.part = a.part join M e on e.doc = a.doc and e.n = least(a.n + a.keep - 1, case when a.forced and a.keep = 1 then a.n else Z.last end)),
        X as (with recursive W as (select doc, bi, li, n, case when blank then -1 else cost end as used, case when blank then 0 else 1 end as page, not blank as shown, bud as b from N where n = 1 union all
          select N.doc, N.bi, N.li, N.n, case when used < 0 or forced or used + need > b then case when blank then -1 else cost end else used + cost end, page + case when (used < 0 or forced or used + need > b) and not blank then 1 else 0 end,
          not ((used < 0 or forced or used + need > b) and blank), case when used < 0 or forced or used + need > b then bud else b end from W join N on N.doc = W.doc and N.n = W.n + 1) select * from W)
        select doc, bi, li, cast(page as bigint) as page from X where shown""", "PL"),
    "trailing_pages": with_views(""", G as (select doc, li // 5 as page, max(length(text)) as size from LP group by 1, 2), H as (select *, max(case when size % 3 = 0 or page % 9 = 8 then page end) over (partition by doc) as last from G)
        select doc, page, size from H where page <= last""", "LP"),
    "trailing_break": with_views(""", K as (select doc, li as bi, case when length(text) % 2 = 0 then 'pagebreak' else 'para' end as kind, li = max(li) over (partition by doc) as last from LP)
        select doc, bi, kind from K where not (last and kind = 'pagebreak' and doc % 3 <> 0)""", "LP"),
    "roman_labels": f"""with recursive {_NOTES}, M as (select doc, idx, kind, coalesce(tag, cast(coalesce(number * cast(idx as integer) * 7, row_number() over (partition by doc, kind order by idx)) as varchar)) as label from N),
        T as (select * from (values (1000, 'm'), (900, 'cm'), (500, 'd'), (400, 'cd'), (100, 'c'), (90, 'xc'), (50, 'l'), (40, 'xl'), (10, 'x'), (9, 'ix'), (5, 'v'), (4, 'iv'), (1, 'i')) t(v, m)),
        Y as (select distinct label, cast(label as bigint) as n, '' as r from M where kind = 'endnote' and regexp_matches(label, '^[0-9]+$') and cast(label as bigint) > 0 union all select label, n - (select max(v) from T where v <= n), r || (select arg_max(m, v) from T where v <= n) from Y where n > 0)
        select doc, idx, kind, coalesce(case when kind = 'endnote' then r end, M.label) as label from M left join (select * from Y where n = 0) Y on Y.label = M.label""",
    "first_pages": with_views(_PAGES + " select doc, bi, li, cast(page as bigint) as page from X where page <= 2", "PL"),
    "break_reasons": with_views(_PAGES + " select X.doc, cast(X.page as bigint) as page, X.bi, X.li, case when X.n = 1 then 'start' when X.bi % 1000 = 0 then 'form feed' when F.forced then 'explicit' else 'overflow' end as reason from (select *, lag(page) over (partition by doc order by n) as was from X) X join F using (doc, bi, li) where was is null or was <> page", "PL"),
    "wrap_words": with_views(r""", T as (select doc, li, list_filter(string_split_regex(trim(text), ' +'), lambda x: x <> '') as w from L),
        R as (select doc, li, case when len(w) = 0 then {'n': 0, 'w': 0, 'r': 1, 't': ''} else list_reduce(list_transform(w, lambda x: {'n': length(x), 'w': length(x), 'r': 1, 't': x}),
          lambda a, x: case when a.n + 1 + x.n <= 60 then {'n': a.n + 1 + x.n, 'w': greatest(a.w, a.n + 1 + x.n), 'r': a.r, 't': a.t || ' ' || x.t} else {'n': x.n, 'w': greatest(a.w, x.n), 'r': a.r + 1, 't': a.t || '|' || x.t} end) end as z from T)
        select doc, li, cast(z.r as bigint) as rows, cast(z.w as integer) as widest, md5(z.t) as digest from R""", "L"),
    "trailing_trim": with_views(""", R as (select doc, li // 5 as page, li, case when li % 5 >= 2 + doc % 4 then '' else trim(text) end as t from LP), M as (select *, max(case when t <> '' then li else -1 end) over (partition by doc, page) as last, count(*) over (partition by doc, page) as n from R),
        K as (select *, count(*) filter (li > last) over (partition by doc, page) as extra from M) select doc, page, li, extra as "trailing" from K where li <= last""", "LP"),
    "machine_margin": with_views(""", R as (select doc, li // 6 + 1 as page, li % 6 as line, case when li % 6 < 1 + (li // 6 + 1) % 3 then '' else trim(text) end as t from LP),
        M as (select doc, page, coalesce(min(line) filter (t <> ''), count(*)) as lead from R group by 1, 2), G as (select doc, coalesce(min(lead) filter (page > 1), min(lead)) as margin from M group by doc)
        select doc, page, line, margin from R join G using (doc) where line >= margin""", "LP"),
    "geometry_summary": with_views("select bi, count(distinct kind) > 1 as orientation_varies, count(distinct style % 3) > 1 as width_varies, count(distinct kind) as orientations from PL group by bi", "PL"),
    "column_sheets": with_views(_SUB + """, G as (select *, sum(case when columns is distinct from pc or gutter is distinct from pg then 1 else 0 end) over (partition by doc order by page) as region from (select *, lag(columns) over (partition by doc order by page) as pc, lag(gutter) over (partition by doc order by page) as pg from C)),
        H as (select *, (row_number() over (partition by doc, region order by page) - 1) % columns as col from G)
        select doc, page, columns, gutter, col as "column", cast(sum(case when col = 0 then 1 else 0 end) over (partition by doc order by page) as bigint) as sheet, col * ((65 - (columns - 1) * gutter) // columns + gutter) as x_offset from H""", "PL"),
    "region_breaks": with_views(_SUB + """, K as (select doc, page as bi, columns, case when (page + doc) % 5 = 0 then 'pagebreak' when page % 6 = 1 then 'other' else 'para' end as kind from C),
        P as (select a.doc, a.bi, a.columns, (select max(b.bi) from K b where b.doc = a.doc and b.bi < a.bi and b.kind = 'para') as prev from K a where kind = 'para')
        select P.doc, P.bi as before, K.columns as was, P.columns as now from P join K on K.doc = P.doc and K.bi = P.prev where K.columns > 1 and K.columns <> P.columns and not exists (select 1 from K x where x.doc = P.doc and x.kind = 'pagebreak' and x.bi > P.prev and x.bi < P.bi)""", "PL"),
    "toc_page_join": with_views(_PAGES + """, B as (select doc, bi, min(page) + 10 as number from X group by 1, 2), E as (select doc, case when bi % 80 = 0 then -bi - 1 else bi end as bi, 'entry ' || bi as text from PL where li = 1)
        select E.doc, E.bi, E.text, cast(B.number as bigint) as number from E left join B on E.doc = B.doc and E.bi = B.bi""", "PL"),
    "note_labels": f"with {_NOTES} select doc, idx, kind, label from R",
    "collision_renumber": f"with {_NOTES}, M as (select doc, idx, kind, row_number() over (partition by doc, kind order by idx) as rank from R where tag is null and kind in ('footnote', 'endnote')), C as (select doc, kind from M join R using (doc, idx, kind) group by 1, 2 having count(*) > count(distinct label)) select doc, idx, kind, case when C.doc is not null and rank is not null then cast(rank as varchar) else label end as label from R left join M using (doc, idx, kind) left join C using (doc, kind)",
    "prefixed_labels": f"with {_NOTES} select doc, idx, case kind when 'endnote' then 'e' when 'comment' then 'c' else '' end || r as label from R",
    "note_order": f"with {_NOTES} select doc, idx, row_number() over (partition by doc order by case kind when 'footnote' then 0 when 'endnote' then 1 else 3 end, idx) as seq from R",
    "note_for_reference": f"""with {_NOTES}, K as (select doc, kind, row_number() over (partition by doc order by idx) as k from N where doc % 4 <> 0 or idx < 3), Q as (select doc, idx * 2 as idx, row_number() over (partition by doc order by idx) as k from N)
        select doc, idx, kind as note_kind, case when kind is null then 'invalid' when kind = 'comment' then 'dropped' else 'shown' end as status from Q left join K using (doc, k)""",
    "comment_beside_reference": f"""with {_NOTES}, U as (select doc, idx as o, 0 as s, 'item' as kind, text from N where kind = 'footnote' union all select doc, idx - 1, 1, 'comment', text from N where kind <> 'footnote')
        select doc, row_number() over (partition by doc order by o, s, text) as seq, kind, text from U""",
    "rule_decisions": with_views(""" select seq as doc, 'euro' as name, 'even' as reason, true as enabled from EV where arg % 2 = 0 union all select seq, 'corners', 'by three', false from EV where arg % 3 = 0
        union all select seq, 'spacing', 'large', true from EV where arg > 10000 union all select seq, 'verse', 'always', false from EV""", "EV"),
    "overlay_overrides": """with D as (select doc_id as doc, unnest(['lang', 'source']) as name, lang as v from documents), O as (select doc_id as doc, case when toxic = 1 then 'lang' else 'mode' end as name, case when quality = 1 then 'on' else '' end as v from labels)
        select doc, name, coalesce(O.v, D.v) as value from D full join O using (doc, name) where coalesce(O.v, D.v) <> ''""",
    "effective_settings": """select p_partkey as doc, 'length' as name, cast(case when p_size % 2 = 0 then p_size else 66 end as varchar) as value, case when p_size % 2 = 0 then 'file' else 'default' end as source from part
        union all select p_partkey, 'top', cast(case when p_size % 3 = 0 then p_size + 1 else 3 end as varchar), case when p_size % 3 = 0 then 'file' else 'machine-default' end from part
        union all select p_partkey, 'offset', cast(case when p_size > 40 then 7 else 8 end as varchar), case when p_size > 40 then 'file' else 'default' end from part
        union all select p_partkey, 'rows', cast(case when p_size % 2 = 0 then p_size else 66 end - case when p_size % 3 = 0 then p_size + 1 else 3 end - 8 as varchar), 'derived' from part""",
    "style_lookup": "select l_orderkey, l_linenumber, l_suppkey as doc, l_partkey % 50 as slot, p_name as style_name, p_size as attrs from lineitem left join part on p_partkey % 100 = l_suppkey and p_partkey // 100 = l_partkey % 50",
    "font_resolution": _font_twin(),
    "resolve_references": f"with {_REF} select P.*, resolved from P left join Z using (page_id)",
    "probe_report": f"with {_REF} select page_id, least(20, count(*)) as probed, case when count(*) > 20 then '+' || (count(*) - 20) || ' more' end as more from H where page_id not in (select page_id from Z) group by page_id",
}
ORACLES["first_pages_marks"] = f"select * from ({ORACLES['paginate_marks']}) where page <= 3"
