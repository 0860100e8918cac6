"""Queries over timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import timeline as T
from paperloom.plans.views import events, items, table, with_views

ORDER = ["ts", "seq"]


def change_log(spark, d):
    return T.change_log(events(spark, d).withColumn("arg", F.expr("arg div 5000")), "view", order=ORDER, value_col="arg")


def change_log_all(spark, d):
    day = events(spark, d).withColumn("day", F.to_date("ts"))
    return T.change_log(day, "view", keep="all", order=["day", "seq"], value_col="arg").select("doc", "day", "seq", "arg")


def state_at(spark, d):
    e = events(spark, d)
    return T.state_at(e.filter("name = 'purchase'").select("doc", "ts", "seq"), e.filter("name = 'view'"), order=ORDER, value_col="arg")


def page_checkpoint(spark, d):
    e = events(spark, d)
    return T.page_checkpoint(e.filter("name = 'click'").select("doc", "ts", "seq"), e.filter("name = 'signup'"), order=ORDER)


def replay_events(spark, d):
    li = items(spark, d).select("doc", "bi", "li")
    changes = li.filter("(bi + li) % 7 = 0").select("doc", "bi", (F.col("li") * 3 - 4).alias("li"), (F.col("bi") * 10 + F.col("li")).alias("seq"))
    return T.replay_events(li, changes)


#: events as commands: the hundredth part of an argument names one of those of the timelines
_COMMANDS = sorted({c for t in T.TIMELINES.values() for c in t.commands})


def named_timelines(spark, d):
    """All timelines of the events' documents, a third of which have a page that says its own facts."""
    names = F.element_at(F.array(*(F.lit(c) for c in _COMMANDS)), (F.col("arg") % len(_COMMANDS) + 1).cast("int"))
    marks = events(spark, d).withColumns({"name": names, "arg": F.when(F.col("seq") % 31 != 0, F.expr("arg div 10000"))})
    facts = F.explode(F.array(*(F.lit(t) for t in ("top_bottom", "page_length", "offset", "page_start"))))
    page = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("doc"), facts.alias("timeline"), (F.col("c_custkey") % 7).alias("v0"), (F.col("c_custkey") % 5).alias("v1"))
    return T.all_timelines(marks, page, order=ORDER, value_col="arg")


def _timelines_twin() -> str:
    """Each timeline by itself, from the rules told for it."""
    pairs, alone, restart = [], [], []
    page = {"top_bottom": "always", "page_length": "none", "offset": "none", "page_start": "none"}
    seeds = {"orientation": "0", "page_length": "66", "offset": "8", "auto_number": "1", "line_interval": "null", "page_start": "1"}
    for name, a, b, x, y in (("top_bottom", "MT", "MB", 3, 8), ("head_foot", "HM", "FM", 2, 2)):
        s0, s1 = (f"coalesce((select g.p{i} from G g where g.doc = C.doc), {v})" if name == "top_bottom" else str(v) for i, v in ((0, x), (1, y)))
        pairs.append(f"""select doc, ts, seq, v0, v1, '{name}' as timeline from (select *, lag(v0, 1, s0) over w as q0, lag(v1, 1, s1) over w as q1 from (select doc, ts, seq, {s0} as s0, {s1} as s1,
            coalesce(last_value(case when name = '{a}' then arg end ignore nulls) over w, {s0}) as v0, coalesce(last_value(case when name = '{b}' then arg end ignore nulls) over w, {s1}) as v1 from C where name in ('{a}', '{b}') and arg is not null
            window w as (partition by doc order by ts, seq rows between unbounded preceding and current row)) window w as (partition by doc order by ts, seq)) where v0 <> q0 or v1 <> q1""")
    for name, says in (("orientation", "case when name = 'PR' then arg end"), ("page_length", "case when name = 'PL' then arg end"), ("offset", "case when name = 'PO' then arg end"), ("even_offset", "case when name = 'POE' then arg end"), ("odd_offset", "case when name = 'POO' then arg end"), ("auto_number", "case name when 'PN' then 1 when 'PG' then 1 when 'OP' then 0 end"), ("line_interval", "case when name = 'L#' then arg end")):
        alone.append(f"""select doc, ts, seq, v, null, '{name}' from (select doc, ts, seq, v, lag(v, 1, {seeds.get(name, "null")}) over (partition by doc order by ts, seq) as q from (select doc, ts, seq, cast({says} as bigint) as v from C) where v is not null) where v is distinct from q""")
    restart.append("select doc, ts, max(seq), arg_max(arg, seq), null, 'page_start' from C where name = 'PN' and arg is not null group by doc, ts")
    first = [f"select doc, null, null, {'coalesce(g.p0, 3)' if n == 'top_bottom' else 2}, {'coalesce(g.p1, 8)' if n == 'top_bottom' else 2}, '{n}' from A left join G g using (doc)" for n in ("top_bottom", "head_foot")]
    for name, seed in seeds.items():
        own = f"case when not exists (select 1 from E where E.doc = A.doc and E.timeline = '{name}') then coalesce(g.p0, {seed}) else {seed} end" if page.get(name) == "none" else seed
        other = f"case when not exists (select 1 from E where E.doc = A.doc and E.timeline = '{name}') then g.p1 end" if page.get(name) == "none" else "null"
        first.append(f"select doc, null, null, {own}, {other}, '{name}' from A left join G g using (doc)")
    every = ", ".join(f"'{c}'" for c in _COMMANDS)
    return with_views(f""", C as (select doc, ts, seq, ([{every}])[arg % {len(_COMMANDS)} + 1] as name, case when seq % 31 <> 0 then arg // 10000 end as arg from EV), G as (select c_custkey as doc, c_custkey % 7 as p0, c_custkey % 5 as p1 from customer where c_custkey % 3 = 0),
        A as (select doc from EV union select doc from G), E as ({" union all ".join(pairs + alone + restart)}) select * from E union all {" union all ".join(first)}""", "EV")


def page_numbers(spark, d):
    e = events(spark, d)
    pages = e.filter("name = 'click'").select("doc", "ts", "seq")
    restarts = e.filter("name = 'signup'")
    marked = T.state_at(T.page_checkpoint(pages, restarts, order=ORDER), restarts.withColumn("start", F.expr("arg div 100")), order=ORDER, value_col="start", out="start", strict=True)
    return T.page_numbers(marked, page="seq").select("doc", "seq", "checkpoint", "number")


def number_visibility(spark, d):
    e = events(spark, d)
    switches = e.filter("name in ('error', 'signup')").withColumn("on", F.col("name") == "signup")
    return T.number_visibility(e.filter("name = 'view'").select("doc", "ts", "seq"), switches, order=ORDER)


def line_numbers(spark, d):
    li = items(spark, d).withColumns({"page": F.expr("bi div 1000"), "step": F.expr("nullif((bi div 300) % 4, 1)")})
    return T.line_numbers(li.select("doc", "page", "bi", "li", "step"), "step", order=["bi", "li"])


def latest_n(spark, d):
    return T.latest_n(events(spark, d), 5, ORDER, key="doc").select("doc", "ts", "seq", "name")


def latest_40(spark, d):
    return T.latest_n(events(spark, d), 40, ORDER).select("doc", "seq", "name")


QUERIES = {f.__name__: f for f in (change_log, change_log_all, state_at, page_checkpoint, replay_events, named_timelines, page_numbers, number_visibility, line_numbers, latest_n, latest_40)}

_ASOF = "select t.doc, t.ts, t.seq, {what} from EV t where t.name = '{target}'"
ORACLES = {
    "change_log": with_views("select doc, ts, seq, name, arg from (select doc, ts, seq, name, arg // 5000 as arg, lag(arg // 5000) over (partition by doc order by ts, seq) as p from EV where name = 'view') where arg is distinct from p", "EV"),
    "change_log_all": with_views("select doc, cast(ts as date) as day, max(seq) as seq, arg_max(arg, seq) as arg from EV where name = 'view' group by doc, cast(ts as date)", "EV"),
    "state_at": with_views("select t.doc, t.ts, t.seq, v.arg as state from (select * from EV where name = 'purchase') t asof left join (select doc, ts, arg from EV where name = 'view') v on t.doc = v.doc and t.ts >= v.ts", "EV"),
    "page_checkpoint": with_views(_ASOF.format(target="click", what="(select count(*) from EV v where v.doc = t.doc and v.name = 'signup' and (v.ts < t.ts or (v.ts = t.ts and v.seq < t.seq))) as checkpoint"), "EV"),
    "replay_events": with_views(""", S as (select doc, bi, max(li) as last from LI group by 1, 2)
        select c.doc, c.bi, least(greatest(c.li * 3 - 4, 0), s.last + 1) as place, 0 as kind, c.bi * 10 + c.li as ref from LI c join S s using (doc, bi) where (c.bi + c.li) % 7 = 0
        union all select doc, bi, li, 1, li from LI""", "LI"),
    "named_timelines": _timelines_twin(),
    "page_numbers": with_views(""", C as (select t.doc, t.seq, t.ts, (select count(*) from EV v where v.doc = t.doc and v.name = 'signup' and (v.ts < t.ts or (v.ts = t.ts and v.seq < t.seq))) as checkpoint from EV t where t.name = 'click'),
        S as (select doc, arg // 100 as start, row_number() over (partition by doc order by ts, seq) as checkpoint from EV where name = 'signup')
        select C.doc, C.seq, C.checkpoint, coalesce(S.start, 1) + row_number() over (partition by C.doc, C.checkpoint order by C.seq) - 1 as number from C left join S using (doc, checkpoint)""", "EV"),
    "number_visibility": with_views("select t.doc, t.ts, t.seq, coalesce(v.name = 'signup', true) as visible from (select * from EV where name = 'view') t asof left join (select doc, ts, name from EV where name in ('error', 'signup')) v on t.doc = v.doc and t.ts > v.ts", "EV"),
    "line_numbers": with_views(""", P as (select doc, bi // 1000 as page, bi, li, nullif((bi // 300) % 4, 1) as step from LI),
        I as (select *, sum(case when step is distinct from p then 1 else 0 end) over (partition by doc, page order by bi, li) as island from (select *, lag(step) over (partition by doc, page order by bi, li) as p from P)),
        K as (select doc, page, bi, li, step, row_number() over (partition by doc, page, island order by bi, li) - 1 as k from I)
        select *, case when step > 0 then case when k % step = 0 then k // step + 1 end end as label from K""", "LI"),
    "latest_n": with_views("select doc, ts, seq, name from (select *, row_number() over (partition by doc order by ts desc, seq desc) as r from EV) where r <= 5", "EV"),
    "latest_40": with_views("select doc, seq, name from EV order by ts desc, seq desc limit 40", "EV"),
}
