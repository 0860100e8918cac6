"""Queries over sources, classification and text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import codepage
from paperloom.operators import classify as C
from paperloom.operators import text as X
from paperloom.sources import archive as A
from paperloom.plans.views import items, lines, planted, table, with_views


def claimed_files(spark, d):
    urls = table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.element_at(F.array(*(F.lit(x) for x in (".WS", ".txt", ".png", ""))), (F.col("page_id") % 4 + 1).cast("int"))).alias("path"))
    return A.claimed_files(urls, "path")


def _bytes(spark, d):
    """Documents as byte characters: some line feeds become soft or hard returns."""
    n = F.col("doc_id")
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "\x82")
    chars = F.when(n % 3 == 0, F.replace(text, F.lit("\n"), F.lit("\x8d\n"))).when(n % 3 == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return table(spark, d, "documents").select(n.alias("doc"), F.concat(chars, F.when(n % 5 == 0, F.repeat(F.lit("\x1a"), 9)).otherwise("")).alias("chars"))


_BYTES = """, B as (select doc_id as doc, case when doc_id % 3 = 0 then replace(t, chr(10), chr(141) || chr(10)) when doc_id % 3 = 1 then replace(t, chr(10), chr(13) || chr(10)) else t end
    || case when doc_id % 5 = 0 then repeat(chr(26), 9) else '' end as chars from (select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', chr(130), 'g') as t from documents))"""


def lines_of(spark, d):
    return A.lines_of(_bytes(spark, d), "chars").withColumn("text", F.md5("text"))


def sniff_prefix(spark, d):
    files = _bytes(spark, d).withColumn("content", F.encode("chars", "ISO-8859-1"))
    return A.sniff_prefix(files, 1000).select("doc", F.length("content").cast("long").alias("bytes"), F.md5(codepage.bytes_as_chars(F.col("content"))).alias("md5"))


def read_print_stream(spark, d):
    stream = _bytes(spark, d).withColumn("chars", F.replace("chars", F.lit(". "), F.lit(".\f")))
    return A.read_print_stream(stream).select("doc", "page", "li", F.md5("text").alias("text"))


def _records(spark, d):
    c = table(spark, d, "customer")
    line = F.concat_ws(",", F.concat(F.lit('"'), F.col("c_name"), F.lit(', Esq"')), F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('"')), F.col("c_custkey").cast("string"))
    short = F.when((F.col("c_nationkey") % 5 == 0) & (F.col("c_custkey") % 50 == 0), F.col("c_name")).otherwise(line)
    return c.select(F.col("c_nationkey").cast("long").alias("doc"), F.col("c_custkey").alias("li"), short.alias("text"))


def read_record_list(spark, d):
    """Records of the files that are lists; each is broken by a soft return after its first comma."""
    whole = _records(spark, d)
    halves = whole.select("doc", F.explode(F.array(F.struct((F.col("li") * 2).alias("li"), F.expr("substr(text, 1, instr(text, ','))").alias("text"), F.lit("soft").alias("terminator")), F.struct((F.col("li") * 2 + 1).alias("li"), F.concat(F.expr("substr(text, instr(text, ',') + 1)"), F.lit("\x1a\x1a")).alias("text"), F.lit("hard").alias("terminator")))).alias("x")).select("doc", "x.*")
    return A.read_record_list(halves, C.detect_record_lists(whole)).select("doc", "record", F.array_join("fields", "|").alias("fields"))


def detect_record_lists(spark, d):
    return C.detect_record_lists(_records(spark, d))


def byte_profile(spark, d):
    return C.byte_profile(_bytes(spark, d)).drop("chars")


def true_end(spark, d):
    return _bytes(spark, d).select("doc", C.true_end(F.col("chars")).alias("end"))


def framed_block_count(spark, d):
    frame = F.lit("\x1d\x0d\x00ten bytes.\x0d\x00\x1d")
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.concat(text, F.repeat(frame, (F.col("doc_id") % 4).cast("int")), F.lit("\x1d tail")).alias("chars"))
    return C.framed_block_count(docs)


def classify(spark, d):
    """Documents by their profiles; some hold frames or wrapped characters, some begin with a header."""
    n = F.col("doc")
    chars = F.concat(F.when(n % 13 == 0, F.lit("\x1d}")).otherwise(""), "chars", F.when(n % 11 == 0, F.lit("\x1d\x05\x00ab\x05\x00\x1d")).otherwise(""), F.when(n % 7 == 0, F.repeat(F.lit("\x1b\x82\x1c"), 4)).otherwise(""), F.when(n % 6 == 0, F.repeat(F.lit("\x01"), (F.length("chars") * (n % 4)).cast("int"))).otherwise(""))
    files = _bytes(spark, d).select("doc", chars.alias("chars"))
    facts = files.withColumns({"triples": F.regexp_count("chars", F.lit(r"(?s)\x1B.\x1C")).cast("long"), "declared": F.startswith("chars", F.lit("\x1d}"))})
    profile = C.byte_profile(facts).drop("chars").join(C.framed_block_count(files).withColumnRenamed("blocks", "framed"), "doc")
    return C.classify(profile).select("doc", "variant", "reason")


def damage_signature(spark, d):
    return C.damage_signature(_bytes(spark, d)).drop("chars")


def era_flags(spark, d):
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*(F.lit(x) for x in ("ws4", "ws5+", "text", "other"))), (F.length("event_type") % 4 + 1).cast("int")).alias("variant"))
    return C.era_flags(e)


def forced_variant(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("variant"))
    overrides = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("doc"), F.lit("ws4").alias("variant"))
    return C.forced_variant(docs, overrides)


def archive_summary(spark, d):
    """Per source and language, with totals: documents, lines, words and the line length at the
    ninth decile of each group's lines."""
    docs = table(spark, d, "documents")
    measured = docs.select("source", "lang", F.size(F.split("text", "\n", -1)).cast("long").alias("_lines"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_words"))
    return C.archive_summary(measured, ["source", "lang"], lines=F.col("_lines"), words=F.col("_words"))


def name_filter(spark, d):
    files = table(spark, d, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit(".ws")).alias("name"))
    names = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 97 = 0").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("?"))).alias("wanted"))
    found, missing = C.name_filter(files, names)
    return found.select(F.lit("found").alias("kind"), F.col("name"), "p_partkey").unionByName(missing.select(F.lit("missing").alias("kind"), F.col("wanted").alias("name"), F.lit(None).cast("long").alias("p_partkey")))


def single_sentence_space(spark, d):
    return planted(spark, d).select("doc", "li", X.single_sentence_space(F.col("text")).alias("text"))


def single_sentence_spans(spark, d):
    """Lines cut into spans of up to four characters, some with more spaces after their stops."""
    wide = F.when(F.col("li") % 2 == 0, F.replace("text", F.lit(". "), F.lit(".      "))).otherwise(F.col("text"))
    pieces = F.posexplode(F.regexp_extract_all(wide, F.lit("(?s).{1,4}"), F.lit(0))).alias("si", "text")
    return X.single_sentence_spans(planted(spark, d).select("doc", "li", pieces), ["doc", "li"], "si")


def command_marks(spark, d):
    marks, _ = X.command_marks(planted(spark, d))
    return marks


def command_text_lines(spark, d):
    _, text = X.command_marks(planted(spark, d))
    return text.groupBy("doc").agg(F.count("*").alias("lines"))


def decode_corpus(spark, d):
    chars = codepage.bytes_as_chars(F.encode("chars", "ISO-8859-1"))
    text = codepage.decode_cp437(chars)
    back = codepage.encode_cp437(text)
    signs = F.translate("chars", "zqkxj\x82", "\xa3\xae\xf2\xa8\xab\xd7")
    return _bytes(spark, d).select("doc", text.alias("text"), (back == chars).alias("round_trip"), codepage.decode_symbol(signs).alias("symbols"), codepage.decode_dingbats(signs).alias("dingbats"), codepage.encode_symbol(codepage.decode_symbol(signs)).alias("symbol_codes"))


def substitute(spark, d):
    spans = lines(spark, d).withColumn("text", F.replace(F.replace("text", F.lit(","), F.lit("--")), F.lit("e "), F.lit("¤ ")))
    names = F.explode(F.array(*(F.lit(x) for x in ("euro", "typography", "corners"))))
    decisions = table(spark, d, "labels").select(F.col("doc_id").alias("doc"), "quality", "toxic", names.alias("name"))
    decisions = decisions.select("doc", "name", F.when(F.col("name") == "euro", F.col("toxic") == 1).otherwise(F.col("quality") == 1).alias("enabled"))
    return X.substitute(spans, decisions, skip=F.col("li") % 4 == 3).select("doc", "li", F.md5("text").alias("text"))


def effective_styles(spark, d):
    li = items(spark, d)
    spans = li.select("doc", "bi", "li", F.col("style").alias("styles"), F.when(F.col("height") % 3 == 0, F.col("height").cast("int")).alias("colour"))
    blocks = li.groupBy("doc", "bi").agg(F.max("style").alias("m"), F.count("*").alias("n")).select("doc", "bi", (F.col("m") % 16).alias("style_attrs"), (F.col("m") % 4).alias("style_colour"), F.when(F.col("n") > 1, 1).otherwise(0).alias("heading"))
    return X.effective_styles(spans, blocks, ["doc", "bi"])


def bind_page_variables(spark, d):
    text = lines(spark, d).withColumn("text", F.concat("text", F.lit(" &#&"), F.when(F.col("li") % 3 == 0, F.lit(" &#/r& &#/& &# &")).otherwise("")))
    pages = lines(spark, d).filter("li % 5 <> 4").select("doc", "li", F.expr("li div 3 + 1").alias("number"))
    return X.bind_page_variables(text, pages, ["doc", "li"])


def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


def note_filter(spark, d):
    notes = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "comment").when(F.col("role") == "user", "footnote").otherwise("endnote").alias("kind"))
    kept = X.note_filter(notes, ["comment", "footnote"]).withColumn("mode", F.lit("modern"))
    return kept.unionByName(X.note_filter(notes, ["comment", "footnote"], facsimile=True).withColumn("mode", F.lit("facsimile")))


def dedupe_new(spark, d):
    o = table(spark, d, "orders").select("o_custkey")
    return A.dedupe_new(o.filter("o_custkey % 3 = 0"), o, ["o_custkey"])


QUERIES = {f.__name__: f for f in (single_sentence_spans, claimed_files, lines_of, sniff_prefix, read_print_stream, read_record_list, detect_record_lists, byte_profile, true_end, framed_block_count, classify, damage_signature, era_flags, forced_variant, archive_summary, name_filter, single_sentence_space, command_marks, command_text_lines, decode_corpus, substitute, effective_styles, bind_page_variables, html_to_text, note_filter, dedupe_new)}

_MARK = "regexp_matches(text, '^\\.[A-Za-z][A-Za-z#]{0,2}\\s*')"
_DETECT = """, R as (select cast(c_nationkey as bigint) as doc, c_custkey as li, case when c_nationkey % 5 = 0 and c_custkey % 50 = 0 then c_name else '"' || c_name || ', Esq","' || c_mktsegment || '",' || c_custkey end as text from customer)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLES = {
    "claimed_files": """select * from (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || (['.WS', '.txt', '.png', ''])[page_id % 4 + 1] as path from pages)
        where regexp_extract(lower(path), '\\.([^./]+)$', 1) in ('ws', 'wsd', 'ws3', 'ws4', 'ws5', 'ws6', 'ws7', 'wst', 'doc', 'txt', 'man', 'prn', 'nt', 'bak', 'let', 'pix')""",
    "lines_of": with_views(_BYTES + """, S as (select doc, replace(replace(replace(chars, chr(141) || chr(10), chr(1)), chr(13) || chr(10), chr(2)), chr(10), chr(3)) as c from B),
        P as (select doc, string_split_regex(c, '[\\x01\\x02\\x03]') as p, regexp_extract_all(c, '[\\x01\\x02\\x03]') as e from S),
        U as (select doc, unnest(range(len(p))) as li, unnest(p) as text, e from P)
        select doc, li, md5(text) as text, case when li >= len(e) then 'eof' when e[li + 1] = chr(1) then 'soft' else 'hard' end as terminator from U where li < len(e) or text <> ''""", "L"),
    "sniff_prefix": with_views(_BYTES + " select doc, least(length(chars), 1000) as bytes, md5(substr(chars, 1, 1000)) as md5 from B", "L"),
    "read_print_stream": with_views(_BYTES + """, S as (select doc, regexp_replace(replace(translate(split_part(chars, chr(26), 1), chr(130) || chr(141), chr(2) || chr(13)), '. ', '.' || chr(12)), '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]', '', 'g') as c from B),
        P as (select doc, unnest(range(len(p))) as page, unnest(p) as c from (select doc, string_split(c, chr(12)) as p from S)),
        Q as (select doc, page, unnest(range(len(p))) as li, unnest(p) as text from (select doc, page, string_split_regex(c, '\\r?\\n') as p from P))
        select doc, page, li, md5(text) as text from Q""", "L"),
    "read_record_list": "with X as (select 1)" + _DETECT + """, Q as (select doc from R group by doc having count(*) >= 2 and bool_and(text like '"%')) select doc, 2 * li as record, case when text like '"%' then replace(regexp_replace(text, '^"(.*)","(.*)",(.*)$', '\\1|\\2|\\3'), '"', '') else text end as fields from R where doc in (select doc from Q)""",
    "detect_record_lists": "with X as (select 1)" + _DETECT + """, F as (select doc, case when text like '"%' then 3 else 1 end as f, case when text like '"%' then 2 else 0 end as q from R)
        select doc, count(*) as records, cast(min(f) as bigint) as fields, count(*) >= 2 and min(f) = max(f) and min(f) >= 2 and 2 * sum(q) >= sum(f) as is_list from F group by doc""",
    "byte_profile": with_views(_BYTES + """, K as (select doc, length(chars) as size, (length(chars) - length(replace(chars, chr(141) || chr(10), ''))) // 2 as soft_returns, (length(chars) - length(replace(chars, chr(13) || chr(10), ''))) // 2 as hard_returns,
        length(chars) - length(replace(replace(chars, chr(130), ''), chr(141), '')) as high_bit, length(replace(replace(replace(chars, chr(130), ''), chr(141), ''), chr(26), '')) as text from B)
        select doc, size, soft_returns, hard_returns, high_bit, case when size > 0 then least(100, 100 * text // size) else 100 end as text_pct from K""", "L"),
    "true_end": with_views(_BYTES + " select doc, length(rtrim(chars, chr(26))) as \"end\" from B", "L"),
    "framed_block_count": "select doc_id as doc, doc_id % 4 as blocks from documents",
    "classify": with_views(_BYTES + """, C as (select doc, case when doc % 13 = 0 then chr(29) || '}' else '' end || chars || case when doc % 11 = 0 then chr(29) || chr(5) || chr(0) || 'ab' || chr(5) || chr(0) || chr(29) else '' end
          || case when doc % 7 = 0 then repeat(chr(27) || chr(130) || chr(28), 4) else '' end || case when doc % 6 = 0 then repeat(chr(1), length(chars) * (doc % 4)) else '' end as chars from B),
        K as (select doc, length(chars) as size, (length(chars) - length(replace(chars, chr(141) || chr(10), ''))) // 2 as soft, (length(chars) - length(replace(chars, chr(13) || chr(10), ''))) // 2 as hard,
          len(regexp_extract_all(chars, '[\\x{80}-\\x{FF}]')) as high, len(regexp_extract_all(chars, '[\\x20-\\x7E\\t\\n\\r]')) + case when doc % 7 = 0 then 8 else 0 end as text, case when doc % 11 = 0 then 1 else 0 end as framed, case when doc % 7 = 0 then 4 else 0 end as triples, doc % 13 = 0 as declared from C),
        P as (select *, case when size > 0 then least(100, 100 * text // size) else 100 end as pct from K),
        D as (select *, soft >= 3 and soft * 16384 >= size as soft_ok, high * 20 >= size and pct >= 70 as high_ok, triples >= 3 and triples * 16384 >= size as tri_ok from P)
        select doc, case when declared then 'ws5+' when pct < 40 then 'binary' when framed > 0 or tri_ok then 'ws5+' when soft_ok and high * 4 < soft then 'ws5+' when soft_ok or high_ok then 'ws4' when pct >= 90 and hard >= 2 then 'printstream' when pct >= 90 then 'text' else 'binary' end as variant,
        case when declared then 'declared header' when pct < 40 then 'under 40% text' when framed > 0 or tri_ok then 'framed blocks or wrapped characters' when soft_ok and high * 4 < soft then 'soft returns without high bits' when soft_ok or high_ok then 'soft returns or high bits' when pct >= 90 and hard >= 2 then 'text with hard returns' when pct >= 90 then 'plain text' else 'none of the rules' end as reason from D""", "L"),
    "damage_signature": with_views(_BYTES + """, K as (select doc, chars, replace(chars, chr(13) || chr(10), chr(1) || chr(1)) as c from B)
        select doc, length(c) - length(replace(c, chr(10), '')) as bare_feeds, nullif(instr(c, chr(10)), 0) - 1 as first_bare, contains(chars, chr(20)) as has_stray from K""", "L"),
    "era_flags": """select event_id, v as variant, v = 'ws4' as high_bit_wrap, v in ('ws5+', 'other') as has_notes, case when v = 'ws4' then 'font' else 'tenth-inch' end as column_unit, cast(28 as integer) as number_column
        from (select event_id, (['ws4', 'ws5+', 'text', 'other'])[length(event_type) % 4 + 1] as v from events)""",
    "forced_variant": "select d.doc_id as doc, case when l.toxic = 1 then 'ws4' else lang end as variant, case when l.toxic = 1 then 'manual' else 'detected' end as variant_source from documents d left join labels l on d.doc_id = l.doc_id and l.toxic = 1",
    "archive_summary": "select source, lang, count(*) as documents, cast(sum(len(string_split(text, chr(10)))) as bigint) as lines, cast(sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) as bigint) as words from documents group by rollup(source, lang)",
    "name_filter": """with W as (select distinct case when p_partkey % 2 = 0 then upper(p_name) else p_name || '?' end as wanted from part where p_partkey % 97 = 0),
        F as (select p_partkey, p_name as stem, (select string_agg(upper(x[1]) || x[2:], ' ') from (select unnest(string_split(p_name, ' ')) as x)) || '.ws' as name from part)
        select 'found' as kind, name, p_partkey from F where stem in (select lower(wanted) from W) union all select 'missing', wanted, null from W where lower(wanted) not in (select stem from F)""",
    "single_sentence_spans": with_views(""", W as (select doc, li, case when li % 2 = 0 then replace(text, '. ', '.      ') else text end as t from LP),
        C as (select doc, li, unnest(range(length(t))) as p, unnest(string_split(t, '')) as ch from W where t <> ''),
        P as (select *, last_value(case when ch <> ' ' then p end ignore nulls) over w as q, last_value(case when ch <> ' ' then ch end ignore nulls) over w as stop from C window w as (partition by doc, li order by p rows between unbounded preceding and current row))
        select doc, li, cast(p // 4 as integer) as si, coalesce(string_agg(ch, '' order by p) filter (not (ch = ' ' and coalesce(stop in ('.', '?', '!'), false) and p - q > 1)), '') as text from P group by doc, li, p // 4""", "LP"),
    "single_sentence_space": with_views("select doc, li, regexp_replace(text, '([.?!]) {2,}', '\\1 ', 'g') as text from LP", "LP"),
    "command_marks": with_views(f"select doc, li, upper(regexp_extract(text, '^\\.([A-Za-z][A-Za-z#]{{0,2}})', 1)) as name, trim(regexp_extract(text, '^\\.[A-Za-z][A-Za-z#]{{0,2}}\\s*(.*)$', 1)) as arg from LP where {_MARK}", "LP"),
    "command_text_lines": with_views(f"select doc, count(*) as lines from LP where not {_MARK} and not starts_with(text, '..') group by doc", "LP"),
    "decode_corpus": with_views(_BYTES + """ select doc, replace(replace(chars, chr(141), 'ì'), chr(130), 'é') as text, true as round_trip,
        translate(g, {codes}, {text}) as symbols, translate(g, {ding_codes}, {dings}) as dingbats, regexp_replace(g, '[^ -~\\xa3\\xa5\\xab-\\xb1\\xb3\\xb4\\xb6-\\xb9\\xce\\xcf\\xd1\\xd5-\\xd7\\xe5\\xf2]', '?', 'g') as symbol_codes
        from (select *, translate(chars, 'zqkxj' || chr(130), chr(163) || chr(174) || chr(242) || chr(168) || chr(171) || chr(215)) as g from B)""".format(codes=_quoted(codepage.SYMBOL_CODES), text=_quoted(codepage.SYMBOL_TEXT), ding_codes=_quoted(codepage.DINGBAT_CODES), dings=_quoted(codepage.DINGBAT_TEXT)), "L"),
    "substitute": with_views(""", S as (select L.doc, li, replace(replace(text, ',', '--'), 'e ', '¤ ') as t, coalesce(toxic = 1, false) and li % 4 <> 3 as e, coalesce(quality = 1, false) and li % 4 <> 3 as q from L left join labels on L.doc = labels.doc_id),
        E as (select doc, li, q, case when e then replace(t, '¤', '€') else t end as t from S)
        select doc, li, md5(case when q then translate(replace(replace(t, '--', '—'), '''', '’'), '┌┐└┘', '╭╮╰╯') else t end) as text from E""", "L"),
    "effective_styles": with_views(""", B as (select doc, bi, max(style) % 16 as attrs, max(style) % 4 as c, count(*) > 1 as heading from LI group by 1, 2)
        select LI.doc, LI.bi, LI.li, cast((style | attrs) | case when heading then 1 else 0 end as integer) as styles, cast(coalesce(case when height % 3 = 0 then height end, nullif(c, 0)) as integer) as colour from LI join B using (doc, bi)""", "LI"),
    "bind_page_variables": with_views("select doc, li, text || ' ' || n || case when li % 3 = 0 then ' ' || n || ' &#/& &# &' else '' end as text from (select *, case when li % 5 <> 4 then cast(li // 3 + 1 as varchar) else '' end as n from L)", "L"),
    "html_to_text": r"""select page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)</body>', 1),
        '(?is)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(?:[^A-Za-z0-9>][^>]*)?>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'),
        '&nbsp;', ' '), '&#x27;', ''''), '&#39;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as text from pages""",
    "note_filter": """with N as (select conv_id, turn, case role when 'system' then 'comment' when 'user' then 'footnote' else 'endnote' end as kind from conversations)
        select *, 'modern' as mode from N where kind in ('comment', 'footnote') union all select *, 'facsimile' from N where kind = 'footnote'""",
    "dedupe_new": "select distinct o_custkey from orders where o_custkey % 3 <> 0",
}
