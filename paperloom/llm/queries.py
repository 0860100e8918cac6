"""Queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import chat, filter_audit, licenses, mixing, near_dedup, page_text, phrase_index, prefix_trie, repetition, secrets, token_store, toxicity, warc
from paperloom.llm.scratch import settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"])))
    return found.select("doc_id", "n_blocks", F.size("found").cast("long").alias("n_found"), F.array_join(names, ",").alias("licenses"), "found")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(_table(spark, sf_dir, "documents"), tokenizer_json(), end_id=2)
    return token_store.verify(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32", "root")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= 0.7).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "n_sentences", "offending")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    said = said.unionByName(spark.createDataFrame(planted, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_conversations(said))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_warc_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(_table(spark, sf_dir, "pages"))
    read = warc.read_records(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", "n_chunks")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    counts = {f"n_{k}": F.size(F.array_remove(F.transform("base", lambda s: s["kind"] != F.lit(k)), True)).cast("long") for k in secrets.KINDS[:3]}  # noqa: B023
    digest = F.sha2(secrets.span_list(F.col("base")), 256)
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), digest.alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose four rarest terms lie within 30 words of a document, in any order."""
    found = phrase_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("near").alias("item_id"))


def op10_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_coverage(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_bits(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels"))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return page_text.extract(pages, page_text.train(pages))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_openings(turns))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_mix_sources, op3_token_store, op4_toxicity, op5_chat_formatting, op6_minhash_near_dedup, op7_warc_chunk_table, op8_secret_scan, op9_benchmark_decontamination, proximity_matches, op10_repetition_coverage, op11_filter_audit, op12_page_text, op13_prefix_trie)}

_SPACED = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: documents' words D, and N: (doc_id, i), the items i whose rarest known words lie within 30 words
_NEAR = f"""D as (select doc_id, regexp_extract_all({_LOW}, '{_LETTERS}') as w from documents), I as (select item_id, regexp_extract_all({_LOW}, '{_LETTERS}') as w from benchmark),
        J as (select row_number() over () as r, coalesce(cast(item_id as varchar), '') as i, w from (select distinct item_id, w from I)),
        JT as (select r, i, t, min(p) as p, count(*) over (partition by r) as d from (select r, i, unnest(w) as t, unnest(range(1, len(w) + 1)) as p from J) group by r, i, t),
        DT as (select doc_id, t, p from (select doc_id, unnest(w) as t, unnest(range(1, len(w) + 1)) as p from D) where t in (select t from JT)),
        JK as (select r, i, t, d, row_number() over (partition by r order by n, p) as k, count(*) over (partition by r) as known from JT join (select t, count(*) as n from DT group by t) using (t)),
        N as (select distinct doc_id, i from (select doc_id, i, k, count(distinct t) over (partition by doc_id, r order by p range between 29 preceding and current row) as c from (select r, i, t, least(known, 4) as k from JK where k <= 4 and 2 * known > d) join DT using (t)) where c = k)"""

#: SQL twins, where SQL can say it without the hashes and models of the operators
ORACLES: dict[str, str] = {
    "op5_chat_formatting": r"""with C as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        K as (select unnest(['<<SYS>>', '<</SYS>>', '[INST]', '[/INST]', '<s>', '</s>', '<|role|>', '<|text|>', '<|end|>']) as k),
        E as (select conv_id, turn, role, text, length(text) + length(text) - length(replace(text, '\', '')) + (select sum((length(text) - length(replace(text, k, ''))) // length(k)) from K)
          + case role when 'system' then 15 when 'user' then 15 when 'assistant' then 7 else 23 + length(role) end as chars,
          coalesce(lag(role) over turns, '') as state, lead(role) over turns is null as is_last from C window turns as (partition by conv_id order by turn nulls first, role, text))
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars,
        count(*) filter (not ((state = '' and role in ('system', 'user')) or (state = 'system' and role = 'user') or (state = 'user' and role = 'assistant') or (state = 'assistant' and role = 'user'))) as n_bad, bool_or(is_last and role = 'assistant') as ends_well from E group by conv_id""",
    "op6_minhash_near_dedup": f"""with recursive W as (select doc_id, regexp_extract_all({_LOW}, '{_SPACED}') as w from documents),
        S as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from W),
        N as (select doc_id, count(*) as n from S group by doc_id),
        P as (select a.doc_id as a, b.doc_id as b, count(*) as c from S a join S b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        L as (select a, b from P join N x on x.doc_id = a join N y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
        R as (select doc_id, doc_id as r from documents union select R.doc_id, case when L.a = R.r then L.b else L.a end from R join L on L.a = R.r or L.b = R.r)
        select d.doc_id, coalesce(n, 0) as n_shingles, m as component_id, d.doc_id = m as kept from documents d left join N using (doc_id) join (select doc_id, min(r) as m from R group by doc_id) using (doc_id)""",
    "op7_warc_chunk_table": """with P as (select page_id, coalesce(html, '') as h from pages), F as (select h, min(page_id) as f from P group by h),
        B as (select page_id, strlen(h) as bytes, f, array_to_string(list_transform(string_split(sha1(h), ''), lambda x: (['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'])[instr('0123456789abcdef', x)]), '') as bits from P join F using (h))
        select page_id, bytes as payload_bytes, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * cast(bits[5 * i + 1] as integer) + 8 * cast(bits[5 * i + 2] as integer) + 4 * cast(bits[5 * i + 3] as integer) + 2 * cast(bits[5 * i + 4] as integer) + cast(bits[5 * i + 5] as integer)]), '') as payload_digest,
        case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to, true as digest_ok, cast(case when page_id = f then (bytes + 1048575) // 1048576 else 0 end as bigint) as n_chunks from B""",
    "op9_benchmark_decontamination": f"""with {_NEAR},
        Q as (select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) as g from I where len(w) > 0),
        G as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from D, (select distinct n from Q))),
        H as (select doc_id, item_id, p, n from G join Q using (n, g)),
        C as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + n)) as x from H) group by doc_id),
        T as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, cast(item_id as varchar) as i from H) group by doc_id)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near from D left join C using (doc_id) left join T using (doc_id) left join (select doc_id, count(*) as n_near from N group by doc_id) using (doc_id)""",
    "proximity_matches": f"with {_NEAR} select doc_id, i as item_id from N",
    "op10_repetition_coverage": f"""with D as (select doc_id, text, regexp_extract_all(text, '{_SPACED}') as w from (select doc_id, coalesce(text, '') as text from documents)),
        G as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from D, (select unnest([5, 6, 7, 8, 9, 10]) as n))),
        H as (select * from (select doc_id, n, p, count(*) over (partition by doc_id, n, g) as c from G) where c > 1),
        X as (select distinct doc_id, n, unnest(range(p, p + n)) as x from H),
        Y as (select doc_id, n, count(*) as words, cast(sum(length(w[x])) as bigint) as chars from X join D using (doc_id) group by 1, 2),
        Z as (select doc_id, max(case when n = 5 then words end) as r, max(case when n = 5 then chars end) as c5, max(case when n = 6 then chars end) as c6, max(case when n = 7 then chars end) as c7, max(case when n = 8 then chars end) as c8, max(case when n = 9 then chars end) as c9, max(case when n = 10 then chars end) as c10 from Y group by doc_id),
        N as (select doc_id, cast(count(*) - count(distinct l) as bigint) as n_dup_lines, cast(sum(length(l)) - sum(case when k = 1 then length(l) else 0 end) as bigint) as dup_line_chars from (select doc_id, l, row_number() over (partition by doc_id, l) as k from (select doc_id, unnest(string_split(text, chr(10))) as l from D) where regexp_matches(l, '{_SPACED}')) group by doc_id),
        B as (select D.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(r, 0) as n_repeat_words, coalesce(dup_line_chars, 0) as dup_line_chars,
          coalesce(c5, 0) as dup_chars_5, coalesce(c6, 0) as dup_chars_6, coalesce(c7, 0) as dup_chars_7, coalesce(c8, 0) as dup_chars_8, coalesce(c9, 0) as dup_chars_9, coalesce(c10, 0) as dup_chars_10 from D left join Z using (doc_id) left join N using (doc_id)),
        V as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from B)
        select *, not base_failed and not (dup_line_chars > 0.3 * word_chars or dup_chars_5 > 0.2 * word_chars or dup_chars_6 > 0.19 * word_chars or dup_chars_7 > 0.18 * word_chars or dup_chars_8 > 0.17 * word_chars or dup_chars_9 > 0.16 * word_chars or dup_chars_10 > 0.15 * word_chars) as kept from V""",
    "op11_filter_audit": f"""with recursive T as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as w from documents),
        M as (select text as t, min(doc_id) as m from T group by text),
        B as (select doc_id, part, case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 4 else 0 end
          + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when doc_id > m then 16 else 0 end as bits from T left join M on t = text),
        L as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
        C as (select part, bits, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from B left join L using (doc_id) group by part, bits),
        O as (select '' as o union all select o || f from O, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) where length(o) < 5 and not contains(o, f)),
        S as (select o as filter_order, step, substr(o, step, 1) as f, (select sum(case when instr(o, x) < step then 1 << (ascii(x) - 65) else 0 end) from (select unnest(['A', 'B', 'C', 'D', 'E']) as x)) as before from (select * from O where length(o) = 5), (select unnest(range(1, 6)) as step)),
        R as (select part, filter_order, cast(step as integer) as step, f, cast(sum(case when bits & before = 0 and bits & bit = 0 then n else 0 end) as bigint) as kept, cast(sum(case when bits & before = 0 and bits & bit > 0 then n else 0 end) as bigint) as removed,
          cast(sum(case when bits & before > 0 and bits & bit > 0 then n else 0 end) as bigint) as redundant, cast(sum(case when bits = bit then n else 0 end) as bigint) as unique_fails,
          cast(sum(case when bits & before = 0 and bits & bit > 0 then good else 0 end) as bigint) as good_lost, cast(sum(case when bits & before = 0 and bits & bit > 0 then toxic else 0 end) as bigint) as toxic_lost
          from C, (select *, 1 << (ascii(f) - 65) as bit from (select filter_order, step, f, cast(before as integer) as before from S)) group by part, filter_order, step, f)
        select * exclude (f), cast(sum(removed) over (partition by part, f) as bigint) as shapley from R""",
    "op13_prefix_trie": """with O as (select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as s from conversations where conv_id is not null group by conv_id),
        H as (select conv_id, s, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: list_concat([ascii(c)], list_transform(range(8), lambda k: -1))))), lambda x, y: case when y >= 0 then xor(x, y) when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end), 4294967295) % 6 as h from O),
        R as (select a.conv_id, list_concat(coalesce(list_slice(b.s, 1, h), []), list_slice(a.s, h + 1, len(a.s))) as s from H a left join O b on b.conv_id = a.conv_id - a.conv_id % 100),
        P as (select conv_id, d, len(s) as n, sha256(coalesce(list_aggregate(list_transform(list_slice(s, 1, d), lambda x: concat(length(x.r), ':', x.r, length(x.t), ':', x.t)), 'string_agg', ''), '')) as p, sha256(coalesce(list_aggregate(list_transform(list_slice(s, 1, d - 1), lambda x: concat(length(x.r), ':', x.r, length(x.t), ':', x.t)), 'string_agg', ''), '')) as q, case when d = 0 then 0 else length(s[d].t) end as chars
          from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from R)),
        N as (select d, p, case when d > 0 then min(q) end as q, min(conv_id) as conv_id, count(*) as n_convs, min(chars) as chars, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (d = n), '') as ends from P group by d, p),
        K as (select d - 1 as d, q as p, count(*) as n from N where d > 0 group by all),
        V as (select N.*, coalesce(n, 0) as n_children from N left join K using (d, p)),
        A as (select P.d, P.p, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * V.chars) as saved from V join P on P.conv_id = V.conv_id and P.d <= V.d group by P.d, P.p)
        select V.conv_id, V.d as depth, U.conv_id as parent_conv_id, V.n_convs, V.n_children, n_leaves, cast(saved as bigint) as saved_tokens, sha256(V.ends) as ends_sha256 from V join A using (d, p) left join N U on U.d = V.d - 1 and U.p = V.q""",
}
