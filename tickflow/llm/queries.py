"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickflow.llm import (collocations, conversation_trie, decontamination, language_id, line_dedup, near_dedup, neighbours,
                          packing, pii, substring_dedup, suffix_dedup, token_output, toxicity)
from tickflow.runtime import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


@query("op1_pii")
def op1(spark, sf_dir):
    return pii.contract(pii.personal_data(table(spark, sf_dir, "documents")))


@query("op2_substring_dedup")
def op2(spark, sf_dir):
    return substring_dedup.contract(substring_dedup.repeated_passages(table(spark, sf_dir, "documents")))


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    return suffix_dedup.contract(suffix_dedup.repeated_strings(table(spark, sf_dir, "documents")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_packing")
def op4(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op5_near_dedup")
def op5(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_token_output")
def op6(spark, sf_dir):
    return token_output.packed_ids(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op7_line_dedup")
def op7(spark, sf_dir):
    return line_dedup.contract(line_dedup.dedup_lines(
        table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, scored = toxicity.train_scored(docs, table(spark, sf_dir, "labels"))
    return toxicity.contract(toxicity.judged(scored, model) if scored is not None else toxicity.toxicity(docs, model))


@query("op9_neighbours")
def op9(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query("op10_decontamination")
def op10(spark, sf_dir):
    return decontamination.contract(decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op11_conversation_trie")
def op11(spark, sf_dir):
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_collocations")
def op12(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_language_id")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.contract(language_id.label_words(docs, language_id.train(docs)))


# --- SQL of the operators that it can express ---------------------------------------------------

ORACLES["op2_substring_dedup"] = r"""
with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (
  select doc_id, p, array_to_string(ws[p:p + 12], ' ') as passage
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 12)) as p from w where len(ws) >= 13)),
hit as (
  select doc_id, p from g join (select passage, min(doc_id) as first from g group by passage) using (passage)
  where first < doc_id),
gone as (select distinct doc_id, p + o as i from hit, generate_series(0, 12) t(o)),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as text from words anti join gone using (doc_id, i) group by doc_id),
counts as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from w left join counts using (doc_id) left join kept using (doc_id)"""

ORACLES["op3_suffix_dedup"] = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
g as (
  select doc_id, p, substr(h, 2 * p - 1, 100) as string
  from (select doc_id, h, unnest(generate_series(1, length(h) // 2 - 49)) as p from d where length(h) >= 100)),
hit as (
  select doc_id, p from g join (select string, min(doc_id) as first from g group by string) using (string)
  where first < doc_id),
gone as (select distinct doc_id, p + o as i from hit, generate_series(0, 49) t(o)),
bytes as (select doc_id, i, substr(h, 2 * i - 1, 2) as b
          from (select doc_id, h, unnest(generate_series(1, length(h) // 2)) as i from d)),
kept as (select doc_id, string_agg(b, '' order by i) as h from bytes anti join gone using (doc_id, i) group by doc_id),
spans as (
  select doc_id, count(*) as n, sum((before is distinct from i - 1)::int) as runs
  from (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from gone) group by doc_id)
select d.doc_id, (length(d.h) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed,
       coalesce(runs, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.h, ''))) as kept_sha256
from d left join spans using (doc_id) left join kept using (doc_id)"""

_SPLIT = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLES["op10_decontamination"] = f"""
with d as (select doc_id, {_SPLIT} as ws from documents),
b as (select item_id, {_SPLIT} as ws from benchmark),
items as (
  select distinct item_id, n, array_to_string(ws[p:p + n - 1], ' ') as passage
  from (select item_id, ws, least(10, len(ws)) as n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) as p
        from b where len(ws) > 0)),
sizes as (select distinct n from items),
windows as (
  select doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') as passage
  from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as p from d, sizes where len(ws) >= n)),
hit as (select doc_id, n, p, item_id from windows join items using (n, passage)),
places as (select doc_id, count(distinct i) as n_hit
           from (select doc_id, unnest(generate_series(p, p + n - 1)) as i from hit) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
          from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join named using (doc_id)"""

ORACLES["op12_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
totals as (select lang, sum(len(ws))::bigint as n from w group by lang),
g as (
  select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase, count(*) as f
  from (select lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) as i
        from w, (select unnest([1, 2, 3, 4]) as m) where len(ws) >= m) group by all),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from g where m > 1 and f >= 30),
cuts as (
  select c.lang, c.phrase, m, a, k, x.f as l, y.f as r, (2000000::hugeint * a) // (x.f + y.f) as score
  from (select *, unnest(generate_series(1, m - 1)) as k from c) c
  join (select lang, phrase, f from g where f >= 30) x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1:k], ' ')
  join (select lang, phrase, f from g where f >= 30) y on y.lang = c.lang and y.phrase = array_to_string(c.ws[k + 1:m], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
  select lang, array_to_string(ws[i:i + s - 1], ' ') as phrase, max(a) as over
  from (select lang, ws, a, s, unnest(generate_series(1, m - s + 1)) as i
        from c, (select unnest([2, 3]) as s) where s < m) group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n,
       score::bigint as score
from best left join inner_parts using (lang, phrase) join totals using (lang)
where not coalesce(100::hugeint * over >= 80::hugeint * a, false)
qualify rank <= 2000"""

# crc32 of a decimal number, bit by bit
_CRC32 = ("xor(list_reduce(list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint), lambda a, x: "
          "list_reduce(list_concat([xor(a, x)], range(8)), lambda b, i: xor(b >> 1, (b & 1) * 3988292384)), 4294967295::bigint), "
          "4294967295::bigint)")
ORACLES["op11_conversation_trie"] = f"""
with t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
  from conversations where conv_id is not null),
convs as (select c, c - c % 100 as base, {_CRC32} % 6 as h from (select distinct c from t)),
r as (
  select convs.c, 0 as side, pos, role, text from convs join t on t.c = base where pos < h
  union all select convs.c, 1, pos, role, text from convs join t using (c) where pos >= h),
named as (
  select c, row_number() over (partition by c order by side, pos) as depth, length(text) as size,
         md5(length(role) || ':' || role || text) as name from r),
paths as (
  select c, depth, size, string_agg(name, '' order by depth) over (partition by c order by depth) as path from named
  union all select c, 0, 0, '' from convs),
nodes as (select depth, path, min(c) as conv_id, count(*) as n_convs, any_value(size) as size from paths group by depth, path),
ends as (select path, string_agg(c::varchar, ',' order by c) as ids
         from (select c, max_by(path, depth) as path from paths group by c) group by path),
family as (select path, count(*) as n_children from (select left(path, (depth::int - 1) * 32) as path from nodes where depth > 0) group by path),
subtrees as (
  select left(n.path, d::int * 32) as path, sum((n_convs - 1) * size)::bigint as saved_tokens, count(*) filter (f.path is null) as n_leaves
  from (select *, unnest(generate_series(0, depth)) as d from nodes) n left join family f on f.path = n.path group by 1)
select n.conv_id, n.depth::bigint as depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children,
       n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from nodes n join subtrees using (path) left join family using (path) left join ends using (path)
left join nodes up on up.path = left(n.path, (n.depth::int - 1) * 32) and up.depth = n.depth - 1"""
