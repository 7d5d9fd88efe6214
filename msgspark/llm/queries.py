"""The numbered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_cnn, divergence, fm_dedup, jaccard_join, lm_score, mixing, period_runs, piece_nbest, quality_rules, rp_forest, sharding
from . import suffix_dedup, token_file
from .storage import documents, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(spread(documents(spark, sf_dir)))


def _rules_sql() -> str:
    bounds = []
    for r in quality_rules.RULES:
        if r.low is not None:
            bounds.append(f"({r.bottom} = 0 or {r.top}::double >= {r.low!r}::double * {r.bottom}::double)")
        if r.high is not None:
            bounds.append(f"({r.bottom} = 0 or {r.top}::double <= {r.high!r}::double * {r.bottom}::double)")
    return " and ".join(bounds)


ORACLES["op10_quality_rules"] = rf"""
with texts as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
counted as (
  select doc_id, t, words, len(words) as n_words, coalesce(length(array_to_string(words, '')), 0) as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         len(list_filter(words, lambda w: w in ({", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)}))) as n_stop_words
  from texts),
windows as (
  select doc_id, i, array_to_string(words[i:i + 7], ' ') as w
  from (select doc_id, words, unnest(range(1, greatest(1, n_words - 6))) as i from counted)),
again as (select doc_id, i from windows qualify count(*) over (partition by doc_id, w) > 1),
gaps as (select doc_id, least(8, coalesce(lead(i) over (partition by doc_id order by i) - i, 8)) as g from again),
repeats as (select doc_id, sum(g) as n from gaps group by doc_id),
base as (
  select c.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(r.n, 0)::bigint as n_repeat_words, len(lines) as n_lines, n_stop_words,
         n_words < 20 or 100 * coalesce(r.n, 0) > 30 * n_words as base_failed
  from counted c left join repeats r on c.doc_id = r.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {_rules_sql()} as kept, n_lines, n_stop_words from base
"""


@query
def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(spread(documents(spark, sf_dir)), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file.new_path(spark)
    token_file.write_files(spread(documents(spark, sf_dir)), path, public_tokenizers.path("word_bpe_49k.json"), 2, 49_408)
    return token_file.digests(spark, path)


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spread(documents(spark, sf_dir))).drop("kept")


ORACLES["op1_suffix_array_dedup"] = """
with texts as (
  select doc_id, hex(encode(coalesce(text, ''))) as hx, octet_length(encode(coalesce(text, ''))) as n_bytes from documents),
parts as (
  select doc_id, j, substr(hx, 200 * j + 1, 398) as c from (
    select doc_id, hx, unnest(range(0, (greatest(0, n_bytes - 99) + 99) // 100)) as j from texts)),
windows as (
  select doc_id, 100 * j + k as i, md5(substr(c, 2 * k + 1, 200)) as w from (
    select doc_id, j, c, unnest(range(0, length(c) // 2 - 99)) as k from parts)),
again as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) as k from windows)
  where k > 1),
steps as (
  select doc_id, i, lag(i) over w as before, lead(i) over w as after from again window w as (partition by doc_id order by i)),
removed as (
  select doc_id, sum(least(100, coalesce(after - i, 100)))::bigint as n_removed,
         sum(case when before is null or i - before > 100 then 1 else 0 end)::bigint as n_spans from steps group by doc_id),
pieces as (
  select s.doc_id, s.i as k, substr(hx, 2 * coalesce(before + 100, 0) + 1, 2 * greatest(0, i - coalesce(before + 100, 0))) as x
  from steps s join texts t on s.doc_id = t.doc_id
  union all
  select s.doc_id, s.i + 1000000000, substr(hx, 2 * (i + 100) + 1) from steps s join texts t on s.doc_id = t.doc_id
  where after is null),
kept as (select doc_id, string_agg(x, '' order by k) as x from pieces group by doc_id)
select t.doc_id, n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(k.x, t.hx))) as kept_sha256
from texts t left join removed r on t.doc_id = r.doc_id left join kept k on t.doc_id = k.doc_id
"""


@query
def op6_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeats(spread(documents(spark, sf_dir))).drop("kept_text")


ORACLES["op6_fm_index_dedup"] = r"""
with texts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) as w
  from (select doc_id, words, unnest(range(1, greatest(1, len(words) - 11))) as i from texts)),
again as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by w) as d from windows) where d < doc_id),
gone as (select distinct doc_id, i + k as i from (select doc_id, i, unnest(range(0, 13)) as k from again)),
words as (select doc_id, words[i] as w, i from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from texts)),
kept as (
  select w.doc_id, string_agg(w.w, ' ' order by w.i) as x, count(*) as n
  from words w anti join gone g on w.doc_id = g.doc_id and w.i = g.i group by w.doc_id)
select t.doc_id, len(words)::bigint as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(x, '')) as kept_sha256
from texts t left join kept k on t.doc_id = k.doc_id
"""


@query
def op2_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(spread(documents(spark, sf_dir)))


@query
def op2_prefix_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, its class and with how many others its set agrees."""
    return jaccard_join.link_counts(spread(documents(spark, sf_dir)))


@query
def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rp_forest.nearest(vectors, F.pmod("id", F.lit(20)) == 0)


@query
def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    return byte_cnn.score(docs, byte_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the whole table, as often as a budget of the corpus's own size uses it."""
    docs = spread(documents(spark, sf_dir)).select("doc_id", "source", "text")
    budget = docs.agg(F.coalesce(F.sum(mixing.n_words("text")), F.lit(0))).first()[0]
    return mixing.mix(docs, budget=budget).select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "n_words",
        F.col("epoch").cast("int").alias("epoch"), F.col("block").cast("int").alias("block"))


@query
def op5_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_nbest.encode(spread(documents(spark, sf_dir)), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


ORACLES["op2_prefix_tree_join"] = r"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as words from documents),
sets as materialized (
  select distinct doc_id, array_to_string(words[i:i + 3], ' ') as s
  from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) as i from texts where len(words) > 0)),
sizes as materialized (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as digest from sets group by doc_id),
links as materialized (
  select x, y from (select a.doc_id as x, b.doc_id as y, count(*) as both_have
                    from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2) p
  join sizes m on m.doc_id = x join sizes k on k.doc_id = y where 100 * both_have >= 85 * (m.n + k.n - both_have)),
edges as materialized (select x as a, y as b from links union all select y, x from links),
reach(d, r) as (select doc_id, doc_id from documents union select d, b from reach join edges on a = r),
least as (select d, min(r) as component_id from reach group by d)
select t.doc_id, coalesce(n, 0) as n_shingles, component_id,
       coalesce(min(t.doc_id) over (partition by case when n > 0 then digest else t.doc_id::varchar end), t.doc_id) as class_id
from texts t join least on d = t.doc_id left join sizes s on s.doc_id = t.doc_id
"""

ORACLES["op2_prefix_tree_links"] = r"""
with texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as words from documents),
sets as materialized (
  select distinct doc_id, array_to_string(words[i:i + 3], ' ') as s
  from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) as i from texts where len(words) > 0)),
sizes as materialized (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as digest from sets group by doc_id),
links as materialized (
  select x, y from (select a.doc_id as x, b.doc_id as y, count(*) as both_have
                    from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2) p
  join sizes m on m.doc_id = x join sizes k on k.doc_id = y where 100 * both_have >= 85 * (m.n + k.n - both_have)),
per_doc as (select x, count(*) as n_links from links group by x)
select t.doc_id, coalesce(n, 0) as n_shingles, coalesce(n_links, 0) as n_links,
       coalesce(min(t.doc_id) over (partition by case when n > 0 then digest else t.doc_id::varchar end), t.doc_id) as class_id
from texts t left join per_doc on x = t.doc_id left join sizes s on s.doc_id = t.doc_id
"""


@query
def op11_tiled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.report(spread(documents(spark, sf_dir)), plant=True)


#: crc32 of a number's digits, from the polynomial 0xEDB88320.
_CRC32 = """crc_table as materialized (
  select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
    case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
crc as materialized (
  select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) as h from (select distinct doc_id from documents), crc_table)"""

ORACLES["op11_tiled_runs"] = rf"""
with {_CRC32},
texts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, h % 10 = 0 as hit, h // 10 as g
  from documents join crc using (doc_id)),
laid as (
  select doc_id, w, hit and len(w) > 0 as hit, case when len(w) > 0 then g % len(w) end as a, g from texts),
words as materialized (
  select doc_id, case when hit then list_transform(range(len(w)), lambda i:
    case when i < a then w[i + 1] else w[a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1] end) else w end as w from laid),
periods as (select doc_id, w, unnest(range(1, len(w) // 4 + 1)) as q from words),
starts as (select doc_id, w, q, unnest(range(0, len(w) - 2 * q, q)) as i from periods),
likely as (select distinct doc_id, q from starts where w[i + 1] = w[i + q + 1] and w[i + q + 1] = w[i + 2 * q + 1]),
agree as (
  select doc_id, q, i from (select l.doc_id, q, w, unnest(range(0, len(w) - q)) as i from likely l join words t on l.doc_id = t.doc_id)
  where w[i + 1] = w[i + q + 1]),
islands as (
  select doc_id, q, min(i) as s, count(*) + q as n from (
    select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from agree) group by doc_id, q, k),
runs as materialized (
  select doc_id, s, n, min(q) as q from islands where n >= greatest(6, 4 * q) group by doc_id, s, n),
listed as (
  select doc_id, count(*) as n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as x from runs group by doc_id),
best as (
  select doc_id, s, n, q from runs r where not exists (
    select 1 from runs o where o.doc_id = r.doc_id and (o.n * r.q > r.n * o.q or (o.n * r.q = r.n * o.q and (o.s, o.q) < (r.s, r.q))))),
gone as (select distinct doc_id, unnest(range(s + q, s + n)) as i from runs),
placed as (select doc_id, w[i + 1] as x, i from (select doc_id, w, unnest(range(0, len(w))) as i from words)),
kept as (
  select p.doc_id, string_agg(x, ' ' order by p.i) as x from placed p anti join gone g on p.doc_id = g.doc_id and p.i = g.i group by p.doc_id)
select t.doc_id, coalesce(n_runs, 0) as n_runs, s as start, n as length, q as period, (1000 * n) // q as exponent_milli,
       sha256(coalesce(l.x, '')) as runs_sha256, sha256(coalesce(k.x, '')) as collapsed_sha256
from words t left join listed l on t.doc_id = l.doc_id left join best b on t.doc_id = b.doc_id left join kept k on t.doc_id = k.doc_id
"""


@query
def op12_perfect_hash_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spread(documents(spark, sf_dir)))


ORACLES["op12_perfect_hash_recount"] = r"""
with texts as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
used as materialized (select i, lang, source, t, count(*) as n from (
  select i, lang, source, unnest(words) as t from texts) group by all),
kept as materialized (select lang, t, sum(n)::hugeint as m from used group by lang, t having count(*) >= 3),
counts as materialized (
  select lang, source, t, sum(n)::hugeint as n from used join kept using (lang, t) group by lang, source, t),
groups as materialized (
  select g.lang, g.source, coalesce(total, 0)::hugeint as total from (select distinct lang, source from texts) g
  left join (select lang, source, sum(n) as total from counts group by lang, source) c on g.lang = c.lang and g.source = c.source),
langs as (select lang, count(*)::hugeint as v, sum(m)::hugeint as total from kept group by lang),
shares as materialized (
  select g.lang, g.source, k.t, coalesce(n, 0) as n, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (g.total + l.v) as p,
         1 + (1000000000 * (m + 1)) // (l.total + l.v) as q
  from groups g join langs l on g.lang = l.lang join kept k on g.lang = k.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.t = k.t),
sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value
  from shares a join shares b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by 1, 2, 3),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (
  select lang, source, 'term' as part, t as item, (((p - q) * (p - q)) // q)::bigint as value from shares where n > 0 and p > q)
select *, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from pairs
union all
select * from (select *, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from terms) where rank <= 200
"""


@query
def op13_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    return lm_score.score(docs, lm_score.fit(docs))
