"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    arrow_output, collocations, embedding_dups, html_wrappers, language, mixing, packing, simhash, source_divergence, token_counts,
    topk_search, warc, winnowing,
)

Build = Callable[[SparkSession, str], DataFrame]

BUILDS: dict[str, Build] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(build: Build) -> Build:
    BUILDS[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_next(table(spark, sf_dir, "documents"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("row.doc_id", "row.source", "copy", "shuffle_key")


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.label_languages(table(spark, sf_dir, "documents"))


@query
def op6_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query
def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_text(table(spark, sf_dir, "pages"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


@query
def op10_arrow_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_output.arrow_round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk_search.top_inner_products(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", "vec_id", "score")


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op4_mixing"] = mixing.oracle()
ORACLES["op9_warc"] = """
with p as (
  select page_id, coalesce(html, '') as html from pages
), f as (
  select html, min(page_id) as first_id, count(*) as n from p where octet_length(encode(html)) >= 100 group by html
)
select p.page_id, octet_length(encode(p.html)) as payload_bytes, sha256(p.html) as payload_digest,
  case when f.n > 1 and p.page_id is distinct from f.first_id then 'revisit' else 'response' end as record_type,
  case when f.n > 1 and p.page_id is distinct from f.first_id then f.first_id end as refers_to
from p left join f on p.html = f.html
"""

ORACLES["op6_embedding_dups"] = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
    and list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), r as (
  select vec_id as root, vec_id as id from v union select r.root, l.b from r join l on l.a = r.id
), c as (select id, min(root) as component_id from r group by id)
select v.vec_id, (select count(*) from l where l.a = v.vec_id) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.id = v.vec_id
"""

ORACLES["op11_topk_search"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

ORACLES["op12_collocations"] = r"""
with p as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (
  select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from p
), g as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from w, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k
), totals as (
  select lang, count(*) as n from g where k = 1 group by lang
), f as (
  select lang, k, phrase, string_split(phrase, ' ') as w, count(*) as f from g group by lang, k, phrase having count(*) >= 30
), cuts as (
  select lang, k, phrase, w, f, unnest(range(1, k)) as cut from f where k > 1
), scored as (
  select c.lang, c.k, c.phrase, c.f as a, c.cut, l.f as l, r.f as r, cast(2000000::hugeint * c.f // (l.f::hugeint + r.f) as bigint) as score,
  from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.cut], ' ')
    join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
), weakest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), longer as (
  select lang, f as more, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))) as phrase
  from f, (select unnest([2, 3]) as j) where k > j
), covered as (
  select lang, phrase, max(more) as more from longer group by lang, phrase
), ranked as (
  select x.lang, row_number() over (partition by x.lang order by score desc, a desc, x.phrase) as rank, x.phrase, a, l, r, score
  from weakest x left join covered c on c.lang = x.lang and c.phrase = x.phrase
  where c.more is null or 100::hugeint * c.more < 80::hugeint * a
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

ORACLES["op13_source_divergence"] = r"""
with d as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') as w
  from documents
), t as (
  select doc, lang, source, unnest(w) as term from d
), kept as (
  select lang, term, count(*) as n from t group by lang, term having count(distinct doc) >= 3
), v as (
  select lang, count(*) as v, cast(sum(n) as hugeint) as n from kept group by lang
), c as (
  select t.lang, t.source, t.term, count(*) as n from t join kept k on k.lang = t.lang and k.term = t.term group by t.lang, t.source, t.term
), g as (
  select d.lang, d.source, coalesce(max(s.n), 0) as n from (select distinct lang, source from d) d
    left join (select lang, source, cast(sum(n) as hugeint) as n from c group by lang, source) s on s.lang = d.lang and s.source = d.source
  group by d.lang, d.source
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.n + v.v) as p,
    1 + 1000000000::hugeint * (k.n + 1) // (v.n + v.v) as q
  from g join v on v.lang = g.lang join kept k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), every as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(x.value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
    left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, cast((p - q) * (p - q) // q as bigint) from p where n > 0 and p > q
), ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from every
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
"""
