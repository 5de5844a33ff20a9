"""Registered queries of the text operators: each applies one operator, with its production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, extraction, lengths, lexical, packing, ppm, prefixes, quality, rules, simhash, spans, suffix, urls
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_text(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.substring_digest(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.length_histogram(table(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_html_extraction,
        op3_quality_rules,
        op4_packing,
        op5_suffix_dedup,
        op6_token_counts,
        op7_substring_dedup,
        op8_simhash,
        op9_decontamination,
        op10_url_filters,
        op11_prefix_trie,
        op12_lexical_search,
        op13_lm_scoring,
    )
}

# Trained models, tokenizers and hashes that DuckDB lacks are not expressible in its SQL; tests hold those queries against
# brute-force versions.
SQL: dict[str, str] = {
    "op11_prefix_trie": """
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 100 as family, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda r, z: case when r % 2 = 1 then xor(r // 2, 3988292384) else r // 2 end))) % 6 as h
  from (select distinct conv_id from own)),
turns as (
  select c.conv_id, 1 as part, pos, digest, chars from convs c join own o on o.conv_id = c.family where c.conv_id <> family and pos <= h
  union all
  select conv_id, 2, pos, digest, chars from own join convs using (conv_id) where pos > h or conv_id = family),
chained as (
  select conv_id, row_number() over w as depth, sha256(string_agg(digest, '') over w) as node, chars
  from turns window w as (partition by conv_id order by part, pos rows unbounded preceding)),
path as (
  select conv_id, depth, node, chars, coalesce(lag(node) over (partition by conv_id order by depth), '') as parent from chained
  union all select conv_id, 0, '', 0, null from convs),
node as (
  select node, parent, depth, chars, min(conv_id) as conv_id, count(*) as n_convs from path group by all),
child as (select parent as node, count(*) as n from node where depth > 0 group by all),
below as (
  select p.node, sum((v.n_convs - 1) * v.chars) as saved, count(*) filter (where c.n is null) as leaves
  from node v join path p on p.conv_id = v.conv_id and p.depth <= v.depth left join child c on c.node = v.node group by all),
ends as (
  select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha from path
  join (select conv_id, max(depth) as depth from path group by all) using (conv_id, depth) group by all)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, b.leaves as n_leaves,
  b.saved::bigint as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
from node n join below b using (node) left join child c using (node) left join ends e using (node) left join node u on u.node = n.parent
""",
    "op12_lexical_search": r"""
with words as (
  select doc_id, row_number() over () as doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
total as (select count(*) filter (where len(w) > 0) as docs, sum(len(w))::bigint as terms from words),
counted as (select doc, doc_id, n, term, count(*) as tf from (select doc, doc_id, len(w) as n, unnest(w) as term from words) group by all),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as weight from counted, total group by term, docs),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark where item_id is not null),
scored as (
  select item_id, doc, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from asked join weights using (term) join counted using (term), total group by all)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored where score > 0)
where rank <= 50
""",
}
