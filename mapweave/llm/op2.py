"""Query of operator 2 and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm.near_dedup import near_duplicates


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Every pair of texts with a shingle in common, and the links' closure.
ORACLE = rf"""
with recursive d as (
  select doc_id, list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), sh as (
  select distinct doc_id, array_to_string(w[i + 1 : i + 5], ' ') as s from (select doc_id, w, unnest(range(0, greatest(len(w) - 4, least(len(w), 1)))) as i from d)
), sizes as (
  select doc_id, count(*) as n from sh group by doc_id
), links as (
  select a, b from (
    select x.doc_id as a, y.doc_id as b, count(*) as k from sh x join sh y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2
  ) join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 75 * (p.n + q.n - k)
), reach as (
  select doc_id, doc_id as root from documents
  union
  select b, root from reach join links on a = doc_id where root < b
), found as (
  select doc_id, min(root) as component_id from reach group by doc_id
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d left join sizes using (doc_id) left join found using (doc_id)
"""
