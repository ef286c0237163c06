"""Query of operator 6 and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.decontaminate import decontaminate


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near"))


_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOW + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: Every window against every position, without an index.
ORACLE = f"""
with items as (
  select distinct cast(item_id as varchar) as item, {_WORDS.format("text")} as w from benchmark
), wins as (
  select row_number() over () as win, * from (
    select distinct item, least(13, len(w)) as size, w[i + 1 : i + least(13, len(w))] as words
    from (select item, w, unnest(range(0, greatest(len(w) - 12, least(len(w), 1)))) as i from items)
  )
), docs as (
  select row_number() over () as doc, doc_id, {_WORDS.format("text")} as w from documents
), spots as (
  select doc, w, i from (select doc, w, unnest(range(0, len(w))) as i from docs)
), hits as (
  select doc, i, wins.size, item from wins join (
    select doc, i, z.size, w[i + 1 : i + z.size] as words from spots, (select distinct size from wins) as z where i + z.size <= len(w)
  ) s on s.size = wins.size and s.words = wins.words
), hit_words as (
  select doc, count(distinct p) as n from (select doc, unnest(range(i, i + size)) as p from hits) group by doc
), hit_items as (
  select doc, count(distinct item) as n, string_agg(distinct item, ',' order by item) as names from hits group by doc
), anchors as (
  select win, item, words, list_extract(list_sort(list_transform(range(0, len(words)), lambda k: {{'n': -strlen(words[k + 1]), 'k': k, 'w': words[k + 1]}})), 1).w as anchor from wins
), near as (
  select doc, count(distinct item) as n from (
    select doc, w, i, item, words from spots join anchors on anchor = w[i + 1]
  ) where list_has_all(w[greatest(i - 20, 0) + 1 : i + 21], words) group by doc
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit_words.n, 0) as n_hit, coalesce(hit_items.n, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(hit_words.n, 0) > 0 and 20 * coalesce(hit_words.n, 0) >= len(w) as contaminated, coalesce(near.n, 0) as n_near
from docs left join hit_words using (doc) left join hit_items using (doc) left join near using (doc)
"""
