"""Query of operator 1 and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.licenses import PERCENT, SHINGLE, TEMPLATES, WORD_GAP, Templates, find_licenses, windows_of


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), Templates(spark, TEMPLATES))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def _words(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '{WORD_GAP}'), lambda w: w <> '')"


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_SHINGLES = f"array_to_string(w[i + 1 : i + {SHINGLE}], ' ')"
#: Every window against every template by exact containment, without bands.
ORACLE = f"""
with t as (
  select name, {_words("text")} as w from (values {_VALUES}) as v(name, text)
), ts as (
  select distinct name, {_SHINGLES} as s from (select name, w, unnest(range(0, len(w) - {SHINGLE - 1})) as i from t)
), sizes as (
  select name, count(*) as n from ts group by name
), d as (
  select doc_id, {_words("text")} as w from documents
), ds as (
  select doc_id, i, {_SHINGLES} as s from (select doc_id, w, unnest(range(0, len(w) - {SHINGLE - 1})) as i from d)
), hits as (
  select doc_id, i, name, s from ds join ts using (s)
), windows as (
  select doc_id, name, s, size, i // step - back as k, i, step
  from hits, (values {", ".join(map(str, windows_of(TEMPLATES)))}) as z(size, step), (values (0), (1)) as b(back)
), found as (
  select distinct doc_id, name from (
    select doc_id, name, size, k, count(distinct s) as n from windows
    where i >= k * step and i + {SHINGLE} <= k * step + size group by doc_id, name, size, k
  ) x join sizes using (name) where x.n * 100 >= {PERCENT} * sizes.n
), listed as (
  select doc_id, count(*) as n, string_agg(name, ',' order by name) as names from found group by doc_id
)
select d.doc_id, coalesce(n, 0) as n_licenses, coalesce(names, '') as licenses from d left join listed using (doc_id)
"""
