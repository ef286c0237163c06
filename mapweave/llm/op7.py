"""Query of operator 7 and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm.warc import round_trip


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Base 32 of the 160 bits of a SHA-1 digest: each 5 hex digits are 4 characters.
ORACLE = """
with p as (
  select page_id, coalesce(html, '') as body from pages
), d as (
  select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes, sha1(body) as hex from p
), n as (
  select *, list_transform(range(0, 8), lambda i: cast('0x' || substr(hex, cast(5 * i + 1 as bigint), 5) as bigint)) as parts,
    min(page_id) over (partition by hex) as first_id
  from d
)
select page_id, payload_bytes,
  list_aggregate(list_transform(parts, lambda v: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> s) % 32 + 1, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from n
"""
