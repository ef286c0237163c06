"""Query of operator 5 and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm.topk import top_k


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), q as (
  select vec_id, min(e) as e from v where vec_id % 50 = 0 group by vec_id
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from q join v c on c.vec_id <> q.vec_id
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
