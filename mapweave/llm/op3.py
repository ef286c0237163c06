"""Query of operator 3."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.secrets import KINDS, find_secrets, labelled_samples, train


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns of find_secrets()."""
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("secrets")).alias("spans"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled_samples(spark))))
