"""Query of operator 8."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.toxicity import score, train


def fold(doc_id: str = "doc_id") -> Column:
    """Whether a document is held out from learning; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, train(docs, labels.where(~fold())))
    return found.select("doc_id", fold().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
