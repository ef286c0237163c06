"""Query of operator 10."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.langid import Model, identify, train


def fold(doc_id: str = "doc_id") -> Column:
    """Whether a document is held out from learning; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> Model:
    return train(docs.where(~fold() & F.col("doc_id").isNotNull()))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs)).select("doc_id", fold().alias("held_out"), "lang_pred", "score", "ambiguous")
