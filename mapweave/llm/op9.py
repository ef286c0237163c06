"""Query of operator 9."""

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm.bpe import round_trip


def apply(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark.read.parquet(f"{sf_dir}/documents.parquet"))
