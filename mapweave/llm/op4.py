"""Query of operator 4."""

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm.token_counts import count_tokens


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
