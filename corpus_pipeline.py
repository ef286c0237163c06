"""A pipeline over `documents`: language ID, near-dedup, decontamination, secret redaction, BPE.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
all but the last return the columns of `documents`, whatever their names and
however many more there are. A document without doc_id goes through every stage;
the near-duplicate stage keeps it, since its groups are made of ids. Rows that
repeat a doc_id are one document from there on, with the text of the least hash.
An empty table stays empty, and an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import decontaminate, langid, near_dedup, op9, op10, secrets
from mapweave.llm.scratch import Scratch, made_since

#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Lets Spark send rows to Python in batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, key: DataFrame, name: str, of) -> DataFrame:
    """The rows of `docs` for which `of` isn't among the values of the only column of `key`."""
    name = unused(docs, name)
    return docs.join(key.toDF(name), of == F.col(name), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the others teach; texts without letters go.

    A text that is about as near to two codewords keeps the nearer one: an
    ambiguous language is no reason to lose a document.
    """
    bounded(spark)
    return docs.where(langid.language(F.col("text"), op10.learn(docs)) != "und")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; of rows with its id, the one whose text has the least hash."""
    bounded(spark)
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = Scratch(spark, "repeated").save(again, "ids")
    name = unused(docs, "again_id")
    repeated = without(docs.join(again.toDF(name), F.col("doc_id") == F.col(name), "left_semi"), gone, "gone_id", F.col("doc_id"))
    order = F.struct(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), F.xxhash64(*(c for c, kind in docs.dtypes if not kind.startswith("map"))))
    one = repeated.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return without(docs, gone.unionByName(again).distinct(), "gone_id", F.col("doc_id")).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages. A row is known by the hash of its id and text."""
    bounded(spark)
    row = F.xxhash64("doc_id", "text")
    found = decontaminate.decontaminate(docs.select(row.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated").select("doc_id").distinct(), "bad_row", row)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask for every secret; n_chars follows a changed text."""
    models = secrets.train(secrets.labelled_samples(spark))
    clean = unused(docs, "redacted_text")
    changed = ~F.col(clean).eqNullSafe(F.col("text"))
    columns = {"text": F.col(clean), "n_chars": F.when(changed, F.length(clean).cast("long")).otherwise(F.col("n_chars"))}
    return docs.withColumn(clean, secrets.redact(F.col("text"), models)).select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    bounded(spark)
    return op9.apply(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("bpe", bpe),
]

#: SQL can't express learned language models, near-duplicate components and byte-pair merging.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before it kept, each written to the shared folder and read again.

    What a stage's operators wrote for themselves goes as soon as its result is
    written, and a result as soon as the next one is.
    """
    scratch, last = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with made_since():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
