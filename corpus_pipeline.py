"""The corpus pipeline: every stage works on what its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.bpe import round_trip
from gridlake.llm.common import bounded_batches, table, written
from gridlake.llm.language import identify_documents
from gridlake.llm.mixing import domain_labels, mix
from gridlake.llm.neardup import near_duplicates
from gridlake.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, under that language; rejected ones go."""
    found = identify_documents(docs).where("language_id.kept")
    return found.select(*[F.col("language_id.language").alias("lang") if c == "lang" else found[c] for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one of the smallest doc_id.

    Rows that repeat a doc_id are no different documents: one of them stays, the first by text. Rows
    without a doc_id stay.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    return one_of_each(named).select(*docs.columns).union(docs.where("doc_id is null"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each doc_id; the texts are only moved for ids that repeat."""
    repeated = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return docs
    single = docs.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    several = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias("__r"))
    return single.union(several.select("__r.*").select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows the text."""
    bounded_batches(spark)
    clean = docs.withColumn("text", redact(docs["text"]))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the fitted rates select; a rate of one or more always does."""
    rates = mix(docs, domain_labels(table(spark, sf_dir, "labels"))).where("not selected").select("doc_id").distinct()
    gone = written(rates.where("doc_id is not null"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text beside source, language and length of each document."""
    bounded_batches(spark)
    found = docs.withColumn("__bpe", round_trip(docs["text"]))
    return found.select("doc_id", "lang", "source", "n_chars", "__bpe.*")


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express the language model, the classifier or the tokenizer; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
