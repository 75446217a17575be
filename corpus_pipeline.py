"""A corpus pipeline of the llm operators: language, toxicity, repeated lines, near-duplicates, packing.

run() writes each stage's documents to the shared checkpoint folder and reads them again as the next one's input; a stage's own
intermediate tables, and the documents before it, are deleted as soon as its documents are written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import language_id, line_dedup, packing, simhash, toxicity
from tallyloom.llm.queries import held_out
from tallyloom.llm.scratch import discard, materialize, temporary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in one of the corpus languages."""
    judged = language_id.identify(docs, host=F.col("source"))
    return judged.filter(~F.col("rejected")).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a toxicity below 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit_lexicon(docs, labels, ~held_out())
    return toxicity.score_toxicity(docs, lexicon).filter("toxicity < 0.3").select(*docs.columns)


def no_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of line runs of 50 words or more; n_chars follows the text."""
    out = line_dedup.without_repeated_runs(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to 0.8 or more, found by SimHash."""
    return simhash.keep_one_of_each(docs, words=5, least=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences, with less memory, as the workers hold other stages' tables too."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=50_000, portion=1 << 20)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("line_dedup", no_repeated_lines),
    ("simhash", no_near_duplicates),
    ("packing", packed),
]

#: The tokenizers, the learned lexicon and the fingerprints have no SQL form; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with temporary():
            docs = materialize(stage(spark, before, sf_dir), name, keep=True)
        discard(before)
    return docs
