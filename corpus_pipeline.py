"""A training corpus from documents, in five stages; each is written as Parquet and read again.

quality classifier, quality rules, line dedup, near-duplicate removal, packing. All but the last
return the columns of documents. Each stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark import workspace
from shelfspark.llm import classifier, dartminhash, line_dedup, packing, quality_rules

ORACLE_SQL = None  # a trained model, SimHash lines and tokenised lengths have no SQL form; tests/llm checks every stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of labels.quality scores at its threshold or more."""
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their hosts' frequent lines."""
    return quality_rules.clean(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one occurrence of each group of like lines left in all the corpus."""
    return line_dedup.dedup_texts(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return dartminhash.keep_first(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece of a document."""
    import public_tokenizers as tokenizers

    return packing.pack_documents(docs, packing.encoder(tokenizers.path("byte_bpe_50k.json")), end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("best-fit packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's intermediates, and its input but the first, go once its output is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = workspace.new_path(spark, name.replace(" ", "_"))
        with workspace.scope(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        if last:
            workspace.remove(spark, last)
        docs, last = spark.read.parquet(out), out
    return docs
