"""From raw documents to token ids: the stages of a training corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import mixing, near_dedup, quality_classifier, quality_rules, sentencepiece_codec
from orrery.llm.common import dealt, durable, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: null and empty texts go, as too short, and repeated rows are judged alike.

    Later stages have their rows in the tasks that this one writes, so rows that lie in few row groups are dealt out first.
    """
    return quality_rules.accepted(dealt(docs))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good; it learns from labels outside its held-out fold, over all documents, as the rules leave few bad ones.

    An empty text is judged as any other; with no labelled text every document stays, and an empty table stays empty.
    """
    return quality_classifier.good_only(docs, table(spark, sf_dir, "labels"), texts=table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 0.8 alike or more. Rows without doc_id and empty texts stay."""
    return near_dedup.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so rows repeat; a document without words is taken no time."""
    return mixing.repeated(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars with token ids; none for an empty text."""
    return sentencepiece_codec.encoded(docs, sentencepiece_codec.Vocabulary.read())


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]
#: Fitted models and iterated dual problems are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written once to the shared folder, as later stages read their input several times.

    Rows without text go at the rules; rows without doc_id, lang or source stay where a stage keeps them, and repeated rows of
    one doc_id are one document. An empty table gives an empty table. Other columns of documents go along to the mix.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
