"""From raw documents to token ids: five stages, each over all that the stage before it kept.

Every stage takes and (but for the last) returns the columns of ``documents``, whatever other columns they stand among. Null, empty
and very long texts, repeated rows, equal and missing ids, ties and an empty table have a defined result in each, stated below and in
the operators; none of them stops a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, common, decontamination, language_id, ngram_join, substring_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: null, empty, without a letter. Rows are judged one by one, repeated ones alike; without any
    labelled row all go, as none has a learned language."""
    return language_id.undetermined_removed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity class stays: the smallest id. Five-word shingles, similarity 0.8 or more. Null and empty texts
    stay; repeated rows are one document; rows with equal ids are told apart by their texts, rows without an id come last."""
    return ngram_join.near_duplicates_removed(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that start in a smaller document are cut; emptied documents go. Null, empty and short texts stay as
    they are; repeated rows and rows with equal ids cut nothing from each other; a missing id is larger than all."""
    return substring_dedup.repeats_removed(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule finds go, each judged by its own text. Null and empty texts stay."""
    return decontamination.contaminated_removed(docs, common.documents_of(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of ids and decoded text; a null text has none. One row a row, repeated ones too."""
    return bpe.encode_decode(docs, outputs=("ids",))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: No SQL for the similarity classes, the automata or the learned filters: tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again. What a stage stored on
    its way, and the rows of the stage before it, are deleted once its own rows are written."""
    docs = common.documents_of(spark, sf_dir)
    last = None
    for name, stage in STAGES:
        with common.intermediates() as made:
            docs = common.stored(stage(spark, docs, sf_dir))
            made.remove(docs)
        if last is not None:
            common.dropped(last)
        last = docs
    return docs
