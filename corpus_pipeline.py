"""The corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, substring dedup, packing.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and reread as the
next stage's documents. All but the last keep the columns of ``documents``.

Cases, of all stages: an empty table gives no rows; texts of any length are read whole; rows are judged one by one, so a
null or repeated id does no harm; columns beside doc_id, text, source and n_chars may have any names and are passed
through. The stages say what becomes of null and empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuefind.llm import lsh_forest, mil_classifier, packing, quality_rules, substring_dedup
from cuefind.llm.common import table
from cuefind.session import scratch_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules accept. Null and empty texts have no words and go; a posterior of exactly the
    limit stays; repeated rows are all kept or all go."""
    return quality_rules.judge(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. It learns from the labelled documents of the
    whole table: after the rules, hardly a bad example is left to learn from. A null or empty text is one empty
    passage and is judged like any other; a score of exactly 0.5 stays; repeated rows have equal scores."""
    model = mil_classifier.fit(table(spark, sf_dir, "documents", "doc_id", "text"),
                               table(spark, sf_dir, "labels", "doc_id", "quality"))
    return mil_classifier.accept(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id (of repeated ids, the row read
    first). Null and empty texts and documents without an id are in no class and all stay."""
    return lsh_forest.first_of_class(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without word sequences that start earlier in the corpus (``n_chars`` follows). Null texts stay
    null, a text that loses all its words stays as an empty one; a null id counts as the smallest; rows that
    repeat id and text are one document and are not cut by each other."""
    return substring_dedup.clean(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens, with their token ids. A null or empty text is its end
    token alone; a null source is a source; repeated rows are packed each."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", classifier_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: Posteriors, a trained model, MinHash and BPE are beyond SQL: the stages are tested against
#: brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
