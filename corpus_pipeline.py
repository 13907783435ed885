"""Corpus pipeline: quality, near duplicates, benchmark passages, personal data, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last
return the columns of documents. Where a stage changes a text, ``n_chars`` follows it. Rows without doc_id
cannot be told apart and are never removed as near duplicates; rows with the same doc_id are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.decontaminate import Decontaminator
from clickloom.llm.jaccard_join import JaccardJoin
from clickloom.llm.pieces_sampling import PieceSampler
from clickloom.llm.pii import PiiFinder
from clickloom.llm.quality import QualityClassifier
from clickloom.llm.tables import read
from clickloom.session import new_path


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: all of them where it could learn nothing."""
    return QualityClassifier().keep(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five words, similarity 0.8."""
    groups = JaccardJoin(width=5, percent=80).classes(docs)
    others = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    return _counted(Decontaminator().remove(docs, read(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(PiiFinder().redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document."""
    return PieceSampler().encode(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("encode", encode),
]

# trained models and sampled segmentations are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written and reread before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
