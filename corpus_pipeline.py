"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
rereads it as the next stage's docs. All but the last return the columns of documents, with any others that were there.

In every stage an empty table gives an empty result, columns beyond those of documents are carried along whatever their
names, and each row counts by itself where rows repeat, unless the stage's own text says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.classifier import keep_quality
from corpusloom.llm.linededup import without_repeated_lines
from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.ngramjoin import drop_near_duplicates
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.shared import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, trained on the labels, rejects.

    Null, empty and blank texts are judged by statistics that are all 0. Equal texts are judged alike; without labels all stay.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated and near-repeated lines; documents of which no line is left go.

    Null and blank texts have no lines to lose and stay. Of similar lines the first stays, by doc_id (null first) and line
    number; rows that share a doc_id count as one document, whose equal lines at equal places stay or go together.
    """
    return without_repeated_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the least doc_id that is not null.

    Null, empty and blank texts have no n-grams and stay. Of rows that share the doc_id that is kept, one stays.
    """
    return drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mix of sources; a document drawn several times is as many rows.

    A null source is a source of its own; a null or empty text has the least weight. Ties go by doc_id, length and a hash of the text.
    """
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the drawn documents into sequences.

    Null, empty and blank texts are in no sequence; repeated rows are packed once each; equal lengths go by doc_id, null first.
    """
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Boosted trees, MinHash components and best-fit packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = ""
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
