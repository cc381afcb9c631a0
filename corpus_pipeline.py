"""A corpus from raw documents to packed windows, in stages that are each written and read again.

Every stage but the last returns the columns of documents, with any others that the table has, whatever their names.
Rows that repeat, ties, very long and empty texts, nulls in any column and empty tables have a result each, as stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import decontamination, language_id, near_dedup, packing, shared, substring_dedup


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no words, of whose words no language has a third, or that are in no learned language.

    A null or empty text has no words, so it goes; a null doc_id or any other null doesn't matter.  Repeated rows fare
    alike.  Of languages with equally many words the first by name counts.  Very long texts are judged whole.  Without
    labelled rows no language is learned and none stays; an empty table stays empty.
    """
    return language_id.in_known_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least doc_id.

    Rows with a null doc_id or text, and texts without a word, are in no group and stay.  Of rows that repeat both
    doc_id and text one stays.  Very long texts are compared whole.  An empty table stays empty.
    """
    return near_dedup.without_near_duplicates(docs)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of lesser doc_id has are cut out, and a document of which no word is left goes.

    Rows with a null doc_id or text stay as they are.  Rows that repeat a doc_id count as one document, whose own
    repeats stay.  Very long texts are cut whole.  An empty table stays empty.
    """
    return substring_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that share a span with a benchmark item.

    Rows with a null doc_id or text stay, as do empty texts; items with a null id or text count for nothing, and repeated
    items once.  Rows that repeat a doc_id are each judged by their own text, whole.  If either table is empty all
    stay.
    """
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in windows filled with its tokens.

    Rows with a null doc_id or text and empty texts aren't packed; repeated rows are packed each, and very long texts
    fill windows of their own.  An empty table gives no windows.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_shared_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: SQL has neither learned labels nor sketches; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return docs
