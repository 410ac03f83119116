"""Cleans a document table in stages; each stage is written as Parquet and read again as the next one's input.

Every stage reads doc_id and text, carries all other columns whatever their names, takes nulls in any column, texts
of any length and repeated rows, and makes an empty table of an empty one. The last stage adds input_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewright.llm.bpe import default_path, encode
from candlewright.llm.common import stored, table
from candlewright.llm.decontamination import decontaminate
from candlewright.llm.ngram_join import one_of_each
from candlewright.llm.quality_rules import quality_filter
from candlewright.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null, empty and blank texts have no words and go; repeated rows go or stay alike."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least doc_id, of equal ones that of the least text hash.

    A null doc_id comes last; repeated rows become one; texts without a word have no class and stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay; with an empty benchmark all stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked; n_chars, unless null, follows the new text. All rows stay; null texts stay null."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids in input_ids; null and empty texts have none, and a column of that name is replaced."""
    return encode(docs, default_path())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", tokens),
]

#: Minhashing, tokenising and Hamming search have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
