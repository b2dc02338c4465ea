"""A training-data pipeline over the documents: filter, dedup, mix and code.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents; columns that are
there besides pass through, whatever their names. An empty table gives an empty table of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import OWN, SPACE_CHARS, packed, staged, table
from corpusloom.llm.line_dedup import dedup_passages
from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.ngram_join import one_of_each_class
from corpusloom.llm.quality_rules import judge
from corpusloom.llm.sentencepiece_codec import encode


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have too few words and go; repeated rows are judged alike; texts of any length are
    read whole; a null key changes nothing.
    """
    return judge(docs, into=OWN + "failed").where(F.col(OWN + "failed").isNull()).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines and the passages of over 50 words that came before; what has no word left was all repeats and goes.

    Null texts stay null; rows of one key and text count as one document, so repeated rows stay and keep the
    same lines; null keys come last; n_chars is made anew where lines went.
    """
    rows = docs.select(packed(docs), F.col("doc_id").alias("k"), F.col("text").alias("t"))
    out = dedup_passages(rows, key="k", text="t")
    left = (F.col("n_removed_lines") == 0) | (F.translate("t", SPACE_CHARS, "") != "")
    made = {"text": F.col("t"), "n_chars": F.when(F.col("n_removed_lines") == 0, F.col(OWN + "row").getField("n_chars")).otherwise(F.char_length("t").cast("bigint"))}
    return out.where(left).select(*[made.get(c, F.col(OWN + "row").getField(c)).alias(c) for c in docs.columns])


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: that of the least key, null keys last.

    Texts without words (null, empty) are classes of their own and stay; of repeated rows one stays where the
    text has words; texts of any length are compared whole.
    """
    return one_of_each_class(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus that the mix of sources takes: whole copies, and pieces of documents that it cuts.

    Texts without words are taken no time and go; a null source is one of its own; repeated rows are mixed
    row by row; a null key takes part.
    """
    return mixed_documents(docs)


def coding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, ids, n_tokens, n_byte_tokens, round_trip.

    Null and empty texts have no ids; repeated rows are coded alike; a null key is passed on.
    """
    return encode(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", similar_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", coding_stage),
]

#: Seeded mixing and subword coding have no counterpart in SQL; tests/llm/test_pipeline.py compares every stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
