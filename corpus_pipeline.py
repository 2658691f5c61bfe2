"""A cleaning pipeline over documents: toxicity, line dedup, near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents, and any others that docs has, whatever their names. n_chars follows
the text where a stage changes it. An empty table stays empty in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lrforge.llm import linededup, mixing, neardup, pieces, toxicity
from lrforge.llm.common import as_table, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; labels teach, and are no input of a decision.

    Null and empty texts stay, equal texts share a fate. Without labels of both kinds, or documents for them, nothing goes.
    """
    model = toxicity.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic"), F.lit(True))
    return toxicity.keep_clean(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document of which nothing with a word is left goes with them.

    The first in order of (doc_id, text hash, line) stays; null and blank texts stay as they are; rows that are equal in id and text count as one.
    """
    return linededup.keep_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Texts without a word are nobody's copy; rows of one id stay or go together; a null id stays.
    """
    return neardup.keep_one_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as its source's target takes it.

    A null source is a source of its own; documents without words go with those beside them in hash order; equal rows are taken alike.
    """
    return mixing.mixed_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of what the mix holds: doc_id, sample, ids, log_prob, log_inclusion, and the text that ids decode to.

    Null texts give no row, empty ones one without ids; repeated documents have equal samples.
    """
    return pieces.encode(docs, decoded="text")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Toxicity, near-dedup and sampling have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
