"""The corpus pipeline: quality, lines, near duplicates, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of docs; the last adds the place of each
document in the mixture. Between stages the documents are written and read again. n_chars follows the text.

Rows with null or repeated ids, null texts and extra columns go through every stage as its operator says: quality scores null and
empty texts with the prior, the line stage keeps them, the join keeps rows with null ids, the mixture takes null sources as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, linededup, mixing, ngramjoin, quality
from sparkloom.llm.common import settled, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller document holds. Those of which that is more than half keep their text: whether
    they are copies is for the next stage to say, which would not know a copy by the lines that are left. So no document is emptied."""
    names = tuple(unused(docs, "n_lines", "n_dropped"))
    out = linededup.dedup(docs, names=names, spare=0.5)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, 80 %)."""
    return ngramjoin.representatives(docs, 5, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to the coverage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their block, slot and position in the mixture."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixture", mixture_stage),
]

#: A trained classifier and the schedule are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
