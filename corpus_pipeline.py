"""A training-corpus pipeline over `documents`: rules, lines, near duplicates, benchmark leaks, pieces.

Every stage takes what the one before kept and returns the columns of documents; the last adds the
sampled pieces. Stages are joined by Parquet tables, so a lost executor costs tasks and not stages.

Defined results
- a null or empty text fails the quality rules and goes; a stage that is given one by itself keeps it as
  it is: it has no line to lose, no near duplicate, no benchmark passage, and null or no pieces;
- rows that repeat in id and text are one document after near_duplicates, and judged one by one before;
- a text of any length is taken whole by every stage; an empty table gives an empty result;
- columns beyond those of documents are carried through all stages, whatever their names; the pieces
  come in a column named `pieces`, or with underscores before that if the name is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import op1_sentencepiece, op3_line_dedup, op4_quality_rules, op9_jaccard_join, op10_decontaminate
from curatrix.llm.common import by_place, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the production policy rejects."""
    return op4_quality_rules.apply_policy(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from texts; a document stays even if no line does, and a null text stays null."""
    flat, at = by_place(docs)
    done = op3_line_dedup.apply_bitmaps(flat, op3_line_dedup.keep_bitmaps(docs), doc_id=at["doc_id"], text=at["text"], out="found")
    new = {at["text"]: F.when(F.col(at["text"]).isNotNull(), F.col("found.kept"))}
    if "n_chars" in at:
        new[at["n_chars"]] = F.when(F.col("found.n_dropped") > 0, F.length("found.kept").cast("bigint")).otherwise(F.col(at["n_chars"]))
    return done.select(*(new.get(c, F.col(c)).alias(c) for c in flat.columns)).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each near-duplicate component."""
    return op9_jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark windows over a twentieth of their words."""
    return op10_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the sampled piece ids of every text."""
    return op1_sentencepiece.encode(docs, op1_sentencepiece.default_model())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", pieces),
]

#: Sampled pieces can't be expressed in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
