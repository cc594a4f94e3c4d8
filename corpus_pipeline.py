"""A corpus from documents to packed training sequences: five stages, each written as Parquet and read again.

Every stage takes tables without rows, and columns of any other names pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm.common import stage, table
from lodeglass.llm.op3_lines import dedup_lines
from lodeglass.llm.op6_decontamination import decontaminate
from lodeglass.llm.op8_jaccard import keep_one
from lodeglass.llm.op9_packing import pack_documents
from lodeglass.llm.op10_quality import judge_quality
from lodeglass.sources.staging import release


def _free(docs: DataFrame) -> str:
    """A name that no column of ``docs`` has."""
    return "_" + max(docs.columns, key=len)


def _with_text(docs: DataFrame, text: Column, found: str) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).drop(found)


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass, with the text that the line rules leave.

    Null and empty texts have no words and go; equal rows are judged each by itself; a very long text is judged whole.
    ``n_chars`` is made anew from the text that is left, here and in line deduplication.
    """
    found = _free(docs)
    return _with_text(judge_quality(docs, into=found).where(f"{found}.kept"), F.col(f"{found}.clean"), found)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without later repeated runs of lines; those whose every line is a repeat go.

    Runs are three lines, or fewer that hold 50 words. Null and blank texts stay as they are. Equal ids, and equal rows,
    take nothing from each other; a missing id is after all others.
    """
    found = _free(docs)
    out = dedup_lines(docs, into=found).where(f"{found}.n_removed < {found}.n_lines or {found}.n_lines = 0")
    return _with_text(out, F.when(F.col(f"{found}.n_removed") > 0, F.col(f"{found}.kept")).otherwise(F.col("text")), found)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id, a missing one last. Null and blank texts
    have no shingles and all stay; of rows alike in id and text one stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold too little of the benchmark to be contaminated; null and empty texts hold none of it, and equal
    rows are judged each by itself. An empty benchmark leaves all."""
    found = _free(docs)
    out = decontaminate(docs, table(spark, folder, "benchmark"), into=found)
    return out.where(f"not {found}.contaminated").drop(found)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents' token ids, each with its sequence, its place there and its ids (unsigned 16-bit integers).

    Null and empty texts are their end id alone; equal rows are packed each by itself.
    """
    return pack_documents(docs, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Packing has no SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage; each stage's table is deleted once the next one is written."""
    docs, written = table(spark, folder, "documents"), None
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, folder))
        if written:
            release(written)
        written = docs
    return STAGES[-1][1](spark, docs, folder)
