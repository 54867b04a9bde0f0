"""Corpus pipeline: identified languages, repeated passages out, one of each near copy, no benchmark items, then tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes what a stage returns as Parquet in the shared folder and
reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.bpe import round_trip
from larkspur.llm.common import fresh_names, table, written
from larkspur.llm.decontam import drop_leaks
from larkspur.llm.langid import keep_identified
from larkspur.llm.linechunks import remove_repeated_passages
from larkspur.llm.parity import Join, keep_one_each
from larkspur.llm.queries import tokenizer_path
from larkspur.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in none of the learned languages go.

    Null and empty texts and texts without a letter go; very long texts are judged whole, repeated
    rows alike. Where no row has a language, every row with a letter stays. Columns may have
    any names; of no rows none stay.
    """
    ship(spark)
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line passages leave the texts; a row of which nothing is left goes; n_chars follows.

    Null, empty and one-line texts stay as they are. Repeated rows are one document and lose the
    same passages. Columns may have any names; those of the corpus stay as they are but for
    text and n_chars. Of no rows none stay.
    """
    ship(spark)
    cut, chars = fresh_names(docs, "n_removed", "removed_chars")
    done = remove_repeated_passages(docs, (cut, chars)).where((F.col(cut) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(cut) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.drop(cut, chars)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles at a similarity of 0.8, that with the smallest doc_id.

    Rows without a doc_id, and null, empty and wordless texts, link with nothing and stay; rows
    with the same doc_id are one document. Columns may have any names; of no rows none stay.
    """
    ship(spark)
    return keep_one_each(docs, Join(words=5, p=4, q=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows are judged alike; an empty benchmark
    removes nothing. Columns may have any names; of no rows none stay.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each text, encoded and decoded; a null text counts as empty, repeated rows give equal rows."""
    ship(spark)
    return round_trip(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can express neither the profiles nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
