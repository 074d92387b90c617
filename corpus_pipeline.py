"""From raw documents to packed training sequences: five stages, each over all its predecessor kept.

Toxic documents go; recurring lines are dropped (and documents of which nothing else is left); of
near copies one document stays; secrets are blanked; what is left is packed.  A stage takes the
session, its documents and the folder of the tables; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeforge.llm import lines, near, packing, secrets, toxicity
from planeforge.llm.common import table, written


def _measured(df: DataFrame) -> DataFrame:
    """``n_chars``, where the table has it, follows the text."""
    return df.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels are learned from the stage's own documents; held-out rows and unlabelled ones are only scored."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lines.drop_recurring_lines(docs)
    empty = (F.col("lines_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s", " ")) == "")
    return _measured(found.where(~F.coalesce(empty, F.lit(False))).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash of five-word shingles, links checked for 0.8 of all shingles of two texts; an exact way for what no radius finds."""
    return near.drop_near_copies(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secrets.redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("secret scan", blank_secrets),
    ("packing", pack),
]

#: Classifier, hash index, lexer and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
