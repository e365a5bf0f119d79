"""Corpus pipeline over ``documents``: quality filter, near-duplicate removal, decontamination, secret redaction, packing.

``STAGES`` holds (name, function) pairs; a function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``documents``.
The ranking and the packing order have no SQL form, so the rows are tested
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm.bin_packing import pack_texts
from wirefold.llm.common import materialize, read_table
from wirefold.llm.decontaminate import drop_contaminated
from wirefold.llm.jaccard_join import drop_linked
from wirefold.llm.quality_rank import keep_good
from wirefold.llm.secret_scan import redact_secrets

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking learnt from ``labels`` puts above its cut."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by shingles; all documents without links."""
    return drop_linked(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; ``n_chars`` follows the text."""
    redacted = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType
    return redacted.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 2048 words."""
    return pack_texts(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_per_group),
    ("decontamination", clean_of_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written below ``spark.checkpoint.dir`` and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
