"""A corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps,
with the columns of documents; the last returns packed pieces. A stage works
on all that its predecessor kept, as written to Parquet in the shared
checkpoint folder.

NULL and empty texts pass every stage (no words, no shingles, no spans; packed
as their end id alone). Rows with a NULL doc_id are judged by their text alone
and are never near duplicates. Of rows that repeat a doc_id one stays, with the
near duplicates; ties there fall to the smallest doc_id. Columns beyond those
of documents are kept up to the last stage. Without rows every stage gives
none; without labels no text is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontam, jaccard, packing, pii, toxicity
from ledgerlens.llm.common import small_batches, stage, table
from ledgerlens.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subsequence-kernel machine takes for toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    small_batches(spark)
    return jaccard.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", sanitise),
    ("packing", pack),
]

#: Scores, tilings and packing are not SQL; the tests compare with a
#: brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
