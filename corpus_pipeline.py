"""A training-data pipeline: documents without toxic ones, one of each group of near duplicates, without
personal data, mixed by source, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor's Parquet; all but the
last return the columns of ``documents``, ``n_chars`` being that of the new text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import mixing, ngram_join, packing, pii, toxicity
from siftstone.llm.common import documents, saved


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field doesn't find toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that equal texts and links of the n-gram join connect."""
    return ngram_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with sanitised texts."""
    return _sized(pii.sanitise(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut to its target, in training order."""
    return _sized(mixing.take(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of the documents' tokens, numbered in the order of files and rows."""
    return packing.pack(docs, with_ids=False, in_file_order=True)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_duplicates),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the random field nor the tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
