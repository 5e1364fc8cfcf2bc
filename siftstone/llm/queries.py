"""The queries over the driver's tables, one for each operator, and SQL where SQL can express one."""

from __future__ import annotations

from . import mixing, ngram_join, pii, substring_dedup
from .common import documents
from .langid import predict_languages
from .media import media_digest
from .omh import fingerprint_edits
from .packing import pack
from .secrets import secret_digest
from .toxicity import score_documents


def op1_progressive_jpeg(spark, sf_dir):
    """Every document stored as a progressive JPEG and read back."""
    return media_digest(documents(spark, sf_dir))


def op2_order_minhash(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return fingerprint_edits(documents(spark, sf_dir))


def op3_secrets(spark, sf_dir):
    """Secrets of every document."""
    return secret_digest(documents(spark, sf_dir))


def op5_packing(spark, sf_dir):
    """All documents as power-of-two sequences."""
    return pack(documents(spark, sf_dir), with_ids=False)


def op6_language_id(spark, sf_dir):
    """The language of every document."""
    return predict_languages(documents(spark, sf_dir))


def op10_toxicity(spark, sf_dir):
    """The toxicity of every document."""
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_progressive_jpeg": op1_progressive_jpeg,
    "op2_order_minhash": op2_order_minhash,
    "op3_secrets": op3_secrets,
    "op4_ngram_jaccard_join": ngram_join.op4,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_pii": pii.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_mixing": mixing.op9,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": ngram_join.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op9_mixing": mixing.SQL,
}
