import os

import pytest

from siftstone.llm.queries import ORACLE_SQL, QUERIES

from ..duck import SMALL, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


COLUMNS = {
    "op1_progressive_jpeg": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2_order_minhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_whole_table(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert df.select("doc_id").distinct().count() == docs.count()
