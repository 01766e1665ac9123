"""The registered queries over the small fixture tables."""

import pytest

import __spark_entry__ as E
from dashframe.llm.registered import QUERIES, SQL
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "held_out", "lang_pred", "score"],
    "op2": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3": ["doc_id", "held_out", "score", "predicted"],
    "op4": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op5": ["doc_id", "n_shingles", "component_id"],
    "op6": ["doc_id", "n_lines", "n_kept", "dropped"],
    "op7": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept"],
    "op9": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12": ["page_id", "url", "text", "n_chars"],
    "op13": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
             "ends_sha256"],
}


def test_one_query_per_operator_and_the_pipeline():
    assert sorted(k.split("_")[0] for k in QUERIES) == sorted(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_a_row_for_every_document(spark, name):
    if name in SQL:
        res = compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF)
        assert res["status"] == "ok", res
        return
    got = QUERIES[name](spark, SF)
    key, *_ = COLUMNS[name.split("_")[0]]
    assert set(COLUMNS[name.split("_")[0]]) <= set(got.columns)
    source = {"page_id": "pages"}.get(key, "documents")
    ids = [r[0] for r in got.select(key).collect()]
    want = [r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect()]
    assert sorted(ids) == sorted(want)
