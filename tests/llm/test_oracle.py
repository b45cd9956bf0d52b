"""Queries of this package against their SQL, and their contracts' columns."""

import pytest

from tallyframe.llm.queries import ORACLE, QUERIES
from tallyframe.plans.check import compare


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf_small, key):
    r = compare(spark, duck, key, QUERIES[key], ORACLE[key], sf_small)
    assert r["ok"], r


COLUMNS = {
    "op1_langid": "doc_id held_out lang_pred score", "op2_linededup": "doc_id n_lines n_dropped dropped",
    "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset tier step_id",
    "op4_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256", "op5_chat": "conv_id turn part role text rendered",
    "op6_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept failed",
    "op7_exactdedup": "doc_id keep_id group_size kept text_sha256",
    "op8_secrets": "doc_id n_assign n_access n_hex base_sha256 spans n_linked", "op9_licenses": "doc_id licences n_paragraphs found",
    "op10_simhash": "doc_id fingerprint component_id",
    "op11_infilling": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op12_suffixdedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op13_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"}


@pytest.mark.parametrize("key", sorted(COLUMNS))
def test_query_covers_its_table(spark, sf_small, key):
    df = QUERIES[key](spark, sf_small)
    assert df.columns == COLUMNS[key].split()
    source = "conversations" if key == "op5_chat" else "documents"
    ids = "conv_id" if key == "op5_chat" else "doc_id"
    assert df.select(ids).distinct().count() == spark.read.parquet(f"{sf_small}/{source}.parquet").select(ids).distinct().count()


def test_every_operator_is_registered():
    assert set(COLUMNS) == set(QUERIES)
