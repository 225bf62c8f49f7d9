"""The registered training-data queries: check SQL where there is some, whole tables and contract columns otherwise."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from quarrylane.llm.queries import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id", "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op3_substrings": "doc_id n_bytes repeat_bytes spans repeat_of",
    "op4_language": "doc_id held_out lang_pred score", "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_mixing": "doc_id size source_size target taken", "op7_token_counts": "doc_id n_bytes n_tokens over_limit", "op8_toxicity": "doc_id held_out score predicted",
    "op9_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op10_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op11_lexical": "item_id rank doc_id score", "op12_ngram_join": "doc_id n_shingles component_id",
    "op13_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified"}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, rel = entry.queries()[name](spark, FOLDER), con.sql(CHECKS[name])
    assert rows_of(df.columns, df.collect()) == rows_of(list(rel.columns), rel.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    assert df.count() == {"op5_warc": 50, "op11_lexical": 400}.get(name, 200)


def test_all_are_registered():
    assert {*COLUMNS, "pipeline"} == set(QUERIES) <= set(entry.queries())
