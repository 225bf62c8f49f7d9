"""Bound queries against their SQL at the smallest scale, a few per family."""

import duckdb
import pytest

import __spark_entry__ as entry
from bindings import files, funding, learning, registry
from check import TABLES, rows_of
from quarrylane.operators import rounds as rd

FOLDER = "/root/testdata/sf0.001"
NAMES = ("score_review_budgets", "tx_signal_ranking", "tx_temporal_split", "rounds_clean", "rounds_investor_pairs", "subs_sensitivity",
         "subs_decisions", "panel_segments", "features_at_origins", "forecast_scores", "stock_scenarios", "catalog_upsert",
         "catalog_next_state", "text_deduplicated", "search_end_to_end", "ranking_relevant_pairs", "search_every_term", "file_catalog_csv",
         "score_budgets_missing", "text_group_folds", "search_similar_products", "panel_selected_items", "file_rounds_cells", "file_query_set",
         "model_stated_factors", "tx_factor_correlation", "ranking_nearest_rank", "forecast_mase_scale", "file_shard_list", "file_shard_scan", "subs_declared_faults", "subs_features", "forecast_error_drivers")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    rel = con.sql(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(list(rel.columns), rel.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, columns", [
    ("rounds_head_share", ["amount_flag", "amount_usd_adj"]), ("rounds_yearly_median", ["amount_flag", "amount_usd", "amount_usd_adj", "year"]),
    ("rounds_city_concentration", ["amount_flag", "amount_usd_adj", "city"])])
def test_only_the_asked_columns_are_cleaned(spark, con, name, columns, monkeypatch):
    kept, write = [], registry.sinks.write_parquet
    monkeypatch.setattr(registry.sinks, "write_parquet", lambda d, path: kept.append(sorted(d.columns)) or write(d, path))
    df = entry.queries()[name](spark, FOLDER)
    rel = con.sql(entry.oracle_sql()[name])
    assert kept == [columns] and rows_of(df.columns, df.collect()) == rows_of(list(rel.columns), rel.fetchall())


def test_exported_rounds_are_cleaned_once(spark):
    """Both exports come from the written rounds."""
    t = registry.Tables(spark, FOLDER)
    t._kept["rounds"] = rd.clean(funding.raw(t)).limit(7)
    assert {r.tbl: r.n for r in files.rounds_export(t).collect()}["rounds"] == 7


def test_large_partitions_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(registry, "SPREAD_ROWS", 40)
    d = registry.Tables(spark, FOLDER).spread("orders")
    assert d.rdd.getNumPartitions() == -(-d.count() // 40)


def test_people_are_built_once(spark):
    t = registry.Tables(spark, FOLDER)
    assert learning.people(t) is learning.people(t)
