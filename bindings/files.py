"""File round trips: each query writes a table with a sink and reads it back with a reader."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindings import catalogue, demand, funding, payments, subscribers
from bindings.registry import Tables, query
from quarrylane.operators import catalog as ct
from quarrylane.operators import decisions, rankstats, splits
from quarrylane.operators import rounds as rd
from quarrylane.sources import readers, shards, sinks


@query("file_transactions_csv", f"WITH {payments.TX} SELECT type, count(*) AS n, round(sum(amount), 2) AS amount, sum(isFraud)::BIGINT AS frauds FROM tx GROUP BY 1", digits=2)
def transactions_csv(t: Tables):
    """Typed CSV scan with required columns."""
    path = sinks.write_csv(payments.transactions(t), sinks.shared_folder(t.spark, "transactions"))
    d = readers.transactions(t.spark, path)
    return d.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.sum("isFraud").alias("frauds"))


@query("file_rounds_csv", f"WITH {funding.ROUNDS} SELECT stage, count(*) AS n, round(sum(amount_usd), 2) AS amount FROM rounds GROUP BY 1", digits=2)
def rounds_csv(t: Tables):
    """All-text CSV scan with positional names, then the cleaners."""
    raw = funding.raw(t).toDF("Sr No", "Date dd/mm/yyyy", "Startup Name", "Industry Vertical", "SubVertical", "City  Location",
                              "Investors Name", "InvestmentnType", "Amount in USD", "Remarks")
    path = sinks.shared_folder(t.spark, "rounds")
    d = readers.funding_rounds(t.spark, sinks.write_csv(raw, path))
    return rd.clean(d).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_usd").alias("amount"))


@query("file_rounds_cells", f"""WITH {funding.RAW} SELECT sr_no::BIGINT AS sr_no, date_raw, city_raw, amount_raw,
  CASE WHEN sr_no::BIGINT % 3 = 0 THEN 'say "hi", ok' || chr(10) || 'line ' || sr_no WHEN sr_no::BIGINT % 3 = 1 THEN '"' END AS remarks FROM rr""")
def rounds_cells(t: Tables):
    """Cells with quotes, commas and line ends written and read back whole."""
    n = F.col("sr_no").cast("long") % 3
    remarks = F.when(n == 0, F.concat(F.lit('say "hi", ok\nline '), F.col("sr_no").cast("string"))).when(n == 1, '"')
    raw = funding.raw(t).toDF(*rd.RAW_COLUMNS).withColumn("remarks", remarks)
    d = readers.funding_rounds(t.spark, sinks.write_csv(raw, sinks.shared_folder(t.spark, "cells")))
    return d.select(F.col("sr_no").cast("long").alias("sr_no"), "date_raw", "city_raw", "amount_raw", "remarks")


@query("file_query_set", """SELECT 'find ' || p_brand AS query_text, p_brand AS query_id, 'text' AS type, p_brand AS brands, count(*) AS excluded FROM part GROUP BY p_brand""")
def query_set(t: Tables):
    """A benchmark query set, one rule per brand, written as JSON and read with its checks."""
    lists = F.create_map(F.lit("brands"), F.array("p_brand"), F.lit("exclude_external_ids"), F.col("ids"))
    per = t.part.groupBy("p_brand").agg(F.collect_set(F.col("p_partkey").cast("string")).alias("ids"))
    q = F.struct(F.col("p_brand").alias("id"), F.lit("text").alias("type"), F.concat(F.lit("find "), F.col("p_brand")).alias("query"), lists.alias("relevance"))
    path = sinks.write_json(per.agg(F.collect_list(q).alias("queries")).coalesce(1), sinks.shared_folder(t.spark, "queries"))  # one document by its format
    d = readers.query_set(t.spark, path)
    return d.select("query_text", "query_id", "type", F.array_join("brands", ",").alias("brands"), F.size("exclude_ids").alias("excluded"))


@query("file_rounds_export", f"WITH {funding.ROUNDS} SELECT 'rounds' AS tbl, count(*) AS n FROM rounds UNION ALL SELECT 'pairs', count(*) FROM pairs")
def rounds_export(t: Tables):
    """Cleaned rounds and investor pairs written and read back."""
    r = t.kept("rounds", lambda: funding.rounds(t))
    out = None
    for name, d in (("rounds", r), ("pairs", rd.investor_pairs(r))):
        back = readers.text_csv(t.spark, sinks.write_csv(d, sinks.shared_folder(t.spark, name)))
        part = back.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("file_budget_report", payments.SPLIT_SQL + """, e AS (SELECT * FROM s WHERE part = 'test'), f AS (SELECT unnest([0.001, 0.01]::DOUBLE[]) AS budget_frac)
SELECT budget_frac, greatest(floor(budget_frac * (SELECT count(*) FROM e)), 1)::BIGINT AS alerts FROM f""")
def budget_report(t: Tables):
    """Alert budget written as JSON and read back."""
    test = splits.temporal_split(payments.transactions(t), "step").where("part = 'test'")
    b = rankstats.review_budgets(test, "amount", "isFraud", "event_id", [0.001, 0.01])
    path = sinks.write_json(b, sinks.shared_folder(t.spark, "budget"))
    return t.spark.read.json(path, schema="budget_frac double, alerts long")


@query("file_catalog_csv", f"WITH {catalogue.SRC} SELECT kind AS subcategory, count(*) AS n, round(sum(round(cost, 2)), 2) AS price FROM recs GROUP BY 1", digits=2)
def catalog_csv(t: Tables):
    """Canonical catalog file written, read and parsed again."""
    r = ct.records(catalogue.source_rows(t), catalogue.SRC_NAMES, F.col("brand"), unicode=False)
    back = readers.catalog_csv(t.spark, sinks.write_catalog(r, sinks.shared_folder(t.spark, "catalog")))
    return ct.parsed(back).groupBy("subcategory").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))


@query("file_panel_cached", f"WITH {demand.PANEL} SELECT store_id, count(*) AS n, round(sum(demand), 2) AS demand FROM panel GROUP BY 1", digits=2)
def panel_cached(t: Tables):
    """Panel built once, written by store, and taken from the file the second time."""
    path = sinks.shared_folder(t.spark, "panel")
    for _ in range(2):
        d = sinks.cached_parquet(t.spark, path, lambda: demand.full(t), ["store_id"])
    return d.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"), F.sum("demand").alias("demand"))


@query("file_ranked_decisions", subscribers.DECIDE + "SELECT priority, count(*) AS n, round(sum(round(ev, 6)), 2) AS expected_value FROM e GROUP BY 1", digits=2)
def ranked_decisions(t: Tables):
    """Scored customers in working order, written and read back."""
    d = decisions.decide(subscribers.subs(t), "p", "MonthlyCharges", subscribers.ECON)
    path = sinks.write_ranked_decisions(d, sinks.shared_folder(t.spark, "scored"), "customerID", "y")
    b = readers.text_csv(t.spark, path)
    return b.groupBy(F.col("priority").cast("long").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("expected_value").cast("double"), 6)).alias("expected_value"))


@query("file_parquet_columns", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def parquet_columns(t: Tables):
    """Metadata pass that leaves the text column unread."""
    d = readers.parquet_columns(t.spark, f"{t.folder}/documents.parquet", ["lang", "n_chars"])
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# Shards of orders by two years of their date, the last one open; later ones have one more column, the earliest one less.
_SHARDS = """o AS (SELECT *, greatest(least((coalesce(year(o_orderdate), 0) - 1995) // 2, 3), 0)::BIGINT AS shard FROM orders)"""


def order_shards(t: Tables):
    """Orders as shard folders with differing columns, and the kept list of their files."""
    def build():
        root = sinks.shared_folder(t.spark, "shards")
        years = F.coalesce(F.year("o_orderdate"), F.lit(0)) - 1995
        o = t.orders.withColumn("shard", F.greatest(F.least(F.floor(years / 2), F.lit(3)), F.lit(0)).cast("long"))
        folders = []
        for k in range(4):
            d = o.where(F.col("shard") == k).drop("shard")
            d = d.drop("o_orderpriority") if k == 0 else d.withColumn("batch", F.lit(k).cast("long")) if k > 1 else d
            folders.append(sinks.write_parquet(d, f"{root}/shard={k}"))
        return shards.shard_list(t.spark, folders, "o_orderdate", ("o_orderpriority", "batch"))

    return t.kept("shard_list", build)


@query("file_shard_list", f"""WITH {_SHARDS} SELECT shard, count(*) AS n, min(o_orderdate)::DATE AS low, max(o_orderdate)::DATE AS high,
  CASE WHEN shard = 0 THEN 0 ELSE count(o_orderpriority) END::BIGINT AS with_priority, CASE WHEN shard > 1 THEN count(*) ELSE 0 END::BIGINT AS with_batch FROM o GROUP BY shard""")
def shard_figures(t: Tables):
    """Rows, bounds and filled columns of each shard, from the kept list."""
    s = order_shards(t).withColumn("shard", F.regexp_extract("shard", "shard=([0-9]+)", 1).cast("long"))
    return s.groupBy("shard").agg(
        F.sum("rows").alias("n"), F.to_date(F.min("low")).alias("low"), F.to_date(F.max("high")).alias("high"),
        F.sum("has_o_orderpriority").alias("with_priority"), F.sum("has_batch").alias("with_batch"))


@query("file_shard_scan", f"""WITH {_SHARDS} SELECT o_orderstatus, CASE WHEN shard > 1 THEN shard END AS batch, count(*) AS n, round(sum(o_totalprice), 2) AS total
  FROM o WHERE o_orderdate BETWEEN DATE '1996-03-01' AND DATE '1999-06-30' GROUP BY ALL""", digits=2)
def shard_scan(t: Tables):
    """Orders of some months, from the shards whose bounds can hold them."""
    kind = T.StructType([t.orders.schema[c] for c in ("o_orderdate", "o_orderstatus", "o_totalprice")]).add("batch", "long")
    d = shards.scan(order_shards(t), kind, "o_orderdate", dt.date(1996, 3, 1), dt.date(1999, 6, 30))
    return d.groupBy("o_orderstatus", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("file_versioned_upsert", f"""WITH {catalogue.CSV} SELECT CASE WHEN p_size < 20 THEN 'kept' WHEN p_size <= 30 THEN 'updated' ELSE 'created' END AS change, count(*) AS n FROM prod GROUP BY 1""")
def versioned_upsert(t: Tables):
    """Upsert written as the next version of the table."""
    root = sinks.shared_folder(t.spark, "products")
    path = sinks.next_version(catalogue.merged(t), root)
    return t.spark.read.parquet(path).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("file_forecast_stages", demand.RESID + " SELECT horizon, count(*) AS n, round(sum(sba), 4) AS sba FROM iv GROUP BY 1", digits=4)
def forecast_stages(t: Tables):
    """Predictions handed over between stages as parquet."""
    path = sinks.write_parquet(demand.intervals(t)[1], sinks.shared_folder(t.spark, "predictions"))
    return t.spark.read.parquet(path).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("sba").alias("sba"))
