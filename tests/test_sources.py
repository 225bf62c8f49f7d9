"""Readers refuse malformed input; sinks round-trip."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylane.operators import catalog
from quarrylane.sources import readers, shards, sinks, split_csv, versions


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_missing_column_is_named(spark, tmp_path):
    with pytest.raises(ValueError, match="isFraud"):
        readers.transactions(spark, write(tmp_path, "t.csv", "step,type,amount\n1,A,2\n"))


def test_byte_order_mark_is_dropped(spark, tmp_path):
    p = write(tmp_path, "r.csv", "﻿Sr No,b,c,d,e,f,g,h,i,j\n1,2,3,4,5,6,7,8,9,10\n")
    assert readers.funding_rounds(spark, p).first().sr_no == "1"


def rule(**k):
    return {"id": "q1", "type": "text", "query": "red shoe", "relevance": {"colours": ["Red"]}, **k}


def test_query_set(spark, tmp_path):
    d = readers.query_set(spark, write(tmp_path, "q.json", json.dumps({"queries": [rule(), rule(id="q2")]}, indent=1)))
    assert d.count() == 2 and d.first().colours == ["Red"] and d.first().brands == []


@pytest.mark.parametrize("bad", [[rule(), rule()], [rule(relevance={})], [rule(relevance={"sizes": ["L"]})], [rule(type="sound")],
                                 [rule(query=None)], [rule(type="image")]])
def test_query_set_refuses(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        readers.query_set(spark, write(tmp_path, "q.json", json.dumps({"queries": bad})))


def test_catalog_rows(spark, tmp_path):
    p = write(tmp_path, "c.csv", "external_id,name,price,year,in_stock\n1,A,10,2012.0,yes\n2, ,5,,\n3,C,-1,,\n1,B,abc,,no\n")
    d = readers.catalog_csv(spark, p).withColumn("line", F.monotonically_increasing_id() + 2)
    good, bad, twice = catalog.validated(d, "line")
    g = good.first()
    assert good.count() == 1 and (g.name, g.price, g.in_stock) == ("B", None, False)
    assert {(r.external_id, r.reason) for r in bad.collect()} == {("2", "name"), ("3", "price")} and twice.first().n_dropped == 1


def test_cached_parquet_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.cached_parquet(spark, str(tmp_path / "x"), build).count() == 3
    assert len(calls) == 1


def test_csv_keeps_every_cell(spark):
    cells = [('say "hi", ok', "two\nlines"), ("plain", None), ("back\\slash", " kept "), ('"', ",")]
    path = sinks.write_csv(spark.createDataFrame(cells, "a string, b string"), sinks.shared_folder(spark, "cells"))
    assert sorted(map(str, map(tuple, readers.text_csv(spark, path).collect()))) == sorted(map(str, cells))


@pytest.mark.parametrize("limit", ["64", "200", "1000000"])
def test_ranges_that_start_inside_a_cell(spark, tmp_path, limit):
    """Line ends, quotes and commas at every range border: the cells are those of the plain reader, from many ranges."""
    cells = [(str(i), ["plain", 'say ""x"", ok', "two\nlines", "a\n\n\nb", "", "long " * 60 + "\nend", ","][i % 7]) for i in range(140)]
    text = "\ufeffid,note\n" + "".join(f'{i},"{c}"\n' if c else f"{i},\n" for i, c in cells)
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    (tmp_path / "b.csv").write_text('id,note\r\n900,"x\r\ny"\r\n901,z\r\n\r\n', encoding="utf-8", newline="")
    want = [(i, c.replace('""', '"') or None) for i, c in cells] + [("900", "x\r\ny"), ("901", "z")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = split_csv.physical_lines(spark, str(tmp_path))
        assert limit == "1000000" or lines.rdd.getNumPartitions() > 4
        got = split_csv.read(spark, str(tmp_path))
        assert got.columns == ["id", "note"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quotes_that_do_not_pair_up_are_refused(spark, tmp_path):
    with pytest.raises(split_csv.OddQuotes):
        split_csv.read(spark, write(tmp_path, "o.csv", 'a,b\n1,"open\n')).collect()


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    ts = versions.TableSet(spark, str(tmp_path / "set"))
    assert ts.version() == 0 and ts.tables() == {}
    rows = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, k long")
    assert ts.commit({"vectors": rows, "products": rows}) == 1
    pinned = ts.read("products", 1)
    changes = catalog.delete_together({"vectors": ts.read("vectors"), "products": ts.read("products")}, rows.where("k = 1"), "id")
    broken = {**changes, "products": changes["products"].withColumn("k", F.raise_error(F.lit("disk is gone")).cast("long"))}
    with pytest.raises(Exception, match="disk is gone"):
        ts.commit(broken)
    assert ts.version() == 1 and ts.read("vectors").count() == ts.read("products").count() == 10
    assert ts.commit(changes) == 2
    assert ts.read("vectors").count() == ts.read("products").count() == 5 and pinned.count() == ts.read("vectors", 1).count() == 10
    with pytest.raises(versions.Conflict):
        ts.commit({"vectors": rows}, base=1)
    assert ts.version() == 2
    ts.commit(catalog.delete_all({n: ts.read(n) for n in ("vectors", "products")}))
    assert ts.read("products").columns == ["id", "k"] and ts.read("products").count() == 0 and ts.read("products", 2).count() == 5
    with pytest.raises(KeyError):
        ts.read("vectors", 9)


def test_a_version_committed_twice_is_refused(spark, tmp_path):
    ts = versions.TableSet(spark, str(tmp_path / "set"))
    ts.commit({"a": spark.range(3)})
    spark.createDataFrame([(1, 0, "other", {"a": "elsewhere"})], versions.COMMIT).write.mode("append").json(f"{ts.root}/commits")
    with pytest.raises(versions.Conflict, match="twice"):
        ts.read("a")


@pytest.fixture(scope="module")
def four_shards(spark, tmp_path_factory):
    root, folders = tmp_path_factory.mktemp("shards"), []
    for k in range(4):
        d = spark.range(k * 100, k * 100 + 50).select("id", F.lit(f"t{k}").alias("name")).coalesce(1)
        d = d.withColumn("extra", F.col("id") % 7) if k == 2 else d.drop("name") if k == 0 else d
        folders.append(sinks.write_parquet(d, str(root / f"part-{k}")))
    folders.append(sinks.write_parquet(spark.createDataFrame([(None, "lost")], "id long, name string").coalesce(1), str(root / "part-4")))
    return shards.keep_list(shards.shard_list(spark, folders, "id", ("name", "extra", "nowhere")), str(root / "list"))


def test_shard_list_counts_each_shard(four_shards):
    got = sorted(four_shards.where("low IS NOT NULL").select("low", "high", "rows", "has_name", "has_extra", "has_nowhere", "unset").collect())
    assert [tuple(r) for r in got] == [(0, 49, 50, 0, 0, 0, 0), (100, 149, 50, 50, 0, 0, 0), (200, 249, 50, 50, 42 + 8, 0, 0), (300, 349, 50, 50, 0, 0, 0)]
    assert [(r["rows"], r["unset"]) for r in four_shards.where("low IS NULL").collect()] == [(1, 1)]


@pytest.mark.parametrize("low, high, opened", [(120, 220, 2), (None, 49, 1), (300, None, 1), (50, 99, 0), (None, None, 5)])
def test_shard_scan_opens_only_what_can_match(spark, four_shards, low, high, opened):
    kind = "id long, name string, extra long"
    d = shards.scan(four_shards, spark.createDataFrame([], kind).schema, "id", low, high)
    assert len(d.inputFiles()) == opened
    every = [k * 100 + i for k in range(4) for i in range(50)]
    want = [i for i in every if (low is None or i >= low) and (high is None or i <= high)]
    rows = d.collect()
    assert sorted(r.id for r in rows if r.id is not None) == want
    assert sum(r.id is None for r in rows) == (1 if low is None and high is None else 0)
    for r in rows:
        assert (r.extra is None) == (r.id is None or r.id // 100 != 2) and (r.name is None) == (r.id is not None and r.id < 100)
