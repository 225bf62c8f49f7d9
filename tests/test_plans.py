"""Ordered totals, quantiles and ranking statistics against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.operators import rankstats
from quarrylane.plans.bounded import TooManyRows, bounded_rows
from quarrylane.plans.prefix import BUCKET, bucketed, exact_quantiles, points_up_to, running_totals


def scores(n=3000, seed=1):
    r = random.Random(seed)
    # One score holds a third of all rows.
    return [(i, 0.5 if i % 3 == 0 else round(r.random(), 3), int(r.random() < 0.3), "ab"[i % 2]) for i in range(n)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(scores(), "id long, p double, y int, g string")


def test_running_totals_match_a_sort(spark):
    rows = [(float(i % 97) + i / 1000, i) for i in range(2000)]
    d = spark.createDataFrame(rows, "v double, w long")
    got = {r.v: r.cum_w for r in running_totals(d, "v", ["w"], buckets=7).collect()}
    total = 0
    for v, w in sorted(rows):
        total += w
        assert got[v] == total


def test_text_that_differs_late_is_spread(spark):
    # A differing first character, then a common start of 20, then the ids.
    ids = ["ab"[i % 2] + "x" * 20 + f"{i:05d}" for i in range(4000)]
    d = spark.createDataFrame([(x, 1) for x in ids] + [(None, 1)], "k string, one long")
    sizes = [r["count"] for r in bucketed(d, "k", 16).groupBy(BUCKET).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 1000
    got = {r.k: r.cum_one for r in running_totals(d, "k", ["one"], buckets=16).collect()}
    assert got.pop(None) == 1 and [got[x] for x in sorted(ids)] == list(range(2, 4002))


def test_text_order_is_bytewise(spark):
    words = ["", "a", "é", "z", "\uffff", "\U0001f600", "Z", "a" * 400, "a" * 399 + "b"]
    d = spark.createDataFrame([(g, w, 1) for g in "pq" for w in words], "g string, k string, one long")
    for down in (False, True):
        got = {(r.g, r.k): r.cum_one for r in running_totals(d, "k", ["one"], ["g"], descending=down, buckets=5).collect()}
        for g in "pq":
            assert [got[g, w] for w in sorted(words, key=str.encode, reverse=down)] == list(range(1, len(words) + 1))


def test_text_order_of_empty_tables(spark):
    none = spark.createDataFrame([], "k string, one long")
    assert running_totals(none, "k", ["one"]).count() == 0
    unset = spark.createDataFrame([(None, 3)], "k string, one long")
    assert [r.cum_one for r in running_totals(unset, "k", ["one"]).collect()] == [3]


def test_points_up_to_counts(spark):
    points = ["b", "d", "f", "h", "j"]
    rows = [(c,) for c in "abcdefghijk"]
    got = {r.k: r.n for r in spark.createDataFrame(rows, "k string").withColumn("n", points_up_to(F.col("k"), points)).collect()}
    assert got == {c: sum(p <= c for p in points) for (c,) in rows}


def test_running_totals_order_text(spark):
    ids = [f"item-{i:05d}" for i in range(500)]
    d = spark.createDataFrame([(x, 1) for x in ids], "k string, one long")
    got = {r.k: r.cum_one for r in running_totals(d, "k", ["one"], buckets=9).collect()}
    assert [got[x] for x in sorted(ids)] == list(range(1, 501))


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_quantiles_equal_numpy(spark, scored, buckets):
    probs = {"a": 0.1, "b": 0.5, "c": 0.95}
    for r in exact_quantiles(scored, "p", probs, ["g"], buckets=buckets).collect():
        v = [p for _, p, _, g in scores() if g == r.g]
        assert np.allclose([r.a, r.b, r.c], np.quantile(v, list(probs.values())))


def test_auc_and_average_precision_with_ties(scored):
    rows = scores()
    pos, neg = [p for _, p, y, _ in rows if y], [p for _, p, y, _ in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    ap, tp, seen = 0.0, 0, 0
    for s in sorted({p for _, p, _, _ in rows}, reverse=True):
        here = [y for _, p, y, _ in rows if p == s]
        tp, seen = tp + sum(here), seen + len(here)
        ap += sum(here) / len(pos) * tp / seen
    r = rankstats.ranking_quality(scored, "p", "y").first()
    assert r.roc_auc == pytest.approx(wins / (len(pos) * len(neg)))
    assert r.pr_auc == pytest.approx(ap)


def test_one_class_has_no_auc(spark):
    r = rankstats.ranking_quality(spark.createDataFrame([(0.1, 0), (0.4, 0)], "p double, y int"), "p", "y").first()
    assert r.roc_auc is None and r.pr_auc is None


def test_review_budget_splits_a_hot_score(scored):
    order = sorted(scores(), key=lambda r: (-r[1], r[0]))
    got = rankstats.review_budgets(scored, "p", "y", "id", [0.001, 0.4, 0.6]).collect()
    assert len(got) == 3
    for r in got:
        assert r.caught == sum(x[2] for x in order[: r.alerts])


def test_bounded_rows_refuse_growth(spark):
    with pytest.raises(TooManyRows):
        bounded_rows(spark.range(11), 10)


def test_running_totals_with_nulls(spark):
    rows = [("a", 1.0, 2), ("a", None, 3), ("a", 5.0, 1), (None, 2.0, 4), (None, None, 5), ("b", None, 7)] + [("a", float(i), 1) for i in range(6, 40)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    from quarrylane.plans.prefix import running_totals
    for down in (False, True):
        want = {}
        for k in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0), reverse=down)
            total = 0
            for _, v, n in own:
                total += n
                want[k, v] = total
        for buckets in (1, 4, 64):
            got = running_totals(df, "v", ["n"], ["k"], descending=down, buckets=buckets).collect()
            assert {(r.k, r.v): r.cum_n for r in got} == want and len(got) == len(rows)
