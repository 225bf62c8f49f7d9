"""Operators on small tables with hand-computed or brute-force results."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.operators import (audit, catalog, decisions, features, forecasts, fusion, inventory, models, panel, ranking, retrieval, rounds, splits,
                                  subscribers, walk)
from quarrylane.operators import transactions as tx

START = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(s, START + dt.timedelta(days=i), float(v(i)), 2.0, 0) for i in range(120)
            for s, v in (("S_A", lambda i: 4), ("S_B", lambda i: 6 if i % 3 == 0 else 0))]
    return spark.createDataFrame(rows, "series_id string, date date, demand double, sell_price double, snap long")


def test_drain_rule(spark):
    d = spark.createDataFrame([("TRANSFER", 100.0, 100.0, 0.0), ("PAYMENT", 100.0, 100.0, 0.0), ("CASH_OUT", 100.0, 120.0, 20.0),
                               ("CASH_OUT", 0.0, 0.0, 0.0)], "type string, amount double, oldbalanceOrg double, newbalanceOrg double")
    assert [r[0] for r in d.select(tx.drain_rule(d)).collect()] == [True, False, False, False]


def test_unflagged_amounts_are_not_divided(spark):
    raw = spark.createDataFrame([(str(i), "01/07/2015", n, "tech", "", "Pune", "A, B", "Seed", a, "") for i, n, a in (
        (61, "Rapido", "3,90,00,00,000"), (1, "Acme", "71"), (2, "Flipkart.com", "9,00,00,00,000"), (3, "Mystery", "9,00,00,00,000"))], list(rounds.RAW_COLUMNS))
    got = {r.sr_no: (r.amount_flag, r.amount_usd_adj) for r in rounds.clean(raw).collect()}
    assert got[61] == ("confirmed_inr_not_usd", 3_900_000_000 / 71.0)
    assert got[1] == (None, 71.0) and got[2] == (None, 9e9) and got[3][0] == "review_outlier"
    assert {r.sr_no for r in rounds.money_safe(rounds.clean(raw)).collect()} == {61, 1, 2}


def test_conflict_group_is_kept_whole(spark):
    d = spark.createDataFrame([(1, "a", "Yes"), (2, "a", "No"), (3, "a", "No"), (4, "b", "No"), (5, "b", "No"), (6, None, "No"), (7, None, "No")],
                              "id int, f string, y string")
    kept = audit.deduplicate(d, ["f"], "y", "id").collect()
    assert {r.id for r in kept} == {1, 2, 3, 4, 6}
    rep = audit.dedup_report(d, ["f"], "y", "id").first()
    assert (rep.n_removed, rep.n_conflicting_rows, rep.n_conflicting_groups) == (2, 3, 1)


def test_group_folds_never_share_a_group(spark):
    d = spark.createDataFrame([(i, f"g{i % 40}", i % 3 == 0) for i in range(400)], "id int, g string, y boolean")
    f = splits.group_folds(d, ["g"], "y", 5)
    assert f.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    assert f.count() == 400


def test_training_labels_end_before_the_fold():
    last = dt.date(2021, 6, 1)
    o = splits.training_origins(START, last, 28, 28)
    assert max(o) + dt.timedelta(days=28) <= last and min(o) >= START + dt.timedelta(days=88)
    folds = splits.rolling_folds(dt.date(2016, 5, 23))
    assert folds[-1].end == dt.date(2016, 5, 22) and all(a.end < b.start for a, b in zip(folds, folds[1:]))


def test_lags_count_from_the_origin(tiny):
    o = START + dt.timedelta(days=99)  # a sale day of S_B
    f = {r.series_id: r for r in features.origin_features(tiny, [o], START).collect()}
    assert f["S_A"].lag_1 == 4 and f["S_A"].rolling_std_7 == 0 and f["S_A"].hist_nonzero_rate == 1
    assert f["S_B"].lag_1 == 6 and f["S_B"].lag_7 == 6 and f["S_B"].days_since_last_sale == 0
    assert f["S_B"].rolling_mean_7 == pytest.approx(18 / 7) and f["S_B"].series_age_days == 99


def croston(values, alpha=0.1):
    z = p = None
    q = 1
    for d in values:
        if d > 0:
            z, p = (d, q) if z is None else (alpha * d + (1 - alpha) * z, alpha * q + (1 - alpha) * p)
            q = 1
        else:
            q += 1
    return 0.0 if z is None else z / p


def test_croston_follows_the_recurrence_and_is_no_average(spark):
    r = random.Random(3)
    data = {f"s{k}": [r.choice([0, 0, 0, 1, 5, 9]) for _ in range(90)] for k in range(8)} | {"none": [0] * 90}
    d = spark.createDataFrame([(s, START + dt.timedelta(days=i), float(v), None) for s, vs in data.items() for i, v in enumerate(vs)],
                              "series_id string, date date, demand double, sell_price double")
    for x in features.origin_features(d, [START + dt.timedelta(days=89)], START).collect():
        assert x.croston_at_origin == pytest.approx(croston(data[x.series_id]))
        assert x.sba_at_origin == pytest.approx(croston(data[x.series_id]) * 0.95)
    assert croston(data["s0"]) != pytest.approx(np.mean(data["s0"]))


def test_leak_probe_is_silent_and_can_fail(tiny):
    o = START + dt.timedelta(days=80)
    bad = tiny.withColumn("demand", F.when(F.col("date") > F.lit(o), 999.0).otherwise(F.col("demand")))
    a, b = (features.supervised(p, [o], [1, 7], START) for p in (tiny, bad))
    cols = [c for c in a.columns if c not in ("series_id", "origin", "horizon", "target_date", "ref_date", "y_true")]
    keys = ["series_id", "target_date", "horizon"]
    assert audit.changed_columns(a, b, keys, cols).isEmpty()
    leaky = [x.withColumn("leak", F.col("y_true") * 2) for x in (a, b)]
    assert [r.feature for r in audit.changed_columns(*leaky, keys, [*cols, "leak"]).collect()] == ["leak"]


def test_demand_classes(spark):
    d = spark.createDataFrame([(1.0, 0.1), (1.0, 0.6), (2.0, 0.1), (2.0, 0.6), (None, None)], "adi double, cv2 double")
    assert [r[0] for r in d.select(panel.demand_class(F.col("adi"), F.col("cv2"))).collect()] == ["Smooth", "Erratic", "Intermittent", "Lumpy", "Intermittent"]


def simulate(demand, rop, q, lead, review):
    on, pipe, short, bad, cycles, flag, orders, inv = rop + q, [0.0] * (len(demand) + lead + 1), 0.0, 0, 0, False, 0, []
    for t, d in enumerate(demand):
        on += pipe[t]
        lost = max(d - on, 0)
        on, short, flag = max(on - d, 0), short + lost, flag or lost > 0
        if t % review == 0:
            cycles += 1
            bad, flag = bad + (flag and cycles > 1), False
            pos = on + sum(pipe[t + 1:t + lead + 1])
            if pos <= rop:
                pipe[t + lead] += math.ceil((rop + q - pos) / q) * q
                orders += 1
        inv.append(on)
    return short, orders, 1 - (bad + flag) / max(cycles, 1), sum(inv) / len(inv), on


def test_replay_matches_a_day_loop(spark):
    r = random.Random(5)
    data = {f"s{k}": [float(r.choice([0, 0, 3, 8, 20])) for _ in range(28)] for k in range(12)}
    p = spark.createDataFrame([(s, START + dt.timedelta(days=i), v) for s, vs in data.items() for i, v in enumerate(vs)], "series_id string, date date, demand double")
    pol = spark.createDataFrame([(s, float(10 + 5 * i), 7.0, 14) for i, s in enumerate(data)], "series_id string, reorder_point_normal double, q double, protection_days int")
    terms = inventory.PolicyTerms()
    got = inventory.replay(p, pol, START, START + dt.timedelta(days=27), terms, quantity=F.col("q")).collect()
    assert len(got) == 12
    for x in got:
        want = simulate(data[x.series_id], x.reorder_point, 7.0, 7, 7)
        assert (x.units_short, x.orders_placed, x.cycle_service_level, x.avg_inventory, x.ending_inventory) == pytest.approx(want)


def test_policy_numbers(spark):
    assert inventory.PolicyTerms(7, 7).protection_days == 14
    with pytest.raises(ValueError):
        features.normal_quantile(1.0)
    d = spark.createDataFrame([(1000.0, 2.0), (0.0, 2.0), (10.0, 0.0)], "d double, h double")
    q = [r[0] for r in d.select(inventory.order_quantity_eoq(F.col("d"), 5.0, F.col("h"))).collect()]
    assert q == pytest.approx([math.sqrt(2 * 1000 * 5 / 2), 1.0, 1.0])


def test_threshold_grid_uses_the_same_doubles(spark):
    ps = [i * 0.01 for i in range(101)] + [0.289999, 0.29]
    d = spark.createDataFrame([(p,) for p in ps], "p double")
    for p, r in zip(ps, d.select(decisions.grid_step(F.col("p"), 100).alias("s")).collect()):
        assert r.s == max(i for i in range(101) if i * 0.01 <= p)


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    m[7] = m[3]
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")


@pytest.mark.parametrize("limit", [4096, 5])
def test_cosine_top_k_both_ways(vecs, limit):
    m, d = vecs
    q = d.where("id < 12").selectExpr("id AS query_id", "v AS vector")
    got = retrieval.cosine_top_k(d, "id", "v", q, 4, max_queries=limit).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u[:12] @ u.T, 9)
    for i in range(12):
        want = sorted(range(300), key=lambda j: (-s[i, j], j))[:4]
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want


def test_alignment_equals_all_pairs(vecs):
    m, d = vecs
    p = d.withColumn("w", F.reverse("v"))
    r = retrieval.alignment(p, "id", "v", "w").first()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    cross, off = u @ u[:, ::-1].T, ~np.eye(300, dtype=bool)
    assert (r.matched, r.mismatched, r.within_a) == pytest.approx((np.diag(cross).mean(), cross[off].mean(), (u @ u.T)[off].mean()))


def test_normalisation_of_a_flat_pool(spark):
    d = spark.createDataFrame([(1, "c", i, 0.5) for i in range(3)] + [(2, "c", i, float(i)) for i in range(3)], "query_id int, channel string, id int, score double")
    for m, flat, top in (("minmax", 1.0, 1.0), ("zscore", 0.5, 1 / (1 + math.exp(-1.224744871391589)))):
        r = {(x.query_id, x.id): x.norm for x in fusion.normalised(d, F.lit(m), ["query_id", "channel"]).collect()}
        assert r[(1, 0)] == flat and r[(2, 2)] == pytest.approx(top)


def test_weights_sum_to_one(spark):
    base = spark.createDataFrame([("weighted_sum", 0.6, 0.4, 0.2, 0.3), ("embedding_fusion", 0.6, 0.4, 0.0, 0.3)],
                                 "strategy string, image_weight double, text_weight double, lexical_weight double, cross_modal_weight double")
    a, b = [r[0] for r in base.select(fusion.channel_weights(F.lit(True), F.lit(True))).collect()]
    assert sum(a.values()) == pytest.approx(1) and a["image_to_image"] == pytest.approx(0.6 * 0.7 / 1.2)
    assert b == pytest.approx({"fused_to_image": 0.7, "fused_to_text": 0.3})


def test_ranking_metrics_by_hand(spark):
    d = spark.createDataFrame([("q", r, r in (1, 3)) for r in range(1, 6)], "query_id string, rank int, is_relevant boolean")
    n = spark.createDataFrame([("q", 3)], "query_id string, n_relevant int")
    r = ranking.query_scores(d, n, [5]).first()
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert (r.precision_5, r.recall_5, r.average_precision, r.reciprocal_rank) == pytest.approx((0.4, 2 / 3, (1 + 2 / 3) / 3, 1.0))
    assert r.ndcg_5 == pytest.approx((1 + 0.5) / ideal)


def test_brand_mining(spark):
    names = (["Gini and Jony Boys Tee"] * 4 + ["Turtle Check Shirt", "Turtle Plain Shirt", "Turtle Men Shirt", "Turtle Red Tie"]
             + ["Yves Saint Laurent Men Perfume", "Men Blue Jeans", "plain socks"])
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    words = spark.createDataFrame([(w,) for w in ("men", "boys", "blue", "red")], "word string")
    got = {r.name: r.brand for r in catalog.with_brand(d, "name", words).collect()}
    assert got["Gini and Jony Boys Tee"] == "Gini and Jony" and got["Turtle Check Shirt"] == "Turtle"
    assert got["Yves Saint Laurent Men Perfume"] == "Yves Saint Laurent" and got["Men Blue Jeans"] is None and got["plain socks"] is None


def test_linear_attribution_is_exact(spark):
    r = random.Random(2)
    d = spark.createDataFrame([(i, r.random(), r.choice("xyz"), float(r.random() < 0.4)) for i in range(200)], "id int, a double, c string, y double")
    w = models.balanced_weights(d, "y")
    m = models.fit(w, "logistic_regression", ["a"], ["c"], regParam=0.01)
    assert {r.encoded.split("__")[0] for r in models.linear_contributions(m, w, "id").collect()} == {"a", "c"}
    c = models.linear_contributions(m, w, "id").groupBy("id").agg(F.sum("contribution").alias("s"))
    raw = m.transform(w).select("id", F.element_at(F.expr("transform(split(substring(cast(rawPrediction as string), 2, 200), ','), x -> cast(replace(x, ']', '') as double))"), 2).alias("m"))
    j = c.join(raw, "id").toPandas()
    assert np.allclose(j.s - j.s.mean(), j.m - j.m.mean(), atol=1e-6)
    assert json.loads(models.top_factors(models.grouped_contributions(models.linear_contributions(m, w, "id"), "id", ["a", "c"], {}, {}), "id", w, ["a", "c"]).first().factors)


def test_group_folds_keep_the_label_ratio(spark):
    d = spark.createDataFrame([(i, f"g{i}", int(i < 6)) for i in range(60)] + [(100 + i, "g3", 0) for i in range(20)], "id long, g string, y int")
    rows = splits.group_folds(d, "g", "y", 5).collect()
    folds = {r.g: r.fold for r in rows}
    assert len(rows) == 80 and all(folds[r.g] == r.fold for r in rows)
    for positive in (True, False):
        sizes = [sum(f == k for g, f in folds.items() if (int(g[1:]) < 6) == positive) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_bad_scores_are_refused(spark):
    from quarrylane.operators import decisions, scoring

    for bad in (None, -0.2, 1.5, float("nan")):
        d = spark.createDataFrame([(0.5, 1, 10.0), (bad, 0, 10.0)], "p double, y int, v double")
        for job in (scoring.threshold_metrics(d, "p", "y", 0.3), scoring.reliability(d, "p", "y"), scoring.band_summary(d, "p", "y", "v"),
                    decisions.sweep_counts(d, "p", "y", "v")):
            with pytest.raises(Exception, match="score is missing"):
                job.collect()


def test_missing_residuals_and_spreads_stay_missing(spark):
    from quarrylane.operators import forecasts, inventory

    d = spark.createDataFrame([(1, 5.0), (2, 5.0)], "horizon int, f double")
    resid = spark.createDataFrame([(1, -6.0, 2.0)], "horizon int, resid_q10 double, resid_q90 double")
    got = {r.horizon: (r.q10, r.q90) for r in forecasts.with_intervals(d, "f", resid).collect()}
    assert got == {1: (0.0, 7.0), 2: (None, None)}
    s = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "s double").select(inventory.safety_normal(F.col("s"), F.lit(2.0)).alias("x"))
    assert [r.x for r in s.collect()] == [None, 0.0, 4.0]


def test_many_queries_find_their_rows(spark):
    from quarrylane.operators import retrieval

    c = spark.createDataFrame([(i, f"item{i:04d} plain") for i in range(300)], "id long, name string")
    q = spark.createDataFrame([(i, f"item{i % 300:04d}") for i in range(3000)], "query_id long, q string")
    got = retrieval.substring_scores(c, "id", q, "q", ["name"], ["name"], "name", 3)
    assert got.count() == 3000 and got.where("id != query_id % 300").count() == 0
    assert retrieval.all_terms_scores(c, "id", q, "q", 3, {"name": 1.0}).where("id = query_id % 300").count() == 3000


def test_best_rows_with_ties_and_slices(spark, monkeypatch):
    import numpy as np

    from quarrylane.operators import retrieval

    monkeypatch.setattr(retrieval, "SCORE_CELLS", 12)
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(10, 4)), 3, axis=0)
    best = retrieval._Best(retrieval._unit_rows(rng.normal(size=(3, 4))), 5)
    order = rng.permutation(30)
    best.add(order.astype(object), v[order])
    scores = np.round(retrieval._unit_rows(v) @ best.q.T, retrieval.SCORE_DIGITS)
    for j, (s, ids) in enumerate(best.kept):
        assert ids.tolist() == sorted(range(30), key=lambda i: (-scores[i, j], i))[:5]


def test_sampled_settings():
    got = models.sampled_settings(models.SPACES["boosted_trees"])
    assert len(got) == 30 == len({json.dumps(g) for g in got}) and got == models.sampled_settings(models.SPACES["boosted_trees"])
    assert all(g[k] in v for g in got for k, v in models.SPACES["boosted_trees"].items())
    assert len(models.sampled_settings(models.SPACES["logistic_regression"])) == 6


def test_staged_margins_end_at_the_model(spark):
    """The margins of all trees, started at one half, are the fitted classifier's own probability."""
    from quarrylane.operators import models, staging

    rows = [(float(i % 13), float(i % 7), float((i * i) % 5 < 2)) for i in range(200)]
    d = models.balanced_weights(spark.createDataFrame(rows, "a double, b double, y double"), "y")
    fitted = models.fit(d, "boosted_trees", ["a", "b"], [], maxIter=4, maxDepth=2)
    own = models.score(fitted, d).select("p").collect()
    staged = staging.staged_scores(staging.tree_margins(fitted, d), {"half": 0.5}, (1, 4, 9), ["y"])
    assert {r.rounds for r in staged.collect()} == {1, 4}
    last = staged.where("rounds = 4").collect()
    assert sorted(round(r.p, 9) for r in last) == sorted(round(r.p, 9) for r in own)


def test_substrings_by_rarest_run(spark):
    from quarrylane.operators import retrieval

    texts = [(1, "red shoes\nnike"), (2, "reddish"), (3, "shoe"), (4, ""), (5, None), (6, "sh\noes"), (7, "\u00e9t\u00e9 red")]
    terms = ["red", "shoes", "sh", "nowhere", "t\u00e9"]
    d = spark.createDataFrame(texts, "id long, near string")
    got = retrieval.holding_substrings(d, "id", "near", spark.createDataFrame([(x,) for x in terms], "term string"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(i, x) for i, t in texts for x in terms if t and x in t}


@pytest.mark.parametrize("pivots,block", [(1, 3), (7, 5), (40, 1000)])
def test_pruned_search_equals_all_scores(spark, pivots, block, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_VALUES", 6 * 50)  # several blocks of 50 rows in a cell
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 6)) * 3
    x = middles[rng.integers(0, 6, 400)] + rng.normal(size=(400, 6)) * 0.3
    x[10:30] = x[9]  # ties
    x[40:43] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    q = d.where("id % 13 = 0 OR id IN (41, 900)").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.pruned_top_k(d, "id", "v", q, 8, pivots, block).collect()}
    u = retrieval._unit_rows(x)
    want = {}
    for i in [*range(0, 400, 13), 41]:
        s = np.round(u @ u[i], 9)
        for n, j in enumerate(np.lexsort((np.arange(400), -s))[:8]):
            want[i, n + 1] = (int(j), float(s[j]))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_pruned_search_skips_far_cells(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(np.eye(8), 50, axis=0) * 5 + rng.normal(size=(400, 8)) * 0.05
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, __v array<double>")
    pivots = retrieval._unit_rows(np.eye(8))
    cells = retrieval._near_pivot(d, pivots)
    sizes = {r["cell"]: (r["n"], r["reach"]) for r in cells.groupBy("cell").agg(F.count("id").alias("n"), F.max("angle").alias("reach")).collect()}
    q = d.select(F.col("id").alias("query_id"), "__v", F.lit(0.9).alias("floor"))
    assert retrieval._cells_to_ask(q, pivots, sizes, 5, True).count() == 400
    assert retrieval._cells_to_ask(q, pivots, sizes, 5, False).count() == 0


def test_python_repeats_no_query_vector(spark, monkeypatch):
    """A query that meets every cell leaves Python as one row with a list, however many cells there are."""
    angle = np.arange(200) / 200 * 2 * math.pi
    pivots = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    sizes = {i: (3, 1.5) for i in range(200)}
    got = retrieval._wanted_cells(np.array([[1.0, 0.0], [0.0, 0.0]]), np.array([-2.0, -2.0]), pivots, sizes, 5)
    assert [len(c) for c in got] == [198, 198]
    monkeypatch.setattr(retrieval, "ASK_ROWS", 7)
    q = spark.createDataFrame([(i, [math.cos(i), math.sin(i)], -2.0) for i in range(50)], "query_id long, __v array<double>, floor double")
    for first, each in ((True, 2), (False, 198)):
        asked = retrieval._cells_to_ask(q, pivots, sizes, 5, first)
        assert asked.count() == 50 * each and asked.distinct().count() == 50 * each


def test_pruned_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    q = d.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    assert retrieval.pruned_top_k(d.limit(0), "id", "v", q, 3).count() == 0
    assert retrieval.pruned_top_k(d, "id", "v", q.limit(0), 3).count() == 0
    assert [tuple(r) for r in retrieval.pruned_top_k(d, "id", "v", q, 3).select("query_id", "id", "rank").collect()] == [(1, 1, 1)]


def test_refit_per_fold_knows_nothing_later(spark):
    import datetime as dt

    rng = random.Random(5)
    origins = [START + dt.timedelta(days=7 * i) for i in range(12)]
    folds = [splits.Fold(f"f{n}", o, o + dt.timedelta(days=1), o + dt.timedelta(days=7)) for n, o in enumerate(origins[8:10])]
    training = lambda last: [o for o in origins if o + dt.timedelta(days=7) <= last]
    rows = [(f"S{s}", o, float(h), o + dt.timedelta(days=h), float(rng.randint(1, 9) + s), float(s), "A" if s % 2 else "B")
            for s in range(6) for o in [*origins, *walk.error_origins(folds[0], 4, 2)[1:]] for h in range(1, 8)]
    schema = "series_id string, origin date, horizon double, target_date date, y_true double, level double, store string"
    late = folds[0].origin

    def forecasts_of(change):
        d = spark.createDataFrame([(*r[:4], r[4] + (change if r[3] > late else 0.0), *r[5:]) for r in rows], schema)
        got = walk.walk_forward(d, folds, training, {"tweedie": {"variancePower": 1.1, "maxIter": 5, "regParam": 0.1}}, ["level", "horizon"], ["store"], 4, 2)
        return got.collect()

    a, b = forecasts_of(0.0), forecasts_of(500.0)
    pick = lambda rs, f: {(r.part, r.series_id, r.origin, r.horizon): r.forecast for r in rs if r.fold == f}
    first, second = pick(a, "f0"), pick(a, "f1")
    assert first == pick(b, "f0") and second != pick(b, "f1")
    assert {k[0] for k in first} == {"test", "error"} and len([k for k in first if k[0] == "test"]) == 42
    assert {k[3] for k in first if k[0] == "error"} == {1, 2, 3, 4}
    assert walk.error_origins(folds[0], 4, 2) == [late, late + dt.timedelta(days=2)]
    with pytest.raises(ValueError, match="no training rows"):
        walk.walk_forward(spark.createDataFrame(rows, schema), folds, lambda last: [], {"tweedie": {}}, ["level"], [])


def test_repeated_days(spark):
    d = spark.createDataFrame([("A", START), ("A", START), ("A", START), ("B", START), (None, START), (None, START)], "series_id string, date date")
    assert tuple(panel.duplicate_days(d).first()) == (2, 3)
    assert tuple(panel.duplicate_days(d.limit(0)).first()) == (0, 0)


def test_naive_years(spark):
    d = spark.createDataFrame([("05/07/2018",), ("31/02/2018",), ("05/072018",), ("1/1/2017",), (None,), ("5/7/015",)], "date_raw string")
    assert {tuple(r) for r in rounds.naive_years(d).collect()} == {(2018, 1), (2017, 1)}


def test_a_probability_outside_its_range_stops_the_job(spark, monkeypatch):
    d = spark.createDataFrame([(1, 1.2), (2, 0.4)], "id long, p double")
    monkeypatch.setattr(models, "score", lambda model, df: df)
    contract = {"columns": ["id"], "threshold": 0.3, "monthly": "id", "value_cut": 20.0}
    good = models.score_and_decide(None, d.where("p < 1"), contract, decisions.Economics()).first()
    assert good.positive_at_threshold and good.value_tier == "High value" and good.risk_segment is not None
    with pytest.raises(Exception, match="outside"):
        models.score_and_decide(None, d, contract, decisions.Economics()).collect()


def test_origin_passes_copy_few_rows(tiny):
    origins = [START + dt.timedelta(days=60 + 7 * i) for i in range(8)]
    per = features.at_origins(tiny, origins, 28).groupBy("series_id", "date").count().agg(F.max("count")).first()[0]
    assert per <= 4


def test_croston_of_all_origins_equals_one_at_a_time(tiny):
    origins = [START + dt.timedelta(days=d) for d in (0, 45, 80, 119)]
    every = {(r.series_id, r.origin): r.croston_at_origin for r in features.croston_at_origins(tiny, origins, START).collect()}
    one = {}
    for o in origins:
        one |= {(r.series_id, r.origin): r.croston_at_origin for r in features.croston_at_origins(tiny, [o], START).collect()}
    assert every == one and len(every) == 8


def test_features_of_a_series_that_has_ended(spark):
    rows = [("S", START + dt.timedelta(days=i), 1.0 + i, 2.0) for i in range(10)]
    d = spark.createDataFrame(rows, "series_id string, date date, demand double, sell_price double")
    f = features.origin_features(d, [START + dt.timedelta(days=60), START + dt.timedelta(days=500)], START).orderBy("origin").collect()
    assert [r.nonzero_rate_28 for r in f] == [0.0, 0.0] and [r.days_since_last_sale for r in f] == [features.NEVER] * 2
    assert f[0].croston_at_origin > 0 and f[1].croston_at_origin == 0.0 and [r.hist_mean for r in f] == [5.5, 5.5]


@pytest.fixture(scope="module")
def catalogue(spark):
    # "casual" and "red" are each held by a third of all products or more.
    r = random.Random(3)
    rows = [(i, "casual" if i % 3 else r.choice(["sport", "formal", None]), "Red" if i % 2 else r.choice(["blue", "green"]),
             f"b{r.randrange(40)}") for i in range(900)]
    rules = [("q1", ["Casual"], [], [], []), ("q2", ["casual"], ["red"], [], ["7"]), ("q3", ["casual", "sport"], ["red", "blue"], [], None),
             ("q4", ["casual"], ["red"], ["b1", "b2", "B3"], []), ("q5", ["nothing"], [], [], []), ("q6", None, ["red"], None, []), ("q7", ["casual", "Casual"], ["green"], [], [])]
    return rows, rules


@pytest.mark.parametrize("cut", [None, 5, 50, 10_000])
def test_relevant_pairs_of_hot_values(spark, catalogue, cut):
    rows, rules = catalogue
    products = spark.createDataFrame(rows, "id long, usage string, colour string, brand string")
    d = spark.createDataFrame(rules, "query_id string, usages array<string>, colours array<string>, brands array<string>, exclude_ids array<string>")
    got = ranking.relevant_pairs(d, products, "id", {"usages": "usage", "colours": "colour", "brands": "brand"}, cut)
    want = [(q, row[0]) for q, *lists, out in rules for row in rows
            if any(lists) and str(row[0]) not in (out or [])
            and all(not wanted or (v is not None and v.lower() in {w.lower() for w in wanted}) for wanted, v in zip(lists, row[1:]))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_hot_values_are_dealt_out(spark, catalogue):
    rows, _ = catalogue
    low = spark.createDataFrame(rows, "id long, usage string, colour string, brand string")
    hot = spark.createDataFrame([("usage", "casual", True)], "field string, value string, hot boolean")
    cells = ranking._cells(low, "id", ["usage", "colour", "brand"], hot)
    probe = spark.createDataFrame([("q", "usage", "casual", "", "")], "query_id string, field string, value string, field2 string, value2 string")
    m = ranking.spread_pairs(cells, probe, "id", 50)
    sizes = [r["count"] for r in m.groupBy("part").count().collect()]
    assert sum(sizes) == 600 and len(sizes) == 12 and max(sizes) < 100


def test_actions_come_from_the_callers_table(spark):
    d = spark.createDataFrame([(1, 0.9, 100.0), (2, 0.05, 1.0), (3, 0.9, 1.0)], "id long, p double, monthly double")
    cells = [("Critical Risk", "High value", "call"), ("Low Risk", "Standard value", "wait"), ("Low Risk", "Standard value", "wait")]
    actions = spark.createDataFrame(cells, "risk_segment string, value_tier string, recommended_action string")
    got = {r.id: r.recommended_action for r in decisions.decide(d, "p", "monthly", decisions.Economics(), value_cut=500.0, actions=actions).collect()}
    assert got == {1: "call", 2: "wait", 3: None}
    assert "recommended_action" not in decisions.decide(d, "p", "monthly", decisions.Economics(), value_cut=500.0).columns


def test_features_read_renamed_columns(spark):
    row = {c: "Yes" for c in subscribers.ADDONS[:2]} | {c: "No" for c in subscribers.ADDONS[2:]}
    row |= {"months": 10, "MonthlyCharges": 20.0, "TotalCharges": 230.0, "InternetService": "DSL", "Contract": "Month-to-month",
            "PaymentMethod": "Mailed check", "Partner": "Yes", "Dependents": "No"}
    d = spark.createDataFrame([row])
    r = subscribers.with_features(d, {"tenure": "months"}).first().asDict()
    assert [r[c] for c in subscribers.ENGINEERED] == ["7-12m", 0, 1, 2, 2 / 6.0, 1, 0, 23.0, 20.0 / 23.0, 30.0, 20.0 / 3, 1, 10.0]


@pytest.mark.parametrize("hot", [0.0, 5.0])
def test_error_drivers_with_a_common_value(spark, hot):
    r = random.Random(5)
    rows = [(hot if i % 3 else r.random() * 9, float(i % 7), r.choice([0.5, r.random()]), 20.0) for i in range(300)]
    d = spark.createDataFrame(rows, "a double, b double, wape double, total_actual double")
    got = {x.characteristic: (x.spearman, x.n) for x in forecasts.error_drivers(d, ["a", "b"]).collect()}
    for k, name in enumerate("ab"):
        rho = np.corrcoef(*[np.array([(np.sum(v < x) + np.sum(v <= x) + 1) / 2 for x in v]) for v in (np.array([w[k] for w in rows]), np.array([w[2] for w in rows]))])[0, 1]
        assert got[name] == (pytest.approx(rho, abs=1e-9), 300)


def test_investor_leaders_need_no_sort_by_text(spark, capsys):
    rows = [(1, "A", "a", "x"), (2, "A.", "a", "x"), (2, "A", "a", "y"), (None, "Ab", "a", None), (3, "B", "b", "x"), (4, "C", None, "z"), (5, "C", None, "z"), (5, "D", None, "z")]
    d = spark.createDataFrame(rows, "sr_no long, investor string, investor_key string, startup string")
    got = rounds.investor_leaderboard(d, 2)
    assert [tuple(r) for r in got.collect()] == [(None, "C", 2, 1), ("a", "A", 2, 2)]
    big = rounds.investor_leaderboard(d).explain()
    assert big is None and "Expand" not in capsys.readouterr().out


def test_correlation_without_spread(spark):
    """A characteristic that all series share, or one error for all, is NaN as in SQL, not a division by zero."""
    rows = [(f"s{i}", 100.0 + i, 0.1 * i, 0.5, float(i % 7)) for i in range(30)]
    d = spark.createDataFrame(rows, "series_id string, total_actual double, wape double, flat double, own double")
    got = {r.characteristic: r for r in forecasts.error_drivers(d, ["flat", "own"]).collect()}
    assert math.isnan(got["flat"].spearman) and got["flat"].n == 30 and abs(got["own"].spearman) < 1
    (alike,) = forecasts.error_drivers(d.withColumn("wape", F.lit(1.0)), ["own"]).collect()
    assert math.isnan(alike.spearman)
    (pair,) = tx.factor_correlation(d, ["flat", "own"], "series_id").collect()
    assert math.isnan(pair.correlation)


def test_weights_and_medians_are_counted_once(spark):
    """No job of a fit counts the classes again, and given medians give the same model."""
    rows = [(float(i % 11) if i % 5 else None, float(i % 7), float(i % 3 == 0)) for i in range(90)]
    d = models.balanced_weights(spark.createDataFrame(rows, "a double, b double, y double"), "y")
    assert "subquery" not in d._jdf.queryExecution().toString().lower()
    assert {(r.y, r.weight) for r in d.collect()} == {(1.0, 1.5), (0.0, 0.75)}
    own = models.fit(d, "logistic_regression", ["a", "b"], [])
    given = models.fit(d, "logistic_regression", ["a", "b"], [], models.fitted_imputer(d, ["a", "b"]))
    assert own.stages[-1].coefficients.toArray().tolist() == given.stages[-1].coefficients.toArray().tolist()
