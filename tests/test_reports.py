"""Report operators by hand: missing values, empty sides, ties, failures."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupsight.operators import evaluate as E
from groupsight.operators import reports as R
from groupsight.operators import sampling as U
from groupsight.operators import stats as S


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


def test_hard_and_easy_against_numpy(spark):
    g = np.random.default_rng(20)
    n = 400
    y, s, a = (g.random(n) < 0.6).astype(int), g.random(n), g.normal(size=n)
    rows = [(int(y[i]), float(s[i]), None if i % 17 == 0 else float(a[i]), 2.0) for i in range(n)]
    got = rows_of(R.hard_easy_contrast(spark.createDataFrame(rows, "label int, score double, a double, flat double"), ["a", "flat"]), "feature")
    x = np.where(np.arange(n) % 17 == 0, np.nan, a)
    hard, easy, human = x[(y == 1) & (s < 0.5)], x[(y == 1) & (s >= 0.5)], x[y == 0]
    r = got["a"]
    assert r.z_easy == pytest.approx(abs(np.nanmean(easy) - np.nanmean(hard)) / np.nanstd(hard, ddof=1))
    assert r.z_human == pytest.approx(abs(np.nanmean(hard) - np.nanmean(human)) / np.nanstd(human, ddof=1))
    assert r["corr"] == pytest.approx(np.corrcoef(np.nan_to_num(x[y == 1]), s[y == 1])[0, 1])
    assert got["flat"]["corr"] is None and got["flat"].z_easy == 0


def test_segments_have_the_rates_of_their_class(spark):
    rows = [("a", 0, 0.6), ("a", 0, 0.1), ("a", 1, 0.2), ("a", 1, 0.9), ("a", 1, None), ("b", 1, 0.3), (None, 1, 0.5)]
    got = {(r.seg, r.label): r for r in R.segment_blocks(spark.createDataFrame(rows, "seg string, label int, score double"), "seg").collect()}
    assert (got["a", 0].fpr, got["a", 0].recall, got["a", 0].recalls) == (0.5, None, None)
    assert (got["a", 1].recall, got["a", 1].recalls, got["a", 1].n, got["a", 1].median) == (0.5, [1.0, 0.5, 0.5], 2, pytest.approx(0.55))
    assert got["b", 1].recalls == [1.0, 1.0, 0.0]


def test_profiles_match_by_weighted_median(spark):
    d = spark.createDataFrame([("a", 0.1, 1.0), ("b", 0.5, 3.0), ("c", 0.3, 0.01)], "feature string, ks double, weight double")
    r = R.profile_match(d).first()
    assert (r.n_features, r.median_ks, r.weighted_median_ks, r.reached) == (3, 0.3, 0.5, False) and R.profile_match(d, 0.3, 0.5).first().reached
    none = R.profile_match(d.limit(0)).first()
    assert (none.n_features, none.median_ks, none.reached) == (0, 1.0, False)
    rows = [(1, None, 0.0), (1, 0.0, 1.0), (1, 2.0, 2.0), (0, 0.0, 5.0), (0, None, 6.0), (0, float("nan"), 7.0)]
    got = rows_of(R.profile_distances(spark.createDataFrame(rows, "y int, a double, b double"), ["a", "b"], F.col("y") == 1, {"b": 2.0}), "feature")
    assert got["a"].ks == pytest.approx(1 / 3) and got["a"].mean_a == pytest.approx(2 / 3) and (got["b"].ks, got["b"].weight) == (1.0, 2.0)
    assert R.profile_distances(spark.createDataFrame(rows[:4], "y int, a double, b double"), ["a"], F.col("y") == 1).count() == 0
    pulled = rows_of(R.adjusted_fingerprint(spark.createDataFrame([("a", 0.3, 1.0, 3.0, 1.0), ("b", 0.1, 1.0, 3.0, 2.0)], "feature string, ks double, mean_a double, mean_b double, weight double")), "feature")
    assert (pulled["a"].mean, pulled["a"].weight, pulled["b"].mean, pulled["b"].weight) == (2.0, 1.3, 1.0, 2.2)


def test_strategies_and_gates(spark):
    rows = [("x", 80.0, 3.0, 1.0, 90.0, None), ("y", 82.0, None, 1.0, 0.0, None), ("z", 99.0, 0.0, 0.0, 99.0, "failed"), ("w", 80.0, 2.0, 5.0, None, None)]
    t = spark.createDataFrame(rows, "trial string, recall double, fpr double, other_fpr double, low_recall double, error string")
    got = rows_of(R.strategy_scores(t), "trial")
    assert {k: (r.strategy_score, r.place) for k, r in got.items()} == {"x": (84.0, 1), "w": (74.0, 2), "z": (-1.0, 3), "y": (82.0 - 97 * 5, 4)}
    g = R.release_gates(t, {"recall": ("min", 80.0), "fpr": ("max", 2.0)}).collect()
    assert {r.trial: (r.recall_ok, r.fpr_ok) for r in g} == {"x": (True, False), "y": (True, False), "z": (True, True), "w": (True, True)} and not any(r.release for r in g)


def test_suspicion_keeps_the_last_events(spark):
    rows = [("a", c, ["late"] if c % 2 else ["late", "closed"]) for c in range(10)] + [("a", 10, []), ("b", 3, ["closed"]), ("c", 1, [])]
    df = spark.createDataFrame(rows, "scorer string, cycle int, reasons array<string>")
    got = rows_of(R.suspicion(df, "scorer", "cycle", "reasons", last=4), "scorer")
    assert set(got) == {"a", "b"} and got["a"].counts == {"late": 10, "closed": 5} and (got["a"].events, got["a"].last_cycle, got["a"].last_reasons) == (4, 9, ["late"])
    assert sorted((r.scorer, r.cycle) for r in R.last_events(df, "scorer", "cycle", "reasons", last=4).collect()) == [("a", 6), ("a", 7), ("a", 8), ("a", 9), ("b", 3)]


def test_statuses_change_and_sum_up(spark):
    df = spark.createDataFrame([("a", 1, "opaque"), ("a", 2, "opaque"), ("a", 3, "transparent"), ("b", 5, None), ("b", 6, None), ("c", 2, "opaque")], "scorer string, cycle int, status string")
    got = {(r.scorer, r.cycle): (r.previous, r.changed) for r in R.status_changes(df, "scorer", "cycle", "status").collect()}
    assert got == {("a", 1): (None, True), ("a", 2): ("opaque", False), ("a", 3): ("opaque", True), ("b", 5): (None, False), ("b", 6): (None, False), ("c", 2): (None, True)}
    s = R.compliance_summary(df, "scorer", "cycle", "status").first()
    assert (s.tracked, s.transparent, s.opaque, s.last_cycle) == (3, 1, 1, 6)


def test_answers_are_cut_and_missing_ones_count(spark):
    given = spark.createDataFrame([("a", 1, p, 0.5) for p in range(4)] + [("b", 2, 0, 0.5), ("x", 9, 0, 0.5)], "scorer string, cycle int, position int, score double")
    expected = spark.createDataFrame([(1, 3), (2, 2), (3, 0)], "cycle int, expected int")
    kept, coverage = E.answers(given, expected, spark.createDataFrame([("a",), ("b",), ("c",)], "scorer string"), "scorer", "cycle", "position")
    assert kept.count() == 4 and kept.where("scorer = 'a'").agg(F.max("position")).first()[0] == 2
    assert {(r.scorer, r.cycle): r.coverage for r in coverage.collect() if r.coverage} == {("a", 1): 1.0, ("b", 2): 0.5} and coverage.count() == 9


def test_windowed_rewards_with_coverage_and_latency(spark):
    good = [("a", c, 0.9 if c % 2 else 0.1, c % 2) for c in range(50)] + [("few", 1, 0.9, 1)]
    df = spark.createDataFrame(good, "scorer string, cycle int, score double, label int")
    responses = spark.createDataFrame([("a", c, 1.0 if c >= 10 else 0.0, None if c == 49 else float(c)) for c in range(50)] + [("gone", 1, 0.0, None)], "scorer string, cycle int, coverage double, latency double")
    got = rows_of(E.windowed_reward(df, "scorer", ["cycle"], responses=responses), "scorer")
    assert (got["a"].reward, got["a"].samples, got["a"].coverage, got["a"].latency) == (1.0, 40, 1.0, pytest.approx(np.mean(range(9, 49))))
    assert (got["few"].reward, got["few"].fpr, got["few"].samples, got["few"].coverage) == (0.0, 1.0, 1, 0.0)
    assert (got["gone"].reward, got["gone"].samples, got["gone"].coverage, got["gone"].latency) == (0.0, 0, 0.0, None)


def test_sessions_as_recorded(spark):
    rows = [("g", "s", 1, 0, "call", 1, 2.0, 2.0, 10.0), ("g", "s", 2, 0, "raise", 2, 3.0, 5.0, 20.0), ("g", "s", 3, 1, "fold", 1, 0.0, 5.0, 8.0), ("g", "t", 1, 0, "check", 7, None, 0.0, 5.0)]
    e = spark.createDataFrame(rows, "grp string, sess string, ord int, stage int, type string, actor int, amount double, total double, stack double")
    p = rows_of(R.raw_session_profile(e, spark.createDataFrame([("s", 3, 0.5)], "sess string, seats int, fee double")), "sess")
    assert (p["s"].stack_mean, p["s"].stack_std, p["s"].n_players, p["s"].n_streets, p["s"].meta_seats, p["s"].meta_fee) == (15.0, pytest.approx(50**0.5), 2, 2, 3.0, 0.5)
    assert (p["t"].stack_std, p["t"].amount_std, p["t"].meta_fee) == (0.0, 0.0, None)
    s = R.shortcut_features(e).first()
    assert (s.chunk_size, s.avg_players, s.avg_actions, s.avg_call, s.avg_check, s.avg_amount_sum, s.avg_total_sum) == (2, 1.5, 2.0, 0.5, 0.5, 2.5, 6.0)
    assert [r.line for r in R.compact_session(e).orderBy("sess").collect()] == ["s0:C:1 | s0:R:2 | s1:F:1", "s0:C:7"]
    keys = spark.createDataFrame([(0.05, 2, 0, 6), (0.5, 6, 1, 7), (4.9, 7, 2, 14), (5.0, 1, 3, 15)], "u double, a int, st int, n int")
    assert [r[0] for r in keys.select(R.stratum_key(F.col("u"), F.col("a"), F.col("st"), F.col("n"))).collect()] == ["micro|hu|pf|short", "low|sh|flop|mid", "mid|fr|deep|mid", "high|hu|deep|long"]


def test_correlations_by_numpy(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 5)) + 1e4
    x[:, 1] += x[:, 0]
    x[:, 4] = 7.1
    x[g.random((400, 5)) < 0.1] = np.nan
    x[60:, 3] = np.inf
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"x{k} double" for k in range(5))).repartition(7)
    got = {(r.a, r.b): r for r in S.correlations(df, df.columns).collect()}
    assert len(got) == 10
    for i in range(5):
        for j in range(i + 1, 5):
            both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            r = got[f"x{i}", f"x{j}"]
            assert r.n == both.sum()
            if both.sum() < 50 or j == 4:
                assert r.r is None
            else:
                assert r.r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    empty = S.correlations(df.limit(0), df.columns, least_rows=0).collect()
    assert len(empty) == 10 and all(r.r is None and r.n == 0 for r in empty)
    assert S.correlations(df, ["x0"]).count() == 0


def test_moments_of_missing_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (float("nan"), None)], "a double, b double")
    out = {r.feature: r for r in S.describe(df, ["a", "b"]).collect()}
    assert (out["a"]["count"], out["a"].mean, out["a"].q50, out["a"].missing) == (2, 2.0, 2.0, pytest.approx(1 / 3))
    assert (out["b"]["count"], out["b"].mean, out["b"].missing) == (0, None, 1.0)
    assert [r["count"] for r in S.describe(df.limit(0), ["a", "b"]).collect()] == [0, 0]
    assert [r.feature for r in S.profile(df, ["a", "b"]).collect()] == ["a"]
    report = {r.feature: r for r in S.feature_report(df, ["a", "b"]).collect()}
    assert (report["a"].n_unique, report["b"].n_unique, report["b"].constant) == (2, 0, True)


def test_pools_keep_their_ratio(spark):
    a = spark.createDataFrame([(i, "x") for i in range(10)], "id long, pool_name string")
    b = spark.createDataFrame([(i, "y") for i in range(100, 190)], "id long, pool_name string")
    once = U.pool_at_ratio(a, b, "id", 0.25).toPandas()
    assert once.groupby("pool").size().to_dict() == {"a": 10, "b": 30} and once.id.is_unique and once.draw.isna().all()
    drawn = U.pool_at_ratio(a, b, "id", 0.25, replace=True).toPandas()
    assert drawn.groupby("pool").size().to_dict() == {"a": 45, "b": 135} and set(drawn.id[drawn.pool == "a"]) <= set(range(10)) and not drawn.id.is_unique
    again = U.pool_at_ratio(a.repartition(5), b.repartition(3), "id", 0.25, replace=True).toPandas()
    key = ["pool", "draw"]
    assert drawn.sort_values(key).id.tolist() == again.sort_values(key).id.tolist()
    for share, left in ((0.0, a), (1.0, a), (0.5, a.limit(0))):
        with pytest.raises(ValueError):
            U.pool_at_ratio(left, b, "id", share)


def test_threshold_methods_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 0.2), (None, 0.4), (None, None), (1, 0.3), (1, float("nan"))], "k long, score double")
    out = {r.k: r for r in E.threshold_methods(df, ["k"]).collect()}
    assert out[None].passive == pytest.approx(0.3) and out[None].hybrid == pytest.approx(0.4) and out[1].passive == 0.3


def test_partitions_of_order_events_follow_the_rows(spark, tiny, monkeypatch):
    """A table of many rows is dealt by session into tasks of bounded size; the events stay the same."""
    from groupsight.sources import bindings as B

    plain = B.order_events(spark, tiny)
    monkeypatch.setattr(B, "MANY_ROWS", 100)
    monkeypatch.setattr(B, "TASK_ROWS", 200)
    events = B.order_events(spark, tiny)
    n = spark.read.parquet(f"{tiny}/lineitem.parquet").count()
    assert events.rdd.getNumPartitions() == -(-n // 200) > 8
    assert events.exceptAll(plain).isEmpty() and plain.exceptAll(events).isEmpty()


def test_orders_meet_customers_in_tasks_that_follow_the_rows(spark, tiny, monkeypatch):
    from groupsight.sources import bindings as B

    monkeypatch.setattr(B, "MANY_ROWS", 100)
    monkeypatch.setattr(B, "TASK_ROWS", 200)
    parts = -(-spark.read.parquet(f"{tiny}/orders.parquet").count() // 200)
    assert parts > spark.sparkContext.defaultParallelism
    plan = B.order_events(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    for key in ("o_custkey", "c_custkey"):
        assert re.search(rf"RepartitionByExpression \[{key}#\d+L?\], {parts}\b", plan)


def test_session_features_keep_the_tasks_that_events_were_dealt_into(spark, tiny, monkeypatch):
    """The windows and the aggregate by session add no shuffle that would join dealt tasks again; the fitted indices stay the same."""
    from groupsight.operators import features as G
    from groupsight.plans.q_features import g_derived_fit
    from groupsight.sources import bindings as B

    plain = rows_of(g_derived_fit(spark, tiny), "grp")
    for module in (B, G):
        monkeypatch.setattr(module, "MANY_ROWS", 100)
    monkeypatch.setattr(B, "TASK_ROWS", 200)
    sessions = G.session_features(B.order_events(spark, tiny))
    assert sessions.rdd.getNumPartitions() == -(-spark.read.parquet(f"{tiny}/lineitem.parquet").count() // 200) > 8
    got = rows_of(g_derived_fit(spark, tiny), "grp")
    assert got.keys() == plain.keys()
    for k, r in got.items():
        assert list(r) == pytest.approx(list(plain[k]), abs=2e-6)


def test_shortcut_features_count_actors_and_stages_without_dealing_rows_again(spark):
    rows = [(1, 1, 1, 0, "call", 7, 1.0, 1.0), (1, 1, 2, 0, "fold", 7, 2.0, 3.0), (1, 1, 3, 1, "call", 8, 1.0, 4.0), (1, 1, 4, None, "raise", None, 1.0, 5.0), (1, 2, 1, 0, "check", None, None, None)]
    events = spark.createDataFrame(rows, "grp long, sess long, ord long, stage int, type string, actor long, amount double, total double")
    out = R.shortcut_features(events)
    (r,) = out.collect()
    assert (r.chunk_size, r.avg_players, r.avg_streets, r.avg_actions, r.avg_call, r.avg_amount_sum, r.avg_total_sum) == (2, 1.0, 1.5, 2.5, 1.0, 2.5, 6.5)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
