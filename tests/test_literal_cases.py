"""Operators on literal rows with known answers, and statistics against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupsight.functions import scalars as S
from groupsight.operators import clean, evaluate, features, sampling, stats, transform
from groupsight.streaming import jobs


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_podium_and_reserve(spark):
    r = spark.createDataFrame([(1, 0.25), (2, 0.8), (3, 0.4)], "scorer long, reward double")
    got = [(x.scorer, round(x.weight, 9)) for x in evaluate.podium(r, "scorer").orderBy(F.desc("weight")).collect()]
    assert got == [(0, 0.97), (2, 0.015), (3, 0.009), (1, 0.006)]
    none = spark.createDataFrame([(1, 0.0), (2, -0.1), (3, 0.0)], "scorer long, reward double")
    assert [tuple(x) for x in evaluate.podium(none, "scorer").collect()] == [(0, 1.0)]


def test_epochs_around_the_anchor(spark):
    t = spark.createDataFrame([("2026-05-12 19:59:00",), ("2026-05-12 20:00:00",), ("2026-05-15 19:59:59",), ("2026-05-15 20:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = [(str(r.epoch_start), str(r.epoch_end)) for r in jobs.epoch(t, "t").orderBy("t").collect()]
    assert got == [
        ("2026-05-11 20:00:00", "2026-05-12 20:00:00"), ("2026-05-12 20:00:00", "2026-05-15 20:00:00"), ("2026-05-12 20:00:00", "2026-05-15 20:00:00"), ("2026-05-15 20:00:00", "2026-05-18 20:00:00"),
    ]


def test_event_types(spark):
    for raw, want in (("RAISE", "raise"), (" all_in ", "all_in"), ("re-raise to", "raise"), ("muck", "fold"), ("shows", ""), (None, "")):
        assert one(spark, S.event_type(F.col("t")), t=raw) == want
    kind = S.infer_event_type(F.lit("?"), F.col("a"), F.lit(0.0), F.lit(0.0), F.col("b"), F.col("c"))
    assert one(spark, kind, a=1.0, b=1.0, c=2.0) == "bet" and one(spark, kind, a=1.0, b=2.0, c=2.0) == "call" and one(spark, kind, a=0.0, b=2.0, c=2.0) == "check"


def test_units_round_half_to_even_and_clamp(spark):
    assert one(spark, S.to_units(F.col("v"), F.col("u")), v=0.125, u=1.0) == 0.12
    assert one(spark, S.to_units(F.col("v"), F.col("u")), v=-5.0, u=1.0) == 0.0 and one(spark, S.to_units(F.col("v"), F.col("u")), v=5.0, u=0.0) == 0.0
    assert one(spark, S.to_units(F.col("v"), F.col("u")), v=1e9, u=1.0) == 500.0


def test_remap_rejects_falling_anchors():
    with pytest.raises(ValueError):
        S.remap(None, [(0.0, 0.5), (1.0, 0.2)])


EVENTS = [("g", "s", i + 1, 0, t, a, x, 0.0, 1.0) for i, (t, a, x) in enumerate([
    ("small_blind", 1, 0.5), ("call", 2, 1.0), ("check", 3, 0.0), ("check", 3, 0.0), ("check", 3, 0.0), ("check", 4, 0.0), ("raise", 2, 4.0), ("fold", 3, 0.0),
])]
SCHEMA = "grp string, sess string, ord long, stage int, type string, actor long, amount double, total double, stack double"


def test_noops_collapse_and_forced_events_go(spark):
    e = spark.createDataFrame(EVENTS, SCHEMA)
    assert [r.ord for r in clean.collapse_noops(e).orderBy("ord").collect()] == [1, 2, 3, 6, 7, 8]
    view = clean.canonical_view(e).orderBy("pos").collect()
    assert view[0].type == "call" and [r.pos for r in view] == list(range(1, len(view) + 1)) and {r.actor for r in view} <= {1, 2, 3, 4} and view[0].actor == 1
    lone = spark.createDataFrame([("g", "x", 1, 0, "call", 1, 1.0, 1.0, 1.0)], SCHEMA)
    assert clean.sample_events(lone).count() == 12


def test_session_features_by_hand(spark):
    f = features.session_features(spark.createDataFrame(EVENTS, SCHEMA), None).first()
    assert (f.n_actions, f.n_players, f.check_ratio, f.max_consecutive, f.fold_position_mean) == (7.0, 4.0, 4 / 7, 4.0, 1.0)
    p = np.array([1, 4, 1, 1]) / 7
    assert f.action_entropy == pytest.approx(-(p * np.log2(p)).sum()) and f.bet_size_mean == 2.5 and f.aggression_factor == pytest.approx(1 / 6)
    other = spark.createDataFrame([("g", "s", 1, 0, "other", 1, 1.0, 1.0, 1.0)], SCHEMA)
    only = features.session_features(other, None).first()
    assert only.other_ratio == 1.0 and only.n_actions == 1.0 and only.call_ratio == 0.0 and only.action_entropy == 0.0
    assert len(features.feature_names()) == 147


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    for run in (lambda d: sampling.stratified_split(d, "id", "y", 0.2), lambda d: sampling.packed(d, "id", 30, 25), lambda d: sampling.rotating_window(d, "id", 3, 70)):
        a, b = (sorted(map(tuple, run(df.repartition(n)).collect())) for n in (1, 32))
        assert a == b and a


def test_splits_and_quotas(spark):
    df = spark.range(101).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    s = sampling.stratified_split(df, "id", "y", 0.2)
    assert s.count() == 101 and s.where("split = 'val' AND y = 1").count() == 3
    sizes = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20), ("d", 1)], "k string, n long")
    q = {r.k: r.quota for r in sampling.quotas(sizes, "k", "n", 10).collect()}
    assert sum(q.values()) == 10 and q == {"a": 5, "b": 3, "c": 2, "d": 0}
    assert sampling.balanced(df, "id", "y").groupBy("y").count().select("count").distinct().count() == 1


def test_ks_auc_anova_equal_numpy(spark):
    g = np.random.default_rng(0)
    x, y = np.round(g.normal(size=400), 1), (g.random(400) < 0.4).astype(int)
    rows = [(float(v), int(k)) for v, k in zip(x, y, strict=True)] + [(float("nan"), 1), (float("inf"), 0), (None, 1)]
    df = spark.createDataFrame(rows, "x double, label int")
    a, b = np.sort(x[y == 1]), np.sort(x[y == 0])
    grid = np.unique(x)
    d = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max()
    assert stats.ks(df, ["x"], F.col("label") == 1).first().ks == pytest.approx(d)
    wins = np.mean([(p > q) + 0.5 * (p == q) for p in a for q in b])
    assert stats.auc(df, ["x"], "label").first().auc == pytest.approx(wins)
    m = x.mean()
    between = len(a) * (a.mean() - m) ** 2 + len(b) * (b.mean() - m) ** 2
    within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    assert stats.anova(df, ["x"], "label").first().f == pytest.approx(between / (within / 398))


def test_p_values_at_known_points():
    assert stats._beta_tail(1.0, 1, 1) == pytest.approx(0.5, abs=1e-6)
    assert stats._beta_tail(3.841458820694124, 1, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert stats._beta_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert stats._beta_tail(3.4928284767356, 2, 20) == pytest.approx(0.05, abs=1e-5)


def test_kolmogorov_series(spark):
    assert one(spark, stats.ks_pvalue(F.lit(1.3581 / 10), F.lit(200.0), F.lit(200.0)), a=1) == pytest.approx(0.05, abs=1e-3)


def test_fdr_and_ties(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "feature string, p_value double")
    got = {r.feature: round(r.p_fdr_bh, 6) for r in stats.multiple_tests(p).collect()}
    assert got == {"a": 0.04, "b": 0.04, "c": 0.04, "d": 0.5}


def test_reward_is_zero_beyond_the_cap_and_half_rounds_down(spark):
    rows = [(0, 0.5, 0), (0, 0.6, 1), (1, 0.9, 0), (1, 0.8, 1)]
    got = {r.scorer: r for r in evaluate.reward(spark.createDataFrame(rows, "scorer int, score double, label int"), ["scorer"]).collect()}
    assert got[0].fpr == 0.0 and got[0].reward == 1.0 and got[1].reward == 0.0 and got[1].ap == 0.5
    single = evaluate.reward(spark.createDataFrame([(0, 0.2, 0)], "scorer int, score double, label int"), ["scorer"]).first()
    assert single.ap == 0.0 and single.reward == 0.0


def test_gap_in_both_forms(spark):
    s = [0.1, 0.11, 0.12, 0.13, 0.14, 0.8, 0.81, 0.82, 0.83, 0.84]
    df = spark.createDataFrame([(1, x) for x in s] + [(2, 0.5)] * 12, "b int, score double")
    got = {r.b: r.threshold for r in evaluate.bimodal_gap(df, ["b"]).collect()}
    assert got[1] == pytest.approx(0.47) and got[2] is None and evaluate.gap_of(np.array(s)) == pytest.approx(0.47)
    out = evaluate.dynamic_threshold(df.withColumn("k", F.lit("x")), "k", "b").orderBy("b").collect()
    assert [(r.threshold, r.mode) for r in out] == [(0.45, "gap_batch"), (0.45, "gap_rolling")]


def test_transforms_on_missing_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (float("nan"), 5.0), (float("inf"), 5.0), (3.0, 5.0)], "x double, c double")
    assert transform.fill_fit(df, ["x"]) == {"x": 2.0} and transform.robust_fit(df, ["c"]) == {"c": (5.0, 1.0)}
    assert [r.x for r in transform.fill_apply(df, {"x": 2.0}).collect()] == [1.0, 2.0, 2.0, 2.0, 2.0, 3.0]
    assert one(spark, transform.log1p_of(F.col("v"), "clamp"), v=-3.0) == 0.0 and one(spark, transform.log1p_of(F.col("v")), v=-3.0) == pytest.approx(-np.log(4))


def test_schema_tools(spark):
    df = spark.createDataFrame([((1, [(2, "x")]),)], "r struct<a:int,l:array<struct<b:int,secret:string>>>")
    out = clean.strip_private(df, {"secret"})
    assert clean.keys_of(out.schema) == {"r", "a", "l", "b"} and out.first().r.l[0].b == 2
    want = T.StructType([T.StructField("r", T.StructType([T.StructField("z", T.StringType()), T.StructField("a", T.LongType())]))])
    assert clean.enforce_schema(df, want).first().r.asDict() == {"z": None, "a": 1}
    with pytest.raises(ValueError):
        clean.align_columns(df, ["q"])


def test_manifests_are_transparent_or_opaque(spark):
    from groupsight.operators import records as R

    good = {
        "open_source": "true", "repo_url": "https://host/own", "repo_commit": "69df8454943e965e08d3b7923182e0a69981584c", "model_name": "reference", "model_version": "1",
        "training_data_statement": "none", "private_data_attestation": "none",
    }
    report = lambda changes, files=("a.py",), digest="abc": spark.range(1).select(R.manifest_report(
        {k: F.lit(v) for k, v in (good | changes).items()}, F.array(*[F.lit(x) for x in files]).cast("array<string>"), F.lit(digest), "https://host/own", ("reference",)).alias("m")).first().m
    assert (report({}).status, report({}).missing, report({}).violations, report({}).suspicion) == ("transparent", [], [], [])
    own = report({"model_name": "mine"})
    assert own.status == "opaque" and own.violations == ["repo_url_must_point_to_model_repo"]
    assert report({"repo_url": "https://host/mine", "model_name": "mine", "repo_commit": "<full_git_commit_sha>"}).violations == ["repo_commit_invalid"]
    bare = report({"open_source": "false", "training_data_statement": " "}, (), "")
    assert bare.missing == ["open_source", "training_data_statement", "implementation_files", "implementation_sha256"]
    assert bare.suspicion == ["manifest_not_open_source", "manifest_missing_training_data_statement"]
    assert report({k: "" for k in good}).suspicion == ["missing_model_manifest"]


def test_session_errors_of_literal_sessions(spark):
    from groupsight.operators import records as R

    kind = "payouts map<string,double>, rake double, total double, private array<array<string>>, stages array<struct<stage:string,board:array<string>>>, ended string"
    flop, turn = ("flop", ["a", "b", "c"]), ("turn", ["a", "b", "c", "d"])
    rows = [
        ({"x": 0.91}, 0.06, 0.97, [["a", "b"], None], [], "preflop"), ({"x": 0.91}, 0.06, 0.98, [["a"]], [("flop", ["a", "b"])], "flop"),
        ({}, None, None, None, [flop, turn], "turn"), (None, 1.0, 1.0, [], [turn, flop], "turn"), ({"x": 0.9}, 0.1, 1.0, [], None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    found = df.select(R.session_errors(*[F.col(c) for c in df.columns]).alias("e")).collect()
    assert [r.e for r in found] == [[], ["board", "end", "private", "total"], [], ["end"], ["end"]]


def test_keys_leakage_and_pairs(spark):
    from groupsight.operators import records as R

    a = spark.createDataFrame([], "id long, x struct<p:int,q:array<struct<r:int>>>")
    b = spark.createDataFrame([], "x struct<p:int,q:array<struct<s:int>>>, id int")
    assert R.key_differences(a.schema, b.schema) == ["+x.q[].r", "-x.q[].s"]
    assert R.pair_issues(a, b, {"id"}) == ["leakage_id", "order", "type_id", "type_x"]
    assert R.table_issues(a.select("id", a.id.alias("ID"))) == ["id"]


def test_draws_and_packs_of_ranged_size(spark):
    from collections import Counter

    from groupsight.operators import sampling as U

    df = spark.range(1000).withColumnRenamed("id", "k")
    draws = [r.k for r in U.with_replacement(df, "k", 5000).collect()]
    assert len(draws) == 5000 and len(set(draws)) > 980 and max(Counter(draws).values()) < 20
    packs = Counter(r.pack for r in U.packed_ranges(df, "k", 5, 9).collect())
    assert sum(packs.values()) == 1000 and max(packs.values()) <= 9 and sum(5 <= n for n in packs.values()) >= len(packs) - 2
    assert {r.k: r.pack for r in U.packed_ranges(df, "k", 5, 9).collect()} == {r.k: r.pack for r in U.packed_ranges(df.repartition(7), "k", 5, 9).collect()}
