"""Running sums, quantiles, rolling windows and what stands on them: against numpy, and as plans without a window over a whole group."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groupsight.operators import evaluate as E
from groupsight.operators import features as G
from groupsight.operators import ordered as O
from groupsight.operators import stats as S
from groupsight.operators import transform as T
from groupsight.sources import bindings


@pytest.fixture(scope="module")
def values(spark):
    """One hot group, a small one, a null one; ties, repeats, bad values."""
    g = np.random.default_rng(8)
    rows = [("hot", i, float(np.round(g.normal(), 2)), int(g.integers(0, 2))) for i in range(4000)] + [("small", i, float(i % 3), i % 2) for i in range(7)] + [(None, 1, 2.0, 1), (None, 2, 1.0, 0)]
    rows += [("small", 7, None, 1), ("small", 8, float("nan"), 0), ("small", 9, float("inf"), 1)]
    return spark.createDataFrame(rows, "grp string, at int, x double, label int")


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as they are, so that a small group has many."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
    spark.conf.set("spark.sql.shuffle.partitions", old[1])


def test_running_sums_cross_ranges(spark, values, many_ranges):
    rows = values.where("x IS NOT NULL AND NOT isnan(x)")
    out = O.running(rows, ["grp"], [F.col("x"), F.col("at")], {"place": F.lit(1), "ones": F.col("label")}, previous="x").toPandas()
    assert len(out) == rows.count()
    for _, g in out.groupby("grp", dropna=False):
        g = g.sort_values(["x", "at"])
        assert g.place.tolist() == list(range(1, len(g) + 1)) and (g.place_total == len(g)).all()
        assert g.ones.tolist() == g.label.cumsum().tolist() and (g.ones_total == g.label.sum()).all()
        assert g.previous_x.iloc[1:].tolist() == g.x.iloc[:-1].tolist() and np.isnan(g.previous_x.iloc[0])
    whole = O.running(rows, [], [F.desc("x"), F.col("at"), F.col("grp")], {"place": F.lit(1)}).orderBy("place").toPandas()
    assert whole.place.tolist() == list(range(1, len(whole) + 1)) and whole.x.is_monotonic_decreasing
    assert O.running(rows.limit(0), ["grp"], [F.col("x")], {"place": F.lit(1)}).count() == 0


def windows_over(df):
    """Partition keys of the plan's windows over more than a row per range."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"#\d+L?", "", w) for w in re.findall(r"Window \[.*?\], \[(.*?)\]", plan)]


@pytest.mark.parametrize("make", [
    lambda df: S.ks(df, ["x"], F.col("label") == 1), lambda df: S.auc(df, ["x"], "label"), lambda df: S.best_rule(df, ["x"], "label"),
    lambda df: E.average_precision(df, [], "x"), lambda df: E.bimodal_gap(df, ["grp"], "x"), lambda df: S.ks_matrix(df, ["x"], "grp"),
])
def test_no_window_over_a_whole_feature(values, make):
    """Every window over rows is within a range; others see a row per range and group, which an aggregate by range makes."""
    df = make(values)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for line in (x for x in plan.splitlines() if re.search(r"\bWindow \[", x)):
        by = re.search(r"\], \[([^\[\]]*)\](?:, \[.*\])?\s*$", line)
        within = "_part" in line.split("windowspecdefinition(")[1].split("ASC" if "ASC" in line else "specified")[0]
        assert within or "_s_" in line or "_end" in line, (line, by)
    assert "percentile(" not in plan


def test_rank_statistics_of_odd_groups(spark, values, many_ranges):
    p = values.toPandas().query("grp == 'hot'")
    a, b = p.x[p.label == 1].to_numpy(), p.x[p.label == 0].to_numpy()
    grid = np.unique(p.x)
    want = np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()
    got = {r.grp: r for r in S.ks(values, ["x"], F.col("label") == 1, ["grp"]).collect()}
    assert got["hot"].ks == pytest.approx(want) and (got["hot"].n_a, got["hot"].n_b) == (len(a), len(b)) and got[None].ks == 1.0
    m = {(r.a, r.b): r.ks for r in S.ks_matrix(values.withColumn("d", F.col("at") % 3), ["x"], "d").collect()}
    parts = [np.sort(values.toPandas().query("at % 3 == @k and x < 1e9").x.dropna()) for k in range(3)]
    for (i, j), k in m.items():
        grid = np.unique(np.concatenate([parts[i], parts[j]]))
        assert k == pytest.approx(np.abs(np.searchsorted(parts[i], grid, "right") / len(parts[i]) - np.searchsorted(parts[j], grid, "right") / len(parts[j])).max())
    assert len(m) == 3 and S.ks_matrix(values.where("grp = 'hot'"), ["x"], "grp").count() == 0
    order = np.argsort(-p.x.to_numpy(), kind="stable")
    y, ap = p.label.to_numpy()[order], 0.0
    s = p.x.to_numpy()[order]
    for v in np.unique(s):
        upto = y[s >= v]
        ap += (y[s == v].sum() / y.sum()) * upto.mean()
    assert E.average_precision(values.where("grp = 'hot'"), [], "x").first().ap == pytest.approx(ap)


@pytest.mark.parametrize("small", [100_000, 50, 3])
@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one"])
def test_quantiles_are_exact(spark, small, kind):
    g = np.random.default_rng(3)
    x = {"normal": g.normal(size=20_000), "ties": g.integers(0, 4, 20_000).astype(float), "wide": np.exp(g.normal(size=20_000) * 40) * g.choice([-1, 1], 20_000), "one": np.array([3.5])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double").withColumn("e", F.lit(None).cast("double")).repartition(5)
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = O.quantiles(df, ["x", "e"], at, small)
    assert got["x"] == pytest.approx(np.quantile(x, at).tolist(), rel=1e-12) and got["e"] == [None] * len(at)
    assert O.quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}


def test_fits_on_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert T.clip_fit(df, ["a", "b"], 0.0, 1.0) == {"a": (1.0, 3.0)} and T.fill_fit(df, ["a", "b"]) == {"a": 2.0, "b": 0.0} and set(T.robust_fit(df, ["a", "b"])) == {"a"}
    rows = {r.feature: r for r in S.describe(df, ["a", "b"]).collect()}
    assert (rows["a"].q50, rows["b"].q50, rows["b"]["count"]) == (2.0, None, 0)


@pytest.mark.parametrize("keep", [1, 7, 500])
def test_rolling_quantiles_share_one_stream(spark, many_ranges, keep):
    g = np.random.default_rng(6)
    x = g.normal(size=900)
    x[::50] = np.nan
    rows = [("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("b", 0, 5.0), (None, 3, None), (None, 4, 1.0)]
    df = spark.createDataFrame(rows, "k string, at int, x double").repartition(6)
    chunked = O.chunks(df, ["k"], [F.col("at")], 64, keep - 1)
    sizes = chunked.groupBy("k", "chunk").agg(F.count_if(~F.col("in_halo")).alias("own"), F.count("*").alias("n")).toPandas()
    assert (sizes.k == "a").sum() > 10 and sizes.own.max() == 64 and sizes.n.max() <= 64 + keep - 1
    out = O.rolling_quantile(df, ["k"], [F.col("at")], "x", 0.9, keep, 64).toPandas().sort_values("at")
    assert len(out) == len(rows)
    got = out[out.k == "a"]["quantile"].to_numpy()
    want = [np.nanquantile(w, 0.9) if not np.isnan(w := x[max(0, i - keep + 1) : i + 1]).all() else np.nan for i in range(len(x))]
    assert got == pytest.approx(want, nan_ok=True)
    assert out[out.k == "b"]["quantile"].tolist() == [5.0] and out[out.k.isna()]["quantile"].iloc[-1] == 1.0


def test_medians_of_groups(spark, values, many_ranges):
    got = {r.grp: r.median for r in O.medians(values.where("x < 100"), ["grp"], "x").collect()}
    p = values.toPandas().query("x < 100")
    assert got == {"hot": pytest.approx(p[p.grp == "hot"].x.median()), "small": pytest.approx(1.0), None: 1.5}


def test_dynamic_thresholds_do_not_depend_on_chunks(spark, many_ranges):
    g = np.random.default_rng(9)
    rows = []
    for b in range(60):
        n = int(g.integers(1, 40)) if b != 30 else 700
        low = g.random(n) < 0.6
        rows += [("s", b, float(v)) for v in np.where(low, g.normal(0.1, 0.02, n), g.normal(0.3 if b % 2 else 0.12, 0.02, n))]
    df = spark.createDataFrame([*rows, ("s", None, 0.5), ("s", 3, None), (None, 1, 0.1)], "k string, b int, score double").repartition(5)
    before, want = np.empty(0), []
    for b in range(60):
        x = np.sort([v for _, c, v in rows if c == b])
        t = E.gap_of(x)
        mode = "gap_batch" if t is not None else "gap_rolling"
        if t is None:
            t = E.gap_of(before)
        if t is None:
            t, mode = 0.5, "fixed"
        want.append((b, pytest.approx(min(max(t, 0.1), 0.45)), mode))
        before = np.concatenate([before, x])[-100:]
    for size in (37, 4096):
        out = E.dynamic_threshold(df, "k", "b", keep=100, size=size).orderBy("b").collect()
        assert [(r.b, r.threshold, r["mode"]) for r in out] == want
    assert {m for *_, m in want} == {"gap_batch", "gap_rolling", "fixed"}


def test_gaps_of_one_array_and_of_groups_agree(spark):
    g = np.random.default_rng(10)
    groups = {k: np.round(g.choice([g.normal(0.2, 0.03, 30), np.r_[g.normal(0.2, 0.03, 20), g.normal(0.8, 0.03, 10)]][k % 2 : k % 2 + 1][0], int(g.integers(1, 60))), 3) for k in range(30)}
    groups[30], groups[31] = np.array([0.5]), np.array([0.5] * 20)
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [(0, None), (0, float("nan"))], "k int, score double")
    got = {r.k: r.threshold for r in E.bimodal_gap(df, ["k"]).collect()}
    want = {k: E.gap_of(x) for k, x in groups.items()}
    assert {k: v for k, v in got.items() if v is not None} == {k: pytest.approx(v) for k, v in want.items() if v is not None}
    assert any(v is not None for v in want.values()) and set(got) == set(want)


def test_rolling_percentiles_of_repeated_and_missing_event_ids(spark, tmp_path):
    from groupsight.plans import catalog

    day = dt.datetime(2024, 1, 1)
    rows = [(7, 1, day, 1.0), (7, 1, day + dt.timedelta(1), 3.0), (None, 1, day + dt.timedelta(2), None), (9, None, day, float("nan"))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = catalog.queries()["w_rolling_p"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(7, 1.0, 1.0), (7, 2.8, 2.0), (None, 2.8, 2.0), (9, None, None)], key=str)


def test_nearest_profiles_of_many_targets_with_missing_numbers(spark):
    from groupsight.operators import records as R

    g = np.random.default_rng(3)
    x = np.round(g.normal(size=(900, 2)), 1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 0.0), (901, float("nan"), 0.0)]
    asked = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.round(g.normal(size=(70, 2)), 1))] + [(70, None, 0.0)]
    near = R.nearest_profiles(spark.createDataFrame(rows, "id long, a double, b double").repartition(5), spark.createDataFrame(asked, "t long, a double, b double"), "id", "t", {"a": 1.0, "b": 0.5}, 20)
    got = {r.t: (r.id, r.distance) for r in near.collect()}
    assert got.pop(70) == (0, None) and len(got) == 70
    for t, a, b in asked[:70]:
        d = np.round(np.abs(x[:, 0] - a) + 0.5 * np.abs(x[:, 1] - b), 9)
        assert got[t] == (int(d.argmin()), pytest.approx(d.min()))


def test_group_features_of_dealt_and_of_large_groups(spark, monkeypatch):
    g = np.random.default_rng(7)
    rows = [(None if k == 0 else k, round(float(x), 1), None if i % 5 == 0 else float(y)) for k, n in enumerate([300, 250, *([1, 2, 7, 30] * 10)]) for i, (x, y) in enumerate(g.normal(size=(n, 2)))]
    rows += [(99, 1.0, None)] * 60  # a large group without a value
    df = spark.createDataFrame(rows, "grp int, a double, b double")
    monkeypatch.setattr(bindings, "MANY_ROWS", 100)
    monkeypatch.setattr(G, "MANY_ROWS", 100)
    monkeypatch.setattr(bindings, "TASK_ROWS", 50)
    dealt = G.group_features(df, names=("a", "b"), percentiles=("a", "b"))
    assert dealt.rdd.getNumPartitions() >= len(rows) // 50
    mixed = G.group_features(df, names=("a", "b"), percentiles=("a", "b"), large=50)
    assert mixed.columns == dealt.columns
    whole = pd.DataFrame(rows, columns=["grp", "a", "b"]).fillna({"grp": -1})
    for got in (dealt, mixed):
        got = got.fillna({"grp": -1}).toPandas().set_index("grp")
        assert len(got) == whole.grp.nunique()
        for k, part in whole.groupby("grp"):
            assert got.chunk_n_hands[k] == len(part)
            for c in "ab":
                x = part[c].dropna().to_numpy()
                want = [x.mean(), x.std(), x.max(), *np.quantile(x, [0.1, 0.5, 0.9])] if len(x) else [np.nan] * 6
                assert got.loc[k, [f"{c}_{s}" for s in ("mean", "std", "max", "p10", "p50", "p90")]].to_numpy(float) == pytest.approx(want, abs=1e-9, nan_ok=True)
