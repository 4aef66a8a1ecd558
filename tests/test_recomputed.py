"""Queries that SQL cannot express, against a numpy or plain-Python computation of the same result."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groupsight.functions.scalars import SIZE_BUCKETS
from groupsight.operators import clean as C
from groupsight.operators import evaluate as E
from groupsight.operators import models as M
from groupsight.plans import catalog
from groupsight.sources.bindings import order_events, table, vector_features, vector_scores

FS = [f"f{i}" for i in range(64)]


def run(name, spark, d):
    return catalog.queries()[name](spark, d).toPandas()


@pytest.fixture(scope="module")
def vec(spark, tiny):
    return vector_features(spark, tiny).toPandas().sort_values("id").reset_index(drop=True)


@pytest.fixture(scope="module")
def scores(spark, tiny):
    return vector_scores(spark, tiny).toPandas()


def auc(score, label):
    """Share of pairs in order, ties half."""
    p, q = np.asarray(score)[np.asarray(label) == 1], np.asarray(score)[np.asarray(label) == 0]
    return ((p[:, None] > q[None, :]).sum() + 0.5 * (p[:, None] == q[None, :]).sum()) / (len(p) * len(q))


def logistic(x, y, w, ridge):
    """Weighted ridge logistic regression on standardised features, as P(1) of a function of x."""
    sd = np.sqrt(np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w) * w.sum() / (w.sum() - 1))
    z = np.column_stack([x / sd, np.ones(len(x))])
    b, pen = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (w * (p - y)) / w.sum() + pen @ b
        h = (z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + pen
        b -= np.linalg.solve(h, g)
    return lambda q: 1 / (1 + np.exp(-np.column_stack([q / sd, np.ones(len(q))]) @ b))


def balanced(y):
    return np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))


def test_logistic_scores_and_what_is_made_of_them(spark, tiny, vec):
    train = vec[vec.id % 5 != 0]
    model = logistic(train[FS].to_numpy(), train.label.to_numpy(), balanced(train.label.to_numpy()), 0.01)
    got = run("m_lr", spark, tiny).sort_values("id")
    assert got.score.to_numpy() == pytest.approx(model(vec[vec.id % 5 == 0][FS].to_numpy()), abs=2e-3)
    by = vec.assign(score=model(vec[FS].to_numpy())).groupby("domain").score
    for r in run("m_score", spark, tiny).itertuples():
        assert (r.mean, r.p90, r.n) == (pytest.approx(by.mean()[r.domain], abs=2e-3), pytest.approx(by.quantile(0.9)[r.domain], abs=4e-3), by.count()[r.domain])


def test_leave_one_domain_out(spark, tiny, vec):
    for r in run("m_lodo", spark, tiny).itertuples():
        a, b = vec[vec.domain != r.domain], vec[vec.domain == r.domain]
        model = logistic(a[FS].to_numpy(), a.label.to_numpy(), balanced(a.label.to_numpy()), 0.01)
        assert r.auc == pytest.approx(auc(model(b[FS].to_numpy()), b.label), abs=0.02)


def left_out_auc(vec, features, ridge=0.01):
    out = []
    for k in range(3):
        a, b = vec[vec.domain != k], vec[vec.domain == k]
        model = logistic(a[features].to_numpy(), a.label.to_numpy(), balanced(a.label.to_numpy()), ridge)
        out.append(auc(model(b[features].to_numpy()), b.label))
    return out


def test_grid_forward_and_pairs_by_separate_fits(spark, tiny):
    whole = vector_features(spark, tiny, 64).toPandas()
    every = [f"f{i}" for i in range(64)]
    trials = [left_out_auc(whole, every, r) for r in (0.001, 0.01, 0.1, 1.0)]
    got = run("m_grid", spark, tiny)
    for r in got.itertuples():
        assert (r.worst, r.mean) == (pytest.approx(min(trials[r.trial]), abs=1e-6), pytest.approx(np.mean(trials[r.trial]), abs=1e-6))
    assert got.trial.tolist() == sorted(range(4), key=lambda i: (-min(trials[i]), -np.mean(trials[i]), i))
    chosen, best = [], 0.5
    for name, value in run("m_forward", spark, tiny).itertuples(index=False):
        tried = {c: np.mean(left_out_auc(whole, [*chosen, c])) for c in every if c not in chosen}
        c = max(sorted(tried), key=tried.get)
        assert (name, value) == (c, pytest.approx(tried[c], abs=1e-9)) and tried[c] >= best + 0.002
        chosen.append(c)
        best = tried[c]
    pairs = run("m_pair", spark, tiny)
    assert len(pairs) == 64 * 63 // 2
    for r in pairs.sample(25, random_state=1).itertuples():
        p = np.mean(left_out_auc(whole, [r.a, r.b]))
        assert (r.pair_auc, r.gain) == (pytest.approx(p, abs=1e-6), pytest.approx(p - max(np.mean(left_out_auc(whole, [x])) for x in (r.a, r.b)), abs=1e-6))


def test_passes_do_not_grow_with_models(spark, tiny, monkeypatch):
    passes = []
    sums = M.Fits._sums
    monkeypatch.setattr(M.Fits, "_sums", lambda self, plan, beta: (passes.append(len(beta)), sums(self, plan, beta))[1])
    rows = vector_features(spark, tiny)
    M.leave_one_out(rows, FS[:1], "domain").count()
    few = len(passes)
    M.pair_rescue(rows, FS[:8], "domain").count()
    assert len(passes) - few <= few + 4 and max(passes) == 3 * (8 + 28)
    odd = rows.select("domain", F.when(F.col("id") % 2 == 0, 1).alias("label"), F.lit(1.0).alias("f0"), F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("f1")).alias("f1"))
    assert M.leave_one_out(odd, ["f0", "f1"], "domain").count() == 3 and M.leave_one_out(odd.limit(0), ["f0"], "domain").count() == 0


def test_forests_and_boosting_give_probabilities_with_an_auc(spark, tiny):
    for name in ("m_rf", "m_gbt"):
        out = run(name, spark, tiny)
        assert len(out) and out.score.between(0, 1).all()
    rf = run("m_rf", spark, tiny)
    assert run("m_model_auc", spark, tiny).auc[0] == pytest.approx(auc(rf.score, rf.label))


def test_clusters_are_nearest_centres(spark, tiny, vec):
    out = M.clusters(vector_features(spark, tiny), FS, 3).select("id", "cluster").toPandas().sort_values("id").cluster.to_numpy()
    x = vec[FS].to_numpy()
    centres = np.array([x[out == k].mean(axis=0) for k in range(3)])
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (near.argmin(axis=1) == out).mean() > 0.97
    sizes = {r.cluster: (r.n, r.positive_share) for r in run("m_kmeans", spark, tiny).itertuples()}
    assert sizes == {k: ((out == k).sum(), pytest.approx(vec.label[out == k].mean())) for k in range(3)}
    costs = run("m_silhouette", spark, tiny).set_index("k")
    assert costs.cost[3] == pytest.approx(((x - np.array([x[out == k].mean(axis=0) for k in range(3)])[out]) ** 2).sum(), rel=0.02) and costs.silhouette.between(-1, 1).all()
    soft = run("m_gmm", spark, tiny)
    assert len(soft) == len(vec) and soft.cluster_probability.between(1 / 3, 1).all() and soft.cluster.isin([0, 1, 2]).all()


def test_dense_forward_pass(spark, tiny, vec):
    g = np.random.default_rng(1)
    a, b = g.normal(size=(64, 6)), g.normal(size=(6, 3))
    out = run("m_embed", spark, tiny).sort_values("id")
    assert np.stack(out.embedding) == pytest.approx(np.maximum(vec[FS].to_numpy() @ a, 0) @ b)


def test_isotonic_and_sigmoid_calibration(spark, tiny, scores):
    out = run("t_calibrate", spark, tiny).merge(scores[["id", "label"]], on="id").sort_values("score")
    means = out.groupby("score").label.agg(["mean", "size"])
    blocks = []  # pools of adjacent violators: value, weight, scores
    for v, n in means.itertuples(index=False):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y, m, k = blocks.pop()
            x = blocks[-1]
            blocks[-1] = [(x[0] * x[1] + y * m) / (x[1] + m), x[1] + m, x[2] + k]
    want = dict(zip(means.index, np.repeat([b[0] for b in blocks], [b[2] for b in blocks]), strict=True))
    assert out.calibrated.to_numpy() == pytest.approx(out.score.map(want).to_numpy(), abs=1e-6)
    soft = run("t_calibrate_sigmoid", spark, tiny).merge(scores[["id", "label"]], on="id")
    model = logistic(soft[["score"]].to_numpy(), soft.label.to_numpy(), np.ones(len(soft)), 0.0)
    assert soft.calibrated.to_numpy() == pytest.approx(model(soft[["score"]].to_numpy()), abs=1e-3)


def test_dynamic_thresholds_by_hand(spark, tiny, scores):
    def gap(x):
        x = np.sort(x)
        if len(x) < 10:
            return None
        d = np.diff(x)
        k = int(np.argmax(d))
        fits = d[k] > 0.02 and d[k] > 3 * max(np.median(d), 1e-6) and min(k + 1, len(x) - k - 1) >= max(1, int(0.05 * len(x)))
        return (x[k] + x[k + 1]) / 2 if fits else None

    got = {(r.scorer, r.cycle): (r.threshold, r.mode) for r in run("e_dynamic", spark, tiny).itertuples()}
    for scorer, rows in scores.groupby("scorer"):
        before = np.empty(0)
        for cycle, part in rows.groupby("cycle"):
            x, mode = gap(part.score.to_numpy()), "gap_batch"
            if x is None:
                x, mode = gap(before), "gap_rolling"
            if x is None:
                x, mode = 0.5, "fixed"
            assert got.pop((scorer, cycle)) == (pytest.approx(min(max(x, 0.1), 0.45), abs=1e-6), mode)
            before = np.concatenate([before, np.sort(part.score.to_numpy())])[-500:]
    assert not got


def test_mixture_threshold_is_where_the_components_cross(spark, tiny, scores):
    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(0.2, 0.05, 3000), g.normal(0.8, 0.1, 1500)])
    got = E.mixture_threshold(spark.createDataFrame([(float(v),) for v in x], "score double"))
    grid = np.linspace(0.2, 0.8, 6001)
    a, b = 2 / 3 * np.exp(-(((grid - 0.2) / 0.05) ** 2) / 2) / 0.05, 1 / 3 * np.exp(-(((grid - 0.8) / 0.1) ** 2) / 2) / 0.1
    assert got == pytest.approx(grid[np.abs(np.log(a) - np.log(b)).argmin()], abs=0.02)
    assert E.mixture_threshold(spark.createDataFrame([(0.5,), (0.5,), (None,)], "score double")) is None
    out = run("e_mixture", spark, tiny)
    assert out.n[0] == len(scores) and scores.score.min() < out.threshold[0] < scores.score.max()


def test_uncorrelated_choices_by_hand(spark, tiny, vec):
    x = vec.assign(twice=2 * vec.f0)
    r = np.abs(np.corrcoef(x[[*FS, "twice"]].to_numpy().T))
    kept = []
    for i, f in enumerate([*FS, "twice"]):
        if all(r[i, j] < 0.95 for j in kept):
            kept.append(i)
    assert set(run("s_prefilter", spark, tiny).feature) == {[*FS, "twice"][i] for i in kept} and 64 not in kept
    places = run("s_diverse", spark, tiny).sort_values("place").feature.tolist()
    at = [FS.index(f) for f in places]
    assert all(r[a, b] < 0.3 for i, a in enumerate(at) for b in at[:i]) and places


def test_streams_give_what_batches_give(spark, tiny):
    stream = run("z_stream_tumbling", spark, tiny)
    batch = run("z_tumbling", spark, tiny)
    stream = stream.assign(start=stream.start.dt.strftime("%Y-%m-%d %H:%M:%S"))
    both = stream.merge(batch, on=["start", "event_type"], suffixes=("", "_b"))
    assert len(both) == len(stream) > 0 and (both.n == both.n_b).all() and both["mean"].to_numpy() == pytest.approx(both.mean_b.to_numpy(), abs=1e-6)
    # what is left out are the last windows, which the watermark has not passed
    assert set(batch.start) - set(stream.start) == set(sorted(set(batch.start))[-len(set(batch.start) - set(stream.start)) :])


def test_hashed_and_private_columns(spark, tiny, vec):
    out = run("p_hash_cols", spark, tiny)
    names = {"h_" + hashlib.sha256(f"salt{c}".encode()).hexdigest()[:16]: c for c in vec.columns if c not in ("id", "label")}
    assert set(out.columns) == set(names) | {"id", "label"}
    out = out.sort_values("id").rename(columns=names).reset_index(drop=True)
    assert (out[FS].to_numpy() == vec[FS].to_numpy()).all()
    kept = catalog.queries()["p_strip"](spark, tiny).schema.simpleString()
    assert "l_suppkey" not in kept and "o_custkey" not in kept and "l_partkey" in kept


def test_samples_of_events_by_hand(spark, tiny):
    events = order_events(spark, tiny).toPandas()
    out = run("p_sample", spark, tiny)
    assert set(out.sess) == set(events.sess)
    sizes = events.groupby("sess").size()
    for sess, rows in list(out.groupby("sess"))[:200]:
        mine = events[events.sess == sess].sort_values("ord")
        want = 5 + int(hashlib.sha256(f"view|{sess}".encode()).hexdigest()[:2], 16) % 4
        if sizes[sess] == 1:
            assert len(rows) == 12
            continue
        assert len(rows) == min(want, len(mine)) and {mine.ord.min(), mine.ord.max()} <= set(rows.ord) and rows.sort_values("pos").ord.is_monotonic_increasing


def test_draws_and_shares(spark, tiny):
    out, people = run("u_replace", spark, tiny), table(spark, tiny, "customer").count()
    assert len(out) == people and out.draw.nunique() == people
    packs = run("u_pack_ranges", spark, tiny)
    assert packs.c_custkey.nunique() == people and packs.groupby("pack").size().max() <= 40
    assert catalog.queries()["j_shared_cols"](spark, tiny).columns == sorted({"id", "domain", "label", *FS} - {"f3"})
    assert catalog.queries()["p_align"](spark, tiny).agg(F.count("*")).first()[0] > 0


def coarse(value, *seed):
    """Nearest size bucket, moved by a noise from the seed's hash."""
    v = max(0.0, value or 0.0)
    i = min(range(len(SIZE_BUCKETS)), key=lambda k: (abs(SIZE_BUCKETS[k] - v), k))
    b = SIZE_BUCKETS[i]
    noise = int(hashlib.sha256("|".join(seed).encode()).hexdigest()[2:4], 16) / 255 * 2 - 1
    spread = 0.08 if b <= 1.5 else 0.22 if b <= 8 else max(0.35, b * 0.05)
    return 0.0 if v <= 0 else max(0.0, min(SIZE_BUCKETS[-1], b + noise * spread))


def test_canonical_view_by_hand(spark, tiny):
    events = order_events(spark, tiny)
    seen = C.sample_events(C.collapse_noops(events.where(~F.col("type").isin("small_blind", "big_blind", "ante"))), "view").toPandas()
    got = run("p_canonical", spark, tiny)
    assert len(got) == len(seen) and set(got.columns) == {"grp", "sess", "pos", "stage", "type", "actor", "amount", "total"}
    by = {(r.sess, r.pos): r for r in got.itertuples()}
    for sess, part in seen.groupby("sess"):
        alias = {}
        for r in part.sort_values("pos").itertuples():
            if not np.isnan(r.actor):
                alias.setdefault(r.actor, len(alias) + 1)
            g = by[sess, r.pos]
            assert (g.stage, g.type, g.actor) == (r.stage, r.type, 0 if np.isnan(r.actor) else alias[r.actor])
            for name in ("amount", "total"):
                assert getattr(g, name) == pytest.approx(coarse(getattr(r, name) / 2, str(sess), str(r.pos), name), abs=0.0051)


def test_domain_probe_by_its_own_forest(spark, tiny):
    from pyspark.ml.classification import RandomForestClassifier

    rows = M.vectors(vector_features(spark, tiny).withColumn("label", F.col("domain").cast("double")), FS)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=20, maxDepth=5, seed=M.SEED).fit(rows)
    p = model.transform(rows).select("domain", "probability").toPandas()
    want = np.mean([auc(np.array([v[k] for v in p.probability]), (p.domain == k).astype(int)) for k in range(3)])
    got = run("m_domain", spark, tiny)
    assert got.auc.to_numpy() == pytest.approx(np.full(len(FS), want)) and got.importance.sum() == pytest.approx(1)
    assert dict(zip(got.feature, got.importance, strict=True)) == pytest.approx(dict(zip(FS, model.featureImportances.toArray(), strict=True)))


def test_held_out_auc_over_many_ranges(spark, monkeypatch):
    g = np.random.default_rng(5)
    rows = [(i % 4, 1 if i % 4 == 3 else int(x > 0), round(float(x + g.normal()), 1), float(x * x + g.normal()), 1.0) for i, x in enumerate(g.normal(size=1200))]
    whole = pd.DataFrame(rows, columns=["fold", "label", "f0", "f1", "f2"])
    monkeypatch.setattr(M, "RANGE_ROWS", 40)
    models = [M.Fit(c, k) for c in (("f0",), ("f0", "f1"), ("f2",)) for k in range(4)]
    with M._fits(spark.createDataFrame(whole).repartition(3), ["f0", "f1", "f2"], "fold") as fits:
        got, found = fits.held_out_auc(models), fits.fitted(models)
        edges = fits._edges([([fits.columns.index(c) for c in f.features], f.out, b) for f, b in zip(models, found, strict=True)], {k: 300 for k in range(4)})
    assert [len(e) for e in edges] == [7] * 8 + [1] * 4
    for f, b, a in zip(models, found, got, strict=True):
        part = whole[whole.fold == f.out]
        score = b[-1] + sum(s * part[c] for c, s in zip(f.features, b, strict=False))
        p, q = score[part.label == 1].to_numpy()[:, None], score[part.label == 0].to_numpy()[None]
        assert a is None if f.out == 3 else a == pytest.approx(((p > q) + 0.5 * (p == q)).mean(), abs=1e-9)
