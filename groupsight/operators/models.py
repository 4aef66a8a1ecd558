"""Models on feature tables with MLlib, and what is done with their scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupsight.functions.scalars import finite
from groupsight.operators import stats
from groupsight.session import ship_package
from groupsight.sources.store import cut, scratch

SEED = 17


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="keep").transform(df)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight: classes count alike."""
    ones, n = df.agg(F.count_if(F.col(label) == 1), F.count("*")).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, n / (2 * max(ones, 1))).otherwise(n / (2 * max(n - ones, 1))))


def classifier(kind: str, **options):
    common = {"featuresCol": "x", "labelCol": "label"}
    if kind == "forest":
        return RandomForestClassifier(**common, weightCol="weight", numTrees=options.get("trees", 20), maxDepth=options.get("depth", 5), seed=SEED)
    if kind == "boosted":
        return GBTClassifier(**common, weightCol="weight", maxIter=options.get("trees", 10), maxDepth=options.get("depth", 3), seed=SEED)
    return LogisticRegression(**common, weightCol="weight", regParam=options.get("ridge", 0.01))


def fit_score(train: DataFrame, test: DataFrame, columns: list[str], kind: str = "forest", **options) -> DataFrame:
    """test with score: P(label 1) of a classifier fitted on train with classes balanced."""
    model = classifier(kind, **options).fit(class_weights(vectors(train, columns)))
    return model.transform(vectors(test, columns)).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def domain_probe(df: DataFrame, columns: list[str], domain: str = "domain") -> DataFrame:
    """(feature, importance, auc): how well a forest tells the domains apart (one against the rest, mean AUC), by feature."""
    rows = vectors(df.withColumn("label", F.col(domain).cast("double")), columns)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=20, maxDepth=5, seed=SEED).fit(rows)
    scored = model.transform(rows).withColumn("p", vector_to_array("probability"))
    kinds = sorted(r[0] for r in df.select(domain).distinct().collect())  # domains are few
    aucs = [stats.auc(scored.withColumn("y", (F.col(domain) == k).cast("int")).withColumn("s", F.col("p")[int(k)]), ["s"], "y").first().auc for k in kinds]
    return df.sparkSession.createDataFrame([(c, float(v), float(np.mean(aucs))) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)], "feature string, importance double, auc double")


@dataclass(frozen=True)
class Fit:
    """A ridge logistic model of some features, fitted on all folds but one."""

    features: tuple[str, ...]
    out: object = None
    ridge: float = 0.01


#: Scores of a model that are put in order together; values of a task; bytes that a task sends at once; rows that ranges are laid by.
RANGE_ROWS, _TASK_VALUES, _SEND_BYTES, _EDGE_ROWS = 100_000, 4_000_000, 16_000_000, 20_000


def counted(value: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, with the sums of p and q of each."""
    order = np.argsort(value)
    value = value[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    return value[first], np.add.reduceat(p[order], first, dtype=np.int64), np.add.reduceat(q[order], first, dtype=np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each where they are small, else in eight."""
    return counts.astype(np.uint8 if counts.max() < 256 else np.int64).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else np.int64).astype(np.int64)


class Fits:
    """Many ridge logistic models of one table, classes balanced, by Newton steps that share their passes.

    A pass over the table adds up each model's loss, gradient and Hessian in every task; only these sums are shuffled, and the steps are taken on the
    driver. The number of passes is that of the slowest model (eight or so), however many models there are. Features are
    scaled by their weighted standard deviation, as the ridge counts on scaled features; constant ones weigh nothing. Rows without a label of 0 or 1, without
    a fold, or with a feature that is no number are left out.
    """

    def __init__(self, rows: DataFrame, columns: list[str], fold: str, label: str = "label"):
        self.columns = columns
        ship_package(rows.sparkSession)
        good = F.col(label).isin(0, 1) & F.col(fold).isNotNull()
        for c in columns:
            good = good & finite(F.col(c)).isNotNull()
        self.rows = rows.where(good).select(F.col(fold).alias("fold"), F.col(label).cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
        moments = [x for i in range(len(columns)) for x in (F.avg(F.col("x")[i]).alias(f"m{i}"), F.var_pop(F.col("x")[i]).alias(f"v{i}"))]
        self.groups = self.rows.groupBy("fold", "y").agg(F.count("*").alias("n"), *moments).collect()  # a row per fold and class
        self.folds = sorted({g.fold for g in self.groups})

    def _scales(self, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        """Weight of a row of class 0 and 1, and each feature's weighted standard deviation, over a model's training rows."""
        groups = [g for g in self.groups if g.fold != fit.out]
        n = np.array([sum(g.n for g in groups if g.y == k) for k in (0, 1)], float)
        weight = n.sum() / (2 * np.maximum(n, 1))
        w = np.array([g.n * weight[g.y] for g in groups])
        at = [self.columns.index(c) for c in fit.features]
        m, v = (np.array([[g[f"{k}{i}"] for i in at] for g in groups], float).reshape(len(groups), len(at)) for k in "mv")
        mean = (w[:, None] * m).sum(axis=0) / max(w.sum(), 1)
        var = (w[:, None] * (v + (m - mean) ** 2)).sum(axis=0) / max(w.sum() - 1, 1)
        return weight, np.sqrt(var)

    def fitted(self, fits: list[Fit], tol: float = 1e-9, most_passes: int = 30) -> list[np.ndarray]:
        """Coefficients (features as they are, then the constant) of each model."""
        plan, scales, place = [], {}, {c: i for i, c in enumerate(self.columns)}
        for f in fits:
            if f.out not in scales:
                weight, sd = self._scales(Fit(tuple(self.columns), f.out))
                total = sum(g.n * weight[g.y] for g in self.groups if g.fold != f.out) or 1.0
                scales[f.out] = (weight, np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0), total)
            weight, scale, total = scales[f.out]
            plan.append((np.array([place[c] for c in f.features], int), f.out, weight, scale, total))
        beta = [np.zeros(len(f.features) + 1) for f in fits]
        step, loss, open_ = [np.zeros_like(b) for b in beta], [np.inf] * len(fits), set(range(len(fits)))
        for _ in range(most_passes):
            if not open_:
                break
            tried = {k: beta[k] + step[k] for k in open_}
            sums = self._sums(plan, tried)
            for k in sorted(open_):
                d, ridge = len(tried[k]), np.append(np.full(len(tried[k]) - 1, fits[k].ridge), 0.0)
                s = sums.get(k, np.zeros(1 + d + d * d)) / plan[k][4]
                now = s[0] + (ridge * tried[k] ** 2).sum() / 2
                if now > loss[k] + 1e-12:
                    step[k] = step[k] / 2
                    if np.abs(step[k]).max() < tol:
                        open_.discard(k)
                    continue
                beta[k], loss[k] = tried[k], now
                gradient, hessian = s[1 : 1 + d] + ridge * beta[k], s[1 + d :].reshape(d, d) + np.diag(ridge + 1e-12)
                step[k] = -np.linalg.solve(hessian, gradient)
                if np.abs(step[k]).max() < tol:
                    open_.discard(k)
        return [np.append(b[:-1] * p[3][p[0]], b[-1]) for b, p in zip(beta, plan, strict=True)]

    def _sums(self, plan: list, beta: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Loss, gradient and Hessian of each model that is still open, added up over the table."""
        sent = self.rows.sparkSession.sparkContext.broadcast((plan, beta))
        starts = np.cumsum([0, *[1 + len(b) + len(b) ** 2 for b in beta.values()]])

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            plan, beta = sent.value
            out = np.zeros(starts[-1])
            for pdf in parts:
                x, y, fold = np.stack(pdf.x).T, pdf.y.to_numpy(), pdf.fold.to_numpy()
                inside = {}
                for at, (k, b) in zip(starts, beta.items(), strict=False):
                    columns, left_out, weight, scale, _ = plan[k]
                    if left_out not in inside:  # a row per feature, scaled, and one of ones
                        mine = np.flatnonzero(fold != left_out) if left_out is not None else np.arange(len(y))
                        inside[left_out] = np.vstack([x[:, mine] * scale[:, None], np.ones(len(mine))]), y[mine], weight[y[mine]]
                    features, ym, w = inside[left_out]
                    z = features[np.append(columns, -1)]
                    t = b @ z
                    e = np.exp(-np.abs(t))
                    p = np.where(t >= 0, 1.0, e) / (1 + e)
                    out[at] += w @ (np.maximum(t, 0) + np.log1p(e) - ym * t)
                    out[at + 1 : at + 1 + len(b)] += z @ (w * (p - ym))
                    out[at + 1 + len(b) : at + 1 + len(b) + len(b) ** 2] += ((z * (w * p * (1 - p))) @ z.T).ravel()
            yield pd.DataFrame({"at": np.arange(len(out)), "v": out})

        found = self.rows.mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # the models' sums
        sent.destroy()
        whole = np.zeros(starts[-1])
        whole[found["at"].to_numpy()] = found.v.to_numpy()
        return {k: whole[a:b] for k, a, b in zip(beta, starts[:-1], starts[1:], strict=True)}

    def held_out_auc(self, fits: list[Fit]) -> list[float | None]:
        """AUC of each model on the fold it was not fitted on.

        A model's scores are cut into ranges of about RANGE_ROWS. A task sends what a batch of rows has in a range as one row of packed values in order, with
        their positives and negatives; a range's are put in order together, and a row of totals per model and range gives the pairs that lie in different ranges.
        """
        place = {c: i for i, c in enumerate(self.columns)}
        models = [(np.array([place[c] for c in f.features], int), f.out, b) for f, b in zip(fits, self.fitted(fits), strict=True)]
        sizes: dict = {}
        for g in self.groups:
            sizes[g.fold] = sizes.get(g.fold, 0) + g.n
        values = sum(sizes.get(out, 0) for _, out, _ in models)
        if not values:
            return [None] * len(fits)
        sent = self.rows.sparkSession.sparkContext.broadcast((models, self._edges(models, sizes)))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            models, edges = sent.value
            ready, held = [], 0
            for pdf in parts:
                x, y, fold = np.ascontiguousarray(np.stack(pdf.x).T), pdf.y.to_numpy(), pdf.fold.to_numpy()
                inside = {out: np.flatnonzero(fold == out) for out in {m[1] for m in models}}
                inside = {out: (x[:, mine], y[mine]) for out, mine in inside.items() if len(mine)}
                for k, (columns, out, b) in enumerate(models):
                    if out not in inside:
                        continue
                    xm, ym = inside[out]
                    score = np.full(len(ym), b[-1])
                    for c, slope in zip(columns, b, strict=False):
                        score += slope * xm[c]
                    value, p, q = counted(score, ym, 1 - ym)
                    cuts = [0, *np.searchsorted(value, edges[k]), len(value)]
                    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if lo < hi:
                            ready.append((k, i, value[lo:hi].tobytes(), packed(p[lo:hi]), packed(q[lo:hi])))
                            held += 10 * (hi - lo)
                    if held > _SEND_BYTES:
                        yield pd.DataFrame(ready, columns=names)
                        ready, held = [], 0
            if ready:
                yield pd.DataFrame(ready, columns=names)

        def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            value, p, q = counted(np.concatenate([np.frombuffer(v) for v in pdf.value]), *(np.concatenate([unpacked(c, len(v) // 8) for c, v in zip(pdf[n], pdf.value, strict=True)]) for n in "pq"))
            return pd.DataFrame({"model": [key[0]], "part": [key[1]], "wins": [float((p * (np.cumsum(q) - q / 2)).sum())], "p": [float(p.sum())], "q": [float(q.sum())]})

        names = ["model", "part", "value", "p", "q"]
        rows = self.rows.mapInPandas(run, "model int, part int, value binary, p binary, q binary")
        tasks = max(self.rows.sparkSession.sparkContext.defaultParallelism, math.ceil(values / _TASK_VALUES))
        ranges = rows.repartition(tasks, "model", "part").groupBy("model", "part").applyInPandas(merged, "model int, part int, wins double, p double, q double")
        below = F.coalesce(F.sum("q").over(Window.partitionBy("model").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        total = F.sum("p") * F.sum("q")
        aucs = ranges.withColumn("wins", F.col("wins") + F.col("p") * below).groupBy("model").agg(F.when(total > 0, F.sum("wins") / total).alias("auc"))
        found = {r.model: r.auc for r in aucs.collect()}  # a row per model
        sent.destroy()
        return [found.get(k) for k in range(len(fits))]

    def _edges(self, models: list, sizes: dict) -> list[np.ndarray]:
        """What parts each model's scores into ranges: quantiles of a few rows' scores. Any edges give the same AUC."""
        most = max(sizes.values())
        if most <= RANGE_ROWS:
            return [np.empty(0)] * len(models)
        rows = self.rows.sample(min(1.0, _EDGE_ROWS / sum(sizes.values())), seed=SEED).toPandas()
        x = np.stack(rows.x) if len(rows) else np.empty((0, len(self.columns)))
        shares = {out: np.arange(1, math.ceil(n / RANGE_ROWS)) / math.ceil(n / RANGE_ROWS) for out, n in sizes.items()}
        mine = {out: x[(rows.fold == out).to_numpy()] for out in sizes}
        return [np.unique(np.quantile(mine[out][:, c] @ b[:-1] + b[-1], shares[out])) if len(mine.get(out, ())) else np.empty(0) for c, out, b in models]

    def left_out(self, sets: list[tuple[tuple[str, ...], float]]) -> list[dict]:
        """For each (features, ridge), the held-out AUC of every fold."""
        fits = [Fit(c, k, ridge) for c, ridge in sets for k in self.folds]
        aucs = self.held_out_auc(fits)
        n = len(self.folds)
        return [dict(zip(self.folds, aucs[i * n : (i + 1) * n], strict=True)) for i in range(len(sets))]


def _mean(aucs: dict) -> float | None:
    known = [a for a in aucs.values() if a is not None]
    return float(np.mean(known)) if known else None


@contextmanager
def _fits(df: DataFrame, columns: list[str], fold: str) -> Iterator[Fits]:
    """Fits over df's columns, written once, in as many files as there are cores, so that all take part in every pass."""
    with scratch(df.sparkSession):
        rows = df.select(fold, "label", *columns).repartition(df.sparkSession.sparkContext.defaultParallelism)
        yield Fits(cut(rows, "fits"), columns, fold)


def leave_one_out(df: DataFrame, columns: list[str], fold: str, kind: str = "logistic", **options) -> DataFrame:
    """(fold, auc): each fold scored by a model of the others. Logistic models of all folds are fitted in the same passes."""
    if kind == "logistic":
        with _fits(df, columns, fold) as fits:
            found = fits.left_out([(tuple(columns), options.get("ridge", 0.01))])[0]
        return df.sparkSession.createDataFrame(list(found.items()), f"{fold} {dict(df.dtypes)[fold]}, auc double")
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):  # folds are dates or domains
        one = fit_score(df.where(F.col(fold) != k), df.where(F.col(fold) == k), columns, kind, **options)
        one = stats.auc(one, ["score"], "label", [fold]).select(fold, "auc")
        out = one if out is None else out.union(one)
    return out


def clusters(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """df with cluster by k-means."""
    return KMeans(featuresCol="x", predictionCol="cluster", k=k, seed=SEED).fit(vectors(df, columns)).transform(vectors(df, columns)).drop("x")


def choose_k(df: DataFrame, columns: list[str], ks: list[int]) -> DataFrame:
    """(k, cost, silhouette) of k-means."""
    rows, out = vectors(df, columns).persist(), []
    for k in ks:
        model = KMeans(featuresCol="x", k=k, seed=SEED).fit(rows)
        out.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator(featuresCol="x").evaluate(model.transform(rows)))))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, cost double, silhouette double")


def soft_clusters(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """df with cluster and its membership probability, by a Gaussian mixture."""
    out = GaussianMixture(featuresCol="x", k=k, seed=SEED).fit(vectors(df, columns)).transform(vectors(df, columns))
    return out.withColumn("cluster_probability", F.array_max(vector_to_array("probability"))).withColumnRenamed("prediction", "cluster").drop("x", "probability")


def embed(df: DataFrame, key: str, columns: list[str], layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(key, embedding): a forward pass through dense layers with frozen weights, ReLU between them."""
    sent = df.sparkSession.sparkContext.broadcast(layers)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = pdf[columns].to_numpy(float)
            for i, (w, b) in enumerate(sent.value):
                x = x @ w + b
                x = np.maximum(x, 0) if i + 1 < len(sent.value) else x
            yield pd.DataFrame({key: pdf[key], "embedding": list(x)})

    return df.select(key, *columns).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")


def calibrate(scored: DataFrame, method: str = "sigmoid") -> DataFrame:
    """scored with calibrated: score through a logistic or isotonic fit to the labels."""
    rows = VectorAssembler(inputCols=["score"], outputCol="x").transform(scored.withColumn("label", F.col("label").cast("double")))
    if method == "isotonic":
        return IsotonicRegression(featuresCol="x", labelCol="label", predictionCol="calibrated").fit(rows).transform(rows).drop("x")
    out = LogisticRegression(featuresCol="x", labelCol="label").fit(rows).transform(rows)
    return out.withColumn("calibrated", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def grid(df: DataFrame, columns: list[str], fold: str, options: list[dict], kind: str = "logistic") -> DataFrame:
    """(trial, worst, mean) of leave_one_out() per parameter set, best first: worst fold, then mean.

    Logistic models of all trials and folds share their passes; trees are grown one trial after the other.
    """
    if kind == "logistic":
        with _fits(df, columns, fold) as fits:
            trials = fits.left_out([(tuple(columns), o.get("ridge", 0.01)) for o in options])
    else:
        trials = [{r[0]: r.auc for r in leave_one_out(df, columns, fold, kind, **o).collect()} for o in options]  # a row per fold
    rows = [(i, min((a for a in t.values() if a is not None), default=None), _mean(t)) for i, t in enumerate(trials)]
    rows.sort(key=lambda r: (-(r[1] if r[1] is not None else -1), -(r[2] if r[2] is not None else -1), r[0]))
    return df.sparkSession.createDataFrame(rows, "trial int, worst double, mean double")


def forward_selection(df: DataFrame, columns: list[str], fold: str, least_gain: float = 0.002, most: int = 4, worst: bool = False) -> list[tuple[str, float]]:
    """Features one by one by mean (worst: least) leave-one-out AUC, until the gain is small; ties by name. A round fits all its candidates in the same passes."""
    chosen, best = [], 0.5
    with _fits(df, columns, fold) as fits:
        while len(chosen) < most:
            left = sorted(set(columns) - {c for c, _ in chosen})
            tried = fits.left_out([((*[x for x, _ in chosen], c), 0.01) for c in left])
            value = [(min((a for a in t.values() if a is not None), default=None) if worst else _mean(t)) for t in tried]
            k = max((i for i, v in enumerate(value) if v is not None), key=lambda i: value[i], default=None)
            if k is None or value[k] < best + least_gain:
                break
            best = value[k]
            chosen.append((left[k], best))
    return chosen


def pair_rescue(df: DataFrame, columns: list[str], fold: str, least_gain: float | None = None) -> DataFrame:
    """(a, b, pair_auc, gain): pairs of features against the better of the two alone; with least_gain, the pairs that gain as much. All are fitted in the same passes."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    with _fits(df, columns, fold) as fits:
        value = [_mean(t) for t in fits.left_out([(x, 0.01) for x in [*((c,) for c in columns), *pairs]])]
    single = dict(zip(columns, value, strict=False))
    rows = [(a, b, p, p - max(single[a], single[b])) for (a, b), p in zip(pairs, value[len(columns) :], strict=True) if None not in (p, single[a], single[b])]
    return df.sparkSession.createDataFrame([r for r in rows if least_gain is None or r[3] >= least_gain], "a string, b string, pair_auc double, gain double")
