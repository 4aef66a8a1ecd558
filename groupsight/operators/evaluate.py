"""Scores against labels: confusion, ranking metrics, thresholds, rewards, weights.

Ranking metrics and threshold grids first count positives and negatives per distinct score, so what
is looked at in order has a row per score value, not per prediction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupsight.functions.scalars import clamp, finite
from groupsight.operators.ordered import medians, running
from groupsight.session import ship_package

DOWN = Window.unboundedPreceding


def confusion(df: DataFrame, by: list[str], predicted: Column, label: str = "label") -> DataFrame:
    """(by, tn, fp, fn, tp, accuracy, precision, recall, f1, fpr); ratios with nothing below are 0."""
    y = F.col(label) == 1
    n = {"tn": ~predicted & ~y, "fp": predicted & ~y, "fn": ~predicted & y, "tp": predicted & y}
    c = df.groupBy(*by).agg(*[F.count_if(x).alias(k) for k, x in n.items()])
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return c.withColumns({
        "accuracy": safe(tp + tn, tn + fp + fn + tp), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn), "fpr": safe(fp, fp + tn),
    })


def score_counts(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(by, score, p, q): positives and negatives per distinct score."""
    return df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))


def average_precision(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(by, ap): sum of precision times the step in recall, one step per distinct score; 0 without positives."""
    c = running(score_counts(df, by, score, label), by, [F.desc(score)], {"cp": F.col("p"), "cq": F.col("q")})
    step = F.col("p") * F.col("cp") / (F.col("cp") + F.col("cq"))
    return c.groupBy(*by).agg(F.coalesce(F.sum(step) / F.nullif(F.sum("p"), F.lit(0)), F.lit(0.0)).alias("ap"))


def reward(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(by, fpr, recall, ap, penalty, base, reward): 0 where a tenth or more of the negatives are hit. A score of 0.5 rounds to 0."""
    c = confusion(df, by, F.bround(score, 0) >= 1, label).select(*by, "fpr", "recall")
    j = c.join(average_precision(df, by, score, label), by) if by else c.join(average_precision(df, by, score, label), F.lit(True))
    penalty = F.when(F.col("fpr") >= 0.10, 0.0).otherwise(F.pow(F.greatest(F.lit(0.0), 1 - F.col("fpr")), F.lit(2)))
    j = j.withColumn("penalty", penalty).withColumn("base", 0.65 * F.col("ap") + 0.35 * F.col("recall"))
    return j.withColumn("reward", F.col("base") * F.col("penalty"))


def probability_metrics(df: DataFrame, by: list[str], score: str = "score", label: str = "label", eps: float = 1e-15) -> DataFrame:
    """(by, log_loss, brier)."""
    p, y = clamp(F.col(score), eps, 1 - eps), F.col(label)
    return df.groupBy(*by).agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg(F.pow(F.col(score) - y, F.lit(2))).alias("brier"))


def at_thresholds(df: DataFrame, grid: list[float], by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """(by, t, tp, fp, pos, neg, recall, fpr): predictions at or above each threshold of a fixed grid.

    Each distinct score is placed at its largest threshold below, counts are summed per threshold, then added up downwards.
    """
    by = by or []
    ts = F.array(*[F.lit(float(t)) for t in sorted(grid)])
    place = F.size(F.filter(ts, lambda t: t <= F.col(score)))
    c = score_counts(df, by, score, label).withColumn("place", place).groupBy(*by, "place").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    whole = c.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    cells = whole.select("*", F.posexplode(ts).alias("i", "t")).withColumn("place", F.col("i") + 1)  # the grid per group
    j = cells.join(c, [*by, "place"], "left")
    upward = Window.partitionBy(*by).orderBy(F.desc("place")).rowsBetween(DOWN, 0)
    j = j.withColumn("tp", F.coalesce(F.sum("p").over(upward), F.lit(0))).withColumn("fp", F.coalesce(F.sum("q").over(upward), F.lit(0)))
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return j.select(*by, "t", "tp", "fp", "pos", "neg", rate("tp", "pos").alias("recall"), rate("fp", "neg").alias("fpr"))


def pick(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order. Without groups the rows are few: a grid."""
    window = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def best_under_cap(curve: DataFrame, cap: float, by: list[str] | None = None) -> DataFrame:
    """Largest recall with fpr within the cap; ties to the threshold closest to 0.5, then the lower."""
    return pick(curve.where(F.col("fpr") <= cap), by or [], F.desc("recall"), F.abs(F.col("t") - 0.5), F.col("t"))


def youden(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Largest recall - fpr; ties to the higher threshold."""
    return pick(curve, by or [], F.desc(F.round(F.col("recall") - F.col("fpr"), 12)), F.desc("t"))


def recall_at_cap(curve: DataFrame, cap: float, by: list[str] | None = None) -> DataFrame:
    """Within the cap by recall, then lower fpr, then nearness to 0.5; where no threshold is within it, lowest fpr first."""
    ok = F.col("fpr") <= cap
    near = F.abs(F.col("t") - 0.5)
    return pick(curve.withColumn("feasible", ok), by or [], F.desc("feasible"), F.when(ok, -F.col("recall")).otherwise(F.col("fpr")), F.when(ok, F.col("fpr")).otherwise(-F.col("recall")), near, "t")


def two_parts(n, low, max_gap, median_gap, min_scores: int = 10, gap_ratio: float = 3.0, min_gap: float = 0.02, min_share: float = 0.05):
    """Whether the largest gap of n scores, `low` of them below it, makes two clear parts. For columns and for numbers."""
    wide = (max_gap > min_gap) & (max_gap > gap_ratio * median_gap) & (max_gap > gap_ratio * 1e-6)
    # a part has a row at least, and the whole number of rows in its least share
    return (n >= min_scores) & wide & (low >= 1) & (low > n * min_share - 1) & (n - low >= 1) & (n - low > n * min_share - 1)


def bimodal_gap(df: DataFrame, by: list[str], score: str = "score", **peaks) -> DataFrame:
    """(by, n, max_gap, median_gap, threshold): the middle of the largest gap between neighbouring scores (of equal ones the lowest), NULL unless two_parts().

    Missing scores do not count. Neighbours and the median come from running sums over ranges, so a large group is shared by tasks.
    """
    near = running(df.where(finite(F.col(score)).isNotNull()).select(*by, score), by, [F.col(score)], {"_k": F.lit(1)}, previous=score)
    gaps = near.withColumn("_gap", F.col(score) - F.col(f"previous_{score}"))
    top = F.max_by(F.struct(F.col(f"previous_{score}").alias("a"), F.col(score).alias("b"), (F.col("_k") - 1).alias("low")), F.struct("_gap", -F.col("_k")))
    g = gaps.groupBy(*by).agg(F.count("*").alias("n"), F.max("_gap").alias("max_gap"), top.alias("_top"))
    middle = medians(gaps, by, "_gap").select("median", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
    met = F.lit(True)
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    g = g.join(middle, met, "left").withColumnRenamed("median", "median_gap")
    ok = two_parts(F.col("n"), F.col("_top.low"), F.col("max_gap"), F.col("median_gap"), **peaks)
    return g.select(*by, "n", "max_gap", "median_gap", F.when(ok, (F.col("_top.a") + F.col("_top.b")) / 2).alias("threshold"))


def gap_of(scores: np.ndarray, **peaks) -> float | None:
    """bimodal_gap() of one array."""
    x = np.sort(scores[np.isfinite(scores)])
    if len(x) < 2:
        return None
    gaps = np.diff(x)
    low = int(gaps.argmax()) + 1
    return float(x[low - 1 : low + 1].mean()) if two_parts(len(x), low, gaps.max(), np.median(gaps), **peaks) else None


def chosen_threshold(batch: float | None, before: np.ndarray, static: float | None, fixed: float, low: float, high: float, peaks: dict) -> tuple[float, str]:
    """Threshold and mode: the gap of the batch, else that of the scores before it, else static, else fixed; clamped."""
    found, mode = batch, "gap_batch"
    if found is None:
        found, mode = gap_of(before, **peaks), "gap_rolling"
    if found is None:
        found, mode = (fixed, "fixed") if static is None else (static, "static")
    return min(max(found, low), high), mode


def dynamic_threshold(
    df: DataFrame, stream: str, batch: str, score: str = "score", keep: int = 500, static: float | None = None, fixed: float = 0.5, low: float = 0.1, high: float = 0.45,
    size: int = 4096, peaks: dict | None = None,
) -> DataFrame:
    """(stream, batch, threshold, mode): gap in the batch, else in the last `keep` scores before it, else static, else fixed; clamped. peaks: options of two_parts().

    A batch is cut down to its last scores, `keep` at most, in order of score. A stream's batches are worked on in chunks that begin every
    `size` scores, each with the batches that the `keep` scores before it come from, so one long stream is shared by many tasks.
    Rows without stream, batch or score do not count.
    """
    ship_package(df.sparkSession)
    peaks, kinds = peaks or {}, dict(df.dtypes)
    rows = df.where(F.col(stream).isNotNull() & F.col(batch).isNotNull() & finite(F.col(score)).isNotNull()).select(stream, batch, score)
    placed = running(rows, [stream], [F.col(batch), F.col(score)], {"_k": F.lit(1)}).drop("_k_total")
    per = placed.groupBy(stream, batch).agg((F.min("_k") - 1).alias("_before"), F.max("_k").alias("_end"))
    tails = placed.join(per, [stream, batch]).where(F.col("_k") > F.col("_end") - keep).groupBy(stream, batch).agg(
        F.first("_before").alias("_before"), F.first("_end").alias("_end"), F.sort_array(F.collect_list(score)).alias("_tail")
    )
    found = bimodal_gap(rows, [stream, batch], score, **peaks).select(stream, batch, F.col("threshold").alias("_found"))
    chunk = lambda c: F.floor(c / size)
    ahead = F.sequence(chunk(F.col("_end")), chunk(F.col("_end") + keep - 1))
    met = tails.join(found, [stream, batch]).withColumn("_own", chunk(F.col("_before"))).withColumn("_chunk", F.explode(F.array_union(F.array("_own"), ahead)))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_before")
        before, out = np.empty(0), []
        for s, b, found, tail, held in zip(pdf[stream], pdf[batch], pdf["_found"], pdf["_tail"], pdf["_own"] == pdf["_chunk"], strict=True):
            if held:
                out.append((s, b, *chosen_threshold(None if pd.isna(found) else found, before, static, fixed, low, high, peaks)))
            before = np.concatenate([before, tail])[-keep:]
        return pd.DataFrame(out, columns=[stream, batch, "threshold", "mode"])

    return met.groupBy(stream, "_chunk").applyInPandas(decide, f"{stream} {kinds[stream]}, {batch} {kinds[batch]}, threshold double, mode string")


def answers(given: DataFrame, expected: DataFrame, scorers: DataFrame, scorer: str, cycle: str, position: str, wanted: str = "expected") -> tuple[DataFrame, DataFrame]:
    """What scorers gave in cycles: (the rows of given within each cycle's expected number, (scorer, cycle, coverage)).

    Positions count from 0; those beyond the expected number are cut off. Each scorer has a coverage for each cycle, 0 where nothing came or nothing was expected.
    """
    kept = given.join(expected.select(cycle, wanted), cycle).where(F.col(position) < F.col(wanted)).drop(wanted)
    came = kept.groupBy(scorer, cycle).agg(F.count("*").alias("_n"))
    asked = scorers.select(scorer).distinct().join(expected.select(cycle, wanted), F.lit(True))  # the cycles' list of who was asked
    coverage = F.coalesce(F.col("_n") / F.nullif(F.col(wanted), F.lit(0)), F.lit(0.0))
    return kept, asked.join(came, [scorer, cycle], "left").select(scorer, cycle, coverage.alias("coverage"))


def windowed_reward(df: DataFrame, scorer: str, order: list[str], n: int = 40, responses: DataFrame | None = None, cycle: str = "cycle") -> DataFrame:
    """(scorer, fpr, recall, ap, penalty, base, reward, samples[, coverage, latency]) over each scorer's last n predictions; with fewer, fpr is 1 and all others 0.

    responses: (scorer, cycle, coverage, latency), whose last n rows, and last n known latencies, are averaged; scorers that only they name have
    no prediction. Only a scorer's last n rows of a task are shuffled.
    """
    last = lambda rows, keys: rows.withColumn("_place", F.row_number().over(Window.partitionBy(scorer).orderBy(*[F.desc(c) for c in keys]))).where(F.col("_place") <= n).drop("_place")
    recent = last(df, order)
    out = reward(recent, [scorer]).join(recent.groupBy(scorer).agg(F.count("*").alias("samples")), scorer)
    if responses is not None:
        met = last(responses, [cycle]).groupBy(scorer).agg(F.avg("coverage").alias("coverage"))
        slow = last(responses.where(F.col("latency").isNotNull()), [cycle]).groupBy(scorer).agg(F.avg("latency").alias("latency"))
        out = out.join(met.join(slow, scorer, "left"), scorer, "full").withColumns({"samples": F.coalesce("samples", F.lit(0)), "coverage": F.coalesce("coverage", F.lit(0.0))})
    full = F.col("samples") >= n
    worst = {"fpr": 1.0, "recall": 0.0, "ap": 0.0, "penalty": 0.0, "base": 0.0, "reward": 0.0}
    return out.select(scorer, *[F.when(full, F.col(k)).otherwise(w).alias(k) for k, w in worst.items()], "samples", *(["coverage", "latency"] if responses is not None else []))


def podium(rewards: DataFrame, scorer: str, shares: tuple[float, ...] = (0.5, 0.3, 0.2), reserve: float = 0.97) -> DataFrame:
    """(scorer, weight): the top positive rewards share what the reserve (scorer 0) leaves; everything is the reserve's without a positive one. A row per scorer on the podium."""
    top = rewards.where(F.col("reward") > 0).orderBy(F.desc("reward"), scorer).limit(len(shares))
    placed = top.withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("reward"), scorer)))
    w = placed.select(F.col(scorer).cast("long").alias(scorer), ((1 - reserve) * F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("_place"))).alias("weight"))
    rest = placed.agg(F.count("*").alias("n")).select(F.lit(0).cast("long").alias(scorer), F.when(F.col("n") > 0, reserve).otherwise(1.0).alias("weight"))
    return rest.union(w)


def normalized_weights(df: DataFrame, weight: str = "weight", top: int = 65535) -> DataFrame:
    """df with share and units: NaN and negative weights are 0, shares sum to 1."""
    clean = F.greatest(F.lit(0.0), F.when(F.col(weight).isNotNull() & ~F.isnan(weight), F.col(weight)).otherwise(0.0))
    total = df.agg(F.sum(clean).alias("_total"))
    share = F.coalesce(clean / F.nullif(F.col("_total"), F.lit(0.0)), F.lit(0.0))
    return df.join(F.broadcast(total), F.lit(True)).withColumn("share", share).withColumn("units", F.bround(F.col("share") * top, 0).cast("long")).drop("_total")


def ema_scores(rewards: DataFrame, scorer: str, cycle: str, cycles: tuple[int, int] | None = None, alpha: float = 0.1) -> DataFrame:
    """(scorer, ema): alpha * reward + (1 - alpha) * before, over every cycle of the range (default: all there are); an absent reward is 0.

    A reward of cycle c weighs alpha * (1 - alpha) ** (last - c), so no grid of cycles and scorers is made.
    """
    rows = rewards.where(F.col(cycle).between(*cycles)) if cycles else rewards
    end = F.broadcast(rows.agg((F.lit(cycles[1]) if cycles else F.max(cycle)).alias("_last")))  # one row
    weight = alpha * F.pow(F.lit(1 - alpha), F.col("_last") - F.col(cycle))
    return rows.join(end, F.lit(True)).groupBy(scorer).agg(F.sum(F.col("reward") * weight).alias("ema"))


def threshold_methods(df: DataFrame, by: list[str], score: str = "score", fixed: float = 0.5) -> DataFrame:
    """(by, passive, hybrid): the batch median; the gap where there is one, else the mean of median and fixed. Missing scores do not count; no task holds a group."""
    rows = df.where(finite(F.col(score)).isNotNull())
    med = medians(rows, by, score).select(F.col("median").alias("passive"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
    met = F.lit(True)
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return bimodal_gap(rows, by, score).join(med, met).select(*by, "passive", F.coalesce("threshold", (F.col("passive") + fixed) / 2).alias("hybrid"))


def mixture_threshold(df: DataFrame, score: str = "score", rounds: int = 100, seed: int = 7) -> float | None:
    """Where the two normal components that fit a table's scores cross, between their means; None without two different scores."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = df.where(finite(F.col(score)).isNotNull()).select(F.col(score).cast("double").alias("x"))
    if rows.agg(F.max("x") > F.min("x")).first()[0] is not True:
        return None
    fitted = GaussianMixture(k=2, maxIter=rounds, seed=seed, featuresCol="v").fit(VectorAssembler(inputCols=["x"], outputCol="v").transform(rows))
    (w1, m1, v1), (w2, m2, v2) = sorted(((w, g.mean[0], g.cov[0, 0]) for w, g in zip(fitted.weights, fitted.gaussians, strict=True)), key=lambda t: t[1])
    # log densities are parabolas: their difference vanishes where the components cross
    a, b = 1 / v2 - 1 / v1, 2 * (m1 / v1 - m2 / v2)
    c = m2**2 / v2 - m1**2 / v1 + np.log(v2 / v1) + 2 * np.log(w1 / w2)
    roots = [x.real for x in np.roots([a, b, c]) if abs(x.imag) < 1e-9]
    between = [x for x in roots if m1 <= x <= m2]
    return float(between[0] if between else (m1 + m2) / 2)
