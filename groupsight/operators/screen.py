"""Verdicts on features, rows, groups and scorers: what to keep, what to watch, how distributions compare."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupsight.functions.scalars import clamp
from groupsight.operators.stats import correlation, long_form
from groupsight.sources.store import sized
from groupsight.operators.ordered import quantiles


def select_features(scores: DataFrame, most_shift: float = 0.2, blind: tuple[float, float] = (0.45, 0.55)) -> DataFrame:
    """(feature, verdict) from rows (feature, ks, auc): drop what shifts, watch what tells nothing, keep the rest."""
    verdict = F.when(F.col("ks") >= most_shift, "drop").when(F.col("auc").between(*blind), "watch").otherwise("keep")
    return scores.select("feature", verdict.alias("verdict"))


def recommend(scores: DataFrame, shift_at: float = 0.75, signal_at: float = 0.5) -> DataFrame:
    """(feature, kind) from rows (feature, ks, auc): high or low shift, strong or weak signal, against quantiles over the features."""
    rows = scores.select("feature", "ks", F.abs(F.col("auc") - 0.5).alias("_s"))
    limits = rows.agg(F.percentile("ks", F.lit(shift_at)).alias("_hk"), F.percentile("_s", F.lit(signal_at)).alias("_hs"))  # one row
    kind = F.concat(F.when(F.col("ks") >= F.col("_hk"), "high").otherwise("low"), F.lit("_shift_"), F.when(F.col("_s") >= F.col("_hs"), "strong").otherwise("weak"))
    return rows.join(F.broadcast(limits), F.lit(True)).select("feature", kind.alias("kind"))


def row_health(df: DataFrame, key: str, columns: list[str], tiny: float = 1e-12) -> DataFrame:
    """(key, null_share, active, l2): of a row's features, the share missing, how many are not zero, and their length."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    length = F.sqrt(F.aggregate(known, F.lit(0.0), lambda s, x: s + x * x))
    return df.select(key, (1 - F.size(known) / len(columns)).alias("null_share"), F.size(F.filter(known, lambda x: F.abs(x) > tiny)).alias("active"), length.alias("l2"))


def qc_tiers(df: DataFrame, key: str, columns: list[str], reference: Column, soft: float = 0.9, hard: float = 0.99) -> DataFrame:
    """(key, tier, reasons): hard or soft by the features that lie over the reference rows' quantiles, which are the reasons; else clean."""
    marks = {c: q if q[0] is not None else [float("inf")] * 2 for c, q in quantiles(df.where(reference), columns, [soft, hard]).items()}
    over = lambda k: F.filter(F.array(*[F.when(F.col(c) > marks[c][k], c) for c in columns]), lambda x: x.isNotNull())
    tier = F.when(F.size(over(1)) > 0, "hard").when(F.size(over(0)) > 0, "soft").otherwise("clean")
    return df.select(key, tier.alias("tier"), F.when(F.size(over(1)) > 0, over(1)).otherwise(over(0)).alias("reasons"))


def direction_check(df: DataFrame, columns: list[str], domain: str, label: str, pair: tuple[int, int], least: float = 0.1) -> DataFrame:
    """(feature, a, b, verdict): class effects in two domains, in standard deviations; rejected if their signs differ, weak if either is small."""
    mean = lambda k: F.avg(F.when(F.col(label) == k, F.col("value")))
    rows = long_form(df.where(F.col(domain).isin(*pair)), columns, [domain, label])
    e = rows.groupBy("feature").pivot(domain, list(pair)).agg((mean(1) - mean(0)) / F.stddev_samp("value")).toDF("feature", "a", "b")
    verdict = F.when(F.sign("a") != F.sign("b"), "rejected").when(F.least(F.abs("a"), F.abs("b")) < least, "weak").otherwise("robust")
    return e.withColumn("verdict", verdict)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n): equal bins 1 to `bins` from low to high; 0 below and bins + 1 from high on."""
    width = (high - low) / bins
    at = F.when(F.col(column) < low, 0).when(F.col(column) >= high, bins + 1).otherwise(F.floor((F.col(column) - low) / width) + 1)
    return df.where(F.col(column).isNotNull()).groupBy(*(by or []), at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def ecdf(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, bin, share) of a histogram: rows at or below each bin. There is a row per bin."""
    over = Window.partitionBy(*(by or [F.lit(1)]))
    return counts.select(*(by or []), "bin", (F.sum("n").over(over.orderBy("bin")) / F.sum("n").over(over)).alias("share"))


def qq(df: DataFrame, columns: list[str], side: Column, points: list[float]) -> DataFrame:
    """(feature, p, a, b): exact quantiles of the rows of one side and of the other."""
    a, b = (quantiles(df.where(F.coalesce(x, F.lit(False))), columns, points) for x in (side, ~side))
    rows = [(c, p, *(None if x[c][k] is None else float(x[c][k]) for x in (a, b))) for c in columns for k, p in enumerate(points) if a[c][k] is not None or b[c][k] is not None]
    return df.sparkSession.createDataFrame(rows, "feature string, p double, a double, b double")


def score_bands(df: DataFrame, by: list[str], score: str, low: float, high: float) -> DataFrame:
    """(by, mean, median, p10, p90, share_high, share_low)."""
    q = F.percentile(score, F.array(*[F.lit(p) for p in (0.1, 0.5, 0.9)]))  # a bounded group's scores
    share = lambda c: F.avg(c.cast("int"))
    return df.groupBy(*by).agg(F.avg(score).alias("mean"), q[1].alias("median"), q[0].alias("p10"), q[2].alias("p90"), share(F.col(score) > high).alias("share_high"), share(F.col(score) < low).alias("share_low"))


def scorer_agreement(df: DataFrame, scorers: list[str]) -> DataFrame:
    """(a, b, corr, mean_abs_difference) of each two score columns."""
    pairs = list(combinations(scorers, 2))
    row = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (correlation(F.col(a), F.col(b)).alias(f"c{i}"), F.avg(F.abs(F.col(a) - F.col(b))).alias(f"d{i}"))])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"), F.col(f"d{i}").alias("mean_abs_difference")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def pseudo_labels(df: DataFrame, members: list[Column], high: float = 0.8, low: float = 0.2, most_gap: float = 0.1) -> DataFrame:
    """df with mean, label and weight: the label that all members of an ensemble are sure of, weighted by how sure; NULL and 0 elsewhere."""
    mean, gap = F.round(sum(members, F.lit(0.0)) / len(members), 9), F.greatest(*members) - F.least(*members) if len(members) > 1 else F.lit(0.0)
    label = F.when((mean >= high) & (gap < most_gap), 1).when((mean <= low) & (gap < most_gap), 0)
    return df.withColumns({"mean": mean, "label": label, "weight": F.when(label.isNotNull(), clamp(F.abs(mean - 0.5) * 2)).otherwise(0.0)})


def cluster_labels(df: DataFrame, cluster: str, probability: str, label: str, least: float = 0.55, weight: float = 0.15, noise: int | None = None) -> DataFrame:
    """df's sure rows with label, that of most of their cluster's labelled rows, and sample_weight: weight times the membership.

    Rows of the noise cluster, and of clusters without a labelled row, have none.
    """
    rows = df if noise is None else df.where(F.col(cluster) != noise)
    major = rows.groupBy(cluster).agg((F.avg(label) >= 0.5).cast("int").alias("_major")).where("_major IS NOT NULL")  # a row per cluster
    sure = rows.where(F.col(probability) >= least).drop(label)
    return sure.join(sized(major, "clusters"), cluster).withColumnRenamed("_major", label).withColumn("sample_weight", weight * F.col(probability))


def cluster_majority(df: DataFrame, cluster: str, label: str, noise: int) -> DataFrame:
    """(coverage, noise_share, accuracy, balanced_accuracy): every row outside noise takes its cluster's majority label."""
    rows = df.withColumn("_in", F.col(cluster) != noise)
    major = rows.where("_in").groupBy(cluster).agg((F.avg(label) >= 0.5).cast("int").alias("_major"))  # a row per cluster
    hit = (F.col("_major") == F.col(label)).cast("int")
    each = [F.avg(F.when(F.col("_in") & (F.col(label) == k), hit)) for k in (0, 1)]
    return rows.join(sized(major, "clusters"), cluster, "left").agg(
        F.avg(F.col("_in").cast("int")).alias("coverage"), F.avg((~F.col("_in")).cast("int")).alias("noise_share"),
        F.avg(F.when(F.col("_in"), hit)).alias("accuracy"), ((each[0] + each[1]) / 2).alias("balanced_accuracy"),
    )


def load_state(df: DataFrame, key: str, value: str, order: list[Column], last: int = 50, high: float = 400.0, extreme: float = 450.0) -> DataFrame:
    """(key, p95, state) of each key's last values: the value at place floor(0.95 (n - 1)) of their order. Only those are ever gathered."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    kept = df.withColumn("_rank", rank).where(F.col("_rank") <= last).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    p95 = F.element_at("_v", (F.floor(0.95 * (F.size("_v") - 1)) + 1).cast("int"))
    return kept.select(key, p95.alias("p95"), F.when(p95 > extreme, "extreme").when(p95 > high, "high").otherwise("normal").alias("state"))


def violation_counts(df: DataFrame, key: str, reason: str, cycle: str, limit: int = 3) -> DataFrame:
    """(key, reason, n, latest, status): open up to `limit` violations of a reason, then suspended."""
    out = df.groupBy(key, reason).agg(F.count("*").alias("n"), F.max(cycle).alias("latest"))
    return out.withColumn("status", F.when(F.col("n") > limit, "suspended").otherwise("open"))


def leaderboard(rewards: DataFrame, names: DataFrame, scorer: str, metrics: DataFrame | None = None) -> DataFrame:
    """rewards with place (ties by scorer), the names' columns and the metrics', where there are any. A row per scorer."""
    out = rewards.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("reward"), scorer)))
    for other in (names, metrics):
        out = out if other is None else out.join(other, scorer, "left")
    return out
