"""Statistics, drift and quality of feature tables.

Moments come from one aggregate with a group per feature, quantiles from exact selection in several passes. Rank statistics (KS,
AUC, best rule) first reduce each feature to a row per distinct value, and then look along the values
by running sums over ranges of them, so no task holds a feature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupsight.functions.scalars import EPS, finite
from groupsight.operators.ordered import quantiles, running
from groupsight.session import ship_package


def long_form(df: DataFrame, columns: list[str], keep: list[str], missing: bool = False) -> DataFrame:
    """(keep, feature, value) of all finite values; with missing, of all cells, others being NULL."""
    rows = df.select(*keep, *[finite(F.col(c)).alias(c) for c in columns]).unpivot(keep, columns, "feature", "value")
    return rows if missing else rows.where("value IS NOT NULL")


def every_feature(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, at most one per feature, with a row of NULLs for each of the columns that has none."""
    return rows.sparkSession.createDataFrame([(c,) for c in columns], "feature string").join(rows, "feature", "left")


def from_wide(row: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """(feature, names): one row of columns named feature__name turned into a row per feature."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{n}").cast("double").alias(n) for n in names]) for c in columns])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def _with_quantiles(df: DataFrame, found: dict[str, list], names: list[str]) -> DataFrame:
    """df, a row per feature, with the features' quantiles under names."""
    rows = df.sparkSession.createDataFrame([(c, *map(_number, q)) for c, q in found.items()], "feature string, " + ", ".join(f"{n} double" for n in names))
    return df.join(F.broadcast(rows), "feature", "left")  # a row per feature


def _number(x) -> float | None:
    return None if x is None else float(x)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, count, missing, mean, std, min, q25, q50, q75, max), exact."""
    v = F.col("value").cast("double")
    one = {"count": F.count(v).cast("double"), "missing": 1 - F.count(v) / F.count("*"), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}
    moments = long_form(df, columns, [], missing=True).groupBy("feature").agg(*[x.alias(n) for n, x in one.items()])
    out = _with_quantiles(every_feature(moments, columns), quantiles(df, columns, [0.25, 0.5, 0.75]), ["q25", "q50", "q75"])
    return out.select("feature", F.coalesce("count", F.lit(0.0)).alias("count"), "missing", "mean", "std", "min", "q25", "q50", "q75", "max")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std, p10, p50, p90), exact, population std; features without a value are left out."""
    moments = long_form(df, columns, []).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return _with_quantiles(moments, quantiles(df, columns, [0.1, 0.5, 0.9]), ["p10", "p50", "p90"])


def feature_report(df: DataFrame, columns: list[str], near: float = 1e-8) -> DataFrame:
    """(feature, n_missing, n_finite, n_unique, std, min, max, constant, near_constant); std is 0 for a single value."""
    aggs = []
    for c in columns:
        v = finite(F.col(c))
        one = {"n_missing": F.count("*") - F.count(v), "n_finite": F.count(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}
        aggs += [x.alias(f"{c}__{n}") for n, x in one.items()]
    out = from_wide(df.agg(*aggs), columns, ["n_missing", "n_finite", "std", "min", "max"])
    # distinct values are counted in long form: one aggregate over all features, not a copy of the rows for each
    values = long_form(df, columns, []).groupBy("feature", "value").agg(F.lit(1).alias("_one")).groupBy("feature").agg(F.count("*").cast("double").alias("_u"))
    out = out.join(values, "feature", "left").select("feature", "n_missing", "n_finite", F.coalesce("_u", F.lit(0.0)).alias("n_unique"), "std", "min", "max")
    return out.withColumn("constant", F.col("n_unique") <= 1).withColumn("near_constant", F.coalesce(F.col("std") < near, F.lit(True)))


def duplicate_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(feature, same_as): columns equal to an earlier one in every row, NULL equal to NULL.

    Candidates share a fingerprint of (row, value) pairs; they alone are compared value by value.
    """
    prints = df.agg(*[F.sum(F.xxhash64(key, c).cast("decimal(20,0)")).alias(c) for c in columns]).first()
    first: dict = {}
    pairs = [(c, first.setdefault(prints[c], c)) for c in columns]
    pairs = [(c, f) for c, f in pairs if c != f]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature string, same_as string")
    equal = df.agg(*[F.bool_and(F.col(c).eqNullSafe(F.col(f))).alias(c) for c, f in pairs]).first()
    return df.sparkSession.createDataFrame([(c, f) for c, f in pairs if equal[c]] or [], "feature string, same_as string")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r over the rows that have both, as an aggregate; NULL where either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlations(df: DataFrame, columns: list[str], least_rows: int = 50) -> DataFrame:
    """(a, b, r, n) of all pairs of columns, over the rows where both are numbers; r is NULL below least_rows and where either is constant (to 1 in 1e13) over those rows.

    The sums of all pairs come from one pass: a task multiplies its batches' matrices, less the columns' means, and sends a row per pair.
    """
    ship_package(df.sparkSession)
    k = len(columns)
    rows = df.select(*[finite(F.col(c)).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    means = np.array([0.0 if m is None else m for m in rows.agg(*[F.avg(f"x{i}") for i in range(k)]).first()]) if k else np.empty(0)
    i, j = np.triu_indices(k, 1)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, one, two, both = (np.zeros((k, k)) for _ in range(4))
        for pdf in parts:
            x = pdf.to_numpy(float) - means
            known = np.isfinite(x).astype(float)
            x[known == 0] = 0
            n += known.T @ known
            one += x.T @ known
            two += (x * x).T @ known
            both += x.T @ x
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j].astype(np.int64), "sa": one[i, j], "sb": one[j, i], "saa": two[i, j], "sbb": two[j, i], "sab": both[i, j]})

    names = ("n", "sa", "sb", "saa", "sbb", "sab")
    found = rows.mapInPandas(sums, "i long, j long, n long, " + ", ".join(f"{x} double" for x in names[1:])).groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in names])
    pairs = df.sparkSession.range(k * k).select(F.floor(F.col("id") / max(k, 1)).alias("i"), (F.col("id") % max(k, 1)).alias("j")).where("i < j")
    t = pairs.join(found, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    spread = lambda x: F.when(F.col(f"s{x}{x}") - F.pow(F.col(f"s{x}"), 2) / F.col("n") > 1e-13 * F.col(f"s{x}{x}"), F.col(f"s{x}{x}") - F.pow(F.col(f"s{x}"), 2) / F.col("n"))
    r = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(spread("a") * spread("b"))
    name = lambda at: F.element_at(F.array(*[F.lit(c) for c in columns]), (F.col(at) + 1).cast("int"))
    return t.select(name("i").alias("a"), name("j").alias("b"), F.when((F.col("n") >= least_rows) & (F.col("n") > 0), r).alias("r"), "n")


def ks(df: DataFrame, columns: list[str], side: Column, by: list[str] | None = None) -> DataFrame:
    """(by, feature, ks, n_a, n_b): two-sample Kolmogorov-Smirnov distance between rows where side is true and false."""
    by = by or []
    rows = long_form(df.withColumn("_side", side), columns, [*by, "_side"])
    counts = rows.groupBy(*by, "feature", "value").agg(F.count_if("_side").alias("a"), F.count_if(~F.col("_side")).alias("b"))
    steps = running(counts, [*by, "feature"], [F.col("value")], {"ca": F.col("a"), "cb": F.col("b")}).where("ca_total > 0 AND cb_total > 0")
    return steps.groupBy(*by, "feature").agg(
        F.max(F.abs(F.col("ca") / F.col("ca_total") - F.col("cb") / F.col("cb_total"))).alias("ks"), F.first("ca_total").alias("n_a"), F.first("cb_total").alias("n_b")
    )


def ks_matrix(df: DataFrame, columns: list[str], domain: str, strong: float = 0.5, moderate: float = 0.3) -> DataFrame:
    """(a, b, feature, ks, kind): Kolmogorov-Smirnov distance of each two domains, a before b, from one table of counts.

    The table is read once: each distinct value holds its counts in all domains, whose running sums are the domains' step functions; all pairs' largest
    differences come from the same rows. Domains are few (a column each); rows without one are left out.
    """
    names = sorted(r[0] for r in df.select(domain).where(F.col(domain).isNotNull()).distinct().collect())  # a row per domain
    rows = long_form(df.where(F.col(domain).isNotNull()), columns, [domain])
    counts = rows.groupBy("feature", "value").agg(*[F.count_if(F.col(domain) == d).alias(f"n{i}") for i, d in enumerate(names)])
    steps = running(counts, ["feature"], [F.col("value")], {f"c{i}": F.col(f"n{i}") for i in range(len(names))})
    share = [F.col(f"c{i}") / F.nullif(F.col(f"c{i}_total"), F.lit(0)) for i in range(len(names))]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    wide = steps.groupBy("feature").agg(F.lit(0).alias("_"), *[F.max(F.abs(share[i] - share[j])).alias(f"p{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"p{i}_{j}").alias("ks")) for i, j in pairs]
    if not cells:
        return wide.where("false").select(F.lit(None).cast(dict(df.dtypes)[domain]).alias("a"), F.lit(None).cast(dict(df.dtypes)[domain]).alias("b"), "feature", F.lit(0.0).alias("ks"), F.lit("").alias("kind"))
    out = wide.select("feature", F.explode(F.array(*cells)).alias("x")).where("x.ks IS NOT NULL")
    kind = F.when(F.col("x.ks") >= strong, "strong").when(F.col("x.ks") >= moderate, "moderate").otherwise("weak")
    return out.select("x.a", "x.b", "feature", "x.ks", kind.alias("kind"))


def ks_pvalue(d: Column, n_a: Column, n_b: Column, terms: int = 50) -> Column:
    """Asymptotic two-sided p-value, by the Kolmogorov series."""
    x = F.sqrt(n_a * n_b / (n_a + n_b)) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def anova(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, f, df_between, df_within, n): one-way F over the classes; NULL without spread within."""
    per = long_form(df, columns, [label]).groupBy("feature", label).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    whole = per.groupBy("feature").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.count("*").alias("k"))
    j = per.join(whole, "feature").groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.first("total").alias("n"), F.first("k").alias("k"))
    f = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return j.select("feature", F.when((F.col("within") > 0) & (F.col("k") > 1), f).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), "n")


def _beta_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) by the continued fraction of the incomplete beta function."""
    if f is None or not f >= 0 or d1 <= 0 or d2 <= 0:
        return float("nan")
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    c, d = 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    value = front * h / a
    return 1 - value if swap else value


@F.pandas_udf(T.DoubleType())
def _beta_tails(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([_beta_tail(*x) for x in zip(f, d1, d2, strict=True)])


def anova_pvalue(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    """P(F > f); used on a row per feature."""
    ship_package(SparkSession.getActiveSession())
    return _beta_tails(f, d1, d2)


def multiple_tests(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """df (a row per feature) with Benjamini-Hochberg p_fdr_bh and the flags for it, for Bonferroni and for p itself."""
    every = Window.partitionBy()
    ranked = df.withColumn("_rank", F.row_number().over(Window.orderBy(p, "feature"))).withColumn("_n", F.count(p).over(every))
    least = F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(Window.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))
    out = ranked.withColumn("p_fdr_bh", F.least(F.lit(1.0), least))
    return out.withColumns({"sig_fdr": F.col("p_fdr_bh") < alpha, "sig_bonferroni": F.col(p) < alpha / F.col("_n"), "sig_p": F.col(p) < alpha}).drop("_rank", "_n")


def min_max(c: Column, default: float = 0.0) -> Column:
    every = Window.partitionBy()
    low, high = F.min(c).over(every), F.max(c).over(every)
    return F.when(high > low, (c - low) / (high - low)).otherwise(default)


def composite_scores(signal: DataFrame, shift: DataFrame) -> DataFrame:
    """(feature, task_score, shift_score, keep_score) from F statistics and KS distances, a row per feature."""
    j = signal.join(shift.select("feature", "ks"), "feature", "left").withColumn("shift_score", F.coalesce("ks", F.lit(0.0)))
    j = j.withColumn("task_score", min_max(F.log1p("f")))
    return j.select("feature", "task_score", "shift_score", (0.65 * F.col("task_score") + 0.35 * (1 - F.col("shift_score"))).alias("keep_score"))


def cohen_d(df: DataFrame, columns: list[str], domain: str) -> DataFrame:
    """(feature, max_d, mean_range): largest standardised difference between two domains' means, and the means' range."""
    per = long_form(df, columns, [domain]).groupBy("feature", domain).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    a, b = per.alias("a"), per.alias("b")
    pairs = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col(f"a.{domain}") < F.col(f"b.{domain}")))
    pooled = F.sqrt(((F.col("a.n") - 1) * F.col("a.v") + (F.col("b.n") - 1) * F.col("b.v")) / (F.col("a.n") + F.col("b.n") - 2))
    d = pairs.select(F.col("a.feature").alias("feature"), (F.abs(F.col("a.m") - F.col("b.m")) / F.nullif(pooled, F.lit(0.0))).alias("d"))
    return d.groupBy("feature").agg(F.max("d").alias("max_d")).join(per.groupBy("feature").agg((F.max("m") - F.min("m")).alias("mean_range")), "feature")


def auc(df: DataFrame, columns: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """(by, feature, auc): chance that a positive's value exceeds a negative's, ties half."""
    by = by or []
    return auc_of_counts(long_form(df, columns, [*by, label]).groupBy(*by, "feature", "value").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")), [*by, "feature"])


def auc_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc) from rows (by, value, p, q): positives and negatives at each distinct value."""
    wins = running(counts, by, [F.col("value")], {"upto": F.col("q")}).withColumn("w", F.col("p") * (F.col("upto") - F.col("q") / 2))
    total = F.sum("p").cast("double") * F.sum("q")
    return wins.groupBy(*by).agg(F.when(total > 0, F.sum("w") / total).alias("auc"))


def feature_ranking(df: DataFrame, columns: list[str], label: str, side: Column) -> DataFrame:
    """(feature, auc_strength, ks, abs_corr, rank_score): what tells the label, less what moves between the sides."""
    strength = auc(df, columns, label).select("feature", (2 * F.abs(F.col("auc") - 0.5)).alias("auc_strength"))
    r = from_wide(df.agg(*[correlation(F.col(c), F.col(label).cast("double")).alias(f"{c}__r") for c in columns]), columns, ["r"])
    j = strength.join(ks(df, columns, side).select("feature", "ks"), "feature", "left").join(r.select("feature", F.abs("r").alias("abs_corr")), "feature", "left")
    return j.withColumn("rank_score", 0.5 * F.col("auc_strength") + 0.3 * F.coalesce("abs_corr", F.lit(0.0)) - 0.2 * F.coalesce("ks", F.lit(0.0)))


def stability(train: DataFrame, other: DataFrame, columns: list[str], limit: float = 0.5) -> DataFrame:
    """(feature, shift, verdict): |difference of means| over the training std."""
    stat = lambda df, x: long_form(df, columns, []).groupBy("feature").agg(F.avg("value").alias(f"m_{x}"), F.stddev_samp("value").alias(f"s_{x}"))
    j = stat(train, "a").join(stat(other, "b"), "feature")
    shift = F.abs(F.col("m_a") - F.col("m_b")) / F.greatest(F.col("s_a"), F.lit(EPS))
    return j.select("feature", shift.alias("shift"), F.when(shift <= limit, "stable").otherwise("unstable").alias("verdict"))


def best_rule(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, threshold, above, accuracy): the best cut of each feature; ties to the lower threshold, then 'above'."""
    counts = long_form(df, columns, [label]).groupBy("feature", "value").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    c = running(counts, ["feature"], [F.col("value")], {"cp": F.col("p"), "cq": F.col("q")})
    high = (F.col("cq") + F.col("cp_total") - F.col("cp")) / (F.col("cp_total") + F.col("cq_total"))
    both = F.array(F.struct(high.alias("acc"), (-F.col("value")).alias("t"), F.lit(True).alias("above")), F.struct((1 - high).alias("acc"), (-F.col("value")).alias("t"), F.lit(False).alias("above")))
    best = c.select("feature", F.explode(both).alias("x")).groupBy("feature").agg(F.max("x").alias("x"))
    return best.select("feature", (-F.col("x.t")).alias("threshold"), F.col("x.above").alias("above"), F.col("x.acc").alias("accuracy"))


def greedy_uncorrelated(ranked: list[str], pairs: DataFrame, limit: float) -> list[str]:
    """Features in order, each kept unless it correlates above the limit with one kept before; pairs has a row per pair of features."""
    close = {(r.a, r.b) for r in pairs.where(F.abs("r") > limit).collect()}
    kept: list[str] = []
    for f in ranked:
        if not any((f, k) in close or (k, f) in close for k in kept):
            kept.append(f)
    return kept


def fingerprint(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample std of each feature."""
    row = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}__m"), F.stddev_samp(c).alias(f"{c}__s"))]).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in columns}


def fingerprint_distance(target: dict[str, tuple[float, float]], weights: dict[str, float]) -> Column:
    """Weighted root mean square z-score of a row against a fingerprint."""
    parts = [F.lit(w) * F.pow((F.col(c) - target[c][0]) / max(target[c][1], EPS), F.lit(2)) for c, w in weights.items()]
    return F.sqrt(sum(parts[1:], parts[0]) / sum(weights.values()))
