"""Fit / apply transforms of feature tables. fit() returns a small dict of numbers; apply() is one projection.

Quantiles are exact and found in several passes over the table (see ordered.quantiles), so a table that is dear to make is written first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupsight.functions.scalars import finite
from groupsight.operators.ordered import quantiles
from groupsight.sources.store import sized


def clip_fit(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> dict[str, tuple[float, float]]:
    return {c: tuple(v) for c, v in quantiles(df, columns, [low, high]).items() if v[0] is not None}


def clip_apply(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(a), F.least(F.lit(b), F.col(c)))) for c, (a, b) in bounds.items()})


def log1p_fit(df: DataFrame, columns: list[str], pattern: str = ".*", least: float = -1e-9) -> list[str]:
    """Columns whose name fits and whose smallest value is not below `least`."""
    mins = df.agg(*[F.min(finite(F.col(c))).alias(c) for c in columns]).first()
    return [c for c in columns if re.fullmatch(pattern, c) and mins[c] is not None and mins[c] >= least]


def log1p_of(c: Column, mode: str = "signed") -> Column:
    """clamp: log1p of max(x, 0); signed: log1p of |x| with the sign of x."""
    return F.log1p(F.greatest(c, F.lit(0.0))) if mode == "clamp" else F.sign(c) * F.log1p(F.abs(c))


def log1p_apply(df: DataFrame, columns: list[str], mode: str = "signed") -> DataFrame:
    return df.withColumns({c: log1p_of(F.col(c), mode) for c in columns})


def robust_fit(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range; a range of 0 counts as 1."""
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    return {c: (m, (b - a) or 1.0) for c, (a, m, b) in q.items() if m is not None}


def robust_apply(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / iqr for c, (m, iqr) in stats.items()})


def abs_clip(df: DataFrame, columns: list[str], limit: float) -> DataFrame:
    return clip_apply(df, dict.fromkeys(columns, (-limit, limit)))


def fill_fit(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {c: v[0] if v[0] is not None else 0.0 for c, v in quantiles(df, columns, [0.5]).items()}


def fill_apply(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(v)) for c, v in fills.items()})


def pipeline_fit(train: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, pattern: str = ".*", mode: str = "signed", limit: float = 10.0) -> dict:
    """clip, log1p, robust scaling, absolute clip and fill, each fitted on what the one before gives on the training table."""
    out = {"clip": clip_fit(train, columns, low, high), "mode": mode, "limit": limit}
    train = clip_apply(train, out["clip"])
    out["log1p"] = log1p_fit(train, columns, pattern)
    train = log1p_apply(train, out["log1p"], mode)
    out["robust"] = robust_fit(train, columns)
    train = abs_clip(robust_apply(train, out["robust"]), columns, limit)
    out["fill"] = fill_fit(train, columns)
    return out


def pipeline_apply(df: DataFrame, model: dict) -> DataFrame:
    df = log1p_apply(clip_apply(df, model["clip"]), model["log1p"], model["mode"])
    return fill_apply(abs_clip(robust_apply(df, model["robust"]), list(model["robust"]), model["limit"]), model["fill"])


def group_zscore(df: DataFrame, train: DataFrame, bucket: Column, columns: list[str], min_rows: int = 30) -> DataFrame:
    """columns as z-scores within their bucket; buckets of fewer than min_rows training rows use all rows' mean and std."""
    stats = [x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"))]
    per = train.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.count("*").alias("_n"), *stats).where(F.col("_n") >= min_rows)
    whole = train.agg(*stats).first()
    j = df.withColumn("_bucket", bucket).join(sized(per, "buckets"), "_bucket", "left")
    z = {}
    for c in columns:
        mean, std = F.coalesce(F.col(f"{c}_m"), F.lit(whole[f"{c}_m"])), F.coalesce(F.col(f"{c}_s"), F.lit(whole[f"{c}_s"]))
        z[c] = (F.col(c) - mean) / F.when(std < 1e-8, 1.0).otherwise(std)
    return j.withColumns(z).select(*df.columns)


def standardize(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population std, std below 1e-8 as 1."""
    row = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]).first()
    return df.withColumns({c: (F.col(c) - row[f"{c}_m"]) / (row[f"{c}_s"] if row[f"{c}_s"] >= 1e-8 else 1.0) for c in columns})
