"""Reports on scores, profiles, trials and scorers: small tables that say what to do next.

A report has a row per feature, segment, trial or scorer; what is counted over rows of predictions or events is aggregated first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupsight.functions.scalars import EPS, finite
from groupsight.operators.ordered import quantiles
from groupsight.operators.stats import correlation, every_feature, from_wide, ks, long_form


def score_summary(df: DataFrame, segment: str, score: str = "score", points: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """(segment, n, mean, low, high, q): exact quantiles of the scores of each of a few segments, q an array in the order of points."""
    rows = df.where(finite(F.col(score)).isNotNull() & F.col(segment).isNotNull())
    whole = rows.groupBy(segment).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"))
    names = [r[0] for r in rows.select(segment).distinct().collect()]  # a row per segment
    if not names:
        return whole.withColumn("q", F.array().cast("array<double>"))
    wide = rows.select(*[F.when(F.col(segment) == s, F.col(score).cast("double")).alias(f"s{i}") for i, s in enumerate(names)])
    found = quantiles(wide, wide.columns, list(points))
    q = df.sparkSession.createDataFrame([(s, [float(x) for x in found[f"s{i}"]]) for i, s in enumerate(names)], f"{segment} {dict(df.dtypes)[segment]}, q array<double>")
    return whole.join(F.broadcast(q), segment)


def segment_blocks(df: DataFrame, segment: str, score: str = "score", label: str = "label", at: float = 0.5, grid: tuple[float, ...] = (0.15, 0.25, 0.35)) -> DataFrame:
    """(segment, label, n, mean, median, fpr, recall, recalls): negatives have fpr alone; positives recall at `at`, and at each threshold of the grid as an array. Segments are few."""
    rows = df.withColumn("_block", F.concat_ws("/", F.col(segment).cast("string"), F.col(label).cast("string")))
    share = lambda t: F.avg((F.col(score) >= t).cast("int"))
    hit = rows.where(finite(F.col(score)).isNotNull()).groupBy("_block", segment, label).agg(share(at).alias("_hit"), F.array(*[share(t) for t in grid]).alias("_hits"))
    j = hit.join(score_summary(rows, "_block", score, (0.5,)), "_block")
    positive = F.col(label) == 1
    return j.select(
        segment, label, "n", "mean", F.col("q")[0].alias("median"), F.when(~positive, F.col("_hit")).alias("fpr"), F.when(positive, F.col("_hit")).alias("recall"), F.when(positive, F.col("_hits")).alias("recalls")
    )


def hard_easy_contrast(df: DataFrame, columns: list[str], score: str = "score", label: str = "label", at: float = 0.5) -> DataFrame:
    """(feature, hard_mean, easy_mean, human_mean, z_easy, z_human, corr): positives scored below `at` (hard) against those above (easy), in standard deviations of the hard ones, and against negatives,
    in those of the negatives (sample std, of 0 or one row 1e-6); corr of the feature (missing as 0) with the score over all positives, NULL for a constant one.
    """
    hard, easy, human = (F.col(label) == 1) & (F.col(score) < at), (F.col(label) == 1) & (F.col(score) >= at), F.col(label) == 0
    kind = F.when(hard, "hard").when(easy, "easy").when(human, "human")
    cells = long_form(df.select(kind.alias("_kind"), F.col(score).alias("_score"), *columns), columns, ["_kind", "_score"], missing=True)
    of = lambda k: F.when(F.col("_kind") == k, F.col("value"))
    filled, at_score = (F.when(F.col("_kind").isin("hard", "easy"), x) for x in (F.coalesce("value", F.lit(0.0)), F.col("_score")))
    one = {f"{k}_mean": F.avg(of(k)) for k in ("hard", "easy", "human")} | {"_h": F.stddev_samp(of("hard")), "_n": F.stddev_samp(of("human"))}
    one |= {"corr": F.when(F.stddev_pop(filled) >= 1e-9, correlation(filled, at_score))}
    rows = every_feature(cells.groupBy("feature").agg(*[x.alias(n) for n, x in one.items()]), columns)
    spread = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(EPS))
    z_easy = F.abs(F.coalesce("easy_mean", F.lit(0.0)) - F.col("hard_mean")) / spread("_h")
    return rows.select("feature", "hard_mean", "easy_mean", "human_mean", z_easy.alias("z_easy"), (F.abs(F.col("hard_mean") - F.col("human_mean")) / spread("_n")).alias("z_human"), "corr")


def profile_distances(df: DataFrame, columns: list[str], side: Column, weights: dict[str, float] | None = None, least_rows: int = 3) -> DataFrame:
    """(feature, ks, mean_a, mean_b, weight): how far the rows of one side are from the other in each feature, missing values as 0; features of sides with fewer than least_rows rows are left out."""
    filled = df.select(side.alias("_side"), *[F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in columns])
    d = ks(filled, columns, F.col("_side")).where((F.col("n_a") >= least_rows) & (F.col("n_b") >= least_rows))
    means = filled.agg(*[F.avg(F.when(F.col("_side") == s, F.col(c))).alias(f"{c}__{n}") for c in columns for s, n in ((True, "mean_a"), (False, "mean_b"))])
    given = F.element_at(F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(float((weights or {}).get(c, 1.0))))]), F.col("feature"))
    return d.join(from_wide(means, columns, ["mean_a", "mean_b"]), "feature").select("feature", "ks", "mean_a", "mean_b", given.alias("weight"))


def profile_match(distances: DataFrame, most_median: float = 0.3, most_weighted: float = 0.3) -> DataFrame:
    """(n_features, median_ks, mean_ks, weighted_median_ks, reached), one row from profile_distances(): a feature counts ten times its weight, rounded down, but once at least. Without features, 1 and not reached."""
    times = F.greatest(F.lit(1), F.floor(F.col("weight") * 10)).cast("long")
    half = F.lit(0.5)
    row = distances.agg(F.count("*").alias("n_features"), *[F.coalesce(x, F.lit(1.0)).alias(n) for n, x in (("median_ks", F.percentile("ks", half)), ("mean_ks", F.avg("ks")), ("weighted_median_ks", F.percentile("ks", half, times)))])
    return row.withColumn("reached", (F.col("n_features") > 0) & (F.col("median_ks") <= most_median) & (F.col("weighted_median_ks") <= most_weighted))


def blended(a: dict[str, tuple[float, float]], b: dict[str, tuple[float, float]], share: float = 0.7) -> dict[str, tuple[float, float]]:
    """Fingerprint whose means are `share` of a's and the rest b's, with a's spread."""
    return {c: (share * a[c][0] + (1 - share) * b[c][0], a[c][1]) for c in a if c in b}


def adjusted_fingerprint(distances: DataFrame, least: float = 0.3, pull: float = 0.5) -> DataFrame:
    """(feature, mean, weight) from profile_distances(): means of side a are pulled towards b's where the distance is `least` or more, weights grow with it."""
    mean = F.when(F.col("ks") >= least, F.col("mean_a") + pull * (F.col("mean_b") - F.col("mean_a"))).otherwise(F.col("mean_a"))
    return distances.select("feature", mean.alias("mean"), (F.col("weight") * (1 + F.col("ks"))).alias("weight"))


def qc_gate(tiers: DataFrame, most_hard: float = 0.02) -> DataFrame:
    """(hard_share, soft_share, pass), one row from rows with tier."""
    share = lambda k: F.avg((F.col("tier") == k).cast("int"))
    return tiers.agg(share("hard").alias("hard_share"), share("soft").alias("soft_share"), (share("hard") <= most_hard).alias("pass"))


def release_gates(metrics: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """metrics (a row per set) with a column per gate, and release, whether all rows pass all: gates maps a column to ('min' or 'max', limit); a missing value fails."""
    ok = {f"{c}_ok": F.coalesce((F.col(c) >= limit) if kind == "min" else (F.col(c) <= limit), F.lit(False)) for c, (kind, limit) in gates.items()}
    rows = metrics.withColumns(ok)
    every = rows.agg(F.bool_and(reduce(Column.__and__, [F.col(k) for k in ok])).alias("release"))  # one row
    return rows.join(F.broadcast(every), F.lit(True))


def grid_select(grid: DataFrame, feasible: Column, *order: Column) -> DataFrame:
    """The feasible rows of a grid with place, best first."""
    return grid.where(feasible).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # a row per point of the grid


def strategy_scores(trials: DataFrame, most_fpr: float = 2.0, most_other_fpr: float = 2.0) -> DataFrame:
    """trials with strategy_score and place, from recall, fpr, other_fpr and low_recall in per cent: recall plus a tenth of the recall at a lower threshold, less five times the fpr over its limit and twice the other fpr
    over its own. Missing rates are 99, missing recalls 0; trials with an error have -1. A row per trial.
    """
    known = lambda c, d: F.coalesce(finite(F.col(c)), F.lit(d))
    over = lambda c, most: F.greatest(F.lit(0.0), known(c, 99.0) - most)
    value = known("recall", 0.0) + 0.1 * known("low_recall", 0.0) - 5 * over("fpr", most_fpr) - 2 * over("other_fpr", most_other_fpr)
    scored = trials.withColumn("strategy_score", F.when(F.col("error").isNotNull(), -1.0).otherwise(value) if "error" in trials.columns else value)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("strategy_score"), "trial")))


def served_counts(rows: DataFrame, key: str, cycle: str) -> DataFrame:
    """(key, served, first_cycle, last_cycle, repeats): how often each fingerprint was served."""
    return rows.groupBy(key).agg(F.count("*").alias("served"), F.min(cycle).alias("first_cycle"), F.max(cycle).alias("last_cycle"), (F.count("*") - 1).alias("repeats"))


def score_diagnostics(df: DataFrame, request: str, order: str, score: str = "score", floor: float = 0.2, ceiling: float = 0.8, at: float = 0.5) -> DataFrame:
    """(request, n, low, high, mean, std, near_floor, near_ceiling, digest): a request's scores, digest the SHA-256 of its predictions (0 and 1 in order). A request is one message."""
    bits = F.transform(F.sort_array(F.collect_list(F.struct(order, (F.col(score) > at).cast("int").cast("string").alias("b")))), lambda x: x["b"])
    return df.groupBy(request).agg(
        F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count_if(F.col(score) < floor).alias("near_floor"),
        F.count_if(F.col(score) > ceiling).alias("near_ceiling"), F.sha2(F.array_join(bits, ""), 256).alias("digest"),
    )


def suspicion(events: DataFrame, scorer: str, cycle: str, reasons: str, last: int = 64) -> DataFrame:
    """(scorer, counts, events, last_cycle, last_reasons) from rows (scorer, cycle, array of reasons): how often each reason was found (a map), how many events there were of which the last `last` are kept, and the latest event.

    Rows without a reason are no events. Only a scorer's last rows of a task are shuffled for the latest event.
    """
    rows = events.where(F.size(reasons) > 0)
    counts = rows.select(scorer, F.explode(reasons).alias("_r")).groupBy(scorer, "_r").agg(F.count("*").alias("_n")).groupBy(scorer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_r", "_n")))).alias("counts"))
    whole = rows.groupBy(scorer).agg(F.least(F.count("*"), F.lit(last)).alias("events"), F.max(cycle).alias("last_cycle"), F.max_by(F.sort_array(reasons), F.struct(cycle, F.sort_array(reasons))).alias("last_reasons"))
    return whole.join(counts, scorer)


def last_events(events: DataFrame, scorer: str, cycle: str, reasons: str, last: int = 64) -> DataFrame:
    """The last `last` events of each scorer."""
    place = F.row_number().over(Window.partitionBy(scorer).orderBy(F.desc(cycle), F.array_join(F.sort_array(reasons), "|")))
    return events.where(F.size(reasons) > 0).withColumn("_place", place).where(F.col("_place") <= last).drop("_place")


def status_changes(rows: DataFrame, scorer: str, cycle: str, status: str) -> DataFrame:
    """rows with previous and changed: whether a scorer's status is another than in its row before (a first one is a change)."""
    before = F.lag(status).over(Window.partitionBy(scorer).orderBy(cycle))  # cycles of one scorer
    return rows.withColumn("previous", before).withColumn("changed", ~F.col(status).eqNullSafe(F.col("previous")))


def compliance_summary(rows: DataFrame, scorer: str, cycle: str, status: str) -> DataFrame:
    """(tracked, transparent, opaque, last_cycle), one row over each scorer's latest status."""
    latest = rows.groupBy(scorer).agg(F.max_by(status, cycle).alias("_s"), F.max(cycle).alias("_c"))
    return latest.agg(F.count("*").alias("tracked"), F.count_if(F.col("_s") == "transparent").alias("transparent"), F.count_if(F.col("_s") == "opaque").alias("opaque"), F.max("_c").alias("last_cycle"))


def stratum_key(unit: Column, actors: Column, stages: Column, events: Column) -> Column:
    """stake|seats|depth|pace of a session: its unit, actors, stages after the first, and events."""
    stake = F.when(unit < 0.1, "micro").when(unit < 1, "low").when(unit < 5, "mid").otherwise("high")
    seats = F.when(actors <= 2, "hu").when(actors <= 6, "sh").otherwise("fr")
    depth = F.when(stages == 0, "pf").when(stages == 1, "flop").otherwise("deep")
    return F.concat_ws("|", stake, seats, depth, F.when(events <= 6, "short").when(events <= 14, "mid").otherwise("long"))


def shortcut_features(events: DataFrame, by: str = "grp") -> DataFrame:
    """(by, sessions, and means per session of actors, events, stages, calls, raises, checks, folds, sum of amounts, sum of totals): what a leak probe looks at first."""
    n = {f"avg_{t}": F.count_if(F.col("type") == t) for t in ("call", "raise", "check", "fold")}
    # one row stands for each actor and each stage: events that lie by session are not dealt again, as two distinct counts would
    first = lambda c: (F.row_number().over(Window.partitionBy(by, "sess", c).orderBy(c)) == 1) & F.col(c).isNotNull()
    s = events.withColumn("_actor", first("actor")).withColumn("_stage", first("stage")).groupBy(by, "sess").agg(
        F.count_if("_actor").alias("avg_players"), F.count("*").alias("avg_actions"), F.count_if("_stage").alias("avg_streets"), *[c.alias(k) for k, c in n.items()],
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("avg_amount_sum"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("avg_total_sum"),
    )
    names = ["avg_players", "avg_actions", "avg_streets", *n, "avg_amount_sum", "avg_total_sum"]
    return s.groupBy(by).agg(F.count("*").alias("chunk_size"), *[F.avg(k).alias(k) for k in names])


def raw_session_profile(events: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(sess, numbers of a session as it was recorded): stacks are the actors' first ones, std of the sample (one value: 0); metadata has sess and numeric columns, which come as meta_<name>."""
    stacks = events.groupBy("sess", "actor").agg(F.min_by("stack", "ord").alias("s")).groupBy("sess").agg(
        F.count("*").alias("n_players"), F.avg("s").alias("stack_mean"), F.min("s").alias("stack_min"), F.max("s").alias("stack_max"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("stack_std")
    )
    whole = events.groupBy("sess").agg(
        F.count("*").alias("n_actions"), F.count_distinct("stage").alias("n_streets"), F.max("total").alias("total_max"), F.max_by("total", "ord").alias("total_last"), F.sum("amount").alias("amount_sum"),
        F.max("amount").alias("amount_max"), F.avg("amount").alias("amount_mean"), F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("amount_std"),
    )
    out = stacks.join(whole, "sess")
    if metadata is not None:
        out = out.join(metadata.select("sess", *[F.col(c).cast("double").alias(f"meta_{c}") for c in metadata.columns if c != "sess"]), "sess", "left")
    return out


def compact_session(events: DataFrame) -> DataFrame:
    """(sess, line): a session's events as text, s<stage>:<first letter of the type>:<actor>, in order. A session is short."""
    word = F.concat(F.lit("s"), F.col("stage").cast("string"), F.lit(":"), F.upper(F.substring("type", 1, 1)), F.lit(":"), F.col("actor").cast("string"))
    e = events.groupBy("sess").agg(F.sort_array(F.collect_list(F.struct("ord", word.alias("w")))).alias("e"))
    return e.select("sess", F.array_join("e.w", " | ").alias("line"))


def compared(left: DataFrame, right: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, delta, side) of two metric tables: keys lower-cased and trimmed, delta right less left, side left, right or both."""
    one = lambda df, x: df.select(F.lower(F.trim(key)).alias(key), *[F.col(m).cast("double").alias(f"{m}_{x}") for m in metrics], F.lit(1).alias(f"_{x}"))
    j = one(left, "a").join(one(right, "b"), key, "full")
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_b") - F.col(f"{m}_a")).alias("delta")) for m in metrics])
    return j.select(key, F.explode(cells).alias("x"), side.alias("side")).select(key, "x.metric", "x.delta", "side")
