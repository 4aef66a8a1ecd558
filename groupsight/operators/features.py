"""Session and group features: what happens within a session, and how a group's sessions are distributed."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupsight.functions.scalars import EPS, EVENT_TYPES, clamp, total
from groupsight.operators.ordered import SMALL, group_quantiles, quantile_of, quantiles
from groupsight.sources.bindings import MANY_ROWS, dealt
from groupsight.sources.store import cut, scratch

# The contract's feature names, in order.
SESSION_FEATURES = (
    "n_players", "n_streets", "n_actions", "call_ratio", "check_ratio", "fold_ratio", "raise_ratio", "bet_ratio", "all_in_ratio", "other_ratio",
    "mean_norm_bb", "std_norm_bb", "max_norm_bb", "mean_pot_after", "std_pot_after", "bet_size_mean", "bet_size_std", "bet_size_max",
    "end_preflop", "end_flop", "end_turn", "end_river", "p2", "p3", "p4", "p5", "p6p", "stack_mean", "stack_std",
    "aggression_factor", "action_entropy", "pot_growth", "max_consecutive", "unique_actors_ratio", "fold_position_mean", "preflop_action_density",
)
PERCENTILE_FEATURES = (
    "bet_ratio", "call_ratio", "check_ratio", "fold_ratio", "raise_ratio", "mean_norm_bb", "mean_pot_after", "aggression_factor", "action_entropy", "bet_size_mean",
)
PERCENTILES = (0.1, 0.5, 0.9)
CONTRAST_FEATURES = (
    "raise_minus_call_mean", "bet_minus_fold_mean", "late_minus_early_mean", "raise_std_over_check_std", "pot_after_over_stack_mean",
    "aggression_std_over_mean", "entropy_range", "bet_size_cv",
)


def feature_names() -> list[str]:
    """Columns of a group row, in order: 147."""
    out = ["chunk_n_hands"]
    for k in SESSION_FEATURES:
        out += [f"{k}_{s}" for s in ("mean", "std", "max")]
        out += [f"{k}_{s}" for s in ("p10", "p50", "p90")] if k in PERCENTILE_FEATURES else []
    return out + list(CONTRAST_FEATURES)


def numbered(events: DataFrame) -> DataFrame:
    """Known events of each session with their place (from 0) and the island of equal types they stand in."""
    known = events.where(F.col("type").isin(*EVENT_TYPES))
    by = Window.partitionBy("sess").orderBy("ord")
    island = F.row_number().over(by) - F.row_number().over(Window.partitionBy("sess", "type").orderBy("ord"))
    return known.withColumn("pos", F.row_number().over(by) - 1).withColumn("island", island)


def max_run(events: DataFrame) -> DataFrame:
    """(sess, max_consecutive): longest run of equal types."""
    runs = numbered(events).groupBy("sess", "type", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("sess").agg(F.max("n").cast("double").alias("max_consecutive"))


def event_entropy(counts: list[Column], n: Column) -> Column:
    """Shannon entropy in bits of counts that sum to n."""
    return F.when(n > 0, total([F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for c in counts])).otherwise(0.0)


def session_features(events: DataFrame, label: str | None = "label") -> DataFrame:
    """(grp, sess, label, 36 features): one row per session. Everything but other_ratio ignores unknown event types.

    All windows and the one aggregate share the partitioning by session: a single shuffle, and none if events come so.
    """
    keep = ["grp", "sess"] + ([label] if label else [])
    known = F.col("type").isin(*EVENT_TYPES)
    session, person = Window.partitionBy("sess"), Window.partitionBy("sess", "actor")
    rows = events.withColumn("_pos", F.sum(known.cast("int")).over(session.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("_island", F.col("_pos") - F.row_number().over(Window.partitionBy("sess", "type").orderBy("ord")))
    rows = rows.withColumn("_run", F.count("*").over(Window.partitionBy("sess", "type", "_island")))
    # one row stands for each person, one of known type if there is any
    rows = rows.withColumn("_one", (F.row_number().over(person.orderBy(known.desc(), "ord")) == 1) & F.col("actor").isNotNull())
    rows = rows.withColumn("_stack", F.when(F.col("_one"), F.max("stack").over(person)))
    of = lambda c: F.when(known, F.col(c))
    size = F.when(known & (F.col("amount") > 0), F.col("amount"))
    j = rows.groupBy(*keep).agg(
        F.count("*").alias("n_all"), F.count_if(F.col("type") == "other").alias("n_other"), F.max("stage").alias("streets"),
        F.count_if("_one").alias("np"), F.avg("_stack").alias("stack_mean"), F.stddev_pop("_stack").alias("stack_std"),
        F.count_if(known).alias("n"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in EVENT_TYPES],
        F.avg(of("amount")).alias("mean_norm_bb"), F.stddev_pop(of("amount")).alias("std_norm_bb"), F.max(of("amount")).alias("max_norm_bb"),
        F.avg(of("total")).alias("mean_pot_after"), F.stddev_pop(of("total")).alias("std_pot_after"), F.avg(size).alias("bet_size_mean"),
        F.stddev_pop(size).alias("bet_size_std"), F.max(size).alias("bet_size_max"), F.min_by("total", of("ord")).alias("first"), F.max_by("total", of("ord")).alias("last"),
        F.count_if(F.col("_one") & known).alias("actors"), F.avg(F.when(F.col("type") == "fold", F.col("_pos"))).alias("fold_pos"),
        F.count_if(known & (F.col("stage") == 0)).alias("early"), F.max(of("_run")).alias("run"),
    )
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    n, players, streets = F.greatest(zero("n"), F.lit(1.0)), zero("np"), zero("streets")
    counts = {t: zero(f"n_{t}") for t in EVENT_TYPES}
    flag = lambda c: c.cast("double")
    col = {
        "n_players": players, "n_streets": streets, "n_actions": n, **{f"{t}_ratio": counts[t] / n for t in EVENT_TYPES},
        "other_ratio": zero("n_other") / F.greatest(zero("n_all"), F.lit(1.0)),
        "end_preflop": flag(streets <= 0), "end_flop": flag(streets == 1), "end_turn": flag(streets == 2), "end_river": flag(streets >= 3),
        "p2": flag(players <= 2), "p3": flag(players == 3), "p4": flag(players == 4), "p5": flag(players == 5), "p6p": flag(players >= 6),
        "aggression_factor": (counts["bet"] + counts["raise"] + counts["all_in"]) / (counts["call"] + counts["check"] + 1),
        "action_entropy": event_entropy(list(counts.values()), zero("n")),
        "pot_growth": F.when(zero("n") >= 2, (F.col("last") - F.col("first")) / n).otherwise(0.0), "max_consecutive": zero("run"),
        "unique_actors_ratio": F.when(players > 0, zero("actors") / F.greatest(players, F.lit(1.0))).otherwise(0.0),
        "fold_position_mean": zero("fold_pos") / F.greatest(n - 1, F.lit(1.0)), "preflop_action_density": zero("early") / n,
    }
    return j.select(*keep, *[col.get(k, zero(k)).alias(k) for k in SESSION_FEATURES])


def group_features(
    sessions: DataFrame, keys: tuple[str, ...] = ("grp",), names: tuple[str, ...] = SESSION_FEATURES, percentiles: tuple[str, ...] = PERCENTILE_FEATURES, large: int = SMALL
) -> DataFrame:
    """Per group: number of sessions, mean, population std and max of each feature, exact p10/p50/p90 of some.

    Groups are first counted. Sessions are then dealt by group into tasks of a bounded number of them, where a group's percentiles are read from its sorted values;
    groups of more than `large` sessions are added up in every task instead, and their percentiles come from running counts of their values.
    """
    sizes = sessions.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.max("_n")).first()
    moments = [F.count("*").cast("double").alias("chunk_n_hands")]
    for k in names:
        moments += [F.avg(k).alias(f"{k}_mean"), F.stddev_pop(k).alias(f"{k}_std"), F.max(k).alias(f"{k}_max")]
    percentiles = tuple(k for k in names if k in percentiles)
    cols = [*keys, "chunk_n_hands"]
    for k in names:
        cols += [f"{k}_mean", f"{k}_std", f"{k}_max"]
        cols += [F.col(f"_{k}")[i].alias(f"{k}_p{p}") for i, p in enumerate((10, 50, 90))] if k in percentiles else []

    def held(few: DataFrame) -> DataFrame:
        at_once = [F.collect_list(F.struct(*percentiles)).alias("_all")] if percentiles else []
        few = dealt(few, rows, *keys) if rows > MANY_ROWS else few.repartition(*keys)  # before the lists are made: a task would make one per session
        out = few.groupBy(*keys).agg(*moments, *at_once)
        out = out.withColumns({f"_{k}": F.sort_array(F.array_compact(F.col("_all")[k])) for k in percentiles})
        return out.withColumns({f"_{k}": F.array(*[quantile_of(F.col(f"_{k}"), p) for p in PERCENTILES]) for k in percentiles}).select(*cols)

    if (most or 0) <= large:
        return held(sessions)
    big = cut(sizes.where(F.col("_n") > large), "large_groups").select(*[F.col(k).alias(f"_big_{k}") for k in keys])  # at most a row per `large` sessions
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_big_{k}")) for k in keys])
    many = sessions.join(F.broadcast(big), same, "left_semi")
    out = many.groupBy(*keys).agg(*moments)
    if percentiles:
        found = group_quantiles(many, list(keys), list(percentiles), PERCENTILES).select(*[F.col(k).alias(f"_big_{k}") for k in keys], *[f"_{k}" for k in percentiles])
        out = out.join(found, same)
    return held(sessions.join(F.broadcast(big), same, "left_anti")).unionByName(out.select(*cols))


#: Aggregates that a feature of a spec may ask for.
STATS = {
    "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
    **{f"p{p}": (lambda c, p=p: F.percentile(c, F.lit(p / 100))) for p in (10, 50, 90)},
}


def spec_features(df: DataFrame, keys: tuple[str, ...], spec: list[tuple[str, Column, tuple[str, ...]]]) -> DataFrame:
    """(keys, name_stat ...): one aggregate over all features (name, column, stats) of a spec; stats are names of STATS."""
    return df.groupBy(*keys).agg(*[STATS[s](c).alias(f"{name}_{s}") for name, c, stats in spec for s in stats])


def stage_counts(events: DataFrame, stages: list[int], by: str = "grp") -> DataFrame:
    """(by, s<stage> ...): events of each stage."""
    return events.groupBy(by).agg(*[F.count_if(F.col("stage") == k).alias(f"s{k}") for k in stages])


def contrast_features(groups: DataFrame) -> DataFrame:
    """groups with eight differences and ratios of its columns."""
    c = F.col
    return groups.withColumns({
        "raise_minus_call_mean": c("raise_ratio_mean") - c("call_ratio_mean"), "bet_minus_fold_mean": c("bet_ratio_mean") - c("fold_ratio_mean"),
        "late_minus_early_mean": c("end_turn_mean") + c("end_river_mean") - (c("end_preflop_mean") + c("end_flop_mean")),
        "raise_std_over_check_std": c("raise_ratio_std") / (F.abs("check_ratio_std") + EPS),
        "pot_after_over_stack_mean": c("mean_pot_after_mean") / (F.abs("stack_mean_mean") + EPS),
        "aggression_std_over_mean": c("aggression_factor_std") / (F.abs("aggression_factor_mean") + EPS),
        "entropy_range": c("action_entropy_max") - c("action_entropy_mean"), "bet_size_cv": c("bet_size_mean_std") / (F.abs("bet_size_mean_mean") + EPS),
    })


# Name: (numerator, denominator); denominators are floored at 1e-8.
INVARIANTS = {
    "pot_cv_inv": ("mean_pot_after_std", "mean_pot_after_mean"), "pot_spread_inv": ("mean_pot_after_p90 - mean_pot_after_p10", "mean_pot_after_mean"),
    "pot_median_position_inv": ("mean_pot_after_p50 - mean_pot_after_p10", "mean_pot_after_p90 - mean_pot_after_p10"),
    "pot_growth_relative_inv": ("pot_growth_mean", "mean_pot_after_mean"), "pot_growth_cv_inv": ("pot_growth_std", "mean_pot_after_mean"),
    "std_pot_cv_inv": ("std_pot_after_std", "mean_pot_after_mean"), "bet_size_cv_inv": ("bet_size_mean_std", "bet_size_mean_mean"),
    "bet_size_p90_ratio_inv": ("bet_size_mean_p90", "bet_size_mean_mean"), "bet_size_p50_ratio_inv": ("bet_size_mean_p50", "bet_size_mean_mean"),
    "bet_size_max_ratio_inv": ("bet_size_mean_max", "bet_size_mean_mean"), "bet_size_max_cv_inv": ("bet_size_max_std", "bet_size_mean_mean"),
    "bet_size_std_max_ratio_inv": ("bet_size_std_max", "bet_size_mean_mean"), "norm_bb_cv_inv": ("std_norm_bb_std", "mean_norm_bb_p90"),
    "max_norm_bb_cv_inv": ("max_norm_bb_std", "mean_norm_bb_p90"), "bet_to_pot_ratio_inv": ("bet_size_mean_mean", "mean_pot_after_mean"),
    "pot_growth_consistency_inv": ("pot_growth_std", "pot_growth_mean"),
}


def invariant_features(groups: DataFrame) -> DataFrame:
    """groups with 16 ratios that do not change with the scale of amounts."""
    return groups.withColumns({k: F.coalesce(F.expr(f"({a}) / greatest({b}, 1e-8D)"), F.lit(0.0)) for k, (a, b) in INVARIANTS.items()})


# The derived indices, whose weights stand in derived_features().
DERIVED = ("dbf_aggression_intensity", "dbf_aggr_minus_fold", "dbf_action_diversity_norm", "dbf_transition_complexity", "dbf_repetition_score", "dbf_early_pressure", "dbf_late_pressure", "dbf_street_pressure_shift")


def derived_features(groups: DataFrame) -> DataFrame:
    """groups with eight behavioural indices; missing inputs count as 0."""
    have = set(groups.columns)
    c = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in have else F.lit(0.0)
    bet, call, check, raise_, fold = (c(f"{x}_ratio_mean") for x in ("bet", "call", "check", "raise", "fold"))
    early, late = c("end_preflop_mean") + c("end_flop_mean"), c("end_turn_mean") + c("end_river_mean")
    scale = F.abs(early) + F.abs(late) + EPS
    spread = (F.abs(bet - call) + F.abs(call - check) + F.abs(check - raise_)) / 3
    return groups.withColumns({
        "dbf_aggression_intensity": 0.8 * raise_ + 0.6 * bet - (0.4 * call + 0.8 * fold), "dbf_aggr_minus_fold": c("raise_ratio_max") - fold,
        "dbf_action_diversity_norm": 1 / (1 + spread), "dbf_transition_complexity": c("n_streets_mean") + 0.5 * c("n_streets_std"),
        "dbf_repetition_score": c("check_ratio_std") + c("call_ratio_std") - c("raise_ratio_std"), "dbf_early_pressure": early / scale,
        "dbf_late_pressure": late / scale, "dbf_street_pressure_shift": late / scale - early / scale,
    })


def derived_fit(train: DataFrame) -> dict[str, tuple[float, float, float]]:
    """1 % and 99 % quantiles and population std of each index over the training groups."""
    with scratch(train.sparkSession):
        rows = cut(derived_features(train).select(*DERIVED), "derived")  # read in several passes
        found, row = quantiles(rows, list(DERIVED), [0.01, 0.99]), rows.agg(*[F.stddev_pop(k).alias(k) for k in DERIVED]).first()
    return {k: (*found[k], row[k]) for k in DERIVED if found[k][0] is not None}


def derived_apply(groups: DataFrame, fitted: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Indices within the fitted quantiles, squashed by tanh(x / 3); 0 where the training groups hardly vary."""
    out = derived_features(groups)
    squash = lambda k, lo, hi, std: F.lit(0.0) if std < 1e-7 else F.tanh(clamp(F.col(k), lo, hi) / 3)
    return out.withColumns({k: squash(k, *v) for k, v in fitted.items()})


def heuristic_score(groups: DataFrame) -> Column:
    """A score in [0, 1] from a group row's means. Its weights and scales are fixed values."""
    c = F.col
    players = F.when(c("n_players_mean") != 0, (6 - F.least(c("n_players_mean"), F.lit(6.0))) / 4).otherwise(0.0)
    s = (
        0.32 * F.least(F.lit(1.0), c("n_streets_mean") / 3) + 0.18 * clamp(c("call_ratio_mean") / 0.35) + 0.12 * clamp(c("check_ratio_mean") / 0.30)
        + 0.08 * clamp(players) - 0.18 * clamp(c("fold_ratio_mean") / 0.55) - 0.10 * clamp(c("raise_ratio_mean") / 0.20)
    )
    return clamp(s)
