"""Queries of session and group features (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupsight.functions.scalars import EVENT_TYPES, rounded, smooth_uncertain
from groupsight.operators import features as G
from groupsight.operators import reports as R
from groupsight.plans.registry import query
from groupsight.sources.bindings import ORDER_EVENTS, USER_EVENTS, order_events, table, user_events

_IN = ", ".join(f"'{t}'" for t in EVENT_TYPES)


def _events_sql(name: str, source: str) -> str:
    """Known events of `source` with place and island, as CTE name."""
    return f"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY sess ORDER BY ord) - 1 AS pos,
    row_number() OVER (PARTITION BY sess ORDER BY ord) - row_number() OVER (PARTITION BY sess, type ORDER BY ord) AS island
  FROM {source} WHERE type IN ({_IN}))"""


def session_sql(source: str) -> str:
    counts = ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t in EVENT_TYPES)
    ratios = ", ".join(f"coalesce(n_{t}, 0) / nn AS {t}_ratio" for t in EVENT_TYPES)
    entropy = " + ".join(f"CASE WHEN coalesce(n_{t}, 0) > 0 THEN -(n_{t} / nn) * log2(n_{t} / nn) ELSE 0 END" for t in EVENT_TYPES)
    return f"""{_events_sql('kn', source)},
people AS (SELECT sess, count(*) AS np, avg(stack) AS stack_mean, stddev_pop(stack) AS stack_std
  FROM (SELECT sess, actor, max(stack) AS stack FROM {source} WHERE actor IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
whole AS (SELECT grp, sess, label, count(*) AS n_all, count(*) FILTER (type = 'other') AS n_other, max(stage) AS streets FROM {source} GROUP BY 1, 2, 3),
per AS (SELECT sess, count(*) AS n, {counts}, avg(amount) AS mean_norm_bb, stddev_pop(amount) AS std_norm_bb, max(amount) AS max_norm_bb,
  avg(total) AS mean_pot_after, stddev_pop(total) AS std_pot_after, avg(amount) FILTER (amount > 0) AS bet_size_mean, stddev_pop(amount) FILTER (amount > 0) AS bet_size_std,
  max(amount) FILTER (amount > 0) AS bet_size_max, arg_min(total, ord) AS first, arg_max(total, ord) AS last, count(DISTINCT actor) AS actors,
  avg(pos) FILTER (type = 'fold') AS fold_pos, count(*) FILTER (stage = 0) AS early FROM kn GROUP BY 1),
runs AS (SELECT sess, max(run) AS run FROM (SELECT sess, type, island, count(*) AS run FROM kn GROUP BY 1, 2, 3) GROUP BY 1),
jn AS (SELECT *, greatest(coalesce(n, 0), 1)::DOUBLE AS nn, coalesce(np, 0)::DOUBLE AS pp, coalesce(streets, 0)::DOUBLE AS st
  FROM whole LEFT JOIN per USING (sess) LEFT JOIN people USING (sess) LEFT JOIN runs USING (sess)),
sf AS (SELECT grp, sess, label, pp AS n_players, st AS n_streets, nn AS n_actions, {ratios}, n_other / greatest(n_all, 1)::DOUBLE AS other_ratio,
  coalesce(mean_norm_bb, 0) AS mean_norm_bb, coalesce(std_norm_bb, 0) AS std_norm_bb, coalesce(max_norm_bb, 0) AS max_norm_bb,
  coalesce(mean_pot_after, 0) AS mean_pot_after, coalesce(std_pot_after, 0) AS std_pot_after, coalesce(bet_size_mean, 0) AS bet_size_mean,
  coalesce(bet_size_std, 0) AS bet_size_std, coalesce(bet_size_max, 0) AS bet_size_max,
  (st <= 0)::INT::DOUBLE AS end_preflop, (st = 1)::INT::DOUBLE AS end_flop, (st = 2)::INT::DOUBLE AS end_turn, (st >= 3)::INT::DOUBLE AS end_river,
  (pp <= 2)::INT::DOUBLE AS p2, (pp = 3)::INT::DOUBLE AS p3, (pp = 4)::INT::DOUBLE AS p4, (pp = 5)::INT::DOUBLE AS p5, (pp >= 6)::INT::DOUBLE AS p6p,
  coalesce(stack_mean, 0) AS stack_mean, coalesce(stack_std, 0) AS stack_std,
  (coalesce(n_bet, 0) + coalesce(n_raise, 0) + coalesce(n_all_in, 0)) / (coalesce(n_call, 0) + coalesce(n_check, 0) + 1.0::DOUBLE) AS aggression_factor,
  {entropy} AS action_entropy, CASE WHEN n >= 2 THEN (last - first) / nn ELSE 0 END AS pot_growth, coalesce(run, 0)::DOUBLE AS max_consecutive,
  CASE WHEN pp > 0 THEN coalesce(actors, 0) / greatest(pp, 1) ELSE 0 END AS unique_actors_ratio,
  coalesce(fold_pos, 0) / greatest(nn - 1, 1) AS fold_position_mean, coalesce(early, 0) / nn AS preflop_action_density FROM jn)"""


def group_sql(source: str = "sf", keys: str = "grp") -> str:
    cols = ["count(*)::DOUBLE AS chunk_n_hands"]
    for k in G.SESSION_FEATURES:
        cols += [f"avg({k}) AS {k}_mean", f"stddev_pop({k}) AS {k}_std", f"max({k}) AS {k}_max"]
        if k in G.PERCENTILE_FEATURES:
            cols += [f"quantile_cont({k}, {p / 100}) AS {k}_p{p}" for p in (10, 50, 90)]
    return f"\ngf AS (SELECT {keys}, {', '.join(cols)} FROM {source} GROUP BY {keys})"


CONTRAST_SQL = """
cf AS (SELECT *, raise_ratio_mean - call_ratio_mean AS raise_minus_call_mean, bet_ratio_mean - fold_ratio_mean AS bet_minus_fold_mean,
  end_turn_mean + end_river_mean - (end_preflop_mean + end_flop_mean) AS late_minus_early_mean,
  raise_ratio_std / (abs(check_ratio_std) + 1e-6) AS raise_std_over_check_std, mean_pot_after_mean / (abs(stack_mean_mean) + 1e-6) AS pot_after_over_stack_mean,
  aggression_factor_std / (abs(aggression_factor_mean) + 1e-6) AS aggression_std_over_mean, action_entropy_max - action_entropy_mean AS entropy_range,
  bet_size_mean_std / (abs(bet_size_mean_mean) + 1e-6) AS bet_size_cv FROM gf)"""

B1_GROUPS = f"WITH {ORDER_EVENTS},{session_sql('b1')},{group_sql()},{CONTRAST_SQL}"
HEURISTIC_SQL = """greatest(0, least(1, 0.32 * least(1.0, n_streets_mean / 3) + 0.18 * greatest(0, least(1, call_ratio_mean / 0.35)) + 0.12 * greatest(0, least(1, check_ratio_mean / 0.30))
  + 0.08 * greatest(0, least(1, CASE WHEN n_players_mean != 0 THEN (6 - least(n_players_mean, 6)) / 4 ELSE 0 END)) - 0.18 * greatest(0, least(1, fold_ratio_mean / 0.55)) - 0.10 * greatest(0, least(1, raise_ratio_mean / 0.20))))"""


def r(names, digits: int = 6) -> list:
    return [rounded(F.col(n), digits).alias(n) for n in names]


def rs(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def b1_groups(spark, d):
    return G.contrast_features(G.group_features(G.session_features(order_events(spark, d))))


@query("g_session", f"WITH {ORDER_EVENTS},{session_sql('b1')} SELECT grp, sess, label, {rs(G.SESSION_FEATURES)} FROM sf")
def g_session(spark, d):
    return G.session_features(order_events(spark, d)).select("grp", "sess", "label", *r(G.SESSION_FEATURES))


@query("g_session_users", f"WITH {USER_EVENTS},{session_sql('b2')} SELECT grp, sess, label, {rs(G.SESSION_FEATURES)} FROM sf")
def g_session_users(spark, d):
    return G.session_features(user_events(spark, d)).select("grp", "sess", "label", *r(G.SESSION_FEATURES))


@query("g_entropy", f"WITH {USER_EVENTS},{session_sql('b2')} SELECT sess, round(action_entropy, 6) + 0.0 AS action_entropy FROM sf")
def g_entropy(spark, d):
    e = user_events(spark, d).where(F.col("type").isin(*EVENT_TYPES))
    counts = e.groupBy("sess").agg(F.count("*").alias("n"), *[F.count_if(F.col("type") == t).alias(t) for t in EVENT_TYPES])
    return counts.select("sess", rounded(G.event_entropy([F.col(t) for t in EVENT_TYPES], F.col("n"))).alias("action_entropy"))


@query("g_max_run", f"WITH {USER_EVENTS},{_events_sql('kn', 'b2')} SELECT sess, max(n)::DOUBLE AS max_consecutive FROM (SELECT sess, type, island, count(*) AS n FROM kn GROUP BY 1, 2, 3) GROUP BY 1")
def g_max_run(spark, d):
    return G.max_run(user_events(spark, d))


@query("g_growth", f"WITH {USER_EVENTS} SELECT sess, round((arg_max(total, ord) - arg_min(total, ord)) / greatest(1, count(*)), 6) + 0.0 AS growth FROM b2 GROUP BY 1")
def g_growth(spark, d):
    growth = (F.max_by("total", "ord") - F.min_by("total", "ord")) / F.greatest(F.lit(1), F.count("*"))
    return user_events(spark, d).groupBy("sess").agg(rounded(growth).alias("growth"))


@query("g_fold_pos", f"WITH {USER_EVENTS},{_events_sql('kn', 'b2')} SELECT sess, round(coalesce(avg(pos) FILTER (type = 'fold'), 0) / greatest(count(*) - 1, 1), 6) + 0.0 AS fold_position_mean FROM kn GROUP BY 1")
def g_fold_pos(spark, d):
    at = F.coalesce(F.avg(F.when(F.col("type") == "fold", F.col("pos"))), F.lit(0.0)) / F.greatest(F.count("*") - 1, F.lit(1))
    return G.numbered(user_events(spark, d)).groupBy("sess").agg(rounded(at).alias("fold_position_mean"))


@query("g_actors", f"WITH {ORDER_EVENTS} SELECT sess, count(DISTINCT actor) AS actors, round(count(DISTINCT actor) / count(*), 6) AS unique_actors_ratio, round(count(*) FILTER (stage = 0) / count(*), 6) AS first_stage_density FROM b1 GROUP BY 1")
def g_actors(spark, d):
    return order_events(spark, d).groupBy("sess").agg(
        F.count_distinct("actor").alias("actors"), rounded(F.count_distinct("actor") / F.count("*"), 6).alias("unique_actors_ratio"),
        rounded(F.count_if(F.col("stage") == 0) / F.count("*"), 6).alias("first_stage_density"),
    )


@query("g_other", f"WITH {ORDER_EVENTS} SELECT grp, count(*) FILTER (type = 'other') AS n_other, round(count(*) FILTER (type = 'other') / count(*), 6) + 0.0 AS other_ratio FROM b1 GROUP BY 1")
def g_other(spark, d):
    n = F.count_if(F.col("type") == "other")
    return order_events(spark, d).groupBy("grp").agg(n.alias("n_other"), rounded(n / F.count("*")).alias("other_ratio"))


_GF = [n for n in G.feature_names() if n not in G.CONTRAST_FEATURES]


@query("g_group", f"{B1_GROUPS} SELECT grp, {rs(_GF, 5)} FROM gf")
def g_group(spark, d):
    return G.group_features(G.session_features(order_events(spark, d))).select("grp", *r(_GF, 5))


@query("g_contrast", f"{B1_GROUPS} SELECT grp, {rs(G.CONTRAST_FEATURES, 4)} FROM cf WHERE check_ratio_std > 1e-3 AND aggression_factor_mean > 1e-3 AND bet_size_mean_mean > 1e-3")
def g_contrast(spark, d):
    return b1_groups(spark, d).where("check_ratio_std > 1e-3 AND aggression_factor_mean > 1e-3 AND bet_size_mean_mean > 1e-3").select("grp", *r(G.CONTRAST_FEATURES, 4))


_INV_SQL = ", ".join(f"round(coalesce(({a}) / greatest({b}, 1e-8), 0), 4) + 0.0 AS {k}" for k, (a, b) in G.INVARIANTS.items())
_INV_OK = "mean_pot_after_p90 - mean_pot_after_p10 > 1e-3 AND pot_growth_mean > 1e-3 AND bet_size_mean_mean > 1e-3"


@query("g_invariant", f"{B1_GROUPS} SELECT grp, {_INV_SQL} FROM gf WHERE {_INV_OK}")
def g_invariant(spark, d):
    return G.invariant_features(G.group_features(G.session_features(order_events(spark, d)))).where(_INV_OK).select("grp", *r(G.INVARIANTS, 4))


DERIVED_SQL = """
df AS (SELECT *, 0.8 * raise_ratio_mean + 0.6 * bet_ratio_mean - (0.4 * call_ratio_mean + 0.8 * fold_ratio_mean) AS dbf_aggression_intensity,
  raise_ratio_max - fold_ratio_mean AS dbf_aggr_minus_fold,
  1 / (1 + (abs(bet_ratio_mean - call_ratio_mean) + abs(call_ratio_mean - check_ratio_mean) + abs(check_ratio_mean - raise_ratio_mean)) / 3) AS dbf_action_diversity_norm,
  n_streets_mean + 0.5 * n_streets_std AS dbf_transition_complexity, check_ratio_std + call_ratio_std - raise_ratio_std AS dbf_repetition_score,
  (end_preflop_mean + end_flop_mean) / sc AS dbf_early_pressure, (end_turn_mean + end_river_mean) / sc AS dbf_late_pressure,
  (end_turn_mean + end_river_mean) / sc - (end_preflop_mean + end_flop_mean) / sc AS dbf_street_pressure_shift
  FROM (SELECT *, abs(end_preflop_mean + end_flop_mean) + abs(end_turn_mean + end_river_mean) + 1e-6 AS sc FROM cf))"""


@query("g_derived", f"{B1_GROUPS},{DERIVED_SQL} SELECT grp, {rs(G.DERIVED)} FROM df")
def g_derived(spark, d):
    return G.derived_features(b1_groups(spark, d)).select("grp", *r(G.DERIVED))


_FIT = ", ".join(f"quantile_cont({k}, 0.01) AS {k}_lo, quantile_cont({k}, 0.99) AS {k}_hi, stddev_pop({k}) AS {k}_sd" for k in G.DERIVED)
_APPLY = ", ".join(f"round(CASE WHEN {k}_sd < 1e-7 THEN 0 ELSE tanh(greatest({k}_lo, least({k}_hi, {k})) / 3) END, 6) + 0.0 AS {k}" for k in G.DERIVED)


@query("g_derived_fit", f"{B1_GROUPS},{DERIVED_SQL}, fit AS (SELECT {_FIT} FROM df WHERE grp % 5 != 0) SELECT grp, {_APPLY} FROM df, fit")
def g_derived_fit(spark, d):
    groups = b1_groups(spark, d)
    return G.derived_apply(groups, G.derived_fit(groups.where("grp % 5 != 0"))).select("grp", *r(G.DERIVED))


_SIG = ("n_players", "n_actions", "call_ratio", "check_ratio", "fold_ratio", "raise_ratio", "bet_ratio", "mean_norm_bb", "n_streets")


@query("g_signature", f"WITH {ORDER_EVENTS},{session_sql('b1')} SELECT grp, " + ", ".join(f"round(avg({k}), 6) + 0.0 AS sig_{k}" for k in _SIG) + " FROM sf GROUP BY 1")
def g_signature(spark, d):
    return G.session_features(order_events(spark, d)).groupBy("grp").agg(*[rounded(F.avg(k)).alias(f"sig_{k}") for k in _SIG])


_STRUCT = ("end_preflop", "end_flop", "end_turn", "end_river", "p2", "p3", "p4", "p5", "p6p")


@query("g_structure", f"WITH {ORDER_EVENTS},{session_sql('b1')} SELECT label, " + ", ".join(f"round(avg({k}), 6) + 0.0 AS {k}_share" for k in _STRUCT) + " FROM sf GROUP BY 1")
def g_structure(spark, d):
    return G.session_features(order_events(spark, d)).groupBy("label").agg(*[rounded(F.avg(k)).alias(f"{k}_share") for k in _STRUCT])


_SHORT = ("avg_players", "avg_actions", "avg_streets", "avg_call", "avg_raise", "avg_check", "avg_fold", "avg_amount_sum", "avg_total_sum")


@query("g_shortcut", f"""WITH {ORDER_EVENTS}, s AS (SELECT grp, sess, count(DISTINCT actor) AS avg_players, count(*) AS avg_actions, count(DISTINCT stage) AS avg_streets, {', '.join(f"count(*) FILTER (type = '{t}') AS avg_{t}" for t in ('call', 'raise', 'check', 'fold'))},
  sum(amount) AS avg_amount_sum, sum(total) AS avg_total_sum FROM b1 GROUP BY 1, 2) SELECT grp, count(*) AS chunk_size, {', '.join(f'round(avg({k}), 4) + 0.0 AS {k}' for k in _SHORT)} FROM s GROUP BY 1""")
def g_shortcut(spark, d):
    return R.shortcut_features(order_events(spark, d)).select("grp", "chunk_size", *r(_SHORT, 4))


_RAW = ("stack_mean", "stack_std", "total_max", "total_last", "amount_sum", "amount_max", "amount_mean", "amount_std", "meta_o_totalprice")


@query("g_raw_profile", f"""WITH {ORDER_EVENTS}, a AS (SELECT sess, actor, arg_min(stack, ord) AS s FROM b1 GROUP BY 1, 2), p AS (SELECT sess, count(*) AS n_players, avg(s) AS stack_mean, min(s) AS stack_min, max(s) AS stack_max, coalesce(stddev_samp(s), 0) AS stack_std FROM a GROUP BY 1),
  e AS (SELECT sess, count(*) AS n_actions, count(DISTINCT stage) AS n_streets, max(total) AS total_max, arg_max(total, ord) AS total_last, sum(amount) AS amount_sum, max(amount) AS amount_max, avg(amount) AS amount_mean, coalesce(stddev_samp(amount), 0) AS amount_std FROM b1 GROUP BY 1)
  SELECT sess, n_players, stack_min, stack_max, n_actions, n_streets, meta_o_custkey, {', '.join(f'round({k}, 4) + 0.0 AS {k}' for k in _RAW)} FROM p JOIN e USING (sess) JOIN (SELECT o_orderkey AS sess, o_custkey::DOUBLE AS meta_o_custkey, o_totalprice AS meta_o_totalprice FROM orders) USING (sess)""")
def g_raw_profile(spark, d):
    out = R.raw_session_profile(order_events(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("sess"), "o_custkey", "o_totalprice"))
    return out.select("sess", "n_players", "stack_min", "stack_max", "n_actions", "n_streets", "meta_o_custkey", *r(_RAW, 4))


@query("g_counts", f"WITH {ORDER_EVENTS} SELECT grp, " + ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t in (*EVENT_TYPES, "other")) + " FROM b1 GROUP BY 1")
def g_counts(spark, d):
    out = order_events(spark, d).groupBy("grp").pivot("type", [*EVENT_TYPES, "other"]).count().na.fill(0)
    return out.withColumnsRenamed({t: f"n_{t}" for t in (*EVENT_TYPES, "other")})


@query("g_depth", f"WITH {ORDER_EVENTS} SELECT label, min(depth) AS depth_min, max(depth) AS depth_max, round(avg(depth), 6) AS depth_mean, max(depth) - min(depth) AS depth_gap FROM (SELECT label, sess, max(stage) AS depth FROM b1 GROUP BY 1, 2) GROUP BY 1")
def g_depth(spark, d):
    s = order_events(spark, d).groupBy("label", "sess").agg(F.max("stage").alias("depth"))
    return s.groupBy("label").agg(F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"), rounded(F.avg("depth"), 6).alias("depth_mean"), (F.max("depth") - F.min("depth")).alias("depth_gap"))


@query("g_bench_stats", f"""WITH {ORDER_EVENTS},{session_sql('b1')} SELECT CASE WHEN grp % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS sessions, count(DISTINCT grp) AS groups,
  count(*) FILTER (label = 1) AS positives, round(avg(n_actions), 6) AS mean_actions, round(avg(raise_ratio), 6) AS mean_raise FROM sf GROUP BY 1""")
def g_bench_stats(spark, d):
    s = G.session_features(order_events(spark, d)).withColumn("split", F.when(F.col("grp") % 5 == 0, "val").otherwise("train"))
    return s.groupBy("split").agg(F.count("*").alias("sessions"), F.count_distinct("grp").alias("groups"), F.count_if(F.col("label") == 1).alias("positives"),
                                  rounded(F.avg("n_actions"), 6).alias("mean_actions"), rounded(F.avg("raise_ratio"), 6).alias("mean_raise"))


def _slice(spark, d):
    groups = b1_groups(spark, d)
    score = G.heuristic_score(groups)
    return groups.select("grp", "chunk_n_hands", rounded(score, 5).alias("score"), rounded(smooth_uncertain(score, 0.3, 0.7, 1.4), 5).alias("smoothed"))


_SMOOTH_SQL = "round(CASE WHEN s <= 0.3 OR s >= 0.7 THEN s ELSE 0.3 + 0.4 * pow((s - 0.3) / 0.4, 1.4) END, 5)"


@query("flagship", f"{B1_GROUPS}, hs AS (SELECT grp, chunk_n_hands, {HEURISTIC_SQL} AS s FROM cf) SELECT grp, chunk_n_hands, round(s, 5) AS score, {_SMOOTH_SQL} AS smoothed FROM hs")
def flagship(spark, d):
    """Heuristic score per group, smoothed: events to score in one plan."""
    return _slice(spark, d)


@query("g_spec", f"WITH {ORDER_EVENTS} SELECT grp, round(avg(amount), 6) AS size_mean, round(quantile_cont(amount, 0.9), 6) AS size_p90, max(stage) AS depth_max, count(*) AS depth_count FROM b1 GROUP BY 1")
def g_spec(spark, d):
    out = G.spec_features(order_events(spark, d), ("grp",), [("size", F.col("amount"), ("mean", "p90")), ("depth", F.col("stage"), ("max", "count"))])
    return out.select("grp", rounded("size_mean").alias("size_mean"), rounded("size_p90").alias("size_p90"), "depth_max", "depth_count")


@query("g_stages", f"WITH {ORDER_EVENTS} SELECT grp, " + ", ".join(f"count(*) FILTER (stage = {k}) AS s{k}" for k in range(4)) + " FROM b1 GROUP BY 1")
def g_stages(spark, d):
    return G.stage_counts(order_events(spark, d), [0, 1, 2, 3])
