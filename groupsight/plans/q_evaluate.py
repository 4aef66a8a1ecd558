"""Queries of scoring, thresholds, evaluation and rewards (E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groupsight.functions.scalars import remap, rounded, smooth_uncertain
from groupsight.operators import evaluate as E
from groupsight.operators import features as G
from groupsight.operators import reports as R
from groupsight.operators import screen as C
from groupsight.plans.q_features import B1_GROUPS, HEURISTIC_SQL, b1_groups
from groupsight.plans.registry import query
from groupsight.sources.bindings import VECTOR_SCORES, table, vector_scores

SC = f"WITH {VECTOR_SCORES}"


def sc(spark, d):
    return vector_scores(spark, d)


def r(*names, digits: int = 6):
    return [rounded(n, digits).alias(n) for n in names]


_CM = "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn"


@query("e_confusion", f"""{SC}, c AS (SELECT scorer, {_CM} FROM sc GROUP BY 1) SELECT scorer, tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) + 0.0 AS fpr FROM c""")
def e_confusion(spark, d):
    return E.confusion(sc(spark, d), ["scorer"], F.col("score") >= 0.5).select("scorer", "tn", "fp", "fn", "tp", *r("accuracy", "precision", "recall", "f1", "fpr"))


AP = """ec AS (SELECT scorer, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM {src} GROUP BY 1, 2), ew AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM ec WINDOW w AS (PARTITION BY scorer ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  ap AS (SELECT scorer, coalesce(sum(p * cp / (cp + cq)) / nullif(sum(p), 0), 0) AS ap FROM ew GROUP BY 1)"""
RW = """, cm AS (SELECT scorer, coalesce(count(*) FILTER (score > 0.5 AND label = 0) / nullif(count(*) FILTER (label = 0), 0), 0) AS fpr, coalesce(count(*) FILTER (score > 0.5 AND label = 1) / nullif(count(*) FILTER (label = 1), 0), 0) AS recall FROM {src} GROUP BY 1),
  rw AS (SELECT scorer, fpr, recall, ap, CASE WHEN fpr >= 0.1 THEN 0 ELSE pow(1 - fpr, 2) END AS penalty, 0.65 * ap + 0.35 * recall AS base FROM cm JOIN ap USING (scorer))"""


@query("e_ap", f"{SC}, {AP.format(src='sc')} SELECT scorer, round(ap, 6) AS ap FROM ap")
def e_ap(spark, d):
    return E.average_precision(sc(spark, d), ["scorer"]).select("scorer", *r("ap"))


@query("e_reward", f"{SC}, {AP.format(src='sc')}{RW.format(src='sc')} SELECT scorer, round(fpr, 6) + 0.0 AS fpr, round(recall, 6) AS recall, round(ap, 6) AS ap, round(base * penalty, 6) + 0.0 AS reward FROM rw")
def e_reward(spark, d):
    return E.reward(sc(spark, d), ["scorer"]).select("scorer", *r("fpr", "recall", "ap", "reward"))


@query("e_logloss", f"{SC} SELECT scorer, round(avg(-(label * ln(greatest(1e-15, least(1 - 1e-15, score))) + (1 - label) * ln(1 - greatest(1e-15, least(1 - 1e-15, score))))), 6) AS log_loss, round(avg(pow(score - label, 2)), 6) AS brier FROM sc GROUP BY 1")
def e_logloss(spark, d):
    return E.probability_metrics(sc(spark, d), ["scorer"]).select("scorer", *r("log_loss", "brier"))


@query("e_quantiles", f"{SC} SELECT label, round(quantile_cont(score, 0.01), 6) AS p01, round(median(score), 6) AS p50, round(quantile_cont(score, 0.99), 6) AS p99, round(avg(score), 6) AS mean FROM sc GROUP BY 1")
def e_quantiles(spark, d):
    q = lambda p: rounded(F.percentile("score", F.lit(p)))
    return sc(spark, d).groupBy("label").agg(q(0.01).alias("p01"), q(0.5).alias("p50"), q(0.99).alias("p99"), rounded(F.avg("score")).alias("mean"))


GRID = [i / 200 for i in range(201)]
_CURVE = """g AS (SELECT i / 200::DOUBLE AS t FROM range(201) x(i)), cu AS (SELECT t, count(*) FILTER (label = 1 AND score >= t) / (SELECT count(*) FROM sc WHERE label = 1)::DOUBLE AS recall, count(*) FILTER (label = 0 AND score >= t) / (SELECT count(*) FROM sc WHERE label = 0)::DOUBLE AS fpr FROM g, sc GROUP BY 1)"""


@query("e_sweep", f"{SC}, {_CURVE} SELECT round(t, 3) AS t, round(recall, 6) AS recall, round(fpr, 6) + 0.0 AS fpr FROM cu WHERE fpr <= 0.05 ORDER BY cu.recall DESC, abs(cu.t - 0.5), cu.t LIMIT 1")
def e_sweep(spark, d):
    return E.best_under_cap(E.at_thresholds(sc(spark, d), GRID), 0.05).select(rounded("t", 3).alias("t"), *r("recall", "fpr"))


@query("e_curve", f"{SC}, {_CURVE} SELECT round(t, 3) AS t, round(recall, 6) AS recall, round(fpr, 6) + 0.0 AS fpr FROM cu")
def e_curve(spark, d):
    return E.at_thresholds(sc(spark, d), GRID).select(rounded("t", 3).alias("t"), *r("recall", "fpr"))


@query("e_youden", f"{SC}, {_CURVE} SELECT round(t, 3) AS t, round(recall - fpr, 6) AS j FROM cu ORDER BY round(cu.recall - cu.fpr, 12) DESC, cu.t DESC LIMIT 1")
def e_youden(spark, d):
    return E.youden(E.at_thresholds(sc(spark, d), GRID)).select(rounded("t", 3).alias("t"), rounded(F.col("recall") - F.col("fpr")).alias("j"))


@query("e_cap", f"{SC}, {_CURVE} SELECT round(t, 3) AS t, round(recall, 6) AS recall, fpr <= 0.1 AS feasible FROM cu ORDER BY cu.fpr <= 0.1 DESC, CASE WHEN cu.fpr <= 0.1 THEN -cu.recall ELSE cu.fpr END, CASE WHEN cu.fpr <= 0.1 THEN cu.fpr ELSE -cu.recall END, abs(cu.t - 0.5), cu.t LIMIT 1")
def e_cap(spark, d):
    return E.recall_at_cap(E.at_thresholds(sc(spark, d), GRID), 0.1).select(rounded("t", 3).alias("t"), *r("recall"), "feasible")


@query("e_trial_rank", f"{SC}, m AS (SELECT scorer, domain, avg((score > 0.5)::INT = label) AS acc FROM (SELECT scorer, domain, score, label FROM sc) GROUP BY 1, 2), w AS (SELECT scorer, round(min(acc), 9) AS worst, round(avg(acc), 9) AS mean FROM m GROUP BY 1) SELECT scorer, row_number() OVER (ORDER BY worst DESC, mean DESC, scorer) AS place FROM w".replace("avg((score > 0.5)::INT = label)", "avg(((score > 0.5)::INT = label)::INT)"))
def e_trial_rank(spark, d):
    hit = ((F.col("score") > 0.5).cast("int") == F.col("label")).cast("int")
    per = sc(spark, d).groupBy("scorer", "domain").agg(F.avg(hit).alias("acc"))
    w = per.groupBy("scorer").agg(rounded(F.min("acc"), 9).alias("worst"), rounded(F.avg("acc"), 9).alias("mean"))  # a row per trial
    return w.select("scorer", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("worst"), F.desc("mean"), "scorer")).alias("place"))


@query("e_maxacc", f"{SC}, g AS (SELECT (10 + i * 5) / 100::DOUBLE AS t FROM range(17) x(i)) SELECT round(t, 3) AS t, round(acc, 6) AS accuracy FROM (SELECT t, avg(((score >= t)::INT = label)::INT) AS acc FROM g, sc GROUP BY 1) z ORDER BY round(z.acc, 12) DESC, z.t LIMIT 1")
def e_maxacc(spark, d):
    c = E.at_thresholds(sc(spark, d), [(10 + i * 5) / 100 for i in range(17)])
    c = c.withColumn("accuracy", (F.col("tp") + F.col("neg") - F.col("fp")) / (F.col("pos") + F.col("neg")))
    return E.pick(c, [], F.desc(rounded("accuracy", 12)), F.col("t")).select(rounded("t", 3).alias("t"), *r("accuracy"))


@query("e_segment", f"""{SC}, s AS (SELECT *, CASE WHEN label = 0 THEN 'neg' WHEN score < 0.4 THEN 'hard' ELSE 'easy' END AS seg FROM sc), g AS (SELECT i / 10::DOUBLE AS t FROM range(1, 10) x(i)) SELECT seg, round(t, 3) AS t, round(avg((score >= t)::INT), 6) + 0.0 AS hit FROM s, g GROUP BY seg, g.t""")
def e_segment(spark, d):
    seg = F.when(F.col("label") == 0, "neg").when(F.col("score") < 0.4, "hard").otherwise("easy")
    c = E.at_thresholds(sc(spark, d).withColumn("seg", seg), [i / 10 for i in range(1, 10)], ["seg"])
    return c.select("seg", rounded("t", 3).alias("t"), rounded((F.col("tp") + F.col("fp")) / (F.col("pos") + F.col("neg"))).alias("hit"))


@query("e_segment_block", f"""{SC}, h AS (SELECT domain AS segment, label, score, [(score >= t)::INT FOR t IN [0.15, 0.25, 0.35]] AS hs FROM sc)
  SELECT segment, label, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, CASE WHEN label = 0 THEN round(avg((score >= 0.5)::INT), 6) END AS fpr, CASE WHEN label = 1 THEN round(avg((score >= 0.5)::INT), 6) END AS recall,
  """ + ", ".join(f"CASE WHEN label = 1 THEN round(avg(hs[{i + 1}]), 6) END AS recall_{t}" for i, t in enumerate((15, 25, 35))) + " FROM h GROUP BY 1, 2")
def e_segment_block(spark, d):
    out = R.segment_blocks(sc(spark, d), "domain")
    return out.select(F.col("domain").alias("segment"), "label", "n", *r("mean", "median", "fpr", "recall"), *[rounded(F.col("recalls")[i]).alias(f"recall_{t}") for i, t in enumerate((15, 25, 35))])


@query("e_smooth", f"{SC} SELECT id, round(CASE WHEN score <= 0.3 OR score >= 0.7 THEN score ELSE 0.3 + 0.4 * pow((score - 0.3) / 0.4, 1.4) END, 6) AS s FROM sc")
def e_smooth(spark, d):
    return sc(spark, d).select("id", rounded(smooth_uncertain(F.col("score"), 0.3, 0.7, 1.4)).alias("s"))


@query("e_remap", f"{SC} SELECT id, round(CASE WHEN score <= 0.1 THEN 0.05 WHEN score >= 0.9 THEN 0.95 WHEN score <= 0.5 THEN 0.05 + (score - 0.1) / 0.4 * 0.25 ELSE 0.3 + (score - 0.5) / 0.4 * 0.65 END, 6) AS s FROM sc")
def e_remap(spark, d):
    return sc(spark, d).select("id", rounded(remap(F.col("score"), [(0.1, 0.05), (0.5, 0.3), (0.9, 0.95)])).alias("s"))


@query("e_heuristic", f"{B1_GROUPS} SELECT grp, round({HEURISTIC_SQL}, 5) AS score FROM cf")
def e_heuristic(spark, d):
    g = b1_groups(spark, d)
    return g.select("grp", rounded(G.heuristic_score(g), 5).alias("score"))


@query("e_other", f"{B1_GROUPS} SELECT grp, CASE WHEN other_ratio_mean > 0 THEN 0.0 ELSE 1.0 END AS score FROM cf")
def e_other(spark, d):
    return b1_groups(spark, d).select("grp", F.when(F.col("other_ratio_mean") > 0, 0.0).otherwise(1.0).alias("score"))


def gap_sql(source: str, out: str, min_scores: int = 10, ratio: float = 3, least: float = 0.02, share: float = 0.05, keys: str = "scorer, cycle") -> str:
    """Tables that end in out (keys, n, max_gap, median_gap, threshold): the largest gap of each group of source's scores."""
    ok = f"n >= {min_scores} AND max_gap > {ratio} * greatest(median_gap, 1e-6) AND max_gap > {least} AND low >= greatest(1, floor(n * {share})) AND n - low >= greatest(1, floor(n * {share}))"
    return f"""{out}_p AS (SELECT {keys}, score, lag(score) OVER w AS prev, score - lag(score) OVER w AS gap, row_number() OVER w - 1 AS low FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY score)),
  {out}_t AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY gap DESC NULLS LAST, low) AS rk FROM {out}_p),
  {out}_a AS (SELECT {keys}, count(*) AS n, max(gap) AS max_gap, median(gap) AS median_gap, max((prev + score) / 2) FILTER (rk = 1) AS mid, max(low) FILTER (rk = 1) AS low FROM {out}_t GROUP BY ALL),
  {out} AS (SELECT {keys}, n, max_gap, median_gap, CASE WHEN {ok} THEN mid END AS threshold FROM {out}_a)"""


_GAP = gap_sql("sc", "gg", keys="cycle")

#: Thresholds of a stream's requests: gap of the request, else of the 500 scores before it, else 0.5; clamped.
THRESHOLD_SQL = f"""{SC}, bf AS (SELECT q.scorer, q.cycle, s.score FROM (SELECT DISTINCT scorer, cycle FROM sc) q JOIN sc s ON s.scorer = q.scorer AND s.cycle < q.cycle QUALIFY row_number() OVER (PARTITION BY q.scorer, q.cycle ORDER BY s.cycle DESC, s.score DESC) <= 500),
  {gap_sql("sc", "gb")}, {gap_sql("bf", "gr")}
  SELECT scorer, cycle, round(greatest(0.1, least(0.45, coalesce(gb.threshold, gr.threshold, 0.5))), 6) AS threshold, CASE WHEN gb.threshold IS NOT NULL THEN 'gap_batch' WHEN gr.threshold IS NOT NULL THEN 'gap_rolling' ELSE 'fixed' END AS mode FROM gb LEFT JOIN gr USING (scorer, cycle)"""


@query("e_gap", f"{SC}, {_GAP} SELECT cycle, n, round(max_gap, 6) AS max_gap, round(median_gap, 6) AS median_gap, round(threshold, 6) AS threshold FROM gg")
def e_gap(spark, d):
    return E.bimodal_gap(sc(spark, d), ["cycle"]).select("cycle", "n", *r("max_gap", "median_gap", "threshold"))


@query("e_dynamic", THRESHOLD_SQL)
def e_dynamic(spark, d):
    return E.dynamic_threshold(sc(spark, d), "scorer", "cycle").select("scorer", "cycle", *r("threshold"), "mode")


@query("e_methods", f"{SC}, {_GAP} SELECT cycle, round(passive, 6) AS passive, round(coalesce(threshold, (passive + 0.5) / 2), 6) AS hybrid FROM gg JOIN (SELECT cycle, median(score) AS passive FROM sc GROUP BY 1) USING (cycle)")
def e_methods(spark, d):
    return E.threshold_methods(sc(spark, d), ["cycle"]).select("cycle", *r("passive", "hybrid"))


@query("e_mixture")
def e_mixture(spark, d):
    """One mixture for the whole table of scores."""
    rows = sc(spark, d)
    return spark.createDataFrame([(E.mixture_threshold(rows), rows.count())], "threshold double, n long")


@query("e_pick", f"{SC}, c AS (SELECT scorer, {_CM} FROM sc GROUP BY 1), m AS (SELECT scorer, tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr FROM c WHERE fp / (fp + tn) <= 0.5) SELECT scorer, row_number() OVER (ORDER BY recall DESC, fpr, scorer) AS place FROM m")
def e_pick(spark, d):
    m = E.confusion(sc(spark, d), ["scorer"], F.col("score") >= 0.5).where("fpr <= 0.5")  # a row per method
    return m.select("scorer", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("recall"), "fpr", "scorer")).alias("place"))


_LAST = "ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scorer ORDER BY cycle DESC, id DESC) AS rk FROM sc) WHERE rk <= 40)"
_WR = f"{SC}, {_LAST}, {AP.format(src='ls')}{RW.format(src='ls')}, wr AS (SELECT scorer, CASE WHEN (SELECT count(*) FROM ls l WHERE l.scorer = rw.scorer) >= 40 THEN base * penalty ELSE 0 END AS reward FROM rw)"


#: Events as answers: a user answers in daily cycles, 3 answers are expected in each, a cycle's latency is its first value.
ANSWERS_SQL = """an AS (SELECT user_id, CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS cycle, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS position, value FROM events),
  ex AS (SELECT DISTINCT cycle, CAST(2 + cycle % 3 AS INTEGER) AS expected FROM an), us AS (SELECT DISTINCT user_id FROM events), ke AS (SELECT an.* FROM an JOIN ex USING (cycle) WHERE position < expected),
  cv AS (SELECT us.user_id, ex.cycle, coalesce(n / expected::DOUBLE, 0) AS coverage FROM us CROSS JOIN ex LEFT JOIN (SELECT user_id, cycle, count(*) AS n FROM ke GROUP BY 1, 2) c ON c.user_id = us.user_id AND c.cycle = ex.cycle)"""


def answered(spark, d):
    e = table(spark, d, "events").withColumn("cycle", F.floor(F.unix_timestamp(F.date_trunc("day", "ts")) / 86400))
    e = e.withColumn("position", F.row_number().over(Window.partitionBy("user_id", "cycle").orderBy("ts", "event_id")) - 1).select("user_id", "cycle", "position", "value")
    expected = e.select("cycle").distinct().withColumn("expected", (2 + F.col("cycle") % 3).cast("int"))
    return E.answers(e, expected, e.select("user_id"), "user_id", "cycle", "position")


@query("e_windowed", f"{_WR} SELECT scorer, round(reward, 6) + 0.0 AS reward FROM wr")
def e_windowed(spark, d):
    return E.windowed_reward(sc(spark, d), "scorer", ["cycle", "id"]).select("scorer", *r("reward"))


@query("e_windowed_full", f"""WITH {ANSWERS_SQL}, pr AS (SELECT user_id AS scorer, cycle, position, round(value / 500, 6) AS score, (value > 230)::INT AS label FROM ke), ls AS (SELECT *, row_number() OVER (PARTITION BY scorer ORDER BY cycle DESC, position DESC) AS rk FROM pr QUALIFY rk <= 40),
  cr AS (SELECT user_id AS scorer, avg(coverage) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cycle DESC) AS rk FROM cv) WHERE rk <= 40 GROUP BY 1), lt AS (SELECT scorer, cycle, max(score) FILTER (position = 0) AS latency FROM pr GROUP BY 1, 2),
  lr AS (SELECT scorer, avg(latency) AS latency FROM (SELECT *, row_number() OVER (PARTITION BY scorer ORDER BY cycle DESC) AS rk FROM lt WHERE latency > 0.1) WHERE rk <= 40 GROUP BY 1),
  {AP.format(src='ls')}{RW.format(src='ls')}, sa AS (SELECT scorer, count(*) AS samples FROM ls GROUP BY 1)
  SELECT scorer, coalesce(samples, 0) AS samples, CASE WHEN samples >= 40 THEN round(base * penalty, 6) + 0.0 ELSE 0 END AS reward, round(coverage, 6) AS coverage, round(latency, 6) AS latency FROM cr LEFT JOIN sa USING (scorer) LEFT JOIN rw USING (scorer) LEFT JOIN lr USING (scorer)""")
def e_windowed_full(spark, d):
    """Answers cut to what was expected, rewards of the last 40, mean coverage and latency of the last 40 cycles."""
    kept, coverage = answered(spark, d)
    p = kept.select(F.col("user_id").alias("scorer"), "cycle", "position", rounded(F.col("value") / 500).alias("score"), (F.col("value") > 230).cast("int").alias("label"))
    latency = p.groupBy("scorer", "cycle").agg(F.max(F.when(F.col("position") == 0, F.col("score"))).alias("l")).withColumn("latency", F.when(F.col("l") > 0.1, F.col("l")))
    responses = coverage.withColumnRenamed("user_id", "scorer").join(latency.drop("l"), ["scorer", "cycle"], "left")
    return E.windowed_reward(p, "scorer", ["cycle", "position"], responses=responses).select("scorer", "samples", *r("reward", "coverage", "latency"))


def _rewards(spark, d):
    return sc(spark, d).groupBy("scorer").agg(rounded(F.avg(F.col("score") * F.col("label")), 9).alias("reward"))


_RWD = "rd AS (SELECT scorer, round(avg(score * label), 9) AS reward FROM sc GROUP BY 1)"
_POD = "pd AS (SELECT scorer, row_number() OVER (ORDER BY reward DESC, scorer) AS place FROM rd WHERE reward > 0)"


@query("e_podium", f"{SC}, {_RWD}, {_POD} SELECT 0 AS scorer, CASE WHEN (SELECT count(*) FROM pd) > 0 THEN 0.97 ELSE 1.0 END AS weight UNION ALL SELECT scorer, round(0.03::DOUBLE * CASE place WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END, 6) FROM pd WHERE place <= 3")
def e_podium(spark, d):
    return E.podium(_rewards(spark, d), "scorer").select("scorer", *r("weight"))


@query("e_weights", f"{SC}, {_RWD}, w AS (SELECT scorer, CASE scorer WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE reward END AS c FROM rd) SELECT scorer, round(c / sum(c) OVER (), 6) + 0.0 AS share, CAST(round_even(c / sum(c) OVER () * 65535, 0) AS BIGINT) AS units FROM w")
def e_weights(spark, d):
    w = _rewards(spark, d).withColumn("weight", F.when(F.col("scorer") == 2, float("nan")).when(F.col("scorer") == 3, -1.0).otherwise(F.col("reward")))
    return E.normalized_weights(w).select("scorer", *r("share"), "units")


@query("e_settle", f"{SC}, {_RWD}, ok AS (SELECT * FROM rd WHERE scorer BETWEEN 1 AND 5) SELECT scorer, round(0.9::DOUBLE * reward / sum(reward) OVER (), 6) AS weight FROM ok UNION ALL SELECT 0, 0.1")
def e_settle(spark, d):
    given = E.normalized_weights(_rewards(spark, d).where(F.col("scorer").between(1, 5)).withColumnRenamed("reward", "weight"))
    kept = spark.range(1).select(F.col("id").alias("scorer"), F.lit(0.1).alias("weight"))
    return given.select("scorer", rounded(0.9 * F.col("share")).alias("weight")).union(kept)


@query("e_ema", f"{SC}, rd AS (SELECT scorer, cycle, avg(score * label) AS reward FROM sc GROUP BY 1, 2) SELECT scorer, round(sum(reward * 0.1::DOUBLE * pow(0.9::DOUBLE, (SELECT max(cycle) FROM rd) - cycle)), 6) AS ema FROM rd GROUP BY 1")
def e_ema(spark, d):
    rd = sc(spark, d).groupBy("scorer", "cycle").agg(F.avg(F.col("score") * F.col("label")).alias("reward"))
    return E.ema_scores(rd, "scorer", "cycle").select("scorer", *r("ema"))


@query("e_leader", f"{SC}, {_RWD} SELECT scorer, round(reward, 6) AS reward, n_name AS name, row_number() OVER (ORDER BY reward DESC, scorer) AS place, n FROM rd LEFT JOIN nation ON scorer = n_nationkey AND n_regionkey < 3 JOIN (SELECT scorer, count(*) AS n FROM sc GROUP BY 1) USING (scorer)")
def e_leader(spark, d):
    names = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("scorer"), F.col("n_name").alias("name"))
    out = C.leaderboard(_rewards(spark, d), names, "scorer", sc(spark, d).groupBy("scorer").agg(F.count("*").alias("n")))
    return out.select("scorer", *r("reward"), "name", "place", "n")


@query("e_gates", f"{SC}, c AS (SELECT domain, {_CM} FROM sc GROUP BY 1) SELECT domain, tp / (tp + fn) >= 0.5 AS recall_ok, fp / (fp + tn) <= 0.5 AS fpr_ok, (SELECT bool_and(tp / (tp + fn) >= 0.5 AND fp / (fp + tn) <= 0.5) FROM c) AS release FROM c")
def e_gates(spark, d):
    c = E.confusion(sc(spark, d), ["domain"], F.col("score") >= 0.5)
    return R.release_gates(c, {"recall": ("min", 0.5), "fpr": ("max", 0.5)}).select("domain", "recall_ok", "fpr_ok", "release")


_ENS = "round((score + least(1, score * 1.1)) / 2, 9)"


@query("e_pseudo", f"{SC}, e AS (SELECT id, {_ENS} AS mean, abs(score - least(1, score * 1.1)) AS gap FROM sc) SELECT id, round(mean, 6) AS mean, CASE WHEN mean >= 0.8 AND gap < 0.1 THEN 1 WHEN mean <= 0.2 AND gap < 0.1 THEN 0 END AS label, round(CASE WHEN (mean >= 0.8 OR mean <= 0.2) AND gap < 0.1 THEN abs(mean - 0.5) * 2 ELSE 0 END, 6) + 0.0 AS weight FROM e")
def e_pseudo(spark, d):
    out = C.pseudo_labels(sc(spark, d).drop("label"), [F.col("score"), F.least(F.lit(1.0), F.col("score") * 1.1)])
    return out.select("id", *r("mean"), "label", *r("weight"))


@query("e_cluster_pseudo", f"{SC}, m AS (SELECT scorer, (avg(label) >= 0.5)::INT AS label FROM sc WHERE scorer <> 6 GROUP BY 1) SELECT id, m.label, round(0.15 * score, 6) AS sample_weight FROM sc JOIN m USING (scorer) WHERE score >= 0.55")
def e_cluster_pseudo(spark, d):
    return C.cluster_labels(sc(spark, d), "scorer", "score", "label", noise=6).select("id", "label", *r("sample_weight"))


@query("e_cluster_quality", f"""{SC}, m AS (SELECT scorer, (avg(label) >= 0.5)::INT AS mj FROM sc WHERE scorer <> 6 GROUP BY 1), h AS (SELECT label, (mj = label)::INT AS hit FROM sc JOIN m USING (scorer))
  SELECT round((SELECT avg((scorer <> 6)::INT) FROM sc), 6) AS coverage, round((SELECT avg((scorer = 6)::INT) FROM sc), 6) AS noise_share, round(avg(hit), 6) AS accuracy, round((avg(hit) FILTER (label = 0) + avg(hit) FILTER (label = 1)) / 2, 6) AS balanced_accuracy FROM h""")
def e_cluster_quality(spark, d):
    return C.cluster_majority(sc(spark, d), "scorer", "label", 6).select(*r("coverage", "noise_share", "accuracy", "balanced_accuracy"))


@query("e_tail_labels", f"{SC} SELECT id, CASE WHEN score <= 0.25 THEN 0 WHEN score >= 0.75 THEN 1 END AS label FROM sc WHERE score <= 0.25 OR score >= 0.75")
def e_tail_labels(spark, d):
    label = F.when(F.col("score") <= 0.25, 0).when(F.col("score") >= 0.75, 1)
    return sc(spark, d).select("id", label.alias("label")).where("label IS NOT NULL")


@query("e_majority", f"{SC}, m AS (SELECT scorer, (avg(label) >= 0.5)::INT AS class, count(*) AS n FROM sc WHERE scorer < 6 GROUP BY 1) SELECT class, CAST(sum(n) AS BIGINT) AS n, (SELECT round(avg((scorer = 6)::INT), 6) FROM sc) AS noise_share FROM m GROUP BY 1")
def e_majority(spark, d):
    s = sc(spark, d)
    noise = s.agg(rounded(F.avg((F.col("scorer") == 6).cast("int"))).alias("noise_share"))  # one row
    m = s.where("scorer < 6").groupBy("scorer").agg((F.avg("label") >= 0.5).cast("int").alias("class"), F.count("*").alias("n"))
    return m.groupBy("class").agg(F.sum("n").alias("n")).join(F.broadcast(noise), F.lit(True))


@query("e_grid", f"""{SC}, g AS (SELECT DISTINCT cycle, scorer FROM sc), c AS (SELECT scorer, {_CM}, count(DISTINCT cycle) AS cycles FROM sc GROUP BY 1), m AS (SELECT scorer, fp / (fp + tn) AS noise, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced, tp + fp AS covered, cycles FROM c WHERE tp + fn >= 20)
  SELECT scorer, row_number() OVER (ORDER BY round(noise, 9), round(balanced, 9) DESC, covered DESC, cycles, scorer) AS place FROM m""")
def e_grid(spark, d):
    """Scorers as grid points: least noise, then balanced accuracy, coverage, fewest cycles."""
    c = E.confusion(sc(spark, d), ["scorer"], F.col("score") >= 0.5).join(sc(spark, d).groupBy("scorer").agg(F.count_distinct("cycle").alias("cycles")), "scorer")
    balanced = F.round((F.col("recall") + 1 - F.col("fpr")) / 2, 9)
    return R.grid_select(c, F.col("tp") + F.col("fn") >= 20, F.round("fpr", 9), F.desc(balanced), F.desc(F.col("tp") + F.col("fp")), "cycles", "scorer").select("scorer", "place")


@query("e_strategies", f"""{SC}, c AS (SELECT scorer, {_CM}, count(*) FILTER (score >= 0.25 AND label = 1) AS low, count(*) FILTER (score >= 0.6 AND label = 0) AS other FROM sc GROUP BY 1),
  m AS (SELECT scorer AS trial, 100 * tp / (tp + fn) AS recall, 100 * fp / (fp + tn) AS fpr, CASE WHEN scorer = 3 THEN 99 ELSE 100 * other / (fp + tn) END AS other_fpr, 100 * low / (tp + fn) AS low_recall FROM c),
  s AS (SELECT trial, CASE WHEN trial = 5 THEN -1 ELSE round(recall + 0.1 * low_recall - 5 * greatest(0, fpr - 20) - 2 * greatest(0, other_fpr - 10), 6) END AS strategy_score FROM m) SELECT trial, strategy_score + 0.0 AS strategy_score, row_number() OVER (ORDER BY strategy_score DESC, trial) AS place FROM s""")
def e_strategies(spark, d):
    """Scorers as strategies, one without its other rate, one that failed."""
    neg, pos = F.col("label") == 0, F.col("label") == 1
    share = lambda t, side: 100 * F.count_if((F.col("score") >= t) & side) / F.count_if(side)
    t = sc(spark, d).groupBy(F.col("scorer").alias("trial")).agg(share(0.5, pos).alias("recall"), share(0.5, neg).alias("fpr"), share(0.6, neg).alias("other_fpr"), share(0.25, pos).alias("low_recall"))
    t = t.withColumns({"other_fpr": F.when(F.col("trial") != 3, F.col("other_fpr")), "error": F.when(F.col("trial") == 5, "failed")})
    t = t.withColumns({c: rounded(c, 9) for c in ("recall", "fpr", "other_fpr", "low_recall")})
    return R.strategy_scores(t, 20.0, 10.0).select("trial", *r("strategy_score"), "place")


@query("e_total", f"{SC} SELECT id, label, 1.0 AS sample_weight FROM sc WHERE id % 2 = 0 UNION ALL SELECT id, (score > 0.5)::INT, round(abs(score - 0.5), 6) + 0.0 FROM sc WHERE id % 2 = 1")
def e_total(spark, d):
    gold = sc(spark, d).where("id % 2 = 0").select("id", "label", F.lit(1.0).alias("sample_weight"))
    pseudo = sc(spark, d).where("id % 2 = 1").select("id", (F.col("score") > 0.5).cast("int").alias("label"), rounded(F.abs(F.col("score") - 0.5)).alias("sample_weight"))
    return gold.unionByName(pseudo)


@query("e_served", "SELECT user_id, count(*) AS served, min(event_id) AS first_cycle, max(event_id) AS last_cycle, count(*) - 1 AS repeats FROM events GROUP BY 1")
def e_served(spark, d):
    return R.served_counts(table(spark, d, "events"), "user_id", "event_id")


#: What a day of a user is suspected of.
_REASONS = """sp AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(epoch(CAST(ts AS DATE)) / 86400 AS BIGINT) AS cycle, count(*) FILTER (value > 300) AS a, count(*) FILTER (event_type = 'error') AS b, count(*) FILTER (value < 20) AS c FROM events GROUP BY 1, 2, 3),
  rs AS (SELECT user_id, cycle, list_filter([CASE WHEN a > 1 THEN 'many_high' END, CASE WHEN b > 0 THEN 'error' END, CASE WHEN c > 0 THEN 'low' END], lambda x: x IS NOT NULL) AS reasons FROM sp)"""


def _reasons(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("cycle")).agg(
        F.count_if(F.col("value") > 300).alias("a"), F.count_if(F.col("event_type") == "error").alias("b"), F.count_if(F.col("value") < 20).alias("c"))
    return e.select("user_id", "cycle", F.filter(F.array(F.when(F.col("a") > 1, "many_high"), F.when(F.col("b") > 0, "error"), F.when(F.col("c") > 0, "low")), lambda x: x.isNotNull()).alias("reasons"))


@query("e_violations", f"""WITH {_REASONS}, ev AS (SELECT * FROM rs WHERE len(reasons) > 0), ct AS (SELECT user_id, r, count(*) AS n FROM (SELECT user_id, unnest(reasons) AS r FROM ev) GROUP BY 1, 2), cs AS (SELECT user_id, string_agg(r || ':' || n, ' ' ORDER BY r) AS counts FROM ct GROUP BY 1)
  SELECT user_id, least(count(*), 8) AS events, max(cycle) AS last_cycle, arg_max(array_to_string(list_sort(reasons), '|'), cycle) AS last_reasons, any_value(counts) AS counts FROM ev JOIN cs USING (user_id) GROUP BY 1""")
def e_violations(spark, d):
    s = R.suspicion(_reasons(spark, d), "user_id", "cycle", "reasons", last=8)
    shown = F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), " ")
    return s.select("user_id", "events", "last_cycle", F.array_join("last_reasons", "|").alias("last_reasons"), shown.alias("counts"))


@query("e_last_events", f"WITH {_REASONS} SELECT user_id, cycle FROM rs WHERE len(reasons) > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cycle DESC) <= 8")
def e_last_events(spark, d):
    return R.last_events(_reasons(spark, d), "user_id", "cycle", "reasons", last=8).select("user_id", "cycle")


_STATUS = f"WITH {_REASONS}, st AS (SELECT user_id, cycle, CASE WHEN len(reasons) > 1 THEN 'opaque' ELSE 'transparent' END AS status FROM rs)"


def _statuses(spark, d):
    return _reasons(spark, d).select("user_id", "cycle", F.when(F.size("reasons") > 1, "opaque").otherwise("transparent").alias("status"))


@query("e_status_changes", f"{_STATUS} SELECT user_id, cycle, status, lag(status) OVER w AS previous, status IS DISTINCT FROM lag(status) OVER w AS changed FROM st WINDOW w AS (PARTITION BY user_id ORDER BY cycle)")
def e_status_changes(spark, d):
    return R.status_changes(_statuses(spark, d), "user_id", "cycle", "status")


@query("e_compliance", f"{_STATUS}, la AS (SELECT user_id, arg_max(status, cycle) AS s, max(cycle) AS c FROM st GROUP BY 1) SELECT count(*) AS tracked, count(*) FILTER (s = 'transparent') AS transparent, count(*) FILTER (s = 'opaque') AS opaque, max(c) AS last_cycle FROM la")
def e_compliance(spark, d):
    return R.compliance_summary(_statuses(spark, d), "user_id", "cycle", "status")


@query("e_diag", f"{SC} SELECT cycle, round(min(score), 6) AS low, round(max(score), 6) AS high, round(stddev_pop(score), 6) AS std, count(*) FILTER (score < 0.2) AS near_floor, count(*) FILTER (score > 0.8) AS near_ceiling, sha256(string_agg((score > 0.5)::INT::VARCHAR, '' ORDER BY id)) AS digest FROM sc GROUP BY 1")
def e_diag(spark, d):
    return R.score_diagnostics(sc(spark, d), "cycle", "id").select("cycle", *r("low", "high", "std"), "near_floor", "near_ceiling", "digest")


@query("e_load", "SELECT user_id, p95, CASE WHEN p95 > 450 THEN 'extreme' WHEN p95 > 400 THEN 'high' ELSE 'normal' END AS state FROM (SELECT user_id, list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS INTEGER) + 1] AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk <= 50 GROUP BY 1)")
def e_load(spark, d):
    return C.load_state(table(spark, d, "events"), "user_id", "value", [F.desc("ts"), F.desc("event_id")])
