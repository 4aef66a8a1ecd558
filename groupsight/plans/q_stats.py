"""Queries of transforms and statistics (T, S, W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groupsight.functions.scalars import rounded
from groupsight.operators import reports as R
from groupsight.operators import screen as C
from groupsight.operators import stats as S
from groupsight.operators import transform as T
from groupsight.operators.ordered import rolling_quantile, rolling_quantiles
from groupsight.operators.sampling import sorted_places
from groupsight.plans.registry import query
from groupsight.sources.bindings import DOCUMENT_FEATURE_NAMES as DF
from groupsight.sources.bindings import VECTOR_NAMES as FS
from groupsight.sources.bindings import DOCUMENT_FEATURES, ORDER_EVENTS, document_features, order_events, table, vector_features, vector_scores, vector_sql
from groupsight.sources.store import cut

B5, B4 = f"WITH {vector_sql()}", f"WITH {DOCUMENT_FEATURES}"
LONG = "lf AS (" + " UNION ALL ".join(f"SELECT id, domain, label, '{c}' AS feature, {c} AS value FROM b5" for c in FS) + ")"
DLONG = "lf AS (" + " UNION ALL ".join(f"SELECT id, domain, label, '{c}' AS feature, {c} AS value FROM b4 WHERE label IS NOT NULL" for c in DF) + ")"


def v(spark, d):
    return vector_features(spark, d)


def docs(spark, d):
    return document_features(spark, d).where("label IS NOT NULL")


def r(*names, digits: int = 6):
    return [rounded(n, digits).alias(n) for n in names]


def rs(*names, digits: int = 6):
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


_TRAIN = "(SELECT * FROM b5 WHERE id % 5 <> 0)"


@query("t_clip", f"{B5}, q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.05) AS {c}_a, quantile_cont({c}, 0.95) AS {c}_b" for c in FS) + f" FROM {_TRAIN}) SELECT id, " + ", ".join(f"round(greatest({c}_a, least({c}_b, {c})), 6) + 0.0 AS {c}" for c in FS) + " FROM b5, q")
def t_clip(spark, d):
    return T.clip_apply(v(spark, d), T.clip_fit(v(spark, d).where("id % 5 <> 0"), FS, 0.05, 0.95)).select("id", *r(*FS))


@query("t_log1p", f"{B4} SELECT id, " + ", ".join(f"round(ln(1 + {c}), 6) AS {c}" for c in DF) + " FROM b4")
def t_log1p(spark, d):
    x = document_features(spark, d)
    return T.log1p_apply(x, T.log1p_fit(x, DF)).select("id", *r(*DF))


@query("t_robust", f"{B5}, q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, median({c}) AS {c}_m, quantile_cont({c}, 0.75) AS {c}_b" for c in FS) + f" FROM {_TRAIN}) SELECT id, " + ", ".join(f"round(({c} - {c}_m) / ({c}_b - {c}_a), 6) + 0.0 AS {c}" for c in FS) + " FROM b5, q")
def t_robust(spark, d):
    return T.robust_apply(v(spark, d), T.robust_fit(v(spark, d).where("id % 5 <> 0"), FS)).select("id", *r(*FS))


@query("t_absclip", f"{B5} SELECT id, " + ", ".join(f"round(greatest(-0.1, least(0.1, {c})), 6) + 0.0 AS {c}" for c in FS) + " FROM b5")
def t_absclip(spark, d):
    return T.abs_clip(v(spark, d), FS, 0.1).select("id", *r(*FS))


@query("t_fill", f"{B5}, h AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE f0 END AS f0 FROM b5) SELECT id, round(coalesce(f0, (SELECT median(f0) FROM h)), 6) + 0.0 AS f0 FROM h")
def t_fill(spark, d):
    h = v(spark, d).select("id", F.when(F.col("id") % 7 != 0, F.col("f0")).alias("f0"))
    return T.fill_apply(h, T.fill_fit(h, ["f0"])).select("id", *r("f0"))


def _pipe_sql() -> str:
    c1 = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_a, quantile_cont({c}, 0.99) AS {c}_b" for c in DF)
    x1 = ", ".join(f"ln(1 + greatest({c}_a, least({c}_b, {c}))) AS {c}" for c in DF)
    c2 = ", ".join(f"median({c}) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_i" for c in DF)
    x2 = ", ".join(f"round(greatest(-10, least(10, ({c} - {c}_m) / CASE WHEN {c}_i = 0 THEN 1 ELSE {c}_i END)), 5) + 0.0 AS {c}" for c in DF)
    return f"{B4}, q AS (SELECT {c1} FROM b4 WHERE id % 5 <> 0), l AS (SELECT id, {x1} FROM b4, q), p AS (SELECT {c2} FROM l WHERE id % 5 <> 0) SELECT id, {x2} FROM l, p"


@query("t_pipeline", _pipe_sql())
def t_pipeline(spark, d):
    x = cut(document_features(spark, d), "document_features")  # fitted on in several passes
    return T.pipeline_apply(x, T.pipeline_fit(x.where("id % 5 <> 0"), DF)).select("id", *r(*DF, digits=5))


_BUCKET = "greatest(2, least(10, {0}(5 + 4 * f7)))"


@query("t_group_z", f"""{B5}, x AS (SELECT *, {_BUCKET.format('floor')} AS bk FROM b5), s AS (SELECT bk, avg(f0) AS m, stddev_samp(f0) AS sd FROM x WHERE id % 5 <> 0 GROUP BY 1 HAVING count(*) >= 30),
  g AS (SELECT avg(f0) AS gm, stddev_samp(f0) AS gs FROM x WHERE id % 5 <> 0) SELECT id, round((f0 - coalesce(m, gm)) / coalesce(sd, gs), 6) + 0.0 AS f0 FROM x LEFT JOIN s USING (bk), g""")
def t_group_z(spark, d):
    bucket = F.greatest(F.lit(2), F.least(F.lit(10), F.floor(5 + 4 * F.col("f7"))))
    return T.group_zscore(v(spark, d), v(spark, d).where("id % 5 <> 0"), bucket, ["f0"], 30).select("id", *r("f0"))


@query("t_standard", f"{B5}, q AS (SELECT avg(f0) AS m, stddev_pop(f0) AS s FROM {_TRAIN}) SELECT id, round((f0 - m) / s, 6) + 0.0 AS f0 FROM b5, q")
def t_standard(spark, d):
    return T.standardize(v(spark, d), v(spark, d).where("id % 5 <> 0"), ["f0"]).select("id", *r("f0"))


_D = ("count", "missing", "mean", "std", "min", "q25", "q50", "q75", "max")


@query("s_describe", f"""{B5}, {LONG} SELECT feature, count(*)::DOUBLE AS count, 0::DOUBLE AS missing, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) + 0.0 AS min,
  round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(value, 0.5), 6) + 0.0 AS q50, round(quantile_cont(value, 0.75), 6) + 0.0 AS q75, round(max(value), 6) + 0.0 AS max FROM lf GROUP BY 1""")
def s_describe(spark, d):
    return S.describe(v(spark, d), FS).select("feature", *r(*_D))


@query("s_profile", f"{B5}, {LONG} SELECT feature, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.1), 6) + 0.0 AS p10, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.9), 6) + 0.0 AS p90 FROM lf GROUP BY 1")
def s_profile(spark, d):
    return S.profile(v(spark, d), FS).select("feature", *r("mean", "std", "p10", "p50", "p90"))


@query("s_report", f"""{B4}, {DLONG} SELECT feature, 0::DOUBLE AS n_missing, count(*)::DOUBLE AS n_finite, count(DISTINCT value)::DOUBLE AS n_unique, round(stddev_pop(value), 4) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
  count(DISTINCT value) <= 1 AS constant, stddev_pop(value) < 1e-8 AS near_constant FROM lf GROUP BY 1""")
def s_report(spark, d):
    return S.feature_report(docs(spark, d), DF).select("feature", "n_missing", "n_finite", "n_unique", *r("std", digits=4), *r("min", "max"), "constant", "near_constant")


@query("s_dupcols", f"{B5} " + "SELECT x.feature, x.same_as FROM (SELECT unnest([" + ", ".join(f"{{'feature': '{b}', 'same_as': '{a}', 'same': bool_and({a} IS NOT DISTINCT FROM {'f1' if b == 'f1b' else b})}}" for i, a in enumerate(FS) for b in [*FS[i + 1 :], "f1b"]) + "]) AS x FROM b5) WHERE x.same")
def s_dupcols(spark, d):
    return S.duplicate_columns(v(spark, d).withColumn("f1b", F.col("f1")), "id", [*FS, "f1b"])


@query("s_corr", f"{B5} " + "SELECT x.a AS a, x.b AS b, round(x.r, 6) + 0.0 AS r, n FROM (SELECT count(*) AS n, unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': corr({a}, {b})}}" for i, a in enumerate(FS) for b in FS[i + 1 :]) + "]) AS x FROM b5)")
def s_corr(spark, d):
    return S.correlations(v(spark, d), FS).select("a", "b", *r("r"), "n")


def _ks_sql(side: str, keys: str = "feature") -> str:
    return f"""kc AS (SELECT {keys}, value, count(*) FILTER ({side}) AS a, count(*) FILTER (NOT ({side})) AS b FROM lf GROUP BY ALL),
  kw AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY {keys}) AS na, sum(b) OVER (PARTITION BY {keys}) AS nb FROM kc WINDOW w AS (PARTITION BY {keys} ORDER BY value ROWS UNBOUNDED PRECEDING)),
  ksd AS (SELECT {keys}, max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS ks, CAST(any_value(na) AS BIGINT) AS n_a, CAST(any_value(nb) AS BIGINT) AS n_b FROM kw GROUP BY ALL)"""


@query("s_ks", f"{B5}, {LONG}, {_ks_sql('domain = 0')} SELECT feature, round(ks, 6) AS ks, n_a, n_b FROM ksd")
def s_ks(spark, d):
    return S.ks(v(spark, d), FS, F.col("domain") == 0).select("feature", *r("ks"), "n_a", "n_b")


@query("s_ks_p")
def s_ks_p(spark, d):
    out = S.ks(v(spark, d), FS, F.col("domain") == 0)
    return out.withColumn("p_value", S.ks_pvalue(F.col("ks"), F.col("n_a"), F.col("n_b")))


_ANOVA = """pc AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM lf GROUP BY 1, 2), pw AS (SELECT feature, sum(n) AS total, sum(n * m) / sum(n) AS mean, count(*) AS k FROM pc GROUP BY 1),
  an AS (SELECT feature, (sum(n * pow(m - mean, 2)) / (any_value(k) - 1)) / (sum(n * v) / (any_value(total) - any_value(k))) AS f, any_value(k) - 1 AS df_between, CAST(any_value(total) - any_value(k) AS BIGINT) AS df_within, CAST(any_value(total) AS BIGINT) AS n FROM pc JOIN pw USING (feature) GROUP BY 1)"""


@query("s_anova", f"{B5}, {LONG}, {_ANOVA} SELECT feature, round(f, 6) AS f, df_between, df_within, n FROM an")
def s_anova(spark, d):
    return S.anova(v(spark, d), FS, "label").select("feature", *r("f"), "df_between", "df_within", "n")


def _pvalues(spark, d):
    return S.anova(v(spark, d), FS, "label").withColumn("p_value", S.anova_pvalue("f", F.col("df_between").cast("double"), F.col("df_within").cast("double")))


@query("s_anova_p")
def s_anova_p(spark, d):
    return _pvalues(spark, d)


_P = "1 / (1 + 40 * ks)"


@query("s_fdr", f"""{B5}, {LONG}, {_ks_sql('domain = 0')}, p AS (SELECT feature, {_P} AS p, row_number() OVER (ORDER BY {_P}, feature) AS rk, count(*) OVER () AS n FROM ksd)
  SELECT feature, round(p, 6) AS p_value, round(least(1, min(p * n / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_fdr_bh, p < 0.05 / n AS sig_bonferroni, p < 0.05 AS sig_p FROM p""")
def s_fdr(spark, d):
    p = S.ks(v(spark, d), FS, F.col("domain") == 0).withColumn("p_value", 1 / (1 + 40 * F.col("ks")))
    return S.multiple_tests(p).select("feature", *r("p_value", "p_fdr_bh"), "sig_bonferroni", "sig_p")


_COMPOSITE = "cs AS (SELECT feature, (ln(1 + f) - min(ln(1 + f)) OVER ()) / (max(ln(1 + f)) OVER () - min(ln(1 + f)) OVER ()) AS task_score, ks AS shift_score FROM an JOIN ksd USING (feature))"


@query("s_composite", f"{B5}, {LONG}, {_ANOVA}, {_ks_sql('domain = 0')}, {_COMPOSITE} SELECT feature, {rs('task_score', 'shift_score')}, round(0.65 * task_score + 0.35 * (1 - shift_score), 6) AS keep_score FROM cs")
def s_composite(spark, d):
    return S.composite_scores(S.anova(v(spark, d), FS, "label"), S.ks(v(spark, d), FS, F.col("domain") == 0)).select("feature", *r("task_score", "shift_score", "keep_score"))


@query("s_cohen", f"""{B5}, {LONG}, p AS (SELECT feature, domain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM lf GROUP BY 1, 2) SELECT a.feature, round(max(abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))), 6) AS max_d,
  round((SELECT max(m) - min(m) FROM p q WHERE q.feature = a.feature), 6) AS mean_range FROM p a JOIN p b ON a.feature = b.feature AND a.domain < b.domain GROUP BY a.feature""")
def s_cohen(spark, d):
    return S.cohen_d(v(spark, d), FS, "domain").select("feature", *r("max_d", "mean_range"))


_AUC = """ac AS (SELECT feature, value, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM lf GROUP BY 1, 2),
  aw AS (SELECT *, sum(q) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) - q AS below FROM ac), au AS (SELECT feature, sum(p * (below + q / 2::DOUBLE)) / (sum(p)::DOUBLE * sum(q)) AS auc FROM aw GROUP BY 1)"""


@query("s_auc", f"{B5}, {LONG}, {_AUC} SELECT feature, round(auc, 6) AS auc FROM au")
def s_auc(spark, d):
    return S.auc(v(spark, d), FS, "label").select("feature", *r("auc"))


@query("s_auc_docs", f"{B4}, {DLONG}, {_AUC} SELECT feature, round(auc, 6) AS auc FROM au")
def s_auc_docs(spark, d):
    return S.auc(docs(spark, d), DF, "label").select("feature", *r("auc"))


_CORR = "co AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, label)) AS abs_corr FROM b5" for c in FS) + ")"


@query("s_rank", f"{B5}, {LONG}, {_AUC}, {_ks_sql('domain = 0')}, {_CORR} SELECT feature, round(2 * abs(auc - 0.5), 6) AS auc_strength, round(ks, 6) AS ks, round(abs_corr, 6) AS abs_corr, round(0.5 * 2 * abs(auc - 0.5) + 0.3 * abs_corr - 0.2 * ks, 6) + 0.0 AS rank_score FROM au JOIN ksd USING (feature) JOIN co USING (feature)")
def s_rank(spark, d):
    return S.feature_ranking(v(spark, d), FS, "label", F.col("domain") == 0).select("feature", *r("auc_strength", "ks", "abs_corr", "rank_score"))


_SELECT = "CASE WHEN ks >= 0.2 THEN 'drop' WHEN auc BETWEEN 0.45 AND 0.55 THEN 'watch' ELSE 'keep' END"


@query("s_select", f"{B5}, {LONG}, {_AUC}, {_ks_sql('domain = 0')} SELECT feature, {_SELECT} AS verdict FROM au JOIN ksd USING (feature)")
def s_select(spark, d):
    j = S.auc(v(spark, d), FS, "label").join(S.ks(v(spark, d), FS, F.col("domain") == 0), "feature")
    return C.select_features(j)


@query("s_recommend", f"""{B5}, {LONG}, {_AUC}, {_ks_sql('domain = 0')}, j AS (SELECT feature, ks, abs(auc - 0.5) AS s FROM au JOIN ksd USING (feature)), q AS (SELECT quantile_cont(ks, 0.75) AS hk, median(s) AS hs FROM j)
  SELECT feature, CASE WHEN ks >= hk THEN 'high' ELSE 'low' END || '_shift_' || CASE WHEN s >= hs THEN 'strong' ELSE 'weak' END AS kind FROM j, q""")
def s_recommend(spark, d):
    return C.recommend(S.auc(v(spark, d), FS, "label").join(S.ks(v(spark, d), FS, F.col("domain") == 0), "feature"))


@query("s_prefilter")
def s_prefilter(spark, d):
    x = v(spark, d).withColumn("twice", 2 * F.col("f0"))
    report = S.feature_report(x, [*FS, "twice"]).where("NOT near_constant").orderBy("feature")
    kept = S.greedy_uncorrelated([q.feature for q in report.collect()], S.correlations(x, [*FS, "twice"]), 0.95)  # a row per feature
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@query("s_diverse")
def s_diverse(spark, d):
    x = v(spark, d)
    ranked = [q.feature for q in S.feature_ranking(x, FS, "label", F.col("domain") == 0).orderBy(F.desc("rank_score"), "feature").collect()]  # a row per feature
    return spark.createDataFrame([(i, f) for i, f in enumerate(S.greedy_uncorrelated(ranked, S.correlations(x, FS), 0.3), 1)], "place int, feature string")


@query("s_coverage", f"{B5}, {LONG} SELECT feature, stddev_samp(value) >= 1e-8 AS usable FROM lf WHERE domain = 2 GROUP BY 1")
def s_coverage(spark, d):
    return S.long_form(v(spark, d).where("domain = 2"), FS, []).groupBy("feature").agg((F.stddev_samp("value") >= 1e-8).alias("usable"))


@query("s_stability", f"""{B5}, {LONG}, s AS (SELECT feature, abs(avg(value) FILTER (domain = 0) - avg(value) FILTER (domain = 1)) / greatest(stddev_samp(value) FILTER (domain = 0), 1e-6) AS shift FROM lf GROUP BY 1)
  SELECT feature, round(shift, 6) AS shift, CASE WHEN shift <= 0.1 THEN 'stable' ELSE 'unstable' END AS verdict FROM s""")
def s_stability(spark, d):
    return S.stability(v(spark, d).where("domain = 0"), v(spark, d).where("domain = 1"), FS, 0.1).select("feature", *r("shift"), "verdict")


_HEALTH = "CASE WHEN id % 5 = 0 THEN NULL ELSE f0 END"


@query("s_health", f"{B5} SELECT id, round((id % 5 = 0)::INT / 3, 6) AS null_share, 2 + (id % 5 <> 0)::INT AS active, round(sqrt(coalesce(pow({_HEALTH}, 2), 0) + f1 * f1 + f2 * f2), 6) AS l2 FROM b5")
def s_health(spark, d):
    out = C.row_health(v(spark, d).withColumn("f0", F.expr(_HEALTH)), "id", ["f0", "f1", "f2"])
    return out.select("id", *r("null_share"), "active", *r("l2"))


_TIER = f"{B5}, q AS (SELECT quantile_cont(f0, 0.9) AS hi, quantile_cont(f0, 0.99) AS top FROM b5 WHERE label = 0), t AS (SELECT id, CASE WHEN f0 > top THEN 'hard' WHEN f0 > hi THEN 'soft' ELSE 'clean' END AS tier FROM b5, q)"


def _tiers(spark, d):
    return C.qc_tiers(v(spark, d), "id", ["f0"], F.col("label") == 0).select("id", "tier")


@query("s_tier", f"{_TIER} SELECT * FROM t")
def s_tier(spark, d):
    return _tiers(spark, d)


@query("s_gate", f"{_TIER} SELECT round(avg((tier = 'hard')::INT), 6) AS hard_share, round(avg((tier = 'soft')::INT), 6) AS soft_share, avg((tier = 'hard')::INT) <= 0.02 AS pass FROM t")
def s_gate(spark, d):
    return R.qc_gate(_tiers(spark, d)).select(*r("hard_share", "soft_share"), "pass")


@query("s_fingerprint", f"{B5}, {LONG} SELECT feature, round(0.7 * avg(value) FILTER (label = 1) + 0.3 * avg(value) FILTER (label = 0), 6) + 0.0 AS mean, round(stddev_samp(value) FILTER (label = 1), 6) AS std FROM lf GROUP BY 1")
def s_fingerprint(spark, d):
    a, b = (S.fingerprint(v(spark, d).where(F.col("label") == k), FS) for k in (1, 0))
    rows = spark.createDataFrame([(c, *x) for c, x in R.blended(a, b).items()], "feature string, mean double, std double")
    return rows.select("feature", *r("mean", "std"))


@query("s_fp_dist", f"""{B5}, p AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s' for c in FS)} FROM b5 WHERE label = 1)
  SELECT domain, round(avg(sqrt(({' + '.join(f'{i + 1} * pow(({c} - {c}_m) / {c}_s, 2)' for i, c in enumerate(FS))}) / {len(FS) * (len(FS) + 1) // 2})), 6) AS distance FROM b5, p GROUP BY 1""")
def s_fp_dist(spark, d):
    dist = S.fingerprint_distance(S.fingerprint(v(spark, d).where("label = 1"), FS), {c: float(i + 1) for i, c in enumerate(FS)})
    return v(spark, d).withColumn("distance", dist).groupBy("domain").agg(rounded(F.avg("distance")).alias("distance"))


_W = {"f0": 0.05, "f1": 2.0, "f2": 1.3}
_WSQL = "CASE feature " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in _W.items()) + " ELSE 1.0 END"


@query("s_match", f"""{B5}, {LONG}, {_ks_sql('label = 1')}, w AS (SELECT ks, unnest(range(CAST(greatest(1, floor({_WSQL} * 10)) AS BIGINT))) FROM ksd)
  SELECT count(*) AS n_features, round(median(ks), 6) AS median_ks, round(avg(ks), 6) AS mean_ks, round((SELECT median(ks) FROM w), 6) AS weighted_median_ks, median(ks) <= 0.3 AND (SELECT median(ks) FROM w) <= 0.05 AS reached FROM ksd""")
def s_match(spark, d):
    return R.profile_match(R.profile_distances(v(spark, d), FS, F.col("label") == 1, _W), most_weighted=0.05).select("n_features", *r("median_ks", "mean_ks", "weighted_median_ks"), "reached")


@query("s_match_features", f"{B5}, {LONG}, {_ks_sql('label = 1')}, m AS (SELECT feature, avg(value) FILTER (label = 1) AS mean_a, avg(value) FILTER (label = 0) AS mean_b FROM lf GROUP BY 1) SELECT feature, {rs('ks', 'mean_a', 'mean_b')}, CAST({_WSQL} AS DOUBLE) AS weight FROM ksd JOIN m USING (feature)")
def s_match_features(spark, d):
    return R.profile_distances(v(spark, d), FS, F.col("label") == 1, _W).select("feature", *r("ks", "mean_a", "mean_b"), "weight")


@query("s_adjust", f"""{B5}, {LONG}, {_ks_sql('label = 1')}, m AS (SELECT feature, avg(value) FILTER (label = 1) AS a, avg(value) FILTER (label = 0) AS b FROM lf GROUP BY 1)
  SELECT feature, round(CASE WHEN ks >= 0.1 THEN a + 0.5 * (b - a) ELSE a END, 6) + 0.0 AS mean, round(1 + ks, 6) AS weight FROM m JOIN ksd USING (feature)""")
def s_adjust(spark, d):
    return R.adjusted_fingerprint(R.profile_distances(v(spark, d), FS, F.col("label") == 1), least=0.1).select("feature", *r("mean", "weight"))


_SCORED = f"sb AS (SELECT *, round(1 / (1 + exp(-3 * (round(f0, 5) + round(f1, 5)) - label * 0.9)), 4) AS score FROM b5)"
_SLONG = "sl AS (" + " UNION ALL ".join(f"SELECT label, score, '{c}' AS feature, {c} AS value FROM sb" for c in FS) + ")"


def _scored(spark, d):
    return vector_scores(spark, d).select("id", "score").join(v(spark, d), "id")


@query("s_contrast", f"""{B5}, {_SCORED}, {_SLONG}, c AS (SELECT feature, avg(value) FILTER (label = 1 AND score < 0.7) AS hard_mean, avg(value) FILTER (label = 1 AND score >= 0.7) AS easy_mean, avg(value) FILTER (label = 0) AS human_mean,
  stddev_samp(value) FILTER (label = 1 AND score < 0.7) AS h, stddev_samp(value) FILTER (label = 0) AS n, corr(value, score) FILTER (label = 1) AS corr FROM sl GROUP BY 1)
  SELECT feature, {rs('hard_mean', 'easy_mean', 'human_mean')}, round(abs(easy_mean - hard_mean) / h, 6) AS z_easy, round(abs(hard_mean - human_mean) / n, 6) AS z_human, round(corr, 6) + 0.0 AS corr FROM c""")
def s_contrast(spark, d):
    return R.hard_easy_contrast(_scored(spark, d), FS, at=0.7).select("feature", *r("hard_mean", "easy_mean", "human_mean", "z_easy", "z_human", "corr"))


@query("s_contrast_scores", f"""{B5}, {_SCORED}, g AS (SELECT score, CASE WHEN label = 0 THEN 'human' WHEN score < 0.7 THEN 'hard' ELSE 'easy' END AS segment FROM sb), q AS (SELECT segment, count(*) AS n, avg(score) AS mean, quantile_cont(score, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q FROM g GROUP BY 1)
  SELECT segment, n, round(mean, 6) AS mean, {', '.join(f'round(q[{i + 1}], 6) AS p{p}' for i, p in enumerate((10, 25, 50, 75, 90, 95)))} FROM q""")
def s_contrast_scores(spark, d):
    rows = _scored(spark, d).withColumn("segment", F.when(F.col("label") == 0, "human").when(F.col("score") < 0.7, "hard").otherwise("easy"))
    return R.score_summary(rows, "segment").select("segment", "n", *r("mean"), *[rounded(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90, 95))])


@query("s_hist", f"{B5} SELECT CAST(CASE WHEN f0 < -0.4 THEN 0 WHEN f0 >= 0.4 THEN 17 ELSE floor((f0 + 0.4) / 0.05) + 1 END AS BIGINT) AS bin, count(*) AS n FROM b5 GROUP BY 1")
def s_hist(spark, d):
    return C.histogram(v(spark, d), "f0", -0.4, 0.4, 16)


@query("s_ecdf", f"{B5}, h AS (SELECT CAST(CASE WHEN f0 < -0.4 THEN 0 WHEN f0 >= 0.4 THEN 17 ELSE floor((f0 + 0.4) / 0.05) + 1 END AS BIGINT) AS bin, domain, count(*) AS n FROM b5 GROUP BY 1, 2) SELECT domain, bin, round(sum(n) OVER (PARTITION BY domain ORDER BY bin) / sum(n) OVER (PARTITION BY domain), 6) AS share FROM h")
def s_ecdf(spark, d):
    return C.ecdf(C.histogram(v(spark, d), "f0", -0.4, 0.4, 16, ["domain"]), ["domain"]).select("domain", "bin", *r("share"))


_QQ = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("s_qq", f"{B5}, {LONG}, p AS (SELECT unnest({_QQ})::DOUBLE AS p), q AS (SELECT feature, " + ", ".join(f"quantile_cont(value, {p}) FILTER (domain = 0) AS a{i}, quantile_cont(value, {p}) FILTER (domain <> 0) AS b{i}" for i, p in enumerate(_QQ)) + " FROM lf GROUP BY 1) " + " UNION ALL ".join(f"SELECT feature, {p}::DOUBLE AS p, round(a{i}, 6) + 0.0 AS a, round(b{i}, 6) + 0.0 AS b FROM q" for i, p in enumerate(_QQ)))
def s_qq(spark, d):
    return C.qq(v(spark, d), FS, F.col("domain") == 0, _QQ).select("feature", "p", *r("a", "b"))


@query("s_agree", f"{B5} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr, round(avg(abs({a} - {b})), 6) AS mean_abs_difference FROM b5" for a, b in (("f0", "f1"), ("f0", "f2"), ("f1", "f2"))))
def s_agree(spark, d):
    return C.scorer_agreement(v(spark, d), ["f0", "f1", "f2"]).select("a", "b", *r("corr", "mean_abs_difference"))


@query("s_rule", f"""{B5}, {LONG}, {_AUC}, rw AS (SELECT feature, value, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(p) OVER (PARTITION BY feature) AS tp, sum(q) OVER (PARTITION BY feature) AS tq FROM ac WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
  ra AS (SELECT feature, value, (cq + tp - cp) / (tp + tq)::DOUBLE AS acc FROM rw) SELECT feature, round(max(greatest(acc, 1 - acc)), 6) AS accuracy FROM ra GROUP BY 1""")
def s_rule(spark, d):
    return S.best_rule(v(spark, d), FS, "label").select("feature", *r("accuracy"))


@query("s_bands", f"{B5} SELECT label, round(avg(f0), 6) + 0.0 AS mean, round(median(f0), 6) + 0.0 AS median, round(avg((f0 > 0.1)::INT), 6) AS share_high, round(avg((f0 < -0.1)::INT), 6) AS share_low, round(quantile_cont(f0, 0.1), 6) + 0.0 AS p10, round(quantile_cont(f0, 0.9), 6) + 0.0 AS p90 FROM b5 GROUP BY 1")
def s_bands(spark, d):
    return C.score_bands(v(spark, d), ["label"], "f0", -0.1, 0.1).select("label", *r("mean", "median", "p10", "p90", "share_high", "share_low"))


@query("s_by_hash", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(avg((value > 250)::INT), 6) AS high_share FROM events GROUP BY 1")
def s_by_hash(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"), rounded(F.stddev_samp("value")).alias("std"), rounded(F.avg((F.col("value") > 250).cast("int"))).alias("high_share"))


_PAIRS = [(0, 1), (0, 2), (1, 2)]


@query("s_ks_matrix", f"{B5}, {LONG.replace('lf AS', 'l0 AS')}, lf AS (" + " UNION ALL ".join(f"SELECT '{a}-{b}' AS pair, feature, value, domain = {a} AS left_side FROM l0 WHERE domain IN ({a}, {b})" for a, b in _PAIRS) + f"), {_ks_sql('left_side', 'pair, feature')} SELECT pair, feature, round(ks, 6) AS ks, CASE WHEN ks >= 0.5 THEN 'strong' WHEN ks >= 0.3 THEN 'moderate' ELSE 'weak' END AS kind FROM ksd")
def s_ks_matrix(spark, d):
    return S.ks_matrix(v(spark, d), FS, "domain").select(F.concat_ws("-", "a", "b").alias("pair"), "feature", *r("ks"), "kind")


@query("s_ks_kinds", f"{B5}, {LONG.replace('lf AS', 'l0 AS')}, lf AS (" + " UNION ALL ".join(f"SELECT {k} AS pair, feature, value, domain = {a} AS left_side FROM l0 WHERE domain IN ({a}, {b})" for k, (a, b) in enumerate(_PAIRS)) + f"), {_ks_sql('left_side', 'pair, feature')} SELECT feature, count(*) FILTER (ks >= 0.1) AS strong, count(*) FILTER (ks >= 0.05 AND ks < 0.1) AS moderate, count(*) FILTER (ks < 0.05) AS weak FROM ksd GROUP BY 1")
def s_ks_kinds(spark, d):
    """How many pairs of domains differ strongly, moderately or weakly in each feature."""
    m = S.ks_matrix(v(spark, d), FS, "domain", strong=0.1, moderate=0.05)
    return m.groupBy("feature").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("strong", "moderate", "weak")])


@query("s_direction", f"""{B5}, {LONG}, e AS (SELECT feature, domain, (avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0)) / stddev_samp(value) AS e FROM lf WHERE domain < 2 GROUP BY 1, 2), j AS (SELECT feature, max(e) FILTER (domain = 0) AS a, max(e) FILTER (domain = 1) AS b FROM e GROUP BY 1)
  SELECT feature, CASE WHEN sign(a) <> sign(b) THEN 'rejected' WHEN least(abs(a), abs(b)) < 0.1 THEN 'weak' ELSE 'robust' END AS verdict FROM j""")
def s_direction(spark, d):
    return C.direction_check(v(spark, d), FS, "domain", "label", (0, 1)).select("feature", "verdict")


@query("s_rollup", "SELECT domain, label, count(*) AS n FROM (SELECT label % 3 AS domain, (label >= 5)::INT AS label FROM embeddings) GROUP BY ROLLUP (domain, label)")
def s_rollup(spark, d):
    return v(spark, d).rollup("domain", "label").agg(F.count("*").alias("n"))


@query("w_rownum", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def w_rownum(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("w_lag", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 4) + 0.0 AS change FROM orders")
def w_lag(spark, d):
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", rounded(F.col("o_totalprice") - F.lag("o_totalprice").over(by), 4).alias("change"))


@query("w_cumsum", f"WITH {ORDER_EVENTS} SELECT sess, ord, total FROM b1")
def w_cumsum(spark, d):
    return order_events(spark, d).select("sess", "ord", "total")


@query("w_revmin", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM orders")
def w_revmin(spark, d):
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(0, Window.unboundedFollowing)
    return table(spark, d, "orders").select("o_orderkey", F.min("o_totalprice").over(by).alias("least"))


@query("w_last_n", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk <= 10")
def w_last_n(spark, d):
    by = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("rk", F.row_number().over(by)).where("rk <= 10").select("event_id")


@query("w_rolling", "SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def w_rolling(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return table(spark, d, "events").select("event_id", rounded(F.avg("value").over(by)).alias("mean"), rounded(F.max("value").over(by)).alias("top"))


@query("w_rolling_p", "SELECT event_id, round(quantile_cont(value, 0.9) OVER w, 6) AS p90, round(median(value) OVER w, 6) AS p50 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)")
def w_rolling_p(spark, d):
    """Percentiles of each user's last 500 values."""
    rows, order = table(spark, d, "events").select("user_id", "ts", "event_id", "value"), [F.col("ts"), F.col("event_id")]
    out = rolling_quantiles(rows, ["user_id"], order, "value", {"p90": 0.9, "p50": 0.5})
    return out.select("event_id", rounded("p90").alias("p90"), rounded("p50").alias("p50"))


@query("w_rolling_stream", "SELECT event_id, round(quantile_cont(value, 0.95) OVER (ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 6) AS p95 FROM events")
def w_rolling_stream(spark, d):
    """A percentile of the last 500 values of the one stream of all events."""
    rows = rolling_quantile(table(spark, d, "events").select("ts", "event_id", "value"), [], [F.col("ts"), F.col("event_id")], "value", 0.95)
    return rows.select("event_id", rounded("quantile").alias("p95"))


@query("w_rank", "SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, round(cume_dist() OVER (PARTITION BY user_id ORDER BY event_type), 6) AS cd FROM events")
def w_rank(spark, d):
    by = Window.partitionBy("user_id").orderBy("event_type")
    return table(spark, d, "events").select("event_id", F.rank().over(by).alias("rk"), rounded(F.cume_dist().over(by)).alias("cd"))


@query("w_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def w_topk(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("w_sort", "SELECT c_custkey, b, row_number() OVER (ORDER BY b ASC NULLS LAST, c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer)")
def w_sort(spark, d):
    b = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("b")
    return sorted_places(table(spark, d, "customer").select("c_custkey", b), F.asc_nulls_last("b"), F.col("c_custkey"))


@query("w_round_robin", "WITH e AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rk, count(*) OVER () AS n FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey FROM e WHERE (rk - (4 * 50) % n + n) % n < 50")
def w_round_robin(spark, d):
    e = sorted_places(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"), F.col("c_custkey"))
    n = max(e.count(), 1)
    return e.where(F.pmod(F.col("place") - 1 - 200 % n, F.lit(n)) < 50).select("c_custkey")
