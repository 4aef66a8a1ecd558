"""Queries of models (M, T9): results are checked by tests, not by SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from groupsight.operators import models as M
from groupsight.operators import stats
from groupsight.plans.registry import query
from groupsight.sources.bindings import VECTOR_NAMES as FS
from groupsight.sources.bindings import vector_features, vector_scores


def _split(spark, d):
    v = vector_features(spark, d)
    return v.where("id % 5 <> 0"), v.where("id % 5 = 0")


def _scored(kind: str):
    def run(spark, d):
        return M.fit_score(*_split(spark, d), FS, kind).select("id", "label", "score")

    return run


for _name, _kind in (("m_rf", "forest"), ("m_gbt", "boosted"), ("m_lr", "logistic")):
    query(_name)(_scored(_kind))


@query("m_domain")
def m_domain(spark, d):
    return M.domain_probe(vector_features(spark, d), FS)


@query("m_lodo")
def m_lodo(spark, d):
    return M.leave_one_out(vector_features(spark, d), FS, "domain")


@query("m_kmeans")
def m_kmeans(spark, d):
    out = M.clusters(vector_features(spark, d), FS, 3)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("label").alias("positive_share")).orderBy(F.desc("positive_share"))


@query("m_silhouette")
def m_silhouette(spark, d):
    return M.choose_k(vector_features(spark, d), FS, [2, 3, 4])


@query("m_gmm")
def m_gmm(spark, d):
    return M.soft_clusters(vector_features(spark, d), FS, 3).select("id", "cluster", "cluster_probability")


@query("m_embed")
def m_embed(spark, d):
    g = np.random.default_rng(1)
    return M.embed(vector_features(spark, d), "id", FS, [(g.normal(size=(len(FS), 6)), np.zeros(6)), (g.normal(size=(6, 3)), np.zeros(3))])


@query("m_score")
def m_score(spark, d):
    train, _ = _split(spark, d)
    return M.fit_score(train, vector_features(spark, d), FS, "logistic").groupBy("domain").agg(F.avg("score").alias("mean"), F.percentile("score", F.lit(0.9)).alias("p90"), F.count("*").alias("n"))


@query("m_grid")
def m_grid(spark, d):
    return M.grid(vector_features(spark, d), FS, "domain", [{"ridge": r} for r in (0.001, 0.01, 0.1, 1.0)])


@query("m_forward")
def m_forward(spark, d):
    return spark.createDataFrame(M.forward_selection(vector_features(spark, d), FS, "domain"), "feature string, auc double")


@query("m_pair")
def m_pair(spark, d):
    return M.pair_rescue(vector_features(spark, d), FS, "domain")


@query("t_calibrate")
def t_calibrate(spark, d):
    return M.calibrate(vector_scores(spark, d).select("id", "score", "label"), "isotonic").select("id", "score", "calibrated")


@query("t_calibrate_sigmoid")
def t_calibrate_sigmoid(spark, d):
    return M.calibrate(vector_scores(spark, d).select("id", "score", "label")).select("id", "score", "calibrated")


@query("m_model_auc")
def m_model_auc(spark, d):
    return stats.auc(_scored("forest")(spark, d), ["score"], "label")
