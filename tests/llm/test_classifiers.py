"""Fitted scores of the quality and toxicity classifiers against a computation by hand."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupsight.llm import op2_rule_ensemble as op2
from groupsight.llm import op4_toxicity as op4
from groupsight.llm.common import bounded_labels


@pytest.fixture(scope="module")
def tables(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")


def test_rule_scores_of_every_document_by_hand(spark, tables, monkeypatch):
    made = []
    fit = op2.fit
    monkeypatch.setattr(op2, "fit", lambda train, **o: made.append(fit(train, **o)) or made[0])
    docs, labels = tables
    got = {r.id: r for r in op2.classify(docs, labels).collect()}
    model = made[0]
    assert len(model.weighted) > 5
    for r in docs.collect():
        x = dict(zip(op2.FEATURES, op2.statistics(r.text), strict=True))
        total = model.constant
        for rule, w in model.weighted:
            if all(x[name] <= at if op == "<=" else x[name] > at for name, op, at in rule):
                total += w
        p = 1 / (1 + math.exp(-total))
        g = got[r.doc_id]
        assert g.score == pytest.approx(p, abs=1e-9) and g.predicted == int(g.score >= 0.3) and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_rule_weights_are_a_lasso_optimum(spark, tables):
    """No step of a proximal descent from the fitted weights gains more than a little."""
    docs, labels = tables
    train = op2.with_statistics(docs).join(bounded_labels(labels, "doc_id", "quality", 1000), "id").cache()
    model = op2.fit(train)
    rows = train.collect()
    y = np.array([r.label for r in rows])
    x = np.array([[float(all(r[n] <= at if op == "<=" else r[n] > at for n, op, at in rule)) for rule, _ in model.weighted] for r in rows])
    sd = x.std(axis=0, ddof=1)
    z = x / sd
    value = lambda w, b: np.mean(np.logaddexp(0, z @ w + b) - y * (z @ w + b)) + 0.001 * np.abs(w).sum()
    w, b = np.array([v for _, v in model.weighted]) * sd, model.constant
    start = value(w, b)
    for _ in range(3000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        step = 0.02
        w = w - step * z.T @ (p - y) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - step * 0.001, 0)
        b = b - step * float(np.mean(p - y))
    assert start <= value(w, b) + 0.01


def ngrams(text):
    """Hash cells of a text's n-grams, from the definition."""
    line = " " + " ".join((text or "").translate({c: c + 32 for c in range(65, 91)}).split()) + " " if (text or "").split() else ""
    out = set()
    for n in op4.SIZES:
        for i in range(len(line) - n + 1):
            h = ord(line[i])
            for ch in line[i + 1 : i + n]:
                h = (h * 0x01000193 + ord(ch)) % 2**32
            out.add(((h ^ n) * 0x9E3779B1 % 2**32) >> (32 - op4.HASH_BITS))
    return out


def test_toxicity_scores_by_hand(spark, tables):
    docs, labels = tables
    rows = docs.join(bounded_labels(labels, "doc_id", "toxic", 1000).withColumnRenamed("id", "doc_id"), "doc_id").select(F.col("text").alias("t"), "label").cache()
    model = op4.fit(rows, features=60, ridge=0.01)
    data = [(ngrams(r.t), int(r.label)) for r in rows.collect()]
    n, toxic = len(data), sum(y for _, y in data)
    counts = {}
    for cells, y in data:
        for h in cells:
            counts.setdefault(h, [0, 0])[1 - y] += 1
    ratio = {h: math.log((p + 1) / (toxic + 2)) - math.log((q + 1) / (n - toxic + 2)) for h, (p, q) in counts.items()}
    told = {h: abs(ratio[h]) * math.sqrt(p / toxic + q / (n - toxic)) for h, (p, q) in counts.items()}
    assert len(model.kept) == 60 and min(told[h] for h in model.kept) >= sorted(told.values())[-60] - 1e-9
    assert model.ratio == pytest.approx([ratio[h] for h in model.kept])
    x = np.array([[ratio[h] if h in cells else 0.0 for h in model.kept] + [1.0] for cells, _ in data])
    y, w, pen = np.array([v for _, v in data]), np.zeros(61), np.diag([0.01] * 60 + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / n + pen + 1e-12 * np.eye(61), x.T @ (p - y) / n + pen @ w)
    want = 1 / (1 + np.exp(-x @ w))
    slots = model.slots()
    got = [1 / (1 + math.exp(-(model.constant + model.weight[op4.features_of(r.t, slots) - 1].sum()))) for r in rows.collect()]
    assert got == pytest.approx(want.tolist(), abs=0.01)
