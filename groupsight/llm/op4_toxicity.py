"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased (A-Z), runs of white space become one space, and n-grams of 4 to 6 characters are
hashed. For the labelled rows, document counts of each n-gram in toxic and other texts give the ratio
r = log((p + a) / (|p| + 2a)) - log((q + a) / (|q| + 2a)). The n-grams whose ratios tell most stay as
features, with value r where the text has the n-gram; a logistic regression weighs them. Scoring
needs one pass over each text and a table of bounded size.

At most `max_train_rows` labelled rows are fitted, those with the smallest hash of their id.

Edge cases: null, empty and very short texts have no n-gram and get the model's constant; without
labelled rows, or with one label only, the score is the labels' mean (0.5 without any); labels other
than 0 and 1 are not learnt from; repeated documents are scored each; an empty table gives an empty result; only
id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupsight.llm.common import bounded_labels, prepare, training_row
from groupsight.sources.store import cut

MAX_TRAIN_ROWS = 20_000
HASH_BITS = 22
SIZES = (4, 5, 6)
FEATURES = 8192
_STEP = np.uint32(0x01000193)


def ngram_hashes(text: str | None) -> list[np.ndarray]:
    """Hashes below 2**HASH_BITS of all n-grams, an array per size."""
    if not text:
        return []
    line = b" " + b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) + b" "
    if line.isascii():
        a = np.frombuffer(line, np.uint8).astype(np.uint32)
    else:
        a = np.frombuffer(line.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    h, out = a, []
    for n in range(2, max(SIZES) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * _STEP + a[n - 1 :]
        if n in SIZES:
            out.append(((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS))
    return out


def document_counts(rows: DataFrame) -> DataFrame:
    """(h, p, q): toxic and other documents that hold each n-gram, from rows (t, label)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << HASH_BITS), np.int32)
        for pdf in parts:
            for t, y in zip(pdf.t, pdf.label, strict=True):
                if found := ngram_hashes(t):
                    counts[int(y > 0.5), np.unique(np.concatenate(found))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pd.DataFrame({"h": at.astype(np.int64), "p": counts[1, at].astype(np.int64), "q": counts[0, at].astype(np.int64)})

    part = rows.mapInPandas(run, "h long, p long, q long")
    return part.groupBy("h").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


class Model:
    """Slots of the kept n-grams (0: none), weight of each slot, constant."""

    def __init__(self, kept: np.ndarray, ratio: np.ndarray, weight: np.ndarray | None = None, constant: float = 0.0):
        self.kept, self.ratio, self.constant = kept, ratio, constant
        self.weight = np.zeros(len(kept)) if weight is None else weight

    def slots(self) -> np.ndarray:
        table = np.zeros(1 << HASH_BITS, np.int32)
        table[self.kept] = np.arange(1, len(self.kept) + 1)
        return table


def features_of(text: str | None, slots: np.ndarray) -> np.ndarray:
    """Slots of the kept n-grams that the text has, each once."""
    found = [s[s > 0] for s in (slots[h] for h in ngram_hashes(text))]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


def fit(rows: DataFrame, alpha: float = 1.0, features: int = FEATURES, ridge: float = 0.001) -> Model:
    """A model from rows (t, label)."""
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or toxic in (0.0, float(n)):
        p = min(max(toxic / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.empty(0, np.int64), np.empty(0), constant=math.log(p / (1 - p)))
    ratio = F.log((F.col("p") + alpha) / (toxic + 2 * alpha)) - F.log((F.col("q") + alpha) / (n - toxic + 2 * alpha))
    # how far an n-gram moves the log odds, over the documents that have it
    told = F.abs("r") * F.sqrt(F.col("p") / toxic + F.col("q") / (n - toxic))
    best = document_counts(rows).withColumn("r", ratio).withColumn("told", told).orderBy(F.desc("told"), "h").limit(features).collect()
    model = Model(np.array([b.h for b in best], np.int64), np.array([b.r for b in best], float))
    sent = rows.sparkSession.sparkContext.broadcast(model.slots())

    @F.pandas_udf("array<int>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([features_of(t, sent.value) for t in s])

    # the vocabulary is the slots' numbers, so a term's place is its slot less 1
    terms = CountVectorizerModel.from_vocabulary([str(k + 1) for k in range(len(best))], inputCol="found", outputCol="has")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(model.ratio), inputCol="has", outputCol="x")
    train = scale.transform(terms.transform(rows.select("label", found("t").cast("array<string>").alias("found")))).select("label", "x").persist()
    lr = LogisticRegression(featuresCol="x", labelCol="label", regParam=ridge, elasticNetParam=0.0, standardization=False, maxIter=60, tol=1e-5)
    fitted = lr.fit(train)
    train.unpersist()
    return Model(model.kept, model.ratio, np.asarray(fitted.coefficients.toArray()) * model.ratio, float(fitted.intercept))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.5, max_train_rows: int = MAX_TRAIN_ROWS, **options,
) -> DataFrame:
    """(id, held_out, score, predicted) for every document."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    train = source.join(F.broadcast(bounded_labels(labels, id_col, label_col, max_train_rows)), "id").select("t", "label")  # max_train_rows rows at most
    model = fit(cut(train, "labelled"), **options)
    sent = spark.sparkContext.broadcast((model.slots(), np.concatenate(([0.0], model.weight)), model.constant))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots, weight, constant = sent.value
        for s in parts:
            yield pd.Series([1 / (1 + math.exp(-max(-40.0, min(40.0, constant + float(weight[features_of(t, slots)].sum()))))) for t in s], dtype="float64")

    out = source.select("id", F.coalesce(~training_row(F.col("id")), F.lit(False)).alias("held_out"), score("t").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).withColumnRenamed("id", "doc_id")
