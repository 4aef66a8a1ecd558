"""Quality classifier: a sparse rule ensemble over text statistics.

A random forest of shallow trees is grown on labelled rows. Every path from a root to a node becomes a
conjunctive rule over the statistics; rules that hold for nearly all or nearly no rows go, as do
repeated ones. A lasso logistic regression weighs the rules, most weights end at zero, and the rest
is compiled into one Spark column expression over the statistics, which scores all documents.

At most `max_train_rows` labelled rows are fitted, those with the smallest hash of their id.

Edge cases: null and empty texts have statistics of zero and get a score; without labelled rows, or
with one label only, the score is the labels' mean (0.5 without any); labels other than 0 and 1 are not
learnt from; repeated documents are scored each; a document labelled twice is learnt from twice; an
empty table gives an empty result; only id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupsight.llm.common import SPACE, bounded_labels, prepare, training_row
from groupsight.sources.store import cut

MAX_TRAIN_ROWS = 20_000
FIT_PARTS = 8
FEATURES = (
    "n_words", "word_length", "symbol_share", "bang_share", "pipe_share", "upper_share", "digit_share", "stop_share", "comma_share",
    "dup_line_share", "repeat_share", "distinct_share", "line_words", "sentence_words", "longest_word", "capital_share", "ascii_share",
)
_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))


def statistics(text: str | None) -> tuple[float, ...]:
    """The features of a whole text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    visible = len(raw) - count(SPACE)
    upper, lower = count(_UPPER), count(_LOWER)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = dict.fromkeys(words)
    at = dict(zip(distinct, range(len(distinct)), strict=True))
    ids = np.fromiter(map(at.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * len(at) + ids[1:]
    stops = raw.count(b".") + raw.count(b"?")
    return (
        float(n), visible / n, count(b"#*$%&<>") / n, raw.count(b"!") / n, raw.count(b"|") / n, upper / max(1, upper + lower), count(_DIGIT) / n,
        stops / n, raw.count(b",") / n, 1 - len(set(lines)) / len(lines), 1 - len(np.unique(pairs)) / max(1, len(pairs)), len(at) / n,
        n / len(lines), n / max(1, stops), float(max(map(len, distinct))), sum(w[:1].isupper() for w in words) / n, (upper + lower) / visible,
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features): one row per document."""
    prepare(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{x} double" for x in FEATURES))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([statistics(x) for x in s], columns=FEATURES, dtype="float64")

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("s")).select("id", "s.*")


#: A rule is a tuple of (feature, "<=" or ">", threshold).
Rule = tuple[tuple[str, str, float], ...]


def tree_rules(model) -> list[Rule]:
    """Conjunctions along every path of every tree, each once."""
    found: dict[Rule, None] = {}

    def walk(node, path: tuple) -> None:
        if path:
            bounds: dict[tuple[str, str], float] = {}
            for name, op, at in path:
                old = bounds.get((name, op), at)
                bounds[name, op] = min(old, at) if op == "<=" else max(old, at)
            found[tuple((name, op, at) for (name, op), at in sorted(bounds.items()))] = None
        if node.subtreeDepth() > 0:
            split = node.split()
            name, at = FEATURES[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, "<=", at)))
            walk(node.rightChild(), (*path, (name, ">", at)))

    for tree in model._java_obj.trees():
        walk(tree.rootNode(), ())
    return list(found)


def rule_column(rule: Rule) -> Column:
    """1.0 where the rule holds, else 0.0."""
    tests = [F.col(name) <= at if op == "<=" else F.col(name) > at for name, op, at in rule]
    return F.when(reduce(lambda a, b: a & b, tests), 1.0).otherwise(0.0)


class RuleEnsemble:
    """Rules with weights, and the constant."""

    def __init__(self, constant: float, weighted: list[tuple[Rule, float]]):
        self.constant, self.weighted = constant, weighted

    def score(self) -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        total = reduce(lambda a, b: a + b, [F.lit(w) * rule_column(r) for r, w in self.weighted], F.lit(float(self.constant)))
        return 1 / (1 + F.exp(-total))


def fit(train: DataFrame, trees: int = 24, depth: int = 4, lasso: float = 0.001, seed: int = 5) -> RuleEnsemble:
    """An ensemble from rows (id, features, label).

    Rows are dealt by the hash of their id and sorted, so that the forest's bags do not depend on how the input is partitioned.
    """
    train = train.repartition(FIT_PARTS, "id").sortWithinPartitions("id", "label", *FEATURES)
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(train).persist()
    try:
        return _fitted(train, trees, depth, lasso, seed)
    finally:
        train.unpersist()


def _fitted(train: DataFrame, trees: int, depth: int, lasso: float, seed: int) -> RuleEnsemble:
    rows, mean = train.agg(F.count("*"), F.avg("label")).first()
    if not rows or mean in (0.0, 1.0):
        p = min(max(0.5 if mean is None else mean, 1e-6), 1 - 1e-6)
        return RuleEnsemble(math.log(p / (1 - p)), [])
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", minInstancesPerNode=5, seed=seed)
    rules = tree_rules(forest.fit(train))
    share = train.agg(*[F.avg(rule_column(r)).alias(str(i)) for i, r in enumerate(rules)]).first()
    rules = [r for i, r in enumerate(rules) if 0.003 < share[i] < 0.997]
    if not rules:
        return RuleEnsemble(math.log(mean / (1 - mean)), [])
    holds = train.select("label", array_to_vector(F.array(*[rule_column(r) for r in rules])).alias("r")).persist()
    lr = LogisticRegression(featuresCol="r", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60, tol=1e-5)
    model = lr.fit(holds)
    holds.unpersist()
    return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients, strict=True) if abs(w) > 1e-9])


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, max_train_rows: int = MAX_TRAIN_ROWS, **options,
) -> DataFrame:
    """(id, held_out, score, predicted, statistics) for every document."""
    stats = cut(with_statistics(docs, id_col, text_col), "statistics")
    train = stats.join(F.broadcast(bounded_labels(labels, id_col, label_col, max_train_rows)), "id")  # max_train_rows rows at most
    model = fit(train, **options)
    out = stats.withColumn("score", model.score()).withColumn("held_out", F.coalesce(~training_row(F.col("id")), F.lit(False)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
