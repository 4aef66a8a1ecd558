"""The test tables seen as groups of sessions of ordered events, as Spark frames and as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groupsight.functions.scalars import rounded

TYPE_OF_LINE = {"RF": "fold", "RO": "raise", "NO": "call", "NF": "check", "AF": "bet", "AO": "all_in"}
TYPE_OF_EVENT = {"click": "call", "view": "check", "purchase": "raise", "signup": "bet", "error": "fold"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column, pairs: dict):
    out = None
    for k, v in pairs.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise("other")


#: Rows of a task that sorts and numbers events; tables of up to MANY_ROWS are left to Spark's own number of partitions.
TASK_ROWS, MANY_ROWS = 250_000, 1_000_000


def dealt(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """df in as many partitions by key as keep tasks at TASK_ROWS of its rows, whatever their number; adaptive execution does not join them again."""
    if rows <= MANY_ROWS:
        return df
    return df.repartition(max(math.ceil(rows / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *key)


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: customer > order > line. (grp, sess, ord, stage, type, actor, amount, total, stack, label)."""
    lines, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    # orders meet their customers first: then lines are dealt once, by session, for the join, the windows and what groups by session
    n, m = lines.count(), orders.count()
    orders, customers = dealt(orders.select("o_orderkey", "o_custkey"), m, "o_custkey"), dealt(customers.select("c_custkey", "c_mktsegment"), m, "c_custkey")
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity")
    rows = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = rows.withColumn("ord", F.row_number().over(order).cast("long")).withColumn("amount", rounded(F.col("l_extendedprice") / 1000, 4))
    kind = F.concat("l_returnflag", "l_linestatus")
    return rows.select(
        F.col("c_custkey").alias("grp"), F.col("l_orderkey").alias("sess"), "ord", F.least(F.floor((F.col("ord") - 1) / 2), F.lit(3)).cast("int").alias("stage"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 45), "other").otherwise(_mapped(kind, TYPE_OF_LINE)).alias("type"), F.col("l_suppkey").alias("actor"),
        "amount", rounded(F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("total"), F.col("l_quantity").alias("stack"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"),
    )


ORDER_EVENTS = """
b1_lines AS (
  SELECT c_custkey AS grp, l_orderkey AS sess, CAST(row_number() OVER w AS BIGINT) AS ord, round(l_extendedprice / 1000, 4) AS amount,
    CASE WHEN l_linenumber = 1 AND l_quantity > 45 THEN 'other' ELSE
    CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'fold' WHEN 'RO' THEN 'raise' WHEN 'NO' THEN 'call' WHEN 'NF' THEN 'check'
      WHEN 'AF' THEN 'bet' WHEN 'AO' THEN 'all_in' ELSE 'other' END END AS type,
    l_suppkey AS actor, l_quantity AS stack, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
b1 AS (
  SELECT grp, sess, ord, CAST(least(floor((ord - 1) / 2), 3) AS INTEGER) AS stage, type, actor, amount,
    round(sum(amount) OVER (PARTITION BY sess ORDER BY ord ROWS UNBOUNDED PRECEDING), 4) AS total, stack, label FROM b1_lines)"""


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: user > day > event, with the same columns."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    order = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    rows = rows.withColumn("ord", F.row_number().over(order).cast("long")).withColumn("amount", rounded("value", 2))
    return rows.select(
        F.col("user_id").alias("grp"), F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("sess"), "ord",
        F.least(F.floor((F.col("ord") - 1) / 2), F.lit(3)).cast("int").alias("stage"), _mapped(F.col("event_type"), TYPE_OF_EVENT).alias("type"),
        F.col("user_id").alias("actor"), "amount", rounded(F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("total"),
        F.lit(1.0).alias("stack"), (F.col("user_id") % 2).cast("int").alias("label"),
    )


USER_EVENTS = """
b2_rows AS (
  SELECT user_id AS grp, CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS sess,
    CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS ord, round(value, 2) AS amount,
    CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'check' WHEN 'purchase' THEN 'raise' WHEN 'signup' THEN 'bet' WHEN 'error' THEN 'fold' ELSE 'other' END AS type,
    user_id AS actor, CAST(user_id % 2 AS INTEGER) AS label FROM events),
b2 AS (
  SELECT grp, sess, ord, CAST(least(floor((ord - 1) / 2), 3) AS INTEGER) AS stage, type, actor, amount,
    round(sum(amount) OVER (PARTITION BY sess ORDER BY ord ROWS UNBOUNDED PRECEDING), 2) AS total, 1.0 AS stack, label FROM b2_rows)"""


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: (id, domain, label, n_chars, n_words, n_lines, digit_ratio, upper_ratio, word_len); label NULL where there is none."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.coalesce("text", F.lit(""))
    chars = F.length(text).cast("double")
    words = F.regexp_count(text, F.lit("[^ \n]+")).cast("double")
    out = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("domain"), chars.alias("n_chars"), words.alias("n_words"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("double").alias("n_lines"),
        (F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(chars, F.lit(1.0))).alias("digit_ratio"),
        (F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.greatest(chars, F.lit(1.0))).alias("upper_ratio"),
        (chars / F.greatest(words, F.lit(1.0))).alias("word_len"),
    )
    # distinct: labels may repeat a document
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    return out.join(known, "id", "left")


DOCUMENT_FEATURE_NAMES = ["n_chars", "n_words", "n_lines", "digit_ratio", "upper_ratio", "word_len"]
DOCUMENT_FEATURES = """
b4 AS (
  SELECT d.doc_id AS id, source AS domain, CAST(length(t) AS DOUBLE) AS n_chars, CAST(len(regexp_extract_all(t, '[^ \\n]+')) AS DOUBLE) AS n_words,
    CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS DOUBLE) AS n_lines,
    length(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(length(t), 1) AS digit_ratio,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) / greatest(length(t), 1) AS upper_ratio,
    length(t) / greatest(len(regexp_extract_all(t, '[^ \\n]+')), 1) AS word_len, l.label
  FROM (SELECT *, coalesce(text, '') AS t FROM documents) d
  LEFT JOIN (SELECT doc_id, CAST(max(toxic) AS INTEGER) AS label FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


#: An embedding's numbers.
VECTOR_NAMES = [f"f{i}" for i in range(64)]


def vector_features(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """B5: (id, domain, label, f0..): an embedding's 64 numbers, or the first n, as doubles."""
    v = table(spark, sf_dir, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(n)]
    return v.select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("int").alias("domain"), (F.col("label") >= 5).cast("int").alias("label"), *cols)


def vector_sql(n: int = 64) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(n))
    return f"\nb5 AS (SELECT vec_id AS id, CAST(label % 3 AS INTEGER) AS domain, CAST(label >= 5 AS INTEGER) AS label, {cols} FROM embeddings)"


#: A bounded score for each embedding, for the operators on predictions.
def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, scorer, cycle, score, label): 1 / (1 + exp(-3 (f0 + f1))), four places; scorer and cycle from the id."""
    v = vector_features(spark, sf_dir)
    score = rounded(1 / (1 + F.exp(-3 * (rounded("f0", 5) + rounded("f1", 5)) - F.col("label") * 0.9)), 4)
    return v.select("id", (F.col("id") % 7).alias("scorer"), F.floor(F.col("id") / 50).alias("cycle"), "domain", score.alias("score"), "label")


VECTOR_SCORES = vector_sql() + """,
sc AS (SELECT id, id % 7 AS scorer, CAST(floor(id / 50) AS BIGINT) AS cycle, domain,
  round(1 / (1 + exp(-3 * (round(f0, 5) + round(f1, 5)) - label * 0.9)), 4) AS score, label FROM b5)"""
