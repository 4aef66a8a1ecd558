"""Queries of joins, unions, dedup, sampling and splits (J, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from groupsight.functions.scalars import rounded
from groupsight.operators import records as R
from groupsight.operators import reports as P
from groupsight.operators import sampling as U
from groupsight.plans.registry import query
from groupsight.sources.bindings import VECTOR_SCORES, table, vector_features, vector_scores, vector_sql


def _h(key: str, seed: str = "s") -> str:
    return f"sha256('{seed}|' || CAST({key} AS VARCHAR))"


def _unit(key: str, seed: str = "s") -> str:
    return f"CAST('0x' || substr({_h(key, seed)}, 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE)"


def cust(spark, d):
    return table(spark, d, "customer")


def orders(spark, d):
    return table(spark, d, "orders")


@query("j_inner", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j_inner(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return cust(spark, d).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY 1")
def j_left(spark, d):
    n = orders(spark, d).where("o_totalprice > 300000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return cust(spark, d).join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS a_n, b.n AS b_n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k")
def j_full(spark, d):
    n = lambda s, x: orders(spark, d).where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(f"{x}_n"))
    return n("F", "a").join(n("P", "b"), "k", "full")


@query("j_compare", """WITH a AS (SELECT lower(trim(c_mktsegment)) AS k, count(*)::DOUBLE AS n, avg(c_acctbal) AS bal FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' GROUP BY 1),
  b AS (SELECT lower(trim(c_mktsegment)) AS k, count(*)::DOUBLE AS n, avg(c_acctbal) AS bal FROM customer WHERE c_custkey % 2 = 1 AND c_mktsegment <> 'MACHINERY' GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, m AS metric, round(CASE m WHEN 'n' THEN b.n - a.n ELSE b.bal - a.bal END, 4) + 0.0 AS delta, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side
  FROM a FULL JOIN b ON a.k = b.k, (VALUES ('n'), ('bal')) v(m)""")
def j_compare(spark, d):
    def metrics(rest: int, without: str):
        rows = cust(spark, d).where((F.col("c_custkey") % 2 == rest) & (F.col("c_mktsegment") != without))
        return rows.groupBy(F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("bal"))

    return P.compared(metrics(0, "BUILDING"), metrics(1, "MACHINERY"), "k", ["n", "bal"]).withColumn("delta", rounded("delta", 4))


@query("j_rowkey", f"WITH {vector_sql()} SELECT a.id, a.f0, b.f1 FROM b5 a JOIN b5 b ON a.id = b.id")
def j_rowkey(spark, d):
    v = vector_features(spark, d)
    a, b = v.select("id", "f0"), v.select("id", "f1")
    if a.count() != b.count():
        raise ValueError("the tables differ in rows")
    return a.join(b, "id")


@query("j_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j_anti(spark, d):
    return cust(spark, d).join(orders(spark, d).where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j_semi(spark, d):
    return cust(spark, d).join(orders(spark, d).where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j_broadcast", """WITH s AS (SELECT c_nationkey AS k, avg(c_acctbal) AS m FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1), g AS (SELECT avg(c_acctbal) AS gm FROM customer)
  SELECT c_custkey, round(c_acctbal - coalesce(m, gm), 4) + 0.0 AS centred FROM customer LEFT JOIN s ON c_nationkey = k, g""")
def j_broadcast(spark, d):
    c = cust(spark, d)
    stats = c.where("c_nationkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("m"))  # a row per nation
    everyone = c.agg(F.avg("c_acctbal")).first()[0]
    return c.join(F.broadcast(stats), F.col("c_nationkey") == F.col("k"), "left").select("c_custkey", rounded(F.col("c_acctbal") - F.coalesce("m", F.lit(everyone)), 4).alias("centred"))


@query("j_nearest", f"""WITH {vector_sql()}, t AS (SELECT domain, avg(f0) AS a, avg(f1) AS b, avg(f2) AS c FROM b5 GROUP BY 1)
  SELECT domain, arg_min(id, (dist, id)) AS nearest FROM (SELECT t.domain, id, round(abs(f0 - a) + 0.5 * abs(f1 - b) + 0.25 * abs(f2 - c), 9) AS dist FROM b5, t) GROUP BY 1""")
def j_nearest(spark, d):
    """A profile per domain, its mean, and the row nearest to it."""
    v = vector_features(spark, d)
    profiles = v.groupBy("domain").agg(*[F.avg(c).alias(c) for c in ("f0", "f1", "f2")])
    near = R.nearest_profiles(v.drop("domain"), profiles, "id", "domain", {"f0": 1.0, "f1": 0.5, "f2": 0.25})
    return near.select("domain", F.col("id").alias("nearest"))


@query("j_apply_labels", f"WITH {vector_sql()} SELECT id, CASE WHEN id % 3 = 0 AND id < 200 THEN 1 ELSE label END AS label FROM b5")
def j_apply_labels(spark, d):
    v = vector_features(spark, d)
    given = spark.range(0, 600, 3).where("id < 200").select("id", F.lit(1).alias("given"))
    return v.join(given, "id", "left").select("id", F.coalesce("given", "label").alias("label"))


@query("j_shared_cols", f"WITH {vector_sql()} SELECT * EXCLUDE (f3) FROM b5")
def j_shared_cols(spark, d):
    a, b = dict(vector_features(spark, d).dtypes), dict(vector_features(spark, d).drop("f3").withColumn("more", F.lit(0)).dtypes)
    shared = sorted(c for c in a if a[c] == b.get(c))
    return vector_features(spark, d).select(*shared)


@query("u_union", "SELECT c_custkey AS k, c_acctbal AS x FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def u_union(spark, d):
    return cust(spark, d).select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x")).unionByName(table(spark, d, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_suppkey").alias("k")))


@query("u_common", f"WITH {vector_sql()} SELECT id, f0, f1 FROM b5 UNION ALL SELECT id + 1000, f0, f1 FROM b5")
def u_common(spark, d):
    v = vector_features(spark, d)
    return U.union_common(v.select("id", "f0", "f1", "f2"), v.select((F.col("id") + 1000).alias("id"), "f1", "f0", "label"))


@query("u_pool", f"WITH {vector_sql()} SELECT f0, CAST(0 AS DOUBLE) AS f9 FROM b5 UNION ALL SELECT 0, f1 FROM b5")
def u_pool(spark, d):
    v = vector_features(spark, d)
    return U.pooled([v.select("f0"), v.select(F.lit("x").alias("f0"), F.col("f1").cast("string").alias("f9"))], ["f0", "f9"])


@query("u_dedup", "SELECT k, id FROM (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS k, event_id AS id FROM events) WHERE k IS NULL OR id = (SELECT min(e.event_id) FROM events e WHERE e.user_id = k AND e.event_id % 50 <> 0)")
def u_dedup(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("k"), F.col("event_id").alias("id"))
    return U.dedup_first(e, "k", ["id"])


@query("u_dedup_agg", "SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events GROUP BY 1")
def u_dedup_agg(spark, d):
    return U.dedup_aggregate(table(spark, d, "events"), "user_id", "value").select("user_id", rounded("mean").alias("mean"), rounded("std").alias("std"), "n")


@query("u_upsert", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value < 100 THEN 0 WHEN value < 300 THEN 1 ELSE 2 END, event_id) AS rk FROM events) WHERE rk = 1")
def u_upsert(spark, d):
    return U.upsert(table(spark, d, "events"), "user_id", F.when(F.col("value") < 100, 0).when(F.col("value") < 300, 1).otherwise(2), ["event_id"]).select("user_id", "event_id")


@query("u_dupcluster", """WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS x, l_returnflag AS y FROM lineitem), c AS (SELECT q, x, count(*) AS n, count(DISTINCT y) > 1 AS conflict FROM k GROUP BY 1, 2)
  SELECT k.q, k.x, k.y, c.n AS cluster_size, conflict AS label_conflict FROM k JOIN c USING (q, x)""")
def u_dupcluster(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("x"), F.col("l_returnflag").alias("y"))
    return U.duplicate_clusters(rows, ["q", "x"], "y").drop("cluster")


@query("u_reservoir", f"SELECT c_custkey FROM customer ORDER BY {_h('c_custkey')} LIMIT 100")
def u_reservoir(spark, d):
    return U.reservoir(cust(spark, d).select("c_custkey"), "c_custkey", 100)


_RANKED = f"SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY {_h('c_custkey')}, c_custkey) AS rk, count(*) OVER () AS total FROM customer"


@query("u_rotate", f"SELECT c_custkey FROM ({_RANKED}) WHERE (rk - 1 - (7 * 230) % total + total) % total < 230")
def u_rotate(spark, d):
    return U.rotating_window(cust(spark, d).select("c_custkey"), "c_custkey", 7, 230)


@query("u_quota", f"""WITH s AS (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT k, n, n * 101 / (SELECT sum(n) FROM s)::DOUBLE AS x FROM s), b AS (SELECT k, n, floor(x) AS base, round(x - floor(x), 9) AS rest FROM e),
  q AS (SELECT k, least(n, base + (row_number() OVER (ORDER BY rest DESC, k) <= 101 - (SELECT sum(base) FROM b))::INT) AS quota FROM b)
  SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_h('c_custkey')}, c_custkey) AS rk FROM customer) JOIN q ON c_mktsegment = k WHERE rk <= quota""")
def u_quota(spark, d):
    return U.stratified_quota(cust(spark, d).select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 101)


@query("u_ratio", f"SELECT c_custkey, CAST(unnest(range(1, 3 + ({_unit('c_custkey')} < 0.3)::INT)) AS INTEGER) AS copy FROM customer")
def u_ratio(spark, d):
    return U.ratio_sample(cust(spark, d).select("c_custkey"), "c_custkey", 2.3)


_BY_LABEL = f"SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_h('id')}, id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM b5"


@query("u_balance", f"WITH {vector_sql()}, r AS ({_BY_LABEL}) SELECT id, label FROM r WHERE rk <= (SELECT min(n) FROM r)")
def u_balance(spark, d):
    return U.balanced(vector_features(spark, d).select("id", "label"), "id", "label")


@query("u_rebalance", f"WITH {vector_sql()}, r AS ({_BY_LABEL}), t AS (SELECT least(count(*) FILTER (label = 1) / 0.25, count(*) FILTER (label = 0) / 0.75) AS total FROM b5) SELECT id, label FROM r, t WHERE rk <= floor(total * CASE WHEN label = 1 THEN 0.25 ELSE 0.75 END + 1e-9)")
def u_rebalance(spark, d):
    return U.rebalance(vector_features(spark, d).select("id", "label"), "id", "label", 0.25)


@query("u_pool_ratio", f"WITH {vector_sql()} SELECT id, CAST(1 AS INTEGER) AS copy FROM b5 WHERE label = 1 AND {_unit('id')} < 0.5 UNION ALL SELECT id, CAST(unnest([1, 2]) AS INTEGER) FROM b5 WHERE label = 0")
def u_pool_ratio(spark, d):
    v = vector_features(spark, d).select("id", "label")
    return U.ratio_sample(v.where("label = 1"), "id", 0.5).union(U.ratio_sample(v.where("label = 0"), "id", 2.0)).select("id", "copy")


_SIDES = f"""WITH {vector_sql()}, x AS (SELECT id, label, CASE label WHEN 1 THEN 'a' ELSE 'b' END AS pool FROM b5), n AS (SELECT count(*) FILTER (pool = 'a') AS na, count(*) FILTER (pool = 'b') AS nb FROM x),
  r AS (SELECT id, pool, row_number() OVER (PARTITION BY pool ORDER BY sha256('s/' || pool || '|' || CAST(id AS VARCHAR)), id) AS rk FROM x)"""


@query("u_pool_share", f"""{_SIDES}, w AS (SELECT *, CAST(floor(least(na / 0.3, nb / (1 - 0.3))) AS BIGINT) AS whole FROM n), t AS (SELECT *, CAST(round_even(whole * 0.3, 0) AS BIGINT) AS ta FROM w)
  SELECT pool, id, CAST(NULL AS BIGINT) AS draw FROM r, t WHERE rk <= CASE pool WHEN 'a' THEN greatest(1, least(ta, na)) ELSE greatest(1, least(whole - ta, nb)) END""")
def u_pool_share(spark, d):
    """The largest pool of positives and negatives of which 30 per cent are positive."""
    v = vector_features(spark, d).select("id", "label")
    return U.pool_at_ratio(v.where("label = 1"), v.where("label = 0"), "id", 0.3).select("pool", "id", "draw")


@query("u_pool_draws", f"""{_SIDES}, t AS (SELECT *, 2 * greatest(na, nb) AS whole, CAST(round_even(2 * greatest(na, nb) * 0.3, 0) AS BIGINT) AS ta FROM n),
  p AS (SELECT 'a' AS pool, unnest(range(ta)) AS draw, na AS n FROM t UNION ALL SELECT 'b', unnest(range(whole - ta)), nb FROM t),
  k AS (SELECT pool, draw, CAST(floor(CAST('0x' || substr(sha256('s/' || pool || '/draw|' || CAST(draw AS VARCHAR)), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE) * n) AS BIGINT) + 1 AS rk FROM p)
  SELECT pool, id, draw FROM k JOIN r USING (pool, rk)""")
def u_pool_draws(spark, d):
    v = vector_features(spark, d).select("id", "label")
    return U.pool_at_ratio(v.where("label = 1"), v.where("label = 0"), "id", 0.3, replace=True).select("pool", "id", "draw")


@query("u_domain_mix", f"""WITH {vector_sql()}, r AS (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY {_h('id')}, id) AS rk FROM b5)
  SELECT id, domain, CAST(unnest(range(1, CASE domain WHEN 1 THEN 4 ELSE 2 END)) AS INTEGER) AS copy, CASE domain WHEN 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS sample_weight FROM r WHERE rk <= CASE domain WHEN 0 THEN 60 WHEN 1 THEN 20 ELSE 100000 END""")
def u_domain_mix(spark, d):
    return U.domain_mix(vector_features(spark, d).select("id", "domain"), "id", "domain", {0: 60, 1: 20}, {1: 3}, {2: 0.5})


@query("u_strat_split", f"WITH {vector_sql()} SELECT id, label, CASE WHEN rk <= CASE WHEN n > 1 THEN greatest(1, floor(n * 0.2 + 0.5)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM ({_BY_LABEL})")
def u_strat_split(spark, d):
    return U.stratified_split(vector_features(spark, d).select("id", "label"), "id", "label", 0.2)


@query("u_bernoulli", f"SELECT c_custkey, CASE WHEN {_unit('c_custkey')} < 0.7 THEN 'train' ELSE 'val' END AS split FROM customer")
def u_bernoulli(spark, d):
    return U.bernoulli_split(cust(spark, d).select("c_custkey"), "c_custkey", 0.7)


@query("u_cutoff", f"SELECT c_custkey, rk <= round(total * 0.7) AS in_train FROM ({_RANKED})")
def u_cutoff(spark, d):
    c = cust(spark, d).select("c_custkey")
    return U.hash_rank(c, "c_custkey", "s").select("c_custkey", (F.col("rank") <= round(c.count() * 0.7)).alias("in_train"))


@query("u_holdout", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'test' ELSE 'train' END AS split FROM orders")
def u_holdout(spark, d):
    return orders(spark, d).select("o_orderkey", F.when(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"), "test").otherwise("train").alias("split"))


@query("u_pack", f"SELECT c_custkey, CAST(floor((rk - 1) / 40) AS BIGINT) AS pack FROM ({_RANKED}) WHERE NOT (floor((rk - 1) / 40) >= floor(total / 40) AND total % 40 < 30)")
def u_pack(spark, d):
    return U.packed(cust(spark, d).select("c_custkey"), "c_custkey", 40, 30)


@query("u_scores", f"WITH {VECTOR_SCORES} SELECT scorer, cycle, count(*) AS n, round(avg(score), 6) AS mean FROM sc GROUP BY 1, 2")
def u_scores(spark, d):
    return vector_scores(spark, d).groupBy("scorer", "cycle").agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("mean"))


@query("j_profiles", f"""WITH {vector_sql()}, t AS (SELECT id AS target, f0 AS a, f1 AS b FROM b5 WHERE id % 50 = 0)
  SELECT target, arg_min(id, (dist, id)) AS id, round(min(dist), 6) + 0.0 AS distance FROM (SELECT target, id, round(abs(f0 - a) + 0.5 * abs(f1 - b), 9) AS dist FROM b5, t WHERE id % 50 <> 0) GROUP BY 1""")
def j_profiles(spark, d):
    """The queries are all rows whose id is divisible by 50, against all others."""
    v = vector_features(spark, d)
    near = R.nearest_profiles(v.where("id % 50 <> 0"), v.where("id % 50 = 0").withColumnRenamed("id", "target"), "id", "target", {"f0": 1.0, "f1": 0.5})
    return near.select("target", "id", rounded("distance").alias("distance"))


@query("u_top_up", f"""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_h('c_custkey')}, c_custkey) AS rk FROM customer),
  f AS (SELECT c_custkey FROM r WHERE rk <= CASE c_mktsegment WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 100000 ELSE 0 END), n AS (SELECT greatest(0, 90 - count(*)) AS k FROM f),
  o AS (SELECT c_custkey, row_number() OVER (ORDER BY {_h('c_custkey')}, c_custkey) AS rk FROM r WHERE c_custkey NOT IN (SELECT c_custkey FROM f))
  SELECT c_custkey FROM f UNION ALL SELECT c_custkey FROM o, n WHERE rk <= k""")
def u_top_up(spark, d):
    return U.topped_up(cust(spark, d).select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 90, {"BUILDING": 5, "MACHINERY": 100_000}).select("c_custkey")


@query("u_lockbox", f"SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN CASE WHEN {_unit('o_orderkey')} < 0.5 THEN 'lockbox' ELSE 'test' END ELSE 'train' END AS split FROM orders")
def u_lockbox(spark, d):
    return U.lockbox(orders(spark, d), "o_orderkey", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", "split")


@query("u_replace", f"SELECT draw, c_custkey FROM (SELECT unnest(range(n)) AS draw, n FROM (SELECT count(*) AS n FROM customer)) JOIN ({_RANKED}) ON rk = CAST(floor({_unit('draw', 's/draw')} * n) AS BIGINT) + 1")
def u_replace(spark, d):
    """As many draws with replacement as there are customers."""
    c = cust(spark, d).select("c_custkey")
    return U.with_replacement(c, "c_custkey", c.count())


@query("u_pack_ranges")
def u_pack_ranges(spark, d):
    return U.packed_ranges(cust(spark, d).select("c_custkey"), "c_custkey", 20, 40)
