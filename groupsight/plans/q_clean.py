"""Queries of projections, filters and validation (P)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupsight.functions import scalars as S
from groupsight.functions.scalars import rounded
from groupsight.operators import clean as C
from groupsight.operators import reports as P
from groupsight.operators import records as R
from groupsight.plans.registry import query
from groupsight.sources.bindings import DOCUMENT_FEATURE_NAMES, DOCUMENT_FEATURES, ORDER_EVENTS, document_features, order_events, table, user_events, vector_features, vector_sql


def _nested(spark, d):
    """Orders as nested records: meta, lines."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    orders = table(spark, d, "orders")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.struct("o_custkey", "o_orderstatus", "o_totalprice").alias("meta"), "lines")


_WANT = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("meta", T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("note", T.StringType())])),
    T.StructField("lines", T.ArrayType(T.StructType([T.StructField("l_partkey", T.LongType()), T.StructField("extra", T.DoubleType())]))),
])


@query("p_enforce", "SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS note, count(*) AS n_lines, CAST(sum(l_partkey) AS BIGINT) AS parts, 0::BIGINT AS extras FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def p_enforce(spark, d):
    out = C.enforce_schema(_nested(spark, d), _WANT)
    parts = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["l_partkey"])
    return out.select("o_orderkey", "meta.o_custkey", "meta.note", F.size("lines").cast("long").alias("n_lines"), parts.alias("parts"),
                      F.size(F.filter("lines", lambda x: x["extra"].isNotNull())).cast("long").alias("extras"))


@query("p_strip")
def p_strip(spark, d):
    return C.strip_private(_nested(spark, d), {"l_suppkey", "o_custkey"})


_RAW = "CASE event_id % 7 WHEN 0 THEN 'Re-Raise' WHEN 1 THEN ' CALL ' WHEN 2 THEN 'muck' WHEN 3 THEN 'bet all' WHEN 4 THEN 'checks' WHEN 5 THEN 'folded' ELSE 'noise' END"
_CLEAN = """CASE WHEN t IN ('call', 'check', 'bet', 'raise', 'fold', 'all_in') THEN t WHEN contains(t, 'raise') THEN 'raise' WHEN contains(t, 'bet') THEN 'bet' WHEN contains(t, 'call') THEN 'call'
  WHEN contains(t, 'check') THEN 'check' WHEN contains(t, 'fold') OR t = 'muck' THEN 'fold' ELSE '' END"""


@query("p_event_type", f"SELECT event_id, {_CLEAN} AS type FROM (SELECT event_id, lower(trim({_RAW})) AS t FROM events)")
def p_event_type(spark, d):
    return table(spark, d, "events").select("event_id", S.event_type(F.expr(_RAW)).alias("type"))


@query("p_infer_type", f"""SELECT event_id, CASE WHEN {_CLEAN} <> '' THEN {_CLEAN} WHEN value > 400 THEN 'raise' WHEN value > 300 THEN 'call'
  WHEN value > 200 THEN CASE WHEN user_id % 3 > 1 THEN 'bet' ELSE 'call' END WHEN user_id % 3 <= 1 THEN 'check' ELSE 'call' END AS type
  FROM (SELECT *, lower(trim({_RAW})) AS t FROM events)""")
def p_infer_type(spark, d):
    v, over = F.col("value"), lambda x: F.greatest(F.col("value") - x, F.lit(0.0))
    kind = S.infer_event_type(F.expr(_RAW), over(200.0), over(400.0), F.when(v <= 400, over(300.0)).otherwise(0.0), F.lit(1), F.col("user_id") % 3)
    return table(spark, d, "events").select("event_id", kind.alias("type"))


@query("p_units", "SELECT event_id, CASE WHEN user_id % 5 > 0 THEN round_even(greatest(0, least(50, value / ((user_id % 5) * 1.37))), 2) ELSE 0 END AS units FROM events")
def p_units(spark, d):
    return table(spark, d, "events").select("event_id", S.to_units(F.col("value"), (F.col("user_id") % 5).cast("double") * 1.37, 50.0).alias("units"))


_BUCKETS = "[" + ", ".join(str(b) for b in S.SIZE_BUCKETS) + "]"


@query("p_coarsen", f"""WITH n AS (SELECT event_id, value / 10 AS v, list_sort(list_transform({_BUCKETS}, lambda b: {{'d': abs(b - value / 10), 'b': b}}))[1].b AS near,
  CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR) || '|amount'), 3, 2) AS INTEGER) / 255.0::DOUBLE * 2 - 1 AS noise FROM events)
  SELECT event_id, round(CASE WHEN v <= 0 THEN 0 ELSE round_even(greatest(0, least(126, near + noise * CASE WHEN near <= 1.5 THEN 0.08 WHEN near <= 8 THEN 0.22 ELSE greatest(0.35, near * 0.05) END)), 2) END, 1) AS coarse FROM n""")
def p_coarsen(spark, d):
    coarse = S.coarsen(F.col("value") / 10, F.col("event_id").cast("string"), F.lit("amount"))
    return table(spark, d, "events").select("event_id", rounded(coarse, 1).alias("coarse"))


@query("p_alias", f"WITH {ORDER_EVENTS} SELECT sess, actor, CAST(row_number() OVER (PARTITION BY sess ORDER BY min(ord)) AS BIGINT) AS alias FROM b1 GROUP BY sess, actor")
def p_alias(spark, d):
    e = order_events(spark, d).groupBy("sess").agg(F.sort_array(F.collect_list(F.struct("ord", (F.col("actor") + 1).alias("actor")))).alias("e"))  # an actor may be number 0
    names = C.alias_actors(F.col("e.actor"), F.array().cast("array<bigint>"), 10)
    return e.withColumn("names", names).select("sess", F.explode(F.array_distinct("e.actor")).alias("actor"), "names").select("sess", (F.col("actor") - 1).alias("actor"), F.array_position("names", F.col("actor")).alias("alias"))


def _noop_events(spark, d):
    e = user_events(spark, d)
    return e.withColumn("amount", F.when(F.col("type").isin("check", "fold"), 0.0).otherwise(F.col("amount"))).withColumn("stage", F.lit(0))


@query("p_collapse", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, CASE event_type WHEN 'view' THEN 'check' WHEN 'error' THEN 'fold' ELSE event_type END AS t FROM events),
  k AS (SELECT *, lag(t) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS before FROM e)
  SELECT CAST(user_id AS VARCHAR) || '/' || CAST(day AS VARCHAR) AS sess, count(*) AS kept FROM k WHERE NOT (t IN ('check', 'fold') AND coalesce(before = t, false)) GROUP BY 1""")
def p_collapse(spark, d):
    return C.collapse_noops(_noop_events(spark, d)).groupBy("sess").agg(F.count("*").alias("kept"))


@query("p_sample")
def p_sample(spark, d):
    return C.sample_events(order_events(spark, d))


@query("p_canonical")
def p_canonical(spark, d):
    return C.canonical_view(order_events(spark, d), unit=2.0)


@query("p_quality", f"WITH {ORDER_EVENTS} SELECT sess, count(DISTINCT actor) AS n_actors, count(*) AS n_events FROM b1 GROUP BY 1 HAVING count(DISTINCT actor) BETWEEN 2 AND 6 AND count(*) >= 3 AND min(amount) > 0")
def p_quality(spark, d):
    return C.filter_quality(order_events(spark, d), 2, 3, 6)


@query("p_consistency", """SELECT o_orderkey, CASE WHEN bad_price THEN 'price ' ELSE '' END || CASE WHEN bad_qty THEN 'quantity ' ELSE '' END || CASE WHEN bad_status THEN 'status ' ELSE '' END AS errors FROM (
  SELECT o_orderkey, NOT coalesce(o_totalprice > 100000, false) AS bad_price, NOT coalesce(sum(l_quantity) >= 60, false) AS bad_qty, NOT coalesce(o_orderstatus IN ('F', 'O'), false) AS bad_status
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice, o_orderstatus)""")
def p_consistency(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    o = table(spark, d, "orders").join(q, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    errors = C.consistency_errors({"price": F.col("o_totalprice") > 100000, "quantity": F.col("q") >= 60, "status": F.col("o_orderstatus").isin("F", "O")})
    return o.select("o_orderkey", F.concat_ws("", F.transform(errors, lambda x: F.concat(x, F.lit(" ")))).alias("errors"))


@query("p_validate", f"WITH {DOCUMENT_FEATURES}, x AS (SELECT *, CASE WHEN id % 10 = 0 THEN NULL ELSE word_len END AS w FROM b4) SELECT 'bad_label' AS issue, count(*) FILTER (label IS NULL) AS n FROM x UNION ALL SELECT 'missing_word_len', count(*) FILTER (w IS NULL) FROM x")
def p_validate(spark, d):
    x = document_features(spark, d).withColumn("word_len", F.when(F.col("id") % 10 != 0, F.col("word_len")))
    return C.validate_features(x, DOCUMENT_FEATURE_NAMES)


@query("p_validate_pair", """WITH t AS (SELECT l_quantity AS q, l_discount AS x, l_tax AS y, l_suppkey % 3 AS s FROM lineitem WHERE l_orderkey % 2 = 0), v AS (SELECT l_quantity AS q, l_discount AS x, l_tax AS y, l_suppkey % 3 AS s FROM lineitem WHERE l_orderkey % 2 = 1)
  SELECT 'train_repeats' AS "check", CAST((SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS BIGINT) AS n
  UNION ALL SELECT 'val_repeats', (SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) UNION ALL SELECT 'overlap', (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM v))""")
def p_validate_pair(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), (F.col("l_suppkey") % 3).alias("s"))
    return C.validate_pair(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), ["q", "x", "y", "s"])


@query("p_validate_groups", "SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(l_orderkey) = 0")
def p_validate_groups(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").count()
    out = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("count", F.lit(0)).cast("long").alias("n_lines")).where("n_lines = 0")


@query("p_align", f"WITH {vector_sql()} SELECT id, label, f1, f0 FROM b5")
def p_align(spark, d):
    return C.align_columns(vector_features(spark, d), ["id", "label", "f1", "f0"], "strip")


@query("p_align_ref", f"WITH {vector_sql()} SELECT id, f1, CAST(NULL AS DOUBLE) AS extra, f0 FROM b5")
def p_align_ref(spark, d):
    v = vector_features(spark, d)
    return C.align_to_reference(v, v.select("id", "f1", F.lit(0.0).alias("extra"), "f0"))


@query("p_align_common", f"WITH {vector_sql()} SELECT id, f1, f0 FROM b5")
def p_align_common(spark, d):
    v = vector_features(spark, d)
    return C.align_to_reference(v, v.select("id", "f1", F.lit(0.0).alias("extra"), "f0"), intersect=True)


@query("p_subset", f"WITH {vector_sql()} SELECT label, f0, f1 FROM b5")
def p_subset(spark, d):
    return vector_features(spark, d).select("label", "f0", "f1")


_HOLES = "CASE WHEN id % {0} = 0 THEN NULL ELSE f{1} END AS f{1}"


@query("p_sparse", f"WITH {vector_sql()}, h AS (SELECT id, {', '.join(_HOLES.format(k + 2, k) for k in range(64))} FROM b5) SELECT id FROM h WHERE " + " + ".join(f"(f{k} IS NULL)::INT" for k in range(64)) + " <= 16")
def p_sparse(spark, d):
    h = vector_features(spark, d).selectExpr("id", *[_HOLES.format(k + 2, k) for k in range(64)])
    return C.drop_sparse_rows(h, [f"f{k}" for k in range(64)], 0.25).select("id")


_MESSY = "CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id * 2 AS {0}) END"


@query("p_coerce", f"SELECT event_id, TRY_CAST({_MESSY.format('VARCHAR')} AS DOUBLE) AS x, CAST(coalesce({_MESSY.format('VARCHAR')} = 'n/a', false) AS INTEGER) AS coercion_failures FROM events")
def p_coerce(spark, d):
    return C.coerce_numeric(table(spark, d, "events").selectExpr("event_id", f"{_MESSY.format('STRING')} AS x"), ["x"])


_LABELS = "CASE event_id % 6 WHEN 0 THEN ' BOT' WHEN 1 THEN 'human' WHEN 2 THEN 'yes' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' END"


@query("p_label", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS label FROM events")
def p_label(spark, d):
    return C.coerce_label(table(spark, d, "events").selectExpr("event_id", f"{_LABELS} AS label"))


@query("p_anon", "SELECT event_id, sha256('salt' || CAST(user_id AS VARCHAR)) AS who FROM events")
def p_anon(spark, d):
    return table(spark, d, "events").select("event_id", C.pseudonym(F.col("user_id"), "salt").alias("who"))


def _hashed(name: str) -> str:
    return "h_" + hashlib.sha256(f"salt{name}".encode()).hexdigest()[:16]


@query("p_hash_cols", f"WITH {vector_sql()} SELECT id, label, " + ", ".join(f"{c} AS {_hashed(c)}" for c in ("domain", *[f"f{i}" for i in range(64)])) + " FROM b5")
def p_hash_cols(spark, d):
    return C.hashed_column_names(vector_features(spark, d), "salt", ("id", "label"))


_TEXT = "CASE WHEN {0} IS NULL THEN 'null' ELSE '\"' || {0} || '\"' END"
_RH = f"""sha256('{{"c_custkey":' || c_custkey || ',"c_mktsegment":' || {_TEXT.format('c_mktsegment')} || ',"c_name":' || {_TEXT.format('c_name')} || '}}')"""


@query("p_record_hash", f"SELECT c_custkey, {_RH} AS h FROM customer")
def p_record_hash(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", C.record_hash(c, ["c_name", "c_custkey", "c_mktsegment"]).alias("h"))


@query("p_nested_hash", """WITH o AS (SELECT o_custkey, string_agg('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) AS os, count(*) AS n FROM orders GROUP BY 1)
  SELECT c_custkey, sha256('{"counts":{"a":' || n || ',"b":null},"name":"' || c_name || '","orders":[' || os || '],"where":{"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}}') AS h FROM customer JOIN o ON c_custkey = o_custkey""")
def p_nested_hash(spark, d):
    """Customers with their orders, a struct and a map, whose fields and entries come in another order than they are hashed in."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    swapped = F.transform("orders", lambda x: F.struct(x["status"].alias("status"), x["key"].alias("key")))
    c = table(spark, d, "customer").join(o, "c_custkey").select(
        "c_custkey", F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("where"), swapped.alias("orders"), F.col("c_name").alias("name"),
        F.create_map(F.lit("b"), F.lit(None).cast("int"), F.lit("a"), F.size("orders")).alias("counts"),
    )
    return c.select("c_custkey", C.record_hash(c, ["where", "orders", "name", "counts"]).alias("h"))


@query("p_dataset_hash", f"""WITH h AS (SELECT {_RH} AS h FROM customer), a AS (SELECT substr(h, 1, 5) AS p5, sha256(string_agg(h, '|' ORDER BY h)) AS h FROM h GROUP BY 1),
  b AS (SELECT substr(p5, 1, 2) AS p2, sha256(string_agg(h, '|' ORDER BY h)) AS h FROM a GROUP BY 1) SELECT sha256(string_agg(h, '|' ORDER BY h)) AS dataset_hash, count(*) AS prefixes FROM b""")
def p_dataset_hash(spark, d):
    c = table(spark, d, "customer")
    return C.dataset_hash(c.select(C.record_hash(c, ["c_name", "c_custkey", "c_mktsegment"]).alias("h")), "h")


@query("p_shorthand", f"WITH {ORDER_EVENTS} SELECT sess, string_agg('s' || stage || ':' || upper(substr(type, 1, 1)) || ':' || actor, ' | ' ORDER BY ord) AS line FROM b1 GROUP BY 1")
def p_shorthand(spark, d):
    return P.compact_session(order_events(spark, d))


_REPLY = "CASE event_id % 4 WHEN 0 THEN 'Sure: ```json {\"label\": 1}```' WHEN 1 THEN '{\"label\": 0, \"why\": \"x\"}' WHEN 2 THEN 'I say 1.' ELSE 'none' END"


@query("p_reply", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS label FROM events")
def p_reply(spark, d):
    return table(spark, d, "events").select("event_id", C.parse_label_reply(F.expr(_REPLY)).alias("label"))


@query("p_flatten", "SELECT c_custkey, 'a.balance' AS path, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'a.b.nation', c_nationkey FROM customer")
def p_flatten(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance"), F.struct(F.col("c_nationkey").alias("nation")).alias("b")).alias("a"))
    return C.flatten_metrics(c, ["c_custkey"])


@query("p_stratum", f"""WITH {ORDER_EVENTS}, s AS (SELECT sess, max(stack) / 10 AS u, count(DISTINCT actor) AS a, max(stage) AS st, count(*) AS n FROM b1 GROUP BY 1)
  SELECT sess, CASE WHEN u < 0.1 THEN 'micro' WHEN u < 1 THEN 'low' WHEN u < 5 THEN 'mid' ELSE 'high' END || '|' || CASE WHEN a <= 2 THEN 'hu' WHEN a <= 6 THEN 'sh' ELSE 'fr' END || '|' ||
  CASE st WHEN 0 THEN 'pf' WHEN 1 THEN 'flop' ELSE 'deep' END || '|' || CASE WHEN n <= 6 THEN 'short' WHEN n <= 14 THEN 'mid' ELSE 'long' END AS stratum FROM s""")
def p_stratum(spark, d):
    e = order_events(spark, d).groupBy("sess").agg((F.max("stack") / 10).alias("u"), F.count_distinct("actor").alias("a"), F.max("stage").alias("st"), F.count("*").alias("n"))
    return e.select("sess", P.stratum_key(F.col("u"), F.col("a"), F.col("st"), F.col("n")).alias("stratum"))


@query("p_compliance", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'repo ' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN 'version ' ELSE '' END AS missing, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN 'opaque' ELSE 'transparent' END AS status FROM customer")
def p_compliance(spark, d):
    c = table(spark, d, "customer")
    missing = C.compliance({"name": F.col("c_name"), "repo": F.when(F.col("c_custkey") % 3 != 0, F.lit("r")), "version": F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).otherwise(F.lit("1"))})
    c = c.withColumn("m", missing)
    return c.select("c_custkey", F.concat_ws("", F.transform("m", lambda x: F.concat(x, F.lit(" ")))).alias("missing"), F.when(F.size("m") > 0, "opaque").otherwise("transparent").alias("status"))


_RECORD_SQL = """WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 4) AS paid, count(*) AS n FROM lineitem GROUP BY 1),
  r AS (SELECT o_orderkey, n, CASE WHEN o_orderkey % 3 = 0 THEN paid + 1.25 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS total, paid,
  CASE WHEN o_orderkey % 4 = 0 THEN 4 WHEN o_orderkey % 4 = 1 THEN 0 ELSE 3 END AS board, CASE WHEN o_orderkey % 2 = 0 THEN 'turn' ELSE 'preflop' END AS ended FROM orders JOIN l ON o_orderkey = l_orderkey)
  SELECT o_orderkey, CASE WHEN board = 3 THEN 'board ' ELSE '' END || CASE WHEN ended <> CASE board WHEN 4 THEN 'turn' WHEN 0 THEN 'preflop' ELSE 'flop' END THEN 'end ' ELSE '' END
  || CASE WHEN n > 4 THEN 'private ' ELSE '' END || CASE WHEN total IS NOT NULL AND abs(total - paid - 1.25) > 0.004 THEN 'total ' ELSE '' END AS errors FROM r"""


@query("p_records", _RECORD_SQL)
def p_records(spark, d):
    """Orders as sessions: line prices are payouts, the board has three cards on the turn where it ought to have four."""
    by_place = F.transform(F.collect_list("l_extendedprice"), lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("v")))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.map_from_entries(by_place).alias("payouts"), F.round(F.sum("l_extendedprice"), 4).alias("paid"), F.count("*").alias("n"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.col("o_orderkey") % 4
    cards = F.sequence(F.lit(1), F.when(key == 0, 4).otherwise(3))
    stages = F.when(key == 1, F.array().cast("array<struct<stage:string,board:array<int>>>")).otherwise(F.array(F.struct(F.lit("turn").alias("stage"), cards.alias("board"))))
    total = F.when(F.col("o_orderkey") % 3 == 0, F.col("paid") + 1.25).when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_totalprice"))
    private = F.array(F.sequence(F.lit(1), F.when(F.col("n") > 4, 3).otherwise(2)), F.lit(None).cast("array<int>"))
    errors = R.session_errors(F.col("payouts"), F.lit(1.25), total, private, stages, F.when(F.col("o_orderkey") % 2 == 0, "turn").otherwise("preflop"))
    return o.select("o_orderkey", F.concat_ws("", F.transform(errors, lambda x: F.concat(x, F.lit(" ")))).alias("errors"))


@query("p_manifest", """WITH m AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS open, CASE WHEN c_custkey % 5 = 0 THEN 'https://host/own' ELSE 'https://host/' || c_custkey END AS url, CASE WHEN c_custkey % 7 = 0 THEN '<sha>' ELSE substr(md5(c_name), 1, 12) END AS sha FROM customer)
  SELECT k, CASE WHEN open THEN '' ELSE 'open_source ' END || CASE WHEN k % 3 = 0 THEN 'implementation_files ' ELSE '' END AS missing, CASE WHEN k % 7 = 0 THEN 'repo_commit_invalid ' ELSE '' END || CASE WHEN k % 5 = 0 AND k % 10 <> 0 THEN 'repo_url_must_point_to_model_repo ' ELSE '' END AS violations,
  CASE WHEN open THEN '' ELSE 'manifest_not_open_source ' END AS suspicion, CASE WHEN open AND k % 3 <> 0 AND k % 7 <> 0 AND (k % 5 <> 0 OR k % 10 = 0) THEN 'transparent' ELSE 'opaque' END AS status FROM m""")
def p_manifest(spark, d):
    k, text = F.col("c_custkey"), F.lit("said")
    fields = {"open_source": k % 2 == 0, "repo_url": F.when(k % 5 == 0, "https://HOST/own/").otherwise(F.concat(F.lit("https://host/"), k.cast("string"))),
              "repo_commit": F.when(k % 7 == 0, "<sha>").otherwise(F.substring(F.md5("c_name"), 1, 12)), "model_name": F.when(k % 10 == 0, "reference").otherwise("mine"),
              "model_version": text, "training_data_statement": text, "private_data_attestation": text}
    files = F.when(k % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("a.py")))
    words = lambda c: F.concat_ws("", F.transform(F.col(f"m.{c}"), lambda x: F.concat(x, F.lit(" ")))).alias(c)
    m = table(spark, d, "customer").select(k.alias("k"), R.manifest_report(fields, files, F.lit("abc"), "https://host/own", ("reference",)).alias("m"))
    return m.select("k", words("missing"), words("violations"), words("suspicion"), "m.status")


@query("p_anon_nested", """SELECT l_orderkey, string_agg('p_' || sha256('salt' || l_suppkey), ' ' ORDER BY sha256('salt' || l_suppkey)) AS people, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_keys FROM lineitem GROUP BY 1""")
def p_anon_nested(spark, d):
    """Suppliers as players in an array of structs, parts as keys of a map."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct("l_suppkey", "l_quantity")).alias("players"), F.map_from_arrays(F.collect_set(F.col("l_partkey").cast("string")), F.collect_set(F.col("l_partkey").cast("string"))).alias("payouts"))
    out = R.with_pseudonyms(rows, ["players.l_suppkey", "payouts"], "salt")
    known = F.filter(F.map_entries("payouts"), lambda e: e["key"] == F.concat(F.lit("p_"), F.sha2(F.concat(F.lit("salt"), e["value"]), 256)))
    return out.select("l_orderkey", F.array_join(F.sort_array("players.l_suppkey"), " ").alias("people"), F.size(known).cast("long").alias("n_keys"))


@query("p_flatten_map", "SELECT c_custkey, 'a.m.' || c_mktsegment AS path, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'a.n', c_nationkey FROM customer")
def p_flatten_map(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.struct(F.create_map("c_mktsegment", "c_acctbal").alias("m"), F.col("c_nationkey").alias("n")).alias("a"))
    return C.flatten_metrics(c, ["c_custkey"])


@query("p_strip_map", "SELECT c_custkey, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS BIGINT) AS n FROM customer")
def p_strip_map(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.array(F.create_map(F.col("c_mktsegment"), F.lit(1), F.lit("seat"), F.lit(2))).alias("a"))
    return C.strip_private(c, {"BUILDING"}).select("c_custkey", F.size(F.col("a")[0]).cast("long").alias("n"))


@query("p_group_issues", "SELECT 'empty_group' AS issue, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) HAVING count(*) > 0 UNION ALL SELECT 'leakage_o_orderstatus', count(*) FROM customer")
def p_group_issues(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("sessions"))
    g = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "sessions")
    return R.group_issues(g, "sessions", {"o_orderstatus", "is_bot"})


@query("p_protected", f"WITH {vector_sql()} SELECT id, label, f1 FROM b5")
def p_protected(spark, d):
    return R.select_columns(vector_features(spark, d), drop=["domain", "label", "nowhere"], keep=["id", "f1", "domain"])
