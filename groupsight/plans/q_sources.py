"""Queries of readers and writers (A): data of the tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupsight.functions.scalars import rounded
from groupsight.operators.sampling import sorted_places
from groupsight.plans.registry import query
from groupsight.sources import io
from groupsight.sources.bindings import VECTOR_NAMES, table, vector_features, vector_sql
from groupsight.sources.store import cut, shared_path

_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())])
_ALL = "SELECT event_id, user_id, value FROM events"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "value")


@query("a_json_array", _ALL)
def a_json_array(spark, d):
    path = shared_path(spark, "arrays")
    lines = _events(spark, d).groupBy((F.col("event_id") % 97).alias("part")).agg(F.to_json(F.collect_list(F.struct("event_id", "user_id", "value"))).alias("value"))
    # a file per array
    lines.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return io.read_json_array(spark, path, _EVENT)


def _with_noise(spark, d, path: str) -> None:
    line = F.when(F.col("event_id") % 50 == 0, F.lit("not json {")).otherwise(F.to_json(F.struct("event_id", "user_id", "value")))
    _events(spark, d).select(line.alias("value")).write.text(path)


@query("a_ndjson", "SELECT count(*) FILTER (event_id % 50 <> 0) AS good, count(*) FILTER (event_id % 50 = 0) AS bad FROM events")
def a_ndjson(spark, d):
    path = shared_path(spark, "lines")
    _with_noise(spark, d, path)
    rows = io.read_ndjson(spark, path, _EVENT).select("event_id", io.BAD)
    return rows.agg(F.count_if(F.col("event_id").isNotNull()).alias("good"), F.count_if(F.col(io.BAD).isNotNull()).alias("bad"))


@query("a_lines", """WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, event_id, user_id FROM events), f AS (SELECT *, CAST(floor(i / 4000) AS BIGINT) AS file FROM e)
  SELECT file, CAST(i - 4000 * file + floor(i / 7) - floor(4000 * file / 7) + 1 AS BIGINT) AS line, CASE i % 50 WHEN 0 THEN 'bad' WHEN 1 THEN 'other' ELSE 'good' END AS kind, CASE WHEN i % 50 > 1 THEN event_id END AS event_id FROM f""")
def a_lines(spark, d):
    """Files of 4000 records and blank lines between, read in several splits each: number and kind of every line."""
    path = shared_path(spark, "numbered")
    rows = sorted_places(table(spark, d, "events").select("event_id", "user_id"), F.col("event_id")).withColumn("i", F.col("place") - 1)
    line = F.when(F.col("i") % 50 == 0, "not json {").when(F.col("i") % 50 == 1, "[1, 2]").otherwise(F.to_json(F.struct("event_id", "user_id")))
    lines = F.when(F.col("i") % 7 == 6, F.array(line, F.lit("  "))).otherwise(F.array(line))
    rows = rows.select(F.floor(F.col("i") / 4000).alias("file"), "i", F.posexplode(lines).alias("k", "value"))
    rows.repartition("file").sortWithinPartitions("file", "i", "k").select("file", "value").write.partitionBy("file").text(path)
    found = with_splits(spark, 65_536, lambda: cut(io.read_ndjson_lines(spark, path, _EVENT), "lines"))
    return found.select(F.regexp_extract("source_file", "file=([0-9]+)", 1).cast("long").alias("file"), "line", "kind", "event_id")


def with_splits(spark, size: int, run):
    """run() while files are read in splits of at most size bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        return run()
    finally:
        spark.conf.set(key, old)


@query("a_dispatch", f"{_ALL} WHERE event_id % 50 <> 0")
def a_dispatch(spark, d):
    path = shared_path(spark, "lines.jsonl")
    _with_noise(spark, d, path)
    return io.read_records(spark, path, _EVENT)


@query("a_table", "SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders")
def a_table(spark, d):
    return io.read_table(spark, f"{d}/orders.parquet", f"{d}/orders.parquet").select("o_orderkey")


@query("a_split", "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0")
def a_split(spark, d):
    path = shared_path(spark, "splits")
    c = table(spark, d, "customer").select("c_custkey")
    c.where("c_custkey % 5 = 0").write.parquet(f"{path}/val")
    c.where("c_custkey % 5 <> 0").write.parquet(f"{path}/train")
    return io.read_split(spark, path, "val")


@query("a_json_col", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def a_json_col(spark, d):
    return io.json_column(table(spark, d, "events"), "props", T.StructType([T.StructField("k", T.LongType())]), "event_id")


@query("a_zip_labels", "SELECT o_custkey, o_orderkey AS item, CAST(o_totalprice > 200000 AS INTEGER) AS label FROM orders")
def a_zip_labels(spark, d):
    x = F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") > 200000).cast("int").alias("y"))))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(x.alias("x")).select("o_custkey", F.col("x.o_orderkey").alias("groups"), F.col("x.y").alias("labels"))
    return io.labelled_arrays(g, "groups", "labels", ["o_custkey"])


@query("a_text_split", "SELECT doc_id, place - 1 AS place, record FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS record, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents) WHERE trim(record, ' ') <> ''")
def a_text_split(spark, d):
    return io.split_text_records(table(spark, d, "documents"), "text", "\n", ["doc_id"])


@query("a_dates", "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def a_dates(spark, d):
    return io.distinct_dates(table(spark, d, "events"), "ts").select(F.col("day").cast("string").alias("day"))


def _files(spark, path: str, kind: str):
    return spark.read.format(kind).load(path).groupBy(F.col("_metadata.file_path").alias("f")).count()


@query("a_parts", "SELECT count(*) AS n_rows, true AS within FROM customer")
def a_parts(spark, d):
    path = shared_path(spark, "parts")
    io.write_parts(table(spark, d, "customer"), path, 400)
    return _files(spark, path, "parquet").agg(F.sum("count").alias("n_rows"), (F.max("count") <= 400).alias("within"))


@query("a_rotate", "SELECT count(*) AS n_rows, true AS within, true AS full FROM events")
def a_rotate(spark, d):
    """Rows, whether every file's size keeps the bound, and whether files are as few as tasks allow."""
    path, bound = shared_path(spark, "rotated"), 20_000
    # a table's file may have few row groups, and a task makes its files one by one: all cores take part
    io.write_rotating(table(spark, d, "events").repartition(spark.sparkContext.defaultParallelism), path, bound)
    files = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("length")).agg(F.count("*").alias("lines"))
    task = F.regexp_extract("name", "part-([0-9]+)-", 1).alias("task")
    sizes = files.groupBy(task).agg(F.max("length").alias("most"), F.sum("length").alias("total"), F.count("*").alias("n"), F.sum("lines").alias("lines"))
    # two neighbouring files of a task together hold more than the bound
    full = F.bool_and(F.col("n") <= 2 * F.col("total") / bound + 1)
    return sizes.agg(F.sum("lines").alias("n_rows"), (F.max("most") <= bound).alias("within"), full.alias("full"))


@query("a_resume", "SELECT event_id % 8 AS shard, count(*) AS n FROM events GROUP BY 1")
def a_resume(spark, d):
    path = shared_path(spark, "shards")
    rows = _events(spark, d).withColumn("shard", F.col("event_id") % 8)
    io.write_missing_shards(rows.where("shard < 3"), path, "shard", None)
    io.write_missing_shards(rows, path, "shard", spark.read.parquet(path))
    return spark.read.parquet(path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"))


@query("a_buckets", "SELECT CASE WHEN value < 100 THEN 'low' WHEN value < 300 THEN 'med' ELSE 'high' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def a_buckets(spark, d):
    path = shared_path(spark, "buckets")
    io.write_buckets(_events(spark, d), path, F.when(F.col("value") < 100, "low").when(F.col("value") < 300, "med").otherwise("high"))
    schema = T.StructType([*_EVENT.fields, T.StructField("bucket", T.StringType())])
    return spark.read.schema(schema).json(path).groupBy("bucket").agg(F.count("*").alias("n"))


@query("a_matrix", f"WITH {vector_sql()} SELECT id, round({' + '.join(f"{i + 1} * {c}" for i, c in enumerate(VECTOR_NAMES))}, 6) + 0.0 AS dot, label, CAST(greatest(2, least(10, round_even((id % 14)::DOUBLE, 0))) - 2 AS INTEGER) AS seat_bucket FROM b5")
def a_matrix(spark, d):
    m = io.export_matrix(vector_features(spark, d).withColumn("seats", (F.col("id") % 14).cast("double")), "id", VECTOR_NAMES, "label", "seats")
    return m.select("id", rounded(F.aggregate(F.transform("features", lambda x, i: (i + 1) * x), F.lit(0.0), lambda s, x: s + x)).alias("dot"), "label", "seat_bucket")


_CUSTOMER_HASH = """sha256('{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"label":' || (c_acctbal > 5000)::INT || '}')"""
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _manifest(spark, d):
    """The manifest of the files that customers were written to, which must be that of the table."""
    path = shared_path(spark, "with_manifest")
    rows = table(spark, d, "customer").withColumn("label", (F.col("c_acctbal") > 5000).cast("int"))
    found = io.write_with_manifest(rows, path, "label", "c_mktsegment", _SEGMENTS)
    if found != io.manifest(rows, "label", "c_mktsegment", _SEGMENTS):
        raise ValueError("the manifest is not that of the table")
    return spark.createDataFrame([found], io.MANIFEST)


@query("a_manifest", f"""WITH h AS (SELECT *, {_CUSTOMER_HASH} AS h FROM customer), p AS (SELECT count(*) AS n, """ + ", ".join(f"sum(CAST('0x' || substr(h, {15 * k + 1}, 15) AS BIGINT)) AS s{k}" for k in range(4)) + """, count(*) FILTER (c_acctbal > 5000) AS positives FROM h)
  SELECT n AS n_rows, positives, n - positives AS negatives, round(positives / n, 6) AS positive_share, 6 AS n_columns, sha256('c_custkey:bigint|c_name:string|c_nationkey:int|c_acctbal:double|c_mktsegment:string|label:int') AS schema_hash, sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS dataset_hash FROM p""")
def a_manifest(spark, d):
    return _manifest(spark, d).withColumn("positive_share", rounded("positive_share")).drop("inputs")


@query("a_manifest_inputs", "SELECT s AS input, count(c_custkey) AS n_rows, count(*) FILTER (c_acctbal > 5000) AS positives FROM (VALUES " + ", ".join(f"('{s}')" for s in _SEGMENTS) + ") v(s) LEFT JOIN customer ON c_mktsegment = s GROUP BY 1")
def a_manifest_inputs(spark, d):
    return _manifest(spark, d).select(F.inline("inputs"))


@query("a_count", "SELECT count(*) AS n FROM lineitem")
def a_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))
