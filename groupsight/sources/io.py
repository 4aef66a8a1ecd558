"""Readers and writers. Schemas are given, never inferred; paths go to Spark alone, so any store it reads will do."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupsight.functions.scalars import canonical_json

BAD = "_bad_record"


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of files that hold one top-level JSON array each; gzip by suffix."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line, with source_file; a line that is none has NULL fields and its text in _bad_record."""
    whole = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = spark.read.schema(whole).option("columnNameOfCorruptRecord", BAD).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("source_file", F.col("_metadata.file_path"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line, value): all lines of text files with their numbers from 1, however files are split or compressed.

    A split's rows are read by one task in the file's order, so their running ids differ from the split's first by their place in it; what
    comes before a split is the sum of the line counts of the file's earlier splits, a row each.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("source_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("source_file", "_start", (before - F.col("_first")).alias("_shift"))
    return rows.join(offsets, ["source_file", "_start"]).select("source_file", (F.col("_id") + F.col("_shift") + 1).alias("line"), "value")


def read_ndjson_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(source_file, line, kind, fields): blank lines are left out but counted; kind is 'good', 'bad' (no JSON) or 'other' (JSON, but no object), whose fields are NULL."""
    whole = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = read_lines(spark, path).where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    parsed = rows.withColumn("_r", F.from_json("value", whole, {"columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"}))
    good = F.col("_r").isNotNull() & F.col(f"_r.{BAD}").isNull() & F.ltrim("value").startswith("{")
    kind = F.when(good, "good").when(F.try_parse_json("value").isNull() | F.ltrim("value").startswith("{"), "bad").otherwise("other")
    return parsed.select("source_file", "line", kind.alias("kind"), *[F.when(good, F.col("_r")[f.name]).alias(f.name) for f in schema.fields])


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By suffix: .jsonl and .ndjson by line, .json as an array, each also with .gz; .parquet."""
    name = path.removesuffix(".gz")
    if name.endswith((".jsonl", ".ndjson")):
        return read_ndjson(spark, path, schema).where(F.col(BAD).isNull()).drop(BAD, "source_file")
    return spark.read.schema(schema).parquet(path) if name.endswith(".parquet") else read_json_array(spark, path, schema)


def read_table(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV files, concatenated."""
    if paths[0].endswith(".csv"):
        return spark.read.schema(schema).option("header", True).csv(list(paths))
    return spark.read.parquet(*paths)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """'train' or 'val' of a folder that holds a table per split, one file or many."""
    if split not in ("train", "val"):
        raise ValueError(f"no such split: {split}")
    return spark.read.parquet(f"{folder}/{split}*")


def json_column(df: DataFrame, column: str, schema: T.StructType, order: str) -> DataFrame:
    """(order, fields) of records held as JSON text."""
    return df.select(order, F.from_json(column, schema).alias("r")).select(order, "r.*")


def labelled_arrays(df: DataFrame, groups: str, labels: str, keep: list[str]) -> DataFrame:
    """(keep, item, label): an array and the array of its labels, one by one; lengths that differ and labels other than 0 and 1 stop the job."""
    ok = (F.size(groups) == F.size(labels)) & F.forall(labels, lambda y: y.isin(0, 1))
    checked = df.withColumn("_ok", F.assert_true(ok, F.lit("labels do not match their groups")))
    zipped = F.arrays_zip(F.col(groups).alias("item"), F.col(labels).alias("label"))
    return checked.where(F.col("_ok").isNull()).select(*keep, F.explode(zipped).alias("x")).select(*keep, "x.item", "x.label")


def split_text_records(df: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """(keep, place, record): one row per part of a text between matches of the pattern; blank parts go."""
    parts = df.select(*keep, F.posexplode(F.split(text, pattern)).alias("place", "record"))
    return parts.where(F.trim("record") != "")


def distinct_dates(df: DataFrame, ts: str) -> DataFrame:
    return df.select(F.to_date(ts).alias("day")).where("day IS NOT NULL").distinct()


def write_parts(df: DataFrame, path: str, rows_per_file: int) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_rotating(df: DataFrame, path: str, max_bytes: int) -> None:
    """JSON lines in files of at most max_bytes, but for single longer rows, which have a file each.

    Each task adds up the bytes of its lines and begins a new file where the next line would go over. A file's lines go to the writer as one text, and
    the writer gives each text a file: no folder is made and moved for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, held = [], 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(0).cast(pa.large_binary())).to_numpy(zero_copy_only=False) + 1)
            rows, at, base, full = batch.column(0).to_pylist(), 0, 0, []
            while at < len(rows):
                fits = int(np.searchsorted(ends, base + max_bytes - held, "right"))
                if fits <= at and held:
                    full.append("\n".join(lines))
                    lines, held = [], 0
                    continue
                fits = max(fits, at + 1)  # a row longer than a file is alone in its own
                lines += rows[at:fits]
                held, base, at = held + int(ends[fits - 1]) - base, int(ends[fits - 1]), fits
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.string())], ["value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(lines)], pa.string())], ["value"])

    texts = df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string")
    texts.write.option("maxRecordsPerFile", 1).text(path)


def write_missing_shards(df: DataFrame, path: str, shard: str, present: DataFrame | None) -> None:
    """Shards of df that are not present yet, each as a folder; the commit protocol shows a shard whole or not at all."""
    rows = df if present is None else df.join(present.select(shard).distinct(), shard, "left_anti")
    rows.write.mode("append").partitionBy(shard).parquet(path)


def write_buckets(df: DataFrame, path: str, bucket: Column) -> None:
    """JSON lines in a folder per bucket."""
    df.withColumn("bucket", bucket).write.partitionBy("bucket").json(path)


def export_matrix(df: DataFrame, key: str, features: list[str], label: str, seats: str) -> DataFrame:
    """(key, features array, label, seat_bucket): seat counts 2 to 10 as buckets 0 to 8."""
    bucket = (F.greatest(F.lit(2), F.least(F.lit(10), F.bround(F.coalesce(F.col(seats), F.lit(2.0)), 0))) - 2).cast("int")
    return df.select(key, F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in features]).alias("features"), label, bucket.alias("seat_bucket"))


def _measures(df: DataFrame, label: str, source: str | None, inputs: list) -> dict[str, Column]:
    """What a manifest tells, as aggregates of one pass."""
    row = F.sha2(canonical_json(F.struct(*df.columns), df.schema), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)"))
    out = {"n_rows": F.count(F.lit(1)), "positives": F.count_if(F.col(label) == 1), "negatives": F.count_if(F.col(label) == 0)}
    out |= {f"h{k}": F.coalesce(part(k), F.lit(0).cast("decimal(38,0)")) for k in range(4)}
    for i, x in enumerate(inputs):
        out |= {f"i{i}": F.count_if(F.col(source) == x), f"p{i}": F.count_if((F.col(source) == x) & (F.col(label) == 1))}
    return out


def _told(df: DataFrame, inputs: list, m: dict) -> dict:
    """A manifest from what was measured."""
    kinds = "|".join(f"{n}:{t}" for n, t in df.dtypes)
    sums = "|".join(str(int(m[k])) for k in ("n_rows", "h0", "h1", "h2", "h3"))
    return {
        "n_rows": m["n_rows"], "positives": m["positives"], "negatives": m["negatives"], "positive_share": m["positives"] / m["n_rows"] if m["n_rows"] else None,
        "n_columns": len(df.columns), "schema_hash": hashlib.sha256(kinds.encode()).hexdigest(), "dataset_hash": hashlib.sha256(sums.encode()).hexdigest(),
        "inputs": [{"input": str(x), "n_rows": m[f"i{i}"], "positives": m[f"p{i}"]} for i, x in enumerate(inputs)],
    }


def write_with_manifest(df: DataFrame, path: str, label: str, source: str | None = None, inputs: list | None = None) -> dict:
    """Write df as Parquet and return the manifest of the files: rows, classes, columns, hashes, and rows and positives of each of the given inputs (values of the column source).

    The dataset hash is over the sums of four parts of each row's record hash, so the rows' order does not matter but a row more or less does. All is measured in one pass over
    the written files, not by an Observation while writing: a session that has used one cannot serialise MLlib models with a training summary any more (Spark 4.1.2).
    """
    df.write.parquet(path)
    return manifest(df.sparkSession.read.schema(df.schema).parquet(path), label, source, inputs)


def manifest(df: DataFrame, label: str, source: str | None = None, inputs: list | None = None) -> dict:
    """The manifest of a table that is there."""
    row = df.agg(*[c.alias(k) for k, c in _measures(df, label, source, inputs or []).items()]).first()
    return _told(df, inputs or [], row.asDict())


MANIFEST = "n_rows long, positives long, negatives long, positive_share double, n_columns int, schema_hash string, dataset_hash string, inputs array<struct<input:string,n_rows:long,positives:long>>"
