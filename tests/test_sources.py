"""Readers and writers: line numbers of split and compressed files, sizes of rotated files, manifests, canonical records."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from groupsight.functions.scalars import canonical_json
from groupsight.operators import clean
from groupsight.plans.q_sources import with_splits
from groupsight.sources import io


def test_lines_are_numbered_in_split_and_compressed_files(spark, tmp_path):
    text = {}
    for name, n in (("a.txt", 5000), ("b.txt", 3000), ("c.txt.gz", 4000), ("empty.txt", 0), ("one.txt", 1)):
        text[name] = [f"{name} {i} {'x' * (i % 37)}" for i in range(1, n + 1)]
        opener = gzip.open if name.endswith("gz") else open
        with opener(tmp_path / name, "wt") as f:
            f.write("\n".join(text[name]) + ("\n" if name != "b.txt" and n else ""))
    got = with_splits(spark, 8192, lambda: io.read_lines(spark, str(tmp_path)).toPandas())
    assert len(got) == sum(map(len, text.values()))
    for path, g in got.groupby("source_file"):
        assert g.sort_values("line").value.tolist() == text[os.path.basename(path)] and sorted(g.line) == list(range(1, len(g) + 1))


def test_kinds_of_lines(spark, tmp_path):
    lines = ['{"event_id": 1, "extra": [1]}', "", "  \t", "nonsense", "[1]", '"text"', "7", "null", '{"event_id": "x"', '{"event_id": null}', ' {"event_id": 5}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    from pyspark.sql import types as T

    got = {r.line: (r.kind, r.event_id) for r in io.read_ndjson_lines(spark, str(tmp_path), T.StructType([T.StructField("event_id", T.LongType())])).collect()}
    assert got == {1: ("good", 1), 4: ("bad", None), 5: ("other", None), 6: ("other", None), 7: ("other", None), 8: ("other", None), 9: ("bad", None), 10: ("good", None), 11: ("good", 5)}


@pytest.mark.parametrize("parts", [1, 3])
def test_rotated_files_keep_their_bound(spark, tmp_path, parts):
    rows = [(i, "é" * (i % 90)) for i in range(900)] + [(900, "z" * 5000), (901, "z" * 1985), (902, None)]
    df = spark.createDataFrame(rows, "i long, t string").coalesce(1).repartition(parts)
    io.write_rotating(df, f"{tmp_path}/r", 2000)
    found, sizes = [], []
    for folder, _, names in os.walk(f"{tmp_path}/r"):
        for n in (n for n in names if n.startswith("part-")):
            with open(f"{folder}/{n}") as f:
                lines = f.read().splitlines()
            size = os.path.getsize(f"{folder}/{n}")
            assert size <= 2000 or len(lines) == 1
            sizes.append(size)
            found += [json.loads(x) for x in lines]
    assert sorted((x["i"], x.get("t")) for x in found) == sorted(rows)
    assert len(sizes) < 2 * sum(sizes) / 2000 + parts + 2
    io.write_rotating(df.limit(0), f"{tmp_path}/none", 2000)


def test_rotated_files_lie_in_one_folder_in_order(spark, tmp_path):
    df = spark.range(25_000, numPartitions=1).select("id", F.repeat(F.lit("é"), (F.col("id") % 7).cast("int")).alias("t"))  # several batches
    io.write_rotating(df, f"{tmp_path}/r", 20_000)
    names = sorted(n for n in os.listdir(f"{tmp_path}/r") if not n.startswith(("_", ".")))
    assert all(os.path.isfile(f"{tmp_path}/r/{n}") for n in names)
    sizes = [os.path.getsize(f"{tmp_path}/r/{n}") for n in names]
    assert max(sizes) <= 20_000 and min(sizes[:-1]) > 19_900
    lines = []
    for n in names:
        with open(f"{tmp_path}/r/{n}") as f:
            lines += [json.loads(x)["id"] for x in f]
    assert lines == list(range(25_000))


def test_manifest_of_a_write_depends_on_rows_not_on_order(spark, tmp_path):
    rows = [(i % 3, i % 2, float(i), {"b": i, "a": None}) for i in range(50)] + [(0, None, None, None)] * 2
    df = spark.createDataFrame(rows, "src int, label int, x double, m map<string,int>")
    m = io.write_with_manifest(df.repartition(4), f"{tmp_path}/a", "label", "src", [0, 1, 2, 9])
    assert (m["n_rows"], m["positives"], m["negatives"], m["n_columns"]) == (52, 25, 25, 4)
    assert [(x["input"], x["n_rows"], x["positives"]) for x in m["inputs"]] == [("0", 19, 8), ("1", 17, 9), ("2", 16, 8), ("9", 0, 0)]
    assert io.manifest(df.orderBy(F.desc("x")), "label", "src", [0, 1, 2, 9]) == m
    assert io.manifest(df.unionByName(df.limit(1)), "label")["dataset_hash"] != m["dataset_hash"]
    assert io.manifest(df.withColumn("x", F.when(F.col("x") != 3, F.col("x"))), "label")["dataset_hash"] != m["dataset_hash"]
    assert io.manifest(df.limit(0), "label")["positive_share"] is None and spark.createDataFrame([m], io.MANIFEST).count() == 1


def test_canonical_json_sorts_every_level(spark):
    values = [
        {"z": 1, "a": {"k": ["x\"y", None, "é\n"], "b": True}, "m": {"q": {"n": 2, "c": None}, "b": {"n": 1, "c": "t"}}, "l": [{"n": 3, "c": "u"}]},
        {"z": None, "a": None, "m": {}, "l": []},
        {"z": 5, "a": {"k": None, "b": False}, "m": None, "l": None},
    ]
    df = spark.createDataFrame(values, "z int, a struct<k:array<string>,b:boolean>, m map<string,struct<n:int,c:string>>, l array<struct<n:int,c:string>>")
    got = [r.j for r in df.select(canonical_json(F.struct(*df.columns), df.schema).alias("j")).collect()]
    assert got == [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in values]
    other = df.select("l", F.when(F.col("m").isNotNull(), F.map_from_entries(F.reverse(F.map_entries("m")))).alias("m"), "z")
    keep = ["z", "m", "l"]
    assert [r[0] for r in df.select(clean.record_hash(df, keep)).collect()] == [r[0] for r in other.select(clean.record_hash(other, list(reversed(keep)))).collect()]
