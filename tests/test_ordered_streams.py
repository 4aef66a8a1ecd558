"""Stream state in event order: any order of files, any cut into batches, late rows, expiry."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupsight.operators import evaluate as E
from groupsight.streaming import jobs as Z
from groupsight.streaming import state as K

BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "k string, seq long, score double, at timestamp"
CLOCK = (None, None, None, BEGIN + dt.timedelta(days=2))


def written(spark, path, files):
    """A stream of files, in that order; the last moves the clock on."""
    for part in [*files, [CLOCK]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, per_batch):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(path)


@pytest.fixture(scope="module")
def requests():
    g = np.random.default_rng(12)
    rows = []
    for k in ("a", "b"):
        for s in range(24):
            n = int(g.integers(3, 25))
            x = np.where(g.random(n) < 0.5, g.normal(0.1, 0.01, n), g.normal(0.8 if s < 12 or k == "a" else 0.12, 0.01, n))
            rows += [(k, s, float(v), BEGIN + dt.timedelta(minutes=s)) for v in x]
    return rows


def dealt(rows, seed, files):
    """Files of shuffled rows: each row is at most half of the files off its place, a request's rows lie in several."""
    g = np.random.default_rng(seed)
    out = [[] for _ in range(files)]
    for r in rows:
        out[int(np.clip(r[1] * files // 24 + g.integers(-1, 2), 0, files - 1))].append(r)
    return [[f[i] for i in g.permutation(len(f))] for f in out if f]


@pytest.mark.parametrize(("seed", "files", "per_batch"), [(1, 8, 1), (2, 8, 3), (3, 2, 1), (4, 5, 100)])
def test_every_order_of_files_and_cut_into_batches_gives_the_same(spark, tmp_path, requests, seed, files, per_batch):
    written(spark, f"{tmp_path}/s", dealt(requests, seed, files))
    got, query = Z.run_through(K.threshold_stream(stream(spark, f"{tmp_path}/s", per_batch), "k", "seq", "score", "at", "1 hour"), "t")
    assert Z.late_rows(query) == 0
    table = spark.createDataFrame(requests, SCHEMA)
    key = lambda df: sorted((r.k, r.seq, round(r.threshold, 9), r["mode"]) for r in df.collect())
    assert key(got) == key(E.dynamic_threshold(table, "k", "seq"))
    alerts = Z.drained(K.monitor_stream(stream(spark, f"{tmp_path}/s", per_batch), "k", "seq", "score", "at", "1 hour"), "m").collect()
    assert sorted((r.k, r.seq) for r in alerts) == [(k, s) for k in "ab" for s in (4, 9, 14, 19)]
    for r in alerts:
        x = np.array([v for _, v in sorted((s, v) for k, s, v, _ in requests if k == r.k and s <= r.seq)])[-200:]
        assert r.n == len(x) and r.upper == pytest.approx(np.median(x[x > 0.5])) and r.lower == pytest.approx(np.median(x[x < 0.5]))


def test_alerts_of_a_stream_that_changes(spark, tmp_path):
    two, one = [0.05] * 20 + [0.06] * 20 + [0.9] * 20, [0.5] * 200
    low = [0.05] * 20 + [0.06] * 20 + [0.3] * 160
    steps = [two] * 5 + [one] * 5 + [two] * 5 + [low] * 5 + [low] * 5
    rows = [("a", s, v, BEGIN + dt.timedelta(minutes=s)) for s, x in enumerate(steps) for v in x] + [("few", s, 0.5, BEGIN + dt.timedelta(minutes=s)) for s in range(10)]
    written(spark, f"{tmp_path}/s", [rows[::2], rows[1::2]])
    out = Z.drained(K.monitor_stream(stream(spark, f"{tmp_path}/s", 1), "k", "seq", "score", "at", "1 hour"), "m").orderBy("seq").collect()
    assert [(r.k, r.seq, r.alert) for r in out] == [("a", 4, None), ("a", 9, "lost"), ("a", 14, "found"), ("a", 19, "moved"), ("a", 24, None)]
    assert out[1].upper is None and out[1].lower == 0.5


def test_late_rows_are_counted_and_change_nothing(spark, tmp_path, requests):
    late = [("a", 0, 0.5, BEGIN)] * 3
    written(spark, f"{tmp_path}/s", [[r for r in requests if r[1] < 12], [r for r in requests if r[1] >= 12], late])
    got, query = Z.run_through(K.threshold_stream(stream(spark, f"{tmp_path}/s", 1), "k", "seq", "score", "at", "5 minutes"), "t")
    assert Z.late_rows(query) == 3
    key = lambda df: sorted((r.k, r.seq, round(r.threshold, 9), r["mode"]) for r in df.collect())
    assert key(got) == key(E.dynamic_threshold(spark.createDataFrame(requests, SCHEMA), "k", "seq"))


def test_served_keys_repeat_and_expire(spark, tmp_path):
    at = lambda m: BEGIN + dt.timedelta(minutes=m)
    rows = [("x", c, 1.0, at(c)) for c in range(80)] + [("x", 3, 1.0, at(3)), ("y", 0, 1.0, at(0)), ("y", 79, 1.0, at(79)), (None, 1, 1.0, at(1)), ("z", None, 1.0, at(1))]
    written(spark, f"{tmp_path}/s", [[r for r in rows if (r[3] - BEGIN).seconds // 60 in range(a, a + 20)] for a in (0, 20, 40, 60)])
    run = lambda idle: {(r.k, r.seq): r for r in Z.drained(K.served_stream(stream(spark, f"{tmp_path}/s", 1), "k", "seq", "at", "2 minutes", keep=64, idle=idle), "v").collect()}
    held = run(None)
    assert len(held) == 82 and held["x", 79].times == 81 and held["x", 3].times == 5 and held["x", 0].repeated is False and held["x", 3].repeated is True
    assert held["x", 79].kept_cycles == list(range(16, 80)) and held["x", 79].first_cycle == 0
    assert (held["y", 79].times, held["y", 79].repeated, held["y", 79].first_cycle) == (2, True, 0)
    gone = run("30 minutes")
    assert (gone["y", 79].times, gone["y", 79].repeated, gone["y", 79].first_cycle) == (1, False, 79)
    assert gone["x", 79].times == 81


def test_state_of_idle_keys_goes(spark, tmp_path):
    rows = [[(f"k{i}", i, 1.0, BEGIN + dt.timedelta(minutes=i))] for i in range(6)]
    written(spark, f"{tmp_path}/s", rows)
    _, query = Z.run_through(K.served_stream(stream(spark, f"{tmp_path}/s", 1), "k", "seq", "at", "1 minute", idle="2 minutes"), "v")
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0
    _, query = Z.run_through(K.served_stream(stream(spark, f"{tmp_path}/s", 1), "k", "seq", "at", "1 minute"), "v")
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 6


def test_log_grows_by_batches_and_replays_add_nothing(spark, tmp_path):
    kind = "user string, at timestamp, xs array<double>"
    files = [[("a", BEGIN, [1.0, 2.0]), ("b", BEGIN, [])], [("a", BEGIN, [9.0]), ("c", BEGIN, [4.0]), (None, BEGIN, [1.0])], [("b", BEGIN, [7.0])]]
    for part in files:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")

    def score(messages):
        return messages.select("user", F.aggregate("xs", F.lit(0.0), lambda s, x: s + x).alias("total"))

    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s")
    log = Z.score_log(source, score, "user", "at")
    assert sorted(map(tuple, log.collect())) == [("a", 3.0), ("b", 0.0), ("c", 4.0)]
    # a batch that is written again stands in the place of its first try
    rows = spark.createDataFrame([("d", 1.0)], "user string, total double")
    for _ in range(2):
        Z.put_batch(rows, f"{tmp_path}/log", 7)
    assert Z.read_log(spark, f"{tmp_path}/log", rows.schema).count() == 1


def test_arrivals_do_not_grow_with_the_values_they_are_ordered_by(spark):
    """As many files for 40000 cycles as for a few, later files with later rows, every row once."""
    rows = spark.range(3000).select("id", F.floor(F.col("id") * 13 / 4).alias("file"))
    path = Z.arriving(rows, "file", "scores")
    found = spark.read.parquet(path).select("id", F.input_file_name().alias("f")).groupBy("f").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).orderBy("low").collect()
    assert len(found) == Z.ARRIVALS and sum(r.n for r in found) == 3000
    assert all(a.high < b.low for a, b in zip(found, found[1:], strict=False))
    few = Z.arriving(spark.createDataFrame([(1, 5), (2, 5), (3, -1), (4, None)], "id long, file long"), "file", "scores")
    assert sorted(r.id for r in spark.read.parquet(few).collect()) == [1, 2, 3]


def test_scores_of_many_cycles_come_in_few_batches(spark, tmp_path):
    """One file per four cycles made 500 files and as many jobs of 2000 cycles."""
    from groupsight.plans import q_streaming as Q

    v = spark.range(2000).select((F.col("id") * 50).alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"), F.array(*[(F.sin(F.col("id") + i)).cast("float") for i in range(64)]).alias("embedding"))
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    stream = Q._score_stream(spark, str(tmp_path))
    out, query = Z.run_through(K.threshold_stream(stream, "scorer", "cycle", "score", "at", "5 minutes"), "thresholds")
    assert out.count() == 2000 and Z.late_rows(query) == 0
    assert len(query.recentProgress) <= Z.ARRIVALS


def test_a_row_without_sequence_leaves_the_others_whole_numbers(spark, tmp_path):
    rows = [("a", 7 + s, 0.5, BEGIN + dt.timedelta(minutes=s)) for s in range(3)]
    written(spark, f"{tmp_path}/s", [[*rows, ("a", None, 0.5, BEGIN)]])
    out = Z.drained(K.served_stream(stream(spark, f"{tmp_path}/s", 1), "k", "seq", "at", "1 minute"), "v")
    assert sorted((r.seq, r.times) for r in out.collect()) == [(7 + s, s + 1) for s in range(3)]
