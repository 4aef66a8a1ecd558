"""Keyed stream state in event order: rows wait until the watermark has passed them, whatever the order of files and batches.

A stream has a time column with a watermark. Rows that come are put into their key's buffer; once the watermark passes a row's time
it is released, in order of (time, sequence, score), and meets the key's state. A timer wakes keys whose buffered rows
become due without new rows. So the result is the same for every order of files and every cut into batches, as long as no row is later than the
watermark allows; later ones are dropped by the engine and counted (`late_rows`).

A buffer holds the rows of one key within the watermark's delay; state beyond it is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groupsight.operators.evaluate import chosen_threshold, gap_of
from groupsight.session import ship_package

#: A request is all rows of a key with one time and sequence. (state, request number or value, scores) -> (state, rows out)
Step = Callable[[tuple, object, np.ndarray], tuple[tuple, list[tuple]]]


def in_order(
    rows: DataFrame, key: str, at: str, sequence: str, score: str, delay: str, step: Step, start: tuple, state: str, out: str, idle: str | None = None
) -> DataFrame:
    """What step gives for each key's requests in order of (at, sequence).

    start and state: a key's first state and its fields' types; out: the fields of the rows out after the key. idle: keys without a row for that
    long after their last are forgotten. Rows without key, time, sequence or score only move the watermark on.
    """
    ship_package(rows.sparkSession)
    kinds = dict(rows.dtypes)
    fields = [f.name for f in T._parse_datatype_string(out).fields]
    integral = kinds[sequence] in ("tinyint", "smallint", "int", "bigint")
    wait = None if idle is None else int(pd.Timedelta(idle) / pd.Timedelta("1ms"))

    def update(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.exists:
            times, sequences, scores, last, *now = held.get
            rows = list(zip(times, sequences, scores, strict=True))
        else:
            rows, last, now = [], -1, list(start)
        for p in parts:
            when, seq, x = p[at], p[sequence], p[score]
            whole = ~(pd.isna(when.to_numpy()) | pd.isna(seq.to_numpy()) | pd.isna(x.to_numpy()))
            if not whole.all():
                when, seq, x = when[whole], seq[whole], x[whole]
            # nulls beside them turn whole numbers into floats
            seq = seq.astype("int64") if integral else seq
            rows += zip(when.to_numpy("datetime64[us]").astype(np.int64).tolist(), seq.tolist(), x.to_numpy(float).tolist(), strict=True)
        water = held.getCurrentWatermarkMs()
        due = sorted(r for r in rows if r[0] <= water * 1000)
        rest = [r for r in rows if r[0] > water * 1000]
        found = []
        for (when, s), part in groupby(due, itemgetter(0, 1)):
            now, made = step(tuple(now), s, np.array([r[2] for r in part]))
            last = when
            found += [(k[0], *m) for m in made]
        if k[0] is None or (not rest and (last < 0 or (wait is not None and last // 1000 + wait <= water))):
            if held.exists:
                held.remove()
        else:
            times, sequences, scores = (list(c) for c in zip(*rest, strict=True)) if rest else ([], [], [])
            held.update((times, sequences, scores, last, *now))
            wake = min(times) // 1000 + 1 if rest else None if wait is None else last // 1000 + wait
            if wake is not None:
                held.setTimeoutTimestamp(max(wake, water + 1))
        if found:
            yield pd.DataFrame(dict(zip([key, *fields], map(list, zip(*found, strict=True)), strict=True)))

    marked = rows.select(key, at, sequence, score).withWatermark(at, delay)
    return marked.groupBy(key).applyInPandasWithState(
        update, f"{key} {kinds[key]}, {out}", f"times array<long>, sequences array<{kinds[sequence]}>, scores array<double>, last long, {state}", "append", GroupStateTimeout.EventTimeTimeout
    )


def threshold_stream(
    scores: DataFrame, stream: str, sequence: str, score: str, at: str, delay: str = "1 hour", keep: int = 500, static: float | None = None, fixed: float = 0.5,
    low: float = 0.1, high: float = 0.45, peaks: dict | None = None, idle: str | None = None,
) -> DataFrame:
    """(stream, sequence, threshold, mode) of each request: the stream's form of evaluate.dynamic_threshold()."""

    def step(state: tuple, s, x: np.ndarray) -> tuple[tuple, list[tuple]]:
        before = np.asarray(state[0], float)
        out = chosen_threshold(gap_of(x, **(peaks or {})), before, static, fixed, low, high, peaks or {})
        return (np.concatenate([before, x])[-keep:].tolist(),), [(s, *out)]

    return in_order(scores, stream, at, sequence, score, delay, step, ([],), "recent array<double>", f"{sequence} {dict(scores.dtypes)[sequence]}, threshold double, mode string", idle)


# What the monitor of a score stream takes for two peaks.
MONITOR = {"min_scores": 20, "gap_ratio": 5.0, "min_gap": 0.01, "min_share": 0.0}


def monitor_stream(
    scores: DataFrame, stream: str, sequence: str, score: str, at: str, delay: str = "1 hour", keep: int = 200, every: int = 5, move: float = 0.15, idle: str | None = None
) -> DataFrame:
    """(stream, sequence, n, upper, lower, alert): every `every`-th request of a stream, the medians of the two parts of its last `keep` scores.

    upper is NULL where the scores have no two parts; lower is then the median of all. alert: 'moved' if upper moved by more than `move` since the look
    before, 'lost' or 'found' if it vanished or appeared, else NULL. Looks at fewer than 20 scores are left out.
    """

    def step(state: tuple, s, x: np.ndarray) -> tuple[tuple, list[tuple]]:
        recent, seen, looked, was = state
        recent, seen = np.concatenate([np.asarray(recent, float), x])[-keep:], seen + 1
        out = []
        if seen % every == 0 and len(recent) >= MONITOR["min_scores"]:
            cut = gap_of(recent, **MONITOR)
            upper = None if cut is None else float(np.median(recent[recent >= cut]))
            lower = float(np.median(recent if cut is None else recent[recent < cut]))
            alert = None
            if looked and (was is None) != (upper is None):
                alert = "lost" if upper is None else "found"
            elif looked and upper is not None and abs(upper - was) > move:
                alert = "moved"
            out, looked, was = [(s, len(recent), upper, lower, alert)], True, upper
        return (recent.tolist(), seen, looked, was), out

    kind = dict(scores.dtypes)[sequence]
    return in_order(
        scores, stream, at, sequence, score, delay, step, ([], 0, False, None), "recent array<double>, seen long, looked boolean, was double",
        f"{sequence} {kind}, n long, upper double, lower double, alert string", idle,
    )


def served_stream(requests: DataFrame, key: str, cycle: str, at: str, delay: str = "1 hour", keep: int = 64, idle: str | None = None) -> DataFrame:
    """(key, cycle, times, first_cycle, repeated, kept_cycles): for each cycle in which a key was served, how often it was until then, its first cycle, whether it had been served before, and its last `keep` cycles.

    Several rows of a key in a cycle count each. Keys without a row for `idle` are forgotten: when they come again, they are new.
    """

    def step(state: tuple, c, x: np.ndarray) -> tuple[tuple, list[tuple]]:
        times, first, cycles = state
        cycles = [*[v for v in cycles if v != c], int(c)][-keep:]
        out = (int(c), times + len(x), int(c) if times == 0 else first, times > 0 or len(x) > 1, [int(v) for v in cycles])
        return (times + len(x), out[2], cycles), [out]

    rows = requests.select(key, F.col(cycle).cast("long").alias(cycle), at, F.lit(1.0).alias("_one"))
    return in_order(rows, key, at, cycle, "_one", delay, step, (0, None, []), "times_ long, first_ long, cycles_ array<long>", f"{cycle} long, times long, first_cycle long, repeated boolean, kept_cycles array<long>", idle)
