"""Order within tables and groups of any size: running sums, places, neighbours, exact quantiles, rolling windows.

Rows are cut into ranges of (group, order) that are written once. What a task looks at in order is one
range, or one chunk of a bounded number of rows; what comes before a range is known from a row of totals per range and group.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupsight.functions.scalars import finite
from groupsight.session import ship_package
from groupsight.sources.store import cut


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], previous: str | None = None) -> DataFrame:
    """df with, for each name of sums, its running sum up to and with the row (name) and over the row's whole group (name_total).

    by may be empty; null is a group. order must be total within a group, or the sums of equal rows come in any order. previous names the column
    that the order ascends by first: its value in the group's row before the present one is added as previous_<name>.
    """
    rows = df.select("*", *[c.alias(f"_{n}") for n, c in sums.items()])
    rows = cut(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = [F.max(previous).alias("_end")] if previous else []
    per = rows.groupBy("_part", *by).agg(*[F.sum(f"_{n}").alias(f"_s_{n}") for n in sums], *ends)  # a row per range and group
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums]
    before += [F.sum(f"_s_{n}").over(group).alias(f"{n}_total") for n in sums]
    before += [F.max("_end").over(earlier).alias("_before_end")] if previous else []
    offsets = per.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *before)
    met = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    along = Window.partitionBy("_part", *by).orderBy(*order)
    inside = {n: F.sum(f"_{n}").over(along.rowsBetween(Window.unboundedPreceding, 0)) for n in sums}
    if previous:
        inside["_lag"] = F.lag(previous).over(along)
    out = rows.withColumns(inside).join(offsets, met)
    out = out.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums})
    if previous:
        out = out.withColumn(f"previous_{previous}", F.coalesce("_lag", "_before_end"))
    return out.select(*df.columns, *sums, *[f"{n}_total" for n in sums], *([f"previous_{previous}"] if previous else []))


#: A column of up to this many values, or distinct ones, may be held in one task.
SMALL = 100_000
#: Points of the sketch that a pass draws over what is left of a column.
_POINTS = 200


def quantiles(df: DataFrame, columns: list[str], at: list[float], small: int = SMALL) -> dict[str, list[float | None]]:
    """Exact linear quantiles of the finite values of each column, None where there are none, by selection in several passes.

    A pass counts how many values lie below and inside each quantile's bracket and draws a sketch over those inside, from which the next,
    some fifty times narrower bracket is taken; the counts of the next pass prove that it holds the quantile, else it is widened. Brackets of `small` values or fewer, or
    of one value, are then read exactly. No task holds more than a sketch or `small` distinct values.
    """
    v = {c: finite(F.col(c)) for c in columns}
    points = [i / _POINTS for i in range(_POINTS + 1)]
    sketch = lambda c: F.percentile_approx(c, points, 10 * _POINTS)
    sizes = df.agg(*[F.count(v[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    n = {c: sizes[f"n{i}"] for i, c in enumerate(columns)}
    # what each quantile is looked for in: bounds, values below them, values inside
    held = {(c, k): (None, None, 0, n[c]) for c in columns for k in range(len(at)) if n[c]}
    drawn = {c: None for c in columns if n[c] > small}
    if drawn:
        row = df.agg(*[sketch(v[c]).alias(f"g{i}") for i, c in enumerate(drawn)]).first()
        drawn = {c: row[f"g{i}"] for i, c in enumerate(drawn)}
    place = {key: (n[key[0]] - 1) * at[key[1]] for key in held}
    open_ = {key: (drawn[key[0]], 1) for key in held if key[0] in drawn}
    while open_:
        tries, aggs = {}, []
        for j, (key, (grid, margin)) in enumerate(open_.items()):
            _, _, below, inside = held[key]
            f = (place[key] - below) / max(inside - 1, 1) * _POINTS
            low, high = int(np.floor(f)) - margin, int(np.ceil(f)) + margin
            lo, hi = (grid[low] if low >= 0 else held[key][0]), (grid[high] if high <= _POINTS else held[key][1])
            x = v[key[0]]
            within = (F.lit(True) if lo is None else x >= lo) & (F.lit(True) if hi is None else x <= hi)
            tries[key] = (lo, hi)
            aggs += [(F.lit(0) if lo is None else F.count_if(x < lo)).alias(f"b{j}"), F.count_if(x.isNotNull() & within).alias(f"i{j}"), sketch(F.when(within, x)).alias(f"g{j}")]
        row, left = df.agg(*aggs, F.count("*").alias("rows")).first(), {}
        for j, (key, (grid, margin)) in enumerate(open_.items()):
            below, inside = row[f"b{j}"], row[f"i{j}"]
            if not below <= place[key] <= below + inside - 1:
                left[key] = (grid, 2 * margin)  # the sketch was off: a wider bracket of the same points
                continue
            lo, hi = tries[key]
            shrunk = inside < held[key][3]
            held[key] = (lo, hi, below, inside)
            if inside > small and lo != hi and shrunk:
                left[key] = (row[f"g{j}"], 1)
        open_ = left
    # quantiles with one bracket are read from it together
    shared: dict[tuple, list[tuple[int, float]]] = {}
    for key, (lo, hi, below, inside) in held.items():
        shared.setdefault((key[0], lo, hi), []).append((key[1], (place[key] - below) / max(inside - 1, 1)))
    aggs = []
    for j, ((c, lo, hi), wanted) in enumerate(shared.items()):
        within = (F.lit(True) if lo is None else v[c] >= lo) & (F.lit(True) if hi is None else v[c] <= hi)
        aggs.append(F.percentile(F.when(within, v[c]), F.array(*[F.lit(share) for _, share in wanted])).alias(f"q{j}"))
    out: dict[str, list[float | None]] = {c: [None] * len(at) for c in columns}
    if aggs:
        row = df.agg(*aggs).first()
        for j, ((c, _, _), wanted) in enumerate(shared.items()):
            for (k, _), value in zip(wanted, row[f"q{j}"], strict=True):
                out[c][k] = value
    return out


def chunks(df: DataFrame, by: list[str], order: list[Column], size: int, halo: int) -> DataFrame:
    """df with place (in its group, from 1), chunk and in_halo: each group cut into chunks of `size` rows, each with the `halo` rows before it as well."""
    placed = running(df, by, order, {"place": F.lit(1)}).drop("place_total")
    own = F.floor((F.col("place") - 1) / size)
    last = F.floor((F.col("place") - 1 + halo) / size)
    return placed.withColumn("_own", own).withColumn("chunk", F.explode(F.sequence(own, last))).withColumn("in_halo", F.col("chunk") > F.col("_own")).drop("_own")


class Sliding:
    """Linear quantiles of the last `keep` values that came in, kept in order; missing values take a place but do not count."""

    def __init__(self, keep: int, at: list[float]):
        self.keep, self.at = keep, at
        self.clear()

    def clear(self) -> None:
        self.came, self.held = deque(), []

    def push(self, x: float) -> None:
        self.came.append(x)
        if x == x:
            insort(self.held, x)
        if len(self.came) > self.keep and (old := self.came.popleft()) == old:
            del self.held[bisect_left(self.held, old)]

    def quantiles(self) -> list[float]:
        last, out = len(self.held) - 1, []
        if last < 0:
            return [math.nan] * len(self.at)
        for q in self.at:
            place = q * last
            k = int(place)
            low, high, t = self.held[k], self.held[min(k + 1, last)], place - k
            # as numpy does: from the nearer end
            out.append(low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t))
        return out


def rolling_quantiles(df: DataFrame, by: list[str], order: list[Column], value: str, at: dict[str, float], keep: int = 500, size: int = 4096) -> DataFrame:
    """df with, for each name of at, the linear quantile of the last `keep` values of the row's group, itself included; null while there are none.

    A group is worked on in chunks of `size` rows, so one long stream is shared by many tasks. Chunks of many groups go through a task as one stream.
    """
    ship_package(df.sparkSession)
    rows = chunks(df.withColumn("_x", F.col(value).cast("double")), by, order, size, keep - 1)
    begins = F.col("place") == F.greatest(F.lit(1), F.col("chunk") * size + 2 - keep)
    names, shares = df.columns, list(at.values())
    rows = rows.withColumn("_begins", begins).repartition(*by, "chunk").sortWithinPartitions(*by, "chunk", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = Sliding(keep, shares)
        for batch in batches:
            x, begins, halo = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_begins", "in_halo"))
            found = []
            for v, new, before in zip(x.tolist(), begins.tolist(), halo.tolist(), strict=True):
                if new:
                    window.clear()
                window.push(v)
                if not before:
                    found.append(window.quantiles())
            found = np.array(found).reshape(-1, len(shares))
            own = batch.select(names).filter(pa.array(~halo.astype(bool)))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(found[:, i]) for i in range(len(shares)))], [*names, *at])

    out = rows.select(*df.columns, "_x", "_begins", "in_halo").mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in at]]))
    return out.withColumns({n: finite(F.col(n)) for n in at})


def rolling_quantile(df: DataFrame, by: list[str], order: list[Column], value: str, q: float, keep: int = 500, size: int = 4096) -> DataFrame:
    """rolling_quantiles() of one share, as column quantile."""
    return rolling_quantiles(df, by, order, value, {"quantile": q}, keep, size)


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median) of the values, nulls left out: the middle one or two of the distinct values' running counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    c = running(counts, by, [F.col(value)], {"_upto": F.col("_n")})
    low, high = F.floor((F.col("_upto_total") + 1) / 2), F.floor((F.col("_upto_total") + 2) / 2)
    holds = lambda k: (F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k)
    middle = c.where(holds(low) | holds(high))  # one or two rows of a group
    return middle.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias("median"))


def quantile_of(held: Column, share: float) -> Column:
    """Linear quantile of a sorted array without nulls, as `percentile` gives it; null where it is empty."""
    place = (F.size(held) - 1) * F.lit(share)
    low, high = F.get(held, F.floor(place).cast("int")), F.get(held, F.ceil(place).cast("int"))
    return between(place, low, high)


def between(place: Column, low: Column, high: Column) -> Column:
    """What lies at a place from 0 whose whole neighbours hold low and high."""
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def group_quantiles(df: DataFrame, by: list[str], columns: list[str], at: tuple[float, ...]) -> DataFrame:
    """(by, _<column> ...): exact linear quantiles of each column's values as an array per group of any size, nulls left out, from running counts of distinct values."""
    values = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, columns, "_feature", "_value").where(F.col("_value").isNotNull())
    counts = values.groupBy(*by, "_feature", "_value").agg(F.count("*").alias("_n"))
    c = running(counts, [*by, "_feature"], [F.col("_value")], {"_upto": F.col("_n")})
    holds = lambda k: (F.col("_upto") > k) & (F.col("_upto") - F.col("_n") <= k)
    places = [(F.col("_upto_total") - 1) * F.lit(p) for p in at]
    ends = [(f"_{x}{i}", f(p)) for i, p in enumerate(places) for x, f in (("low", F.floor), ("high", F.ceil))]
    rows = c.where(reduce(or_, [holds(k) for _, k in ends]))  # a few rows of a group
    picked = rows.groupBy(*by, "_feature").agg(F.max("_upto_total").alias("_upto_total"), *[F.max(F.when(holds(k), F.col("_value"))).alias(n) for n, k in ends])
    found = picked.select(*by, "_feature", F.array(*[between(p, F.col(f"_low{i}"), F.col(f"_high{i}")) for i, p in enumerate(places)]).alias("_q"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_feature") == k, F.col("_q"))).alias(f"_{k}") for k in columns])
