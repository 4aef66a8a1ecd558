"""Unions, dedup, sampling and splits. Random order is a hash of seed and key, so results do not depend on partitioning.

Selections that need one order of a table or a class rank within hash buckets first, then add the buckets' offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupsight.functions.scalars import hash_order, hash_unit
from groupsight.sources.store import cut, sized


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, with the columns that both have."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common).unionByName(b.select(*common))


def pooled(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """All rows with the columns as doubles; missing columns and bad values are 0."""
    one = lambda df: df.select(*[F.coalesce((F.col(c) if c in df.columns else F.lit(None)).try_cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return reduce(lambda a, b: a.unionByName(b), [one(df) for df in frames])


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without a key stay."""
    return upsert(df.where(F.col(key).isNotNull()), key, F.lit(0), order).unionByName(df.where(F.col(key).isNull()))


def dedup_aggregate(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, population std, n) of repeated observations."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


def upsert(rows: DataFrame, key: str, priority: Column, order: list[str]) -> DataFrame:
    """One row per key: lowest priority number first, then order. An aggregate, so a key's rows are never sorted in one task."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(priority.alias("_priority"), *order)).alias("_best"))
    return best.select("_best.*")


def duplicate_clusters(df: DataFrame, features: list[str], label: str, digits: int = 4) -> DataFrame:
    """df with the hash of its rounded features, the cluster's size, and whether its labels differ."""
    parts = [F.coalesce(F.bround(c, digits).cast("string"), F.lit("")) for c in features]
    out = df.withColumn("cluster", F.md5(F.concat_ws("|", *parts)))
    sizes = out.groupBy("cluster").agg(F.count("*").alias("cluster_size"), (F.count_distinct(label) > 1).alias("label_conflict"))
    return out.join(sizes, "cluster")


def reservoir(df: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    """A uniform sample of n rows."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def hash_rank(df: DataFrame, key: str, seed: str, by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """df with rank: the row's place in hash order, from 1, over all rows or within by (null is a group). total names a column for the rows' or group's number.

    Places are counted in 4096 hash buckets, per group of by, and offset by the sizes of the buckets before, so no task
    sorts a whole table or group.
    """
    by = by or []
    rows = df.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")  # 4096 rows at most per group
    offsets = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_b").alias("_bucket"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    met = F.col("_b") == F.col("_bucket")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    return rows.withColumn("_place", place).join(offsets, met).withColumn("rank", (F.col("_place") + F.col("_before")).cast("long")).select(*df.columns, "rank", *([F.col("_total").alias(total)] if total else []))


def sorted_places(df: DataFrame, *order: Column) -> DataFrame:
    """df with place: the row's place, from 1, in the given order, which must be total.

    Ranges of the order are written once, so that places within a range and the ranges' sizes speak of the same rows.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(offsets), "_part").withColumn("place", (F.col("_place") + F.col("_before")).cast("long")).select(*df.columns, "place")


def rotating_window(df: DataFrame, key: str, window_id: int, size: int, seed: str = "s") -> DataFrame:
    """size rows of the hash order that starts at window_id * size and wraps."""
    total = df.count()
    start = window_id * size % max(total, 1)
    return hash_rank(df, key, seed).where(F.pmod(F.col("rank") - 1 - start, F.lit(max(total, 1))) < size).drop("rank")


def quotas(sizes: DataFrame, stratum: str, n: str, target: int) -> DataFrame:
    """(stratum, n, quota): target dealt in proportion, rounded by largest remainder (ties by name), bounded by n. sizes has a row per stratum."""
    total = sizes.agg(F.sum(n).alias("total"))
    rows = sizes.join(F.broadcast(total), F.lit(True)).withColumn("exact", F.col(n) * target / F.col("total"))
    rows = rows.withColumn("base", F.floor("exact")).withColumn("rest", F.round(F.col("exact") - F.col("base"), 9))
    every = Window.partitionBy()
    left = F.lit(target) - F.sum("base").over(every)
    extra = (F.row_number().over(Window.orderBy(F.desc("rest"), stratum)) <= left).cast("long")  # strata are few
    return rows.select(stratum, n, F.least(F.col(n), F.col("base") + extra).cast("long").alias("quota"))


def stratified_quota(df: DataFrame, key: str, stratum: str, target: int, seed: str = "s") -> DataFrame:
    """A sample of target rows whose strata have their quotas."""
    wanted = quotas(df.groupBy(stratum).agg(F.count("*").alias("_n")), stratum, "_n", target).drop("_n")
    return hash_rank(df, key, seed, [stratum]).join(sized(wanted, "quotas"), stratum).where(F.col("rank") <= F.col("quota")).drop("rank", "quota")


def topped_up(df: DataFrame, key: str, stratum: str, target: int, floor: dict, seed: str = "s") -> DataFrame:
    """A sample of target rows: strata named in floor give that many if they have them, and what is then short comes from all other rows, in hash order."""
    wanted = reduce(lambda o, kv: o.when(F.col(stratum) == kv[0], kv[1]), list(floor.items())[1:], F.when(F.col(stratum) == next(iter(floor)), next(iter(floor.values())))).otherwise(0)
    ranked = hash_rank(df, key, seed, [stratum]).withColumn("_first", F.col("rank") <= wanted).drop("rank")
    first = ranked.where("_first").drop("_first")
    rest = hash_rank(ranked.where("NOT _first").drop("_first"), key, seed).where(F.col("rank") <= F.lit(max(0, target - first.count()))).drop("rank")
    return first.unionByName(rest)


def with_replacement(df: DataFrame, key: str, draws: int, seed: str = "s") -> DataFrame:
    """draws rows, each drawn at random from all, with draw, its number: draws meet the rows' places by a join."""
    rows = hash_rank(df, key, seed)
    n = rows.count()
    picks = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (F.floor(hash_unit(seed + "/draw", F.col("id")) * n) + 1).cast("long").alias("rank"))
    return picks.join(rows, "rank").drop("rank")


def pool_at_ratio(a: DataFrame, b: DataFrame, key: str, share: float, replace: bool = False, seed: str = "s") -> DataFrame:
    """Rows of a and b (same columns) with pool, 'a' or 'b', and draw: a gives `share` of all rows.

    Without replacement it is the largest pool that keeps the ratio, at least one row of each, and draw is NULL; with it, twice the rows of the larger source are drawn, and draw is a
    draw's number within its source. A share outside (0, 1) and an empty source are errors.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    n_a, n_b = a.count(), b.count()
    if not (n_a and n_b):
        raise ValueError("both sources must have rows")
    whole = 2 * max(n_a, n_b) if replace else int(min(n_a / share, n_b / (1 - share)))
    take_a = round(whole * share)
    sizes = [(a, "a", n_a, take_a), (b, "b", n_b, whole - take_a)]
    if replace:
        parts = [with_replacement(df, key, take, f"{seed}/{name}").withColumn("pool", F.lit(name)) for df, name, _, take in sizes]
    else:
        none = F.lit(None).cast("long").alias("draw")
        parts = [hash_rank(df, key, f"{seed}/{name}").where(F.col("rank") <= max(1, min(take, n))).select(none, *df.columns, F.lit(name).alias("pool")) for df, name, n, take in sizes]
    return parts[0].unionByName(parts[1])


def lockbox(df: DataFrame, key: str, held: Column, seed: str = "s") -> DataFrame:
    """df with split: rows that are held are half lockbox, half test (a hash of the key), all others train."""
    return df.withColumn("split", F.when(F.coalesce(held, F.lit(False)), F.when(hash_unit(seed, F.col(key)) < 0.5, "lockbox").otherwise("test")).otherwise("train"))


def packed_ranges(df: DataFrame, key: str, least: int, most: int, seed: str = "s") -> DataFrame:
    """df with pack: groups in hash order whose sizes, least to most, come from a hash of a bucket's number.

    Rows are dealt into buckets of `most` times 64; a bucket is packed by itself, and what is left over goes to its last pack if that stays
    within most, else to a pack of its own, which may be smaller than least.
    """
    rows = hash_rank(df, key, seed).withColumn("_bucket", F.floor((F.col("rank") - 1) / (64 * most)).cast("long"))
    size = lambda i: least + F.floor(hash_unit(seed + "/size", F.col("_bucket"), i) * (most - least + 1)).cast("int")
    # ends of the packs of a bucket, cumulated
    ends = F.aggregate(F.sequence(F.lit(0), F.lit(64 * most // least)), F.array().cast("array<int>"), lambda a, i: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + size(i))))
    bounds = rows.select("_bucket").distinct().withColumn("_ends", ends)
    at = F.pmod(F.col("rank") - 1, F.lit(64 * most))
    return rows.join(bounds, "_bucket").withColumn("pack", F.concat_ws("/", F.col("_bucket").cast("string"), F.size(F.filter("_ends", lambda e: e <= at)).cast("string"))).drop("_bucket", "_ends", "rank")


def ratio_sample(df: DataFrame, key: str, ratio: float, seed: str = "s") -> DataFrame:
    """ratio * rows on average: whole copies for its whole part, a hashed share for the rest."""
    copies = F.lit(int(ratio)) + (hash_unit(seed, F.col(key)) < ratio - int(ratio)).cast("int")
    return df.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))


def balanced(df: DataFrame, key: str, label: str, n: int | None = None, seed: str = "s") -> DataFrame:
    """The same number of rows of every class: n, or as many as the smallest class has."""
    least = df.groupBy(label).count().agg(F.min("count").alias("_least"))
    rows = hash_rank(df, key, seed, [label])
    return rows.where(F.col("rank") <= n).drop("rank") if n else rows.join(F.broadcast(least), F.col("rank") <= F.col("_least")).drop("rank", "_least")


def rebalance(df: DataFrame, key: str, label: str, share: float, seed: str = "s") -> DataFrame:
    """The largest sample in which class 1 has the given share."""
    ones, zeros = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    total = min(ones / share if share > 0 else float("inf"), zeros / (1 - share) if share < 1 else float("inf"))
    want = F.when(F.col(label) == 1, int(total * share + 1e-9)).otherwise(int(total * (1 - share) + 1e-9))
    return hash_rank(df.where(F.col(label).isin(0, 1)), key, seed, [label]).where(F.col("rank") <= want).drop("rank")


def domain_mix(df: DataFrame, key: str, domain: str, caps: dict, repeats: dict, weights: dict, seed: str = "s") -> DataFrame:
    """At most caps[d] rows of domain d, each repeats[d] times, with sample_weight weights[d]."""
    pick = lambda values, rest: reduce(lambda o, kv: o.when(F.col(domain) == kv[0], kv[1]), list(values.items())[1:], F.when(F.col(domain) == next(iter(values)), next(iter(values.values())))).otherwise(rest) if values else F.lit(rest)
    rows = hash_rank(df, key, seed, [domain]).where(F.col("rank") <= pick(caps, 2**62)).drop("rank")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), pick(repeats, 1)))).withColumn("sample_weight", pick(weights, 1.0).cast("double"))


def stratified_split(df: DataFrame, key: str, label: str, val_share: float, seed: str = "s") -> DataFrame:
    """df with split: val_share of each class is 'val', at least one row of a class of two or more."""
    rows = hash_rank(df, key, seed, [label], total="_n")
    want = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.floor(F.col("_n") * val_share + 0.5))).otherwise(0)
    return rows.withColumn("split", F.when(F.col("rank") <= want, "val").otherwise("train")).drop("rank", "_n")


def bernoulli_split(df: DataFrame, key: str, ratio: float, seed: str = "s") -> DataFrame:
    return df.withColumn("split", F.when(hash_unit(seed, F.col(key)) < ratio, "train").otherwise("val"))


def packed(df: DataFrame, key: str, size: int, least: int = 1, seed: str = "s") -> DataFrame:
    """df with pack: groups of `size` rows in hash order; a last group of fewer than `least` goes."""
    total = df.count()
    rows = hash_rank(df, key, seed).withColumn("pack", F.floor((F.col("rank") - 1) / size).cast("long"))
    last = total % size
    return (rows.where(F.col("pack") < total // size) if 0 < last < least else rows).drop("rank")
