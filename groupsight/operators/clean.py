"""Projections, filters and validation of records and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupsight.functions.scalars import canonical_json, coarsen, hash_order, label_of


def conform(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """value in the shape `want`: its keys only, NULL for those that are missing, at every level."""
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        kinds = {f.name: f.dataType for f in have}
        fields = [(conform(value[f.name], kinds[f.name], f.dataType) if f.name in kinds else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: conform(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        return F.transform_values(value, lambda _, x: conform(x, have.valueType, want.valueType))
    return value.cast(want)


def enforce_schema(df: DataFrame, want: T.StructType) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[(conform(F.col(f.name), kinds[f.name], f.dataType) if f.name in kinds else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def without_keys(kind: T.DataType, keys: set[str]) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, without_keys(f.dataType, keys), f.nullable) for f in kind if f.name not in keys])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(without_keys(kind.elementType, keys), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, without_keys(kind.valueType, keys), kind.valueContainsNull)
    return kind


def without_map_keys(value: Column, kind: T.DataType, keys: set[str]) -> Column:
    """value without the named keys of its maps, at any depth."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[without_map_keys(value[f.name], f.dataType, keys).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_map_keys(x, kind.elementType, keys))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(value, lambda k, _: ~k.isin(*keys)) if isinstance(kind.keyType, T.StringType) and keys else value
        return F.transform_values(kept, lambda _, x: without_map_keys(x, kind.valueType, keys))
    return value


def strip_private(df: DataFrame, keys: set[str]) -> DataFrame:
    """df without the named keys, of structs and of maps, at any depth."""
    out = enforce_schema(df, without_keys(df.schema, keys))
    return out.select(*[without_map_keys(F.col(f.name), f.dataType, keys).alias(f.name) if "map<" in f.dataType.simpleString() else f.name for f in out.schema])


def keys_of(kind: T.DataType) -> set[str]:
    """All keys at any depth."""
    if isinstance(kind, T.StructType):
        return {f.name for f in kind} | {k for f in kind for k in keys_of(f.dataType)}
    if isinstance(kind, T.MapType):
        return keys_of(kind.valueType)
    return keys_of(kind.elementType) if isinstance(kind, T.ArrayType) else set()


def alias_actors(actors: Column, others: Column, most: int = 10) -> Column:
    """actors in order of first appearance, then others, then 1..most: an actor's place is its alias."""
    return F.array_distinct(F.filter(F.concat(actors, others, F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long"))), lambda x: x > 0))


def collapse_noops(events: DataFrame) -> DataFrame:
    """events without a check or fold of no amount that repeats the event before it (same actor, stage and type).

    Within a run of equal events all but the first go, so looking one event back equals looking at the last one kept.
    """
    by = Window.partitionBy("sess").orderBy("ord")
    same = [F.lag(c).over(by).eqNullSafe(F.col(c)) for c in ("actor", "stage", "type")]
    drop = same[0] & same[1] & same[2] & F.col("type").isin("check", "fold") & (F.coalesce("amount", F.lit(0.0)) == 0) & (F.coalesce(F.lag("amount").over(by), F.lit(0.0)) == 0)
    return events.withColumn("_drop", F.coalesce(drop, F.lit(False)) & F.lag("ord").over(by).isNotNull()).where("NOT _drop").drop("_drop")


def sample_events(events: DataFrame, seed: str = "view", fewest: int = 5, spread: int = 4, lone_repeats: int = 12) -> DataFrame:
    """A reproducible window of `fewest` to `fewest + spread - 1` events per session: first, last, the first of each stage, then by hash.

    A session of one event is repeated `lone_repeats` times.
    """
    by = Window.partitionBy("sess")
    order = by.orderBy("ord")
    want = fewest + F.conv(F.substring(hash_order(seed, F.col("sess")), 1, 2), 16, 10).cast("int") % spread
    rank = (
        F.when(F.row_number().over(order) == 1, 0).when(F.lead("ord").over(order).isNull(), 1)
        .when(F.row_number().over(Window.partitionBy("sess", "stage").orderBy("ord")) == 1, 2).otherwise(3)
    )
    rows = events.withColumn("_rank", rank).withColumn("_hash", hash_order(seed, F.col("sess"), F.col("ord"))).withColumn("_n", F.count("*").over(by))
    rows = rows.withColumn("_place", F.row_number().over(by.orderBy("_rank", "_hash"))).where(F.col("_place") <= want)
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_n") == 1, lone_repeats).otherwise(1))).alias("copy")
    return rows.select(*events.columns, copies).withColumn("pos", F.row_number().over(by.orderBy("ord", "copy")).cast("long")).drop("copy")


def canonical_view(events: DataFrame, unit: float = 1.0, forced: tuple[str, ...] = ("small_blind", "big_blind", "ante"), seed: str = "view") -> DataFrame:
    """What may be shown of a session: forced events dropped, no-ops collapsed, a window of events, actors by alias, amounts in coarse units.

    (grp, sess, pos, stage, type, actor, amount, total)
    """
    rows = sample_events(collapse_noops(events.where(~F.col("type").isin(*forced))), seed)
    # an actor's first place is no other's, so their dense rank is the alias; all windows share the partitioning by session
    rows = rows.withColumn("_first", F.min("pos").over(Window.partitionBy("sess", "actor")))
    rows = rows.withColumn("alias", F.when(F.col("actor").isNotNull(), F.dense_rank().over(Window.partitionBy("sess").orderBy("_first"))))
    shown = lambda c: coarsen(F.col(c) / unit, F.col("sess").cast("string"), F.col("pos").cast("string"), F.lit(c)).alias(c)
    return rows.select("grp", "sess", "pos", "stage", "type", F.coalesce("alias", F.lit(0)).cast("long").alias("actor"), shown("amount"), shown("total"))


def filter_quality(events: DataFrame, min_actors: int = 2, min_events: int = 2, max_actors: int | None = None) -> DataFrame:
    """Sessions whose totals never fall, with enough actors and events: (sess, n_actors, n_events)."""
    by = Window.partitionBy("sess").orderBy("ord")
    rows = events.withColumn("_falls", F.coalesce(F.col("total") < F.lag("total").over(by), F.lit(False)))
    out = rows.groupBy("sess").agg(F.count_distinct("actor").alias("n_actors"), F.count("*").alias("n_events"), F.count_if("_falls").alias("falls"), F.min("amount").alias("least"))
    good = (F.col("n_actors") >= min_actors) & (F.col("n_events") >= min_events) & (F.col("falls") == 0) & (F.col("least") > 0)
    return out.where(good if max_actors is None else good & (F.col("n_actors") <= max_actors)).select("sess", "n_actors", "n_events")


def consistency_errors(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold, sorted; a check that is NULL does not hold."""
    found = F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in sorted(checks.items())])
    return F.filter(found, lambda x: x.isNotNull())


def validate_features(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(issue, n): what is wrong with a labelled table, counted; no rows if nothing is."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    names = [c.lower() for c in df.columns]
    repeated = len(names) - len(set(names))
    counts = df.agg(
        F.count("*").alias("rows"), F.lit(repeated).alias("repeated"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("bad_label"), F.count_distinct(label).alias("classes"),
        *[F.count_if(odd(c)).alias(f"missing_{c}") for c in features],
    )
    tests = [("empty", F.when(F.col("rows") == 0, 1)), ("bad_label", F.nullif(F.col("bad_label"), F.lit(0))), ("one_class", F.when(F.col("classes") < 2, 1)), ("repeated_column", F.nullif(F.col("repeated"), F.lit(0)))]
    tests += [(f"missing_{c}", F.nullif(F.col(f"missing_{c}"), F.lit(0))) for c in features]
    rows = F.array(*[F.struct(F.lit(k).alias("issue"), v.cast("long").alias("n")) for k, v in tests])
    return counts.select(F.explode(rows).alias("x")).select("x.*").where("n IS NOT NULL")


def validate_pair(train: DataFrame, val: DataFrame, features: list[str]) -> DataFrame:
    """(check, n): repeated rows in either table and rows that stand in both."""
    dup = lambda df: df.groupBy(*features).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    both = train.select(*features).intersect(val.select(*features)).agg(F.count("*").alias("n"))
    name = lambda df, k: df.select(F.lit(k).alias("check"), F.col("n").cast("long").alias("n"))
    return name(dup(train), "train_repeats").union(name(dup(val), "val_repeats")).union(name(both, "overlap"))


def align_columns(df: DataFrame, want: list[str], mode: str = "strict") -> DataFrame:
    """df with the wanted columns in their order: strict fails on a difference, strip drops extras, off leaves df alone."""
    missing, extra = [c for c in want if c not in df.columns], [c for c in df.columns if c not in want]
    if mode == "off":
        return df
    if missing or (extra and mode == "strict"):
        raise ValueError(f"columns differ: missing {missing}, extra {extra}")
    return df.select(*want)


def align_to_reference(df: DataFrame, like: DataFrame, intersect: bool = False) -> DataFrame:
    """df with the columns of `like`, in its order: missing ones NULL (intersect: left out), extras gone."""
    if intersect:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema if f.name in df.columns])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def drop_sparse_rows(df: DataFrame, features: list[str], max_null_share: float) -> DataFrame:
    nulls = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    return df.where(nulls <= max_null_share * len(features))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns as doubles; what is no number becomes NULL, counted per row in coercion_failures."""
    failed = sum(((F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("int") for c in columns), F.lit(0))
    return df.withColumn("coercion_failures", failed).withColumns({c: F.col(c).try_cast("double") for c in columns})


def coerce_label(df: DataFrame, column: str = "label") -> DataFrame:
    return df.withColumn(column, label_of(F.col(column)))


def pseudonym(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def hashed_column_names(df: DataFrame, salt: str, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    import hashlib

    return df.withColumnsRenamed({c: "h_" + hashlib.sha256(f"{salt}{c}".encode()).hexdigest()[:16] for c in df.columns if c not in keep})


def record_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the columns as canonical JSON (scalars.canonical_json): the order of columns, fields and map entries does not matter."""
    return F.sha2(canonical_json(F.struct(*columns), df.select(*columns).schema), 256)


def dataset_hash(df: DataFrame, hashes: str) -> DataFrame:
    """One hash of a set of row hashes, whatever their order: per two-digit prefix, then over the prefixes."""
    join = lambda c: F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(c))), 256)
    # 256 prefixes of a sorted list each would grow with the table: three more digits keep each list short
    by = df.groupBy(F.substring(hashes, 1, 5).alias("p5")).agg(join(hashes).alias("h")).groupBy(F.substring("p5", 1, 2).alias("p2")).agg(join("h").alias("h"))
    return by.agg(join("h").alias("dataset_hash"), F.count("*").alias("prefixes"))


def flatten_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, value): every number of nested structs and maps, with its dotted path."""

    def leaves(value: Column, kind: T.DataType, path: Column) -> list[Column]:
        """Arrays of (path, value)."""
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")))]
        if isinstance(kind, T.MapType):
            inner = lambda e: F.concat(*leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))) or [none])
            return [F.coalesce(F.flatten(F.transform(F.map_entries(value), inner)), none)]
        return [F.array(F.struct(path.alias("path"), value.cast("double").alias("value")))] if isinstance(kind, T.NumericType) else []

    none = F.array().cast("array<struct<path:string,value:double>>")
    cells = F.concat(none, *[x for f in df.schema if f.name not in keys for x in leaves(F.col(f.name), f.dataType, F.lit(f.name))])
    return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def parse_label_reply(reply: Column) -> Column:
    """0 or 1 from a reply that may wrap a JSON object in words or a code fence, else NULL."""
    body = F.regexp_extract(F.regexp_replace(reply, "```(json)?", ""), r"(?s)\{.*?\}", 0)
    found = F.coalesce(F.get_json_object(F.nullif(body, F.lit("")), "$.label"), F.regexp_extract(reply, r"\b([01])\b", 1))
    return found.try_cast("int")


def compliance(manifest: dict[str, Column]) -> Column:
    """Names of the required fields that are missing or blank, sorted."""
    return F.filter(F.array(*[F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", k) for k, c in sorted(manifest.items())]), lambda x: x.isNotNull())
