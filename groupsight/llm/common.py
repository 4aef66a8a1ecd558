"""What the text operators share: tables in the shared folder, byte-level words, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groupsight.session import ship_package
from groupsight.sources.store import cut, drop_table

#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+; bytes.split() without arguments splits on exactly these.
SPACE = b" \t\n\r\x0b\x0c"
#: Rows in an Arrow batch at most; long texts make large batches.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches of texts small."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: A side of up to this many rows is broadcast; a larger one is joined by shuffle, where adaptive execution splits hot keys.
BROADCAST_ROWS = 300_000


def sized(side: DataFrame, name: str) -> DataFrame:
    """side as a table in the shared folder, to be broadcast if it has BROADCAST_ROWS rows at most.

    A join of two tables has plain exchanges on both sides, so adaptive execution can split its hot keys.
    """
    side = cut(side, name)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a table in the shared folder with a key of each row, and the key's name; ids may be null or repeated, the key is not."""
    row = fresh(docs, "_row")
    return cut(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def training_row(col: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is not 0."""
    return F.crc32(col.cast("string").cast("binary")) % 5 != 0


def bounded_labels(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most max_rows rows (id, label) of the training part, those with the smallest hash of their id; labels other than 0 and 1 are not learnt from."""
    rows = labels.where(training_row(F.col(id_col)) & F.col(label_col).isin(0, 1))
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(max_rows)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links: (node, root), root the smallest node reachable.

    Alternates large-star and small-star rounds. Each half is an aggregate and a join with its result,
    which is broadcast under a checked size and else a table of its own, so that a star's centre,
    which has a row per link, is split and no component is gathered in one task. Every
    round ends in a table in the shared folder, and the loop stops when a round changes no link.
    """
    spark = edges.sparkSession
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now, path = cut(edges.where("a <> b").select(hi.alias("u"), lo.alias("v")).distinct(), "links", with_path=True)

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = sign(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sized(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = cut(large, "large_stars", with_path=True)
        least = sized(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after_df, after_path = cut(small.where("u <> v").distinct(), "links", with_path=True)
        after = sign(after_df)
        drop_table(spark, path)
        drop_table(spark, large_path)
        now, path = after_df, after_path
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
