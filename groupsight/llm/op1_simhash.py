"""SimHash near-dedup by multi-index hashing.

A fingerprint's 64 bits are cut into segments. Two fingerprints within `radius` bits agree, up to
a small Hamming ball, in at least one segment (pigeonhole), so every fingerprint probes the keys
of that ball in each segment's table, fetches what stands there and compares whole fingerprints.
Identical fingerprints are one entry, so exact copies never meet in pairs.

A key whose table holds more than `HOT_KEY` different fingerprints (one template with thousands of
edits) would give all pairs of its entries. Such keys are dealt into cells of a bounded number of
entries and probes instead; each cell is compared in blocks and gives only a spanning forest of its
links, so the components stay exact while the links stay linear.

Edge cases: null or empty text has no shingle and fingerprint zero, and links with other zeros like
any fingerprint; fewer than `shingle` words make one shingle; repeated rows are kept, one result
each; a null id is kept and counts only as null in the smallest id of its component; an empty
table gives an empty result; other columns are not carried here, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupsight.llm.common import components, prepare, sized
from groupsight.sources.store import cut

SEED = 42
HOT_KEY = 64
CELL = 2048


def simhash(text: bytes | None, shingle: int = 4) -> int:
    """Signed 64-bit fingerprint of a text's bytes."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        pieces = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pieces = [line[a:b] for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(pieces), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per document, fp the signed 64-bit fingerprint."""
    prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([simhash(x, shingle) for x in s], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col).cast("binary")).alias("fp"))


#: Entries of a key on average, beyond which longer segments are taken.
KEY_ENTRIES = 16


def segments(radius: int, n: int = 0) -> list[tuple[int, int, int]]:
    """(offset, width, ball radius) of each segment, for a table of n fingerprints: the balls' radii plus one sum to radius + 1.

    As many segments as balls of radius 0 and 1 allow, while their keys hold KEY_ENTRIES fingerprints on average at most; else fewer, longer ones with larger balls.
    """
    m = max(1, (radius + 2) // 2)
    while m > 1 and n > KEY_ENTRIES << (64 // m):
        m -= 1
    width = [64 // m + (i < 64 % m) for i in range(m)]
    least, more = divmod(radius + 1, m)
    return [(sum(width[:i]), w, least - 1 + int(i < more)) for i, w in enumerate(width)]


def ball(width: int, radius: int) -> list[int]:
    """The masks of up to `radius` bits below width."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _entry(seg: int, key: Column, flip: bool) -> Column:
    return F.struct(F.lit(seg).alias("seg"), key.alias("key"), F.lit(flip).alias("flip"))


def _upward(seg: int, key: Column, width: int) -> Column:
    """The keys that have one more bit set than key."""
    lacking = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(width)]), lambda b: key.bitwiseAND(b) == 0)
    return F.transform(lacking, lambda b: _entry(seg, key.bitwiseOR(b), True))


def _around(seg: int, key: Column, width: int, radius: int) -> Column:
    """All keys within radius bits of key."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])
    return F.transform(masks, lambda m: _entry(seg, key.bitwiseXOR(m), False))


def _table_and_probes(fps: DataFrame, radius: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Keys of each fingerprint's own segments; keys to probe, flip true where one bit is set that the fingerprint lacks.

    Of two keys that differ in one bit, one lacks it, so upward flips find each pair from one side. Larger balls are probed whole.
    """
    own, probe = [], []
    for k, (off, width, r) in enumerate(segments(radius, n)):
        key = F.shiftrightunsigned("fp", off).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        own.append(_entry(k, key, False))
        if r < 2:
            probe.append(F.array(_entry(k, key, False)))
        if r == 1:
            probe.append(_upward(k, key, width))
        if r > 1:
            probe.append(_around(k, key, width, r))
    flat = lambda arr: fps.select("fp", F.explode(arr).alias("x")).select("fp", "x.*")
    return flat(F.array(*own)).drop("flip"), flat(F.concat(*probe))


def _link_cell(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning links among a cell's probes and table entries that lie within the radius."""
    t = pdf.fp[~pdf.probe].to_numpy(np.int64)
    p = pdf.fp[pdf.probe].to_numpy(np.int64)
    label, a, b = np.arange(len(t)), [], []
    for at in range(0, len(p), 512):
        near = np.bitwise_count(p[at : at + 512, None].view(np.uint64) ^ t[None, :].view(np.uint64)) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            hit = np.flatnonzero(near[i])
            if p[at + i] != t[hit[0]]:
                a.append(p[at + i])
                b.append(t[hit[0]])
            if (labels := np.unique(label[hit])).size > 1:
                for x in labels[1:]:
                    a.append(t[x])
                    b.append(t[labels[0]])
                label[np.isin(label, labels[1:])] = labels[0]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between different fingerprints that have the components of all pairs within `radius` bits."""
    table, probes = _table_and_probes(fps, radius, fps.count())
    hot = sized(table.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY), "hot_keys")
    cold = table.join(hot, ["seg", "key"], "left_anti").withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius
    # hot keys number at most entries / HOT_KEY; their probes go to the cells only
    pairs = (
        probes.join(hot, ["seg", "key"], "left_anti")
        .join(cold, ["seg", "key"])
        .where(close & (F.col("flip") | (F.col("fp") < F.col("b"))))
        .select(F.col("fp").alias("a"), "b")
    )
    met = sized(probes.join(hot, ["seg", "key"]).groupBy("seg", "key").agg(F.count("*").alias("m"), F.first("n").alias("n")), "hot_sizes")
    dealt = lambda df, probe: df.join(met, ["seg", "key"]).select("seg", "key", "fp", F.lit(probe).alias("probe"), *[F.ceil(F.col(c) / CELL).cast("int").alias(c) for c in "mn"])
    mine = lambda side: F.pmod(F.xxhash64("fp"), F.col(side)).cast("int")
    others = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    cells = dealt(probes, True).select("seg", "key", "fp", "probe", mine("m").alias("pb"), others("n").alias("tb")).union(
        dealt(table, False).select("seg", "key", "fp", "probe", others("m").alias("pb"), mine("n").alias("tb"))
    )
    spanning = cells.groupBy("seg", "key", "pb", "tb").applyInPandas(lambda pdf: _link_cell(pdf, radius), "a long, b long")
    return pairs.union(spanning)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id): every document with its fingerprint and the smallest id of its component."""
    one = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = cut(one.groupBy("fp").agg(F.min("id").alias("least")), "distinct_fingerprints")
    found = components(links(distinct.select("fp"), radius))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named, "rooted")
    per_root = sized(named.groupBy("root").agg(F.min("least").alias("component_id")), "component_ids")
    per_fp = sized(named.join(per_root, "root").select("fp", "component_id"), "fingerprint_components")
    return one.join(per_fp, "fp").select("id", "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
