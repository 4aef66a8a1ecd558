"""Importance resampling towards a target distribution, by hashed n-gram counts and Gumbel top-k.

Words and their n-grams fall into buckets by CRC-32. A bucket's gain is the log ratio of its smoothed
shares in the target texts and in all documents; a document's weight is the mean gain of its features. Adding a Gumbel number,
a hash of the id, and taking the highest scores draws without replacement in proportion to the weights.

The CRC is affine over bits: apart from a constant of the length alone, each byte adds (XOR) a value that depends
on the byte and its distance from the end. So the checksums of all features of a text come from one look-up in a table of
256 values for each of `SPAN` distances and one bitwise_xor.reduceat over the features' spans. Longer spans are cut into blocks of
`SPAN` bytes from the end: the blocks' values are folded from the front, moving the value so far on by SPAN bytes (four look-ups)
before the next is added.

Counts are arrays of `buckets` numbers per task, added up by bucket. Scores are whole numbers; ranks are counted in ranges of (score, id), so
no task holds them all.

Edge cases: null and empty texts have no feature and weight 0; documents without `least_words` words are never drawn; features of over
SPAN bytes, however long, are exact; a null id's Gumbel number is that of an empty one, and it comes after others of its score; repeated rows count and
are drawn each; an empty target leaves shares of one over `buckets`; an empty table gives an empty result; only id and text columns are read, so others
cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupsight.llm.common import prepare
from groupsight.sources.store import cut

#: Distances from a span's end that the position table holds.
SPAN = 64
#: Bytes of words: digits, small letters and all of other characters; [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
#: Bytes of features that are gathered at a time.
GATHER = 1 << 20


def _position_table() -> np.ndarray:
    """[distance from the end][byte] to what the byte adds to the checksum."""
    t = np.empty((SPAN, 256), np.uint32)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    t[0] = c
    for d in range(1, SPAN):
        t[d] = _on(t[0], t[d - 1])
    return t


def _on(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    """State after one zero byte more."""
    return (state >> np.uint32(8)) ^ table[state & np.uint32(0xFF)]


_TABLE = _position_table()
_FLAT = _TABLE.ravel()


def _moved(steps: int) -> np.ndarray:
    """[k][byte] to what byte k of a state becomes after `steps` zero bytes."""
    out = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    for _ in range(steps):
        out = _on(_TABLE[0], out)
    return out


#: The four look-ups that move a state on by SPAN bytes.
_SHIFT = [x.tolist() for x in _moved(SPAN)]


def _length_constants(upto: int) -> np.ndarray:
    """What the length alone adds: the checksum of as many zero bytes as the index says."""
    out = np.empty(upto + 1, np.uint32)
    state = np.array([0xFFFFFFFF], np.uint32)
    for n in range(upto + 1):
        out[n] = state[0] ^ np.uint32(0xFFFFFFFF)
        state = _on(_TABLE[0], state)
    return out


_LENGTH = _length_constants(SPAN)


def _linear(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes' part of the checksum of each span data[start:end) of 1 to SPAN bytes."""
    size = ends - starts
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    gathered = data[np.repeat(starts, size) + within].astype(np.int64)
    distance = np.repeat(size, size) - 1 - within
    return np.bitwise_xor.reduceat(_FLAT[distance * 256 + gathered], first)


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span data[start:end) of one byte or more."""
    out = np.empty(len(starts), np.uint32)
    size = ends - starts
    short = np.flatnonzero(size <= SPAN)
    at = 0
    while at < len(short):
        # as many spans as GATHER bytes hold
        some = short[at : at + max(1, int(np.searchsorted(np.cumsum(size[short[at : at + GATHER]]), GATHER)))]
        out[some] = _linear(data, starts[some], ends[some])
        at += len(some)
    out[short] ^= _LENGTH[size[short]]
    low, second, third, high = _SHIFT
    for i in np.flatnonzero(size > SPAN):
        cuts = np.arange(ends[i], starts[i], -SPAN)[::-1]  # ends of the blocks, of which the first may be short
        state = int(_LENGTH[cuts[0] - starts[i]] ^ np.uint32(0xFFFFFFFF))  # the length counts from the first block on
        state ^= int(_linear(data, starts[i : i + 1], cuts[:1])[0])
        for some in np.array_split(cuts[1:], len(cuts) * SPAN // GATHER + 1):
            for value in _linear(data, some - SPAN, some).tolist() if len(some) else ():
                state = value ^ low[state & 255] ^ second[state >> 8 & 255] ^ third[state >> 16 & 255] ^ high[state >> 24]
        out[i] = state ^ 0xFFFFFFFF
    return out


def feature_buckets(text: bytes | None, most: int = 1, buckets: int = 10_000) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to `most` consecutive words."""
    data = np.frombuffer((text or b"").lower(), np.uint8)
    edge = np.flatnonzero(np.diff(_WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return 0, np.empty(0, np.int64)
    found = [span_crcs(data, starts, ends)]
    if most > 1 and n > 1:
        size = ends - starts
        line = np.full(int(size.sum()) + n - 1, 0x20, np.uint8)  # the words with one space between them
        at = np.cumsum(size + 1) - size - 1
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        line[np.repeat(at, size) + within] = data[_WORD[data]]
        for k in range(2, min(most, n) + 1):
            found.append(span_crcs(line, at[: n - k + 1], (at + size)[k - 1 :]))
    return n, np.concatenate(found).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows (t binary)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(buckets, np.int64)
        for pdf in parts:
            for t in pdf.t:
                counts += np.bincount(feature_buckets(t, most, buckets)[1], minlength=buckets)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": at, "n": counts[at]})

    rows = texts.mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row per bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's smoothed shares in target and documents."""
    size, total, wanted = len(docs), float(docs.sum() + len(docs)), float(target.sum() + len(docs))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * total / ((float(s) + 1) * wanted))) for s, t in zip(docs, target, strict=True)], np.int64).reshape(size)


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each document's features."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    gain = gains(bucket_counts(source.select("t"), most, buckets), bucket_counts(target.select(F.col(text_col).cast("binary").alias("t")), most, buckets))
    sent = spark.sparkContext.broadcast(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out = []
            for t in s:
                n, found = feature_buckets(t, most, buckets)
                out.append((n, len(found), int(sent.value[found].sum()) // len(found) if len(found) else 0))
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"], dtype="int64")

    return source.select("id", run("t").alias("w")).select("id", "w.*")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1, buckets: int = 10_000,
    per_hundred: int = 10, least_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): rank is the place among the drawn, null for others."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = cut(weigh(docs, target, id_col, text_col, most, buckets).withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("n_words") >= least_words
    n = rows.where(fit).count() * per_hundred // 100
    # the written order of a range is its rows' order: the id's lower 33 bits count within the range
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("_row")]
    ranged = rows.where(fit).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    sizes = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row per range
    before, offsets = 0, []
    for p, size in sizes:
        offsets.append((p, before))
        before += size
    starts = docs.sparkSession.createDataFrame(offsets, "_part long, _before long")
    placed = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row per range
    placed = placed.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long")) + 1)
    names = ["id", "n_words", "n_features", "weight", "score"]
    drawn = placed.select(*names, F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
    return drawn.unionByName(rows.where(~fit).select(*names, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, benchmark).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
