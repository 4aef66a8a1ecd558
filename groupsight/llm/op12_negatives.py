"""Hard-negative mining by exact integer inner products in a residue number system.

Components become whole numbers, floor(scale * x). Inner products are taken modulo a few primes below 256 as float32
matrix products of residues between -127 and 127: sums of up to 1024 such products stay below 2**24 and so are exact; longer
vectors are summed in blocks that are reduced in between. Mixed-radix Chinese remaindering gives the signed score back. As many primes are taken as twice the
largest squared norm asks for (two at least), so every score is exact.

Anchors are a stated part of the rows. In groups of a bounded number they are sent to all tasks, and each task takes its rows in
blocks against them, twice: for the anchors' best rows of the same label (positives), then for the best rows of other labels within each
positive's window of scores. A task keeps only its own best few per anchor, and a window over those few per task
selects the result. More groups are more passes over the rows, never more memory.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of
other lengths are filled with zeros to the longest, so an empty vector scores 0 with all; a positive's window is empty where its score is below zero; ties
go to smaller ids, null ids last, then by label and the row's place; repeated rows, repeated anchors and positives count and are mined each; a null id is
no anchor; an empty table, or one without anchors, gives an empty result; norms of 2**25 or more (components of that size) raise an
error, as do other than numeric arrays; only id, vector and label columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupsight.llm.common import prepare
from groupsight.sources.store import cut, scratch

#: The largest primes below 256.
PRIMES = (251, 241, 239, 233, 229, 227, 223)
#: Products of two residues that a float32 sum holds exactly.
DEPTH = 1024
#: Anchors that are sent to the tasks at a time.
GROUP = 16_384
#: Rows and anchors of one matrix product.
ROWS, ANCHORS = 4096, 512
_NONE = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p as float32, between -(p - 1) / 2 and (p - 1) / 2."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def primes_for(bound: int) -> tuple[int, ...]:
    """Primes whose product exceeds twice the bound on absolute scores."""
    product, out = 1, []
    for p in PRIMES:
        out.append(p)
        product *= p
        if product > 2 * bound and len(out) > 1:
            return tuple(out)
    raise ValueError(f"scores of up to {bound} are out of reach")


def exact_products(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Scores (rows of a by rows of b, int64) from the residue matrices of each prime."""
    total, radix = None, 1
    for x, y, p in zip(a, b, primes, strict=True):
        r = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, max(x.shape[1], 1), DEPTH):
            r += x[:, at : at + DEPTH] @ y[:, at : at + DEPTH].T
            r -= p * np.rint(r / np.float32(p))  # |r| < 2**24: exact
        # the next mixed-radix digit: what is left of the residue after the digits so far, over their radix
        r = r.astype(np.int64)
        if total is None:
            total = r
        else:
            d = np.mod((r - total) * pow(radix % p, -1, p), p)
            d = np.where(d > p // 2, d - p, d)
            total = total + radix * d
        radix *= p
    return total


class Best:
    """Of each place the k best (score, id, label, row) so far: higher scores first, then smaller ids, labels, rows."""

    def __init__(self, places: int, k: int):
        self.k = k
        self.found = np.full((4, places, k), _NONE, np.int64)
        self.found[1:] = _NO_ID

    def offer(self, places: np.ndarray, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        """scores: places by rows, of which ok ones count; rows are in order of id, label and row."""
        worst, last = self.found[0, places, -1][:, None], self.found[1, places, -1][:, None]
        ok = ok & ((scores > worst) | ((scores == worst) & (ids[None, :] <= last)))
        some = np.flatnonzero(ok.any(axis=1))
        if not len(some):
            return
        # one number for score and place in the block: no two are equal, and equal scores keep the order
        key = np.where(ok[some], scores[some] * ROWS + np.arange(scores.shape[1])[::-1][None, :], _NONE)
        k = min(self.k, key.shape[1])
        at = np.argpartition(key, key.shape[1] - k, axis=1)[:, -k:]
        real = np.take_along_axis(key, at, axis=1) > _NONE
        new = np.stack([np.take_along_axis(scores[some], at, axis=1), ids[at], labels[at], rows[at]])
        new[0][~real] = _NONE
        new[1:, ~real] = _NO_ID
        both = np.concatenate([self.found[:, places[some]], new], axis=2)
        order = np.lexsort((both[3], both[2], both[1], -np.maximum(both[0], -(2**62))), axis=1)[:, : self.k]
        self.found[:, places[some]] = np.take_along_axis(both, np.broadcast_to(order, (4, *order.shape)), axis=2)

    def rows(self) -> tuple[np.ndarray, ...]:
        """(place, score, id, label, row) of all that was found."""
        p, j = np.nonzero(self.found[0] > _NONE)
        return p, *self.found[:, p, j]


class Anchors:
    """A bounded group of anchors: rows, labels and residues, a block of ANCHORS at a time."""

    def __init__(self, rows: pa.Table, dim: int, primes: tuple[int, ...]):
        self.dim, self.primes = dim, primes
        self.row, self.label, self.id = (rows.column(c).to_numpy() for c in ("row", "label", "id"))
        x = matrix_of(rows.column("v").combine_chunks(), dim)
        self.residues = [residues(x, p) for p in primes]

    def blocks(self) -> Iterator[np.ndarray]:
        for at in range(0, len(self.row), ANCHORS):
            yield np.arange(at, min(at + ANCHORS, len(self.row)))

    def against(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(anchors, scores, ids, labels, rows) for each block of anchors and rows; rows in order of id, label, row."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids = some.column("id").fill_null(_NO_ID).to_numpy()
                labels, rows = some.column("label").to_numpy(), some.column("row").to_numpy()
                order = np.lexsort((rows, labels, ids))
                x = matrix_of(some.column("v"), self.dim)[order]
                mine = [residues(x, p) for p in self.primes]
                for block in self.blocks():
                    yield block, exact_products([r[block] for r in self.residues], mine, self.primes), ids[order], labels[order], rows[order]


def matrix_of(vectors: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, filled with zeros."""
    size = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = vectors.flatten().to_numpy()
    return out


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of each group, with place; a group has k rows per task at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "label", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _positives(rows: DataFrame, sent, k: int) -> DataFrame:
    """(a, id, score, place): the k best rows of each anchor's label, the anchor's own row apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        best = Best(len(anchors.row), k)
        for block, scores, ids, labels, numbers in anchors.against(batches):
            ok = (anchors.label[block][:, None] == labels[None, :]) & (anchors.row[block][:, None] != numbers[None, :])
            best.offer(block, scores, ok, ids, labels, numbers)
        a, score, i, label, row = best.rows()
        yield pa.RecordBatch.from_pydict({"a": a.astype(np.int64), "id": pa.array(i, mask=i == _NO_ID), "label": label, "row": row, "score": score})

    found = rows.mapInArrow(run, "a long, id long, label long, row long, score long")
    return _ranked(found, ["a"], k).select("a", "id", "score", "place")


def _negatives(rows: DataFrame, sent, positives, k: int, low: int) -> DataFrame:
    """(a, place_p, id, score, place): the k best rows of other labels within each positive's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, top = sent.value, positives.value
        best = [Best(len(anchors.row), k) for _ in range(top.shape[1])]
        for block, scores, ids, labels, numbers in anchors.against(batches):
            other = anchors.label[block][:, None] != labels[None, :]
            for j, b in enumerate(best):
                s = top[block, j][:, None]
                ok = other & (scores <= s) & (100 * scores >= low * s) & (s > _NONE)
                if ok.any():
                    b.offer(block, scores, ok, ids, labels, numbers)
        for j, b in enumerate(best):
            a, score, i, label, row = b.rows()
            yield pa.RecordBatch.from_pydict({"a": a.astype(np.int64), "p": np.full(len(a), j + 1, np.int32), "id": pa.array(i, mask=i == _NO_ID), "label": label, "row": row, "score": score})

    found = rows.mapInArrow(run, "a long, p int, id long, label long, row long, score long")
    return _ranked(found, ["a", "p"], k).select("a", "p", "id", "score", "place")


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, group: int = GROUP,
) -> DataFrame:
    """(anchor_id, positive_id, positive_place, rank, negative_id, positive_score, negative_score) of the rows for which anchor, a condition on id, holds."""
    spark = vectors.sparkSession
    prepare(spark)
    x = lambda c: c.cast("double")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("long").alias("label"))
    rows = source.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(~bad)
    rows = rows.withColumn("v", F.transform("v", lambda c: F.floor(scale * x(c)))).withColumn("row", F.monotonically_increasing_id())
    schema = "anchor_id long, positive_id long, positive_place int, rank int, negative_id long, positive_score long, negative_score long"
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + x(c) * x(c))
    out = [spark.createDataFrame([], schema)]
    with scratch(spark) as tables:
        rows = cut(rows.withColumn("anchor", F.coalesce(anchor & F.col("id").isNotNull(), F.lit(False))), "whole_vectors")
        dim, most, n = rows.agg(F.max(F.size("v")), F.max(norm), F.count_if("anchor")).first()
        if n and most >= 2.0**50:
            raise ValueError(f"norms of {most**0.5:.3g} are out of reach of exact scores: below {2**25} is wanted")
        candidates, groups = rows.select("id", "v", "label", "row"), -(-n // group)
        for g in range(groups):
            part = rows.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).select("id", "v", "label", "row")
            anchors = Anchors(part.orderBy("row").toArrow(), dim, primes_for(int(most * 1.0001) + 1))  # about `group` rows
            sent = spark.sparkContext.broadcast(anchors)
            found = cut(_positives(candidates, sent, positives), "positives")
            top = np.full((len(anchors.row), positives), _NONE, np.int64)
            for r in found.select("a", "place", "score").toArrow().to_pylist():  # `positives` rows per anchor of the group
                top[r["a"], r["place"] - 1] = r["score"]
            scores = spark.sparkContext.broadcast(top)
            own = spark.createDataFrame(pd.DataFrame({"a": np.arange(len(anchors.row)), "anchor_id": anchors.id}), "a long, anchor_id long")
            pos = found.select("a", F.col("place").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            done = _negatives(candidates, sent, scores, negatives, low).join(F.broadcast(pos), ["a", "p"]).join(F.broadcast(own), "a")  # rows of a group
            done = done.select(
                "anchor_id", "positive_id", F.col("p").alias("positive_place"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"),
            )
            done, path = cut(done, "mined", with_path=True)
            tables.remove(path)
            out.append(done)
            sent.destroy()
            scores.destroy()
    return reduce(DataFrame.union, out)


def relabelled(vectors: DataFrame) -> DataFrame:
    """Labels of rows whose vec_id is divisible by 7 move on by one."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    rows = relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mine(rows, F.col("id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
