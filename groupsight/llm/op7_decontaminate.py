"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so an item's Jaccard similarity to a whole document says
nothing. Items are partitioned by size (numbers of shingles up to 8, 16, 32, ...). For the partition of
items of up to s shingles, a document is seen as windows of 2s shingles that start every s, so an
item that stands in the document lies within one window and has at least a fixed similarity to it,
whatever the document's length. Windows and items get MinHash signatures of `permutations` values;
minima of s shingles are taken once from the smallest size upwards and merged pairwise. A window
that shares one minimum with an item is a candidate (bands of one row: items of 5 shingles or more
are above half their partition's size, so at containment 0.8 and 48 permutations a miss has a chance
of 4e-5 at most), and the candidate pair is verified by exact shingle containment in the whole
document. Items of up to 4 shingles are looked up by the hashes of their shingles, so none is missed.

The items are a stated query set: they are taken in blocks of about `block_items`, so what the driver and each
task hold is bounded (about 1 KB an item), and documents are never shuffled; a block is a pass over the documents.

Words are runs of letters and digits, lower-cased. Edge cases: null or empty documents, and items
of fewer words than a shingle, have no shingle and match nothing; repeated items and documents
give a row each; ties do not occur (every pair over the threshold is returned); empty tables give
an empty result; only id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupsight.llm.common import prepare

_WORD = re.compile(r"[^\W_]+")
_KNOWN_WORDS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint32(0x9E3779B1)
_FILTER_BITS = 20
SMALLEST = 8
#: Items of up to this many shingles are looked up exactly; all others are above half of their partition's size.
EXACT = SMALLEST // 2


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """64-bit hashes of the words met so far."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_KNOWN = WordHashes()


def shingle_hashes(words: list[str], size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    if len(_KNOWN) > _KNOWN_WORDS:
        _KNOWN.clear()
    w = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    n = len(w) - size + 1
    h = np.zeros(n, np.uint64)
    for d in range(size):
        h ^= w[d : d + n]
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def shingles(words: list[str], size: int) -> set[str]:
    return {" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}


def permutation_seeds(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**32, n, np.uint64).astype(np.uint32) | np.uint32(1)


def _halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)


def _permuted(low: np.ndarray, high: np.ndarray, seed: np.uint32) -> np.ndarray:
    """32-bit values of one permutation."""
    x = low * seed
    x ^= x >> np.uint32(15)
    x += high
    x *= seed ^ np.uint32(0x85EBCA6A)
    return x


def _pairwise(x: np.ndarray) -> np.ndarray:
    """Minima of neighbouring pairs; an odd last value stands alone."""
    if len(x) % 2:
        x = np.append(x, x[-1])
    return np.minimum(x[::2], x[1::2])


class Shingles(dict):
    """Exact shingles of items, made when an item first becomes a candidate."""

    def __init__(self, texts: list[str | None], size: int):
        super().__init__()
        self.texts, self.size = texts, size

    def __missing__(self, item: int) -> set[str]:
        out = self[item] = shingles(words_of(self.texts[item]), self.size)
        return out


class Items:
    """One block of test items: texts, hashes of short items, and signatures of the others by size partition and permutation."""

    def __init__(self, rows: list[tuple[int, str]], size: int, permutations: int):
        self.ids = [i for i, _ in rows]
        self.shingles = Shingles([t for _, t in rows], size)
        hashes = [np.unique(shingle_hashes(words_of(t), size)) for _, t in rows]
        sizes = np.array([len(s) for s in hashes], np.int64)
        level_of = np.maximum(0, np.ceil(np.log2(np.maximum(1, sizes) / SMALLEST))).astype(np.int64)
        self.levels = int(level_of[sizes > EXACT].max(initial=-1)) + 1
        self.short, self.short_of = self._sorted(np.flatnonzero((sizes > 0) & (sizes <= EXACT)), hashes)
        self.seeds = permutation_seeds(permutations)
        self.minima: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for level in range(self.levels):
            of = np.flatnonzero((level_of == level) & (sizes > EXACT))
            if not len(of):
                continue
            low, high = _halves(np.concatenate([hashes[i] for i in of]))
            starts = np.cumsum(sizes[of]) - sizes[of]
            for p, seed in enumerate(self.seeds):
                v = np.minimum.reduceat(_permuted(low, high, seed), starts)
                order = np.argsort(v, kind="stable")
                maybe = np.zeros(1 << _FILTER_BITS, bool)
                maybe[(v * _SPREAD) >> np.uint32(32 - _FILTER_BITS)] = True
                self.minima[level, p] = v[order], of[order].astype(np.int32), np.packbits(maybe, bitorder="little")

    @staticmethod
    def _sorted(of: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All hashes of the items `of` in order, and the item of each."""
        values = np.concatenate([np.empty(0, np.uint64), *[hashes[i] for i in of]])
        owner = np.repeat(of, [len(hashes[i]) for i in of])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    def candidates(self, h: np.ndarray, void: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): items that share a minimum, or short items that share a shingle, with the window of shingles from..to.

        h holds the shingles of many documents one after another; void marks those that span two.
        """
        if len(self.short):
            left, right = np.searchsorted(self.short, h, "left"), np.searchsorted(self.short, h, "right")
            for k in np.flatnonzero(right > left):
                for x in self.short_of[left[k] : right[k]].tolist():
                    yield x, int(k), int(k) + 1
        if not self.levels:
            return
        low, high = _halves(h)
        for p, seed in enumerate(self.seeds):
            block = _permuted(low, high, seed)
            block[void] = 0xFFFFFFFF
            width = 1
            while width < SMALLEST:
                block, width = _pairwise(block), 2 * width
            for level in range(self.levels):
                if (level, p) in self.minima:
                    values, of, maybe = self.minima[level, p]
                    window = np.minimum(block[:-1], block[1:]) if len(block) > 1 else block
                    bit = (window * _SPREAD) >> np.uint32(32 - _FILTER_BITS)
                    for k in np.flatnonzero(maybe[bit >> np.uint32(3)] >> (bit & np.uint32(7)).astype(np.uint8) & 1):
                        left, right = np.searchsorted(values, window[k], "left"), np.searchsorted(values, window[k], "right")
                        for x in of[left:right].tolist():
                            yield x, int(k) * width, (int(k) + 2) * width
                block, width = _pairwise(block), 2 * width


def search(texts: list[str | None], block: Items, size: int, threshold: float) -> list[tuple[int, int, int, int]]:
    """(text's place, item's place, item's shingles, shared shingles) of pairs over the threshold."""
    words = [words_of(t) for t in texts]
    ends = np.cumsum([len(w) for w in words])
    h = shingle_hashes([x for w in words for x in w], size)
    if not len(h):
        return []
    void = np.concatenate([np.arange(e - size + 1, e) for e in ends])
    void = void[(void >= 0) & (void < len(h))]
    near: set[tuple[int, int]] = set()
    for x, start, stop in block.candidates(h, void):
        first, last = np.searchsorted(ends, [start, min(stop, len(h)) - 1], "right")
        near.update((i, x) for i in range(int(first), min(int(last), len(words) - 1) + 1))
    found, have, of = [], set(), -1
    for i, x in sorted(near):
        if i != of:
            have, of = shingles(words[i], size), i
        want = block.shingles[x]
        shared = len(want & have)
        if want and shared >= threshold * len(want):
            found.append((i, x, len(want), shared))
    return found


def item_blocks(items: DataFrame, item_col: str, item_text: str, shingle: int, permutations: int, block_items: int) -> list[Broadcast]:
    """Broadcast blocks of about block_items items each."""
    spark = items.sparkSession
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("t")).where("item IS NOT NULL")
    blocks = max(1, -(-items.count() // block_items))
    # a block holds block_items on average; hashing keeps it within a few deviations of that
    rows = lambda k: [tuple(r) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()]
    return [spark.sparkContext.broadcast(Items(rows(k), shingle, permutations)) for k in range(blocks)]


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    threshold: float = 0.8, shingle: int = 5, permutations: int = 48, block_items: int = 100_000,
) -> DataFrame:
    """(id, item, item_shingles, shared_shingles, containment): pairs with at least `threshold` of the item's shingles in the document."""
    prepare(docs.sparkSession)
    kind, id_type = dict(items.dtypes)[item_col], dict(docs.dtypes)[id_col]
    schema = f"id string, item {kind}, item_shingles long, shared_shingles long"
    # ids travel as text: pandas would make floats of whole numbers beside a null
    source, out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")), None
    for sent in item_blocks(items, item_col, item_text, shingle, permutations, block_items):

        def run(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            block = sent.value
            for pdf in parts:
                found = search(list(pdf.t), block, shingle, threshold)
                yield pd.DataFrame({
                    "id": pdf.id.iloc[[f[0] for f in found]].array, "item": [block.ids[f[1]] for f in found],
                    "item_shingles": np.array([f[2] for f in found], np.int64), "shared_shingles": np.array([f[3] for f in found], np.int64),
                })

        part = source.mapInPandas(run, schema)
        out = part if out is None else out.union(part)
    return out.withColumn("id", F.col("id").cast(id_type)).withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def clean_documents(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    threshold: float = 0.8, shingle: int = 5, permutations: int = 48, block_items: int = 100_000,
) -> DataFrame:
    """The rows of docs that hold no test item, with docs' own columns; each row is judged by its own text where it stands, whatever its id."""
    prepare(docs.sparkSession)

    def holder(sent: Broadcast):
        @F.pandas_udf("boolean")
        def holds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                out = np.zeros(len(s), bool)
                out[[f[0] for f in search(list(s), sent.value, shingle, threshold)]] = True
                yield pd.Series(out)

        return holds

    for sent in item_blocks(items, item_col, item_text, shingle, permutations, block_items):
        docs = docs.where(~holder(sent)(text_col))
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).withColumnsRenamed({"id": "doc_id", "item": "item_id"})
