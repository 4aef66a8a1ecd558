"""Packing along a space-filling curve.

Each document's token ids are hashed to signed directions, summed and scaled, so that documents
with like tokens get like vectors of a few dimensions. The vector's place on a Hilbert curve is the
document's key. Documents are range-sorted by key and their tokens laid end to end in that order:
sequence k takes tokens 2048 k to 2048 k + 2047, so neighbours on the curve share sequences and only
the very last sequence can be padded.

Tokens are made once and kept as 16-bit ids in the shared folder. Sizes and keys alone are sorted and
summed (by partition, then over the partitions' totals); the ids then meet their positions in
one join and are cut into pieces where they stand.

Edge cases: null text is empty; an empty document is its end token alone; null ids sort first and
are kept; repeated rows are packed each; ties on the curve go by id, then row; an empty table gives
an empty result; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupsight.llm.common import prepare
from groupsight.sources.store import cut

LENGTH = 2048
END = 1
DIMS, BITS = 3, 12
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
_CACHE_CHUNKS = 400_000
_OPEN_SPACE = re.compile(r" (?=\s|$)")


class Chunks(dict):
    """Token ids of chunks of text, as little-endian 16-bit numbers; new chunks are encoded when asked for."""

    def __init__(self, ranks_path: str, vocabulary_path: str):
        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _lines(ranks_path))}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.vocabulary_path, self.whole = vocabulary_path, None

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        out = struct.pack(f"<{len(ids)}H", *ids)
        self[chunk] = out
        return out

    def with_specials(self, text: str) -> bytes:
        """Ids of a text that may hold a special token's string, by the vocabulary's own file."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary_path)
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)


def _lines(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return f.read().splitlines()


@lru_cache(maxsize=1)
def chunks_of(ranks_path: str, vocabulary_path: str) -> Chunks:
    """One table of chunks for a worker."""
    return Chunks(ranks_path, vocabulary_path)


def encode(text: str | None, known: Chunks) -> bytes:
    """Token ids of a whole text, as little-endian 16-bit numbers.

    The byte-level pattern never joins a visible character and a space that follows it, so a text
    without two white spaces in a row at a space falls apart at its spaces into chunks whose ids are
    looked up. Other texts are encoded whole, and those that may hold a special token by
    the vocabulary's own file; the rank file holds the same vocabulary.
    """
    if not text:
        return b""
    if "<|" in text:
        return known.with_specials(text)
    if "\x00" in text or _OPEN_SPACE.search(text):
        ids = known.encode(text)
        return struct.pack(f"<{len(ids)}H", *ids)
    if len(known) > _CACHE_CHUNKS:
        known.clear()
    return b"".join(map(known.__getitem__, text.replace(" ", "\x00 ").split("\x00")))


def directions(dims: int = DIMS) -> np.ndarray:
    """A fixed pseudo-random direction for each hash bucket of token ids."""
    return np.random.default_rng(11).standard_normal((4096, dims)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) with coordinates of `bits` bits, by Gray-coded octants from the top bit down."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            turned = (x[i] >> b & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ flip) >> b & 1)
    return key


def curve_keys(documents: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents' token ids; documents without tokens are at 0."""
    points = np.zeros((len(documents), table.shape[1]), np.int64)
    for i, ids in enumerate(documents):
        if len(ids):
            counts = np.bincount((ids * np.uint32(2654435761)) >> np.uint32(20), minlength=len(table)).astype(np.float32)
            unit = 1 / (1 + np.exp(-1.6 * (counts @ table) / np.sqrt(counts @ counts)))
            points[i] = np.minimum(unit * (1 << BITS), (1 << BITS) - 1)
    return hilbert(points, BITS)


def tokenized(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, vocabulary_path: str) -> DataFrame:
    """(id, row, key, n, ids): token ids as little-endian 16-bit numbers, END included."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    end = struct.pack("<H", END)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = directions(), chunks_of(ranks_path, vocabulary_path)
        for pdf in parts:
            ids = [encode(t, known) + end for t in pdf.t]
            keys = curve_keys([np.frombuffer(x, "<u2")[:-1].astype(np.uint32) for x in ids], table)
            yield pd.DataFrame({"id": pdf.id, "row": pdf.row, "key": keys, "n": np.array([len(x) // 2 for x in ids], np.int64), "ids": ids})

    # ids travel as text: pandas would make floats of whole numbers beside a null
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("t"))
    return rows.mapInPandas(run, "id string, row long, key long, n long, ids binary").withColumn("id", F.col("id").cast(kind))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, vocabulary_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key): a row per piece."""
    files = ranks_path or public_tokenizers.path(RANKS), vocabulary_path or public_tokenizers.path(TOKENIZER)
    tokens = cut(tokenized(docs, id_col, text_col, *files), "tokens")  # row numbers are fixed from here on
    order = ["key", "id", "row"]
    ranged = tokens.select("id", "row", "key", "n").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()), "curve_order")
    before = F.sum("n").over(Window.partitionBy("part").orderBy(*order)) - F.col("n")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per partition
    first, at = {}, 0
    for r in totals:
        first[r.part] = at
        at += r.n
    starts = docs.sparkSession.createDataFrame(list(first.items()) or [(0, 0)], "part int, first long")
    placed = ranged.withColumn("before", before).join(F.broadcast(starts), "part")
    placed = placed.select("row", (F.col("before") + F.col("first")).alias("at"))
    kind = dict(docs.dtypes)[id_col]

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"]
        for pdf in parts:
            out = []
            for i, key, n, raw, at in zip(pdf.id, pdf.key, pdf.n, pdf.ids, pdf["at"], strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    out.append((i, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, sequence, offset, key))
                    start += size
            yield pd.DataFrame(out, columns=names)

    joined = tokens.join(placed, "row").select(F.col("id").cast("string").alias("id"), "key", "n", "ids", "at")
    out = joined.mapInPandas(pieces, f"`{id_col}` string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long")
    return out.withColumn(id_col, F.col(f"`{id_col}`").cast(kind))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
