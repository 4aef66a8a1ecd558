"""Language identification by language-bitmask n-gram filters.

A letter n-gram belongs to a language if that language uses it about as often, within a stated share,
as the language that uses it most. The n-grams of each language go into a Bloom filter. The filters
are bit-sliced: a row of the table is one filter position, and bit l of the row is that position in language l's
filter, so the rows at an n-gram's positions, and-ed, are the mask of all languages that contain it. A text is decided by the
number of its n-grams in each language's filter (popcounts of the masks' slices), corrected for false positives: where a
share f of a filter's bits is set, an n-gram that is not in it answers yes with chance f ** HASHES, so of n n-grams with c answers
(c - n * f ** HASHES) / (1 - f ** HASHES) are expected to be truly in it.

Texts are lower-cased, all but letters and combining marks count as one space, and n-grams of 3 and 4 characters
are taken within and at the ends of words.

The filters are fitted on training rows (crc32 of the id mod 5 not 0, language not null): of each language
about `train_rows` rows at most, those with a small hash, and at most about `ngrams` n-grams, its most frequent.

Edge cases: null texts and texts without a letter are `und` with score 0; letters of which no filter knows an
n-gram give the language with most training rows (ties by name) with score 0, as does a table with one language
only, unless its filter knows the text; without training rows every text is `und`; very long texts are read
whole, in pieces of `PIECE` characters whose counts add up; ties go to the language with more training rows, then by name;
repeated rows are predicted each; null ids are not held out and not learnt from; an empty table gives an empty result; only id, text and language columns
are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupsight.llm.common import BROADCAST_ROWS, prepare, training_row
from groupsight.sources.store import cut, scratch

SIZES = (3, 4)
HASHES = 4
#: Filter bits for each n-gram of a full filter.
BITS = 10
TRAIN_ROWS = 5_000
NGRAMS = 50_000
#: A language owns an n-gram if it uses it at least this share as often as the language that uses it most.
SHARE = 0.25
#: Characters of a text that are looked up at a time.
PIECE = 1 << 20
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_of(text: str | None) -> str:
    """The words of a text, lower-cased, with a space on either side of each; empty without letters."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} " if text and _LETTER.search(text) else ""


def ngram_keys(line: str) -> np.ndarray:
    """A 64-bit key for each n-gram of a line; n-grams that reach over a space are left out."""
    a = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    inner, out = a == 32, []
    for n in SIZES:
        if len(a) < n:
            break
        key = np.full(len(a) - n + 1, n, np.uint64)
        for i in range(n):
            key = (key ^ a[i : len(a) - n + 1 + i]) * _MIX
            key ^= key >> np.uint64(29)
        apart = np.zeros(len(key), bool)
        for i in range(1, n - 1):
            apart |= inner[i : len(key) + i]
        out.append(key[~apart])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def pieces_of(line: str) -> Iterator[str]:
    """A line cut at spaces into pieces of about PIECE characters, each with a space on either side; words of more than that stay whole."""
    at = 0
    while at < len(line) - 1:
        end = line.find(" ", min(at + PIECE, len(line) - 1))
        yield line[at : end + 1]
        at = end


def positions(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """The HASHES filter positions of each key; size is a power of two."""
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def _position(key: Column, i: int, size: int) -> Column:
    """positions() as a column expression."""
    low = key.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1).cast("long"))
    return (low + i * high).bitwiseAND(F.lit(size - 1).cast("long"))


class Filters:
    """Bit-sliced filters: languages (most training rows first), a row of masks per position, the chance of a false yes per language."""

    def __init__(self, languages: list[str], rows: np.ndarray):
        self.languages, self.rows = languages, rows
        set_ = np.unpackbits(rows, axis=1, bitorder="little")[:, : len(languages)].mean(axis=0) if len(rows) else np.zeros(len(languages))
        self.false_yes = np.minimum(set_**HASHES, 0.999)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """Of each key the languages that contain it, a bit each."""
        at = positions(keys, len(self.rows))
        out = self.rows[at[0]]
        for p in at[1:]:
            out &= self.rows[p]
        return out

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of a text's n-grams, and of those in each language's filter."""
        n, found = 0, np.zeros(len(self.languages), np.int64)
        for piece in pieces_of(line_of(text)):
            keys = ngram_keys(piece)
            n += len(keys)
            # slices: a bit string per language, counted by its set bits
            bits = np.unpackbits(self.masks(keys), axis=1, bitorder="little")[:, : len(self.languages)]
            found += np.bitwise_count(np.packbits(bits, axis=0)).sum(axis=0, dtype=np.int64)
        return n, found

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language, and how far it leads: its share of the two best languages' corrected counts (two equal ones 0.5)."""
        n, found = self.counts(text) if self.languages else (0, None)
        if not n:
            return ("und", 0.0) if not self.languages or not line_of(text) else (self.languages[0], 0.0)
        true = np.clip((found - n * self.false_yes) / (1 - self.false_yes), 0, n)
        best = int(true.argmax())
        if true[best] <= 0:
            return self.languages[0], 0.0
        rest = float(np.delete(true, best).max(initial=0.0))
        return self.languages[best], float(true[best] / (true[best] + rest))


def ngram_counts(rows: DataFrame) -> DataFrame:
    """(lang, key, n): uses of each n-gram in rows (lang number, t)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lang, texts in pdf.groupby("lang").t:
                found = [ngram_keys(piece) for t in texts for piece in pieces_of(line_of(t))]
                key, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
                yield pd.DataFrame({"lang": np.int32(lang), "key": key.view(np.int64), "n": n.astype(np.int64)})

    return rows.mapInPandas(run, "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, ngrams: int = NGRAMS, share: float = SHARE, least_uses: int = 2) -> Filters:
    """Filters from rows (id, t, lang); n-grams used fewer than least_uses times in a language are left out."""
    spark = docs.sparkSession
    known = docs.where(training_row(F.col("id")) & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").collect()  # a row per language
    languages = [r.lang for r in sizes]
    if not languages:
        return Filters([], np.zeros((0, 1), np.uint8))
    with scratch(spark):
        chance = spark.createDataFrame([(r.lang, k, min(1.0, train_rows / r.rows)) for k, r in enumerate(sizes)], "lang string, k int, chance double")
        few = F.broadcast(chance) if len(sizes) <= BROADCAST_ROWS else chance
        drawn = F.pmod(F.xxhash64("id", "t"), F.lit(1 << 30)) < F.col("chance") * (1 << 30)
        rows = known.join(few, "lang").where(drawn).select(F.col("k").alias("lang"), "t")
        used = cut(ngram_counts(rows).where(F.col("n") >= least_uses), "ngrams")
        total = used.groupBy("lang").agg(F.sum("n").alias("total"))
        rate = used.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
        most = rate.groupBy("key").agg(F.max("rate").alias("most"))
        own = cut(rate.join(most, "key").where(F.col("rate") >= share * F.col("most")).select("lang", "key", "n"), "own_ngrams")
        # each language's frequent n-grams: the least count that leaves at most ngrams of them
        by_count = own.groupBy("lang", "n").agg(F.count("*").alias("m")).toPandas()  # a row per language and count
        least = []
        for k, g in by_count.sort_values("n", ascending=False).groupby("lang"):
            fits = g.n[g.m.cumsum() <= ngrams]
            least.append((int(k), int(fits.iloc[-1]) if len(fits) else int(g.n.max()) + 1))
        size = 1 << max(10, int(np.ceil(np.log2(BITS * ngrams))))
        kept = own.join(F.broadcast(spark.createDataFrame(least, "lang int, least long")), "lang").where("n >= least")
        bits = kept.select("lang", F.explode(F.array(*[_position(F.col("key"), i, size) for i in range(HASHES)])).alias("at"))
        one = F.pow(F.lit(2), F.col("lang") % 8).cast("int")
        slices = bits.groupBy("at", F.floor(F.col("lang") / 8).cast("int").alias("byte")).agg(F.bit_or(one).alias("mask"))
        table = slices.toPandas()  # filter positions times bytes of languages at most
    rows = np.zeros((size, (len(languages) + 7) // 8), np.uint8)
    rows[table["at"].to_numpy(np.int64), table["byte"].to_numpy(np.int64)] = table["mask"].to_numpy(np.uint8)
    return Filters(languages, rows)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(id, held_out, lang_pred, score) for every document; options of fit()."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    sent = spark.sparkContext.broadcast(fit(source, **options))

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([sent.value.predict(t) for t in s], columns=["lang_pred", "score"]).astype({"lang_pred": "str", "score": "float64"})

    out = source.select("id", F.coalesce(~training_row(F.col("id")), F.lit(False)).alias("held_out"), run("t").alias("p"))
    return out.select("id", "held_out", "p.*")


def op11_language(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
