"""Near copies by exact Jaccard similarity of word shingles, with MinHash candidates.

Operator 1's rule for word shingles, "similarity of 0.8 or more", is about 10 of 64 differing bits, which
multi-index hashing of SimHash fingerprints cannot search alone within the limits (README has the figures).
So operator 1 comes first: its fingerprints of the same `shingle`-word runs and its links within `radius` bits, each verified on
the sets. MinHash bands then give the candidates whose fingerprints lie farther apart.

Two documents are linked if their sets of `shingle`-word runs have a Jaccard similarity of at least
`threshold`. Documents with equal sets are one entry. An entry of two shingles or more has `bands`
keys of `rows` minima; entries that share a key are candidates (at similarity 0.8, with 24 bands of
4 rows, a pair is missed with a chance of (1 - 0.8^4)^24 = 3e-6), and every candidate pair is
verified on the sets themselves before it is linked.

First, each entry is compared with one entry of each of its keys, that which shares the most
keys; that is the middle of a group of copies, so it joins most groups with a link per entry. Keys
whose entries are one component by then are done. In the others, the strays that the middle did not reach
meet the key's other entries, in pairs that share two keys (at similarity 0.8, 6e-5 do not). Keys with
over `HOT_PAIRS` such pairs make no pairs: those with a middle of one component are one bundle, and a
bundle's strays and entries are dealt into cells of bounded size that give spanning links, so
links stay linear and components exact. A bundle of over `BUNDLE_PAIRS` (a passage that very many documents
share) is first dealt anew by `bands` further keys of `rows` minima.

Words are runs of other than ASCII white space, lower-cased. Edge cases: null, empty and blank texts
have the empty set and are copies of each other; fewer than `shingle` words make one shingle; repeated
rows give a row each; a null id comes after all others; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupsight.llm import op1_simhash
from groupsight.llm.common import components, prepare, sized, with_row
from groupsight.llm.op7_decontaminate import _halves, _permuted, permutation_seeds, shingle_hashes
from groupsight.sources.store import cut

HOT_PAIRS = 1024
BUNDLE_PAIRS = 1 << 26
CELL = 512


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(shingle_hashes(words, shingle))


def _name(x: np.ndarray) -> int:
    """The entry of a set, a signed 64-bit number."""
    return int(np.array([xxhash.xxh3_64_intdigest(x.tobytes())], np.uint64).view(np.int64)[0])


def band_keys(sets: list[np.ndarray], bands: int, rows: int, first: int = 0) -> list[np.ndarray]:
    """The keys of each set, from band number `first` on; none for sets of fewer than two, which only an equal set is like."""
    keys = [np.empty(0, np.int64)] * len(sets)
    some = [k for k, x in enumerate(sets) if len(x) > 1]
    if not some:
        return keys
    low, high = _halves(np.concatenate([sets[k] for k in some]))
    starts = np.cumsum([0] + [len(sets[k]) for k in some[:-1]])
    seeds = permutation_seeds((first + bands) * rows).reshape(-1, rows)[first:]
    out = np.empty((len(some), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(some), b + 1, np.uint64)
        for seed in seeds[b]:
            h ^= np.minimum.reduceat(_permuted(low, high, seed), starts)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, b] = h
    for k, x in zip(some, out.view(np.int64), strict=True):
        keys[k] = x
    return keys


def _link_cell(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links among a cell's probes and table entries whose similarity reaches the threshold, one for each two components that meet."""
    t, p, a, b = pdf[~pdf.probe], pdf[pdf.probe], [], []
    if t.empty or p.empty:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    name, sets = t.entry.to_numpy(np.int64), [np.asarray(x, np.int64) for x in t["set"]]
    sizes = np.array([len(x) for x in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    label = np.unique(np.concatenate([t.root, p.root]), return_inverse=True)[1]
    of_t, of_p = label[: len(t)], label[len(t) :]
    for k, (entry, x) in enumerate(zip(p.entry, p["set"], strict=True)):
        left, right = (np.searchsorted(values, np.asarray(x, np.int64), side) for side in ("left", "right"))
        n = right - left
        at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        hit = np.flatnonzero((shared >= threshold * (sizes + len(x) - shared) - 1e-9) & (of_t != of_p[k]))
        for y, first in zip(*np.unique(of_t[hit], return_index=True), strict=True):
            a.append(entry)
            b.append(name[hit[first]])
            of_t[of_t == y] = of_p[k]
            of_p[of_p == y] = of_p[k]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    return met.where(F.col("shared") >= threshold * (F.size("x") + F.size("y") - F.col("shared")) - 1e-9).select("a", "b")


def _candidates(entries: DataFrame) -> DataFrame:
    """(key, entry, middle) of the keys that two entries or more share."""
    table = entries.select("entry", F.explode("keys").alias("key"))
    shared = sized(table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared_keys")
    table = cut(table.join(shared, "key"), "shared")
    company = sized(table.groupBy("entry").agg(F.struct(F.count("*").alias("keys"), F.sum("n").alias("n")).alias("company")), "company")
    middle = table.join(company, "entry").groupBy("key").agg(F.max(F.struct("company", "entry")).getField("entry").alias("middle"))
    return cut(table.select("key", "entry").join(sized(middle, "middles"), "key"), "candidates")


def _simhash_pairs(entries: DataFrame, fp: str, radius: int) -> DataFrame:
    """(a, b): entries whose fingerprints operator 1 links within radius bits; entries of one fingerprint are paired with its least entry."""
    named = entries.groupBy(fp).agg(F.min("entry").alias("least"), F.count("*").alias("n"))
    named = cut(named.withColumnRenamed(fp, "fp"), "fingerprints")
    ends = sized(named.select("fp", "least"), "fingerprint_entries")
    links = cut(op1_simhash.links(named.select("fp"), radius), "simhash_links")
    far = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select("x", "y")
    same = entries.select(F.col(fp).alias("fp"), F.col("entry").alias("x")).join(sized(named.where("n > 1").select("fp", F.col("least").alias("y")), "shared_fingerprints"), "fp").where("x <> y").select("x", "y")
    return far.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _open_keys(table: DataFrame, found: DataFrame) -> DataFrame:
    """(key, bundle, entry, root, stray, pairs) of the keys whose entries stand in two components or more; pairs: of strays and entries."""
    found = sized(found.toDF("entry", "root"), "roots")
    rooted = table.join(found, "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    rooted = rooted.join(found.toDF("middle", "bundle"), "middle", "left").withColumn("bundle", F.coalesce("bundle", "middle"))
    return _with_pairs(cut(rooted.select("key", "bundle", "entry", "root", (F.col("root") != F.col("bundle")).alias("stray")), "rooted_keys"))


def _with_pairs(rows: DataFrame) -> DataFrame:
    """rows (key, entry, root, stray, ...) of the keys that have both strays and other components, with the number of pairs to compare."""
    counts = rows.groupBy("key").agg((F.count_if("stray") * F.count("*")).alias("pairs"), F.min("root").alias("low"), F.max("root").alias("high"))
    counts = sized(counts.where("low < high AND pairs > 0").select("key", "pairs"), "open_keys")
    return cut(rows.join(counts, "key"), "open")


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of strays and entries of other components that share two keys."""
    left = rows.where("stray").select("key", F.col("entry").alias("a"), F.col("root").alias("ra"))
    right = rows.select("key", F.col("entry").alias("b"), F.col("root").alias("rb"))
    met = left.join(right, "key").where("ra <> rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key")
    # two strays meet from both sides
    return met.groupBy("a", "b").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("a", "b")


def _in_cells(hot: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Spanning links of each key's strays and its entries, from rows (key, entry, root, stray)."""
    sizes = sized(hot.groupBy("key").agg(F.ceil(F.count_if("stray") / CELL).cast("int").alias("m"), F.ceil(F.count("*") / CELL).cast("int").alias("n")), "cell_sides")
    hot = hot.join(sizes, "key").join(sets, "entry")
    mine = lambda side: F.pmod(F.xxhash64("entry"), F.col(side)).cast("int")
    others = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    row = lambda df, probe, p, t: df.select("key", "entry", "root", "set", F.lit(probe).alias("probe"), p.alias("pb"), t.alias("tb"))
    cells = row(hot.where("stray"), True, mine("m"), others("n")).union(row(hot, False, others("m"), mine("n")))
    return cells.groupBy("key", "pb", "tb").applyInPandas(lambda pdf: _link_cell(pdf, threshold), "a long, b long")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4, radius: int = 4,
    row_col: str | None = None,
) -> DataFrame:
    """(row, id, component_id, first_row): every document with the smallest id of its component.

    row_col: a whole number that is different in each row and the same each time docs is read; first_row is that of
    the component's row with the smallest id, then the smallest row.
    """
    prepare(docs.sparkSession)
    if row_col is None:
        docs, row_col = with_row(docs)
    source = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))

    @F.pandas_udf("entry long, keys array<long>, fp long")
    def keyed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            sets = [shingle_set(x, shingle) for x in s]
            fps = np.array([op1_simhash.simhash(x, shingle) for x in s], np.int64)
            yield pd.DataFrame({"entry": np.array([_name(x) for x in sets], np.int64), "keys": band_keys(sets, bands, rows), "fp": fps})

    @F.pandas_udf("array<long>")
    def set_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([shingle_set(x, shingle).view(np.int64) for x in s])

    @F.pandas_udf("array<long>")
    def further_keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(band_keys([np.asarray(x, np.int64).view(np.uint64) for x in s], bands, rows, bands))

    one = cut(source.select("row", "id", keyed("t").alias("x")).select("row", "id", "x.*"), "entries")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    least = cut(one.groupBy("entry").agg(first, F.first("keys").alias("keys"), F.min("fp").alias("fp")), "first_rows")
    table = _candidates(least)

    def sets_of(entries: DataFrame) -> DataFrame:
        wanted = least.join(entries.distinct(), "entry", "left_semi").select("entry", F.col("first.row").alias("row"))
        return cut(source.select("row", "t").join(sized(wanted, "wanted_rows"), "row").select("entry", set_of("t").alias("set")), "sets")

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("entry"))
    stars = table.where("entry <> middle").groupBy(F.col("entry").alias("a"), F.col("middle").alias("b")).agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    stars = cut(stars.union(_simhash_pairs(least, "fp", radius)).distinct(), "stars")
    stars = cut(_verified(stars, sets_of(ends(stars)), threshold), "star_links")
    left = _open_keys(table, components(stars))

    few = F.col("pairs") <= HOT_PAIRS
    pairs = cut(_pairs(left.where(few)), "stray_pairs")
    bundles = left.where(~few).groupBy(F.col("bundle").alias("key"), "entry").agg(F.first("root").alias("root"), F.first("stray").alias("stray"))
    bundles = _with_pairs(cut(bundles, "bundles"))
    sets = sets_of(ends(pairs).union(bundles.select("entry")))
    huge = bundles.where(F.col("pairs") > BUNDLE_PAIRS).join(sets, "entry").select("key", "entry", "root", "stray", further_keys("set").alias("more"))
    huge = huge.select("key", "entry", "root", "stray", F.explode("more").alias("more")).withColumn("key", F.xxhash64("key", "more")).drop("more")
    hot = bundles.where(F.col("pairs") <= BUNDLE_PAIRS).union(_with_pairs(cut(huge, "dealt_anew"))).drop("pairs")
    rest = cut(_verified(pairs, sets, threshold).union(_in_cells(hot, sets, threshold)), "further_links")

    found = components(stars.union(rest))
    named = cut(least.select("entry", "first").join(found.withColumnRenamed("node", "entry"), "entry", "left").withColumn("root", F.coalesce("root", "entry")), "rooted")
    per_root = sized(named.groupBy("root").agg(F.min("first").alias("least")), "component_ids")
    named = sized(named.join(per_root, "root").select("entry", "least"), "entry_components")
    return one.join(named, "entry").select("row", "id", F.col("least.id").alias("component_id"), F.col("least.row").alias("first_row"))
