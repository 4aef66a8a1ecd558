"""Language-model scores: a unigram base by exact corpus counts, and a causal self-attention model on subword ids.

Base. Words of the lower-cased text and one end token per document are counted over all training
documents. Frequent words (found in a hashed sample, at most `HEAVY`) are counted and scored in
place by a broadcast table; every other word goes, once per document, through one shuffle by its
64-bit hash that counts it and returns its share to its documents. Which words are frequent
changes the work only, never a count.

Model. Words become subword ids. A subword's symbol is itself for the most frequent ones, else one of
`GROUPS` groups of like frequency; log P(id) = log P(symbol | context) + log P(id | symbol). The symbol before is
the query; the keys are the `REACH` symbols before the token, and a key's value is a distribution over the next
symbol: that which follows the two symbols at the nearest place (the `PAIRS` most frequent pairs, else the one
symbol), that which follows the key at its distance at the others. Attention weights are a masked softmax of a
query-key matrix and a bias by distance, and the output is the values' weighted mean, so it is a distribution.

Values are counted over every token of all training documents. The query-key matrix and the bias are
trained on all of them too, each in one of `rounds` rounds: numpy tasks sum what the attention gave each
query and key and what it ought to have given (the posterior, with the token itself left out of
the values' counts), and a round moves the logits by the log ratio of both. Only sums leave the tasks, so
scores do not depend on how rows are partitioned. Windows of `BLOCK` tokens overlap by `REACH` tokens of context: each
token is scored once, and a whole batch of windows at a time.

Edge cases: null text is empty; an empty document is its end token alone; a null id counts as held
out; without training documents counts are zero and the model is uniform; repeated
rows are counted and scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupsight.llm.common import prepare
from groupsight.llm.op3_packing import RANKS, TOKENIZER, chunks_of
from groupsight.sources.store import cut

VOCABULARY = 50_257
END = 50_256
HEAVY = 65_000
SYMBOLS, GROUPS = 1024, 64
PAD = SYMBOLS
WIDTH = SYMBOLS + 1
PAIRS = 6_000
QUERIES = 128
REACH, BLOCK = 6, 250
#: Distances whose values are counted apart; longer ones share the last table.
FAR = 2
KNOWN_WORDS = 250_000
SAMPLE_SHARE = 64
#: Splits of the input that one counting task takes at most, where there are more than cores.
SPLITS = 32
#: Windows that are scored at a time.
STEP = 200
#: Rows of a table of shares that are made at a time.
STRIP = 256
#: Cells of sums in an Arrow batch that leaves a task.
CELLS_SENT = 100_000


class Symbols:
    """Symbol of each subword and log10 P(subword | symbol), from the subwords' counts."""

    def __init__(self, ids: np.ndarray):
        ranked = np.argsort(-ids, kind="stable")
        ranked = np.concatenate([[END], ranked[ranked != END]])
        singles = SYMBOLS - GROUPS
        self.of = np.empty(VOCABULARY, np.int64)
        self.of[ranked[:singles]] = np.arange(singles)
        share = np.cumsum(ids[ranked[singles:]] + 1)
        self.of[ranked[singles:]] = singles + np.minimum(GROUPS - 1, share * GROUPS // (share[-1] + 1))
        self.log_within = np.log10((ids + 1) / np.bincount(self.of, ids + 1, SYMBOLS)[self.of])


def windows_of(docs: list[np.ndarray], symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Windows of REACH + BLOCK symbols that overlap by REACH, and where each document starts in the targets' line.

    A document is padding, END, its symbols and END; padding is masked, so nothing reaches across documents.
    """
    sizes = np.array([len(x) + REACH + 2 for x in docs], np.int64)
    ends = np.cumsum(sizes)
    total = -(-int(ends[-1]) // BLOCK) * BLOCK
    line = np.full(REACH + total, PAD, np.int64)
    for x, stop in zip(docs, ends.tolist(), strict=True):
        line[stop - len(x) - 2 + REACH] = line[stop - 1 + REACH] = symbols.of[END]
        line[stop - len(x) - 1 + REACH : stop - 1 + REACH] = symbols.of[x]
    return np.lib.stride_tricks.sliding_window_view(line, REACH + BLOCK)[::BLOCK], ends - sizes


class Cells(NamedTuple):
    """The non-zero cells of a table of counts, in ascending order."""

    shape: tuple[int, ...]
    at: np.ndarray
    n: np.ndarray


def cells_of(table: np.ndarray) -> Cells:
    at = np.flatnonzero(table)
    return Cells(table.shape, at, table.ravel()[at])


class Values:
    """Distributions over the next symbol: after the two symbols before (near), and after one symbol at each distance (far).

    less 1: what the counts say of a token that is not counted itself, for training.
    """

    def __init__(self, place: np.ndarray, near: Cells, far: Cells, less: int = 0):
        """place: row of near for each pair of symbols; near and far: counts."""
        self.place = place
        size = WIDTH * SYMBOLS
        tables = [Cells((WIDTH, SYMBOLS), far.at[k] - j * size, far.n[k]) for j in range(FAR) for k in [far.at // size == j]]
        share = np.bincount(tables[0].at % SYMBOLS, tables[0].n, SYMBOLS) + 1
        share = (share / share.sum()).astype(np.float32)[None, :]
        none, last = np.zeros(WIDTH, np.int64), np.zeros(near.shape[0], np.int64)
        last[place] = np.arange(WIDTH * WIDTH) % WIDTH
        self.near = smoothed(near, smoothed(tables[0], share, none, 5.0, less), last, 20.0, less).ravel()
        self.far = [smoothed(x, share, none, 80.0, less).ravel() for x in tables]


class Counts:
    """What values are made of. It travels as its non-zero cells; a worker makes the tables of one kind at a time."""

    def __init__(self, pairs: np.ndarray, near: Cells, far: Cells):
        """pairs: the pairs (a, b) with rows of their own in near, as a * WIDTH + b."""
        # places in a table fit 32 bits
        pack = lambda x: (x.shape, *(zlib.compress(y.tobytes(), 1) for y in (np.diff(x.at, prepend=0).astype("<i4"), x.n.astype("<i8"))))
        self.pairs, self.packed, self.made = pairs, (pack(near), pack(far)), {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": {}}

    def cells(self) -> list[Cells]:
        """near and far."""
        number = lambda x, kind: np.frombuffer(zlib.decompress(x), kind)
        return [Cells(shape, np.cumsum(number(gaps, "<i4"), dtype=np.int32), number(n, "<i8")) for shape, gaps, n in self.packed]

    def values(self, less: int = 0) -> Values:
        if less not in self.made:
            self.made.clear()
            place = np.tile(np.arange(WIDTH, dtype=np.int32), WIDTH)
            place[self.pairs] = WIDTH + np.arange(len(self.pairs))
            self.made[less] = Values(place, *self.cells(), less)
        return self.made[less]


def smoothed(counts: Cells, prior: np.ndarray, prior_row: np.ndarray, strength: float, less: int) -> np.ndarray:
    """Shares of counts (each less `less`, 0 at least), drawn to a row of the prior as by `strength` more tokens."""
    rows, width = counts.shape
    out = np.zeros(rows * width, np.float32)
    by_row = out.reshape(rows, width)
    # a few rows at a time: what is made on the way is small beside the table
    for k in range(0, rows, STRIP):
        part = by_row[k : k + STRIP]
        a, b = np.searchsorted(counts.at, (k * width, (k + STRIP) * width))
        at, n = counts.at[a:b] - k * width, counts.n[a:b]
        total = np.maximum(np.bincount(at // width, n, len(part)) - less, 0) + strength
        part.ravel()[at] = np.maximum(n - less, 0)
        part += prior[prior_row[k : k + STRIP]] * np.float32(strength)
        part /= total[:, None].astype(np.float32)
    return by_row


class Attention:
    """Logits of the query-key matrix and of distances; rows of queries are the most frequent symbols, others in buckets."""

    def __init__(self):
        self.logits = np.zeros((QUERIES, WIDTH))
        self.bias = -0.7 * np.log(np.arange(1, REACH + 1)) - (np.arange(REACH) > 0)
        self.bias[0] = 1.0

    def move(self, wanted: np.ndarray, given: np.ndarray, strength: float = 10.0) -> None:
        """One step: wanted and given are the attention's sums by query and key, then by distance."""
        cells = QUERIES * WIDTH
        step = np.log((wanted[:cells] + strength) / (given[:cells] + strength)).reshape(QUERIES, WIDTH)
        self.logits += np.clip(step, -2, 2)
        self.bias += np.log((wanted[cells:] + strength) / (given[cells:] + strength))


def query_rows() -> np.ndarray:
    own = QUERIES - 16
    at = np.arange(WIDTH)
    return np.where(at < own, at, own + at % 16) * WIDTH


class Reader:
    """Attends over batches of windows."""

    def __init__(self, attention: Attention, values: Values):
        e = np.exp(attention.logits)
        e[:, PAD] = 0
        self.e, self.distance = e.astype(np.float32).ravel(), np.exp(attention.bias).astype(np.float32)
        self.values, self.query_row = values, query_rows()

    def __call__(self, windows: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """log10 P(symbol) of each target, 0 at padding; sums (wanted, given) are added to."""
        target, query = windows[:, REACH:], windows[:, REACH - 1 : -1]
        void = (target == PAD) | (query == PAD)
        y, row, v = np.where(void, 0, target), self.query_row[query], self.values
        key = lambda j: windows[:, REACH - j : windows.shape[1] - j]
        cells, weights, parts = [], [], []
        for j in range(1, REACH + 1):
            at = row + key(j)
            w = self.e[at]
            w *= self.distance[j - 1]
            if j == 1:
                p = v.near[v.place[key(2) * WIDTH + key(1)] * np.int64(SYMBOLS) + y]
            else:
                p = v.far[min(j, FAR) - 1][key(j) * SYMBOLS + y]
            p *= w
            cells.append(at)
            weights.append(w)
            parts.append(p)
        total, met = sum(weights), sum(parts)
        total[void] = met[void] = 1
        if sums is not None:
            real = (~void).astype(np.float32)
            by_total, by_met = real / total, real / met
            at, n = np.concatenate([c.ravel() for c in cells]), QUERIES * WIDTH
            for out, xs, scale in ((sums[0], parts, by_met), (sums[1], weights, by_total)):
                shares = [(x * scale).ravel() for x in xs]
                out[:n] += np.bincount(at, np.concatenate(shares), n)
                out[n:] += [x.sum(dtype=np.float64) for x in shares]
        return np.log10(met / total)


def read_all(reader: Reader, windows: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """The reader's results for any number of windows, as one line."""
    out = [reader(windows[at : at + STEP], sums).ravel() for at in range(0, len(windows), STEP)]
    return np.concatenate(out) if out else np.empty(0, np.float32)


def score_documents(docs: list[np.ndarray], reader: Reader, symbols: Symbols) -> list[float]:
    """log10 probability of each document's subwords and end."""
    if not docs:
        return []
    windows, starts = windows_of(docs, symbols)
    by_symbol = np.add.reduceat(read_all(reader, windows).astype(np.float64), starts)
    within = [float(symbols.log_within[x].sum()) for x in docs]
    return (by_symbol + within + symbols.log_within[END]).tolist()


def _frequent_words(docs: DataFrame) -> list[bytes]:
    """Frequent words, from the training documents whose id hashes to 0 mod SAMPLE_SHARE; they only save work."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Counter()
        for pdf in parts:
            for t in pdf.t:
                words.update((t or "").encode("utf-8", "surrogatepass").lower().split())
        yield pd.DataFrame({"word": list(words), "n": list(words.values())})

    rows = docs.where("NOT held").where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_SHARE)) == 0).select("t").mapInPandas(run, "word binary, n long")
    words = rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(HEAVY)
    return [bytes(r.word) for r in words.collect()]  # HEAVY at most


class Words(dict):
    """Slots of the words met so far, with each slot's subword ids, place among the frequent words (or -1) and hash."""

    def __init__(self, encode, place: dict[bytes, int]):
        super().__init__()
        self.encode, self.frequent = encode, place
        # the ids of slot k are ids[start[k]:start[k + 1]]
        self.ids, self.start, self.place, self.hash = array("H"), array("q", [0]), array("i"), array("Q")

    def _add(self, word: bytes, ids: list[int]) -> int:
        slot = self[word] = len(self.place)
        place = self.frequent.get(word, -1)
        self.ids.extend(ids)
        self.start.append(len(self.ids))
        self.place.append(place)
        self.hash.append(xxhash.xxh64_intdigest(word) if place < 0 else 0)
        return slot

    def __missing__(self, word: bytes) -> int:
        return self._add(word, self.encode(" " + word.decode("utf-8", "surrogatepass")))

    def trim(self) -> None:
        """Forget all but the frequent words."""
        kept = [(w, self.ids[self.start[k] : self.start[k + 1]]) for w, k in self.items() if self.place[k] >= 0]
        self.clear()
        self.ids, self.start, self.place, self.hash = array("H"), array("q", [0]), array("i"), array("Q")
        for word, ids in kept:
            self._add(word, ids)

    def encoded(self, text: str | None) -> tuple[int, bytes, bytes, bytes]:
        """Words, subword ids, frequent words' places and other words' hashes of a text."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return 0, b"", b"", b""
        if len(self) > KNOWN_WORDS:
            self.trim()
        slots = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        view = lambda x, kind: np.frombuffer(x, kind)  # noqa: E731  of arrays that do not grow meanwhile
        start = view(self.start, np.int64)
        first = start[slots]
        n = start[slots + 1] - first
        before = np.cumsum(n) - n
        ids = view(self.ids, np.uint16)[np.repeat(first - before, n) + np.arange(int(n.sum()))]
        place = view(self.place, np.int32)[slots]
        tail = place < 0
        return len(words), ids.astype("<u2").tobytes(), place[~tail].astype("<u2").tobytes(), view(self.hash, np.uint64)[slots[tail]].tobytes()


#: A worker's words, by the encoding they belong to.
_WORDS: dict[str, Words] = {}


def _words(name: str, heavy, files: tuple[str, str]) -> Words:
    """The worker's table of words, kept from task to task of one encoding."""
    if name not in _WORDS:
        _WORDS.clear()
        _WORDS[name] = Words(chunks_of(*files).encode, heavy.value)
    return _WORDS[name]


def _forget_words() -> None:
    """A worker that goes on to count or score gives the memory of its words back."""
    _WORDS.clear()
    chunks_of.cache_clear()


def _encoded(docs: DataFrame, heavy, files: tuple[str, str]) -> DataFrame:
    """(row, id, held, n, ids, heavy, tail): subword ids, frequent words' places and other words' hashes of each document."""
    name = uuid.uuid4().hex

    @F.pandas_udf("n long, ids binary, heavy binary, tail binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _words(name, heavy, files)
        for s in parts:
            n, ids, place, tail = zip(*map(words.encoded, s), strict=True) if len(s) else ((), (), (), ())
            yield pd.DataFrame({"n": np.array(n, np.int64) + 1, "ids": ids, "heavy": place, "tail": tail})

    return docs.select(F.monotonically_increasing_id().alias("row"), "id", "held", run("t").alias("x")).select("row", "id", "held", "x.*")


def _summed(rows: DataFrame, size: int, add, columns: int = 1, kind: str = "long"):
    """Sums over all rows of what add(table, batch) puts into a (columns, size) table; tasks send their non-zero cells only.

    The result holds a row per cell at most, whatever the input.
    """
    names = [f"n{c}" for c in range(columns)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _forget_words()
        table = np.zeros((columns, size), np.int64 if kind == "long" else np.float64)
        for pdf in parts:
            add(table, pdf)
        for k in range(0, size, CELLS_SENT):
            part = table[:, k : k + CELLS_SENT]
            at = np.flatnonzero(part.any(axis=0))
            yield pd.DataFrame({"k": at + k} | {name: part[c, at] for c, name in enumerate(names)})

    # a task sends up to the table's cells, so it takes several splits; it takes few enough to be run again at a small cost
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // SPLITS)
    cells = rows.coalesce(tasks).mapInPandas(run, "k long, " + ", ".join(f"{n} {kind}" for n in names))
    return cells.groupBy("k").agg(*[F.sum(n).alias(n) for n in names]).toArrow()


def count(table: np.ndarray, cells: np.ndarray) -> None:
    """Add one to the table's cell for each of cells; what is made on the way is of the size of cells, not of the table."""
    at, n = np.unique(cells, return_counts=True)
    table[at] += n


def _table(found, size: int, columns: int = 1) -> np.ndarray:
    """The cells of _summed() as a (columns, size) table."""
    out = np.zeros((columns, size), found["n0"].to_numpy().dtype)
    for c in range(columns):
        out[c, found["k"].to_numpy()] = found[f"n{c}"].to_numpy()
    return out


def _as_cells(found, shape: tuple[int, ...]) -> Cells:
    order = np.argsort(found["k"].to_numpy())
    return Cells(shape, found["k"].to_numpy()[order], found["n0"].to_numpy()[order])


def _lists(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column]


def _corpus_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of frequent words, of subwords; tokens and documents."""
    ends = np.cumsum([HEAVY, VOCABULARY])

    def add(table: np.ndarray, pdf: pd.DataFrame) -> None:
        words, ids, total = np.split(table[0], ends)
        words += np.bincount(np.frombuffer(b"".join(pdf.heavy), "<u2"), minlength=HEAVY)
        ids += np.bincount(np.frombuffer(b"".join(pdf.ids), "<u2"), minlength=VOCABULARY)
        total += int(pdf.n.sum()), len(pdf)

    size = int(ends[-1]) + 2
    words, ids, total = np.split(_table(_summed(train.select("n", "ids", "heavy"), size, add), size)[0], ends)
    ids[END] += total[1]
    return words, ids, int(total[0]), int(total[1])


def _values_counted(train: DataFrame, symbols: Symbols) -> Counts:
    """Counts of the symbol after each pair of symbols or symbol, and after a symbol at each distance."""
    cells = WIDTH * SYMBOLS
    sent = train.sparkSession.sparkContext.broadcast(symbols)

    def targets(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Places of targets in the line of windows, and that line."""
        windows, _ = windows_of(_lists(pdf.ids), sent.value)
        line = np.concatenate([windows[0, :REACH], windows[:, REACH:].ravel()])
        return np.flatnonzero((line[1:] != PAD) & (line[:-1] != PAD)) + 1, line

    def add_far(table: np.ndarray, pdf: pd.DataFrame) -> None:
        if len(pdf):
            at, line = targets(pdf)
            for j in range(1, REACH + 1):
                first = (min(j, FAR) - 1) * cells
                table[0, first : first + cells] += np.bincount(line[at - j] * SYMBOLS + line[at], minlength=cells)

    ids = train.select("ids")
    far = _as_cells(_summed(ids, FAR * cells, add_far), (FAR, WIDTH, SYMBOLS))
    real = far.at // SYMBOLS % WIDTH != PAD
    far = Cells(far.shape, far.at[real], far.n[real])
    before = far.at < cells
    top = far.at[before][np.argsort(-far.n[before], kind="stable")[:PAIRS]]
    # pair (a, b) stands at a * WIDTH + b; others fall back to the row of b
    place = np.tile(np.arange(WIDTH, dtype=np.int32), WIDTH)
    place[top // SYMBOLS * WIDTH + top % SYMBOLS] = WIDTH + np.arange(len(top))
    rows = WIDTH + len(top)
    sent_place = train.sparkSession.sparkContext.broadcast(place)

    def add_near(table: np.ndarray, pdf: pd.DataFrame) -> None:
        if len(pdf):
            at, line = targets(pdf)
            row = sent_place.value[line[at - 2] * WIDTH + line[at - 1]].astype(np.int64)
            count(table[0], row * SYMBOLS + line[at])

    near = _as_cells(_summed(ids, rows * SYMBOLS, add_near), (rows, SYMBOLS))
    return Counts(top // SYMBOLS * WIDTH + top % SYMBOLS, near, far)


def _trained(train: DataFrame, known, rounds: int) -> Attention:
    """Attention after one step per round; each training document is in one round."""
    sc, attention = train.sparkSession.sparkContext, Attention()
    pick = F.pmod(F.xxhash64("id", F.lit("round")), F.lit(rounds))
    for k in range(rounds):
        sent = sc.broadcast(attention)

        def add(table: np.ndarray, pdf: pd.DataFrame, sent=sent) -> None:
            if len(pdf):
                symbols, counts = known.value
                read_all(Reader(sent.value, counts.values(less=1)), windows_of(_lists(pdf.ids), symbols)[0], table)

        size = QUERIES * WIDTH + REACH
        attention.move(*_table(_summed(train.where(pick == k).select("ids"), size, add, 2, "double"), size, 2))
    return attention


def _tail_shares(encoded: DataFrame) -> DataFrame:
    """(row, tail_log, tail_known, new): sums over a document's less frequent words; new counts training words first seen here."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows, hashes, counts, held = [], [], [], []
            for row, raw, h in zip(pdf.row, pdf["tail"], pdf.held, strict=True):
                x, n = np.unique(np.frombuffer(raw, "<i8"), return_counts=True)
                hashes.append(x)
                counts.append(n)
                rows.append(np.full(len(x), row))
                held.append(np.full(len(x), h))
            if rows:
                yield pd.DataFrame({"h": np.concatenate(hashes), "row": np.concatenate(rows), "tf": np.concatenate(counts).astype(np.int32), "held": np.concatenate(held)})

    words = encoded.select("row", "held", "tail").mapInPandas(run, "h long, row long, tf int, held boolean")
    over = Window.partitionBy("h")
    learnt = F.when(F.col("held"), 0).otherwise(F.col("tf"))
    words = words.withColumn("c", F.sum(learnt).over(over)).withColumn("first", F.min("row").over(over))
    known = F.col("c") > 0
    return words.groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail_log"), F.sum(F.when(known, F.col("tf")).otherwise(0)).alias("tail_known"),
        F.count_if(known & (F.col("row") == F.col("first"))).alias("new"),
    )


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, rounds: int = 8) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per document; held_out: a Column on id_col."""
    spark = docs.sparkSession
    prepare(spark)
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2 if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(True)).alias("held"), F.col(text_col).alias("t"))
    files = public_tokenizers.path(RANKS), public_tokenizers.path(TOKENIZER)
    place = spark.sparkContext.broadcast({w: i for i, w in enumerate(_frequent_words(rows))})
    encoded = cut(_encoded(rows, place, files), "encoded")
    place.unpersist()
    train = encoded.where("NOT held")
    words, ids, tokens, ends = _corpus_counts(train)
    symbols = Symbols(ids)
    model = spark.sparkContext.broadcast((symbols, _values_counted(train, symbols)))
    attention = _trained(train, model, rounds)
    tail = cut(_tail_shares(encoded), "tail_shares")
    distinct = int(np.count_nonzero(words)) + (tail.agg(F.sum("new")).first()[0] or 0) + (ends > 0)
    sent = spark.sparkContext.broadcast((np.log10(words + 1), words > 0, attention))

    @F.pandas_udf("heavy_log double, heavy_known long, score double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        _forget_words()
        log_count, known, attention = sent.value
        symbols, counts = model.value
        reader = Reader(attention, counts.values())
        for heavy, ids in parts:
            at = _lists(heavy)
            yield pd.DataFrame({
                "heavy_log": [float(log_count[x].sum()) for x in at], "heavy_known": [int(known[x].sum()) for x in at],
                "score": score_documents(_lists(ids), reader, symbols),
            })

    out = encoded.select("row", "id", "held", "n", run("heavy", "ids").alias("x")).select("row", "id", "held", "n", "x.*").join(tail, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("heavy_log") + zero("tail_log") + F.log10(F.lit(ends + 1.0)) - F.col("n") * F.log10(F.lit(float(tokens + distinct + 1)))
    return out.select(
        "id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("heavy_known") + zero("tail_known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op10_attention_lm(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
