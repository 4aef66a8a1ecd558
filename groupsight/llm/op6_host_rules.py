"""Host-level quality rules.

Each document is tested against a few rules; failures are aggregated by host (the column that says
where a document comes from), the host's failure rate is shrunk towards all hosts' with a beta
prior fitted by moments over the hosts, and the host's verdict is joined back to its documents.

A document is kept if it passes its own rules and its host is not blocked. A host is blocked when
it has `min_docs` documents or more and its shrunken failure rate is over `max_host_rate`.

Edge cases: null or empty text has no words and fails; a null host is a host of its own; a table
with one host, or hosts without spread, gets the prior of strength one at the overall rate;
repeated rows count and come back each; an empty table gives an empty result; columns of the input
that clash with result columns are not carried by host_verdicts(); keep_documents() returns
the input's own columns and judges each row by itself, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupsight.llm.common import SPACE, fresh, prepare, sized
from groupsight.sources.store import cut

SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_shout_words long"


def text_stats(text: str | None) -> tuple[int, ...]:
    """Counts over a whole text, in the order of STATS."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else ([raw] if n else [])
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        k = len(ids)
        if k < n:
            triple = (at[:-2] * k + at[1:-1]) * k + at[2:] if k < 2_000_000 else _triples(at, k)
            order = np.argsort(triple, kind="stable")
            same = triple[order][1:] == triple[order][:-1]
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            for d in range(3):
                cover[d : n - 2 + d] |= twice
            repeat = int(cover.sum())
    shout = raw.count(b"!!")
    return n, chars, symbols, dup, len(lines), repeat, shout


def _triples(at: np.ndarray, k: int) -> np.ndarray:
    """Ids of windows of three words where the product of ids would overflow."""
    pair = np.unique(at[:-1] * k + at[1:], return_inverse=True)[1]
    return pair[:-1] * k + at[2:]


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    prepare(docs.sparkSession)

    @F.pandas_udf(STATS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STATS.split(", ")]
        for s in parts:
            yield pd.DataFrame([text_stats(x) for x in s], columns=names, dtype="int64")

    return docs.withColumn("_stats", run(F.col(text_col)))


def fitted_prior(docs: int | None, failed: int | None, n: int, spread: float | None, inverse: float | None) -> tuple[float, float]:
    """Mean and strength of the beta prior by moments.

    Where chance alone explains the hosts' spread, hosts are alike: the prior then weighs as much as a typical host.
    """
    if not docs:
        return 0.0, 1.0
    mean = failed / docs
    between = (spread or 0.0) - mean * (1 - mean) * inverse
    if between > 0 and 0 < mean < 1:
        return mean, max(1.0, mean * (1 - mean) / between - 1)
    return mean, docs / n if n > 1 else 1.0


def _judged(docs: DataFrame, host: str, min_words: int, max_repeat: int, max_symbols: float, max_dup_lines: float, max_shout: float) -> DataFrame:
    """docs with host, the counts, base_failed and rule_failed as one more column, _judged; docs has been through with_stats()."""
    n = lambda c: F.col("_stats")[c]
    base = (n("n_words") < min_words) | (100 * n("n_repeat_words") > max_repeat * n("n_words"))
    more = (
        (n("n_symbols") > max_symbols * n("n_words")) | (n("n_dup_lines") > max_dup_lines * n("n_lines")) | (n("n_shout_words") > max_shout * n("n_words"))
    )
    return docs.withColumn("_judged", F.struct(F.col(host).cast("string").alias("host"), "_stats.*", base.alias("base_failed"), (base | more).alias("rule_failed"))).drop("_stats")


def host_rates(judged: DataFrame, max_host_rate: float = 0.6, min_docs: int = 20) -> DataFrame:
    """(h, host_docs, host_failed, host_rate, host_blocked), a row per host, from rows with host and rule_failed."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("rule_failed").alias("host_failed"))
    hosts = cut(hosts, "hosts")
    prior = hosts.agg(
        F.sum("host_docs").alias("docs"), F.sum("host_failed").alias("failed"), F.count("*").alias("n"),
        F.var_samp(F.col("host_failed") / F.col("host_docs")).alias("spread"), F.avg(1 / F.col("host_docs")).alias("inverse"),
    )
    mean, strength = fitted_prior(**prior.first().asDict())  # one row
    rate = (F.col("host_failed") + mean * strength) / (F.col("host_docs") + strength)
    hosts = hosts.withColumn("host_rate", rate)
    hosts = hosts.withColumn("host_blocked", (F.col("host_docs") >= min_docs) & (F.col("host_rate") > max_host_rate))
    return hosts.select(F.col("host").alias("h"), "host_docs", "host_failed", "host_rate", "host_blocked")


#: Limits of the rules: words at least, repeated words in a hundred, symbols a word, repeated lines, shouts a word.
RULES = {"min_words": 50, "max_repeat": 50, "max_symbols": 0.2, "max_dup_lines": 0.5, "max_shout": 0.3}


def host_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict | None = None, **host_options) -> DataFrame:
    """(id, host, counts, base_failed, rule_failed, host_docs, host_failed, host_rate, host_blocked, kept), a row per document."""
    one = with_stats(docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")))
    one = cut(_judged(one, "host", **RULES | (rules or {})).select("id", "_judged.*"), "rule_stats")
    hosts = sized(host_rates(one, **host_options), "host_verdicts")
    out = one.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return out.withColumn("kept", ~F.col("rule_failed") & ~F.col("host_blocked"))


def keep_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", rules: dict | None = None, **host_options) -> DataFrame:
    """The rows of docs that host_verdicts() keeps, with docs' own columns.

    Each row is judged by its own text and host, so null or repeated ids do not matter. Rows are
    written once with their verdicts (the text of failed ones left out), and blocked hosts' rows go by a join on the host.
    """
    text, host = fresh(docs, "_text"), fresh(docs, "_host")
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias(text), F.col(host_col).alias(host))
    judged = _judged(with_stats(own, text), host, **RULES | (rules or {}))
    failed = F.col("_judged.rule_failed")
    judged = cut(judged.select(F.when(~failed, F.col("_row")).alias("_row"), F.col("_judged.host").alias("host"), failed.alias("rule_failed")), "judged")
    blocked = sized(host_rates(judged, **host_options).where("host_blocked").select("h"), "blocked_hosts")
    kept = judged.where("NOT rule_failed").join(blocked, F.col("host").eqNullSafe(F.col("h")), "left_anti")
    return kept.select("_row.*").select(docs.columns)


def op6_host_rules(spark, sf_dir: str) -> DataFrame:
    found = host_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "rule_failed", "host_docs", "host_failed", F.round("host_rate", 6).alias("host_rate"),
    )
