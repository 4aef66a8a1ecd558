"""Operators 11 to 13 against brute force and SQL, and on rows that are null, empty, long, repeated or not there."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from groupsight.llm import op11_language as op11
from groupsight.llm import op12_negatives as op12
from groupsight.llm import op13_resampling as op13
from groupsight.llm import queries as text
from tests.llm.test_text_operators import CLASH, ROWS, SCHEMA
from tests.test_oracles import rows as same

R = random.Random(11)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in [*CLASH, "lang", "t_", "mask"]}).repartition(3)


@pytest.mark.parametrize("name", ["op12_negatives", "op13_resampling"])
def test_same_rows_as_sql(name, spark, tiny):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    assert same(text.queries()[name](spark, tiny).toPandas()) == same(con.sql(text.oracle_sql()[name]).df())


# --- 11


def test_bit_sliced_filters_are_bloom_filters():
    """Masks against a set of bits per language, and corrected counts against true membership."""
    g = np.random.default_rng(1)
    size, held = 1 << 14, [g.integers(0, 2**63, 1200).astype(np.uint64) for _ in range(11)]
    held[3] = held[3][:50]
    bits = [{int(p) for at in op11.positions(k, size) for p in at} for k in held]
    rows = np.zeros((size, 2), np.uint8)
    for lang, b in enumerate(bits):
        for p in b:
            rows[p, lang // 8] |= 1 << lang % 8
    f = op11.Filters([f"l{i}" for i in range(11)], rows)
    probe = np.concatenate([held[0][:300], held[3], g.integers(0, 2**63, 5000).astype(np.uint64)])
    at = op11.positions(probe, size)
    masks = f.masks(probe)
    for i in range(len(probe)):
        want = [all(int(p[i]) in b for p in at) for b in bits]
        assert [bool(masks[i, lang // 8] >> lang % 8 & 1) for lang in range(11)] == want
    assert np.allclose(f.false_yes, [(len(b) / size) ** op11.HASHES for b in bits])


def test_ngrams_and_positions_by_hand(spark):
    def by_hand(line, n):
        return [line[i : i + n] for i in range(len(line) - n + 1) if " " not in line[i + 1 : i + n - 1]]

    line = op11.line_of("Ab, éçà1x  Ω")
    assert line == " ab éçà x ω "
    assert len(op11.ngram_keys(line)) == sum(len(by_hand(line, n)) for n in op11.SIZES)
    keys = {}
    for w in ("abc", "abd", "bca", "éça", "aaaa", "aaa"):
        keys[w] = op11.ngram_keys(w)[-1]
    assert len(set(keys.values())) == len(keys)
    k = op11.ngram_keys(" the quick brown fox ")
    table = spark.createDataFrame([(int(x),) for x in k.view(np.int64)], "key long")
    for i in range(op11.HASHES):
        got = [r[0] for r in table.select(op11._position(F.col("key"), i, 1 << 12)).collect()]
        assert got == op11.positions(k, 1 << 12)[i].tolist()


def test_pieces_count_like_the_whole(monkeypatch):
    line = op11.line_of(" ".join("".join(R.choices("abcé", k=R.randint(1, 30))) for _ in range(400)))
    whole = np.sort(op11.ngram_keys(line))
    monkeypatch.setattr(op11, "PIECE", 37)
    assert np.array_equal(np.sort(np.concatenate([op11.ngram_keys(p) for p in op11.pieces_of(line)])), whole)


def test_languages_are_told_apart_and_held_out_rows_never_learnt(spark, tiny):
    d = spark.read.parquet(f"{tiny}/documents.parquet")
    got = op11.identify(d).join(d.select(F.col("doc_id").alias("id"), "lang"), "id").toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.id]
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.95 and got.score.between(0, 1).all()
    # other languages on held-out rows change nothing
    other = d.withColumn("lang", F.when(op11.training_row(F.col("doc_id")), F.col("lang")).otherwise("xx"))
    again = op11.identify(other).toPandas()
    key = lambda p: sorted(map(tuple, p[["id", "lang_pred", "score"]].values.tolist()))
    assert key(got) == key(again)
    assert key(got) == key(op11.identify(d.repartition(7)).toPandas())


def test_language_of_odd_rows(spark, docs):
    learn = spark.createDataFrame([(i, t, lang) for i in range(100, 160) for t, lang in (("the cat sat on the mat " * 3, "en"), ("der hund und die katze " * 3, "de"))], "doc_id long, text string, lang string")
    odd = [(1, None, "en"), (2, "", "en"), (3, "12 !? ²", "en"), (4, "漢字", "en"), (None, "the mat", "de"), (5, "Die Katze", None), (5, "Die Katze", None), (6, "katze " * 400_000, "en")]
    got = {}
    for r in op11.identify(learn.union(spark.createDataFrame(odd, learn.schema))).collect():
        got.setdefault(r.id, []).append(r)
    assert [got[i][0].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1][0].score == 0
    assert got[4][0].lang_pred in ("de", "en") and got[4][0].score == 0
    assert got[None][0].lang_pred == "en" and got[None][0].held_out is False
    assert [r.lang_pred for r in got[5]] == ["de", "de"] and got[6][0].lang_pred == "de"
    empty = learn.limit(0)
    assert op11.identify(empty).columns == ["id", "held_out", "lang_pred", "score"] and op11.identify(empty).count() == 0
    assert {r.lang_pred for r in op11.identify(learn.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert op11.identify(docs).count() == len(ROWS)


# --- 12


@pytest.mark.parametrize(("dim", "high"), [(1, 3), (64, 300), (1500, 40), (64, 4_000_000)])
def test_residue_products_are_exact(dim, high):
    g = np.random.default_rng(dim)
    a, b = g.integers(-high, high + 1, (7, dim)), g.integers(-high, high + 1, (9, dim))
    a[0], b[0] = high, -high
    primes = op12.primes_for(dim * high * high)
    got = op12.exact_products([op12.residues(a, p) for p in primes], [op12.residues(b, p) for p in primes], primes)
    assert np.array_equal(got, a @ b.T)


def mined_by_hand(rows, low, k):
    """rows: (id, vector, label); anchors are rows whose id is divisible by 3."""
    rows = [(i, [math.floor(256 * c) for c in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    big = float("inf")
    out = []
    for x, (i, v, lab) in enumerate(rows):
        if i is None or i % 3:
            continue
        dots = [(-sum(p * q for p, q in zip(v, w, strict=False)), big if j is None else j, z, y) for y, (j, w, z) in enumerate(rows) if y != x]
        for s, j, _, _ in sorted(t for t in dots if t[2] == lab)[:k]:
            hits = sorted(t for t in dots if t[2] != lab and low * -s <= 100 * -t[0] <= 100 * -s)[:k]
            out += [(i, None if j == big else j, r + 1, None if h[1] == big else h[1], -s, -h[0]) for r, h in enumerate(hits)]
    return sorted(map(str, out))


@pytest.mark.parametrize("group", [16_384, 4])
def test_negatives_equal_all_pairs(spark, group):
    g = np.random.default_rng(2)
    rows = [(i, [float(c) for c in g.integers(-2, 3, 6) / 64], int(g.integers(0, 3))) for i in range(90)]
    rows += rows[:4] + [(None, [0.1, 0.2], 1), (93, [], 1), (96, None, 1), (99, [0.1, None], 1), (102, [float("nan")], 1), (105, [float("-inf")], 2), (108, [0.1], None), (111, [0.5] * 6, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("id", "v", "row", "anchor", "score", "a", "p")}).repartition(4)
    got = op12.mine(table, F.col("id") % 3 == 0, group=group)
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()]
    assert sorted(map(str, got)) == mined_by_hand(rows, 80, 5)


def test_negatives_of_tables_without_anchors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert op12.mine(spark.createDataFrame([], kind), F.col("id") % 3 == 0).count() == 0
    assert op12.mine(spark.createDataFrame([(1, [0.5], 1)], kind), F.col("id") % 3 == 0).count() == 0
    assert op12.mine(spark.createDataFrame([(3, [0.5], 1)], kind), F.col("id") % 3 == 0).count() == 0
    with pytest.raises(ValueError, match="out of reach"):
        op12.mine(spark.createDataFrame([(3, [1e30], 1)], kind), F.col("id") % 3 == 0)


# --- 13


def features_by_hand(t, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, most + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_position_tables_give_crc32(monkeypatch, most):
    texts = ["", "a", "A b C", "é", "x" * 64, "x" * 65, "x" * 127 + " " + "y" * 128, "x" * 5000 + " y", "".join(R.choices("aB é0-ö_\n", k=3000)), "y" * 300_000]
    for gather in (1 << 20, 100):
        monkeypatch.setattr(op13, "GATHER", gather)
        for t in texts:
            n, found = op13.feature_buckets(t.encode(), most)
            assert (n, found.tolist()) == features_by_hand(t, most)


@pytest.mark.parametrize("most", [1, 2])
def test_resampling_by_hand(spark, docs, most):
    target = ["The gcab habc", None, "é É", ROWS[0][1]]
    got = op13.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), most=most, per_hundred=50).collect()
    assert len(got) == len(ROWS)
    s, t = (np.zeros(10_000, int) for _ in range(2))
    for _, x, _ in ROWS:
        np.add.at(s, np.array(features_by_hand(x, most)[1], int), 1)
    for x in target:
        np.add.at(t, np.array(features_by_hand(x, most)[1], int), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t, strict=True)]
    want = []
    for i, x, _ in ROWS:
        n, found = features_by_hand(x, most)
        w = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, n, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((-x[4], math.inf if x[0] is None else x[0]) for x in want if x[1] >= 20)
    assert sorted(map(str, want)) == sorted(str((r.id, r.n_words, r.n_features, r.weight, r.score)) for r in got)
    drawn = sorted((r["rank"], -r.score, math.inf if r.id is None else r.id) for r in got if r["rank"])
    assert drawn == [(k + 1, *x) for k, x in enumerate(fit[: len(fit) // 2])]


def test_resampling_of_nothing(spark, docs):
    none = docs.limit(0)
    assert op13.resample(none, docs).count() == 0
    assert all(r["rank"] is None or r.n_words >= 20 for r in op13.resample(docs, none).collect())
