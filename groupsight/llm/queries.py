"""Registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from groupsight.llm.op1_simhash import op1_simhash
from groupsight.llm.op10_attention_lm import op10_attention_lm
from groupsight.llm.op11_language import op11_language
from groupsight.llm.op12_negatives import op12_negatives
from groupsight.llm.op13_resampling import op13_resampling
from groupsight.llm.op2_rule_ensemble import op2_rule_ensemble
from groupsight.llm.op3_packing import op3_packing
from groupsight.llm.op4_toxicity import op4_toxicity
from groupsight.llm.op5_warc import op5_warc
from groupsight.llm.op6_host_rules import op6_host_rules
from groupsight.llm.op7_decontaminate import op7_decontaminate
from groupsight.llm.op8_pii import op8_pii
from groupsight.llm.op9_license import op9_license

QUERIES = (
    op1_simhash, op2_rule_ensemble, op3_packing, op4_toxicity, op5_warc, op6_host_rules, op7_decontaminate, op8_pii, op9_license, op10_attention_lm,
    op11_language, op12_negatives, op13_resampling,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


HOST_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wi AS (SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
tw AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM wi) WHERE n > 1),
rp AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM tw) GROUP BY 1),
ln AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
st AS (SELECT d.rid, doc_id, host, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(ln.n, 0) AS n_lines,
  coalesce(rp.n, 0) AS n_repeat_words, CAST((length(t) - length(replace(t, '!!', ''))) / 2 AS BIGINT) AS shout
  FROM d LEFT JOIN rp ON d.rid = rp.rid LEFT JOIN ln ON d.rid = ln.rid),
ru AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.2 * n_words OR n_dup_lines > 0.5 * n_lines OR shout > 0.3 * n_words AS rule_failed FROM st),
ho AS (SELECT host, count(*) AS host_docs, count(*) FILTER (rule_failed) AS host_failed FROM ru GROUP BY 1),
pr AS (SELECT sum(host_failed) / sum(host_docs)::DOUBLE AS m, sum(host_docs)::DOUBLE AS docs, count(*) AS n, coalesce(var_samp(host_failed / host_docs::DOUBLE), 0) AS spread, avg(1 / host_docs::DOUBLE) AS inv FROM ho),
ps AS (SELECT m, CASE WHEN spread - m * (1 - m) * inv > 0 AND m > 0 AND m < 1 THEN greatest(1, m * (1 - m) / (spread - m * (1 - m) * inv) - 1) WHEN n > 1 THEN docs / n ELSE 1 END AS s FROM pr),
hv AS (SELECT *, (host_failed + m * s) / (host_docs + s) AS rate FROM ho, ps)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT rule_failed AND NOT (host_docs >= 20 AND rate > 0.6) AS kept, rule_failed, host_docs, host_failed,
  round(rate, 6) AS host_rate FROM ru JOIN hv ON ru.host IS NOT DISTINCT FROM hv.host"""

DECONTAMINATE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b)),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS item_shingles, shared AS shared_shingles, shared / n AS containment FROM m JOIN bn USING (item_id) WHERE shared >= 0.8 * n"""


NEGATIVES = r"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.rid <> b.rid AND a.vec_id % 100 = 0),
p AS (SELECT arid, anchor_id, vec_id AS positive_id, rid AS prid, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) <= 5),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.arid, prid ORDER BY score DESC, vec_id, label, rid) AS rank
  FROM p JOIN s ON p.arid = s.arid AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

#: CRC-32 is computed from its polynomial, once per different word.
RESAMPLING = r"""
WITH bytes AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (SELECT 0 AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
ws AS (SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src),
f AS (SELECT side, rid, unnest(w) AS w FROM ws),
hx AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM f)),
cr AS (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM hx, bytes),
fb AS (SELECT side, rid, bucket FROM f JOIN cr USING (w)),
sz AS (SELECT count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM fb),
bk AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM fb GROUP BY 1),
ga AS (SELECT bucket, CAST(floor(1000 * ln((bk.t + 1)::DOUBLE * (sz.s + 10000) / ((bk.s + 1)::DOUBLE * (sz.t + 10000)))) AS BIGINT) AS g FROM bk, sz),
dw AS (SELECT rid, CAST(floor(sum(g) / count(*)::DOUBLE) AS BIGINT) AS weight FROM fb JOIN ga USING (bucket) WHERE side = 0 GROUP BY 1),
sc AS (SELECT ws.rid, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM ws LEFT JOIN dw ON ws.rid = dw.rid WHERE side = 0),
rk AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, rid) AS r, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_host_rules": HOST_RULES, "op7_decontaminate": DECONTAMINATE, "op12_negatives": NEGATIVES, "op13_resampling": RESAMPLING}
