"""The queries of this subpackage, and the SQL that says the same where there is such SQL."""

from __future__ import annotations

from lexforge.llm.byte_bpe import op7_duckdb_bpe
from lexforge.llm.near_dedup import op6_bagminhash
from lexforge.llm.one_bit_search import op2_one_bit_codes
from lexforge.llm.packing import op9_residual_packing
from lexforge.llm.quality_mil import op5_attention_mil
from lexforge.llm.quality_rules import op8_risk_controlled_rules
from lexforge.llm.role_repair import op3_role_repair
from lexforge.llm.sanitise import op4_information_sanitise
from lexforge.llm.sharding import op1_histogram_sort
from lexforge.llm.toxicity import op10_kneser_ney

_ALL = (
    op1_histogram_sort, op2_one_bit_codes, op3_role_repair, op4_information_sanitise, op5_attention_mil,
    op6_bagminhash, op7_duckdb_bpe, op8_risk_controlled_rules, op9_residual_packing, op10_kneser_ney,
)
QUERIES = {f.__name__: f for f in _ALL}

# ---- SQL: all pairs of texts for op6; all cutoffs, rules and strata, with exact tails, for op8 ----------------------

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_OP6 = rf"""WITH RECURSIVE t AS (SELECT text, row_number() OVER (ORDER BY text) AS v, {_WORDS} AS l FROM (SELECT DISTINCT text FROM documents WHERE text <> '')),
 shingle AS (SELECT v, s, count(*) AS n FROM (SELECT v, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS s FROM t) GROUP BY v, s),
 size AS (SELECT v, sum(n) AS n FROM shingle GROUP BY v),
 pair AS (SELECT a.v AS x, b.v AS y, sum(least(a.n, b.n)) AS o FROM shingle a JOIN shingle b ON a.s = b.s AND a.v < b.v GROUP BY 1, 2),
 edge AS (SELECT x, y FROM pair JOIN size p ON x = p.v JOIN size q ON y = q.v WHERE 5 * o >= 4 * (p.n + q.n - o)),
 twice AS (SELECT x, y FROM edge UNION ALL SELECT y, x FROM edge),
 reach AS (SELECT v, v AS root FROM t UNION SELECT y, root FROM reach JOIN twice ON x = v),
 class AS (SELECT v, min(root) AS root FROM reach GROUP BY v),
 member AS (SELECT doc_id, root, min(doc_id) OVER (PARTITION BY root) AS class_id FROM documents JOIN t USING (text) JOIN class USING (v))
SELECT doc_id, class_id, row_number() OVER (PARTITION BY root ORDER BY doc_id) = 1 AS first FROM member
UNION ALL SELECT doc_id, doc_id, TRUE FROM documents WHERE text IS NULL OR text = ''"""
_OTHER = r"[^\x20\x09-\x0D]"


def _share(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN least(64, ceil(64 * {a} / {b})) ELSE 0 END)::INTEGER"


_OP8 = rf"""WITH w AS (SELECT doc_id, coalesce(lang, chr(0) || 'none') AS lang, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_OTHER}+') AS l, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_OTHER}')) AS lines FROM documents),
 windows AS (SELECT doc_id, lang, text, i, count(*) OVER (PARTITION BY doc_id, lang, text, list_slice(l, i, i + 7)) AS times FROM (SELECT doc_id, lang, text, l, unnest(range(1, len(l) - 6)) AS i FROM (SELECT DISTINCT doc_id, lang, text, l FROM w))),
 covered AS (SELECT doc_id, lang, text, sum(least(8, i - coalesce(before, -7))) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, lang, text ORDER BY i) AS before FROM windows WHERE times > 1) GROUP BY ALL),
 c AS (SELECT w.doc_id, w.lang, w.text, len(l)::BIGINT AS n_words, length(array_to_string(l, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals
  FROM w LEFT JOIN covered ON w.doc_id IS NOT DISTINCT FROM covered.doc_id AND w.lang = covered.lang AND w.text = covered.text),
 s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [{_share('n_symbols','word_chars')}, {_share('n_dup_lines','n_lines')}, {_share('n_capitals','word_chars')}, {_share('n_repeat_words','n_words')}] AS steps FROM c),
 trial AS (SELECT lang, text, steps, max(good) AS good FROM s JOIN (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
 cell AS (SELECT lang, unnest([1, 2, 3, 4]) AS rule, unnest(steps) AS step, good FROM trial),
 test AS (SELECT lang, rule, cut, sum(good) AS n, count(*) - sum(good) AS bad, sum(CASE WHEN step > cut THEN good ELSE 0 END) AS k, sum(CASE WHEN step > cut THEN 1 - good ELSE 0 END) AS caught FROM cell, range(64) r(cut) GROUP BY ALL),
 tail AS (SELECT *, CASE WHEN k >= n * 0.01 THEN 1.0 ELSE list_sum(list_transform(range(0, k::BIGINT + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) END AS p FROM test),
 fine AS (SELECT *, caught / greatest(bad, 1) - 10.0 * k / greatest(n, 1) AS gain FROM (SELECT *, max(p) OVER (PARTITION BY lang, rule ORDER BY cut DESC) AS worst FROM tail) WHERE worst <= 0.05 / (4 * (SELECT count(DISTINCT lang) FROM trial))),
 best AS (SELECT lang, rule, arg_max(cut, (gain, cut)) AS cut FROM fine WHERE gain > 0 GROUP BY ALL)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM best WHERE best.lang = s.lang AND s.steps[rule] > cut) AS kept FROM s"""

#: The others can't be said in SQL: shards follow a hash that other engines lack (op1), neighbours are those found (op2), turns are repaired by a dynamic
#: programme (op3), spans need places of matches (op4), models are learnt (op5, op10), and tokenizers are read from files (op7, op9).
SQL: dict[str, str] = {"op6_bagminhash": _OP6, "op8_risk_controlled_rules": _OP8}
