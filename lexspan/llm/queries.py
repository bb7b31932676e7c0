"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op10_bpe_prefix_dp
from .hnsw import op8_hnsw
from .html_text import op7_html_wrappers
from .line_rules import op9_line_frequency
from .mixing import op1_mix_sources
from .pii import op6_pii_anchors
from .quality_model import op5_quality_gam
from .repeats import op4_prefix_free_repeats
from .simhash import op2_simhash_pigeonring
from .toxicity import op3_toxicity_counterfactual


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_simhash_pigeonring": op2_simhash_pigeonring,
        "op3_toxicity_counterfactual": op3_toxicity_counterfactual,
        "op4_prefix_free_repeats": op4_prefix_free_repeats,
        "op5_quality_gam": op5_quality_gam,
        "op6_pii_anchors": op6_pii_anchors,
        "op7_html_wrappers": op7_html_wrappers,
        "op8_hnsw": op8_hnsw,
        "op9_line_frequency": op9_line_frequency,
        "op10_bpe_prefix_dp": op10_bpe_prefix_dp,
    }


#: The other queries can't be expressed: hashes, fitted models, inferred wrappers, approximate search, tokens.
_LINE_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8) x),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) x WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, 8)) AS j FROM rep) x GROUP BY r),
split AS (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  regexp_replace(array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' '), '[0-9]+', '0', 'g') AS k FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, line, count(*) AS c FROM lw GROUP BY r, line) x GROUP BY r),
host AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
freq AS (SELECT source, k, count(DISTINCT r) AS n FROM lw GROUP BY source, k),
bad AS (SELECT f.source, f.k FROM freq f JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > greatest(10, 0.02 * h.docs)),
lost AS (SELECT lw.r, sum(lw.n) AS n FROM lw JOIN bad b ON lw.k = b.k AND lw.source IS NOT DISTINCT FROM b.source GROUP BY lw.r),
base AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(d.w) - coalesce(lost.n, 0) AS BIGINT) AS left_words FROM d LEFT JOIN cov ON cov.r = d.r LEFT JOIN dup ON dup.r = d.r LEFT JOIN lost ON lost.r = d.r)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_words >= 0.5 * n_words AS kept FROM base
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_line_frequency": _LINE_RULES}
