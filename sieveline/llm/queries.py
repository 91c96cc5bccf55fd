"""Registry of the training-data queries: name -> (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.codes import op13_vector_codes
from sieveline.llm.decontaminate import op10_decontaminate
from sieveline.llm.html_extract import op1_html_extract
from sieveline.llm.jaccard_join import op7_jaccard_join
from sieveline.llm.langid import op9_language_id
from sieveline.llm.line_dedup import op2_line_dedup
from sieveline.llm.lm_score import op3_lm_score
from sieveline.llm.media import op5_media_columns
from sieveline.llm.mixing import op6_mixing
from sieveline.llm.phrases import op11_phrases
from sieveline.llm.quality import op8_quality
from sieveline.llm.rules_trees import op12_quality_rules
from sieveline.llm.toxicity import op4_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extract, op2_line_dedup, op3_lm_score, op4_toxicity, op5_media_columns, op6_mixing, op7_jaccard_join, op8_quality, op9_language_id, op10_decontaminate,
        op11_phrases, op12_quality_rules, op13_vector_codes, pipeline,
    )
}
#: Words, sets and links of op7 are fixed by its contract. The other queries are trained models, hash-chosen boundaries, seeded draws
#: or stored bytes, which have no SQL form; tests/llm has their brute force, round trips and held-out labels.
ORACLES: dict[str, str] = {
    "op7_jaccard_join": r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    # counts, cuts and ranks of op11 are fixed by its contract
    "op11_phrases": r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
i AS (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y
      ON x.lang = y.lang AND y.k > x.k AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
s AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n.n, j, ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN n ON n.lang = c.lang JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : j], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM i))
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000""",
}


def _nearest(codes: str) -> str:
    return f"(SELECT vec_id, q, any_value(x) AS x, min({{'d': list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.z) + list_dot_product(c.z, c.z), 'entry': c.entry}}) AS m FROM p JOIN {codes} c USING (q) GROUP BY vec_id, q)"


def _vector_codes_sql() -> str:
    """Rounds are written out one after another; sums of whole numbers below 2**53 are exact as doubles."""
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, q, e[q * (len(e) // 4) + 1 : (q + 1) * (len(e) // 4)] AS x FROM v, range(4) r(q))",
        "c0 AS MATERIALIZED (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS entry, x AS z FROM p QUALIFY entry < 256)",
    ]
    for k in range(4):
        steps.append(f"a{k} AS MATERIALIZED {_nearest(f'c{k}')}")
        steps.append(f"u{k} AS (SELECT q, m.entry AS entry, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{k})")
        steps.append(f"m{k} AS (SELECT q, entry, list(x ORDER BY i) AS z FROM (SELECT q, entry, i, floor(sum(x) / count(*)) AS x FROM u{k} GROUP BY q, entry, i) GROUP BY q, entry)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.q, c.entry, coalesce(m.z, c.z) AS z FROM c{k} c LEFT JOIN m{k} m ON c.q = m.q AND c.entry = m.entry)")
    steps.append(f"f AS (SELECT vec_id, string_agg(format('{{:02x}}', m.entry), '' ORDER BY q) AS code, sum(m.d)::BIGINT AS error FROM {_nearest('c4')} GROUP BY vec_id)")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(list_transform(z, lambda x: x::BIGINT), ','), ',' ORDER BY q, entry)) AS codebooks_sha256 FROM c4)")
    return "WITH " + ",\n".join(steps) + "\nSELECT f.vec_id, f.code, f.error, (sum(f.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, h.codebooks_sha256 FROM f JOIN v USING (vec_id), h"


ORACLES["op13_vector_codes"] = _vector_codes_sql()
