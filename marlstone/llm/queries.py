"""The queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run as pipeline
from marlstone.llm.ann import op5_nearest
from marlstone.llm.collocations import SQL as COLLOCATION_SQL
from marlstone.llm.collocations import op11_collocations
from marlstone.llm.curriculum import SQL as CURRICULUM_SQL
from marlstone.llm.curriculum import op13_curriculum
from marlstone.llm.html_text import op6_html_text
from marlstone.llm.language_id import op9_language_id
from marlstone.llm.near_vectors import op4_near_vectors
from marlstone.llm.ngram_join import op2_ngram_join
from marlstone.llm.packing import op8_packing
from marlstone.llm.periodic_runs import SQL as PERIODIC_SQL
from marlstone.llm.periodic_runs import op12_periodic_runs
from marlstone.llm.pieces import op7_pieces
from marlstone.llm.quality import op1_quality
from marlstone.llm.suffix_dedup import op10_suffix_dedup
from marlstone.llm.token_output import op3_token_output

QUERIES = {
    "op1_quality": op1_quality,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_output": op3_token_output,
    "op4_near_vectors": op4_near_vectors,
    "op5_nearest": op5_nearest,
    "op6_html_text": op6_html_text,
    "op7_pieces": op7_pieces,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_curriculum": op13_curriculum,
    "pipeline": pipeline,
}
REACH = "r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, MIN(b) AS m FROM r GROUP BY a)"

ORACLE_SQL: dict[str, str] = {
    "op11_collocations": COLLOCATION_SQL,
    "op12_periodic_runs": PERIODIC_SQL,
    "op13_curriculum": CURRICULUM_SQL,
    "op2_ngram_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, UNNEST(range(1, GREATEST(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
{REACH}
SELECT doc_id, COALESCE(n, 0) AS n_shingles, LEAST(doc_id, COALESCE(m, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id""",
    "op4_near_vectors": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{REACH},
k AS (SELECT a, COUNT(*) AS n FROM l GROUP BY a)
SELECT vec_id, COALESCE(n, 0) AS n_links, LEAST(vec_id, COALESCE(m, vec_id)) AS component_id, vec_id <= COALESCE(m, vec_id) AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.a = vec_id""",
}
if PIPELINE_SQL is not None:
    ORACLE_SQL["pipeline"] = PIPELINE_SQL
