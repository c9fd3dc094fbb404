"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duewise.llm import bpe, jaccard, licenses, lines, mixing, neighbours, oracles, packing, pivots, surrogates, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_surrogates": surrogates.op2_surrogates,
    "op3_licenses": licenses.op3_licenses,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pivots": pivots.op5_pivots,
    "op6_lines": lines.op6_lines,
    "op7_mix": mixing.op7_mix,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_bpe": bpe.op10_bpe,
}

_PARTS = """links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
part AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""

ORACLE_SQL: dict[str, str] = {
    "op3_licenses": oracles.licenses_sql(),
    "op6_lines": oracles.LINES,
    "op5_pivots": f"""WITH RECURSIVE x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
pairs AS (SELECT p.vec_id AS a, q.vec_id AS b FROM x p JOIN x q ON p.label = q.label AND p.vec_id < q.vec_id WHERE list_cosine_similarity(p.v, q.v) >= 0.93), {_PARTS}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(component, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN part ON node = e.vec_id""",
    "op9_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both_ FROM s p JOIN s q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id),
pairs AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)), {_PARTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS n_links, coalesce(component, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN part ON node = d.doc_id""",
}
