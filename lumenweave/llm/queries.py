"""Registered queries of this subpackage and the SQL that DuckDB can run against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenweave.llm import align, ann, bpe, decontam, lines, lm, neardup, secrets, sharding, suffix_dedup, tokenfiles, toxicity, turns


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_ngram_jaccard": neardup.op2_ngram_jaccard,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_bfd_shards": sharding.op4_bfd_shards,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_deleted_interpolation": lm.op6_deleted_interpolation,
    "op7_cross_polytope": ann.op7_cross_polytope,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_winnowing": decontam.op9_winnowing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_token_files": tokenfiles.op12_token_files,
    "op13_conversation_repair": turns.op13_conversation_repair,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Texts as hexadecimal digits (two for each byte), so that substrings are cut by bytes.
_OP1 = f"""
WITH body AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, k, n, substring(h, 800 * k + 1, 1600) AS p FROM (SELECT doc_id, h, len(h) // 2 AS n, unnest(range((len(h) // 2 - 400) // 400 + 1)) AS k FROM body WHERE len(h) >= 800)),
windows AS MATERIALIZED (SELECT doc_id, 400 * k + o AS s, hash(substring(p, 2 * o + 1, 800)) AS g FROM (SELECT *, unnest(range(least(400, n - 400 * k - 399))) AS o FROM pieces)),
hit AS (SELECT doc_id, s FROM windows WHERE g IN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1)),
marked AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400, true) AS new FROM hit),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS z FROM (SELECT *, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked) GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(z - a) AS n, count(*) AS runs FROM runs GROUP BY doc_id),
edges AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, len(h) // 2, NULL FROM body)),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS h FROM edges JOIN body USING (doc_id) GROUP BY doc_id),
words AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
passages AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 51], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 50)) AS i FROM words WHERE len(w) > 50)),
again AS (SELECT doc_id, i FROM passages WHERE g IN (SELECT g FROM passages GROUP BY g HAVING count(*) > 1)),
said AS (SELECT doc_id, sum(least(51, coalesce(later - i, 51))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM again) GROUP BY doc_id)
SELECT b.doc_id, (len(b.h) // 2)::BIGINT AS n_bytes, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.runs, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.h, ''))) AS kept_sha256, coalesce(p.n, 0)::BIGINT AS n_repeated_words
FROM body b LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN said p USING (doc_id)
"""

_OP2 = f"""
WITH RECURSIVE words AS (
  SELECT DISTINCT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) < 5 THEN 'whole ' || array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
  )
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

_OP7 = """
WITH vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ranked) WHERE rank <= 20
"""

_OP9 = f"""
WITH dw AS (SELECT DISTINCT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS span
  FROM (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT l FROM item_windows),
doc_windows AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS span
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw JOIN lengths ON len(w) >= l)
),
hits AS (SELECT doc_id, i, l, item_id FROM doc_windows JOIN item_windows USING (l, span)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(dw.w), false) AS contaminated
FROM documents d JOIN dw ON dw.doc_id = d.doc_id LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

ORACLES = {"op1_suffix_dedup": _OP1, "op2_ngram_jaccard": _OP2, "op7_cross_polytope": _OP7, "op8_line_dedup": lines.ORACLE, "op9_winnowing": _OP9}
