"""One query per operator: it applies the operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from wirefold.llm.bin_packing import pack_texts
from wirefold.llm.centroid_cluster import CENTROIDS, ROUNDS, cluster_report
from wirefold.llm.chat_format import chat_digests
from wirefold.llm.common import read_table
from wirefold.llm.decontaminate import contamination_report
from wirefold.llm.embedding_dedup import near_duplicate_vectors
from wirefold.llm.html_extract import extract_pages
from wirefold.llm.importance_sample import importance_resample
from wirefold.llm.jaccard_join import jaccard_components
from wirefold.llm.line_dedup import drop_repeated_lines
from wirefold.llm.lm_score import backoff_scores
from wirefold.llm.quality_rank import score_documents
from wirefold.llm.registry import register
from wirefold.llm.secret_scan import secret_digests
from wirefold.llm.token_repair import token_blocks

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, contains(text, chr(91)) OR contains(text, '<') AS odd FROM t),
l AS (SELECT conv_id, max(CASE WHEN regexp_matches(text, '[\[<]/?(INST|SYS|OUT|TURN|s[:>])') THEN 1 ELSE 0 END) AS level FROM c GROUP BY conv_id),
e AS (SELECT c.*, CASE WHEN level = 0 THEN length(text)
        ELSE length(regexp_replace(replace(text, '\', '\\'), '([\[<])(/?(INST|SYS|OUT|TURN|s[:>]))', '\1\\\2', 'g')) END AS n, level
      FROM c JOIN l USING (conv_id))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (any_value(CASE WHEN level = 0 THEN 3 ELSE 5 END) + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13
         WHEN 'assistant' THEN 10 ELSE 16 + 2 * strlen(role) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM b, UNNEST(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, k, UNNEST(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, dw.k, i, item_id FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k),
pos AS (SELECT DISTINCT doc_id, p FROM hit, UNNEST(range(i, i + k)) AS t(p)),
n AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM w, UNNEST(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id
"""

BACKOFF_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v FROM d, UNNEST(range(1, len(w) + 1)) AS u(i)),
dw AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
cw AS (SELECT w, sum(n) AS n FROM dw GROUP BY w),
db AS (SELECT doc_id, v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY ALL),
cb AS (SELECT v, w, sum(n) AS n FROM db GROUP BY ALL),
x AS (SELECT t.doc_id, t.v, coalesce(cb.n - db.n, 0) AS b, cw.n - dw.n AS u, cv.n - dv.n AS h,
             greatest((SELECT count(*) FROM t) - len(d.w), 1) AS total
      FROM t JOIN d ON d.doc_id = t.doc_id JOIN dw ON dw.doc_id = t.doc_id AND dw.w = t.w JOIN cw ON cw.w = t.w
      LEFT JOIN db ON db.doc_id = t.doc_id AND db.v = t.v AND db.w = t.w LEFT JOIN cb ON cb.v = t.v AND cb.w = t.w
      LEFT JOIN dw dv ON dv.doc_id = t.doc_id AND dv.w = t.v LEFT JOIN cw cv ON cv.w = t.v),
s AS (SELECT doc_id, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS n_known,
             sum(CASE WHEN b > 0 THEN ln(b / h)
                 ELSE ln((CASE WHEN u > 0 THEN u ELSE 0.5 END) / total) + CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END END) AS s
      FROM x GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_known, 0)::BIGINT AS n_known, round(coalesce(s, 0), 3) AS log_score
FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""

LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line,
             translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM d, UNNEST(range(1, len(ls) + 1)) AS t(i)),
s AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
m AS (SELECT l.*, s.k IS NOT NULL AND doc_id IS DISTINCT FROM s.top AS gone FROM l LEFT JOIN s ON s.k = l.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

RESAMPLE_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
w AS (
  SELECT r, doc_id, is_doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS r, doc_id, text, true AS is_doc FROM documents UNION ALL SELECT NULL, NULL, text, false FROM benchmark)),
f AS (SELECT r, is_doc, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS n
      FROM w, UNNEST([1, 2, 3]) AS o(k), UNNEST(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k GROUP BY ALL),
c AS (SELECT g, xor(list_reduce(list_transform(range(strlen(g)), lambda i: ('0x' || substr(hex(g), 2 * i + 1, 2))::BIGINT),
                                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b
      FROM (SELECT DISTINCT g FROM f), tab),
n AS (SELECT b, coalesce(sum(n) FILTER (is_doc), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT is_doc), 0)::DOUBLE AS t FROM f JOIN c USING (g) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n),
d AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN c USING (g) JOIN gain USING (b) WHERE is_doc GROUP BY r),
x AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN d USING (r) WHERE is_doc),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM k) THEN rank END AS rank
FROM x LEFT JOIN k USING (r)
"""


def _clusters_sql() -> str:
    """Lloyd's rounds written out, one pair of relations (assignment, centroids) per round."""
    steps = [rf"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < {CENTROIDS})"""]
    for i in range(ROUNDS + 1):
        steps.append(rf"""
a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS v, (min(struct_pack(d := d, c := c))).d AS d, (min(struct_pack(d := d, c := c))).c AS c
  FROM (SELECT r, vec_id, v.v AS x, c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i})
  GROUP BY r)""")
        if i < ROUNDS:
            steps.append(rf"""
m{i} AS (SELECT c, list(m ORDER BY j) AS m FROM (
           SELECT c, j, (s - ((s % n) + n) % n) // n AS m FROM (
             SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, UNNEST(range(1, 65)) AS t(j) GROUP BY c, j)) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(list_transform(m, lambda x: x::BIGINT), v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",".join(steps) + rf"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)
"""


@register("op7_parity_sketch_join", JACCARD_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by five-word shingles at similarity 0.75."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


@register("op1_repair_tokens")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in grammar blocks, read back."""
    import public_tokenizers

    return token_blocks(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op2_chat_round_trip", CHAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like the template, formatted and read back."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat_digests(rows.union(extra))


@register("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secret_digests(read_table(spark, sf_dir, "documents"))


@register("op4_html_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = extract_pages(read_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 words; no sequence holds a source twice, nor a text and its exact or near copy."""
    return pack_texts(read_table(spark, sf_dir, "documents"), near=True)


@register("op6_window_decontamination", DECONTAMINATION_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op9_pairwise_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labelled ones that aren't held out."""
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op10_itq_near_duplicates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label at cosine 0.93 or more."""
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


@register("op8_backoff_scores", BACKOFF_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents under bigrams, to three decimals; README has the figures of order 3."""
    scores = backoff_scores(read_table(spark, sf_dir, "documents"), order=2)
    return scores.withColumn("log_score", F.round("log_score", 3))


@register("op13_levelled_line_dedup", LINES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents hold, dropped from all but the largest id."""
    kept = drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register("op12_importance_resample", RESAMPLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of 5 % of all documents of 20 words or more, weighted towards the benchmark's texts."""
    return importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op11_heap_bounds_clusters", _clusters_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 40 clusters after five rounds."""
    return cluster_report(read_table(spark, sf_dir, "embeddings"))
