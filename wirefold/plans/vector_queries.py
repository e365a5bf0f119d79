"""Registered queries for array operators and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.functions import vectors as V
from wirefold.operators import metrics as M
from wirefold.plans.registry import register
from wirefold.session import read_table

KERNEL = [0.5, -1.0, 0.25]
STRIDE = 2


def _emb(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", "label", V.as_double_array("embedding").alias("a"))


def _r(c, name):
    return F.round(c, 6).alias(name)


def _sum(a: str):
    return F.expr(f"aggregate({a}, 0D, (s, x) -> s + x)")


E = "list_transform(embedding, lambda x: x::DOUBLE)"


def _conv_duck(a: str, n: str) -> str:
    taps = " + ".join(f"({w}) * {a}[i * {STRIDE} + {j + 1}]" for j, w in enumerate(KERNEL))
    m = f"(({n} - {len(KERNEL)}) // {STRIDE} + 1)"
    return f"list_transform(range(0, {m}), lambda i: greatest(0, {taps}))"


@register("vectorize", f"""
SELECT vec_id, CAST(label AS DOUBLE) AS label, len(embedding) AS size, round(list_sum({E}), 6) AS total
FROM embeddings""")
def vectorize(spark, sf):
    """V1: array -> ML vector (size and sum read back from the vector)."""
    from pyspark.ml.functions import vector_to_array

    e = _emb(spark, sf).select("vec_id", F.col("label").cast("double").alias("label"), V.vectorize("a").alias("v"))
    back = e.select("vec_id", "label", vector_to_array("v").alias("b"))
    return back.select("vec_id", "label", F.size("b").alias("size"), _r(_sum("b"), "total"))


@register("conv1d_relu", f"""
SELECT vec_id, len(c) AS n_out, round(list_sum(c), 6) AS total
FROM (SELECT vec_id, {_conv_duck(E, 'len(embedding)')} AS c FROM embeddings)""")
def conv1d_relu(spark, sf):
    """V2: valid convolution (kernel 0.5, -1, 0.25; stride 2) + ReLU over each embedding."""
    c = _emb(spark, sf).select("vec_id", V.conv1d("a", KERNEL, STRIDE).alias("c"))
    return c.select("vec_id", F.size("c").alias("n_out"), _r(_sum("c"), "total"))


def _same_duck(a: str, k: int, s: int) -> str:
    n = f"len({a})"
    p = f"greatest(0, (({n} + {s} - 1) // {s} - 1) * {s} + {k} - {n})"
    return (f"list_concat(list_concat(list_transform(range(0, {p} // 2), lambda _i: 0.0::DOUBLE), {a}), "
            f"list_transform(range(0, {p} - {p} // 2), lambda _i: 0.0::DOUBLE))")


@register("conv1d_same", f"""
SELECT vec_id, len(c) AS n_out, round(list_sum(c), 6) AS total
FROM (SELECT vec_id, {_conv_duck('p', 'len(p)')} AS c
      FROM (SELECT vec_id, {_same_duck(E, len(KERNEL), STRIDE)} AS p FROM embeddings))""")
def conv1d_same(spark, sf):
    """V3: SAME-padded convolution, output length ceil(n / stride)."""
    c = _emb(spark, sf).select("vec_id", V.conv1d_same("a", KERNEL, STRIDE).alias("c"))
    return c.select("vec_id", F.size("c").alias("n_out"), _r(_sum("c"), "total"))


def _pool_duck(a: str, k: int) -> str:
    m = f"(len({a}) // {k})"
    cells = ", ".join(f"{a}[i * {k} + {j + 1}]" for j in range(k))
    return f"list_transform(range(0, {m}), lambda i: greatest({cells}))"


@register("max_pool1d", f"""
SELECT vec_id, len(c) AS n_out, round(list_sum(c), 6) AS total
FROM (SELECT vec_id, {_pool_duck(E, 3)} AS c FROM embeddings)""")
def max_pool1d(spark, sf):
    """V4: max pool, window 3 stride 3, tail dropped."""
    c = _emb(spark, sf).select("vec_id", V.max_pool1d("a", 3).alias("c"))
    return c.select("vec_id", F.size("c").alias("n_out"), _r(_sum("c"), "total"))


@register("max_pool1d_same", f"""
SELECT vec_id, len(c) AS n_out, round(list_sum(c), 6) AS total
FROM (SELECT vec_id, {_pool_duck('p', 3)} AS c FROM (SELECT vec_id, {_same_duck(E, 3, 1)} AS p FROM embeddings))""")
def max_pool1d_same(spark, sf):
    """V4 SAME variant (stride-1 padding formula, pooling stride 3)."""
    c = _emb(spark, sf).select("vec_id", V.max_pool1d_same("a", 3).alias("c"))
    return c.select("vec_id", F.size("c").alias("n_out"), _r(_sum("c"), "total"))


@register("global_mean_pool", f"SELECT vec_id, round(list_sum({E}) / len(embedding), 6) AS mean FROM embeddings")
def global_mean_pool(spark, sf):
    """V5: mean over positions."""
    return _emb(spark, sf).select("vec_id", _r(V.global_mean_pool("a"), "mean"))


@register("shortcut_add", f"""
SELECT vec_id, len(c) AS n_out, round(list_sum(c), 6) AS total
FROM (SELECT vec_id, list_transform(range(0, len(e)), lambda i: e[i + 1] + coalesce(pp[i + 1], 0.0)) AS c
      FROM (SELECT vec_id, e, list_concat(list_concat(list_transform(range(0, (len(e) - len(q)) // 2), lambda _i: 0.0::DOUBLE), q),
                   list_transform(range(0, len(e) - len(q) - (len(e) - len(q)) // 2), lambda _i: 0.0::DOUBLE)) AS pp
            FROM (SELECT vec_id, {E} AS e, {_pool_duck(E, 3)} AS q FROM embeddings)))""")
def shortcut_add(spark, sf):
    """V6: embedding + its 3-pooled copy, zero-padded symmetrically."""
    e = _emb(spark, sf).select("vec_id", "a", V.max_pool1d("a", 3).alias("q"))
    c = e.select("vec_id", V.shortcut_add("a", "q").alias("c"))
    return c.select("vec_id", F.size("c").alias("n_out"), _r(_sum("c"), "total"))


_LOGITS = _pool_duck(E, 6)


@register("log_softmax", f"""
SELECT vec_id, round(list_sum(lp), 6) AS lp_sum, round(list_max(lp), 6) AS lp_max
FROM (SELECT vec_id, list_transform(z, lambda x: x - list_max(z) - ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z)))))) AS lp
      FROM (SELECT vec_id, {_LOGITS} AS z FROM embeddings))""")
def log_softmax(spark, sf):
    """V7: log-softmax of 10 logits (embedding max-pooled by 6)."""
    z = _emb(spark, sf).select("vec_id", V.max_pool1d("a", 6).alias("z"))
    lp = z.select("vec_id", V.log_softmax("z").alias("lp"))
    return lp.select("vec_id", _r(_sum("lp"), "lp_sum"), _r(F.array_max("lp"), "lp_max"))


@register("argmax", f"""
SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS prediction
FROM (SELECT vec_id, {_LOGITS} AS z FROM embeddings)""")
def argmax(spark, sf):
    """V7: first maximum of the 10 logits."""
    z = _emb(spark, sf).select("vec_id", V.max_pool1d("a", 6).alias("z"))
    return z.select("vec_id", V.argmax("z").alias("prediction"))


@register("cross_entropy", f"""
SELECT round(avg(-(z[label + 1] - list_max(z) - ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z))))))), 6) AS loss,
       count(*) AS n
FROM (SELECT label, {_LOGITS} AS z FROM embeddings)""")
def cross_entropy(spark, sf):
    """Mean negative log-likelihood of the true class under the 10 logits."""
    z = _emb(spark, sf).select("label", V.max_pool1d("a", 6).alias("z"))
    lp = z.select(V.log_softmax("z").alias("lp"), "label").select(V.nll("lp", "label").alias("nll"))
    return lp.agg(_r(F.avg("nll"), "loss"), F.count("*").alias("n"))


# --- evaluation on labels (quality = truth, toxic = prediction) ---------------------------

def _scored(spark, sf):
    return read_table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


_CM = """
WITH g AS (SELECT l.i AS label, p.i AS prediction FROM range(0, 2) l(i), range(0, 2) p(i)),
c AS (SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY 1, 2),
cm AS (SELECT CAST(g.label AS INTEGER) AS label, CAST(g.prediction AS INTEGER) AS prediction,
              CAST(coalesce(c.n, 0) AS BIGINT) AS n
       FROM g LEFT JOIN c ON g.label = c.label AND g.prediction = c.prediction)
"""


@register("confusion_matrix", _CM + "SELECT * FROM cm")
def confusion_matrix(spark, sf):
    """M1: counts per (truth, prediction), zero cells included."""
    return M.confusion_matrix(_scored(spark, sf), num_classes=2)


@register("confusion_overflow", """
WITH s AS (SELECT CASE WHEN doc_id % 7 > 0 THEN quality END AS label, CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 11 > 0 THEN toxic END AS prediction
           FROM labels),
c AS (SELECT label, prediction, count(*) AS n FROM s GROUP BY ALL),
g AS (SELECT CAST(a AS INTEGER) AS label, CAST(b AS INTEGER) AS prediction FROM range(2) AS x(a), range(2) AS y(b))
SELECT CAST(label AS INTEGER) AS label, CAST(prediction AS INTEGER) AS prediction, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT * FROM c UNION ALL SELECT label, prediction, 0 FROM g) GROUP BY ALL""")
def confusion_overflow(spark, sf):
    """M1: classes beyond the grid and nulls keep cells of their own, so that no row is lost."""
    d = read_table(spark, sf, "labels").selectExpr(
        "CASE WHEN doc_id % 7 > 0 THEN quality END AS label",
        "CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 11 > 0 THEN toxic END AS prediction")
    return M.confusion_matrix(d, num_classes=2)


@register("confusion_wide", _CM + """
SELECT label, CAST(sum(n) FILTER (WHERE prediction = 0) AS BIGINT) AS p0,
       CAST(sum(n) FILTER (WHERE prediction = 1) AS BIGINT) AS p1 FROM cm GROUP BY label""")
def confusion_wide(spark, sf):
    """M1 wide: pivot of the matrix."""
    return M.confusion_wide(M.confusion_matrix(_scored(spark, sf), num_classes=2), 2)


@register("class_report", _CM + """
SELECT CAST(c.label AS INTEGER) AS label,
       CASE WHEN col_sum > 0 THEN tp / col_sum END AS precision,
       CASE WHEN row_sum > 0 THEN tp / row_sum END AS recall
FROM (SELECT label, CAST(sum(n) AS DOUBLE) AS row_sum, CAST(sum(n) FILTER (WHERE label = prediction) AS DOUBLE) AS tp
      FROM cm GROUP BY label) c
JOIN (SELECT prediction, CAST(sum(n) AS DOUBLE) AS col_sum FROM cm GROUP BY prediction) p ON c.label = p.prediction""")
def class_report(spark, sf):
    """M2-M4: precision and recall per class."""
    rep = M.class_report(M.confusion_matrix(_scored(spark, sf), num_classes=2))
    return rep.select(F.col("label").cast("int").alias("label"), "precision", "recall")


@register("confusion_normalised", _CM + """
SELECT label, prediction, coalesce(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY label), 0), 0.0) AS share
FROM cm""")
def confusion_normalised(spark, sf):
    """M5: row-normalised matrix, empty rows -> 0."""
    return M.confusion_normalised(M.confusion_matrix(_scored(spark, sf), num_classes=2))
