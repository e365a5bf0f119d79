"""Registered queries for sampling, splitting and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import features as FE
from wirefold.operators import sampling as B
from wirefold.operators.labels import TASKS
from wirefold.plans.oracle_base import with_kept
from wirefold.plans.registry import register
from wirefold.session import read_table, shared_dir
from wirefold.sources.synthetic import captures_from_events


def h1_sql(*keys: str, seed: int = B.SEED) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(keys)}, '{seed}')), 1, 8))::BIGINT"


def h2_sql(*keys: str, seed: int = B.SEED) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(keys)}, '{seed}')), 9, 8))::BIGINT"


def test_sql(*keys: str, frac: float = 0.2) -> str:
    return f"({h1_sql(*keys)} < {frac} * 4294967296)"


@register("row_key", f"""
SELECT l_orderkey, l_linenumber, {h1_sql('l_orderkey', 'l_linenumber')} AS h1,
       {h2_sql('l_orderkey', 'l_linenumber')} AS h2 FROM lineitem""")
def row_key(spark, sf):
    """B1: stable key (order, line) and its two hash words."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    h1, h2 = B.hash_words(["l_orderkey", "l_linenumber"])
    return li.select("l_orderkey", "l_linenumber", h1.alias("h1"), h2.alias("h2"))


@register("label_fractions", """
SELECT DISTINCT o_orderstatus AS label, CAST(0.2 AS DOUBLE) AS fraction FROM orders""")
def label_fractions(spark, sf):
    """B2: distinct labels -> test fraction."""
    o = read_table(spark, sf, "orders").select(F.col("o_orderstatus").alias("label"))
    return B.label_fractions(o, "label", 0.2)


@register("stratified_sample", f"""
SELECT l_returnflag AS label, count(*) AS n, CAST(sum(l_orderkey * 10 + l_linenumber) AS BIGINT) AS key_sum
FROM lineitem WHERE {test_sql('l_orderkey', 'l_linenumber')} GROUP BY 1""")
def stratified_sample(spark, sf):
    """Keyed-hash Bernoulli sample of each class (fraction 0.2)."""
    li = read_table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "label")
    s = B.stratified_sample(li, ["l_orderkey", "l_linenumber"], "label", 0.2)
    return s.groupBy("label").agg(F.count("*").alias("n"),
                                  F.sum(F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("key_sum"))


@register("train_test_split", f"""
SELECT CASE WHEN {test_sql('o_orderkey')} THEN 'test' ELSE 'train' END AS split, o_orderstatus AS label,
       count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1, 2""")
def train_test_split(spark, sf):
    """Train / test partition of orders, stratified by status."""
    o = read_table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "label")
    train, test = B.train_test_split(o, "o_orderkey", "label", 0.2)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split", "label").agg(F.count("*").alias("n"),
                                              F.sum("o_orderkey").cast("bigint").alias("key_sum"))


@register("split_by_ids", """
SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'test' ELSE 'train' END AS split, lang,
       count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS key_sum
FROM documents GROUP BY 1, 2""")
def split_by_ids(spark, sf):
    """B4 (given ids): documents listed in ``labels`` form the test set."""
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    train, test = B.split_by_ids(docs, read_table(spark, sf, "labels"), "doc_id")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split", "lang").agg(F.count("*").alias("n"), F.sum("doc_id").cast("bigint").alias("key_sum"))


@register("label_counts", "SELECT label, count(*) AS count FROM embeddings GROUP BY 1")
def label_counts(spark, sf):
    """Rows per class."""
    return B.label_counts(read_table(spark, sf, "embeddings"), "label")


@register("min_label_count", """
SELECT min(c) AS min_count FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus)""")
def min_label_count(spark, sf):
    """Smallest class size."""
    return B.min_label_count(read_table(spark, sf, "orders"), "o_orderstatus")


@register("top_n_per_group", f"""
SELECT l_suppkey, l_orderkey, l_linenumber FROM (
  SELECT l_suppkey, l_orderkey, l_linenumber,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY {h1_sql('l_orderkey', 'l_linenumber')},
                            {h2_sql('l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) AS rn
  FROM lineitem) WHERE rn <= 5""")
def top_n_per_group(spark, sf):
    """Five random (hash-ordered) lines per supplier."""
    li = read_table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return B.top_n_per_group(li, "l_suppkey", 5, ["l_orderkey", "l_linenumber"]).select(
        "l_suppkey", "l_orderkey", "l_linenumber")


_UNDER = f"""
WITH tr AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT {test_sql('o_orderkey')}),
m AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM tr GROUP BY o_orderstatus)),
r AS (SELECT o_orderkey, o_orderstatus,
             row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h1_sql('o_orderkey')},
                                {h2_sql('o_orderkey')}, o_orderkey) AS rn FROM tr)
SELECT o_orderstatus AS label, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM r, m WHERE rn <= m.n GROUP BY 1"""


@register("undersample_train", _UNDER)
def undersample_train(spark, sf):
    """Train side cut to the smallest class, per status (skewed classes)."""
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    train, _test = B.split_train_test(o, "o_orderkey", "label", 0.2, under_sampling=True)
    return train.groupBy("label").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("bigint").alias("key_sum"))


_CUST_SETS = f"""
SELECT CASE WHEN {test_sql('c_custkey')} THEN 'test' ELSE 'train' END AS split, c_mktsegment AS label,
       count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum
FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2"""


def _customer_samples(spark, sf):
    return read_table(spark, sf, "customer").select(
        "c_custkey", F.array(F.col("c_custkey").cast("double")).alias("feature"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))


@register("task_sets", _CUST_SETS)
def task_sets(spark, sf):
    """One task's train/test sets written as Parquet (one job, partitioned by split), read back."""
    out = shared_dir(spark, "task-sets")
    B.build_task_sets(_customer_samples(spark, sf), "segment", out, "c_custkey", 0.2)
    back = spark.read.parquet(out)
    return back.groupBy("split", "label").agg(
        F.count("*").alias("n"), F.sum(F.col("feature")[0]).cast("bigint").alias("key_sum"))


_APP = "CASE lprefix WHEN 'email1a' THEN 1 WHEN 'netflix1' THEN 7 END"
_TRAFFIC = "CASE lprefix WHEN 'email1a' THEN 1 WHEN 'netflix1' THEN 3 WHEN 'vpn_email2a' THEN 7 END"


@register("both_task_sets", with_kept(f"""
SELECT task, CASE WHEN {test_sql('path', 'packet_no')} THEN 'test' ELSE 'train' END AS split,
       CAST(label AS BIGINT) AS label, count(*) AS n
FROM (SELECT 'app' AS task, path, packet_no, {_APP} AS label FROM kept
      UNION ALL SELECT 'traffic', path, packet_no, {_TRAFFIC} FROM kept)
WHERE label IS NOT NULL GROUP BY 1, 2, 3"""))
def both_task_sets(spark, sf):
    """Application and traffic sets from one stored sample table (bytes stored,
    vectors derived when the sets are written)."""
    samples = FE.preprocess(captures_from_events(spark, sf), as_bytes=True)
    stored = shared_dir(spark, "samples")
    samples.write.mode("overwrite").parquet(stored)
    out = shared_dir(spark, "task-sets")
    paths = B.build_both_task_sets(spark.read.parquet(stored), out, ["path", "packet_no"], 0.2)
    parts = [spark.read.parquet(p).withColumn("task", F.lit(t)) for t, p in paths.items()]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("task", "split", "label").agg(F.count("*").alias("n"))


@register("label_distribution", f"""
SELECT c_mktsegment AS label, count(*) AS count
FROM customer WHERE c_acctbal > 0 AND NOT {test_sql('c_custkey')} GROUP BY 1""")
def label_distribution(spark, sf):
    """Label counts of a stored train set (split partition pruned)."""
    out = shared_dir(spark, "task-sets")
    B.build_task_sets(_customer_samples(spark, sf), "segment", out, "c_custkey", 0.2)
    return B.label_distribution(spark, out, "train")


@register("balanced_task_sets", with_kept(f"""
, t AS (SELECT 'app' AS task, path, packet_no, {_APP} AS label FROM kept
        UNION ALL SELECT 'traffic', path, packet_no, {_TRAFFIC} FROM kept),
s AS (SELECT task, path, packet_no, label, {test_sql('path', 'packet_no')} AS is_test,
             row_number() OVER (PARTITION BY task, label, {test_sql('path', 'packet_no')}
                                ORDER BY {h1_sql('path', 'packet_no')}, {h2_sql('path', 'packet_no')}, path, packet_no) AS rn FROM t WHERE label IS NOT NULL),
m AS (SELECT task, min(n) AS least FROM (SELECT task, label, count(*) AS n FROM s WHERE NOT is_test GROUP BY 1, 2) GROUP BY task)
SELECT task, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, CAST(label AS BIGINT) AS label, count(*) AS n,
       CAST(sum(packet_no) AS BIGINT) AS packet_sum
FROM s JOIN m USING (task) WHERE is_test OR rn <= least GROUP BY 1, 2, 3"""))
def balanced_task_sets(spark, sf):
    """Both tasks' sets from stored samples, the train sides cut to their smallest class."""
    stored = shared_dir(spark, "samples")
    FE.preprocess(captures_from_events(spark, sf), as_bytes=True).write.parquet(stored)
    samples = spark.read.parquet(stored)
    parts = [B.task_sets(samples, col, ["path", "packet_no"], 0.2, under_sampling=True).withColumn("task", F.lit(t)) for t, col in TASKS.items()]
    return parts[0].unionByName(parts[1]).groupBy("task", "split", "label").agg(
        F.count("*").alias("n"), F.sum("packet_no").cast("bigint").alias("packet_sum"))
