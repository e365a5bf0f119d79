from pyspark.sql import Window
from pyspark.sql import functions as F

from tables import SF_SMALL
from wirefold.operators import sampling as B
from wirefold.session import read_table


def orders(spark):
    return read_table(spark, SF_SMALL, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))


def keys(df, col="o_orderkey"):
    return sorted(r[0] for r in df.select(col).collect())


def test_split_is_a_partition_and_partition_independent(spark):
    o = orders(spark)
    train, test = B.train_test_split(o, "o_orderkey", "label", 0.2)
    a, b = keys(train), keys(test)
    assert not set(a) & set(b) and sorted(a + b) == keys(o)
    train2, test2 = B.train_test_split(o.repartition(7, "label"), "o_orderkey", "label", 0.2)
    assert keys(test2) == b and keys(train2) == a
    assert 0.1 < len(b) / (len(a) + len(b)) < 0.3


def test_undersampled_classes_equal_minimum(spark):
    o = orders(spark)
    u = B.undersample(o, "o_orderkey", "label")
    counts = {r.label: r["count"] for r in B.label_counts(u).collect()}
    m = min(r["count"] for r in B.label_counts(o).collect())
    assert set(counts.values()) == {m} and len(counts) == 3


def test_top_n_equals_window_brute_force(spark):
    li = read_table(spark, SF_SMALL, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    k = ["l_orderkey", "l_linenumber"]
    h1, h2 = B.hash_words(k)
    for n in (1, 3, 40, 10_000):
        fast = B.top_n_per_group(li, "l_suppkey", n, k)
        w = Window.partitionBy("l_suppkey").orderBy(h1, h2, *k)
        brute = li.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
        cols = ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"]
        assert sorted(map(tuple, fast.select(cols).collect())) == sorted(map(tuple, brute.select(cols).collect()))


def test_per_label_fractions_and_ids(spark):
    o = orders(spark)
    s = B.stratified_sample(o, "o_orderkey", "label", {"F": 0.0, "O": 1.0, "P": 0.5})
    labels = {r.label for r in s.select("label").distinct().collect()}
    assert "F" not in labels and "O" in labels
    n_o = o.where("label = 'O'").count()
    assert s.where("label = 'O'").count() == n_o
    ids = spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey long")
    train, test = B.split_by_ids(o, ids, "o_orderkey")
    assert train.count() + test.count() == o.count()


def test_top_n_with_a_hot_group(spark):
    """One group holds about a third of all rows; the result still equals the brute-force window."""
    li = read_table(spark, SF_SMALL, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    g = F.when(F.col("l_linenumber") <= 2, F.lit(-1)).otherwise(F.col("l_suppkey")).alias("g")
    d = li.select(g, "l_orderkey", "l_linenumber")
    k = ["l_orderkey", "l_linenumber"]
    h1, h2 = B.hash_words(k)
    w = Window.partitionBy("g").orderBy(h1, h2, *k)
    for n in (7, 1500):
        fast = B.top_n_per_group(d, "g", n, k)
        brute = d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
        assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, brute.select(fast.columns).collect()))
    hot = d.where("g = -1").count()
    assert hot > d.count() / 4


def test_top_n_zero_null_groups_and_absent_groups(spark):
    rows = [("a", i) for i in range(60)] + [(None, i) for i in range(100, 140)] + [("b", i) for i in range(200, 203)]
    df = spark.createDataFrame(rows, "g string, k long")

    def ranked(limits):
        h1, h2 = B.hash_words("k")
        w = Window.partitionBy("g").orderBy(h1, h2, "k")
        ranks = df.withColumn("rn", F.row_number().over(w)).collect()
        return sorted(((r.g, r.k) for r in ranks if r.rn <= limits.get(r.g, 0)), key=str)

    for few in (True, False):
        for n in (0, -1, 1, 5, 45, 100):
            got = sorted(((r.g, r.k) for r in B.top_n_per_group(df, "g", n, "k", few_groups=few).collect()), key=str)
            assert got == ranked({"a": n, None: n, "b": n})
        n = spark.createDataFrame([("a", 7), (None, 0), ("missing", 3)], "g string, n long")
        got = sorted(((r.g, r.k) for r in B.top_n_per_group(df, "g", n, "k", few_groups=few).collect()), key=str)
        assert got == ranked({"a": 7})


def test_top_n_is_lazy_and_ranks_few_rows(spark):
    """No job runs before an action, and only the rows around the cut reach the window; rows of one key are ranked all."""
    df = spark.range(60_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("top-n-plan", "")
    out = B.top_n_per_group(df, "g", 5_000, "k", few_groups=True)
    assert not jobs("top-n-plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.g: r["count"] for r in out.groupBy("g").count().collect()} == {"a": 5_000, "b": 5_000}
    same = spark.range(900).select(F.lit(1).alias("k"), F.col("id").alias("v"), F.lit("a").alias("g"))
    assert B.top_n_per_group(same, "g", 100, ["k"]).count() == 100


def test_undersampling_does_not_deal_rows_by_label_alone(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 8, "x").when(F.col("id") % 10 == 8, "y").alias("label"))
    out = B.undersample(df, "k")
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {"x": 2000, "y": 2000, None: 2000}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
