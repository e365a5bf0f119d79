"""Keyed-hash stratified split, class balancing, task sets.

Randomness comes from ``md5(key || ':' || seed)`` of a stable row key instead
of ``rand``/``sampleBy``/``monotonically_increasing_id``: the same rows are
chosen whatever the partitioning, after a retry, and in DuckDB.

* the split is a narrow predicate (no join, no shuffle);
* class counts are one partial aggregate;
* "first n rows per class in hash order" is exact and skew-safe: the hash is
  uniform, so a class's size tells nearly where its cut lies; one count checks
  that, and only the rows around the cut are ranked with a window.  The plan is
  lazy; a table of few classes is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirefold.operators.labels import TASKS

# Fixed value: seed of the split and of the under-sampling order.
SEED = 9876
TWO_32 = 4294967296
SIGMAS = 7  # standard deviations around the expected cut of a group


def _key_list(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def key_text(key, seed: int = SEED) -> Column:
    """``k1:k2:...:seed`` — the same text in Spark and DuckDB for integer / string keys."""
    parts = [F.col(k).cast("string") for k in _key_list(key)] + [F.lit(str(seed))]
    return F.concat_ws(":", *parts)


def hash_words(key, seed: int = SEED) -> tuple[Column, Column]:
    """Two independent unsigned 32-bit words of ``md5(key_text)``."""
    m = F.md5(key_text(key, seed))
    h1 = F.conv(F.substring(m, 1, 8), 16, 10).cast("bigint")
    h2 = F.conv(F.substring(m, 9, 8), 16, 10).cast("bigint")
    return h1, h2


def hash_unit(key, seed: int = SEED) -> Column:
    """Uniform value in [0, 1) per key."""
    return hash_words(key, seed)[0] / F.lit(TWO_32)


def with_row_key(df: DataFrame, key=None, out: str = "row_key") -> DataFrame:
    """B1: stable row key; ``monotonically_increasing_id`` only when no key exists
    (then the split depends on partitioning, as ``sampleBy`` does)."""
    if key is None:
        return df.withColumn(out, F.monotonically_increasing_id())
    return df.withColumn(out, key_text(key, seed=0))


def label_fractions(df: DataFrame, label: str = "label", test_size: float = 0.2) -> DataFrame:
    """B2: one row per label with its test fraction (same fraction for every label)."""
    return df.select(label).distinct().withColumn("fraction", F.lit(float(test_size)))


def _fraction_col(df: DataFrame, label: str, fractions) -> tuple[DataFrame, Column]:
    if isinstance(fractions, (int, float)):
        return df, F.lit(float(fractions))
    if isinstance(fractions, dict):
        pairs = F.create_map(*[x for k, v in fractions.items() for x in (F.lit(k), F.lit(float(v)))])
        return df, F.coalesce(F.element_at(pairs, F.col(label)), F.lit(0.0))
    # DataFrame(label, fraction): one row per class; AQE broadcasts it when small.
    fr = fractions.select(F.col(label).alias("_fl"), F.col("fraction").alias("_fraction"))
    joined = df.join(fr, df[label].eqNullSafe(fr["_fl"]), "left").drop("_fl")
    return joined, F.coalesce(F.col("_fraction"), F.lit(0.0))


def stratified_flag(df: DataFrame, key, label: str = "label", fractions=0.2, seed: int = SEED,
                    out: str = "is_test") -> DataFrame:
    """Bernoulli sample per class by keyed hash — ``is_test`` when hash < fraction."""
    df2, frac = _fraction_col(df, label, fractions)
    h1, _ = hash_words(key, seed)
    res = df2.withColumn(out, h1 < frac * F.lit(TWO_32))
    return res.drop("_fraction") if "_fraction" in res.columns else res


def stratified_sample(df: DataFrame, key, label: str = "label", fractions=0.2, seed: int = SEED,
                      method: str = "hash") -> DataFrame:
    """The sampled rows. ``method='sampleBy'`` uses Spark's own (partition-dependent) sampler."""
    if method == "sampleBy":
        fr = fractions if isinstance(fractions, dict) else {
            r[0]: float(fractions) for r in df.select(label).distinct().collect()}
        return df.sampleBy(label, fr, seed)
    return stratified_flag(df, key, label, fractions, seed).where("is_test").drop("is_test")


def train_test_split(df: DataFrame, key, label: str = "label", test_size=0.2,
                     seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test), a partition of the input; no join, no shuffle."""
    flagged = stratified_flag(df, key, label, test_size, seed)
    return (flagged.where(~F.col("is_test")).drop("is_test"),
            flagged.where(F.col("is_test")).drop("is_test"))


def split_by_ids(df: DataFrame, ids: DataFrame, key: str, id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """B4 (given ids): test = rows whose key is listed, train = the rest."""
    idc = ids.select(F.col(id_col or key).alias(key)).distinct()
    return df.join(idc, key, "left_anti"), df.join(idc, key, "left_semi")


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class (partial aggregation before the shuffle)."""
    return df.groupBy(label).agg(F.count("*").alias("count"))


def min_label_count(df: DataFrame, label: str = "label") -> DataFrame:
    """Size of the smallest class, as a one-row DataFrame (stays lazy)."""
    return label_counts(df, label).agg(F.min("count").alias("min_count"))


def min_count_per_label(df: DataFrame, label: str = "label") -> DataFrame:
    """B6 as ``(label, n)``: every class paired with the smallest class size.

    The smallest size is one row, attached by a join on a constant.
    """
    counts = label_counts(df, label)
    least = counts.agg(F.min("count").alias("n")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(least), "_one").select(label, "n")


def _null_safe(left: DataFrame, right: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """Join on ``group`` with nulls equal; keeps the left columns of the key."""
    renamed = right.select(*[F.col(g).alias("_g_" + g) for g in group], *[c for c in right.columns if c not in group])
    on = [left[g].eqNullSafe(renamed["_g_" + g]) for g in group]
    return left.join(renamed, on, how).drop(*["_g_" + g for g in group])


def _bounds(sizes: DataFrame, group: list[str]) -> DataFrame:
    """Per group of ``_size`` rows two hash values between which the ``_n``-th smallest lies, unless hashes are very uneven.

    The share of rows below a hash value is the value over 2**32, give or take
    a few standard deviations; the bounds leave ``SIGMAS`` of them, and room for small groups.
    """
    room = F.lit(SIGMAS) * F.sqrt(F.col("_n") * (1 - F.col("_n") / F.col("_size"))) + 4 * SIGMAS
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / F.col("_size"))) * F.lit(float(TWO_32))
    return sizes.select(
        *group, "_n",
        F.when(F.col("_n") >= F.col("_size"), F.lit(TWO_32)).otherwise(at(F.col("_n") - room).cast("bigint")).alias("_lo"),
        F.when(F.col("_n") >= F.col("_size"), F.lit(TWO_32)).otherwise(F.ceil(at(F.col("_n") + room))).cast("bigint").alias("_hi"))


def top_n_per_group(df: DataFrame, group, n, key, seed: int = SEED, few_groups: bool = False) -> DataFrame:
    """The first ``n`` rows of each group in (hash, key) order — a seeded random top-n.

    ``n`` is an int or a DataFrame ``(group..., n)`` with one row per group.
    Equal to
    ``row_number() OVER (PARTITION BY group ORDER BY h1, h2, key) <= n``:
    null groups are a group, n <= 0 and groups that ``n`` doesn't list give no
    rows.  A lazy plan: group sizes give two hash bounds around each group's cut,
    a count checks them, rows below the lower one are taken as they are, and
    only those between them are ranked.  Where the count contradicts the bounds
    (rows that repeat one key) all rows of the group are ranked.

    ``few_groups`` says that the groups are few, like the labels of a task: their
    table is broadcast and no row is shuffled.  Else Spark chooses the joins.
    """
    group = _key_list(group)
    keys = _key_list(key)
    h1, h2 = hash_words(keys, seed)
    hashed = df.withColumns({"_h1": h1, "_h2": h2})
    sizes = hashed.groupBy(*group).agg(F.count("*").alias("_size"))
    if isinstance(n, int):
        sizes = sizes.withColumn("_n", F.lit(n).cast("bigint"))
    else:
        sizes = _null_safe(sizes, n.select(*group, F.col("n").cast("bigint").alias("_n")), group)
    table = F.broadcast if few_groups else (lambda t: t)
    guess = table(_bounds(sizes.where("_n > 0"), group))
    inside = _null_safe(hashed.select(*group, "_h1"), guess, group).groupBy(*group).agg(
        F.first("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
        F.count_if(F.col("_h1") < F.col("_lo")).alias("_below"), F.count_if(F.col("_h1") < F.col("_hi")).alias("_upto"))
    right = (F.col("_below") <= F.col("_n")) & ((F.col("_upto") >= F.col("_n")) | (F.col("_hi") >= TWO_32))
    cuts = inside.select(*group, F.when(right, F.col("_lo")).otherwise(0).alias("_lo"), F.when(right, F.col("_hi")).otherwise(TWO_32).alias("_hi"),
                         (F.col("_n") - F.when(right, F.col("_below")).otherwise(0)).alias("_need"))
    rows = _null_safe(hashed, table(cuts), group).where("_h1 < _hi")
    helpers = ["_h1", "_h2", "_lo", "_hi", "_need"]
    ranked = Window.partitionBy(*group).orderBy("_h1", "_h2", *keys)
    between = rows.where("_h1 >= _lo").withColumn("_rn", F.row_number().over(ranked)).where("_rn <= _need").drop("_rn")
    return rows.where("_h1 < _lo").unionByName(between).drop(*helpers)


def undersample(df: DataFrame, key, label: str = "label", seed: int = SEED) -> DataFrame:
    """Every class cut to the smallest class's size (hash order)."""
    return top_n_per_group(df, label, min_count_per_label(df, label), key, seed, few_groups=True)


def split_train_test(df: DataFrame, key, label: str = "label", test_size=0.2, under_sampling: bool = False,
                     seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """B4 + B8: stratified split, train optionally under-sampled."""
    train, test = train_test_split(df, key, label, test_size, seed)
    if under_sampling:
        train = undersample(train, key, label, seed)
    return train, test


def task_sets(df: DataFrame, label_col: str, key, test_size=0.2, under_sampling: bool = False,
              seed: int = SEED) -> DataFrame:
    """One task's rows with ``split`` in {train, test} (write with ``partitionBy('split')``).

    Without balancing this is one projection of one scan.  Balancing works on
    stored bytes where there are any, so that no vector is shuffled.
    """
    keys = _key_list(key)
    feat = "fbytes" if "fbytes" in df.columns else "feature"
    t = df.where(F.col(label_col).isNotNull()).select(*keys, feat, F.col(label_col).alias("label"))
    if not under_sampling:
        flagged = stratified_flag(t, keys, "label", test_size, seed)
        return flagged.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train")).drop("is_test")
    train, test = split_train_test(t, keys, "label", test_size, True, seed)
    return (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("split", F.lit("test"))))


def build_task_sets(df: DataFrame, label_col: str, out: str, key, test_size=0.2, under_sampling: bool = False,
                    seed: int = SEED, as_bytes: bool = False) -> str:
    """B9 + S11: write ``out/split=train`` and ``out/split=test`` in one job.

    With ``as_bytes`` samples that hold bytes are stored as they are (column
    ``fbytes``), a hundredth of the vectors; the models read them directly.
    """
    from wirefold.operators.features import with_feature

    sets = task_sets(df, label_col, key, test_size, under_sampling, seed)
    sets = sets if as_bytes else with_feature(sets)
    feature = "fbytes" if "fbytes" in sets.columns else "feature"
    sets.select(feature, "label", "split").write.mode("overwrite").partitionBy("split").parquet(out)
    return out


def build_both_task_sets(samples: DataFrame, out: str, key, test_size=0.2, under_sampling: bool = False,
                         seed: int = SEED, as_bytes: bool = False) -> dict[str, str]:
    """Application and traffic sets from one stored sample table."""
    paths = {}
    for task, col in TASKS.items():
        paths[task] = build_task_sets(samples, col, f"{out}/{task}", key, test_size, under_sampling, seed, as_bytes)
    return paths


def label_distribution(spark, path: str, split: str | None = None) -> DataFrame:
    """Rows per label of a stored set (partition-pruned to one split)."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.groupBy("label").agg(F.count("*").alias("count"))
