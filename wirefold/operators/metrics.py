"""M1-M5: confusion matrix, precision, recall, report, row-normalised matrix.

All inputs are ``(label, prediction)`` rows; the matrix is a partial
aggregate (k*k cells), the grid of classes is generated from the class
count, not from a join of data rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.operators.labels import label_name


def _grid(scored: DataFrame, label: str, prediction: str, num_classes: int | None) -> DataFrame:
    """All (label, prediction) cells 0..k-1, k given or max class id + 1."""
    if num_classes is not None:
        k = scored.sparkSession.range(1).select(F.lit(num_classes).alias("k"))
    else:
        k = scored.agg((F.greatest(F.max(label), F.max(prediction)) + 1).cast("int").alias("k"))
    rows = k.select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("label"), "k")
    return rows.select("label", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("prediction"))


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                     num_classes: int | None = None) -> DataFrame:
    """M1: ``(label, prediction, n)`` for every cell, zeros included; row = truth.

    Pairs outside of the grid, null labels or predictions among them, get
    cells of their own, so the cells always add up to the number of rows.
    """
    counts = scored.groupBy(F.col(label).cast("int").alias("label"),
                            F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    grid = _grid(scored, label, prediction, num_classes)
    cells = grid.withColumn("n", F.lit(0).cast("bigint")).unionByName(counts)
    return cells.groupBy("label", "prediction").agg(F.sum("n").cast("bigint").alias("n"))


def confusion_wide(matrix: DataFrame, num_classes: int) -> DataFrame:
    """M1 wide: one row per true label, one column ``p<j>`` per predicted class."""
    wide = matrix.groupBy("label").pivot("prediction", list(range(num_classes))).agg(F.sum("n"))
    return wide.select("label", *[F.coalesce(F.col(str(j)), F.lit(0)).cast("bigint").alias(f"p{j}")
                                  for j in range(num_classes)])


def class_report(matrix: DataFrame, task: str | None = None) -> DataFrame:
    """M2-M4: per class precision = tp / column sum, recall = tp / row sum (null when undefined)."""
    tp = matrix.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    rows = matrix.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("row_sum"))
    cols = matrix.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("col_sum"))
    rep = rows.join(cols, "cls", "full").join(tp, "cls", "left").where(F.col("cls").isNotNull()).select(
        "cls",
        F.try_divide(F.col("tp").cast("double"), F.when(F.col("col_sum") > 0, F.col("col_sum"))).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.when(F.col("row_sum") > 0, F.col("row_sum"))).alias("recall"))
    if task is None:
        return rep.withColumnRenamed("cls", "label")
    named = label_name(rep, task, "cls", "label")
    return named.select(F.coalesce("label", F.col("cls").cast("string")).alias("label"), "precision", "recall")


def confusion_normalised(matrix: DataFrame) -> DataFrame:
    """M5: cell / row sum; 0 where the row is empty. Window over the k*k matrix only."""
    w = Window.partitionBy("label")
    return matrix.select("label", "prediction", F.coalesce(
        F.try_divide(F.col("n").cast("double"), F.sum("n").over(w)), F.lit(0.0)).alias("share"))
