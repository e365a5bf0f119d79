import math

from pyspark.sql import functions as F

from wirefold.functions import vectors as V
from wirefold.operators import metrics as M
from wirefold.operators import scoring as SC


def test_confusion_cells_sum_and_report(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    cm = M.confusion_matrix(df)
    cells = {(r.label, r.prediction): r.n for r in cm.collect()}
    assert len(cells) == 9 and sum(cells.values()) == len(rows) and cells[(1, 1)] == 2
    rep = {r.label: (r.precision, r.recall) for r in M.class_report(cm).collect()}
    assert rep[0] == (1.0, 0.5) and rep[2][0] is None and rep[2][1] == 0.0
    norm = {(r.label, r.prediction): r.share for r in M.confusion_normalised(cm).collect()}
    assert norm[(0, 0)] == 0.5 and norm[(2, 1)] == 1.0
    named = {r.label for r in M.class_report(cm, task="app").collect()}
    assert named == {"AIM Chat", "Email", "Facebook"}


def test_vote_ties_smallest_and_empty_capture(spark):
    preds = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("b", 2), ("b", 0)], "path string, prediction int")
    v = {r.path: (r.n_packets, r.prediction) for r in SC.majority_vote(preds).collect()}
    assert v == {"a": (2, 1), "b": (3, 2)}
    caps = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    lab = {r.path: (r.n_packets, r.label) for r in SC.capture_labels(caps, preds, "app").collect()}
    assert lab["c"] == (0, None) and lab["a"] == (2, "Email")


def test_array_ops(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0, 4.0, -5.0],)], "a array<double>")
    r = df.select(V.conv1d("a", [1.0, 1.0], 1).alias("c"), V.max_pool1d("a", 2).alias("p"),
                  V.max_pool1d_same("a", 2).alias("ps"), V.conv1d_same("a", [1.0, 1.0, 1.0], 2).alias("cs"),
                  V.log_softmax("a").alias("ls"), V.argmax("a").alias("am"),
                  V.global_mean_pool("a").alias("m"), V.shortcut_add("a", "p").alias("sa")).first()
    assert r.c == [0.0, 1.0, 7.0, 0.0] and r.p == [1.0, 4.0] and r.am == 3
    assert r.ps == [1.0, 4.0, 0.0] and r.cs == [0.0, 5.0, 0.0]
    assert abs(sum(math.exp(x) for x in r.ls) - 1) < 1e-12 and r.m == 0.2
    assert r.sa == [1.0, -1.0, 7.0, 4.0, -5.0]
