import numpy as np
import pytest

from wirefold.operators import models as MO


def test_presets_and_unknown_names():
    assert MO.preset("cnn", "app")["output_dim"] == 17 and MO.preset("resnet", "traffic")["epochs"] == 40
    with pytest.raises(ValueError, match="no preset|must be"):
        MO.preset("cnn", "video")
    with pytest.raises(ValueError, match="no preset|must be"):
        MO.build_pipeline("app", "cnn", 3, head="tree")


def test_conv_features_same_and_valid_shapes():
    x = np.arange(20, dtype=float).reshape(2, 10) / 20
    k = MO.random_kernels([(4, 3), (5, 1)], 6)
    valid = MO.conv_features(x, k, "valid")
    same = MO.conv_features(x, k, "same")
    assert valid.shape == (2, 24) and same.shape == (2, 24)
    assert ((valid[:, 6:12] >= 0) & (valid[:, 6:12] <= 1)).all()  # positive shares
    assert (same >= 0).all()  # ReLU outputs
    again = MO.conv_features(x, MO.random_kernels([(4, 3), (5, 1)], 6), "valid")
    assert np.array_equal(valid, again)  # filters fixed by the seed


def test_nll_matches_mllib_log_loss(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    from tables import SF_SMALL
    from wirefold.functions import vectors as V
    from wirefold.session import read_table

    e = read_table(spark, SF_SMALL, "embeddings").select(
        array_to_vector(V.as_double_array("embedding")).alias("features"), F.col("label").cast("double"))
    scored = LogisticRegression(maxIter=10, family="multinomial").fit(e).transform(e)
    ours = (scored.select(vector_to_array("rawPrediction").alias("z"), "label")
            .select(V.log_softmax("z").alias("lp"), "label")
            .agg(F.avg(V.nll("lp", "label")).alias("loss")).first().loss)
    mllib = MulticlassClassificationEvaluator(metricName="logLoss").evaluate(scored)
    assert abs(ours - mllib) < 1e-9
