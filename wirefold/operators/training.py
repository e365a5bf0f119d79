"""Training that stops when the loss stalls.

The MLlib perceptron is fitted epoch by epoch, each fit starting from the
weights of the one before.  After every epoch its training loss is recorded;
training ends when the best loss hasn't improved for ``patience`` epochs, and
the weights of the best epoch are kept.  An epoch is one Spark job of a few
optimiser steps over the whole data, so it grows with the data and the
weights are all that passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.sql import DataFrame

from wirefold.operators.sampling import SEED

PATIENCE = 5
STEPS = 5  # optimiser steps per epoch


@dataclass
class Training:
    """A fitted model, the loss after each epoch, the epoch it is from (1 the first), and whether the loss stalled."""

    model: MultilayerPerceptronClassificationModel
    losses: list[float] = field(default_factory=list)
    best_epoch: int = 0
    stalled: bool = False

    @property
    def best_losses(self) -> list[float]:
        """The best loss so far, after each epoch."""
        return [min(self.losses[:i + 1]) for i in range(len(self.losses))]


def fit_until_stalled(data: DataFrame, layers: list[int], epochs: int, patience: int = PATIENCE, min_delta: float = 0.0, steps: int = STEPS,
                      features: str = "conv", label: str = "label", seed: int = SEED) -> Training:
    """Fit a perceptron with the given ``layers`` on ``(features, label)`` rows for at most ``epochs`` epochs.

    A loss counts as better if it is lower than the best one by more than ``min_delta``.
    """
    if epochs < 1 or patience < 1:
        raise ValueError("epochs and patience must be at least 1")
    weights, best, result = None, float("inf"), None
    losses: list[float] = []
    waited = 0
    for epoch in range(1, epochs + 1):
        mlp = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers, maxIter=steps, seed=seed)
        if weights is not None:
            mlp = mlp.setInitialWeights(weights)
        model = mlp.fit(data)
        weights = model.weights
        losses.append(float(model.summary().objectiveHistory[-1]))
        if result is None or losses[-1] < best - min_delta:
            best, waited = losses[-1], 0
            result = Training(model, best_epoch=epoch)
        else:
            waited += 1
            if waited >= patience:
                result.stalled = True
                break
    result.losses = losses
    return result
