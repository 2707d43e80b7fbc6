"""Train, score and evaluate classifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame

from claimsieve.operators.learning import evaluate, fit_forest, fit_logistic, parts, score, stored_split
from claimsieve.staging import Workspace

_FIT = {"logistic": fit_logistic, "forest": fit_forest}
MODELS = tuple(_FIT)


@dataclass
class Trained:
    """``predictions`` is lazy; ``scored`` has label, raw prediction and prediction of each test row, staged."""

    model: Model
    predictions: DataFrame
    scored: DataFrame
    metrics: DataFrame


def train_and_score(
    processed: DataFrame,
    workspace: Workspace,
    models: Sequence[str] = MODELS,
    seed: int = 42,
    params: Mapping[str, Mapping] | None = None,
) -> dict[str, Trained]:
    """Fit every model on the same 70 % of the rows and evaluate it on the others.

    A stored table with a column ``_part`` has its parts already; else they are drawn and stored.
    ``params`` has further arguments of a model's fit. The scores, without their vectors, are
    staged, so that the metrics do not score twice.
    """
    train, test = parts(processed) if "_part" in processed.columns else stored_split(processed, workspace, seed=seed)
    trained = {}
    for name in models:
        arguments = dict((params or {}).get(name, {}))
        if name == "forest":
            arguments.setdefault("seed", seed)
        model = _FIT[name](train, **arguments)
        predictions = score(test, model)
        scored = workspace.stage(predictions.select("label", "rawPrediction", "prediction"), f"scored_{name}")
        trained[name] = Trained(model, predictions, scored, evaluate(scored, name, workspace.run_id))
    return trained
