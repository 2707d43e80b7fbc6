"""What a run learned, to prepare, encode and score a later batch."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession

from claimsieve.operators.cleaning import fill_medians, fill_unknown, normalise_text
from claimsieve.operators.drift import SHIFTED, Spread, drift, spreads_frame, spreads_from_frame
from claimsieve.operators.encoding import Encoder, label_as_double
from claimsieve.operators.learning import score
from claimsieve.operators.outliers import MeasureStats, flag_outliers, stats_frame, stats_from_frame
from claimsieve.operators.rules import add_charge_ratio, any_rule, cap_ratio, check_range, fraud_rules, label
from claimsieve.plans.prepare import complete_claims
from claimsieve.schema import MEASURES

_MODELS = {"logistic": LogisticRegressionModel, "forest": RandomForestClassificationModel}


@dataclass
class Artefacts:
    """The encoder, the models, and the medians and outlier statistics of the batch they came from.

    ``spreads`` of its measures, where they were asked for, allow to look for drift.
    """

    encoder: Encoder
    models: Mapping[str, Model]
    medians: Mapping[str, float | None]
    stats: list[MeasureStats]
    spreads: list[Spread] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str, run_id: str) -> None:
        """Save under ``run_id``; other runs below ``path`` stay. Saving a run again replaces it."""
        self.encoder.save(f"{path}/{run_id}/encoder")
        for name, model in self.models.items():
            model.write().overwrite().save(f"{path}/{run_id}/models/{name}")
        rows = [(c, m) for c, m in self.medians.items()]
        spark.createDataFrame(rows, "column string, median double").write.mode("overwrite").parquet(f"{path}/{run_id}/medians")
        stats_frame(spark, self.stats, run_id).write.mode("overwrite").parquet(f"{path}/{run_id}/statistics")
        if self.spreads:
            spreads_frame(spark, self.spreads, run_id).write.mode("overwrite").parquet(f"{path}/{run_id}/spreads")

    @classmethod
    def load(cls, spark: SparkSession, path: str, run_id: str, models: tuple[str, ...] = tuple(_MODELS), spreads: bool = False) -> Artefacts:
        """What ``save`` wrote; ``spreads`` are read if asked for, as a run may have been saved without."""
        return cls(
            Encoder.load(spark, f"{path}/{run_id}/encoder"),
            {name: _MODELS[name].load(f"{path}/{run_id}/models/{name}") for name in models},
            {r["column"]: r["median"] for r in spark.read.parquet(f"{path}/{run_id}/medians").collect()},
            stats_from_frame(spark.read.parquet(f"{path}/{run_id}/statistics"), run_id, MEASURES),
            spreads_from_frame(spark.read.parquet(f"{path}/{run_id}/spreads"), run_id) if spreads else [],
        )

    def prepare_batch(self, claims: DataFrame) -> DataFrame:
        """Claims of a later batch, filled, flagged, cleaned and labelled by the run's statistics.

        A projection and filters without shuffle. Copies stay, as whether a row is one depends on the batch alone.
        """
        filled = fill_unknown(fill_medians(complete_claims(claims), self.medians))
        flagged = add_charge_ratio(flag_outliers(normalise_text(filled), self.stats))
        return label(check_range(cap_ratio(flagged)), any_rule(fraud_rules()))

    def batch_drift(self, claims: DataFrame, limit: float = SHIFTED) -> DataFrame:
        """Per measure whether claims of a later batch, before anything is filled in, are spread like those of the run."""
        if not self.spreads:
            raise ValueError("the run was saved without spreads of its measures")
        return drift(complete_claims(claims), self.spreads, limit)

    def score_batch(self, prepared: DataFrame, model: str) -> DataFrame:
        """A prepared batch with its vectors and scores."""
        return score(self.encoder.transform(label_as_double(prepared)), self.models[model])
