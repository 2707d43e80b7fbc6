"""All stages in order, each handing a Parquet table to the next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from claimsieve.operators.drift import fit_spreads
from claimsieve.operators.learning import with_part
from claimsieve.operators.rules import label_distribution
from claimsieve.plans.artefacts import Artefacts
from claimsieve.plans.consolidate import consolidate_metrics
from claimsieve.plans.encode import encode_claims
from claimsieve.plans.label import label_claims
from claimsieve.plans.prepare import complete_claims, prepare_claims, stored_claims
from claimsieve.plans.profile import Profile, profile_claims
from claimsieve.plans.train import Trained, train_and_score
from claimsieve.schema import LABEL, QUANTILE_ERROR
from claimsieve.sources import append_metrics, read_stage, write_metric_file, write_stage
from claimsieve.staging import Workspace

# Metric file of each model, and the consolidated one.
METRIC_FILES = {"logistic": "lr_metrics.csv", "forest": "rf_metrics.csv"}
CONSOLIDATED = "consolidated_metrics.csv"


@dataclass
class Outcome:
    profile: Profile
    labelled: DataFrame
    processed: DataFrame
    trained: dict[str, Trained]
    labels: DataFrame
    metrics: DataFrame
    artefacts: Artefacts


def run_all(
    claims: DataFrame,
    output: str,
    workspace: Workspace,
    rel_err: float = QUANTILE_ERROR,
    include_flags: bool = True,
    seed: int = 42,
    with_spreads: bool = False,
) -> Outcome:
    """Prepare, profile, label, encode, train both models and consolidate their metrics.

    Two whole tables are written below ``output``: ``labelled``, which is the cleaned table and the label, and
    ``processed``, partitioned into the parts that the models are trained and tested on. What a
    later batch needs is saved in ``artefacts`` under the workspace's run; ``with_spreads`` adds, for two more passes
    over the measures, what a look at the batch's drift needs. Drop ``workspace``
    once the profile and the scores are no longer read.
    """
    spark = claims.sparkSession
    prepared = prepare_claims(claims, workspace, rel_err)
    write_stage(label_claims(prepared.cleaned), f"{output}/labelled")
    labelled = read_stage(spark, f"{output}/labelled")
    profile = profile_claims(labelled.drop(LABEL), workspace)
    vectors, encoder = encode_claims(labelled, workspace, include_flags)
    write_stage(with_part(vectors, seed=seed), f"{output}/processed", partition_by="_part")
    processed = read_stage(spark, f"{output}/processed")
    trained = train_and_score(processed, workspace, list(METRIC_FILES), seed)
    for model_name, file_name in METRIC_FILES.items():
        append_metrics(trained[model_name].metrics, f"{output}/metrics")
        write_metric_file(trained[model_name].metrics, f"{output}/{file_name}")
    consolidated = consolidate_metrics(spark, output, list(METRIC_FILES.values()), f"{output}/{CONSOLIDATED}")
    artefacts = Artefacts(encoder, {name: t.model for name, t in trained.items()}, prepared.medians, prepared.stats)
    if with_spreads:
        artefacts.spreads = fit_spreads(complete_claims(claims), rel_err=rel_err)
    artefacts.save(spark, f"{output}/artefacts", workspace.run_id)
    return Outcome(profile, labelled, processed, trained, label_distribution(labelled), consolidated, artefacts)


def run_files(spark: SparkSession, csv_path: str, output: str, workspace: Workspace, **options) -> Outcome:
    """The same from a claims CSV under its published column names, whose text is parsed once."""
    return run_all(stored_claims(spark, csv_path, workspace), output, workspace, **options)
