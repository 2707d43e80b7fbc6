"""Batch analytics over provider-by-procedure claims tables, on Spark."""

from claimsieve.plans.artefacts import Artefacts
from claimsieve.plans.consolidate import consolidate_metrics
from claimsieve.plans.encode import encode_claims
from claimsieve.plans.label import label_claims
from claimsieve.plans.pipeline import run_all, run_files
from claimsieve.plans.prepare import prepare_claims, stored_claims
from claimsieve.plans.profile import profile_claims
from claimsieve.plans.sample import sample_labelled
from claimsieve.plans.train import train_and_score
from claimsieve.staging import Workspace

__all__ = [
    "Artefacts",
    "Workspace",
    "consolidate_metrics",
    "encode_claims",
    "label_claims",
    "prepare_claims",
    "profile_claims",
    "run_all",
    "run_files",
    "sample_labelled",
    "stored_claims",
    "train_and_score",
]
