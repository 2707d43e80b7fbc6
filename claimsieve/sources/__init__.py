from claimsieve.sources.metrics import append_metrics, read_metric_files, read_metrics, write_metric_file
from claimsieve.sources.tables import (
    describe_schema,
    preview,
    read_claims,
    read_claims_checked,
    read_records,
    read_stage,
    read_strings,
    write_csv,
    write_stage,
)

__all__ = [
    "append_metrics",
    "describe_schema",
    "preview",
    "read_claims",
    "read_claims_checked",
    "read_metric_files",
    "read_metrics",
    "read_records",
    "read_stage",
    "read_strings",
    "write_csv",
    "write_metric_file",
    "write_stage",
]
