"""Time the headline jobs: prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the runs per job, of which
the best counts. Every job evaluates its whole result; the claims table is written once before.
"""

from __future__ import annotations

import json
import os
import sys
import time
from contextlib import contextmanager
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from claimsieve.catalog.claims_view import stages, table  # noqa: E402
from claimsieve.catalog.queries import queries  # noqa: E402
from claimsieve.functions import quantiles  # noqa: E402
from claimsieve.operators.rules import label_distribution  # noqa: E402
from claimsieve.plans.encode import encode_claims  # noqa: E402
from claimsieve.plans.label import label_claims  # noqa: E402
from claimsieve.plans.pipeline import run_all  # noqa: E402
from claimsieve.plans.prepare import prepare_claims  # noqa: E402
from claimsieve.plans.profile import profile_claims  # noqa: E402
from claimsieve.plans.train import train_and_score  # noqa: E402
from claimsieve.session import settings_for  # noqa: E402


QUARTILE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATALOG = ["s1_csv_scan", "a4_dedupe", "a6_describe_all", "m1_string_index", "m1_index_by_join", "m10_auc"]


def evaluate(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    size = sum(path.stat().st_size for path in Path(sf_dir).glob("*.parquet"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in settings_for(size, cpus).items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    s = stages(spark, sf_dir)
    start = time.time()
    s.claims()
    claims_seconds = time.time() - start
    s.raw_csv(), s.labelled(), s.processed()

    @contextmanager
    def scratch():
        workspace = s.scratch()
        yield workspace
        workspace.drop()

    def prepared_label(rel_err: float) -> None:
        with scratch() as workspace:
            cleaned = prepare_claims(s.claims(), workspace, rel_err).cleaned
            evaluate(label_distribution(label_claims(cleaned)))

    def prepared_table() -> None:
        with scratch() as workspace:
            workspace.stage(prepare_claims(s.claims(), workspace).cleaned, "cleaned")

    def profile() -> None:
        with scratch() as workspace:
            p = profile_claims(s.cleaned(), workspace)
            for df in (p.first_rows, p.rows, p.columns, p.nulls, p.mean_charge_by_type, p.rows_by_state, p.high_charges):
                evaluate(df)

    def encoded() -> None:
        with scratch() as workspace:
            workspace.stage(encode_claims(s.labelled(), workspace)[0], "processed")

    def trained(model: str) -> None:
        with scratch() as workspace:
            train_and_score(s.processed(), workspace, [model])

    def end_to_end() -> None:
        with scratch() as workspace:
            evaluate(run_all(s.claims(), workspace.location("out"), workspace).labels)

    jobs = {
        "prepare_label": lambda: prepared_label(0.01),
        "prepare_label_exact": lambda: prepared_label(0.0),
        "prepare_to_parquet": prepared_table,
        "profile": profile,
        "label": lambda: evaluate(label_claims(s.cleaned())),
        "encode_to_parquet": encoded,
        "logistic_fit_score_auc": lambda: trained("logistic"),
        "forest_fit_score_auc": lambda: trained("forest"),
        "end_to_end": end_to_end,
        "quartiles_4_columns": lambda: quantiles(
            table(spark, sf_dir, "lineitem").select(*QUARTILE_COLUMNS),
            QUARTILE_COLUMNS,
            [0.25, 0.75],
            0.01,
        ),
        **{name: lambda query=queries()[name]: evaluate(query(spark, sf_dir)) for name in CATALOG},
    }
    seconds = {}
    for name, job in jobs.items():
        times = []
        for _ in range(runs):
            start = time.time()
            job()
            times.append(time.time() - start)
        seconds[name] = round(min(times), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    result = {
        "metric": "total seconds of the headline jobs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
        "claims_rows": s.claims().count(),
        "claims_table_sec": round(claims_seconds, 3),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
