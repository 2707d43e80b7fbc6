"""Run the registered queries against their SQL: python tests/check_queries.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tests.comparing import compare, oracle_connection, local_session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main(sf: str = "0.01", *names: str) -> int:
    spark, sf_dir = local_session(), f"/root/testdata/sf{sf}"
    connection, sql, failed = oracle_connection(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            rows, problem = compare(query(spark, sf_dir), connection, sql.get(name))
        except Exception as error:  # noqa: BLE001
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "sql" if name in sql else "rows"
        print(f"{name:28s} {kind} {rows:8d} rows {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(*sys.argv[1:])))
