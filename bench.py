"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once as warm-up on the smallest data and is then timed once, written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """
RUL-1 RUL-3 RUL-8 RUL-10 RUL-13 RUL-17 RUL-19 FIL-1 FIL-2 JOI-1 JOI-4 JOI-9 JOI-10 JOI-11 JOI-13
AGG-1 AGG-2 AGG-3 AGG-7 AGG-13 AGG-15 AGG-18 AGG-24 AGG-25 AGG-26 AGG-31 WIN-1 WIN-3 WIN-4 WIN-6 WIN-11 WIN-13
FEA-4 FEA-5 FEA-6 FEA-7 FEA-12 FEA-14 FEA-20 GEO-4 GEO-7 GEO-12 GEO-15 GRA-3 GRA-6 GRA-10 GRA-13 GRA-14 GRA-19
ANO-1 ANO-4 TXT-1 TXT-3 STR-1 STR-3 STR-9 STR-15 ML-4 ML-6 ML-9
""".split()


def rule_scoring_rows(spark, sf: str) -> tuple[int, float]:
    """Batch rule scoring over about a million rows: the one published throughput figure."""
    from pyspark.sql import functions as F

    from ledgerwatch.adapters import Tables
    from ledgerwatch.operators import rules

    tx = Tables(spark, sf).tx.persist()
    copies = max(1, round(1_000_000 / max(tx.count(), 1)))
    many = tx.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    start = time.perf_counter()
    rules.score_batch(many).write.format("noop").mode("overwrite").save()
    spent = time.perf_counter() - start
    rows = tx.count() * copies
    tx.unpersist()
    return rows, spent


def main() -> None:
    from ledgerwatch import plans
    from ledgerwatch.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus=cpus, shuffle_partitions=cpus, memory=os.environ.get("BENCH_MEMORY", "16g"))
    queries = plans.queries()
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for key in ("RUL-1", "AGG-24", "FEA-4", "WIN-13"):
            queries[key](spark, small).write.format("noop").mode("overwrite").save()
    times, failed = {}, {}
    for key in wanted:
        start = time.perf_counter()
        try:
            queries[key](spark, sf).write.format("noop").mode("overwrite").save()
            times[key] = round(time.perf_counter() - start, 3)
        except Exception as error:  # noqa: BLE001
            failed[key] = str(error)[:200]
    rows, spent = rule_scoring_rows(spark, sf)
    print(
        json.dumps(
            {
                "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("sf")[-1],
                "cpus": cpus, "failed": failed,
                "rule_scoring": {"rows": rows, "sec": round(spent, 3), "rows_per_sec": round(rows / spent)},
            }
        )
    )


if __name__ == "__main__":
    main()
