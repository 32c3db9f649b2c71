"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Results are fully computed: small results are collected, large ones are
written to Spark's no-op sink so that driver transfer is not measured.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Headline queries: the analytics request, the chart request, ingest and
# quality over the messy text export, features and the forecast.
HEADLINE = (
    "kpis", "monthly_sales", "top_products", "region_sales", "category_sales",
    "weekly_sales", "daily_revenue", "analytics_payload", "chart_bundle", "summary_text",
    "normalize_sales", "validation_report", "features", "naive_metrics",
    "seasonal_naive_forecast", "forecast",
)
LARGE = {"normalize_sales", "features"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    from tillsight.plans import catalog
    from tillsight.session import build_session

    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalog.queries()
    # Warm-up on the smallest tables: JVM start, JIT and code generation are
    # not part of any query's time.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("kpis", "normalize_sales", "features"):
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    qs["monthly_sales"](spark, sf_dir).collect()

    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        df = qs[name](spark, sf_dir)
        if name in LARGE:
            df.write.format("noop").mode("overwrite").save()
        else:
            df.collect()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
