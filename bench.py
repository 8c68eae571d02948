"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from catalog.scored import three  # noqa: E402
from catalog.views import P1  # noqa: E402
from gainsieve.operators import apply as matching  # noqa: E402
from gainsieve.operators import encode, metrics  # noqa: E402
from gainsieve.plans.miner import PatternMiner  # noqa: E402
from gainsieve.sources.workspace import Workspace  # noqa: E402


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    view = P1.frame(spark, sf)
    rows = view.select(*P1.features, "lab")
    n = rows.count()

    def fit(**params):
        return PatternMiner(label="lab", features=P1.features, **params).fit(rows)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    models = {}

    def keep(name, **params):
        models[name] = fit(**params)

    jobs = {
        "fit_bins5_len1": lambda: keep("l1"),
        "fit_auto_len1": lambda: keep("auto", bins=-1),
        "fit_bins5_len2": lambda: keep("l2", length=2),
        "fit_bins5_len3": lambda: keep("l3", length=3),
        "quantile_edges": lambda: encode.quantile_edges(rows, [*P1.ints, *P1.floats], 5, Workspace(spark)),
        "match_inline_len2": lambda: noop(models["l2"].match(rows).select("pids")),
        "match_inline_len3": lambda: noop(models["l3"].match(rows).select("pids")),
        "match_join_len3": lambda: noop(matching.match_join(models["l3"].row_items(view), models["l3"].patterns, P1.keys)),
        "metric_vector": lambda: metrics.metric_vector(three(spark, sf), Workspace(spark), n_classes=3).collect(),
        "metric_auc": lambda: metrics.auc_ovr(three(spark, sf), Workspace(spark)).agg(F.max("auc")).collect(),
    }
    fit()  # warm-up
    seconds = {}
    for name, job in jobs.items():
        taken = []
        for _ in range(repeats):
            start = time.time()
            job()
            taken.append(time.time() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, "rows": n}
        )
    )


if __name__ == "__main__":
    main()
