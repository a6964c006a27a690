"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores,
BENCH_QUERIES (comma separated) a subset. Every query is run in full into a no-op sink.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from moundwork.plans import catalog
from moundwork.session import build_session

HEADLINES = (
    "riskiest_pitchers", "pitches_to_appearances", "appearances_by_last_pitch", "pitch_with_appearance",
    "rolling_workload_by_game", "snapshot_rolling", "pregame_rolling", "time_rolling", "ewm",
    "breaking_ball_mix", "engineered_features", "spec_v2_features", "history_features", "snapshot_grid",
    "label_forward", "label_with_blackout", "last_n_before_injury", "healthy_appearances",
    "idempotent_load_pitches", "statcast_to_pitches", "parse_injury_text", "injury_elements", "dedup_best",
    "quality_report", "category_counts", "team_workload_pitchers", "compare_to_role", "top_k_percent",
    "cohort_percentile", "risk_assessment", "roc_auc_continuous", "rolling_origin_backtest", "alert_budget",
    "drift_ks", "stream_daily_appearances", "stream_alerts", "resolve_pitcher_id", "page_records", "fit_gbt_score_batch",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINES
    shared = tempfile.TemporaryDirectory(prefix="bench-")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": shared.name,
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    items = catalog.load()
    # The first query of a session also loads and compiles Spark's own code; that is not timed.
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    items[wanted[0]].run(spark, folder).limit(1).collect()
    spent: dict[str, float] = {}
    for name in wanted:
        begin = time.perf_counter()
        items[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()
    shared.cleanup()


if __name__ == "__main__":
    main()
