"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Panels: 1 series (all orders), 5 (order priority), 125 (nation x segment) and one per
supplier (1,000 at sf0.1).  Every query is run to the end with the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from checks.panels import orders_panel, supplier_panel, table, targets
from tidecast.operators import analogs, baselines, diagnostics, feedback, learners, smoothing
from tidecast.plans import features as pf
from tidecast.plans import forecast as plan
from tidecast.plans.presets import MODELS
from tidecast.session import local_session
from tidecast.sources.history import daily_rollup, materialise

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
THIRTY = tuple(f"2000-{m:02d}-{day:02d}" for m in (1, 3, 5, 7, 9, 11) for day in (1, 8, 15, 22, 28))


def one_series(spark, d):
    return daily_rollup(table(spark, d, "orders"), "o_orderdate", [F.lit("all")], F.floor(F.col("o_totalprice") / 1000))


def nation_segment(spark, d):
    facts = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return daily_rollup(facts, "o_orderdate", ["c_nationkey", "c_mktsegment"], F.floor(F.col("o_totalprice") / 1000))


def cross_validation(h):
    rows = learners.assemble(pf.feature_frame(h, "complete"), pf.model_features("complete"), "drop")
    rows = rows.select("series_id", "ds", "y", "raw").persist()
    return learners.ts_cv(rows, {"GBT": MODELS["complete"]["GradientBoosting"]}, 5)


def trained(h):
    """All fourteen models of a version, as its preset has them, and their forecasts."""
    models = plan.train(h, "complete")
    return plan.ml_predictions(models, h, targets(h, THIRTY))


def jobs(spark, d):
    """Roll facts up to a history table first, as a user would, then run on the tables."""
    h = {}

    def build(size, panel):
        def job():
            h[size] = materialise(panel(spark, d))
            return h[size]

        return job

    def on(size, fn, dates=THIRTY):
        return lambda: fn(h[size], targets(h[size], dates))

    def previous_year(many, t):
        return learners.union_all(plan.previous_year_part(many, t, "statistical"))

    return {
        "build_history_1": build(1, one_series),
        "build_history_5": build(5, orders_panel),
        "build_history_125": build(125, nation_segment),
        "build_history_1000": build(1000, supplier_panel),
        "features_125": lambda: pf.feature_frame(h[125], "enhanced"),
        "features_1000": lambda: pf.feature_frame(h[1000], "enhanced"),
        "window_models_1000": on(1000, lambda m, t: plan.window_part(m, t, "statistical")),
        "previous_year_1000": on(1000, previous_year),
        "weekday_mean_1000": on(1000, baselines.weekday_mean),
        "similar_days_125": on(125, analogs.similar_days),
        "pattern_match_125": on(125, analogs.pattern_match),
        "holt_winters_1000": on(1000, lambda m, t: smoothing.smooth(m, t, "hw_add")),
        "acf_1000": lambda: diagnostics.acf(h[1000]),
        "decompose_1000": lambda: diagnostics.decompose(h[1000]),
        "backtest_1000": lambda: feedback.backtest_corrected(feedback.backtest_base(h[1000])),
        "forecast_statistical_1": on(1, plan.forecast),
        "forecast_statistical_5": on(5, plan.forecast),
        "forecast_statistical_1000": on(1000, plan.forecast),
        "forecast_analogs_1000": on(1000, lambda m, t: plan.forecast(m, t, "enhanced")),
        "boosted_cv_125_100_rounds": lambda: cross_validation(h[125]),
        "train_complete_1": lambda: trained(h[1]),
    }


def main() -> None:
    spark = local_session(CPUS, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name, build in jobs(spark, SF_DIR).items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        start = time.time()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
