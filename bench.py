"""Times headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Each query runs once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p11_c22_signal_summary_warehouse", "p11_c22_signal_summary_local", "a03_w05_market_sentiment_index_warehouse",
    "a05_j04_claim_audit_warehouse", "w01_w02_latest_headline_per_ticker", "p12_j18_active_signals",
    "p01_c01_c02_c06_normalize_headlines", "c11_g01_lexicon_scores_default_words", "u08_dedupe_by_content_hash",
    "a07_i01_i15_insights_of_last_window", "w17_p09_insights_of_every_day", "j10_asof_quote_fourteen_days_real_only",
    "j12_provider_fallback_chain", "j11_p19_p20_c19_evaluate_insights", "a08_u03_performance_summary",
    "b04_w13_buy_and_sell_orders_of_a_day", "j17_t07_portfolio_per_ticker", "h01_success_rules_over_all_runs",
    "j07_match_tickers_in_texts", "j08_policy_topics_standing", "s15_j13_insert_if_absent",
    "s17_s26_upsert_last_of_batch_wins",
]


def main() -> None:
    from checks import load
    from newsgauge.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    timings: dict[str, float] = {}
    for name in names:
        laps = []
        for lap in range(repeats + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if lap:
                laps.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(laps), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "runs": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
