"""The registered queries: both engines on the smallest tables, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry
import checks
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["p11_c22_signal_summary_warehouse", "a03_w05_market_sentiment_index_warehouse", "a05_j04_claim_audit_warehouse", "w17_p09_insights_of_every_day",
          "j12_provider_fallback_chain", "a08_u03_performance_summary", "b04_w13_buy_and_sell_orders_of_a_day", "c11_c13_g01_lexicon_scores_own_words",
          "s09_w15_feed_documents", "s17_s26_upsert_last_of_batch_wins", "x07_daily_windows_with_watermark"]


def test_every_query_has_sql_for_it():
    assert set(checks.load()[0]) == set(checks.load()[1])
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, result.fetchall())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(entry.queries()["a03_w05_market_sentiment_index_warehouse"](spark, SF))
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("props" not in s for s in schemas)


@pytest.mark.parametrize("name", ["p11_c22_signal_summary_warehouse", "w17_p09_insights_of_every_day", "j11_p19_p20_c19_evaluate_insights", "j07_match_tickers_in_texts"])
def test_no_cartesian_products(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_signal_chain_shuffles_twice(spark):
    """Once for the daily aggregate, once for the ticker window; partial counts go first."""
    plan = plan_of(entry.queries()["p11_c22_signal_summary_warehouse"](spark, SF))
    assert plan.count("hashpartitioning") == 2
