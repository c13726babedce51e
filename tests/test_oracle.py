"""Registered queries against their SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "M11_latest", "M13_template_minutes", "T1_dedup_spans", "T5_sessionize_batch", "A3_span_tree", "A6_ancestors", "A8_root_cause", "A12_explain", "A17_endpoint_stats", "A24_baseline_diff",
    "A28_span_self_ns", "L3_distinct_sequences", "D4_spike_baseline", "D7_spike_alerts", "D15_example_traces", "N3_delivery_outcome", "Q1_story_groups", "Q7_log_alerts", "Q8_log_templates", "Q12_service_graph", "Q13_overview", "Q11_service_map", "Q14_traces_search", "Q20_counter_rate", "Q20_rate_with_gaps", "Q21_gauge_of_replicas", "Q1_groups_of_service", "N5_webhook_payload",
    "N6_slack_payload", "U3_alert_activity", "U11_trace_rows", "A4_looped_roots", "A6_nested_intervals", "A21_refresh_baselines", "A25_error_stories", "D12_partition_states", "M2_otlp_logs",
    "M3_nested_values", "M8_undecodable", "M15_drop_expired", "M18_corpus_faults", "M22_verify_sample", "Q5_trace_story", "Q9_template_alerts", "Q20_rate_by_labels", "Q22_histogram_quantile",
    "T3_assemble_traces", "T6_event_time_sessions", "T8_analyze_stream", "U12_waterfall", "U13_waterfall_filter",
]


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, tables, name):
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    result = tables.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
