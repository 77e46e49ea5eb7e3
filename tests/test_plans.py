"""The shape of the physical plans: exchanges, pushed filters, pruned columns, no Python in the hot path."""

import re

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import changes, fetchlog, health, ordered, versions
from shelfwatch.plans.queries import QUERIES, Inputs


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return Inputs(spark, sf_dir)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning)", text)


def test_flagship_shuffles_records_once(inputs):
    text = plan(QUERIES["diff_events"](inputs))
    assert len(exchanges(text)) == 1 and "hashpartitioning(item_id" in text
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_hot_items_are_reduced_before_the_exchange(inputs):
    cuts = ordered.find_cuts(inputs.positions, ["item_id"], versions.ORDER, ordered.Slicing(5, 10000))
    kept = versions.first_versions(versions.with_content_fp(inputs.records), cuts=cuts)
    text = plan(kept)
    assert re.search(r"WindowGroupLimit .*Partial", text)
    assert "hashpartitioning(item_id" in text and "content_fp" in exchanges(text)[0]
    pairs = plan(versions.version_pairs(kept, changes.FIELDS, cuts=cuts))
    # the records themselves never meet by item alone; only the per-slice summaries do
    assert re.search(r"Window \[lag.*\], \[item_id#\d+L?, _slice#\d+\]", pairs)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cross_join_and_no_python_but_where_meant(inputs, name):
    text = plan(QUERIES[name](inputs))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ("dedupe_within", "request_dedupe", "request_dedupe_sliced", "cached_requests", "health_report", "cycle_stats", "cycle_report"):
        assert "Python" not in text and "InPandas" not in text


def test_single_partition_work_is_only_on_aggregated_rows(inputs):
    for name in QUERIES:
        if name.startswith("stream_"):
            continue
        text = plan(QUERIES[name](inputs))
        if "Exchange SinglePartition" in text:
            assert name in ("cycle_stats", "cycle_report", "expired_counts", "resolve_source", "retention_at_rest", "top_severity_overall"), name


def test_no_table_is_shuffled_before_its_keyed_work(inputs):
    for name, count in (("normalize_items", 0), ("classify_response", 0), ("attempt_outcome", 0), ("failure_streaks", 1)):
        assert plan(QUERIES[name](inputs)).count("Exchange hashpartitioning") == count, name


def test_sliced_breaker_log_grows_with_its_steps_only(inputs):
    cuts = ordered.find_cuts(inputs.log_positions, ["source_id"], fetchlog.LOG_ORDER, ordered.Slicing(60, 200))
    text = plan(health.pause_events(inputs.attempts, inputs.registered, cuts=cuts))
    # the log was read and written before; left are the last step's windows, its summary and the policy join
    assert "events.parquet" not in text and len(exchanges(text)) <= 5


def test_scans_are_pruned_and_filters_pushed(inputs):
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan(inputs.positions)).group(1)
    assert "l_extendedprice" not in read and "l_quantity" not in read
    rows = inputs.records.where(F.col("fetched_at") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    assert "GreaterThanOrEqual(l_shipdate,2001-06-01" in plan(rows)
    recent = plan(versions.recent(inputs.events, 10, ("fetched_at", "seq", "item_id", "check_no")))
    assert "TakeOrderedAndProject" in recent
    history = plan(versions.history(inputs.records.select("item_id", "fetched_at", "seq", "price"), 3))
    assert re.search(r"WindowGroupLimit .*Partial", history)


def test_snapshots_are_made_and_read_back_once(inputs):
    text = plan(QUERIES["to_snapshot"](inputs))
    assert exchanges(text) == [exchanges(text)[0]] and "hashpartitioning(item_id" in text
    assert text.count("lineitem.parquet") == 1 and text.count("from_json(") == 1


def test_pairs_are_worked_out_once_for_several_tables(spark, sf_dir, monkeypatch):
    for name in ("appended_tables", "retention_at_rest"):
        fresh, worked = Inputs(spark, sf_dir), []
        keep = versions.version_pairs
        monkeypatch.setattr(versions, "version_pairs", lambda *a, **k: worked.append(1) or keep(*a, **k))
        monkeypatch.setattr(Inputs, "events", property(lambda i: pytest.fail("worked out again")))
        assert QUERIES[name](fresh).count() > 0 and worked == [1]
        monkeypatch.undo()
