"""One key holds more than a third of the rows: sliced scans must equal the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwatch.operators import changes, fetchlog, health, request_dedupe, responses, versions
from shelfwatch.operators.ordered import (
    SLICE, OrderedScan, Slicing, find_cuts, last_known, position, previous, running_max, running_min, running_sum, with_slice,
)
from shelfwatch.sources import tables

SMALL = Slicing(slice_rows=40, max_slices=1000)


@pytest.fixture(scope="module")
def skewed(spark):
    """1,500 rows, 'hot' has 60 % of them, many at the same instant."""
    rng = np.random.default_rng(7)
    n = 1500
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.6, "hot", [f"cold{v}" for v in rng.integers(0, 40, n)]),
        "t": rng.integers(0, 60, n) // 7,
        "seq": rng.permutation(n),
        "v": rng.integers(-5, 6, n),
    })
    rows = spark.createDataFrame(pdf).withColumn("maybe", F.when(F.col("v") > 2, F.col("v")))
    return rows.repartition(5).cache()


def test_cuts_split_the_hot_key_evenly_even_within_one_instant(skewed):
    cuts = find_cuts(skewed, ["k"], ["t", "seq"], SMALL)
    assert [r["k"] for r in cuts.table.collect()] == ["hot"]
    sizes = with_slice(skewed, ["t", "seq"], cuts).where(F.col(SLICE).isNotNull()).groupBy(SLICE).count().collect()
    assert len(sizes) > 15
    assert max(r["count"] for r in sizes) <= 2 * SMALL.slice_rows


def test_no_hot_key_means_no_cuts(skewed):
    assert find_cuts(skewed, ["k"], ["t", "seq"]) is None
    assert find_cuts(skewed, ["k", "t", "seq"], ["t", "seq"], SMALL) is None


def test_every_scan_equals_the_plain_window(skewed):
    cuts = find_cuts(skewed, ["k"], ["t", "seq"], SMALL)
    v, maybe = F.col("v"), F.col("maybe")
    scan = OrderedScan(skewed, ["k"], ["t", "seq"], cuts)
    scan.add(
        total=running_sum(v), lo=running_min(v), hi=running_max(maybe), nth=position(),
        before=previous(F.struct("seq", "maybe")), known=last_known(maybe),
    )
    scan.add(twice=running_sum(F.col("total")))
    w = Window.partitionBy("k").orderBy("t", "seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.select(
        "*", F.sum(v).over(run).alias("total"), F.min(v).over(run).alias("lo"), F.max(maybe).over(run).alias("hi"),
        F.row_number().over(w).cast("bigint").alias("nth"), F.lag(F.struct("seq", "maybe")).over(w).alias("before"),
        F.last(maybe, True).over(run).alias("known"),
    ).withColumn("twice", F.sum("total").over(run))
    ours = scan.result().select(*plain.columns)
    assert ours.exceptAll(plain).isEmpty() and plain.exceptAll(ours).isEmpty()


def _same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def hot_records(spark, sf_dir):
    """The records with two thirds of them moved to one item."""
    rec = tables.records(spark, sf_dir)
    item = F.when(F.col("seq") % 3 != 0, F.lit(7)).otherwise(F.col("item_id")).cast("bigint")
    return versions.with_content_fp(rec.withColumn("item_id", item)).cache()


def test_version_diff_with_a_hot_item(hot_records):
    def flow(cuts):
        kept = versions.first_versions(hot_records, cuts=cuts)
        return changes.diff_events(versions.version_pairs(kept, changes.FIELDS, cuts=cuts))

    cuts = find_cuts(hot_records, ["item_id"], versions.ORDER, SMALL)
    assert cuts is not None
    _same(flow(None), flow(cuts))


def test_consecutive_dedupe_and_as_of_with_a_hot_item(hot_records):
    cuts = find_cuts(hot_records, ["item_id"], versions.ORDER, SMALL)
    _same(versions.changed_versions(hot_records), versions.changed_versions(hot_records, cuts=cuts))
    probes = hot_records.select("item_id", "seq", F.col("fetched_at").alias("before")).withColumnRenamed("seq", "probe")
    seen = hot_records.select("item_id", F.col("fetched_at").alias("_time"), F.lit(1).alias("_kind"), "seq")
    deep = find_cuts(seen, ["item_id"], ["_time", "_kind", "seq"], SMALL)
    find = lambda c: versions.previous_before(probes, hot_records, "before", ["seq", "price"], cuts=c)
    _same(find(None), find(deep))


@pytest.fixture(scope="module")
def attempts(spark, sf_dir):
    log = tables.fetch_log(spark, sf_dir)
    source = F.when(F.col("seq") % 3 != 0, F.lit("src0")).otherwise(F.col("source_id"))
    return fetchlog.attempt_outcome(log.withColumn("source_id", source)).cache()


def test_log_scans_with_a_hot_source(spark, sf_dir, attempts):
    sources = tables.sources(spark, sf_dir).withColumn("qps", F.lit(0.0005))
    cuts = find_cuts(attempts, ["source_id"], fetchlog.LOG_ORDER, SMALL)
    assert cuts is not None
    _same(fetchlog.failure_streaks(attempts), fetchlog.failure_streaks(attempts, cuts))
    audit = fetchlog.rate_audit(attempts, sources)
    assert audit.count() > 0
    _same(audit, fetchlog.rate_audit(attempts, sources, cuts))
    _same(health.breaker_log(attempts), health.breaker_log(attempts, cuts=cuts))
    none = spark.createDataFrame([], "source_id string, daily_quota bigint")
    _same(health.pause_events(attempts, none), health.pause_events(attempts, none, cuts=cuts))
    dated = attempts.withColumn("day", fetchlog.local_day(F.col("ts"), "UTC"))
    tiny = Slicing(slice_rows=8, max_slices=1000)
    day_cuts = find_cuts(dated, ["source_id", "day"], fetchlog.LOG_ORDER, tiny)
    assert day_cuts is not None
    _same(fetchlog.quota_ledger(attempts, sources), fetchlog.quota_ledger(attempts, sources, cuts=day_cuts))


@pytest.mark.parametrize("ttl", [1, 600, 6 * 3600, 40 * 86400])
def test_request_dedupe_with_a_hot_request(attempts, ttl):
    fp = F.when(F.col("seq") % 4 != 0, F.lit("one")).otherwise(F.col("item_id").cast("string"))
    requests = request_dedupe.dedupe_input(attempts.withColumn("request_fp", fp))
    cuts = find_cuts(requests, request_dedupe.KEY, request_dedupe.ORDER, SMALL)
    assert cuts is not None
    _same(request_dedupe.request_dedupe(requests, ttl), request_dedupe.request_dedupe(requests, ttl, cuts))


def test_fingerprints_of_requests_are_worked_out_once(spark):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(seq):
        worked.add(1)
        return "one" if seq % 4 else "few"

    requests = spark.range(0, 400, 1, 2).select(
        F.lit("s").alias("source_id"), costly("id").alias("request_fp"), (F.col("id") * 1_000_000).alias("ts_us"), F.col("id").alias("seq"), (F.col("id") % 3 > 0).alias("ok"))
    cuts = find_cuts(requests, request_dedupe.KEY, request_dedupe.ORDER, SMALL)
    assert cuts is not None
    worked.value = 0
    assert request_dedupe.request_dedupe(requests, 20, cuts).count() == 400
    assert worked.value == 400


def test_forgetful_dedupe_with_a_hot_content(hot_records):
    # every third record of the hot item repeats one content
    same_content = F.when(F.col("seq") % 3 == 1, F.lit("same")).otherwise(F.col("content_fp"))
    rows = hot_records.withColumn("content_fp", same_content)
    asked = rows.select(
        F.col("item_id").cast("string").alias("source_id"), F.col("content_fp").alias("request_fp"),
        F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("ts_us"), "seq",
    )
    cuts = find_cuts(asked, request_dedupe.KEY, request_dedupe.ORDER, SMALL)
    assert cuts is not None
    plain = versions.versions_within(rows, 30)
    assert 50 < plain.where("content_fp = 'same'").count() < 120
    _same(plain.select("item_id", "seq"), versions.versions_within(rows, 30, cuts=cuts).select("item_id", "seq"))


def test_busy_cycle_is_split_into_full_parts(hot_records):
    kept = versions.first_versions(hot_records)
    events = changes.diff_events(versions.version_pairs(kept, changes.FIELDS)).withColumns(
        {"role": F.lit("self"), "category": F.lit(""), "cycle_id": F.when(F.col("seq") % 3 != 0, "busy").otherwise("quiet")}
    )
    order = ["item_id", "seq", "check_no", "fetched_at"]
    cuts = find_cuts(events, ["cycle_id"], order, Slicing(200, 1000))
    plain = responses.events_bundle(events, order=order, max_events=50)
    cut = responses.events_bundle(events, order=order, max_events=50, cuts=cuts)
    _same(plain, cut)
    sizes = cut.agg(F.max("event_count").alias("most"), F.sum("event_count").alias("all")).first()
    assert sizes["most"] == 50 and sizes["all"] == events.count()
