"""Streams replayed in several micro-batches must end where batch does."""

import shutil
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions.scalars import canonical_url, request_fp
from shelfwatch.operators import changes, fetchlog, health, request_dedupe, versions
from shelfwatch.operators.incremental import new_versions_of_batch
from shelfwatch.plans import queries
from shelfwatch.sources import tables
from shelfwatch.sources.committed import CommittedTables
from shelfwatch.sources.version_store import VersionStore
from shelfwatch.streaming import health as streaming_health
from shelfwatch.streaming import jobs, requests, windows
from shelfwatch.streaming.versions import write_versions


@pytest.fixture(scope="module")
def item_days(spark, sf_dir):
    """Records of some items (whole histories)."""
    rec = versions.with_content_fp(tables.records(spark, sf_dir))
    return rec.where(F.col("item_id") < 25).cache()


def in_files(frame, time, folder, parts=4):
    """Write a frame as ``parts`` files in time order."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = frame.select(F.min(at), F.max(at)).first()
    for n in range(parts):
        lo, hi = low + (high - low + 1) * n // parts, low + (high - low + 1) * (n + 1) // parts
        frame.where((at >= lo) & (at < hi)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(*a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


LAYOUT = {"buckets": 4, "blocks": 4, "period": "year"}


def test_version_diff_replay_equals_batch(spark, item_days, tmp_path):
    source = in_files(item_days, "fetched_at", str(tmp_path / "in"))
    done = jobs.version_diff(jobs.as_stream(spark, source), str(tmp_path / "out"), **LAYOUT)
    assert len(done.commits()) == 4
    kept = versions.first_versions(item_days)
    batch = changes.diff_events(versions.version_pairs(kept, changes.FIELDS)).cache()
    same(batch, done.read("events"))
    same(kept.select("item_id", "seq", "content_fp"), done.read("snapshots").select("item_id", "seq", "content_fp"))
    assert done.read("late_records").count() == 0
    urgent = batch.where("severity = 'P0'").count()
    assert done.read("alerts").count() == urgent
    assert done.read("digest").agg(F.sum("events")).first()[0] == batch.count() - urgent
    stats = done.read("stats").agg(F.sum("fetched"), F.sum("saved"), F.sum("late"), F.sum("events"), F.min("top_severity")).first()
    assert tuple(stats) == (item_days.count(), kept.count(), 0, batch.count(), "P0")


def test_forgetting_stream_equals_the_anchored_rule(spark, item_days, tmp_path):
    source = in_files(item_days, "fetched_at", str(tmp_path / "in"), parts=4)  # none longer than what is remembered
    done = jobs.version_diff(jobs.as_stream(spark, source), str(tmp_path / "out"), keep_days=800, **LAYOUT)
    kept = versions.versions_within(item_days, 800)
    assert kept.count() > versions.first_versions(item_days).count()
    same(kept.select("item_id", "seq"), done.read("snapshots").select("item_id", "seq"))


def record(price, hour, **more):
    return {"item_id": 1, "source_id": "s", "title": "t", "original_price": 1.0, "stock": 5, "listing_status": "on_sale",
            "main_image": "m", "promotion": "p", "review_count": 1, "rating": 4.5, "sku_list": ["a"],
            "price": price, "fetched_at": datetime(2024, 1, 1) + timedelta(hours=hour), "seq": hour, **more}


RECORD = ("item_id bigint, source_id string, title string, price double, original_price double, stock bigint, listing_status string, "
          "main_image string, promotion string, review_count bigint, rating double, sku_list array<string>, fetched_at timestamp_ntz, seq bigint")


def batches_of(spark, *batches):
    return [versions.with_content_fp(spark.createDataFrame([record(*r) for r in rows], RECORD)) for rows in batches]


def test_late_rows_go_aside_and_leave_history_alone(spark, tmp_path):
    source = str(tmp_path / "in")
    for frame in batches_of(spark, [(10.0, 0), (11.0, 10)], [(5.0, 3), (20.0, 20)], [(5.0, 30), (11.0, 31)]):
        frame.coalesce(1).write.mode("append").parquet(source)
    done = jobs.version_diff(jobs.as_stream(spark, source), str(tmp_path / "out"), **LAYOUT)
    events = done.read("events").orderBy("seq").collect()
    assert [(r["old_num"], r["new_num"]) for r in events] == [(10.0, 11.0), (11.0, 20.0)]
    assert [r["price"] for r in done.read("late_records").collect()] == [5.0]  # and its content counts as seen
    assert done.read("snapshots").count() == 3


class Died(Exception):
    pass


def test_a_batch_that_dies_and_runs_again_appears_once(spark, tmp_path, monkeypatch):
    first, second = batches_of(spark, [(10.0, 0)], [(11.0, 10), (12.0, 11)])
    store, done = VersionStore(first, str(tmp_path / "store"), **LAYOUT), CommittedTables(spark, str(tmp_path / "tables"))
    write_versions(first, 0, store, done)
    for dies_at in ("alerts", "store"):  # after the first tables, then between the commit and the store
        with monkeypatch.context() as m:
            if dies_at == "store":
                m.setattr(VersionStore, "append", lambda *a: (_ for _ in ()).throw(Died()))
            else:
                m.setattr("shelfwatch.streaming.versions.rule_alerts", lambda e: lambda: (_ for _ in ()).throw(Died()))
            with pytest.raises(Died):
                write_versions(second, 1, store, done)
        assert done.read("snapshots").count() == (1 if dies_at == "alerts" else 3)
    write_versions(second, 1, store, done)
    write_versions(second, 1, store, done)  # replayed once more
    write_versions(batches_of(spark, [(12.0, 20), (13.0, 21)])[0], 2, store, done)
    assert [r["price"] for r in done.read("snapshots").orderBy("seq").collect()] == [10.0, 11.0, 12.0, 13.0]
    assert [(r["old_num"], r["new_num"]) for r in done.read("events").orderBy("seq").collect()] == [(10.0, 11.0), (11.0, 12.0), (12.0, 13.0)]


def test_compaction_moves_each_row_once(spark, tmp_path):
    done = CommittedTables(spark, str(tmp_path / "t"))
    assert done.read("rows") is None and done.commits() == []
    for k in range(4):
        rows = spark.createDataFrame([(k, datetime(2024, 1, 1 + k // 2))], "n bigint, ts timestamp_ntz")
        assert done.write(k, {"rows": rows, "counts": lambda n=k: spark.range(n)})
    assert not done.write(2, {"rows": spark.range(9)})  # a replay of a committed batch
    spark.range(7).write.parquet(str(tmp_path / "t/rows/batch_9"))  # a batch that died before its commit
    for _ in range(2):
        done.compact({"rows": "ts", "counts": None})
    assert [(c.first, c.last) for c in done.commits()] == [(0, 2), (3, 3)]
    assert sorted(map(tuple, done.read("rows").collect())) == [(k, datetime(2024, 1, 1 + k // 2)) for k in range(4)]
    assert done.read("counts").count() == 6 and done.committed(1) and not done.committed(9)
    assert done.read_batch("rows", 3).count() == 1 and done.read_batch("rows", 0) is None


def stored_sides(plan):
    """The lines of a plan from a scan of a stored table up to the join that reads it."""
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "FileScan" in line and any(f"spark_catalog.default.{t}_" in line for t in ("latest", "contents", "filters")):
            above, level = [], depth(line)
            for k in range(at - 1, -1, -1):
                if depth(lines[k]) < level:
                    level = depth(lines[k])
                    above.append(lines[k])
                    if "Join" in lines[k]:
                        break
            yield above


def test_incremental_diff_equals_the_whole_and_leaves_the_stored_side_in_place(spark, item_days, tmp_path):
    border = F.lit("2000-01-01").cast("timestamp_ntz")
    store = VersionStore(item_days, str(tmp_path / "store"), buckets=16, blocks=4, period="year")
    old = versions.first_versions(item_days.where(F.col("fetched_at") < border))
    store.append(old, 0)
    batch = item_days.where(F.col("fetched_at") >= border)
    want = changes.diff_events(versions.version_pairs(versions.first_versions(item_days), changes.FIELDS)).where(F.col("fetched_at") >= border)
    for filtered in (True, False):
        found = new_versions_of_batch(batch, store, 1, filtered=filtered)
        same(want, changes.diff_events(found.pairs))
        assert found.late.isEmpty()
    firsts = versions.first_versions(batch).cache()
    asked, maybe = firsts.count(), store.maybe_known(firsts).count()
    known = store.known(firsts)
    assert known.count() <= maybe < asked / 2  # what goes to the exact join
    same(known, store.known(firsts, filtered=False))
    for frame, moves in ((known, ("Exchange", "Sort ")), (store.latest(firsts), ("Exchange", "Sort ")), (store.latest(), ("Exchange",))):
        sides = list(stored_sides(frame._jdf.queryExecution().executedPlan().toString()))
        assert sides and not [line for above in sides for line in above if any(m in line for m in moves)]
    again = VersionStore(item_days, str(tmp_path / "store"), buckets=16, blocks=4, period="year")  # as another application
    before = again.latest().collect()
    again.fold(1)
    again.append(found.pairs, 2)
    assert sorted(map(tuple, again.latest(before=2).collect())) == sorted(map(tuple, before))
    newest = versions.latest(versions.first_versions(item_days)).select("item_id", "seq")
    same(newest, again.latest().select("item_id", "seq"))
    store.close()
    again.close()


def contents_of(spark, first, last):
    """One content each of so many items, 2,500 a day."""
    rows = spark.range(first, last).withColumnRenamed("id", "item_id")
    day = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.floor(F.col("item_id") / 2500).cast("int"))
    return rows.select("item_id", F.sha2(F.col("item_id").cast("string"), 256).alias("content_fp"), day.alias("fetched_at"), F.col("item_id").alias("seq"))


def test_filters_of_many_periods_still_tell_contents_apart(spark, tmp_path):
    rows = contents_of(spark, 0, 25_000)
    store = VersionStore(rows, str(tmp_path / "store"), fields=(), buckets=2, blocks=1, period="day")
    store.append(rows, 0)
    assert store.maybe_known(rows).count() == 25_000
    assert store.maybe_known(contents_of(spark, 30_000, 40_000)).count() < 1_000
    # what is held in a task are few narrow columns of the batch, and no array of each row
    assert "array" not in store.maybe_known(rows)._jdf.queryExecution().optimizedPlan().toString().lower()
    store.close()


def test_a_store_without_bitmaps_gets_them(spark, tmp_path):
    rows = contents_of(spark, 0, 3_000)
    VersionStore(rows, str(tmp_path / "old"), fields=(), buckets=2, blocks=2, period="day").append(rows, 0)
    shutil.copytree(tmp_path / "old", tmp_path / "new", ignore=shutil.ignore_patterns("bitmaps"))
    store = VersionStore(rows, str(tmp_path / "new"), fields=(), buckets=2, blocks=2, period="day")
    same(store.known(rows, filtered=False), store.known(rows))
    assert store.known(rows).count() == 3_000


def test_a_batch_stores_one_latest_version_of_each_item(spark, tmp_path):
    batch = batches_of(spark, [(10.0 + n, n) for n in range(9)])[0]
    store = VersionStore(batch, str(tmp_path / "store"), **LAYOUT)
    store.append(batch, 0)
    assert [(r["price"], r["generation"]) for r in spark.table(store._latest).collect()] == [(18.0, 0)]
    assert spark.table(store._contents).count() == 9
    store.close()


def test_contents_known_come_back_only_after_keep_days(spark, tmp_path):
    first, second = batches_of(spark, [(10.0, 0), (11.0, 1)], [(10.0, 30), (11.0, 50), (12.0, 51)])
    store = VersionStore(first, str(tmp_path / "store"), **LAYOUT)
    store.append(versions.first_versions(first), 0)
    kept = lambda days: [(r["seq"], r["prev"]["price"]) for r in new_versions_of_batch(second, store, 1, keep_days=days).pairs.orderBy("seq").collect()]
    assert kept(None) == [(51, 11.0)] and kept(2) == [(50, 11.0), (51, 11.0)]
    store.close()


def test_the_store_grows_with_the_table(spark, sf_dir, monkeypatch):
    inputs = queries.Inputs(spark, sf_dir)
    assert queries._layout(inputs) == queries.STORE
    rows = inputs.positions.count()
    years = [r["count"] for r in inputs.positions.groupBy(F.year("fetched_at")).count().collect()]
    monkeypatch.setattr(queries, "BUCKET_ROWS", 100)
    monkeypatch.setattr(queries, "BLOCK_CONTENTS", 10)
    assert queries._layout(inputs) == queries.STORE | {"buckets": -(-rows // 100), "blocks": -(-max(years) // 10)}


def test_compaction_without_gathering_shuffles_nothing(spark, tmp_path):
    done = CommittedTables(spark, str(tmp_path / "t"))
    days = [datetime(2023 + k % 2, 1, 1 + k) for k in range(6)]
    for k in range(3):
        done.write(k, {"rows": spark.createDataFrame([(n, d) for n, d in enumerate(days)], "n bigint, ts timestamp_ntz").repartition(2)})
    jobs_before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    done.compact({"rows": "ts"}, keep_last=0, period="year", gather=False)
    assert [(c.first, c.last) for c in done.commits()] == [(0, 2)]
    assert sorted(map(tuple, done.read("rows").collect())) == sorted([(n, d) for n, d in enumerate(days)] * 3)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == jobs_before


def test_request_dedupe_replay_equals_batch(spark, sf_dir, tmp_path):
    log = tables.fetch_log(spark, sf_dir).withColumn("request_fp", request_fp(canonical_url(F.col("url"))))
    source = in_files(log, "ts", str(tmp_path / "in"))
    stream = requests.request_dedupe_stream(request_dedupe.dedupe_input(jobs.as_stream(spark, source)), 6 * 3600)
    hits = jobs.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    batch = request_dedupe.request_dedupe(request_dedupe.dedupe_input(log), 6 * 3600)
    same(batch, hits)
    held = [requests.remembered(spark, str(tmp_path / "ckpt"), b).count() for b in range(5)]
    successes = batch.where("ok").select("source_id", "request_fp").distinct().count()
    assert max(held) < successes / 2  # of 30 days; and after the last one all but six hours are forgotten
    end = batch.agg(F.max("ts_us")).first()[0]
    alive = batch.where(f"ok AND NOT hit AND ts_us + 21600000000 > {end}").select("source_id", "request_fp").distinct()
    same(alive, requests.remembered(spark, str(tmp_path / "ckpt"), 4).select("source_id", "request_fp"))


def test_source_health_out_of_order_equals_batch(spark, sf_dir, tmp_path):
    attempts = fetchlog.attempt_outcome(tables.fetch_log(spark, sf_dir))
    shuffled = attempts.withColumn("arrives", F.col("ts") + F.make_dt_interval(secs=F.pmod(F.col("seq") * 7919, F.lit(3600))))
    source = in_files(shuffled, "arrives", str(tmp_path / "in"))
    out = str(tmp_path / "out")
    arriving = jobs.as_stream(spark, source).drop("arrives")
    streaming_health.start_source_health(arriving, out, str(tmp_path / "ckpt"), lateness_seconds=3600).awaitTermination()
    done = CommittedTables(spark, out)
    held = done.read_batch("waiting", 3).count()
    assert len(done.commits()) == 4 and 0 < held < 20
    streaming_health.finish_source_health(done)
    log = health.breaker_log(attempts)
    same(log, done.read("attempts"))
    same(health.last_state(log), done.read_batch("states", 4).drop("last_us"))
    assert done.read("late").isEmpty() and done.read_batch("waiting", 4).isEmpty()
    assert done.read("transitions").count() > 50


def attempts_of(spark, *rows):
    schema = "source_id string, seq bigint, ts timestamp_ntz, outcome string"
    return spark.createDataFrame([(s, n, datetime(2024, 1, 1) + timedelta(seconds=t), o) for n, (s, t, o) in enumerate(rows)], schema)


def settled(done):
    """A batch's tables with their rows worked out."""
    return {name: t.sparkSession.createDataFrame(t.collect(), t.schema) for name, t in done.tables().items() if name in ("states", "waiting", "clock")}


def test_the_clock_degrades_a_silent_source(spark):
    wrong = ("a", 10, "auth_expired")  # opens at once, for 60 seconds
    at = lambda seconds: int(datetime(2024, 1, 1, tzinfo=UTC).timestamp() + seconds) * 1_000_000
    moves = lambda done: [(r["source_id"], r["at_us"]) for r in done.transitions.collect()]
    one = streaming_health.health_of_batch(attempts_of(spark, wrong, ("b", 15, "ok")), None)
    assert moves(one) == [] and one.waiting.count() == 1  # the newest attempt waits for the clock
    two = streaming_health.health_of_batch(attempts_of(spark, ("b", 300, "ok"), ("a", 5, "ok")), settled(one))
    assert moves(two) == [("a", at(70))] and [r["ts"].second for r in two.late.collect()] == [5]
    three = streaming_health.health_of_batch(attempts_of(spark, ("b", 400, "ok"), ("a", 390, "ok")), settled(two))
    assert moves(three) == []  # said once
    four = streaming_health.health_of_batch(attempts_of(spark, ("a", 410, "auth_expired"), ("a", 420, "ok"), ("b", 600, "ok")), settled(three))
    assert moves(four) == []  # closed before the cooldown ended
    none = streaming_health.health_of_batch(attempts_of(spark).limit(0), None)
    assert none.attempts.isEmpty() and moves(none) == []
    assert streaming_health.health_of_batch(attempts_of(spark, ("b", 1, "ok")), settled(none), last=True).attempts.count() == 1


def test_one_batch_equals_many(spark):
    rows = [("a", 10, "auth_expired"), ("a", 200, "auth_expired"), ("b", 30, "ok"), ("a", 250, "breaker_open"), ("a", 500, "ok"), ("b", 900, "ok")]
    whole = streaming_health.health_of_batch(attempts_of(spark, *rows), None, last=True)
    moves, before = [], None
    for n in range(len(rows)):
        part = attempts_of(spark, *rows).where(f"seq = {n}")
        done = streaming_health.health_of_batch(part, before, 1000, last=n == len(rows) - 1)
        moves += done.transitions.collect()
        before = settled(done)
    assert sorted(moves) == sorted(whole.transitions.collect()) and len(moves) == 2


def test_windows_of_a_stream_end_where_batch_does(spark, item_days, tmp_path):
    kept = versions.first_versions(item_days)
    events = changes.diff_events(versions.version_pairs(kept, changes.FIELDS)).cache()
    source = in_files(events, "fetched_at", str(tmp_path / "in"))
    counts = windows.changes_per_window(jobs.as_stream(spark, source), width="1 day", lateness="0 seconds")
    out = jobs.run_to_table(counts, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    batch = windows.changes_per_window(events, width="1 day")
    # append mode holds back the windows the watermark has not passed: only the last day may be missing
    open_windows = batch.join(out, ["window_start", "severity"], "left_anti").select("window_start").distinct().count()
    assert open_windows <= 1 and out.count() > 100
    assert out.exceptAll(batch).isEmpty()


def test_parts_of_a_replay_have_equally_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "FILE_ROWS", 2)
    rows = spark.createDataFrame([(n, datetime(2024, 1, 1 + n // 5)) for n in range(6)], "n bigint, ts timestamp_ntz")
    folder = str(tmp_path / "arriving")
    stream = jobs.replayed(rows, F.col("ts"), ("2024-01-02", "2024-01-03"), folder, total=6)
    assert len(spark.read.parquet(folder).inputFiles()) == 9  # three for each part, of five, one and no rows
    seen = []
    stream.writeStream.foreachBatch(lambda batch, _: seen.append(sorted(r["n"] for r in batch.collect()))).trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert seen == [[0, 1, 2, 3, 4], [5], []]
