"""The registered queries: every operator applied to its whole input tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_url, content_fp, request_fp, short_fp, word_changes
from ..operators import changes, classify, cycles, fetchlog, health, incremental, request_dedupe, responses, versions
from ..operators.ordered import Cuts, Slicing, find_cuts
from ..sources import declarations, payloads, sinks, tables
from ..sources.committed import CommittedTables
from ..sources.version_store import BLOCK_CONTENTS, VersionStore
from ..streaming import health as streaming_health
from ..streaming import jobs, requests, windows
from .shared import stored

RETENTION_AS_OF = datetime(2001, 11, 4)
LOG_AS_OF = datetime(2024, 1, 31)
DEDUPE_TTL = 6 * 3600
# how the tables are replayed as streams: when the micro-batches end, and how late an attempt may be
RECORD_CUTS = ("1996-06-01", "1998-01-01", "2000-01-01")
LOG_CUTS = ("2024-01-07", "2024-01-13", "2024-01-19", "2024-01-25")
LATENESS = 3600
# a handful of files for seven years of records
STORE = {"buckets": 8, "blocks": 16, "period": "year"}
BUCKET_ROWS = 500_000
PROMPT = "Events of this cycle:\n{events}\nAnswer in JSON."


class Inputs:
    """Frames shared by the queries of one session and data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir
        # for tables of a few row groups, see ``tables.table``; the caller sets it, no size decides
        asked = spark.conf.get("shelfwatch.partitions", None)
        self.partitions = int(asked) if asked else None

    # ---- items ----
    @cached_property
    def records(self) -> DataFrame:
        return tables.records(self.spark, self.dir)

    @cached_property
    def targets(self) -> DataFrame:
        return tables.targets(self.spark, self.dir)

    @cached_property
    def positions(self) -> DataFrame:
        return tables.record_positions(self.spark, self.dir)

    @cached_property
    def item_cuts(self) -> Cuts | None:
        return find_cuts(self.positions, ["item_id"], versions.ORDER)

    @cached_property
    def kept(self) -> DataFrame:
        return versions.first_versions(self.records, cuts=self.item_cuts)

    @cached_property
    def pairs(self) -> DataFrame:
        return versions.version_pairs(self.kept, [*changes.FIELDS, "seq"], cuts=self.item_cuts)

    def written_pairs(self) -> DataFrame:
        """``pairs`` worked out once, for a query that writes several tables from them."""
        return stored(self.pairs)

    @cached_property
    def events(self) -> DataFrame:
        return changes.diff_events(self.pairs)

    @cached_property
    def events_with_role(self) -> DataFrame:
        return changes.with_role(self.events, self.targets)

    @cached_property
    def classified(self) -> DataFrame:
        return classify.with_category(changes.visible_events(self.events_with_role))

    def check(self, field: str, *columns: str) -> DataFrame:
        return changes.diff_events(self.pairs, [field]).select("item_id", "seq", "severity", *columns)

    # ---- fetch log ----
    @cached_property
    def log(self) -> DataFrame:
        return tables.fetch_log(self.spark, self.dir, self.partitions)

    @cached_property
    def log_positions(self) -> DataFrame:
        return self.log.select("source_id", "ts", "seq", "url", "ok")

    @cached_property
    def sources(self) -> DataFrame:
        return tables.sources(self.spark, self.dir)

    @cached_property
    def registered(self) -> DataFrame:
        return self.sources.where("enabled")

    @cached_property
    def declared(self) -> DataFrame:
        """The sources without one that the log has attempts of: it has the default policy."""
        return self.sources.where("source_id <> 'src7'")

    @cached_property
    def attempts(self) -> DataFrame:
        return fetchlog.attempt_outcome(self.log)

    @cached_property
    def source_cuts(self) -> Cuts | None:
        return find_cuts(self.log_positions, ["source_id"], fetchlog.LOG_ORDER)

    @cached_property
    def source_day_cuts(self) -> Cuts | None:
        days = self.log_positions.withColumn("day", fetchlog.local_day(F.col("ts"), "UTC"))
        return find_cuts(days, ["source_id", "day"], fetchlog.LOG_ORDER)

    @cached_property
    def requests(self) -> DataFrame:
        return self._requests(self.log)

    def _requests(self, log: DataFrame) -> DataFrame:
        return request_dedupe.dedupe_input(log.withColumn("request_fp", request_fp(canonical_url(F.col("url")))))

    @cached_property
    def deduped(self) -> DataFrame:
        cuts = find_cuts(self._requests(self.log_positions), request_dedupe.KEY, request_dedupe.ORDER)
        return request_dedupe.request_dedupe(self.requests, DEDUPE_TTL, cuts)

    # ---- cycles ----
    @cached_property
    def cycle_events(self) -> DataFrame:
        return self.classified.withColumn("cycle_id", cycles.cycle_of(F.col("fetched_at")))

    @cached_property
    def bundles(self) -> DataFrame:
        seen = self.positions.select(
            cycles.cycle_of(F.col("fetched_at")).alias("cycle_id"), "item_id", "seq", F.lit(0).alias("check_no")
        )
        order = ["item_id", "seq", "check_no"]
        cuts = find_cuts(seen, ["cycle_id"], order)
        return responses.events_bundle(self.cycle_events, order=order, max_events=50, cuts=cuts)

    @cached_property
    def cycle_attempts(self) -> DataFrame:
        fetched = self.records.select(
            "source_id", F.col("fetched_at").alias("ts"), F.lit(True).alias("ok"), F.lit(False).alias("cached")
        )
        hits = self.deduped.select(
            "source_id", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "ok", F.col("hit").alias("cached")
        )
        # a cached answer is a success whatever a fresh request would have brought
        both = fetched.unionByName(hits.withColumn("ok", F.col("ok") | F.col("cached")))
        return both.withColumn("cycle_id", cycles.cycle_of(F.col("ts")))

    @cached_property
    def cycle_report(self) -> DataFrame:
        owned = changes.with_role(self.pairs, self.targets)
        stored = changes.summarized(owned).withColumn("cycle_id", cycles.cycle_of(F.col("fetched_at")))
        return cycles.cycle_report(self.cycle_attempts, stored)

    @cached_property
    def parsed(self) -> DataFrame:
        return responses.parse_response(tables.responses(self.spark, self.dir, self.partitions)).drop("response")


Query = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


_EVENT = ("item_id", "source_id", "seq", "check_no", "field", "severity", "old_value", "new_value", "old_num", "new_num", "ratio")


# ---- change detection ----
@query
def diff_events(i: Inputs) -> DataFrame:
    return i.events.select(*_EVENT)


@query
def diff_events_exact(i: Inputs) -> DataFrame:
    return changes.diff_events(i.pairs, exact=True).select("item_id", "seq", "field", "severity")


@query
def diff_events_by_role(i: Inputs) -> DataFrame:
    return changes.visible_events(i.events_with_role).select(*_EVENT, "role")


@query
def event_texts(i: Inputs) -> DataFrame:
    return i.events.select("item_id", "seq", "field", "event")


@query
def version_pairs(i: Inputs) -> DataFrame:
    return i.pairs.select("item_id", "seq", F.col("prev.seq").alias("prev_seq"), F.col("prev.price").alias("prev_price"))


@query
def chg_status(i: Inputs) -> DataFrame:
    return i.check("listing_status", "old_value", "new_value", "event")


@query
def chg_price(i: Inputs) -> DataFrame:
    return i.check("price", "old_num", "new_num", "ratio")


@query
def chg_stock(i: Inputs) -> DataFrame:
    return i.check("stock", "old_value", "new_value", "ratio")


@query
def chg_image(i: Inputs) -> DataFrame:
    return i.check("main_image", "old_value", "new_value")


@query
def chg_title(i: Inputs) -> DataFrame:
    return i.check("title", "old_value", "new_value", "event")


@query
def chg_promotion(i: Inputs) -> DataFrame:
    return i.check("promotion", "old_value", "new_value")


@query
def chg_reviews(i: Inputs) -> DataFrame:
    return i.check("review_count", "old_value", "new_value")


@query
def chg_rating(i: Inputs) -> DataFrame:
    return i.check("rating", "old_num", "new_num")


@query
def title_words(i: Inputs) -> DataFrame:
    gained, lost = word_changes(F.col("prev.title"), F.col("title"))
    return i.pairs.where("prev IS NOT NULL").select(
        "item_id", "seq", F.array_join(gained, ",").alias("gained"), F.array_join(lost, ",").alias("lost")
    )


@query
def baselines(i: Inputs) -> DataFrame:
    return changes.baselines(i.pairs).select("item_id", "seq", "field", "severity", "new_value")


@query
def silent_versions(i: Inputs) -> DataFrame:
    # copies of a version that differ only in a field no check reads
    rec = i.records.withColumn("original_price", F.col("original_price") + (F.col("seq") % 2).cast("double"))
    kept = versions.first_versions(rec, cuts=i.item_cuts)
    pairs = versions.version_pairs(kept, changes.FIELDS, cuts=i.item_cuts)
    return changes.silent_versions(pairs).select("item_id", "seq")


@query
def top_severity(i: Inputs) -> DataFrame:
    return changes.top_severity(i.cycle_events, ["cycle_id"])


@query
def top_severity_overall(i: Inputs) -> DataFrame:
    return changes.top_severity(i.events_with_role)


@query
def severity_rollup(i: Inputs) -> DataFrame:
    return changes.severity_rollup(i.events_with_role)


# ---- versions ----
@query
def q_content_fp(i: Inputs) -> DataFrame:
    fps = i.records.select("item_id", content_fp().alias("fp"))
    return fps.groupBy("item_id").agg(F.count_distinct("fp").alias("contents"), F.count(F.lit(1)).alias("records"))


@query
def dedupe_versions(i: Inputs) -> DataFrame:
    return i.kept.select("item_id", "seq", "price", "stock", "title")


@query
def dedupe_consecutive(i: Inputs) -> DataFrame:
    return versions.changed_versions(i.records, cuts=i.item_cuts).select("item_id", "seq")


@query
def dedupe_within(i: Inputs) -> DataFrame:
    seen = versions.with_content_fp(i.records)
    asked = seen.select(
        F.col("item_id").cast("string").alias("source_id"), F.col("content_fp").alias("request_fp"),
        F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("ts_us"), "seq",
    )
    cuts = find_cuts(asked, request_dedupe.KEY, request_dedupe.ORDER)
    return versions.versions_within(seen, 180, cuts=cuts).select("item_id", "seq")


@query
def dedupe_incremental(i: Inputs) -> DataFrame:
    rec = versions.with_content_fp(i.records)
    border = F.lit("2000-01-01").cast("timestamp_ntz")
    known = versions.first_versions(rec.where(F.col("fetched_at") < border), cuts=i.item_cuts)
    fresh = versions.new_versions(rec.where(F.col("fetched_at") >= border), known, cuts=i.item_cuts)
    return fresh.select("item_id", "seq")


@query
def latest_snapshot(i: Inputs) -> DataFrame:
    return versions.latest(i.kept.select("item_id", "fetched_at", "seq", "price", "stock", "listing_status", "title")).drop("fetched_at")


@query
def asof_previous(i: Inputs) -> DataFrame:
    lines = tables.table(i.spark, i.dir, "lineitem")
    probes = lines.select(
        F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("probe_order"), F.col("l_linenumber").cast("bigint").alias("probe_line"),
        (F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber") - 4)).alias("before"),
    )
    seen = i.positions.select("item_id", F.col("fetched_at").alias("_time"), F.lit(1).alias("_kind"), "seq")
    cuts = find_cuts(seen, ["item_id"], ["_time", "_kind", "seq"])
    found = versions.previous_before(probes, i.kept.select("item_id", "fetched_at", "seq", "price"), "before", ["seq", "price"], cuts=cuts)
    return found.select("item_id", "probe_order", "probe_line", "prev_seq", "prev_price")


@query
def history_topn(i: Inputs) -> DataFrame:
    return versions.history(i.kept.select("item_id", "fetched_at", "seq", "price"), 5).select("item_id", "seq", "price", "nth")


@query
def recent_events(i: Inputs) -> DataFrame:
    order = ("detected_at", "seq", "item_id", "check_no")
    return versions.recent(i.events, 100, order).select("item_id", "seq", "check_no", "field", "severity")


@query
def retained(i: Inputs) -> DataFrame:
    return versions.retained(i.kept, RETENTION_AS_OF, 180).select("item_id", "seq")


@query
def expired_counts(i: Inputs) -> DataFrame:
    snaps = versions.expired_count(i.kept, RETENTION_AS_OF, 180).select(F.lit("snapshots").alias("kind"), "expired")
    gone = versions.expired_count(i.events, RETENTION_AS_OF, 180).select(F.lit("events").alias("kind"), "expired")
    return snaps.unionByName(gone)


# ---- payloads, declarations, snapshots ----
@query
def normalize_items(i: Inputs) -> DataFrame:
    return _records_of(payloads.normalize_items(tables.payloads(i.spark, i.dir, i.partitions)))


def _records_of(rec: DataFrame) -> DataFrame:
    return rec.select(
        "item_id", "source_id", "seq", "title", "price", "original_price", "stock", "listing_status", "main_image",
        "promotion", "review_count", "rating", F.array_join("sku_list", ",").alias("skus"),
    )


@query
def normalize_stored_items(i: Inputs) -> DataFrame:
    """Payloads parsed once when they are stored, and normalised from there."""
    folder = jobs.work_folder(i.spark, "payloads")
    payloads.parsed(tables.payloads(i.spark, i.dir, i.partitions)).write.parquet(folder)
    return _records_of(payloads.normalize_items(i.spark.read.parquet(folder)))


@query
def normalize_routed(i: Inputs) -> DataFrame:
    """Two adapters in one pass: one sends the item inside an object, the other the bare item."""
    known = payloads.Normalisers()
    known.register("bare_item", lambda payload, asked: payloads.item_record(F.concat(F.lit('{"item":'), payload, F.lit("}")), asked))
    bare = F.col("seq") % 2 == 1
    sent = tables.payloads(i.spark, i.dir, i.partitions).withColumns({
        "adapter": F.when(bare, "bare_item").otherwise("item_payload"),
        "payload": F.when(bare, F.substring("payload", F.lit(9), F.length("payload") - 9)).otherwise(F.col("payload")),
    })
    return _records_of(known.apply(sent, ["item_payload", "bare_item"]))


@query
def checked_declarations(i: Inputs) -> DataFrame:
    return declarations.checked_declarations(tables.declarations(i.spark, i.dir)).drop("place", "dedupe_ttl_seconds", "burst")


@query
def unwrap_envelope(i: Inputs) -> DataFrame:
    return payloads.unwrap_envelope(tables.envelopes(i.spark, i.dir, i.partitions))


@query
def sources_loaded(i: Inputs) -> DataFrame:
    return i.sources.where("enabled").select("source_id", "compliance", "daily_quota", "burst")


@query
def compliance_rejects(i: Inputs) -> DataFrame:
    return declarations.compliance_rejects(i.sources).select("source_id", "reason")


@query
def compliant_records(i: Inputs) -> DataFrame:
    return declarations.reject_noncompliant(i.records, i.sources).select("item_id", "seq", "source_id")


@query
def resolve_source(i: Inputs) -> DataFrame:
    sample = F.when(F.col("item_id") % 10 == 0, F.concat(F.lit("SAMPLE-"), F.col("item_id"))).otherwise(F.col("item_id").cast("string"))
    return declarations.resolve_source(i.targets.withColumn("item_id", sample), i.sources).select("item_id", "role", "source_id")


@query
def ttl_clamp(i: Inputs) -> DataFrame:
    return declarations.with_clamped_ttl(i.sources, 3600).select("source_id", "dedupe_ttl_seconds", "ttl_seconds")


@query
def to_snapshot(i: Inputs) -> DataFrame:
    """Equal contents, and no others, share a fingerprint: it names the content's smallest ``seq``."""
    snaps = sinks.to_snapshot(versions.with_content_fp(i.records))
    back = F.from_json("payload", "original_price double, sku_list array<string>")
    # out of a generator the payload is read once, and before the exchange, which then carries only what was in it
    read = snaps.select("item_id", "source_id", "seq", "title", "price", "stock", "rating", "content_fp", F.inline(F.array(back)))
    content = ["item_id", "content_fp"]
    if i.item_cuts is None:
        found = read.withColumn("first_seq", F.min("seq").over(Window.partitionBy(*content)))
    else:  # a content of a hot item may be too much for one task
        found = read.join(read.groupBy(*content).agg(F.min("seq").alias("first_seq")), content)
    return found.select(
        "item_id", "source_id", "seq", "title", "price", "stock", "rating", F.length("content_fp").alias("fp_chars"), "first_seq",
        F.col("original_price").alias("payload_original_price"), F.array_join("sku_list", ",").alias("payload_skus"),
    )


# ---- classification, answers, routing ----
@query
def events_with_role(i: Inputs) -> DataFrame:
    return i.events_with_role.select("item_id", "seq", "field", "role", "priority")


@query
def event_category(i: Inputs) -> DataFrame:
    return classify.with_category(i.events_with_role).select("item_id", "seq", "field", "role", "category")


@query
def event_actions(i: Inputs) -> DataFrame:
    acted = classify.with_action(i.classified, classify.action_templates(i.spark))
    return acted.select("item_id", "seq", "field", "category", "action")


@query
def parse_events_json(i: Inputs) -> DataFrame:
    return responses.parse_events_json(tables.event_documents(i.spark, i.dir, i.partitions)).select(
        "seq", "asked", "pos", "item_id", "role", "field", "old_num", "new_num", "category"
    )


@query
def events_bundle(i: Inputs) -> DataFrame:
    """Every event of every document, member by member."""
    members = "array<struct<item_id string, role string, severity string, field string, old_value string, new_value string, event string, category string>>"
    each = i.bundles.select("cycle_id", "part_no", "event_count", F.posexplode(F.from_json("events_json", members)).alias("pos", "e"))
    return each.select("cycle_id", "part_no", "event_count", "pos", "e.*")


@query
def prompt_rows(i: Inputs) -> DataFrame:
    prompts = responses.prompt_rows(i.bundles, PROMPT)
    return prompts.select("cycle_id", "part_no", F.md5(F.replace("prompt", F.col("events_json"), F.lit("<events>"))).alias("frame"), F.json_array_length("events_json").cast("bigint").alias("in_json"))


@query
def parse_response(i: Inputs) -> DataFrame:
    return i.parsed.select("seq", "summary", F.explode("events").alias("e")).select(
        "seq", "summary", "e.item_id", "e.severity", "e.priority_keep", "e.need_push", "e.attribution", "e.action", "e.priority_reason"
    )


@query
def need_push(i: Inputs) -> DataFrame:
    return i.parsed.select("seq", F.posexplode("events").alias("pos", "e")).select("seq", "pos", "e.need_push")


def _rollup(i: Inputs) -> DataFrame:
    return responses.push_rollup(i.parsed)


@query
def push_rollup(i: Inputs) -> DataFrame:
    return _rollup(i).withColumn("pushed_items", F.array_join("pushed_items", ","))


@query
def alerts(i: Inputs) -> DataFrame:
    return responses.alerts(_rollup(i)).withColumn("pushed_items", F.array_join("pushed_items", ","))


@query
def digest(i: Inputs) -> DataFrame:
    return responses.digest(_rollup(i))


@query
def rule_alerts(i: Inputs) -> DataFrame:
    return responses.rule_alerts(i.classified).select("item_id", "seq", "field", "category")


# ---- requests and fetch log ----
@query
def q_canonical_url(i: Inputs) -> DataFrame:
    pages = tables.table(i.spark, i.dir, "pages")
    return pages.select("page_id", canonical_url(F.col("url")).alias("canonical"))


@query
def q_request_fp(i: Inputs) -> DataFrame:
    fp = request_fp(canonical_url(F.col("url")))
    return i.log.select("seq", fp.alias("fp"), short_fp(fp).alias("short"))


@query
def q_request_dedupe(i: Inputs) -> DataFrame:
    return i.deduped.select("source_id", "seq", "hit")


@query
def classify_response(i: Inputs) -> DataFrame:
    return fetchlog.with_response_class(tables.http_answers(i.spark, i.dir, i.partitions)).select("seq", "anomaly")


@query
def classify_response_mended(i: Inputs) -> DataFrame:
    answers = tables.http_answers(i.spark, i.dir, i.partitions)
    return fetchlog.with_response_class(answers, fix_rate_codes=True).select("seq", "anomaly")


@query
def context_mismatch(i: Inputs) -> DataFrame:
    return fetchlog.context_mismatch(i.log).select("seq", "item_id", "returned_item_id")


@query
def attempt_outcome(i: Inputs) -> DataFrame:
    return i.attempts.select("source_id", "seq", "outcome")


@query
def audit_rows(i: Inputs) -> DataFrame:
    return fetchlog.audit_rows(i.attempts).drop("ts")


@query
def quota_ledger(i: Inputs) -> DataFrame:
    ledger = fetchlog.quota_ledger(i.log, i.declared, cuts=i.source_day_cuts)
    return ledger.select("source_id", "seq", "used", "over")


@query
def quota_days(i: Inputs) -> DataFrame:
    return fetchlog.quota_days(i.log, i.declared).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query
def rate_audit(i: Inputs) -> DataFrame:
    return fetchlog.rate_audit(i.log, i.sources, i.source_cuts).select("source_id", "seq")


@query
def failure_streaks(i: Inputs) -> DataFrame:
    return fetchlog.failure_streaks(i.attempts, i.source_cuts).select("source_id", "seq", "streak", "total_failures")


@query
def breaker_episodes(i: Inputs) -> DataFrame:
    return health.breaker_episodes(i.attempts, cuts=i.source_cuts).drop("ts")


def _source_slices(i: Inputs) -> Cuts | None:
    """Slices far smaller than a task's, so that every source of the log is cut."""
    return find_cuts(i.log_positions, ["source_id"], fetchlog.LOG_ORDER, Slicing(slice_rows=60, max_slices=200))


@query
def breaker_episodes_sliced(i: Inputs) -> DataFrame:
    return health.breaker_episodes(i.attempts, cuts=_source_slices(i)).drop("ts")


@query
def pause_events_sliced(i: Inputs) -> DataFrame:
    return health.pause_events(i.attempts, i.registered, cuts=_source_slices(i)).drop("ts")


@query
def request_dedupe_sliced(i: Inputs) -> DataFrame:
    cuts = find_cuts(i._requests(i.log_positions), request_dedupe.KEY, request_dedupe.ORDER, Slicing(slice_rows=2, max_slices=2000))
    return request_dedupe.request_dedupe(i.requests, DEDUPE_TTL, cuts).select("source_id", "seq", "hit")


@query
def rate_audit_sliced(i: Inputs) -> DataFrame:
    return fetchlog.rate_audit(i.log, i.sources, _source_slices(i)).select("source_id", "seq")


@query
def pause_events(i: Inputs) -> DataFrame:
    return health.pause_events(i.attempts, i.registered, cuts=i.source_cuts).drop("ts")


@query
def health_report(i: Inputs) -> DataFrame:
    cached = request_dedupe.cached_requests(i.deduped, DEDUPE_TTL)
    return health.health_report(i.attempts, i.registered, LOG_AS_OF, cuts=i.source_cuts, cached=cached)


@query
def cached_requests(i: Inputs) -> DataFrame:
    return request_dedupe.cached_requests(i.deduped, DEDUPE_TTL)


# ---- cycles ----
@query
def cycle_stats(i: Inputs) -> DataFrame:
    return cycles.cycle_stats(i.cycle_report)


@query
def cycle_results(i: Inputs) -> DataFrame:
    attempts = i.attempts.withColumn("cycle_id", cycles.cycle_of(F.col("ts")))
    return cycles.cycle_results(attempts, i.targets).drop("ts")


@query
def cycle_report(i: Inputs) -> DataFrame:
    return i.cycle_report.select("cycle_id", "fetched", "saved", "events", "top_severity", "elapsed_ms", "results")


# ---- stored versions and tables at rest ----
def _layout(i: Inputs) -> dict[str, int | str]:
    """A bucket holds the rows of one task and a block the contents it has room for, whatever the size of the table."""
    per_period = i.positions.groupBy(F.date_trunc(STORE["period"], F.col("fetched_at"))).count().collect()  # a row per year
    rows = [r["count"] for r in per_period]
    buckets, blocks = -(-sum(rows) // BUCKET_ROWS), -(-max(rows, default=0) // BLOCK_CONTENTS)
    return STORE | {"buckets": max(STORE["buckets"], buckets), "blocks": max(STORE["blocks"], blocks)}


@query
def diff_incremental(i: Inputs) -> DataFrame:
    border = F.lit("2000-01-01").cast("timestamp_ntz")
    store = VersionStore(i.records, jobs.work_folder(i.spark, "version-store"), **_layout(i))
    store.append(stored(versions.first_versions(i.records.where(F.col("fetched_at") < border), cuts=i.item_cuts)), 0)
    found = incremental.new_versions_of_batch(i.records.where(F.col("fetched_at") >= border), store, 1)
    return changes.diff_events(found.pairs).select(*_EVENT)


@query
def appended_tables(i: Inputs) -> DataFrame:
    """Snapshots, events and audit rows appended in two runs and read back."""
    folder = jobs.work_folder(i.spark, "at-rest")
    pairs = i.written_pairs()
    for early in (True, False):
        run = pairs.where((F.col("fetched_at") < F.lit("2000-01-01").cast("timestamp_ntz")) == early)
        sinks.append_snapshots(run.drop("prev"), f"{folder}/snapshots", "year", gather=False)
        sinks.append_events(changes.diff_events(run), f"{folder}/events", "year", gather=False)
    sinks.append_audit(fetchlog.audit_rows(i.attempts), f"{folder}/audit")
    back = {name: i.spark.read.parquet(f"{folder}/{name}") for name in ("snapshots", "events", "audit")}
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("at")
    rows = back["snapshots"].select(F.lit("snapshot").alias("kind"), F.col("item_id").cast("string").alias("key"), "seq", at("fetched_at"), F.col("listing_status").alias("what"))
    rows = rows.unionByName(back["events"].select(F.lit("event").alias("kind"), F.col("item_id").cast("string").alias("key"), "seq", at("detected_at"), F.concat_ws(":", "field", "severity").alias("what")))
    return rows.unionByName(back["audit"].select(F.lit("audit").alias("kind"), F.col("source_id").alias("key"), "seq", at("ts"), F.col("outcome").alias("what")))


@query
def retention_at_rest(i: Inputs) -> DataFrame:
    """Snapshots and events stored by month, expired, and what is left."""
    folder = jobs.work_folder(i.spark, "retention")
    pairs = i.written_pairs()
    sinks.append_snapshots(pairs.drop("prev"), f"{folder}/snapshots", "year", gather=False)
    sinks.append_events(changes.diff_events(pairs), f"{folder}/events", "year", gather=False)
    out = None
    for kind, time, column in (("snapshots", "fetched_at", "fetch_date"), ("events", "detected_at", "event_date")):
        deleted = sinks.drop_expired(i.spark, f"{folder}/{kind}", time, column, RETENTION_AS_OF, 180, "year")
        left = i.spark.read.parquet(f"{folder}/{kind}").agg(F.count(F.lit(1)).alias("left_rows"), F.sum("seq").alias("left_seq"))
        row = left.select(F.lit(kind).alias("kind"), F.lit(deleted).cast("bigint").alias("deleted"), "left_rows", "left_seq")
        out = row if out is None else out.unionByName(row)
    return out


# ---- streams: whole tables replayed as streams of several micro-batches ----
def _record_stream(i: Inputs, folder: str) -> DataFrame:
    return jobs.replayed(i.records, F.col("fetched_at"), RECORD_CUTS, f"{folder}/arriving", files=4, total=i.positions.count())


@query
def stream_version_diff(i: Inputs) -> DataFrame:
    folder = jobs.work_folder(i.spark, "version-diff")
    return jobs.version_diff(_record_stream(i, folder), folder, **_layout(i)).read("events").select(*_EVENT)


@query
def stream_tables(i: Inputs) -> DataFrame:
    """All tables of the version diff, read back after compaction, and the counters."""
    folder = jobs.work_folder(i.spark, "version-tables")
    done = jobs.version_diff(_record_stream(i, folder), folder, **_layout(i))
    by_time = dict.fromkeys(("snapshots", "events", "alerts", "late_records"), "fetched_at")
    done.compact({**by_time, "digest": None, "stats": None}, period="year", gather=False)
    counted = lambda name: done.read(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    digest = done.read("digest").agg(F.sum("events").alias("n")).select(F.lit("digest").alias("name"), "n")
    sums = done.read("stats").agg(*[F.sum(c).alias(c) for c in ("fetched", "saved", "late", "events")])
    stats = sums.unpivot([], list(sums.columns), "name", "n").select(F.concat(F.lit("counter_"), "name").alias("name"), "n")
    out = stats.unionByName(digest)
    for name in by_time:
        out = out.unionByName(counted(name))
    return out


@query
def stream_late_records(i: Inputs) -> DataFrame:
    """Every fifth record comes three months late: those no newer than the stored latest go aside."""
    folder = jobs.work_folder(i.spark, "late-records")
    arrives = F.when(F.col("seq") % 5 == 0, F.col("fetched_at") + F.make_ym_interval(F.lit(0), F.lit(3))).otherwise(F.col("fetched_at"))
    arriving = jobs.replayed(i.records, arrives, RECORD_CUTS[1:2], f"{folder}/arriving", files=4, total=i.positions.count())
    return jobs.version_diff(arriving, folder, **_layout(i)).read("late_records").select("item_id", "seq")


def _log_stream(i: Inputs, folder: str, late: Column | int = 0) -> DataFrame:
    """The fetch log in the order in which it arrives, ``late`` seconds after the attempt."""
    jobs.use_rocksdb(i.spark)
    arrives = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(late) if isinstance(late, int) else late)
    return jobs.replayed(i.log, arrives, LOG_CUTS, f"{folder}/arriving", total=i.log.count())


def _dedupe_stream(i: Inputs) -> tuple[DataFrame, str]:
    folder = jobs.work_folder(i.spark, "request-dedupe")
    hits = requests.request_dedupe_stream(i._requests(_log_stream(i, folder)), DEDUPE_TTL)
    return jobs.run_to_table(hits, f"{folder}/hits", f"{folder}/checkpoint"), f"{folder}/checkpoint"


@query
def stream_request_dedupe(i: Inputs) -> DataFrame:
    return _dedupe_stream(i)[0].select("source_id", "seq", "hit")


@query
def stream_request_state(i: Inputs) -> DataFrame:
    """How many requests are remembered after each micro-batch; the last one only moves the clock."""
    _, checkpoint = _dedupe_stream(i)
    out = None
    for batch in range(len(LOG_CUTS) + 2):
        held = requests.remembered(i.spark, checkpoint, batch).select(F.lit(batch).cast("bigint").alias("batch"))
        out = held if out is None else out.unionByName(held)
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("remembered"))


def _health_tables(i: Inputs, late: Column) -> CommittedTables:
    folder = jobs.work_folder(i.spark, "source-health")
    arriving = fetchlog.attempt_outcome(_log_stream(i, folder, late))
    streaming_health.start_source_health(arriving, f"{folder}/tables", f"{folder}/checkpoint", lateness_seconds=LATENESS).awaitTermination()
    done = CommittedTables(i.spark, f"{folder}/tables")
    streaming_health.finish_source_health(done)
    return done


def _out_of_order() -> Column:
    """Up to an hour late, each attempt differently."""
    return F.pmod(F.col("seq") * 7919, F.lit(LATENESS))


@query
def stream_source_health(i: Inputs) -> DataFrame:
    done = _health_tables(i, _out_of_order()).read("attempts")
    return done.select("source_id", "seq", "opened", "run_failures", "opens", "streak", "total_failures", "breaker", "paused")


@query
def stream_breaker_timers(i: Inputs) -> DataFrame:
    return _health_tables(i, _out_of_order()).read("transitions")


@query
def stream_late_attempts(i: Inputs) -> DataFrame:
    """Some attempts come two days late, behind the watermark."""
    late = F.when(F.col("seq") % 97 == 0, 2 * 86400).otherwise(_out_of_order())
    return _health_tables(i, late).read("late").select("source_id", "seq")


@query
def changes_per_day(i: Inputs) -> DataFrame:
    counts = windows.changes_per_window(i.events, width="1 day")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "severity", "changes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(Inputs(spark, sf_dir))) for name, fn in QUERIES.items()}
