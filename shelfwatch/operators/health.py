"""Circuit-breaker episodes, automatic pauses and source health, rebuilt from the attempt log.

The log says what happened to each attempt, so the breaker's state needs no replay: failures since
the last success, breaker openings so far and triggers since the last resume are running totals.
That keeps the whole fold in windows that ``OrderedScan`` can slice, whatever a source's share.

Outcomes understood: 'ok'; an anomaly; 'breaker_open' (refused while open: counts towards the streak,
not the breaker); 'quota_exceeded' (pauses the source); 'resume' (an operator's restart); 'paused',
'throttled' and 'dedup' change nothing. A log without refusals is an audit: every attempt counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .fetchlog import LOG_ORDER, SOURCE, local_day, with_policy
from .ordered import Cuts, OrderedScan, last_known, previous, running_max, running_sum


@dataclass(frozen=True)
class BreakerPolicy:
    failure_threshold: int = V.BREAKER_FAILURES
    open_seconds: float = V.BREAKER_OPEN_SECONDS
    max_open_seconds: float = V.BREAKER_MAX_OPEN_SECONDS
    backoff_factor: float = V.BREAKER_BACKOFF
    pause_after_opens: int = V.PAUSE_AFTER_OPENS
    pause_after_failures: int = V.PAUSE_AFTER_FAILURES


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def cooldown_seconds(opens: Column, policy: BreakerPolicy) -> Column:
    # the exponent is held down because the result is capped anyway
    exponent = F.least(F.greatest(opens - 1, F.lit(0)), F.lit(1000)).cast("double")
    grown = F.lit(policy.open_seconds) * F.pow(F.lit(float(policy.backoff_factor)), exponent)
    return F.least(grown, F.lit(float(policy.max_open_seconds)))


STATE = ("run_failures", "streak", "total_failures", "opens", "breaker", "open_until_us", "paused", "pause_reason")


def breaker_log(
    attempts: DataFrame,
    policy: BreakerPolicy = BreakerPolicy(),
    cuts: Cuts | None = None,
    start: DataFrame | None = None,
) -> DataFrame:
    """Every attempt with the breaker and pause state right after it.

    ``start`` (source_id and the ``STATE`` columns, see ``last_state``) continues from earlier
    attempts; sources not in it start healthy.

    Adds run_failures (breaker failures since the last close), opens, opened, cooldown_s, open_until_us,
    breaker ('closed'/'open'/'half_open'), streak, total_failures, pause_trigger, paused, pause_reason
    (in which ``{limit}`` stands for the daily quota; ``pause_events`` and ``health_report`` fill it in).
    """
    kind = F.col("outcome")
    closes = kind.isin("ok", "resume")
    failed = kind.isin(*V.ANOMALIES)
    noted = failed | (kind == "breaker_open")
    weight = F.when(failed, F.when(kind.isin(*V.INSTANT_OPEN_ANOMALIES), policy.failure_threshold).otherwise(1)).otherwise(0)
    passed_gate = kind.isin("throttled", "quota_exceeded", "dedup")
    at = F.struct(*LOG_ORDER)

    rows = attempts
    if start is not None:
        # one row per source; Spark picks the join by its size
        rows = attempts.join(start.select(SOURCE, F.struct(*STATE).alias("_start")), SOURCE, "left")
    begin = (lambda name: F.col("_start")[name]) if start is not None else (lambda name: F.lit(None))
    carried = lambda name: F.coalesce(begin(name), F.lit(0))
    scan = OrderedScan(rows, [SOURCE], LOG_ORDER, cuts)
    scan = scan.add(_weight=running_sum(weight), _noted=running_sum(noted.cast("int")))
    scan = scan.add(
        _weight_closed=running_max(F.when(closes, F.col("_weight"))),
        _noted_closed=running_max(F.when(closes, F.col("_noted"))),
        _noted_resumed=running_max(F.when(kind == "resume", F.col("_noted"))),
    )
    # before the first close of this log the count goes on from where it started
    since = lambda total, mark, name: F.col(total) + F.coalesce(-F.col(mark), carried(name))
    scan.rows = (
        scan.rows.withColumn("run_failures", since("_weight", "_weight_closed", "run_failures"))
        .withColumn("streak", since("_noted", "_noted_closed", "streak"))
        .withColumn("total_failures", since("_noted", "_noted_resumed", "total_failures"))
        .withColumn("opened", failed & (F.col("run_failures") >= policy.failure_threshold))
        .drop("_weight", "_weight_closed", "_noted", "_noted_closed", "_noted_resumed")
    )
    scan = scan.add(opens=running_sum(F.col("opened").cast("int")))
    scan.rows = scan.rows.withColumn("opens", F.col("opens") + carried("opens"))
    cooldown = cooldown_seconds(F.col("opens"), policy)
    scan.rows = scan.rows.withColumn("cooldown_s", F.when(F.col("opened"), cooldown)).withColumn(
        "_until", F.when(F.col("opened"), _micros(F.col("ts")) + (cooldown * 1e6).cast("bigint"))
    )
    many_opens = F.col("opens") >= policy.pause_after_opens
    many_failures = F.col("streak") >= policy.pause_after_failures
    trigger = (
        F.when(kind == "quota_exceeded", "quota")
        .when((F.col("opened") | (kind == "breaker_open")) & many_opens, "opens")
        .when((F.col("opened") | (kind == "breaker_open")) & many_failures, "failures")
    )
    scan.rows = scan.rows.withColumn("pause_trigger", trigger)
    reason = (
        F.when(trigger == "quota", F.lit(V.PAUSED_BY_QUOTA))
        .when(trigger == "opens", F.format_string(V.PAUSED_BY_OPENS, F.col("opens")))
        .when(
            trigger == "failures",
            F.format_string(V.PAUSED_BY_FAILURES, F.col("streak"), F.col("total_failures")),
        )
    )
    scan = scan.add(
        _gate=last_known(
            F.when(closes, F.struct(F.lit("closed").alias("state"), F.lit(None).cast("bigint").alias("until")))
            .when(F.col("opened"), F.struct(F.lit("open").alias("state"), F.col("_until").alias("until")))
            .when(passed_gate, F.struct(F.lit("passed").alias("state"), F.lit(None).cast("bigint").alias("until")))
        ),
        _last_open=last_known(F.when(F.col("opened"), at)),
        _last_close=last_known(F.when(closes, at)),
        _pause=last_known(
            F.when(kind == "resume", F.struct(F.lit(None).cast("string").alias("why")))
            .when(F.col("pause_trigger").isNotNull(), F.struct(reason.alias("why")))
        ),
    )
    was_open = F.coalesce(begin("breaker") == "open", F.lit(False)) & F.col("_last_close").isNull()
    open_since_close = F.coalesce(
        F.col("_last_open") > F.col("_last_close"), F.col("_last_open").isNotNull() & F.col("_last_close").isNull()
    )
    gate = F.col("_gate")["state"]
    state = (
        F.when(gate.isNull(), F.coalesce(begin("breaker"), F.lit("closed")))
        .when(gate == "open", "open")
        .when((gate == "passed") & (open_since_close | was_open), "half_open")
        .when((gate == "passed") & F.col("_last_close").isNull() & F.coalesce(begin("breaker") == "half_open", F.lit(False)), "half_open")
        .otherwise("closed")
    )
    until = F.when(gate.isNull(), begin("open_until_us").cast("bigint")).otherwise(F.col("_gate")["until"])
    why = F.when(F.col("_pause").isNull(), begin("pause_reason").cast("string")).otherwise(F.col("_pause")["why"])
    return scan.result().select(
        *attempts.columns, "run_failures", "streak", "total_failures", "opened", "opens", "cooldown_s",
        until.alias("open_until_us"), state.alias("breaker"), "pause_trigger", why.isNotNull().alias("paused"), why.alias("pause_reason"),
    )


def last_state(log: DataFrame) -> DataFrame:
    """The newest state of each source in a breaker log; an aggregate, reduced before the exchange."""
    newest = log.groupBy(SOURCE).agg(F.max_by(F.struct(*STATE), F.struct(*LOG_ORDER)).alias("_last"))
    return newest.select(SOURCE, "_last.*")


def breaker_episodes(
    attempts: DataFrame, policy: BreakerPolicy = BreakerPolicy(), cuts: Cuts | None = None
) -> DataFrame:
    """One row per opening of a breaker."""
    log = breaker_log(attempts, policy, cuts).where("opened")
    return log.select(
        SOURCE, "seq", "ts", F.col("outcome").alias("reason"), "run_failures", "opens", "cooldown_s", "open_until_us"
    )


def _with_limit(reason: Column, limit: Column) -> Column:
    return F.replace(reason, F.lit("{limit}"), limit.cast("string"))


def pause_events(
    attempts: DataFrame, sources: DataFrame, policy: BreakerPolicy = BreakerPolicy(), cuts: Cuts | None = None
) -> DataFrame:
    """The attempts at which a source went from running to paused (a pause holds until a resume row).

    ``sources`` has the daily quotas; a source that is not in it has the default one.
    """
    log = breaker_log(attempts, policy, cuts)
    scan = OrderedScan(log, [SOURCE], LOG_ORDER, cuts).add(_before=previous(F.struct("paused")))
    was_paused = F.coalesce(F.col("_before")["paused"], F.lit(False))
    newly = with_policy(scan.result().where(F.col("paused") & ~was_paused), sources, daily_quota=V.DEFAULT_DAILY_QUOTA)
    return newly.select(
        SOURCE, "seq", "ts", F.col("pause_trigger").alias("cause"), "opens", "streak", "total_failures",
        _with_limit(F.col("pause_reason"), F.col("daily_quota")).alias("pause_reason"),
    )


def health_report(
    attempts: DataFrame,
    sources: DataFrame,
    as_of: datetime,
    policy: BreakerPolicy = BreakerPolicy(),
    tz: str = "UTC",
    cuts: Cuts | None = None,
    cached: DataFrame | None = None,
) -> DataFrame:
    """State, counters and quota of each source at ``as_of``; partial aggregates over the breaker log.

    ``sources`` are the registered ones (source_id, daily_quota). Those without an attempt are healthy;
    a source with attempts that is not among them is reported with the default quota.
    ``cached`` (source_id, cached_requests) adds how many requests the source remembers.
    """
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    log = breaker_log(attempts.where(F.col("ts") <= now), policy, cuts)
    newest = F.struct("breaker", "opens", "streak", "total_failures", "open_until_us", "paused", "pause_reason")
    at_end = log.groupBy(SOURCE).agg(
        F.max_by(newest, F.struct(*LOG_ORDER)).alias("_last"),
        F.count_if(F.col("outcome") == "ok").alias("success"),
        F.count_if(F.col("outcome").isin(*V.ANOMALIES)).alias("failure"),
        F.count_if(F.col("outcome") == "dedup").alias("dedup_hits"),
        F.count_if(
            (local_day(F.col("ts"), tz) == local_day(now, tz))
            & ~F.col("outcome").isin("breaker_open", "paused", "dedup", "quota_exceeded", "resume")
        ).alias("_today"),
    )
    last = F.col("_last")
    remaining = F.greatest(F.lit(0.0), F.round((last["open_until_us"] - _micros(now)) / 1e6, 1))
    cooled = F.coalesce(remaining, F.lit(0.0)) <= 0
    state = (
        F.when(last["paused"], "paused")
        .when((last["breaker"] == "open") & ~cooled, "open")
        .when(last["breaker"].isin("open", "half_open"), "degraded")
        .otherwise("healthy")
    )
    joined = at_end.join(sources.select(SOURCE, "daily_quota"), SOURCE, "full")
    limit = F.coalesce("daily_quota", F.lit(V.DEFAULT_DAILY_QUOTA))
    if cached is None:
        joined = joined.withColumn("cached_requests", F.lit(None).cast("bigint"))
    else:
        joined = joined.join(cached, SOURCE, "left")
    none = lambda value: F.coalesce(value, F.lit(0))
    return joined.select(
        SOURCE, state.alias("state"), F.coalesce(last["breaker"], F.lit("closed")).alias("breaker"), none(last["opens"]).alias("opens"),
        none(last["streak"]).alias("consecutive_failures"), none(last["total_failures"]).alias("total_failures"),
        F.coalesce(remaining, F.lit(0.0)).alias("open_remaining_s"),
        F.least(none(F.col("_today")), limit).alias("quota_used"), limit.alias("quota_limit"), none(F.col("cached_requests")).alias("cached_requests"),
        F.coalesce(last["paused"], F.lit(False)).alias("paused"), F.coalesce(_with_limit(last["pause_reason"], limit), F.lit("")).alias("paused_reason"),
        *[none(F.col(c)).alias(c) for c in ("success", "failure", "dedup_hits")],
    )
