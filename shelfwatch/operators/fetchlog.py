"""Fetch-log analytics: response classes, outcomes, quota, rate and failure audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import contains_any
from .ordered import Cuts, OrderedScan, position, running_max, running_min, running_sum

SOURCE = "source_id"
LOG_ORDER = ("ts", "seq")


_CODE_MEMBERS = "struct<code variant, error_code variant, sub_code variant, error_description variant, msg variant, message variant>"
_EMPTY_JSON = ("null", "0", "0.0", "-0.0", "false", '""', "[]", "{}")


def _first_filled(members: Column, *names: str) -> Column:
    """JSON text of the first named member that is neither missing nor null, empty, 0 or false."""
    texts = [F.to_json(members[name]) for name in names]
    return F.coalesce(*[F.when(~t.isin(*_EMPTY_JSON), t) for t in texts], F.lit(""))


def with_response_class(
    answers: DataFrame, status: str = "status", body: str = "body", fix_rate_codes: bool = False
) -> DataFrame:
    """Adds ``anomaly``: the class of one response, null when it is fine.

    Two patterns ignore case, the verification one does not. Listed rate codes are lower case while
    the codes they are compared with are upper-cased, so they never match; ``fix_rate_codes`` mends it.
    The steps are separate projections so that each body is parsed once and no generated method grows
    past what the JVM compiles.
    """
    rows = answers.withColumn("_text", F.substring(F.coalesce(F.col(body), F.lit("")), 1, V.BODY_CHARS_READ))
    rows = rows.withColumn("_members", F.try_variant_get(F.try_parse_json("_text"), "$", _CODE_MEMBERS))
    members = F.col("_members")
    joined = F.concat_ws(
        "|",
        _first_filled(members, "code", "error_code"),
        _first_filled(members, "sub_code", "error_description"),
        _first_filled(members, "msg", "message"),
    )
    rows = rows.withColumn("_codes", F.upper(joined))
    text, codes, code = F.col("_text"), F.col("_codes"), F.col(status)
    auth_text = text.rlike(f"(?iU){V.AUTH_PATTERN}")
    auth_code = codes.contains("INVALIDSESSION") | (codes.contains("SIGN") & codes.contains("ERROR"))
    anomaly = (
        F.when(code.isin(*V.RATE_STATUSES), "rate_limited")
        .when(code.isin(*V.AUTH_STATUSES), F.when(auth_text, "auth_expired").otherwise("rate_limited"))
        .when(code >= 500, "transport_error")
        .when(text.rlike(V.VERIFY_PATTERN), "verify_required")
        .when(contains_any(codes, V.CONTEXT_CODES), "context_mismatch")
        .when(auth_text | auth_code, "auth_expired")
        .when(text.rlike(f"(?iU){V.RATE_PATTERN}"), "rate_limited")
    )
    if fix_rate_codes:
        listed = contains_any(codes, [c.upper() for c in V.RATE_CODES])
        anomaly = F.coalesce(anomaly, F.when(listed, "rate_limited"))
    return rows.withColumn("anomaly", anomaly).drop("_text", "_members", "_codes")


def context_mismatch(log: DataFrame) -> DataFrame:
    """Answers that carry another item than the one asked for."""
    got = F.col("returned_item_id")
    return log.where((got != "") & (got != F.col("item_id").cast("string")))


def attempt_outcome(log: DataFrame) -> DataFrame:
    """``outcome``: 'ok', or the anomaly of the attempt. An answer without an item counts as transport trouble."""
    asked, got = F.col("item_id").cast("string"), F.coalesce(F.col("returned_item_id"), F.lit(""))
    failed = F.coalesce(F.col("anomaly"), F.lit("transport_error"))
    outcome = (
        F.when(~F.col("ok"), failed)
        .when(got == "", "transport_error")
        .when((asked != "") & (got != asked), "context_mismatch")
        .otherwise("ok")
    )
    return with_response_class(log).withColumn("outcome", outcome).drop("anomaly")


def audit_rows(attempts: DataFrame, body: str = "body") -> DataFrame:
    """Fetch-audit rows of the failed attempts; the detail says what the answer was classed as and how it began.

    ``counted`` is true where the attempt went to the source and counts towards its failures, and not
    for one that was refused before it was sent.
    """
    what = F.coalesce(F.col("outcome"), F.lit("blocked"))
    began = F.substring(F.coalesce(F.col(body), F.lit("")), 1, V.AUDIT_BODY_CHARS)
    detail = F.substring(F.concat_ws(":", what, began), 1, V.AUDIT_DETAIL_CHARS)
    return attempts.where(F.col("outcome") != "ok").select(
        SOURCE, "seq", "ts", F.concat(F.lit("fail:"), what).alias("outcome"), detail.alias("detail"), what.isin(*V.ANOMALIES).alias("counted")
    )


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz")))


def with_policy(log: DataFrame, sources: DataFrame, **defaults: float) -> DataFrame:
    """The log with its sources' policy columns; undeclared sources have the default policy."""
    policy = sources.select(SOURCE, *defaults)
    return log.join(policy, SOURCE, "left").withColumns({c: F.coalesce(policy[c], F.lit(v).cast(policy.schema[c].dataType)) for c, v in defaults.items()})


def quota_ledger(log: DataFrame, sources: DataFrame, tz: str = "UTC", cuts: Cuts | None = None) -> DataFrame:
    """Each request with its rank in the source's day and whether it is over the daily quota.

    ``cuts`` are positions per (source_id, day).
    """
    days = log.withColumn("day", local_day(F.col("ts"), tz))
    days = with_policy(days, sources, daily_quota=V.DEFAULT_DAILY_QUOTA)
    ranked = OrderedScan(days, [SOURCE, "day"], LOG_ORDER, cuts).add(used=position()).result()
    return ranked.withColumn("over", F.col("used") > F.col("daily_quota"))


def quota_days(log: DataFrame, sources: DataFrame, tz: str = "UTC") -> DataFrame:
    """Used, remaining and overrun per source and day; counted before the shuffle, no ranking needed."""
    used = log.groupBy(SOURCE, local_day(F.col("ts"), tz).alias("day")).agg(F.count(F.lit(1)).alias("used"))
    left = F.col("daily_quota") - F.col("used")
    return with_policy(used, sources, daily_quota=V.DEFAULT_DAILY_QUOTA).select(
        SOURCE, "day", "used",
        F.greatest(F.lit(0), left).alias("remaining"),
        F.greatest(F.lit(0), -left).alias("overrun"),
    )


def rate_audit(log: DataFrame, sources: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Requests that exceed a token bucket of ``qps`` and ``burst`` that starts full.

    With n requests so far and t seconds elapsed, n - qps*t less its smallest earlier value is the
    number of tokens taken from the bucket; above ``burst`` the request broke the limit.
    """
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rated = with_policy(log, sources, qps=V.DEFAULT_QPS, burst=V.DEFAULT_BURST)
    scan = OrderedScan(rated, [SOURCE], LOG_ORDER, cuts).add(_n=position())
    refilled = F.col("qps") * seconds
    scan = scan.add(_floor=running_min((F.col("_n") - 1) - refilled))
    taken = (F.col("_n") - refilled) - F.col("_floor")
    return scan.result().where(taken > F.col("burst")).drop("_n", "_floor")


def failure_streaks(attempts: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Failures in a row (a success starts over) and failures in total, at each attempt."""
    ok = F.col("outcome") == "ok"
    scan = OrderedScan(attempts, [SOURCE], LOG_ORDER, cuts)
    scan = scan.add(total_failures=running_sum(F.when(ok, 0).otherwise(1)))
    scan = scan.add(_at_success=running_max(F.when(ok, F.col("total_failures"))))
    streak = F.col("total_failures") - F.coalesce(F.col("_at_success"), F.lit(0))
    return scan.result().withColumn("streak", streak).drop("_at_success")
