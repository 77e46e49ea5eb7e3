"""Golden rows and brute-force checks of the fetch-log operators."""

import json
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwatch.operators import fetchlog, health, request_dedupe
from shelfwatch.operators.health import BreakerPolicy
from plain_health import SourceHealth

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("status, body, expected", [
    (429, '{"code":429}', "rate_limited"),
    (503, "", "rate_limited"),
    (200, '{"sub_code":"ISV_LIMIT"}', "rate_limited"),
    (200, '{"msg":"API 调用频繁"}', "rate_limited"),
    (200, "API　调用频繁", "rate_limited"),
    (403, "invalid session", "auth_expired"),
    (403, "no", "rate_limited"),
    (200, '{"msg":"签名错误"}', "auth_expired"),
    (200, '{"msg":"Sign Error"}', "auth_expired"),
    (200, "请完成滑块验证", "verify_required"),
    (200, "captcha required", "verify_required"),
    (200, "Captcha required", None),
    (502, "<html>", "transport_error"),
    (200, "", None),
    (200, '{"code":0}', None),
    (200, '{"code":0,"error_code":"data_mismatch"}', "context_mismatch"),
    (200, '{"code":"0","error_code":"DATA_MISMATCH"}', None),
    (200, '{"sub_code":"isv.limit"}', None),
    (200, '[{"code":"ITEM_NOT_MATCH"}]', None),
    (200, "x" * 4000 + "captcha", None),
])
def test_response_class(spark, status, body, expected):
    rows = spark.createDataFrame([(status, body)], "status int, body string")
    assert fetchlog.with_response_class(rows).first()["anomaly"] == expected


def _undeclared(spark):
    return spark.createDataFrame([], "source_id string, daily_quota bigint")


def test_rate_codes_can_be_mended(spark):
    rows = spark.createDataFrame([(200, '{"sub_code":"isv.limit"}')], "status int, body string")
    assert fetchlog.with_response_class(rows, fix_rate_codes=True).first()["anomaly"] == "rate_limited"


def attempts(spark, outcomes, step=1.0, source="s"):
    rows = [(source, n, START + timedelta(seconds=step * n), o) for n, o in enumerate(outcomes)]
    return spark.createDataFrame(rows, "source_id string, seq bigint, ts timestamp, outcome string")


def states(spark, outcomes, step=1.0, **policy):
    log = health.breaker_log(attempts(spark, outcomes, step), BreakerPolicy(**policy))
    return log.orderBy("seq").collect()


def test_breaker_opens_at_the_threshold_and_success_closes(spark):
    rows = states(spark, ["rate_limited", "rate_limited", "breaker_open", "ok"], failure_threshold=2, open_seconds=300.0)
    assert [r["breaker"] for r in rows] == ["closed", "open", "open", "closed"]
    assert [r["streak"] for r in rows] == [1, 2, 3, 0]
    assert [r["opens"] for r in rows] == [0, 1, 1, 1]
    assert rows[1]["cooldown_s"] == 300.0


def test_instant_anomalies_open_at_once(spark):
    for anomaly in ("context_mismatch", "verify_required", "auth_expired"):
        assert states(spark, [anomaly], failure_threshold=99)[0]["breaker"] == "open"
    assert states(spark, ["transport_error"], failure_threshold=99)[0]["breaker"] == "closed"


def test_cooldown_backs_off_to_its_ceiling(spark):
    rows = states(spark, ["auth_expired", "ok"] * 9, open_seconds=60.0, max_open_seconds=3600.0)
    assert [r["cooldown_s"] for r in rows if r["opened"]] == [60, 120, 240, 480, 960, 1920, 3600, 3600, 3600]


def test_half_open_after_a_passed_gate(spark):
    rows = states(spark, ["auth_expired", "throttled", "auth_expired", "ok"], step=400.0)
    assert [r["breaker"] for r in rows] == ["open", "half_open", "open", "closed"]


def test_pause_by_opens_by_streak_and_by_quota(spark):
    by_opens = states(spark, ["auth_expired", "ok", "auth_expired", "paused", "resume", "ok"], pause_after_opens=2)
    assert [r["paused"] for r in by_opens] == [False, False, True, True, False, False]
    assert by_opens[2]["pause_reason"] == "连续熔断 2 次，人工确认后恢复"
    by_streak = states(spark, ["auth_expired", "breaker_open", "breaker_open"], pause_after_failures=3)
    assert [r["paused"] for r in by_streak] == [False, False, True]
    assert by_streak[2]["pause_reason"] == "连续 3 次失败未恢复（累计 3 次），人工确认后恢复"
    assert [r["paused"] for r in states(spark, ["ok", "quota_exceeded", "paused"])] == [False, True, True]


def test_resume_clears_counters_but_not_opens(spark):
    rows = states(spark, ["auth_expired", "resume", "auth_expired"], pause_after_opens=3)
    assert [(r["streak"], r["total_failures"], r["opens"]) for r in rows] == [(1, 1, 1), (0, 0, 1), (1, 1, 2)]
    assert [r["breaker"] for r in rows] == ["open", "closed", "open"]


def test_pause_events_hold_until_resume(spark):
    outcomes = ["auth_expired", "auth_expired", "auth_expired", "resume", "auth_expired"]
    log = attempts(spark, outcomes)
    found = health.pause_events(log, _undeclared(spark), BreakerPolicy(pause_after_opens=2)).orderBy("seq").collect()
    assert [(r["seq"], r["cause"]) for r in found] == [(1, "opens"), (4, "opens")]


OUTCOMES = st.sampled_from([
    "ok", "ok", "rate_limited", "transport_error", "auth_expired", "breaker_open", "throttled", "dedup", "paused", "quota_exceeded", "resume",
])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(outcomes=st.lists(OUTCOMES, min_size=1, max_size=40))
def test_breaker_columns_equal_the_step_by_step_state(spark, outcomes):
    policy = BreakerPolicy(failure_threshold=3, pause_after_opens=3, pause_after_failures=4)
    one, expected = SourceHealth(), []
    for n, outcome in enumerate(outcomes):
        opened = one.step(outcome, int((START + timedelta(seconds=n)).timestamp() * 1e6), policy)
        expected.append((opened, one.run_failures, one.opens, one.streak, one.total_failures, one.breaker, one.paused))
    names = ("opened", "run_failures", "opens", "streak", "total_failures", "breaker", "paused")
    log = attempts(spark, outcomes)
    rows = health.breaker_log(log, policy).orderBy("seq").collect()
    assert [tuple(r[c] for c in names) for r in rows] == expected
    # cut anywhere, the second part continues from the state the first one left
    cut = len(outcomes) // 2
    first = health.breaker_log(log.where(F.col("seq") < cut), policy)
    rest = health.breaker_log(log.where(F.col("seq") >= cut), policy, start=health.last_state(first)).orderBy("seq").collect()
    assert [tuple(r[c] for c in names) for r in rest] == expected[cut:]


def test_health_report_states(spark):
    def report(outcomes, seconds):
        sources = spark.createDataFrame([("s", 3)], "source_id string, daily_quota bigint")
        return health.health_report(attempts(spark, outcomes), sources, START + timedelta(seconds=seconds)).first()

    assert report(["ok"], 10)["state"] == "healthy"
    opened = report(["auth_expired"], 10)
    assert (opened["state"], opened["breaker"], opened["open_remaining_s"]) == ("open", "open", 50.0)
    assert report(["auth_expired"], 61)["state"] == "degraded"
    assert report(["auth_expired", "quota_exceeded"], 61)["state"] == "paused"
    full = report(["ok", "ok", "throttled", "dedup", "transport_error"], 10)
    assert (full["quota_used"], full["quota_limit"], full["success"], full["failure"]) == (3, 3, 2, 1)
    assert report(["quota_exceeded"], 10)["paused_reason"] == "日配额 3 已用尽"


def test_health_report_lists_registered_and_undeclared_sources(spark):
    sources = spark.createDataFrame([("idle", 3)], "source_id string, daily_quota bigint")
    rows = health.health_report(attempts(spark, ["ok", "auth_expired"]), sources, START + timedelta(seconds=10)).collect()
    got = {r["source_id"]: r for r in rows}
    assert set(got) == {"idle", "s"}
    assert (got["s"]["state"], got["s"]["quota_limit"], got["s"]["success"]) == ("open", 1000, 1)
    idle = got["idle"].asDict()
    assert idle == {
        "source_id": "idle", "state": "healthy", "breaker": "closed", "opens": 0, "consecutive_failures": 0, "total_failures": 0,
        "open_remaining_s": 0.0, "quota_used": 0, "quota_limit": 3, "cached_requests": 0, "paused": False, "paused_reason": "",
        "success": 0, "failure": 0, "dedup_hits": 0,
    }


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(gaps=st.lists(st.integers(0, 8), min_size=1, max_size=40), qps=st.sampled_from([0.25, 0.5, 1.0]), burst=st.integers(1, 4))
def test_first_rate_breach_is_the_first_refusal_of_a_bucket(spark, gaps, qps, burst):
    at, moments = 0, []
    for gap in gaps:
        at += gap
        moments.append(at)
    tokens, last, refused = float(burst), None, None
    for n, moment in enumerate(moments):
        tokens = min(burst, tokens + (0 if last is None else moment - last) * qps)
        last = moment
        if tokens < 1:
            refused = n
            break
        tokens -= 1
    log = spark.createDataFrame(
        [("s", n, START + timedelta(seconds=m)) for n, m in enumerate(moments)], "source_id string, seq bigint, ts timestamp")
    sources = spark.createDataFrame([("s", qps, burst)], "source_id string, qps double, burst bigint")
    first = fetchlog.rate_audit(log, sources).agg(F.min("seq")).first()[0]
    assert first == refused


def fold_hits(rows, ttl):
    anchor, hits = {}, {}
    for key, ts, seq, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        hits[seq] = key in anchor and ts - anchor[key] < ttl
        if ok and not hits[seq]:
            anchor[key] = ts
    return hits


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.booleans()), min_size=1, max_size=60),
    ttl=st.sampled_from([0, 1, 5, 20]),
)
def test_request_dedupe_equals_a_plain_fold(spark, rows, ttl):
    flat = [("s", k, t * 1_000_000, n, ok) for n, (k, t, ok) in enumerate(rows)]
    frame = spark.createDataFrame(flat, "source_id string, request_fp string, ts_us bigint, seq bigint, ok boolean")
    got = {r["seq"]: r["hit"] for r in request_dedupe.request_dedupe(frame, ttl).collect()}
    assert got == fold_hits([(k, t, n, ok) for n, (k, t, ok) in enumerate(rows)], ttl)


def test_attempt_outcome_and_audit(spark):
    rows = [
        ("s", 1, START, "A", 200, json.dumps({"code": 0}), True, "A"),
        ("s", 2, START, "A", 200, "", True, "B"),
        ("s", 3, START, "A", 200, "", True, None),
        ("s", 4, START, "A", 502, "x" * 900, False, None),
        ("s", 5, START, "A", 0, "", False, None),
    ]
    log = spark.createDataFrame(
        rows, "source_id string, seq bigint, ts timestamp, item_id string, status int, body string, ok boolean, returned_item_id string")
    done = fetchlog.attempt_outcome(log)
    assert [r["outcome"] for r in done.orderBy("seq").collect()] == [
        "ok", "context_mismatch", "transport_error", "transport_error", "transport_error"]
    assert [r["seq"] for r in fetchlog.context_mismatch(log).collect()] == [2]
    audit = {r["seq"]: r for r in fetchlog.audit_rows(done).collect()}
    assert audit[2]["outcome"] == "fail:context_mismatch" and len(audit[4]["detail"]) == 500 and 1 not in audit


def test_quota_day_follows_the_time_zone(spark):
    log = spark.createDataFrame(
        [("s", 1, datetime(2024, 1, 1, 15)), ("s", 2, datetime(2024, 1, 1, 17))], "source_id string, seq bigint, ts timestamp")
    sources = spark.createDataFrame([("s", 1)], "source_id string, daily_quota bigint")
    over = lambda tz: [r["over"] for r in fetchlog.quota_ledger(log, sources, tz).orderBy("seq").collect()]
    assert over("UTC") == [False, True]
    assert over("Asia/Shanghai") == [False, False]
    assert [r["overrun"] for r in fetchlog.quota_days(log, sources).collect()] == [1]


def test_undeclared_sources_have_the_default_policy(spark):
    log = spark.createDataFrame([("nobody", k, datetime(2024, 1, 1, 10)) for k in range(5)], "source_id string, seq bigint, ts timestamp")
    sources = spark.createDataFrame([("s", 1, 0.1, 1)], "source_id string, daily_quota bigint, qps double, burst bigint")
    assert [r["over"] for r in fetchlog.quota_ledger(log, sources).collect()] == [False] * 5
    assert [(r["used"], r["remaining"]) for r in fetchlog.quota_days(log, sources).collect()] == [(5, 995)]
    assert sorted(r["seq"] for r in fetchlog.rate_audit(log, sources).collect()) == [3, 4]
