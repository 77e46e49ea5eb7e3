"""Payloads, envelopes, declarations, URL rules and tables at rest."""

import json
from datetime import datetime, timedelta
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import fixed_values as V
from shelfwatch.functions.scalars import canonical_url, clamped_ttl, lenient_double, lenient_long, request_fp
from shelfwatch.sources import declarations, payloads, sinks


def test_lenient_numbers(spark):
    texts = ["89.0", " 89.5元 ", "1e2", "", None, "abc", "1.0d", "-3.99", "12.345", "0x10"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        lenient_double(F.col("t")).alias("d"), lenient_long(F.col("t")).alias("n")).collect()
    assert [r["d"] for r in rows] == [89.0, 89.5, 100.0, None, None, None, None, -3.99, 12.35, None]
    assert [r["n"] for r in rows] == [89, None, 100, None, None, None, None, -3, 12, None]


def test_normalise_items(spark):
    full = {"item": {"item_id": 7, "title": "t", "price": "69元", "original_price": "", "stock": "3.7", "status": "on_sale",
                     "main_image": "m", "promotion": "p", "review_count": 5, "rating": "4.85", "skus": [{"sku_id": "b"}, {"sku_id": 2}]}}
    bodies = [json.dumps(full), "{}", "not json", json.dumps({"item": {"price": 5, "original_price": 9}})]
    frame = spark.createDataFrame([("asked", "s", n, b) for n, b in enumerate(bodies)], "item_id string, source_id string, seq int, payload string")
    rows = payloads.normalize_items(frame).orderBy("seq").collect()
    first = rows[0]
    assert (first["item_id"], first["price"], first["original_price"], first["stock"], first["sku_list"]) == ("7", 69.0, 69.0, 3, ["b", "2"])
    assert (rows[1]["item_id"], rows[1]["listing_status"], rows[1]["price"], rows[1]["sku_list"]) == ("asked", "unknown", None, [])
    assert rows[2]["item_id"] == "asked"
    assert (rows[3]["price"], rows[3]["original_price"]) == (5.0, 9.0)


def test_unwrap_envelope(spark):
    bodies = ['{"code":0,"result":{"item":1}}', '{"code":"200","x":1}', '{"error_response":{"code":27,"msg":"m"}}', "{}", '{"code":5,"y":2}']
    frame = spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "seq int, body string")
    rows = payloads.unwrap_envelope(frame).orderBy("seq").collect()
    assert [(r["code"], r["ok"], r["content"]) for r in rows] == [
        ("0", True, '{"item":1}'), ("200", True, '{"code":"200","x":1}'), ("27", False, '{"code":27,"msg":"m"}'),
        ("1", False, "{}"), ("5", False, '{"code":5,"y":2}')]


def test_normaliser_lookup(spark):
    known = payloads.Normalisers()
    known.register("bare", lambda payload, asked: payloads.item_record(F.concat(F.lit('{"item":'), payload, F.lit("}")), asked))
    frame = spark.createDataFrame(
        [("1", "item_payload", '{"item":{"title":"a"}}'), ("2", "bare", '{"title":"b"}'), ("3", "other", "{}")], "item_id string, adapter string, payload string")
    records = known.apply(frame, ["item_payload", "bare"])
    assert [(r["item_id"], r["title"]) for r in records.orderBy("item_id").collect()] == [("1", "a"), ("2", "b")]
    assert records._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
    with pytest.raises(KeyError, match="own_shop.*bare.*item_payload"):
        known.get("own_shop")


DECLARED = {
    "sources": [
        {"id": "real", "adapter": "item_payload", "enabled": True, "compliance": "official_api", "daily_quota": 500},
        {"id": "off", "adapter": "x", "compliance": "vendor"},
        {"id": "synth", "adapter": "flat", "enabled": True, "compliance": "synthetic", "qps": 2.0},
    ],
    "targets": [{"item_id": "SAMPLE-1", "title": "a", "role": "competitor", "priority": 1}, {"item_id": "9", "title": "b"}],
}


def test_declarations(spark, tmp_path):
    path = tmp_path / "declared.json"
    path.write_text(json.dumps(DECLARED, indent=1), encoding="utf-8")
    sources, targets = declarations.load_sources(spark, str(path)), declarations.load_targets(spark, str(path))
    assert [(r["source_id"], r["qps"], r["burst"], r["daily_quota"]) for r in sources.orderBy("ord").collect()] == [
        ("real", 0.5, 3, 500), ("synth", 2.0, 3, 1000)]
    assert {r["item_id"]: (r["role"], r["priority"]) for r in targets.collect()} == {"SAMPLE-1": ("competitor", 1), "9": ("self", 3)}
    chosen = {r["item_id"]: r["source_id"] for r in declarations.resolve_source(targets, sources).collect()}
    assert chosen == {"SAMPLE-1": "synth", "9": "real"}
    only_real = sources.where("compliance <> 'synthetic'")
    assert {r["source_id"] for r in declarations.resolve_source(targets, only_real).collect()} == {None, "real"}
    only_synth = sources.where("compliance = 'synthetic'")
    assert {r["source_id"] for r in declarations.resolve_source(targets, only_synth).collect()} == {"synth"}


def test_compliance_gate(spark):
    rows = [("a", True, "own_data"), ("b", True, ""), ("c", True, "scraped"), ("d", False, ""), ("e", True, None)]
    sources = spark.createDataFrame(rows, "source_id string, enabled boolean, compliance string")
    assert {r["source_id"] for r in declarations.compliance_rejects(sources).collect()} == {"b", "c", "e"}
    with pytest.raises(ValueError, match="compliance"):
        declarations.require_compliance(sources)
    declarations.require_compliance(sources.where("source_id IN ('a', 'd')"))
    seen = declarations.reject_noncompliant(spark.createDataFrame([("a",), ("b",)], "source_id string"), sources)
    assert [r["source_id"] for r in seen.collect()] == ["a"]


def test_ttl_clamp(spark):
    cases = [(7200, 3600, None, 1800), (600, 3600, None, 600), (600, 60, None, 60), (-5, 3600, None, 0), (600, 3600, 0, 0), (600, 3600, -4, 0), (1, 3600, 9999, 9999)]
    frame = spark.createDataFrame(cases, "ttl bigint, every bigint, forced bigint, want bigint")
    rows = frame.select("want", clamped_ttl(F.col("ttl"), F.col("every"), F.col("forced")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


URLS = [
    "HTTPS://Api.Example.com/Item?id=5&utm_source=x&t=9", "http://a.b", "http://a.b?", "http://a.b/p#frag", " http://a.b/p?b=2&a=1&a=0 ",
    "http://a.b/p?x=&y", "http://a.b/p?q=a+b%20c~*", "http://a.b/p?SPM=1&_=2&r=3&keep=%E4%B8%AD", "http://a.b/p?bad=%zz&ok=100%",
    "//Host/p?x=1", "/only/path?z=1&y=2", "http://U:P@Host:80/p?x=1?2#f?g", "http://a.b/p?a=b=c&&d=",
]


def test_canonical_url_follows_the_rfc_tools(spark):
    def rule(url):
        parts = urlsplit(url.strip())
        kept = sorted(p for p in parse_qsl(parts.query, keep_blank_values=True) if p[0].lower() not in V.TRACKING_PARAMS)
        return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path or "/", urlencode(kept), ""))

    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == {u: rule(u) for u in URLS}


def test_request_fp_ignores_tracking_and_case_of_method(spark):
    frame = spark.createDataFrame([("http://A.b/?t=1&x=2", "get"), ("http://a.b/?x=2#z", "GET")], "u string, m string")
    assert frame.select(request_fp(canonical_url(F.col("u")), F.col("m"))).distinct().count() == 1


def test_payloads_parsed_when_stored(spark, tmp_path):
    bodies = [json.dumps({"item": {"item_id": "7", "title": "t", "price": 69.5, "stock": 3, "skus": [{"sku_id": "b"}]}}), "not json", None, json.dumps({"item": {"price": "5元"}})]
    frame = spark.createDataFrame([("asked", n, b) for n, b in enumerate(bodies)], "item_id string, seq int, payload string")
    payloads.parsed(frame).write.parquet(str(tmp_path / "p"))
    stored = payloads.normalize_items(spark.read.parquet(str(tmp_path / "p")))
    fields = [c for c in stored.columns if c != "raw"]
    assert sorted(map(str, stored.select(fields).collect())) == sorted(map(str, payloads.normalize_items(frame).select(fields).collect()))


def test_broken_declarations_are_listed(spark):
    texts = ['{"id":"a","enabled":true,"compliance":"vendor"}', "{", '{"sources":[{"id":"b"},5,{"id":"","enabled":true},{"id":"c","qps":"1"}]}', None,
             '{"id":"d","enabled":true,"compliance":""}', '{"id":"e","enabled":true,"compliance":"hearsay"}', '{"id":"f","daily_quota":2.5}', '{"sources":[]}']
    rows = declarations.checked_declarations(spark.createDataFrame(list(enumerate(texts)), "n int, declaration string"))
    assert [(r["n"], r["source_id"], r["reason"]) for r in rows.orderBy("n", "place").collect()] == [
        (0, "a", None), (1, None, "not JSON"), (2, "b", None), (2, None, "not an object"), (2, "", "no id"), (2, "c", "qps is not a number"),
        (3, None, "not JSON"), (4, "d", "no compliance declared"), (5, "e", "compliance not in the allowed list"), (6, "f", "daily_quota is not a whole number")]
    with pytest.raises(ValueError, match="3 sources .*'d', 'e'"):
        declarations.require_compliance(rows.withColumn("compliance", F.coalesce("compliance", F.lit(""))))


def test_tables_at_rest(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("i", "s", n, start + timedelta(days=n // 2, hours=12 * (n % 2)), float(n)) for n in range(10)]
    frame = spark.createDataFrame(rows, "item_id string, source_id string, seq bigint, fetched_at timestamp, price double")
    path = str(tmp_path / "snap")
    for part in (frame, frame.where("seq = 9")):
        sinks.append_by_period(part, path, "fetched_at", "fetch_date")
    assert spark.read.parquet(path).count() == 11
    plan = spark.read.parquet(path).where("fetch_date >= '2024-01-04'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fetch_date" in plan
    as_of = start + timedelta(days=5, hours=6)
    for expected in (7, 0):  # three whole days, the first half of the fourth; then nothing more
        assert sinks.drop_expired(spark, path, "fetched_at", "fetch_date", as_of, 2) == expected
        left = spark.read.parquet(path)
        assert sorted(r["seq"] for r in left.collect()) == [7, 8, 9, 9] and left.columns[-1] == "fetch_date"
    assert sinks.drop_expired(spark, path, "fetched_at", "fetch_date", as_of, -30) == 4
    assert spark.read.parquet(path).count() == 0


def test_long_periods_are_written_without_a_shuffle(spark, tmp_path):
    frame = spark.range(0, 90, 1, 3).select(
        "id", F.when(F.col("id") % 10 == 9, None).otherwise(F.timestamp_seconds(F.col("id") * 86400 * 20)).alias("at"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for name, gather in (("gathered", True), ("left", False)):
        sinks.append_by_period(frame, str(tmp_path / name), "at", "at_date", "year", gather=gather)
    gathered, left = (spark.read.parquet(str(tmp_path / name)) for name in ("gathered", "left"))
    assert sorted(map(str, gathered.collect())) == sorted(map(str, left.collect())) and left.count() == 90
    # the nulls lie in every task and were not brought together
    assert len(left.where("at_date IS NULL").select(F.input_file_name()).distinct().collect()) == 3
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_payloads_are_parsed_once_in_a_branch(spark):
    known = payloads.Normalisers()
    frame = spark.createDataFrame([("1", "item_payload", '{"item":{"title":"a"}}')], "item_id string, adapter string, payload string")
    plan = known.apply(frame, ["item_payload"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
