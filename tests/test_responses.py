"""Golden rows of event documents, scorer answers and routing."""

import json

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import responses


def parse(spark, text):
    frame = spark.createDataFrame([(1, text)], "id int, response string")
    return responses.push_rollup(responses.parse_response(frame)).first()


EVENT = '{"item_id":"A1","severity":"%s","category":"c","priority_keep":%s}'


@pytest.mark.parametrize("text, count, summary, push", [
    ('{"events":[{"item_id":"mug-7","severity":"P3","category":"c","priority_keep":true},{"summary":"left in the list"}],"summary":""}', 1, "left in the list", False),
    ('Here it is:\n```json\n{"events":[{"item_id":"mug-7","severity":"P0","category":"c","priority_keep":true}]}\n```', 1, "", True),
    ("No structured answer today.", 0, "", False),
    ('{"events":{"item_id":"mug-7"},"summary":"not a list"}', 0, "not a list", False),
    ("[]", 0, "", False),
    ("123", 0, "", False),
    ("{broken", 0, "", False),
    ("", 0, "", False),
    (None, 0, "", False),
    ('{"events":[' + EVENT % ("p0", "true") + '],"summary":"s"}', 1, "s", True),
    ('{"events":[' + EVENT % ("P1", "false") + "]}", 1, "", True),
    ('{"events":[' + EVENT % ("P1", '"false"') + "]}", 1, "", False),
    ('{"events":[' + EVENT % ("P1", "null") + "]}", 1, "", False),
    ('{"events":[' + EVENT % ("P1", "0") + "]}", 1, "", False),
    ('{"events":[{"item_id":"","summary":"first"},{"summary":"second"},5,"x",null],"summary":null}', 0, "first", False),
    ('before {"events":[],"summary":"s {nested}"} after', 0, "s {nested}", False),
])
def test_tolerant_parse(spark, text, count, summary, push):
    row = parse(spark, text)
    assert (row["event_count"], row["summary"], row["need_push"]) == (count, summary, push)


def test_pushed_items_keep_order_and_repeats(spark):
    items = [("b", "P0", "true"), ("a", "P1", "false"), ("c", "P1", "true"), ("b", "P0", "null")]
    text = '{"events":[' + ",".join('{"item_id":"%s","severity":"%s","priority_keep":%s}' % i for i in items) + "]}"
    row = parse(spark, text)
    assert row["pushed_items"] == ["b", "a", "b"] and row["event_count"] == 4


def test_routes_split_every_answer(spark):
    frame = spark.createDataFrame(
        [(1, '{"events":[' + EVENT % ("P0", "true") + '],"summary":"hot"}'), (2, '{"events":[],"summary":"calm"}'), (3, "junk")],
        "id int, response string")
    rolled = responses.push_rollup(responses.parse_response(frame).drop("response"))
    assert [tuple(r) for r in responses.alerts(rolled).collect()] == [(1, "hot", ["A1"])]
    assert sorted(tuple(r) for r in responses.digest(rolled).collect()) == [(2, "calm", 0), (3, "", 0)]


def test_event_documents(spark):
    docs = [
        json.dumps([{"item_id": "A", "role": "self", "field": "price", "old_value": 89.0, "new_value": 80.1}, 5, "x", None]),
        json.dumps([{"item_id": "B", "field": "stock", "old_value": 10, "new_value": 0}]),
        json.dumps([{"item_id": "C", "role": "competitor", "field": "stock", "old_value": 10, "new_value": "0"}]),
        json.dumps([{"item_id": "D", "role": "competitor", "field": "stock", "old_value": 10, "new_value": False}]),
        "{}", "[broken", "", None,
    ]
    frame = spark.createDataFrame([(n, d) for n, d in enumerate(docs)], "n int, diff_events string")
    rows = responses.parse_events_json(frame).orderBy("n").collect()
    assert [(r["item_id"], r["role"], r["category"]) for r in rows] == [
        ("A", "self", "自有降价异常"), ("B", "unknown", "归属未知"), ("C", "competitor", ""), ("D", "competitor", "竞品断货")]


def test_bundle_is_valid_json_in_order_and_goes_into_the_prompt(spark):
    rows = [("c1", f"i{n}", "self", "P1", "price", "1", "2", "价格", "", n, 2) for n in range(7)]
    events = spark.createDataFrame(
        rows, "cycle_id string, item_id string, role string, severity string, field string, old_value string, new_value string, "
        "event string, category string, seq bigint, check_no int")
    bundles = responses.events_bundle(events, max_events=3)
    parts = bundles.orderBy("part_no").collect()
    assert [r["event_count"] for r in parts] == [3, 3, 1]
    assert [e["item_id"] for r in parts for e in json.loads(r["events_json"])] == [f"i{n}" for n in range(7)]
    prompt = responses.prompt_rows(bundles, "<<{events}>>").orderBy("part_no").first()["prompt"]
    assert prompt == f"<<{parts[0]['events_json']}>>"


def test_bundles_gather_texts_not_structs(spark):
    events = spark.createDataFrame(
        [("c", n, n % 2, None if n % 3 else '"', "r", "P1", "f", "o", "n", "e\\", "k") for n in range(7)],
        "cycle_id string, item_id long, seq long, old_value string, role string, severity string, field string, x string, new_value string, event string, category string")
    bundles = responses.events_bundle(events, order=["item_id"], max_events=4)
    plan = bundles._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(collect_list(struct(_nth" in plan and ", e, invoke(StructsToJson" in plan
    first = json.loads(bundles.orderBy("part_no").first()["events_json"])
    assert [e["item_id"] for e in first] == [0, 1, 2, 3]
    assert [e.get("old_value") for e in first] == ['"', None, None, '"'] and first[0]["event"] == "e\\"


def test_rule_alerts_without_an_answer(spark):
    events = spark.createDataFrame([("a", "P0"), ("b", "P1"), ("c", None)], "item_id string, severity string")
    assert [r["item_id"] for r in responses.rule_alerts(events).collect()] == ["a"]


def test_need_push_truth_table(spark):
    rows = [("P0", True), ("p0", None), ("P1", False), ("P1", True), ("P1", None), (None, None), (None, False)]
    frame = spark.createDataFrame(rows, "severity string, keep boolean")
    got = frame.select(responses.need_push(F.col("severity"), F.col("keep")).alias("p")).collect()
    assert [r["p"] for r in got] == [True, True, True, False, False, False, True]


def test_advice_is_kept(spark):
    text = '{"events":[{"item_id":"mug-7","severity":"P1","attribution":"season","action":"wait","priority_reason":""}]}'
    frame = spark.createDataFrame([(1, text)], "id int, response string")
    event = responses.parse_response(frame).first()["events"][0]
    assert (event["attribution"], event["action"], event["priority_reason"]) == ("season", "wait", None)


def test_a_filter_on_the_events_does_not_parse_again(spark):
    answers = spark.range(3).selectExpr("id AS seq", "concat('{\"events\":[{\"item_id\":\"', id, '\"}]}') AS response")
    parsed = responses.parse_response(answers)
    parses = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(")
    for rows in (responses.digest(responses.push_rollup(parsed)), parsed.select("seq", F.explode("events"))):
        assert parses(rows) == parses(parsed) > 0
        assert rows.count() == 3
