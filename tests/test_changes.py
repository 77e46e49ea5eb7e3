"""Golden rows of change detection, versions and categories."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwatch.functions import fixed_values as V
from shelfwatch.functions.scalars import signed_percent
from shelfwatch.operators import changes, classify, versions

BASE = {
    "item_id": "T-1", "source_id": "s", "title": "夏季连衣裙", "price": 89.0, "original_price": 99.0, "stock": 420,
    "listing_status": "on_sale", "main_image": "v1", "promotion": "满199减30", "review_count": 100, "rating": 4.8,
    "sku_list": ["a", "b"],
}
SCHEMA = (
    "item_id string, source_id string, title string, price double, original_price double, stock bigint, listing_status string, "
    "main_image string, promotion string, review_count bigint, rating double, sku_list array<string>, fetched_at timestamp, seq bigint"
)
START = datetime(2024, 1, 1)


def records(spark, states):
    """One record per state (overrides of BASE), an hour apart."""
    rows = [{**BASE, **s, "fetched_at": START + timedelta(hours=n), "seq": n} for n, s in enumerate(states)]
    return versions.with_content_fp(spark.createDataFrame(rows, SCHEMA))


def events_of(spark, *states, exact=False, dedupe=versions.first_versions):
    pairs = versions.version_pairs(dedupe(records(spark, states)), changes.FIELDS)
    rows = changes.diff_events(pairs, exact=exact).orderBy("fetched_at", "check_no").collect()
    return [(r["field"], r["severity"]) for r in rows], rows


@pytest.mark.parametrize("change, expected", [
    ({"price": 69.0}, [("price", "P0")]),
    ({"stock": 100}, [("stock", "P1")]),
    ({"title": "夏季连衣裙 直播爆款新款"}, [("title", "P2")]),
    ({"promotion": "限时券20"}, [("promotion", "P1")]),
    ({"review_count": 150}, [("review_count", "P3")]),
    ({"review_count": 50}, []),
    ({"listing_status": "off_shelf"}, [("listing_status", "P0")]),
    ({"listing_status": "unknown"}, [("listing_status", "P0")]),
    ({"main_image": "v2"}, [("main_image", "P1")]),
    ({"rating": 4.6}, [("rating", "P1")]),
    ({"rating": 4.9}, []),
    ({"price": 80.1}, [("price", "P0")]),
    ({"price": 86.0}, [("price", "P1")]),
    ({"price": 88.0}, [("price", "P2")]),
    ({"price": 97.9}, [("price", "P1")]),
    ({"price": None}, []),
    ({"stock": 0}, [("stock", "P0")]),
    ({"stock": 210}, [("stock", "P1")]),
    ({"stock": 419}, [("stock", "P3")]),
    ({"sku_list": ["a", "c"]}, []),
    ({"main_image": None}, [("main_image", "P1")]),
    ({"title": None}, [("title", "P2")]),
])
def test_one_change(spark, change, expected):
    found, _ = events_of(spark, {}, change)
    assert found == expected


def test_edges_of_the_number_rules(spark):
    assert events_of(spark, {"price": 0.0}, {"price": 5.0})[0] == [("price", "P2")]
    assert events_of(spark, {"stock": 0}, {"stock": 9})[0] == [("stock", "P3")]
    assert events_of(spark, {"stock": 10}, {"stock": 5})[0] == [("stock", "P1")]
    # double arithmetic: 4.6 - 4.4 is a little less than 0.2; a cut from 1.1 to 0.99 a little less than a tenth
    assert events_of(spark, {"rating": 4.6}, {"rating": 4.4})[0] == []
    assert events_of(spark, {"rating": 4.6}, {"rating": 4.4}, exact=True)[0] == [("rating", "P1")]
    assert events_of(spark, {"price": 1.1}, {"price": 0.99}, exact=True)[0] == [("price", "P0")]


def test_texts(spark):
    _, rows = events_of(
        spark, {}, {"price": 69.0, "title": "夏季连衣裙 直播爆款新款", "listing_status": "off_shelf"}, {"listing_status": "on_sale", "stock": 1}
    )
    text = {(r["seq"], r["field"]): r["event"] for r in rows}
    assert text[(1, "price")] == "价格变动 -22.5%"
    assert text[(1, "title")] == "标题调整；新增卖点词 ['直播', '爆款', '新款']，丢失 无"
    assert text[(1, "listing_status")] == V.TEXT_OFF_SALE and text[(2, "listing_status")] == V.TEXT_ON_SALE
    assert (rows[0]["old_value"], rows[0]["new_value"]) == ("on_sale", "off_shelf")


def test_baseline_is_silent_and_grade_is_lowest(spark):
    pairs = versions.version_pairs(versions.first_versions(records(spark, [{}])), changes.FIELDS)
    events = changes.diff_events(pairs)
    assert events.count() == 0
    assert changes.top_severity(events).first()["top_severity"] == "P3"
    first = changes.baselines(pairs).first()
    assert (first["field"], first["severity"], first["new_value"]) == ("init", "P3", "on_sale")


def test_a_content_seen_before_makes_no_version(spark):
    a, b, c = {}, {"price": 50.0}, {"price": 45.5}
    assert versions.first_versions(records(spark, [a, b, a])).count() == 2
    _, rows = events_of(spark, a, b, a, c)
    assert [(r["old_num"], r["new_num"]) for r in rows] == [(89.0, 50.0), (50.0, 45.5)]
    _, rows = events_of(spark, a, b, a, dedupe=versions.changed_versions)
    assert [(r["old_num"], r["new_num"]) for r in rows] == [(89.0, 50.0), (50.0, 89.0)]


def test_a_content_is_new_again_after_the_retention_time(spark):
    a, b = {}, {"price": 50.0}
    rec = records(spark, [a, b] + [a] * 30)
    assert [r["seq"] for r in versions.versions_within(rec, 1).orderBy("seq").collect()] == [0, 1, 24]


def test_fingerprint_ignores_sku_order_but_not_null(spark):
    kept = versions.first_versions(records(spark, [{}, {"sku_list": ["b", "a"]}, {"promotion": ""}, {"promotion": None}]))
    assert [r["seq"] for r in kept.orderBy("seq").collect()] == [0, 2, 3]


def test_silent_versions_are_counted(spark):
    pairs = versions.version_pairs(versions.first_versions(records(spark, [{}, {"sku_list": ["z"]}, {"stock": 1}])), changes.FIELDS)
    assert [r["seq"] for r in changes.silent_versions(pairs).collect()] == [1]


def test_role_filter(spark):
    pairs = versions.version_pairs(
        versions.first_versions(records(spark, [{}, {"title": "x"}, {"listing_status": "off_shelf"}])), changes.FIELDS)
    events = changes.diff_events(pairs)

    def seen(role):
        targets = spark.createDataFrame([("T-1", role, 1)] if role else [], "item_id string, role string, priority int")
        rows = changes.visible_events(changes.with_role(events, targets)).orderBy("seq", "check_no").collect()
        return [r["severity"] for r in rows]

    assert seen("self") == ["P0"]
    assert seen("") == ["P0"] and seen(None) == ["P0"]
    assert seen("competitor") == ["P2", "P0", "P2"]


CATEGORY_CASES = [
    ("self", "price", 50.0, 40.0, "自有降价异常"),
    ("self", "price", 50.0, 49.0, "自有普通调价"),
    ("competitor", "price", 20.0, 15.0, "竞品降价"),
    ("competitor", "price", 15.0, 20.0, "竞品降价"),
    ("self", "price", 0.0, 3.0, "自有普通调价"),
    ("self", "price", None, 3.0, "自有普通调价"),
    ("self", "listing_status", "on_sale", "off_shelf", "自有下架"),
    ("competitor", "listing_status", "on_sale", "off_shelf", "竞品下架"),
    ("competitor", "listing_status", "off_shelf", "on_sale", ""),
    ("self", "stock", 25, 0, "自有断货"),
    ("competitor", "stock", 40, 0, "竞品断货"),
    ("partner", "stock", 8, 0, "竞品断货"),
    ("self", "stock", 10, 3, ""),
    ("self", "main_image", "v1", "v2", "主图换版"),
    ("self", "title", "x", "y", "标题改卖点词"),
    ("self", "promotion", "买二送一", "会员价", "促销机制变化"),
    ("self", "rating", 4.6, 4.1, "评分下滑"),
    ("self", "rating", 4.6, 4.5, ""),
    ("self", "review_count", 1, 2, ""),
    ("unknown", "listing_status", "on_sale", "off_shelf", "归属未知"),
]


def test_categories_and_actions(spark):
    number = lambda v: float(v) if isinstance(v, (int, float)) else None
    rows = [(n, r, f, str(new), number(old), number(new)) for n, (r, f, old, new, _) in enumerate(CATEGORY_CASES)]
    events = spark.createDataFrame(rows, "n int, role string, field string, new_value string, old_num double, new_num double")
    acted = classify.with_action(classify.with_category(events), classify.action_templates(spark)).orderBy("n").collect()
    assert [r["category"] for r in acted] == [c[-1] for c in CATEGORY_CASES]
    wanted = dict(V.ACTION_TEMPLATES)
    assert [r["action"] for r in acted] == [wanted.get(c[-1], "待人工判定") for c in CATEGORY_CASES]


def test_history_latest_and_strict_as_of(spark):
    rec = records(spark, [{"price": float(p)} for p in range(1, 8)])
    assert [r["price"] for r in versions.history(rec, 3).orderBy("nth").collect()] == [7.0, 6.0, 5.0]
    assert versions.latest(rec).first()["price"] == 7.0
    probes = spark.createDataFrame(
        [("T-1", START), ("T-1", START + timedelta(hours=2)), ("T-1", START + timedelta(hours=2, seconds=1)), ("none", START)],
        "item_id string, before timestamp")
    found = versions.previous_before(probes, rec, "before", ["price"]).orderBy("item_id", "before").collect()
    assert [r["prev_price"] for r in found] == [None, 2.0, 3.0, None]


def test_retention_counts(spark):
    rec = records(spark, [{"price": float(p)} for p in range(5)])
    as_of = START + timedelta(days=1, hours=2)
    assert versions.retained(rec, as_of, 1).count() == 3
    assert versions.expired_count(rec, as_of, 1).first()["expired"] == 2


def fold_events(states):
    """The rule as a plain loop over one item's records: store unseen contents, compare with the last stored."""
    seen, last, out = set(), None, []
    for n, (price, stock, title, rating) in enumerate(states):
        if (price, stock, title, rating) in seen:
            continue
        seen.add((price, stock, title, rating))
        if last is not None:
            if None not in (price, last[0]) and price != last[0]:
                ratio = 0.0 if last[0] == 0 else (price - last[0]) / abs(last[0])
                out.append((n, "price", "P0" if ratio <= -0.1 else "P1" if ratio <= -0.03 or ratio >= 0.1 else "P2"))
            if None not in (stock, last[1]) and stock != last[1]:
                ratio = 0.0 if last[1] == 0 else (stock - last[1]) / last[1]
                out.append((n, "stock", "P0" if stock == 0 else "P1" if ratio <= -0.5 else "P3"))
            if (title or "") != (last[2] or ""):
                out.append((n, "title", "P2"))
            if None not in (rating, last[3]) and last[3] - rating >= 0.2:
                out.append((n, "rating", "P1"))
        last = (price, stock, title, rating)
    return out


STATE = st.tuples(
    st.sampled_from([None, 0.0, 9.0, 9.9, 10.0, 11.0]), st.sampled_from([None, 0, 5, 10, 11]),
    st.sampled_from([None, "", "直播", "x"]), st.sampled_from([None, 4.4, 4.6, 4.8]),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(states=st.lists(STATE, min_size=1, max_size=25))
def test_set_based_diff_equals_a_plain_fold(spark, states):
    named = [dict(zip(("price", "stock", "title", "rating"), s, strict=True)) for s in states]
    _, rows = events_of(spark, *named)
    assert sorted((r["seq"], r["field"], r["severity"]) for r in rows) == sorted(fold_events(states))


def test_percent_texts_round_the_exact_value(spark):
    ratios = [0.0025, -0.0625, 0.1235, 0.0015, -0.0005, 0.0, 1.0, 0.99951, -0.07125, 1e-9, 12.34567, *[k / 4000 for k in range(-60, 60)], *[k / 997 for k in range(-50, 50)]]
    rows = spark.createDataFrame([(r,) for r in ratios], "r double").select("r", signed_percent(F.col("r")).alias("t")).collect()
    assert [(r.r, r.t) for r in rows if r.t != f"{r.r:+.1%}"] == []
