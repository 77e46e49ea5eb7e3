"""Views over the given star-schema tables that play the part of the engine's inputs.

``records``      lineitem x part        one observed item state per line
``targets``      part                   which items are ours, which are competitors'
``fetch_log``    events                 one fetch attempt per event
``payloads``     records as JSON text   raw item payloads
``envelopes``    payloads wrapped the way a remote API answers
``responses``    model answers as text, one per cycle and item, with the usual blemishes

Each view is narrow SQL over one or two tables, so column pruning and filters reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS_SQL = """
SELECT l_partkey AS item_id,
 concat('src', CAST(l_suppkey % 4 AS STRING)) AS source_id,
 l_shipdate AS fetched_at,
 l_orderkey * 8 + l_linenumber AS seq,
 floor(round(p_retailprice * 100) * CASE WHEN l_discount < 0.04 THEN 100 WHEN l_discount < 0.08 THEN 95 ELSE 88 END
   / CAST(100 AS DOUBLE)) / CAST(100 AS DOUBLE) AS price,
 p_retailprice AS original_price,
 CAST(CASE WHEN l_quantity < 8 THEN 0 WHEN l_quantity < 25 THEN 20 ELSE 50 END AS BIGINT) AS stock,
 CASE WHEN l_linestatus = 'F' AND l_linenumber >= 6 THEN 'off_shelf' ELSE 'on_sale' END AS listing_status,
 concat('img_v', CAST(l_suppkey % 2 AS STRING)) AS main_image,
 CASE WHEN l_returnflag = 'N' THEN 'none' ELSE 'coupon' END AS promotion,
 CASE WHEN l_tax < 0.05 THEN CAST(4.8 AS DOUBLE) ELSE CAST(4.5 AS DOUBLE) END AS rating,
 CAST(floor(l_linenumber / 4) * 100 AS BIGINT) AS review_count,
 concat(p_name, CASE WHEN l_orderkey % 5 = 0 THEN ' 限时' WHEN l_orderkey % 5 = 1 THEN ' 爆款新款' ELSE '' END) AS title,
 array(concat('sku-', CAST(l_partkey AS STRING), '-b'), concat('sku-', CAST(l_partkey AS STRING), '-a')) AS sku_list
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

TARGETS_SQL = """
SELECT p_partkey AS item_id, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN 'self' ELSE 'competitor' END AS role,
 1 + p_partkey % 3 AS priority
FROM {part} WHERE p_partkey % 5 <> 4
"""

FETCH_LOG_SQL = """
SELECT seq, source_id, ts, item_id, status, body, ok,
 concat('HTTPS://Api.Example.com/item?id=', CAST(item_id AS STRING), '&utm_source=', event_type,
   '&t=', CAST(seq AS STRING)) AS url,
 CASE WHEN ok AND seq % 50 = 7 THEN CAST(item_id + 1 AS STRING) WHEN ok AND seq % 50 = 8 THEN ''
   WHEN ok THEN CAST(item_id AS STRING) END AS returned_item_id
FROM (
 SELECT event_id AS seq, concat('src', CAST(user_id % 8 AS STRING)) AS source_id, ts, event_type,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS item_id,
  CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 6 = 0 THEN 429 WHEN event_id % 6 IN (1, 2) THEN 403
    WHEN event_id % 6 = 3 THEN 502 ELSE 200 END AS status,
  CASE WHEN event_type <> 'error' THEN '{{"code":0}}' WHEN event_id % 6 = 1 THEN 'invalid session'
    WHEN event_id % 6 = 4 THEN '{{"sub_code":"ISV_LIMIT"}}'
    WHEN event_id % 6 = 5 THEN '{{"sub_code":"CONTEXT_MISMATCH"}}' ELSE '' END AS body,
  event_type <> 'error' AS ok
 FROM {events}
)
"""


def table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """One of the given tables; dealt to ``partitions`` if given.

    A table of many files or row groups needs no such thing: its scan has tasks enough. One of a single row
    group is read by one task, and costly work per row (JSON, URLs) then runs in that task alone unless the
    caller, who knows the layout, asks for more.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows if partitions is None else rows.repartition(partitions)


def records(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    return spark.sql(RECORDS_SQL, lineitem=table(spark, sf_dir, "lineitem", partitions), part=table(spark, sf_dir, "part"))


def record_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and order of ``records`` straight from the fact table (what ``find_cuts`` needs to see)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        F.col("l_shipdate").alias("fetched_at"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TARGETS_SQL, part=table(spark, sf_dir, "part"))


def fetch_log(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    return spark.sql(FETCH_LOG_SQL, events=table(spark, sf_dir, "events", partitions))


# sources: suppliers with the policy columns a fetch source declares
SOURCES_SQL = """
SELECT concat('src', CAST(s_suppkey AS STRING)) AS source_id, s_suppkey AS ord, s_suppkey % 7 <> 6 AS enabled,
 CASE s_suppkey % 6 WHEN 0 THEN 'official_api' WHEN 1 THEN 'own_data' WHEN 2 THEN 'vendor' WHEN 3 THEN 'synthetic'
   WHEN 4 THEN '' ELSE 'scraped' END AS compliance,
 CAST(0.002 AS DOUBLE) AS qps, CAST(3 AS BIGINT) AS burst, CAST(30 + s_suppkey % 3 * 10 AS BIGINT) AS daily_quota,
 CAST(s_suppkey % 20 * 150 AS BIGINT) AS dedupe_ttl_seconds
FROM {supplier}
"""

# declarations: each supplier's source as the JSON document it declares itself with, some of them broken
DECLARATIONS_SQL = """
SELECT s_suppkey AS ord, CASE s_suppkey % 11
 WHEN 1 THEN '{{"id":"cut off' WHEN 2 THEN '[7]' WHEN 3 THEN '{{"enabled":true,"compliance":"vendor"}}'
 ELSE concat('{{"id":"src', CAST(s_suppkey AS STRING), '","enabled":', CASE s_suppkey % 11 WHEN 4 THEN '"yes"' WHEN 5 THEN 'false' ELSE 'true' END,
  ',"compliance":"', CASE s_suppkey % 11 WHEN 5 THEN '' WHEN 6 THEN '' WHEN 7 THEN 'scraped' ELSE 'vendor' END, '"',
  CASE s_suppkey % 11 WHEN 8 THEN ',"qps":"fast"' WHEN 9 THEN ',"qps":2,"daily_quota":1.5' WHEN 10 THEN ',"qps":0.25,"daily_quota":77' ELSE '' END, '}}') END AS declaration
FROM {supplier}
"""

# payloads: each record as the JSON a remote catalogue would send, with currency signs, text numbers and junk
PAYLOADS_SQL = """
SELECT item_id, source_id, seq, concat(
 '{{"item":{{', CASE WHEN seq % 13 = 0 THEN '' ELSE concat('"item_id":"', CAST(item_id AS STRING), '",') END,
 '"title":"', title, '","price":', CASE WHEN seq % 7 = 0 THEN concat('" ', CAST(price AS STRING), '元 "')
   WHEN seq % 11 = 0 THEN '"n/a"' ELSE CAST(price AS STRING) END,
 CASE WHEN seq % 5 = 0 THEN '' ELSE concat(',"original_price":', CAST(original_price AS STRING)) END,
 ',"stock":', CASE WHEN seq % 3 = 0 THEN concat('"', CAST(stock AS STRING), '.9"') ELSE CAST(stock AS STRING) END,
 CASE WHEN seq % 17 = 0 THEN '' ELSE concat(',"status":"', listing_status, '"') END,
 ',"main_image":"', main_image, '","promotion":"', promotion, '","review_count":', CAST(review_count AS STRING),
 ',"rating":', CAST(rating AS STRING), ',"skus":[{{"sku_id":"b"}},{{"sku_id":"a"}}]}}}}') AS payload
FROM {records}
"""

ENVELOPES_SQL = """
SELECT item_id, seq, CASE seq % 5 WHEN 0 THEN concat('{{"code":0,"result":', payload, '}}')
 WHEN 1 THEN concat('{{"code":"200","result":', payload, '}}') WHEN 2 THEN '{{"error_response":{{"code":27,"msg":"x"}}}}'
 WHEN 3 THEN payload ELSE '{{"code":"0"}}' END AS body
FROM {payloads}
"""

# http answers: one per event, covering every branch of the response rules
HTTP_SQL = """
SELECT event_id AS seq, CAST(CASE event_id % 20 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 401 WHEN 3 THEN 403
  WHEN 4 THEN 502 ELSE 200 END AS INT) AS status,
 CASE event_id % 20 WHEN 0 THEN '{{"code":429}}' WHEN 2 THEN 'Invalid  Session' WHEN 3 THEN 'denied' WHEN 4 THEN '<html>'
  WHEN 5 THEN '请完成滑块验证' WHEN 6 THEN 'captcha required' WHEN 7 THEN 'CAPTCHA REQUIRED'
  WHEN 8 THEN '{{"sub_code":"item_not_match"}}' WHEN 9 THEN '{{"msg":"签名错误"}}' WHEN 10 THEN '{{"msg":"sign error"}}'
  WHEN 11 THEN '{{"error_code":"InvalidSession"}}' WHEN 12 THEN '{{"sub_code":"ISV_LIMIT"}}'
  WHEN 13 THEN '{{"msg":"API 调用频繁"}}' WHEN 14 THEN '{{"sub_code":"isv.limit"}}' WHEN 15 THEN 'Too Many Requests'
  WHEN 16 THEN '{{"code":0,"error_code":"DATA_MISMATCH"}}' WHEN 17 THEN '{{"code":"0","error_code":"DATA_MISMATCH"}}'
  WHEN 18 THEN '{{"code":"sign error' WHEN 19 THEN concat('{{"k":"', event_type, '"}}') ELSE '' END AS body
FROM {events}
"""

# event documents and scorer answers: one per record, clean and blemished
EVENT_DOCUMENTS_SQL = """
SELECT seq, item_id AS asked, CASE WHEN seq % 9 = 0 THEN '[{{broken' WHEN seq % 9 = 1 THEN '{{"item_id":"x"}}' WHEN seq % 9 = 2 THEN ''
 ELSE concat('[{{"item_id":"', CAST(item_id AS STRING), '"',
  CASE item_id % 4 WHEN 0 THEN ',"role":"self"' WHEN 1 THEN ',"role":"competitor"' WHEN 2 THEN ',"role":""' ELSE '' END,
  ',"severity":"P1","field":"price","old_value":', CAST(original_price AS STRING), ',"new_value":', CAST(price AS STRING), '}},7,',
  '{{"item_id":"', CAST(item_id AS STRING), '","role":"self","field":"stock","old_value":10,"new_value":',
  CASE WHEN seq % 4 = 0 THEN '"0"' ELSE CAST(stock AS STRING) END, '}}]') END AS diff_events
FROM {records}
"""

RESPONSES_SQL = """
SELECT seq, CASE kind WHEN 0 THEN concat('{{"events":[', a, ',', b, '],"summary":"all"}}')
 WHEN 1 THEN concat('```json\n{{"events":[', a, '],"summary":""}}\n```')
 WHEN 2 THEN concat('Here it is: {{"events":[', b, '],"summary":"two"}} done.')
 WHEN 3 THEN concat('{{"events":[', a, ',{{"summary":"kept ', CAST(seq AS STRING), '"}}],"summary":""}}')
 WHEN 4 THEN '{{"events":"oops","summary":"x"}}' WHEN 5 THEN concat('{{"events":[', a)
 WHEN 6 THEN 'nothing to report' ELSE '[]' END AS response
FROM (
 SELECT seq, seq % 8 AS kind,
  concat('{{"item_id":"a', CAST(item_id AS STRING), '","severity":"', CASE stock WHEN 0 THEN 'P0' WHEN 20 THEN 'p0' ELSE 'P2' END,
   '","attribution":"moved by ', CAST(stock AS STRING), '","action":"', CASE WHEN item_id % 3 = 0 THEN 'match price' ELSE '' END,
   '","priority_reason":"rule","priority_keep":true}}') AS a,
  concat('{{"item_id":"b', CAST(item_id AS STRING), '","severity":"P1","priority_keep":', CASE item_id % 5 WHEN 0 THEN 'true'
   WHEN 1 THEN 'false' WHEN 2 THEN 'null' WHEN 3 THEN '"false"' ELSE '0' END, '}}') AS b
 FROM {records})
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SOURCES_SQL, supplier=table(spark, sf_dir, "supplier"))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DECLARATIONS_SQL, supplier=table(spark, sf_dir, "supplier"))


def payloads(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    return spark.sql(PAYLOADS_SQL, records=records(spark, sf_dir, partitions))


def envelopes(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    return spark.sql(ENVELOPES_SQL, payloads=payloads(spark, sf_dir, partitions))


def http_answers(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    return spark.sql(HTTP_SQL, events=table(spark, sf_dir, "events", partitions))


def event_documents(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    return spark.sql(EVENT_DOCUMENTS_SQL, records=records(spark, sf_dir, partitions))


def responses(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    return spark.sql(RESPONSES_SQL, records=records(spark, sf_dir, partitions))
