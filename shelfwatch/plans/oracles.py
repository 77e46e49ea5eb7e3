"""The same results in ANSI SQL for a second engine, written from the rules and not from the Spark code."""

from __future__ import annotations

from ..functions import fixed_values as V
from ..sources import tables


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return ", ".join(_q(v) for v in values)


_F1 = tables.RECORDS_SQL.format(lineitem="lineitem", part="part").replace("array(", "list_value(")
_LOG = tables.FETCH_LOG_SQL.format(events="events")
_TARGETS = tables.TARGETS_SQL.format(part="part")
_SOURCES = tables.SOURCES_SQL.format(supplier="supplier")
_CONTENT = "item_id, price, original_price, stock, listing_status, main_image, promotion, rating, review_count, title"
_WORDS = "[" + _in(V.TITLE_SELL_WORDS) + "]"

_RECORDS = f"f1 AS ({_F1})"
_KEPT = f"""{_RECORDS},
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_CONTENT} ORDER BY fetched_at, seq) AS nth FROM f1) WHERE nth = 1)"""
_PAIRS = _KEPT + """,
pairs AS (SELECT *, lag(seq) OVER w AS p_seq, lag(price) OVER w AS p_price, lag(stock) OVER w AS p_stock,
  lag(listing_status) OVER w AS p_status, lag(main_image) OVER w AS p_image, lag(promotion) OVER w AS p_promotion,
  lag(rating) OVER w AS p_rating, lag(review_count) OVER w AS p_reviews, lag(title) OVER w AS p_title
  FROM kept WINDOW w AS (PARTITION BY item_id ORDER BY fetched_at, seq))"""


def _word_list(have: str, have_not: str) -> str:
    return f"[x FOR x IN {_WORDS} IF contains({have}, x) AND NOT contains({have_not}, x)]"


def _shown(words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN '{V.TEXT_NO_WORDS}' ELSE concat('[''', array_to_string({words}, ''', '''), ''']') END"


_GAINED, _LOST = _word_list("title", "p_title"), _word_list("p_title", "title")
_RATIO = "CASE WHEN p_price = 0 THEN 0.0 ELSE (price - p_price) / abs(p_price) END"
_STOCK_RATIO = "CASE WHEN p_stock = 0 THEN CAST(0 AS DOUBLE) ELSE (CAST(stock AS DOUBLE) - p_stock) / abs(CAST(p_stock AS DOUBLE)) END"


def _branch(no: int, field: str, cond: str, sev: str, old: str, new: str, text: str,
            old_num: str = "NULL", new_num: str = "NULL", ratio: str = "NULL") -> str:
    return f"""SELECT item_id, source_id, fetched_at, seq, CAST({no} AS INTEGER) AS check_no, '{field}' AS field, {sev} AS severity,
 CAST({old} AS VARCHAR) AS old_value, CAST({new} AS VARCHAR) AS new_value, CAST({old_num} AS DOUBLE) AS old_num,
 CAST({new_num} AS DOUBLE) AS new_num, CAST({ratio} AS DOUBLE) AS ratio, {text} AS event
 FROM pairs WHERE p_seq IS NOT NULL AND ({cond})"""


_BRANCHES = {
    "listing_status": _branch(1, "listing_status", "listing_status <> p_status", "'P0'", "p_status", "listing_status",
                              f"CASE WHEN listing_status = 'on_sale' THEN '{V.TEXT_ON_SALE}' ELSE '{V.TEXT_OFF_SALE}' END"),
    "price": _branch(2, "price", "price <> p_price",
                     f"CASE WHEN {_RATIO} <= CAST(-0.1 AS DOUBLE) THEN 'P0' WHEN {_RATIO} <= CAST(-0.03 AS DOUBLE) OR {_RATIO} >= CAST(0.1 AS DOUBLE) THEN 'P1' ELSE 'P2' END",
                     "p_price", "price", f"concat('{V.TEXT_PRICE}', printf('%+.1f%%', ({_RATIO}) * 100))", "p_price", "price", _RATIO),
    "stock": _branch(3, "stock", "stock <> p_stock",
                     f"CASE WHEN stock = 0 THEN 'P0' WHEN {_STOCK_RATIO} <= CAST(-0.5 AS DOUBLE) THEN 'P1' ELSE 'P3' END",
                     "p_stock", "stock", f"'{V.TEXT_STOCK}'", "p_stock", "stock", _STOCK_RATIO),
    "main_image": _branch(4, "main_image", "main_image <> p_image", "'P1'", f"'{V.TEXT_OLD_IMAGE}'", f"'{V.TEXT_NEW_IMAGE}'", f"'{V.TEXT_IMAGE}'"),
    "title": _branch(5, "title", "title <> p_title", "'P2'", "substr(p_title, 1, 60)", "substr(title, 1, 60)",
                     f"concat('{V.TEXT_TITLE_GAINED}', {_shown(_GAINED)}, '{V.TEXT_TITLE_LOST}', {_shown(_LOST)})"),
    "promotion": _branch(6, "promotion", "promotion <> p_promotion", "'P1'", "p_promotion", "promotion", f"'{V.TEXT_PROMOTION}'"),
    "review_count": _branch(7, "review_count", "review_count > p_reviews", "'P3'", "p_reviews", "review_count",
                            f"'{V.TEXT_REVIEWS}'", "p_reviews", "review_count"),
    "rating": _branch(8, "rating", "p_rating - rating >= CAST(0.2 AS DOUBLE)", "'P1'", "p_rating", "rating", f"'{V.TEXT_RATING}'", "p_rating", "rating"),
}
_EVENTS = _PAIRS + ",\nchg AS (" + "\nUNION ALL ".join(_BRANCHES.values()) + ")"
_ROLED = _EVENTS + f""",
targets AS ({_TARGETS}),
roled AS (SELECT c.*, coalesce(nullif(t.role, ''), 'unknown') AS role, t.priority FROM chg c LEFT JOIN targets t USING (item_id))"""


def _category(role: str, field: str, new: str, old_num: str, new_num: str) -> str:
    return f"""CASE WHEN {role} = 'unknown' THEN '{V.CATEGORY_UNKNOWN_ROLE}'
 WHEN {field} = 'price' THEN CASE WHEN {role} <> 'self' THEN '{V.CATEGORY_RIVAL_PRICE}'
   WHEN {old_num} <> 0 AND ({old_num} - {new_num}) / {old_num} >= CAST(0.1 AS DOUBLE) THEN '{V.CATEGORY_SELF_PRICE_ALARM}' ELSE '{V.CATEGORY_SELF_PRICE}' END
 WHEN {field} = 'listing_status' THEN CASE WHEN {new} = 'on_sale' THEN '' WHEN {role} = 'self' THEN '{V.CATEGORY_SELF_OFF}' ELSE '{V.CATEGORY_RIVAL_OFF}' END
 WHEN {field} = 'stock' THEN CASE WHEN {new_num} IS NULL OR {new_num} <> 0 THEN '' WHEN {role} = 'self' THEN '{V.CATEGORY_SELF_NO_STOCK}' ELSE '{V.CATEGORY_RIVAL_NO_STOCK}' END
 WHEN {field} = 'main_image' THEN '{V.CATEGORY_IMAGE}' WHEN {field} = 'title' THEN '{V.CATEGORY_TITLE}'
 WHEN {field} = 'promotion' THEN '{V.CATEGORY_PROMOTION}'
 WHEN {field} = 'rating' AND {old_num} - {new_num} >= CAST(0.2 AS DOUBLE) THEN '{V.CATEGORY_RATING}' ELSE '' END"""


_CLASSED = _ROLED + f""",
visible AS (SELECT * FROM roled WHERE role = 'competitor' OR severity IN ('P0', 'P1')),
classed AS (SELECT *, {_category('role', 'field', 'new_value', 'old_num', 'new_num')} AS category,
  strftime(fetched_at, '%Y-%m-%d') AS cycle_id FROM visible)"""
_EVENT = "item_id, source_id, seq, check_no, field, severity, old_value, new_value, old_num, new_num, ratio"

_OUTCOME = f"""log AS ({_LOG}),
attempts AS (SELECT *, CASE WHEN NOT ok THEN CASE WHEN status = 429 THEN 'rate_limited'
   WHEN status = 403 THEN CASE WHEN regexp_matches(body, 'invalid\\s+session', 'i') THEN 'auth_expired' ELSE 'rate_limited' END
   WHEN status >= 500 THEN 'transport_error' WHEN contains(body, 'CONTEXT_MISMATCH') THEN 'context_mismatch'
   WHEN contains(body, 'ISV_LIMIT') THEN 'rate_limited' ELSE 'transport_error' END
  WHEN returned_item_id = '' THEN 'transport_error' WHEN returned_item_id <> CAST(item_id AS VARCHAR) THEN 'context_mismatch' ELSE 'ok' END AS outcome FROM log)"""

# breaker and pause state as a plain left-to-right fold over each source's attempts
_FOLD = "WITH RECURSIVE " + _OUTCOME + f""",
numbered AS (SELECT source_id, seq, ts, outcome, row_number() OVER (PARTITION BY source_id ORDER BY ts, seq) AS n,
  CASE WHEN outcome IN ({_in(V.INSTANT_OPEN_ANOMALIES)}) THEN 5 ELSE 1 END AS w FROM attempts),
fold AS (
 SELECT source_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS TIMESTAMP) AS ts,
  CAST(0 AS BIGINT) AS run_failures, CAST(0 AS BIGINT) AS opens, CAST(0 AS BIGINT) AS streak, CAST(0 AS BIGINT) AS total,
  false AS opened, false AS paused, false AS newly, CAST('' AS VARCHAR) AS cause, CAST('' AS VARCHAR) AS why, CAST(NULL AS DOUBLE) AS cooldown
 FROM (SELECT DISTINCT source_id FROM numbered)
 UNION ALL
 SELECT source_id, n, seq, outcome, ts, rf, op, st, tot, opened, paused OR cause IS NOT NULL, NOT paused AND cause IS NOT NULL, coalesce(cause, ''),
  CASE cause WHEN 'opens' THEN concat('连续熔断 ', op, ' 次，人工确认后恢复') WHEN 'failures' THEN concat('连续 ', st, ' 次失败未恢复（累计 ', tot, ' 次），人工确认后恢复') ELSE why END,
  CASE WHEN opened THEN least(60.0 * pow(2.0, least(op - 1, 1000)), 3600.0) END
 FROM (SELECT *, CASE WHEN opened AND op >= 3 THEN 'opens' WHEN opened AND st >= 5 THEN 'failures' END AS cause
  FROM (SELECT *, CAST(opens + CASE WHEN opened THEN 1 ELSE 0 END AS BIGINT) AS op
   FROM (SELECT *, outcome <> 'ok' AND rf >= 5 AS opened
    FROM (SELECT b.source_id, b.n, b.seq, b.outcome, b.ts, a.opens, a.paused, a.why,
      CAST(CASE WHEN b.outcome = 'ok' THEN 0 ELSE a.run_failures + b.w END AS BIGINT) AS rf,
      CAST(CASE WHEN b.outcome = 'ok' THEN 0 ELSE a.streak + 1 END AS BIGINT) AS st,
      CAST(a.total + CASE WHEN b.outcome = 'ok' THEN 0 ELSE 1 END AS BIGINT) AS tot
     FROM fold a JOIN numbered b ON a.source_id = b.source_id AND b.n = a.n + 1))))
)"""

_HITS = "WITH RECURSIVE " + f"""log AS ({_LOG}),
req AS (SELECT source_id, item_id, seq, ok, epoch_us(ts) AS t, row_number() OVER (PARTITION BY source_id, item_id ORDER BY ts, seq) AS n FROM log),
fold AS (
 SELECT source_id, item_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, false AS hit, CAST(NULL AS BIGINT) AS anchor, false AS ok FROM (SELECT DISTINCT source_id, item_id FROM req)
 UNION ALL
 SELECT b.source_id, b.item_id, b.n, b.seq, coalesce(b.t - a.anchor < 21600000000, false),
  CASE WHEN b.ok AND NOT coalesce(b.t - a.anchor < 21600000000, false) THEN b.t ELSE a.anchor END, b.ok
 FROM fold a JOIN req b ON a.source_id = b.source_id AND a.item_id = b.item_id AND b.n = a.n + 1)"""

_ALIVE = """, remembered AS (SELECT source_id, item_id, max(anchor) AS newest FROM fold GROUP BY source_id, item_id HAVING max(anchor) IS NOT NULL),
ends AS (SELECT source_id, max(newest) AS stop FROM remembered GROUP BY source_id),
alive AS (SELECT source_id, count(*) AS cached_requests FROM remembered JOIN ends USING (source_id) WHERE stop - newest <= 21600000000 GROUP BY source_id)"""
_ALIVE_IN_HEALTH = (_HITS + _ALIVE).split("req AS", 1)[1].replace("fold", "hits")

_PRICE_TEXT = "CASE WHEN seq % 7 <> 0 AND seq % 11 = 0 THEN NULL ELSE price END"
_PAYLOADS = f"""{_RECORDS}, payloads AS ({tables.PAYLOADS_SQL.format(records='f1')})"""
_ANSWERS = f"""{_RECORDS},
ans AS (SELECT seq, seq % 8 AS kind, concat('a', item_id) AS ida, concat('b', item_id) AS idb, CASE stock WHEN 0 THEN 'P0' WHEN 20 THEN 'p0' ELSE 'P2' END AS sva,
  stock < 50 AS pusha, concat('moved by ', stock) AS why, CASE WHEN item_id % 3 = 0 THEN 'match price' END AS todo, item_id % 5 = 1 AS pushb, CASE item_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS keepb FROM f1),
summ AS (SELECT *, CASE kind WHEN 0 THEN 'all' WHEN 2 THEN 'two' WHEN 3 THEN concat('kept ', seq) WHEN 4 THEN 'x' ELSE '' END AS summary FROM ans),
evs AS (SELECT seq, summary, 0 AS pos, ida AS item_id, sva AS severity, true AS priority_keep, pusha AS need_push, why AS attribution, todo AS action, 'rule' AS priority_reason FROM summ WHERE kind IN (0, 1, 3)
 UNION ALL SELECT seq, summary, CASE kind WHEN 0 THEN 1 ELSE 0 END, idb, 'P1', keepb, pushb, NULL, NULL, NULL FROM summ WHERE kind IN (0, 2)),
roll AS (SELECT s.seq, s.summary, count(e.seq) AS event_count, coalesce(bool_or(e.need_push), false) AS need_push,
  coalesce(string_agg(e.item_id, ',' ORDER BY e.pos) FILTER (WHERE e.need_push), '') AS pushed_items
  FROM summ s LEFT JOIN evs e USING (seq) GROUP BY s.seq, s.summary)"""
# seq is unique per record only together with the item and the day, so answers are rolled up by row number
_ANSWERS = _ANSWERS.replace("SELECT seq, seq % 8 AS kind", "SELECT row_number() OVER () AS rid, seq, seq % 8 AS kind") \
    .replace("SELECT seq, summary, 0 AS pos", "SELECT rid, seq, summary, 0 AS pos") \
    .replace("UNION ALL SELECT seq, summary, CASE kind", "UNION ALL SELECT rid, seq, summary, CASE kind") \
    .replace("LEFT JOIN evs e USING (seq) GROUP BY s.seq, s.summary", "LEFT JOIN evs e USING (rid) GROUP BY s.rid, s.seq, s.summary")

_CODE = "coalesce(nullif(CASE WHEN json_type(d, '$.{a}') IN ('UBIGINT', 'BIGINT') AND json_extract_string(d, '$.{a}') = '0' THEN '' ELSE json_extract_string(d, '$.{a}') END, ''), json_extract_string(d, '$.{b}'), '')"
_CODES = "concat(" + ", '|', ".join([
    _CODE.format(a="code", b="error_code"), _CODE.format(a="sub_code", b="error_description"), _CODE.format(a="msg", b="message")]) + ")"


def _anomaly(rate_codes: str) -> str:
    return f"""CASE WHEN status IN (429, 503) THEN 'rate_limited'
 WHEN status IN (401, 403) THEN CASE WHEN regexp_matches(body, {_q(V.AUTH_PATTERN)}, 'i') THEN 'auth_expired' ELSE 'rate_limited' END
 WHEN status >= 500 THEN 'transport_error' WHEN regexp_matches(body, {_q(V.VERIFY_PATTERN)}) THEN 'verify_required'
 WHEN {' OR '.join(f"contains(codes, '{c}')" for c in V.CONTEXT_CODES)} THEN 'context_mismatch'
 WHEN regexp_matches(body, {_q(V.AUTH_PATTERN)}, 'i') OR contains(codes, 'INVALIDSESSION') OR (contains(codes, 'SIGN') AND contains(codes, 'ERROR')) THEN 'auth_expired'
 WHEN regexp_matches(body, {_q(V.RATE_PATTERN)}, 'i') OR {rate_codes} THEN 'rate_limited' END"""


_HTTP = f"""WITH h AS ({tables.HTTP_SQL.format(events='events')}), j AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS d FROM h),
 c AS (SELECT *, upper({_CODES}) AS codes FROM j)"""

_CYCLES = _EVENTS + ", " + _HITS.removeprefix("WITH RECURSIVE ") + """,
att AS (SELECT strftime(fetched_at, '%Y-%m-%d') AS cycle_id, true AS ok, false AS cached, epoch_us(fetched_at) AS t FROM f1
 UNION ALL SELECT strftime(l.ts, '%Y-%m-%d'), l.ok OR f.hit, f.hit, epoch_us(l.ts) FROM fold f JOIN log l ON f.seq = l.seq),
parts AS (SELECT cycle_id, CASE WHEN ok AND NOT cached THEN 1 ELSE 0 END AS fetched, CASE WHEN ok AND cached THEN 1 ELSE 0 END AS cached,
   CASE WHEN NOT ok THEN 1 ELSE 0 END AS skipped, 0 AS saved, 0 AS events FROM att
 UNION ALL SELECT strftime(fetched_at, '%Y-%m-%d'), 0, 0, 0, 1, 0 FROM kept
 UNION ALL SELECT strftime(fetched_at, '%Y-%m-%d'), 0, 0, 0, 0, 1 FROM chg),
stats AS (SELECT cycle_id, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(skipped) AS BIGINT) AS skipped,
  CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(events) AS BIGINT) AS events FROM parts GROUP BY cycle_id)"""

_ACTIONS = "acts(category, action) AS (VALUES " + ", ".join(f"({_q(c)}, {_q(a)})" for c, a in V.ACTION_TEMPLATES) + ")"


def _check(field: str, columns: str) -> str:
    return f"WITH {_PAIRS}, chg AS ({_BRANCHES[field]}) SELECT item_id, seq, severity, {columns} FROM chg"


ORACLES: dict[str, str] = {
    "diff_events": f"WITH {_EVENTS} SELECT {_EVENT} FROM chg",
    "diff_events_exact": f"""WITH {_EVENTS} SELECT item_id, seq, field, CASE WHEN field <> 'price' THEN severity
 WHEN (CAST(new_num AS DECIMAL(18,2)) - CAST(old_num AS DECIMAL(18,2))) * 10 <= -CAST(old_num AS DECIMAL(18,2)) THEN 'P0'
 WHEN (CAST(new_num AS DECIMAL(18,2)) - CAST(old_num AS DECIMAL(18,2))) * 100 <= -3 * CAST(old_num AS DECIMAL(18,2))
   OR (CAST(new_num AS DECIMAL(18,2)) - CAST(old_num AS DECIMAL(18,2))) * 10 >= CAST(old_num AS DECIMAL(18,2)) THEN 'P1' ELSE 'P2' END AS severity FROM chg""",
    "diff_events_by_role": f"WITH {_ROLED} SELECT {_EVENT}, role FROM roled WHERE role = 'competitor' OR severity IN ('P0', 'P1')",
    "event_texts": f"WITH {_EVENTS} SELECT item_id, seq, field, event FROM chg",
    "version_pairs": f"WITH {_PAIRS} SELECT item_id, seq, p_seq AS prev_seq, p_price AS prev_price FROM pairs",
    "chg_status": _check("listing_status", "old_value, new_value, event"),
    "chg_price": _check("price", "old_num, new_num, ratio"),
    "chg_stock": _check("stock", "old_value, new_value, ratio"),
    "chg_image": _check("main_image", "old_value, new_value"),
    "chg_title": _check("title", "old_value, new_value, event"),
    "chg_promotion": _check("promotion", "old_value, new_value"),
    "chg_reviews": _check("review_count", "old_value, new_value"),
    "chg_rating": _check("rating", "old_num, new_num"),
    "title_words": f"""WITH {_PAIRS} SELECT item_id, seq, array_to_string({_GAINED}, ',') AS gained, array_to_string({_LOST}, ',') AS lost
 FROM pairs WHERE p_seq IS NOT NULL""",
    "baselines": f"WITH {_PAIRS} SELECT item_id, seq, 'init' AS field, 'P3' AS severity, listing_status AS new_value FROM pairs WHERE p_seq IS NULL",
    "silent_versions": f"""WITH {_PAIRS.replace('f1 AS (', 'f0 AS (', 1).replace(')' + chr(44) + chr(10) + 'kept', '), f1 AS (SELECT * REPLACE (original_price + CAST(seq % 2 AS DOUBLE) AS original_price) FROM f0),' + chr(10) + 'kept', 1)}
 SELECT item_id, seq FROM pairs WHERE p_seq IS NOT NULL AND listing_status = p_status AND price = p_price AND stock = p_stock AND main_image = p_image
 AND title = p_title AND promotion = p_promotion AND review_count <= p_reviews AND p_rating - rating < CAST(0.2 AS DOUBLE)""",
    "top_severity": f"WITH {_CLASSED} SELECT cycle_id, min(severity) AS top_severity FROM classed GROUP BY cycle_id",
    "severity_rollup": f"WITH {_ROLED} SELECT role, severity, count(*) AS events FROM roled GROUP BY ROLLUP (role, severity)",
    "content_fp": f"""WITH {_RECORDS}, d AS (SELECT DISTINCT {_CONTENT} FROM f1), c AS (SELECT item_id, count(*) AS contents FROM d GROUP BY item_id)
 SELECT item_id, contents, records FROM c JOIN (SELECT item_id, count(*) AS records FROM f1 GROUP BY item_id) USING (item_id)""",
    "dedupe_versions": f"WITH {_KEPT} SELECT item_id, seq, price, stock, title FROM kept",
    "dedupe_consecutive": f"""WITH {_RECORDS}, c AS (SELECT *, lag(({_CONTENT})) OVER (PARTITION BY item_id ORDER BY fetched_at, seq) AS p FROM f1)
 SELECT item_id, seq FROM c WHERE p IS NULL OR p <> ({_CONTENT})""",
    "dedupe_within": f"""WITH RECURSIVE {_RECORDS}, n AS (SELECT item_id, seq, epoch_us(fetched_at) AS t, dense_rank() OVER (ORDER BY {_CONTENT}) AS content,
  row_number() OVER (PARTITION BY {_CONTENT} ORDER BY fetched_at, seq) AS n FROM f1),
 fold AS (SELECT content, n, item_id, seq, t AS stored, true AS keep FROM n WHERE n = 1
  UNION ALL SELECT b.content, b.n, b.item_id, b.seq, CASE WHEN b.t - a.stored < 15552000000000 THEN a.stored ELSE b.t END, b.t - a.stored >= 15552000000000
  FROM fold a JOIN n b ON a.content = b.content AND b.n = a.n + 1)
 SELECT item_id, seq FROM fold WHERE keep""",
    "dedupe_incremental": f"WITH {_KEPT} SELECT item_id, seq FROM kept WHERE fetched_at >= TIMESTAMP '2000-01-01'",
    "latest_snapshot": f"""WITH {_KEPT} SELECT item_id, seq, price, stock, listing_status, title FROM
 (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fetched_at DESC, seq DESC) AS k FROM kept) WHERE k = 1""",
    "asof_previous": f"""WITH {_KEPT}, probes AS (SELECT l_partkey AS item_id, l_orderkey AS probe_order, CAST(l_linenumber AS BIGINT) AS probe_line,
  l_shipdate + (l_linenumber - 4) * INTERVAL 1 DAY AS before FROM lineitem),
 newest AS (SELECT item_id, fetched_at, max(seq) AS seq, arg_max(price, seq) AS price FROM kept GROUP BY item_id, fetched_at)
 SELECT p.item_id, probe_order, probe_line, k.seq AS prev_seq, k.price AS prev_price
 FROM probes p ASOF LEFT JOIN newest k ON p.item_id = k.item_id AND p.before > k.fetched_at""",
    "history_topn": f"""WITH {_KEPT}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fetched_at DESC, seq DESC) AS k FROM kept)
 SELECT item_id, seq, price, k AS nth FROM r WHERE k <= 5""",
    "recent_events": f"""WITH {_EVENTS} SELECT item_id, seq, check_no, field, severity FROM chg
 ORDER BY fetched_at DESC, seq DESC, item_id DESC, check_no DESC LIMIT 100""",
    "retained": f"WITH {_KEPT} SELECT item_id, seq FROM kept WHERE fetched_at >= TIMESTAMP '2001-11-04' - INTERVAL 180 DAY",
    "expired_counts": f"""WITH {_EVENTS} SELECT 'snapshots' AS kind, count(*) AS expired FROM kept WHERE fetched_at < TIMESTAMP '2001-11-04' - INTERVAL 180 DAY
 UNION ALL SELECT 'events', count(*) FROM chg WHERE fetched_at < TIMESTAMP '2001-11-04' - INTERVAL 180 DAY""",
    "normalize_items": f"""WITH {_RECORDS} SELECT CAST(item_id AS VARCHAR) AS item_id, source_id, seq, title, {_PRICE_TEXT} AS price,
 CASE WHEN seq % 5 = 0 THEN {_PRICE_TEXT} ELSE original_price END AS original_price, stock,
 CASE WHEN seq % 17 = 0 THEN 'unknown' ELSE listing_status END AS listing_status, main_image, promotion, review_count, rating, 'b,a' AS skus FROM f1""",
    "unwrap_envelope": f"""WITH {_PAYLOADS} SELECT item_id, seq, CASE seq % 5 WHEN 0 THEN '0' WHEN 1 THEN '200' WHEN 2 THEN '27' WHEN 3 THEN '1' ELSE '0' END AS code,
 seq % 5 IN (0, 1, 4) AS ok, CASE seq % 5 WHEN 2 THEN '{{"code":27,"msg":"x"}}' WHEN 4 THEN '{{"code":"0"}}' ELSE payload END AS content FROM payloads""",
    "sources_loaded": f"WITH src AS ({_SOURCES}) SELECT source_id, compliance, daily_quota, burst FROM src WHERE enabled",
    "compliance_rejects": f"""WITH src AS ({_SOURCES}) SELECT source_id, CASE WHEN compliance = '' THEN 'no compliance declared' ELSE 'compliance not in the allowed list' END AS reason
 FROM src WHERE enabled AND compliance NOT IN ({_in(V.COMPLIANCE)})""",
    "compliant_records": f"""WITH {_RECORDS}, src AS ({_SOURCES}) SELECT item_id, seq, source_id FROM f1
 WHERE source_id NOT IN (SELECT source_id FROM src WHERE enabled AND compliance NOT IN ({_in(V.COMPLIANCE)}))""",
    "resolve_source": f"""WITH src AS ({_SOURCES}), targets AS ({_TARGETS}),
 one AS (SELECT min_by(source_id, ord) FILTER (WHERE compliance = 'synthetic') AS sample, min_by(source_id, ord) FILTER (WHERE compliance <> 'synthetic') AS chosen FROM src WHERE enabled)
 SELECT CASE WHEN item_id % 10 = 0 THEN concat('SAMPLE-', item_id) ELSE CAST(item_id AS VARCHAR) END AS item_id, role,
 CASE WHEN item_id % 10 = 0 OR chosen IS NULL THEN sample ELSE chosen END AS source_id FROM targets, one""",
    "ttl_clamp": f"WITH src AS ({_SOURCES}) SELECT source_id, dedupe_ttl_seconds, least(dedupe_ttl_seconds, 1800) AS ttl_seconds FROM src",
    "to_snapshot": f"""WITH {_RECORDS} SELECT item_id, source_id, seq, title, price, stock, rating, CAST(64 AS INTEGER) AS fp_chars, min(seq) OVER (PARTITION BY {_CONTENT}) AS first_seq, original_price AS payload_original_price,
 concat('sku-', item_id, '-b,sku-', item_id, '-a') AS payload_skus FROM f1""",
    "events_with_role": f"WITH {_ROLED} SELECT item_id, seq, field, role, priority FROM roled",
    "event_category": f"WITH {_ROLED} SELECT item_id, seq, field, role, {_category('role', 'field', 'new_value', 'old_num', 'new_num')} AS category FROM roled",
    "event_actions": f"""WITH {_CLASSED}, {_ACTIONS} SELECT item_id, seq, field, category, coalesce(action, '{V.CATEGORY_FOR_REVIEW}') AS action
 FROM classed LEFT JOIN acts USING (category)""",
    "parse_events_json": f"""WITH {_RECORDS}, e AS (SELECT seq, item_id AS asked, CAST(0 AS INTEGER) AS pos, CAST(item_id AS VARCHAR) AS item_id,
   CASE item_id % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'competitor' ELSE 'unknown' END AS role, 'price' AS field, original_price AS old_num, price AS new_num, '' AS new_value FROM f1 WHERE seq % 9 > 2
  UNION ALL SELECT seq, item_id, 2, CAST(item_id AS VARCHAR), 'self', 'stock', CAST(10 AS DOUBLE), CASE WHEN seq % 4 <> 0 THEN CAST(stock AS DOUBLE) END, '' FROM f1 WHERE seq % 9 > 2)
 SELECT seq, asked, pos, item_id, role, field, old_num, new_num, {_category('role', 'field', 'new_value', 'old_num', 'new_num')} AS category FROM e""",
    "events_bundle": f"""WITH {_CLASSED}, n AS (SELECT *, (row_number() OVER (PARTITION BY cycle_id ORDER BY item_id, seq, check_no) - 1) // 50 AS part_no FROM classed)
 SELECT cycle_id, part_no, count(*) OVER w AS event_count, CAST(row_number() OVER (PARTITION BY cycle_id, part_no ORDER BY item_id, seq, check_no) - 1 AS INTEGER) AS pos,
  CAST(item_id AS VARCHAR) AS item_id, role, severity, field, old_value, new_value, event, category FROM n WINDOW w AS (PARTITION BY cycle_id, part_no)""",
    "prompt_rows": f"""WITH {_CLASSED}, n AS (SELECT cycle_id, (row_number() OVER (PARTITION BY cycle_id ORDER BY item_id, seq, check_no) - 1) // 50 AS part_no FROM classed)
 SELECT cycle_id, part_no, md5(concat('Events of this cycle:', chr(10), '<events>', chr(10), 'Answer in JSON.')) AS frame, count(*) AS in_json FROM n GROUP BY cycle_id, part_no""",
    "parse_response": f"WITH {_ANSWERS} SELECT seq, summary, item_id, severity, priority_keep, need_push, attribution, action, priority_reason FROM evs",
    "need_push": f"WITH {_ANSWERS} SELECT seq, CAST(pos AS INTEGER) AS pos, need_push FROM evs",
    "push_rollup": f"WITH {_ANSWERS} SELECT seq, summary, event_count, need_push, pushed_items FROM roll",
    "alerts": f"WITH {_ANSWERS} SELECT seq, summary, pushed_items FROM roll WHERE need_push",
    "digest": f"WITH {_ANSWERS} SELECT seq, summary, event_count FROM roll WHERE NOT need_push",
    "rule_alerts": f"WITH {_CLASSED} SELECT item_id, seq, field, category FROM classed WHERE severity = 'P0'",
    "canonical_url": f"""WITH a AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
 b AS (SELECT page_id, regexp_extract(u, '^([A-Za-z]+://[^/?]*)', 1) AS host, regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS path, regexp_extract(u, '\\?(.*)$', 1) AS query FROM a),
 c AS (SELECT *, array_to_string(list_sort([x FOR x IN string_split(query, '&') IF x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_in(V.TRACKING_PARAMS)})]), '&') AS kept FROM b)
 SELECT page_id, concat(lower(host), CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN kept = '' THEN '' ELSE concat('?', kept) END) AS canonical FROM c""",
    "request_fp": f"""WITH log AS ({_LOG}), f AS (SELECT seq, sha256(concat('GET|https://api.example.com/item?id=', item_id)) AS fp FROM log)
 SELECT seq, fp, substr(fp, 1, 12) AS short FROM f""",
    "request_dedupe": f"{_HITS} SELECT source_id, seq, hit FROM fold WHERE n > 0",
    "cached_requests": f"""{_HITS}{_ALIVE} SELECT * FROM alive""",
    "classify_response": f"{_HTTP} SELECT seq, {_anomaly('false')} AS anomaly FROM c",
    "classify_response_mended": f"{_HTTP} SELECT seq, " + _anomaly(" OR ".join(f"contains(codes, '{c.upper()}')" for c in V.RATE_CODES)) + " AS anomaly FROM c",
    "context_mismatch": f"WITH log AS ({_LOG}) SELECT seq, item_id, returned_item_id FROM log WHERE returned_item_id <> '' AND returned_item_id <> CAST(item_id AS VARCHAR)",
    "attempt_outcome": f"WITH {_OUTCOME} SELECT source_id, seq, outcome FROM attempts",
    "audit_rows": f"WITH {_OUTCOME} SELECT source_id, seq, concat('fail:', outcome) AS outcome, concat(outcome, ':', substr(body, 1, 160)) AS detail, true AS counted FROM attempts WHERE outcome <> 'ok'",
    "quota_ledger": f"""WITH log AS ({_LOG}), src AS (SELECT * FROM ({_SOURCES}) WHERE source_id <> 'src7'), r AS (SELECT source_id, seq, row_number() OVER (PARTITION BY source_id, CAST(ts AS DATE) ORDER BY ts, seq) AS used FROM log)
 SELECT source_id, seq, used, used > coalesce(daily_quota, {V.DEFAULT_DAILY_QUOTA}) AS over FROM r LEFT JOIN src USING (source_id)""",
    "quota_days": f"""WITH log AS ({_LOG}), src AS (SELECT * FROM ({_SOURCES}) WHERE source_id <> 'src7'), r AS (SELECT source_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM log GROUP BY ALL)
 SELECT source_id, day, used, greatest(0, coalesce(daily_quota, {V.DEFAULT_DAILY_QUOTA}) - used) AS remaining,
 greatest(0, used - coalesce(daily_quota, {V.DEFAULT_DAILY_QUOTA})) AS overrun FROM r LEFT JOIN src USING (source_id)""",
    "rate_audit": f"""WITH log AS ({_LOG}), a AS (SELECT source_id, seq, ts, row_number() OVER (PARTITION BY source_id ORDER BY ts, seq) AS n, CAST(0.002 AS DOUBLE) * (epoch_us(ts) / CAST(1000000 AS DOUBLE)) AS rt FROM log),
 b AS (SELECT *, min((n - 1) - rt) OVER (PARTITION BY source_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS low FROM a)
 SELECT source_id, seq FROM b WHERE (n - rt) - low > 3""",
    "failure_streaks": f"""WITH {_OUTCOME}, a AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER w AS island FROM attempts WINDOW w AS (PARTITION BY source_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
 SELECT source_id, seq, CAST(sum(CASE WHEN outcome = 'ok' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, island ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak,
 CAST(sum(CASE WHEN outcome = 'ok' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_failures FROM a""",
    "breaker_episodes": f"""{_FOLD} SELECT source_id, seq, outcome AS reason, run_failures, opens, cooldown AS cooldown_s,
 epoch_us(ts) + CAST(cooldown * 1000000 AS BIGINT) AS open_until_us FROM fold WHERE opened""",
    "pause_events": f"{_FOLD} SELECT source_id, seq, cause, opens, streak, total AS total_failures, why AS pause_reason FROM fold WHERE newly",
    "health_report": f"""{_FOLD}, req AS{_ALIVE_IN_HEALTH}, src AS ({_SOURCES}), e AS (SELECT source_id, max(n) AS n, count(*) FILTER (WHERE outcome = 'ok') AS success, count(*) FILTER (WHERE outcome <> 'ok') AS failure,
  CAST(0 AS BIGINT) AS today FROM fold WHERE n > 0 GROUP BY source_id),
 o AS (SELECT source_id, max(epoch_us(ts) + CAST(cooldown * 1000000 AS BIGINT)) FILTER (WHERE opened) AS until FROM fold GROUP BY source_id),
 s AS (SELECT f.*, e.success, e.failure, e.today, CASE WHEN f.run_failures >= 5 THEN 'open' ELSE 'closed' END AS breaker,
  CASE WHEN f.run_failures >= 5 THEN greatest(0.0, round((until - epoch_us(TIMESTAMP '2024-01-31')) / 1000000.0, 1)) ELSE 0.0 END AS left_s
  FROM e JOIN fold f ON f.source_id = e.source_id AND f.n = e.n JOIN o ON o.source_id = e.source_id)
 SELECT source_id, CASE WHEN paused THEN 'paused' WHEN breaker = 'open' AND left_s > 0 THEN 'open' WHEN breaker = 'open' THEN 'degraded' ELSE 'healthy' END AS state,
 coalesce(breaker, 'closed') AS breaker, coalesce(opens, 0) AS opens, coalesce(streak, 0) AS consecutive_failures, coalesce(total, 0) AS total_failures,
 CAST(coalesce(left_s, 0) AS DOUBLE) AS open_remaining_s, least(coalesce(today, 0), coalesce(daily_quota, {V.DEFAULT_DAILY_QUOTA})) AS quota_used,
 coalesce(daily_quota, {V.DEFAULT_DAILY_QUOTA}) AS quota_limit, coalesce(cached_requests, 0) AS cached_requests, coalesce(paused, false) AS paused,
 coalesce(why, '') AS paused_reason, coalesce(success, 0) AS success, coalesce(failure, 0) AS failure, CAST(0 AS BIGINT) AS dedup_hits
 FROM s FULL JOIN (SELECT * FROM src WHERE enabled) USING (source_id) LEFT JOIN alive USING (source_id)""",
    "cycle_stats": f"""WITH RECURSIVE {_CYCLES} SELECT *, """ + ", ".join(
        f"CAST(sum({c}) OVER (ORDER BY cycle_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {c}_total" for c in ("fetched", "cached", "skipped", "saved", "events")) + " FROM stats",
    "cycle_report": f"""WITH RECURSIVE {_CYCLES}, targets AS ({_TARGETS}), worst AS (SELECT strftime(fetched_at, '%Y-%m-%d') AS cycle_id, min(severity) AS worst
  FROM chg LEFT JOIN targets USING (item_id) WHERE coalesce(role, 'unknown') = 'competitor' OR severity IN ('P0', 'P1') GROUP BY 1),
 span AS (SELECT cycle_id, CAST(floor((max(t) - min(t)) / 1000) AS BIGINT) AS elapsed_ms, count(*) AS results FROM att GROUP BY cycle_id)
 SELECT cycle_id, fetched, saved, events, coalesce(worst, 'P3') AS top_severity, elapsed_ms, results FROM stats LEFT JOIN worst USING (cycle_id) LEFT JOIN span USING (cycle_id)""",
}

ORACLES["normalize_stored_items"] = ORACLES["normalize_routed"] = ORACLES["normalize_items"]
_SRC_KIND = "s_suppkey % 11"
ORACLES["checked_declarations"] = f"""SELECT s_suppkey AS ord, CASE WHEN {_SRC_KIND} NOT IN (1, 2, 3) THEN concat('src', s_suppkey) END AS source_id,
 {_SRC_KIND} IN (0, 3, 6, 7, 8, 9, 10) AS enabled, CASE {_SRC_KIND} WHEN 1 THEN '' WHEN 2 THEN '' WHEN 5 THEN '' WHEN 6 THEN '' WHEN 7 THEN 'scraped' ELSE 'vendor' END AS compliance,
 CAST(CASE {_SRC_KIND} WHEN 9 THEN 2 WHEN 10 THEN 0.25 ELSE {V.DEFAULT_QPS} END AS DOUBLE) AS qps,
 CAST(CASE {_SRC_KIND} WHEN 9 THEN 1 WHEN 10 THEN 77 ELSE {V.DEFAULT_DAILY_QUOTA} END AS BIGINT) AS daily_quota,
 CASE {_SRC_KIND} WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not an object' WHEN 3 THEN 'no id' WHEN 4 THEN 'enabled is not a boolean' WHEN 6 THEN 'no compliance declared'
  WHEN 7 THEN 'compliance not in the allowed list' WHEN 8 THEN 'qps is not a number' WHEN 9 THEN 'daily_quota is not a whole number' END AS reason FROM supplier"""
for _name in ("breaker_episodes", "pause_events", "request_dedupe", "rate_audit"):
    ORACLES[f"{_name}_sliced"] = ORACLES[_name]
ORACLES["stream_version_diff"] = ORACLES["diff_events"]
ORACLES["stream_request_dedupe"] = ORACLES["request_dedupe"]
ORACLES["stream_source_health"] = f"""{_FOLD} SELECT source_id, seq, opened, run_failures, opens, streak, total AS total_failures,
 CASE WHEN run_failures >= 5 THEN 'open' ELSE 'closed' END AS breaker, paused FROM fold WHERE n > 0"""
ORACLES["changes_per_day"] = f"""WITH {_EVENTS} SELECT strftime(fetched_at, '%Y-%m-%d') AS day, severity, count(*) AS changes FROM chg GROUP BY ALL"""
ORACLES["top_severity_overall"] = f"WITH {_EVENTS} SELECT coalesce(min(severity), 'P3') AS top_severity FROM chg"
ORACLES["diff_incremental"] = f"WITH {_EVENTS} SELECT {_EVENT} FROM chg WHERE fetched_at >= TIMESTAMP '2000-01-01'"
ORACLES["appended_tables"] = f"""WITH {_EVENTS}, {_OUTCOME}
 SELECT 'snapshot' AS kind, CAST(item_id AS VARCHAR) AS key, seq, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS at, listing_status AS what FROM kept
 UNION ALL SELECT 'event', CAST(item_id AS VARCHAR), seq, strftime(fetched_at, '%Y-%m-%d %H:%M:%S'), concat(field, ':', severity) FROM chg
 UNION ALL SELECT 'audit', source_id, seq, strftime(ts, '%Y-%m-%d %H:%M:%S'), concat('fail:', outcome) FROM attempts WHERE outcome <> 'ok'"""
ORACLES["cycle_results"] = f"""WITH {_OUTCOME}, targets AS ({_TARGETS})
 SELECT strftime(ts, '%Y-%m-%d') AS cycle_id, a.item_id, coalesce(nullif(t.role, ''), 'unknown') AS role, source_id, seq, outcome = 'ok' AS ok,
 CASE WHEN outcome = 'ok' THEN '' ELSE concat(outcome, ':', substr(coalesce(body, ''), 1, 160)) END AS msg FROM attempts a LEFT JOIN targets t ON a.item_id = t.item_id"""
_LEFT = "count(*) FILTER (WHERE old) AS deleted, count(*) FILTER (WHERE NOT old) AS left_rows, CAST(sum(seq) FILTER (WHERE NOT old) AS BIGINT) AS left_seq"
_OLD = "seq, fetched_at < TIMESTAMP '2001-11-04' - INTERVAL 180 DAY AS old"
ORACLES["retention_at_rest"] = f"""WITH {_EVENTS} SELECT 'snapshots' AS kind, {_LEFT} FROM (SELECT {_OLD} FROM kept)
 UNION ALL SELECT 'events', {_LEFT} FROM (SELECT {_OLD} FROM chg)"""
ORACLES["stream_tables"] = f"""WITH {_EVENTS}, n AS (SELECT (SELECT count(*) FROM f1) AS fetched, (SELECT count(*) FROM kept) AS saved,
  (SELECT count(*) FROM chg) AS events, (SELECT count(*) FROM chg WHERE severity = 'P0') AS alerts)
 SELECT unnest(['counter_fetched', 'counter_saved', 'counter_late', 'counter_events', 'digest', 'snapshots', 'events', 'alerts', 'late_records']) AS name,
  unnest([fetched, saved, 0, events, events - alerts, saved, events, alerts, 0]) AS n FROM n"""
# two portions: what came before the cut, and the rest; a content counts from where it came first
ORACLES["stream_late_records"] = f"""WITH {_RECORDS}, arrived AS (SELECT *, CASE WHEN seq % 5 = 0 THEN fetched_at + INTERVAL 3 MONTH ELSE fetched_at END >= TIMESTAMP '1998-01-01' AS second FROM f1),
 firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_CONTENT} ORDER BY second, fetched_at, seq) AS nth FROM arrived) WHERE nth = 1),
 latest AS (SELECT item_id, max((fetched_at, seq)) AS mark FROM firsts WHERE NOT second GROUP BY item_id)
 SELECT item_id, seq FROM firsts JOIN latest USING (item_id) WHERE second AND (fetched_at, seq) <= mark"""
_LOG_PART = " + ".join(f"CAST({{t}} >= TIMESTAMP '2024-01-{d}' AS INTEGER)" for d in ("07", "13", "19", "25"))
ORACLES["stream_request_state"] = _HITS + f""", came AS (SELECT r.source_id, r.item_id, r.t, f.ok AND NOT f.hit AS anchor, {_LOG_PART.format(t="make_timestamp(r.t)")} AS part
  FROM fold f JOIN req r ON f.source_id = r.source_id AND f.item_id = r.item_id AND f.n = r.n),
 marks AS (SELECT g.b, coalesce(max(came.t) // 1000, 0) AS clock FROM range(0, 6) AS g(b) LEFT JOIN came ON came.part < g.b GROUP BY g.b),
 held AS (SELECT marks.b, clock, source_id, item_id, max(t) AS newest FROM marks JOIN came ON part <= marks.b AND anchor GROUP BY ALL)
 SELECT b AS batch, count(*) AS remembered FROM held WHERE (newest + 21600000000 + 999) // 1000 > clock GROUP BY b"""
ORACLES["stream_breaker_timers"] = f"""{_FOLD}, moves AS (SELECT source_id, opened, epoch_us(ts) + CAST(cooldown * 1000000 AS BIGINT) AS until,
  lead(epoch_us(ts)) OVER (PARTITION BY source_id ORDER BY n) AS next_us FROM fold WHERE n > 0)
 SELECT source_id, until AS at_us, 'open' AS from_state, 'degraded' AS to_state FROM moves
 WHERE opened AND until <= coalesce(next_us, (SELECT max(epoch_us(ts)) + 1 FROM attempts))"""
ORACLES["stream_late_attempts"] = f"""WITH log AS ({_LOG}), came AS (SELECT source_id, seq, ts,
  ts + CASE WHEN seq % 97 = 0 THEN INTERVAL 2 DAY ELSE (seq * 7919 % 3600) * INTERVAL 1 SECOND END AS arrives FROM log),
 parted AS (SELECT *, {_LOG_PART.format(t="arrives")} AS part FROM came),
 marks AS (SELECT g.p, max(ts) - INTERVAL 1 HOUR AS clock FROM range(1, 5) AS g(p) JOIN parted ON part < g.p GROUP BY g.p)
 SELECT source_id, seq FROM parted JOIN marks ON part = p WHERE ts < clock"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
