"""Values that results depend on, kept in one place and in natural order.

Nothing here is computed; change a value only if the business rule changes.
"""

# --- fixed values: severities and enumerations --------------------------------
SEVERITIES = ("P0", "P1", "P2", "P3")
LOWEST_SEVERITY = "P3"
COMPLIANCE = ("official_api", "own_data", "vendor", "synthetic")
ANOMALIES = (
    "rate_limited", "auth_expired", "verify_required", "empty_data",
    "malformed", "transport_error", "context_mismatch",
)

# --- fixed values: change thresholds ------------------------------------------
PRICE_P0_RATIO = 0.10
PRICE_P1_RATIO = 0.03
STOCK_CRASH_RATIO = 0.50
RATING_DROP = 0.20
TITLE_SHOWN_CHARS = 60
TITLE_SELL_WORDS = ("包邮", "正品", "旗舰", "直播", "爆款", "新款", "直播同款", "限时")

# --- fixed values: event texts ------------------------------------------------
TEXT_ON_SALE = "商品上架"
TEXT_OFF_SALE = "商品下架"
TEXT_PRICE = "价格变动 "
TEXT_STOCK = "库存变动"
TEXT_IMAGE = "主图换版（需评估美工素材差距）"
TEXT_OLD_IMAGE = "旧主图"
TEXT_NEW_IMAGE = "新主图"
TEXT_TITLE_GAINED = "标题调整；新增卖点词 "
TEXT_TITLE_LOST = "，丢失 "
TEXT_NO_WORDS = "无"
TEXT_PROMOTION = "促销机制变化"
TEXT_REVIEWS = "累计评价增长"
TEXT_RATING = "评分下滑"
TEXT_BASELINE = "首次采集，建立基线"

# --- fixed values: event categories and their standard actions ----------------
CATEGORY_SELF_PRICE_ALARM = "自有降价异常"
CATEGORY_SELF_PRICE = "自有普通调价"
CATEGORY_SELF_OFF = "自有下架"
CATEGORY_SELF_NO_STOCK = "自有断货"
CATEGORY_RIVAL_PRICE = "竞品降价"
CATEGORY_RIVAL_OFF = "竞品下架"
CATEGORY_RIVAL_NO_STOCK = "竞品断货"
CATEGORY_IMAGE = "主图换版"
CATEGORY_TITLE = "标题改卖点词"
CATEGORY_PROMOTION = "促销机制变化"
CATEGORY_RATING = "评分下滑"
CATEGORY_UNKNOWN_ROLE = "归属未知"
CATEGORY_FOR_REVIEW = "待人工判定"

ACTION_TEMPLATES = (
    (CATEGORY_SELF_PRICE_ALARM, "查商家后台改价记录；误操作 → 立刻改回 old_value；主动促销 → 核对活动配置与券叠加"),
    (CATEGORY_SELF_PRICE, "确认与活动节奏一致即可"),
    (CATEGORY_SELF_OFF, "查是平台违规下架还是缺货，恢复上架或补库存"),
    (CATEGORY_SELF_NO_STOCK, "立即补货，或把该 SKU 设为缺货预售"),
    (CATEGORY_RIVAL_PRICE, "对照跟价阈值：跟 → 写出新价并做利润校验；不跟 → 记录价差"),
    (CATEGORY_RIVAL_OFF, "接手流量：抢该商品核心关键词投放，检查自家承接页是否就绪"),
    (CATEGORY_RIVAL_NO_STOCK, "抢该词流量，确认自家该词库存接得住"),
    (CATEGORY_IMAGE, "评估与自家主图的视觉差距，向美工提素材需求"),
    (CATEGORY_TITLE, "核对新增核心词是否值得跟，必要时补同类卖点词"),
    (CATEGORY_PROMOTION, "核对活动配置，评估自己是否要出对应券"),
    (CATEGORY_RATING, "排查近 30 天差评来源"),
    (CATEGORY_UNKNOWN_ROLE, "人工确认归属后再定（**不要猜方向**）"),
)

# --- fixed values: request fingerprints ---------------------------------------
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "spm", "spc", "tb_token", "timestamp", "t", "callback", "_", "r",
    "app_key", "sign", "session",
)
SHORT_FP_CHARS = 12

# --- fixed values: response classification ------------------------------------
BODY_CHARS_READ = 4000
RATE_STATUSES = (429, 503)
AUTH_STATUSES = (401, 403)
CONTEXT_CODES = ("CONTEXT_MISMATCH", "ITEM_NOT_MATCH", "RESOURCE_MISMATCH", "DATA_MISMATCH")
RATE_CODES = (
    "isv.limit", "isv.limit.rate", "fail_sys_traffic_limit", "fail_sys_traffic_limit_control",
    "isp.traffic_limit", "isp.cpu_limit", "isp.server_error",
    "isv.sub_account_error", "api.service.trade.repeat",
)
RATE_PATTERN = r"ISV_LIMIT|TRAFFIC_LIMIT|RESOURCE_EXCEED|API\s*调用频繁|访问过于频繁|too\s+many\s+requests"
AUTH_PATTERN = r"invalid\s+session|未授权|登录失效|请重新登录|签名错误|appkey\s+不在白名单|missing\s+appkey"
VERIFY_PATTERN = r"验证码|captcha|滑块|punish|风控校验|人机验证"
AUDIT_BODY_CHARS = 160
AUDIT_DETAIL_CHARS = 500

# --- fixed values: default policy ---------------------------------------------
DEDUPE_TTL_SECONDS = 600
CYCLE_SECONDS = 3600
RETENTION_DAYS = 180
BREAKER_FAILURES = 5
BREAKER_OPEN_SECONDS = 60.0
BREAKER_MAX_OPEN_SECONDS = 3600.0
BREAKER_BACKOFF = 2.0
PAUSE_AFTER_OPENS = 3
PAUSE_AFTER_FAILURES = 5
INSTANT_OPEN_ANOMALIES = ("context_mismatch", "verify_required", "auth_expired")
SYNTHETIC_ID_PREFIX = "SAMPLE"

# fixed values: why a source is paused; {limit} is its daily quota
PAUSED_BY_QUOTA = "日配额 {limit} 已用尽"
PAUSED_BY_OPENS = "连续熔断 %d 次，人工确认后恢复"
PAUSED_BY_FAILURES = "连续 %d 次失败未恢复（累计 %d 次），人工确认后恢复"

# fixed values: the policy of a source that nobody declared
DEFAULT_QPS = 0.5
DEFAULT_BURST = 3
DEFAULT_DAILY_QUOTA = 1000
