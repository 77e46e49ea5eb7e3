"""Column expressions built only from Spark's own functions (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i)nan|inf|infinity)$"


def lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where ``text`` holds at least one of ``words`` as a substring."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def lenient_double(text: Column) -> Column:
    """Text to a number with two decimals; a currency sign and blanks are dropped, junk gives null."""
    bare = F.trim(F.replace(text.cast("string"), F.lit("元"), F.lit("")))
    return F.round(F.when(bare.rlike(_NUMBER), bare.try_cast("double")), 2)


def lenient_long(text: Column) -> Column:
    """Text to a whole number, cut towards zero; junk gives null."""
    bare = F.trim(text.cast("string"))
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double")).try_cast("bigint")


def relative_change(old: Column, new: Column) -> Column:
    """(new - old) / |old|, and 0.0 when that is undefined."""
    return F.coalesce(F.try_divide(new - old, F.abs(old)), F.lit(0.0))


def signed_percent(ratio: Column) -> Column:
    """Percent with one decimal and a sign, rounded as the double's exact value says, ties to even.

    With a = |percent|, 20 a is an odd number only next to a midpoint; which side a is on shows in
    16 a and 4 a, both exact, as does their distance to that number.
    """
    v = ratio * 100
    a = F.abs(v)
    twentieths = F.rint(a * 20)
    lower = F.floor(twentieths / 2)
    rest = twentieths - a * 16
    up = F.when(a * 4 > rest, 1).when(a * 4 == rest, lower % 2).otherwise(0)
    tenths = (lower + F.when(twentieths % 2 == 1, up).otherwise(0)).cast("bigint")
    text = F.concat(F.when(v < 0, "-").otherwise("+"), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    return F.when(a < 1e12, text).otherwise(F.format_string("%+.1f%%", v))


def word_changes(old: Column, new: Column, words: Sequence[str] = V.TITLE_SELL_WORDS) -> tuple[Column, Column]:
    """(gained, lost) arrays in dictionary order; a word counts when it is a substring."""
    table = lit_array(words)
    gained = F.filter(table, lambda w: F.contains(new, w) & ~F.contains(old, w))
    lost = F.filter(table, lambda w: F.contains(old, w) & ~F.contains(new, w))
    return gained, lost


def word_list_text(words: Column) -> Column:
    quoted = F.concat(F.lit("['"), F.array_join(words, "', '"), F.lit("']"))
    return F.when(F.size(words) > 0, quoted).otherwise(V.TEXT_NO_WORDS)


def role_or_unknown(role: Column) -> Column:
    return F.coalesce(F.nullif(role, F.lit("")), F.lit("unknown"))


def clamped_ttl(ttl: Column, interval: Column, override: Column | None = None) -> Column:
    """Request-dedupe TTL: never longer than half a cycle (floor 60 s); an override wins."""
    half = F.greatest(F.lit(60), F.floor(interval / 2))
    clamped = F.greatest(F.lit(0), F.least(ttl, half))
    if override is not None:
        clamped = F.when(override.isNotNull(), F.greatest(F.lit(0), override)).otherwise(clamped)
    return clamped.cast("bigint")


def _query_decode(piece: Column) -> Column:
    # a percent sign that starts no escape stands for itself
    return F.url_decode(F.regexp_replace(piece, "%(?![0-9A-Fa-f]{2})", "%25"))


def _query_encode(piece: Column) -> Column:
    # Java's form encoding keeps '*' and escapes '~'; RFC 3986 does the reverse
    return F.replace(F.replace(F.url_encode(piece), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, dropped: Sequence[str] = V.TRACKING_PARAMS) -> Column:
    """One spelling per resource: lower host, no fragment, no tracking parameters, sorted query."""
    shape = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    bare = F.trim(url)
    scheme, host, path, query = (F.regexp_extract(bare, shape, i) for i in (1, 2, 3, 4))
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _query_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
            _query_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda kv: ~F.lower(kv["k"]).isin(*dropped)))
    encoded = F.array_join(
        F.transform(kept, lambda kv: F.concat(_query_encode(kv["k"]), F.lit("="), _query_encode(kv["v"]))), "&"
    )
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), F.lower(host))).otherwise(""),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(encoded != "", F.concat(F.lit("?"), encoded)).otherwise(""),
    )


def request_fp(canonical: Column, method: Column | str = "GET") -> Column:
    verb = F.upper(F.lit(method) if isinstance(method, str) else method)
    return F.sha2(F.concat(verb, F.lit("|"), canonical), 256)


def short_fp(fp: Column) -> Column:
    return F.substring(fp, 1, V.SHORT_FP_CHARS)


CONTENT_COLUMNS = (
    "listing_status", "price", "original_price", "stock", "title",
    "main_image", "promotion", "review_count", "rating",
)


def content_fp(skus: str | None = "sku_list", columns: Sequence[str] = CONTENT_COLUMNS) -> Column:
    """Fingerprint of what a shopper sees; null and '' differ, the sku order does not matter."""
    parts = [F.col(c) for c in columns]
    if skus is not None:
        parts.append(F.array_sort(F.col(skus)).alias("skus"))
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
