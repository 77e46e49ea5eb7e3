"""Raw item payloads to typed records, and the response envelopes they arrive in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lenient_double, lenient_long

_ITEM = (
    "struct<item_id string, title string, price string, original_price string, stock string, status string, "
    "main_image string, promotion string, review_count string, rating string, skus array<struct<sku_id string>>>"
)
ITEM_SCHEMA = f"item {_ITEM}"
RECORD = (
    "item_id", "title", "price", "original_price", "stock", "listing_status", "main_image", "promotion",
    "review_count", "rating", "sku_list", "raw",
)


def item_record(payload: Column, asked: Column) -> Column:
    """One item payload (JSON text) as a record struct; ``asked`` fills in a missing item id.

    The item is bound to a lambda: the text is parsed once, also in the branches of ``Normalisers.apply``, where
    Spark shares no subexpressions, and the generated code stays small enough to be compiled.
    """
    return _bound(F.from_json(payload, ITEM_SCHEMA)["item"], lambda item: _record(item, payload, asked))


def stored_item_record(document: Column, asked: Column, raw: Column | None = None) -> Column:
    """The same from a payload that was parsed when it was stored (VARIANT)."""
    text = F.to_json(document) if raw is None else raw
    return _bound(F.try_variant_get(document, "$.item", _ITEM), lambda item: _record(item, text, asked))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _record(item: Column, raw: Column, asked: Column) -> Column:
    blank_to_null = lambda c: F.nullif(c, F.lit(""))
    list_price = F.when(~blank_to_null(item["original_price"]).try_cast("double").eqNullSafe(F.lit(0.0)), blank_to_null(item["original_price"]))
    skus = F.coalesce(F.transform(item["skus"], lambda s: F.coalesce(s["sku_id"], F.lit(""))), F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(blank_to_null(item["item_id"]), asked.cast("string")).alias("item_id"),
        F.coalesce(item["title"], F.lit("")).alias("title"),
        lenient_double(item["price"]).alias("price"),
        lenient_double(F.coalesce(list_price, item["price"])).alias("original_price"),
        lenient_long(item["stock"]).alias("stock"),
        F.coalesce(item["status"], F.lit("unknown")).alias("listing_status"),
        F.coalesce(item["main_image"], F.lit("")).alias("main_image"),
        F.coalesce(item["promotion"], F.lit("")).alias("promotion"),
        lenient_long(item["review_count"]).alias("review_count"),
        lenient_double(item["rating"]).alias("rating"),
        skus.alias("sku_list"),
        raw.alias("raw"),
    )


def _with_record(payloads: DataFrame, payload: str, record: Column, raw: Column | None = None) -> DataFrame:
    kept = [c for c in payloads.columns if c not in (payload, "item_id")]
    made = payloads.select(*kept, record.alias("_record"), *([] if raw is None else [raw.alias("_raw")]))
    text = F.col("_record.raw" if raw is None else "_raw").alias("raw")
    return made.select("_record.item_id", *kept, *[f"_record.{c}" for c in RECORD if c not in ("item_id", "raw")], text)


def normalize_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Typed records from JSON item payloads (text, or VARIANT as stored); the asked-for ``item_id`` fills in a missing one."""
    body, asked = F.col(payload), F.col("item_id")
    if dict(payloads.dtypes)[payload] != "variant":
        return _with_record(payloads, payload, item_record(body, asked))
    # the text is only made where it is selected
    return _with_record(payloads, payload, stored_item_record(body, asked, raw=F.lit(None)), raw=F.to_json(body))


def parsed(rows: DataFrame, text: str = "payload") -> DataFrame:
    """The rows with their JSON text parsed once, for good: a VARIANT column of the same name, null if it is broken."""
    return rows.withColumn(text, F.try_parse_json(text))


def unwrap_envelope(envelopes: DataFrame, body: str = "body") -> DataFrame:
    """``code``, ``ok`` and the inner ``content``: the result of a success, the error part of a failure."""
    text = F.col(body)
    rows = envelopes.withColumn("_e", F.from_json(body, "code string, result string, error_response string"))
    outer, failure = F.col("_e")["code"], F.col("_e")["error_response"]
    # the error part is small and looked into only where there is no code outside
    code = F.coalesce(outer, F.when(outer.isNull(), F.get_json_object(failure, "$.code")), F.lit("1"))
    ok = F.col("code").isin("0", "200")
    kept = [c for c in envelopes.columns if c != body]
    coded = rows.select(*kept, text.alias("_text"), code.alias("code"), F.col("_e")["result"].alias("_result"), failure.alias("_failure"))
    return coded.select(*kept, "code", ok.alias("ok"), F.coalesce(F.when(ok, F.col("_result")).otherwise(F.col("_failure")), F.col("_text")).alias("content"))


Normaliser = Callable[[Column, Column], Column]


class Normalisers:
    """Adapter name -> how it makes a record struct (see ``item_record``) of a payload and the asked-for item id.

    ``apply`` reads the payloads once, whatever the number of adapters: each row takes its adapter's branch.
    """

    def __init__(self) -> None:
        self._known: dict[str, Normaliser] = {"item_payload": item_record}

    def register(self, adapter: str, normaliser: Normaliser) -> None:
        self._known[adapter] = normaliser

    def get(self, adapter: str) -> Normaliser:
        if adapter not in self._known:
            raise KeyError(f"unknown adapter {adapter!r}, known: {sorted(self._known)}")
        return self._known[adapter]

    def apply(self, payloads: DataFrame, adapters: list[str], payload: str = "payload") -> DataFrame:
        """Records of the rows of these adapters (column ``adapter``)."""
        record = F.lit(None)
        for name in reversed(adapters):
            record = F.when(F.col("adapter") == name, self.get(name)(F.col(payload), F.col("item_id"))).otherwise(record)
        return _with_record(payloads.where(F.col("adapter").isin(adapters)), payload, record)
