"""Benchmark decontamination by winnowing: shared fingerprints first, then extension to whole windows.

A window is ``WINDOW`` = 10 consecutive item words. Both sides hash every k-gram (k = 5) and keep the
minimum hash of each run of 10 - k + 1 = 6 consecutive k-grams, that is of each window: a shared span
of 10 words or more therefore always has a common fingerprint. Items of fewer words are one window of
their own length; for each such length that occurs the same is done with k at most 5.

Fingerprints are joined with the distinct ones of the items, so a passage in very many items or
documents multiplies nothing. Where a document's fingerprint is found, the hit is extended: the
document's windows with that fingerprint are compared word by word with the items' windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import durable
from .text import LOWER, UPPER, free_name, grams, let, row_key, whole

WINDOW, GRAM = 10, 5
# a word is letters, digits and anything beyond ASCII; the breaks are listed for the translation
_BREAKS = "".join(chr(c) for c in [*range(0x01, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def plain_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    blank = F.translate(text, _BREAKS + UPPER, " " * len(_BREAKS) + LOWER)
    return F.array_remove(F.split(blank, "[ \\x00]"), "")


def window_minima(tokens: Column, window: int) -> Column:
    """The fingerprint of each window: the minimum of its k-gram hashes, by window start."""
    k = min(GRAM, window)
    each = window - k + 1
    if each == 1:
        return grams(tokens, k)
    minima = lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (each - 1), F.lit(0))), lambda x, i: F.least(x, *[F.get(h, i + j) for j in range(1, each)])
    )
    return let(grams(tokens, k), minima)


def _items(items: DataFrame, window: int) -> DataFrame:
    """(item, w) of the items that have windows of this length."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), plain_words(whole("text")).alias("w"))
    return rows.where(F.size("w") >= WINDOW) if window == WINDOW else rows.where(F.size("w") == window)


def _spans(tokens: str | Column, window: int) -> Column:
    """The words of each window, joined by spaces, by window start (for items and suspects only)."""
    starts = lambda w: F.slice(w, 1, F.greatest(F.size(w) - (window - 1), F.lit(0)))
    return let(F.col(tokens) if isinstance(tokens, str) else tokens, lambda w: F.transform(starts(w), lambda x, i: F.array_join(F.slice(w, i + 1, window), " ")))


def _with_length(window: int):
    return lambda fp: F.struct(F.lit(window).alias("len"), fp.alias("fp"))


def _extended(texts: DataFrame, window: int) -> DataFrame:
    """(s_id, s1, s2, len, start, span): the windows of suspects around the fingerprints they share."""
    marks = F.transform(F.filter("marks", lambda m: m["len"] == window), lambda m: m["fp"])
    rows = texts.select("s_id", "s1", "s2", "w", marks.alias("fps"), F.posexplode(window_minima(F.col("w"), window)).alias("start", "fp"))
    near = rows.where(F.array_contains("fps", F.col("fp")))
    return near.select("s_id", "s1", "s2", F.lit(window).alias("len"), "start", F.array_join(F.slice("w", F.col("start") + 1, window), " ").alias("span"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document (``doc_id``, ``text``): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``items`` has ``item_id`` and ``text``. Null or empty texts have no words and hit nothing; items
    without words match nothing; a null item id hits but is not listed. Equal rows keep a row each;
    empty tables give no rows or no hits. Other columns are ignored. All words of every text are read.
    """
    items = durable(items.select("item_id", "text"))
    counts = items.select(F.size(plain_words(whole("text"))).alias("n")).where("n > 0").select(F.least("n", F.lit(WINDOW)).alias("n")).distinct()
    lengths = sorted(r.n for r in counts.collect())  # at most WINDOW numbers

    parts = [
        _items(items, m).select(
            F.lit(m).alias("len"), "item", F.explode(F.arrays_zip(_spans("w", m).alias("span"), window_minima(F.col("w"), m).alias("fp"))).alias("x")
        ).select("len", "item", "x.span", "x.fp")
        for m in lengths
    ]
    spark = docs.sparkSession
    windows = spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (("len", "int"), ("item", "string"), ("span", "string"), ("fp", "bigint"))])
    for part in parts:
        windows = windows.unionByName(part)
    windows = durable(windows.distinct())
    prints = windows.select("len", "fp").distinct()

    keyed = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), plain_words(whole("text")).alias("w"))
    own = [F.transform(F.array_distinct(window_minima(F.col("w"), m)), _with_length(m)) for m in lengths]
    own = own or [F.array().cast("array<struct<len:int,fp:bigint>>")]
    seen = keyed.select("doc_id", "k1", "k2", F.explode(F.concat(*own)).alias("p"))
    met = seen.select("doc_id", "k1", "k2", "p.len", "p.fp").join(prints, ["len", "fp"])
    marks = met.groupBy("doc_id", "k1", "k2").agg(F.collect_set(F.struct("len", "fp")).alias("marks"))
    # documents are counted beside that join, copies reduced before the shuffle
    every = keyed.groupBy("doc_id", "k1", "k2", F.size("w").alias("n_words")).agg(F.count(F.lit(1)).alias("copies"))
    same = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))
    named_marks = marks.select(F.col("doc_id").alias("_i"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), "marks")
    found = durable(every.join(named_marks, same, "left").drop("_i", "_1", "_2"))

    suspects = found.where(F.size("marks") > 0).select(F.col("doc_id").alias("s_id"), F.col("k1").alias("s1"), F.col("k2").alias("s2"), "marks")
    texts = docs.join(suspects, docs["doc_id"].eqNullSafe(suspects["s_id"]) & (F.xxhash64(docs["text"]) == suspects["s1"]) & (F.xxhash64(F.lit(1), docs["text"]) == suspects["s2"]))
    texts = texts.select("s_id", "s1", "s2", "marks", plain_words(whole("text")).alias("w"))
    spans = [_extended(texts, m) for m in lengths]
    kinds = (("s_id", dict(docs.dtypes)["doc_id"]), ("s1", "bigint"), ("s2", "bigint"), ("len", "int"), ("start", "int"), ("span", "string"))
    hits = spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in kinds])
    for part in spans:
        hits = hits.unionByName(part)
    true = durable(hits.join(windows.select("len", "span").distinct(), ["len", "span"]).distinct())
    key = ["s_id", "s1", "s2"]
    covered = true.groupBy(*key).agg(F.collect_set(F.struct("start", "len")).alias("at")).select(
        *key, F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))).alias("n_hit")
    )
    of_span = windows.groupBy("len", "span").agg(F.collect_set("item").alias("of"))
    named = true.select(*key, "len", "span").distinct().join(of_span, ["len", "span"])
    listed = named.groupBy(*key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("of")))).alias("items"))
    out = found
    for side in (covered, listed):
        side = side.select(F.col("s_id").alias("_i"), F.col("s1").alias("_1"), F.col("s2").alias("_2"), side.columns[-1])
        out = out.join(side, out["doc_id"].eqNullSafe(side["_i"]) & (out["k1"] == side["_1"]) & (out["k2"] == side["_2"]), "left").drop("_i", "_1", "_2")
    names = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no item's window occurs in, columns as they were, whatever their names; equal rows share their fate."""
    key = row_key("doc_id", "text")
    hit = decontaminate(docs.select(key.alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias("_gone")).distinct()
    mark = free_name(docs.columns, "_key")
    marked = docs.withColumn(mark, key)
    return marked.join(hit, marked[mark] == hit["_gone"], "left_anti").select(*[marked[c] for c in docs.columns])
