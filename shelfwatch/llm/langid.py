"""Language ID by Bayesian evidence fusion.

log P(l | row) = text log likelihood + log P(declared | l) + log P(l | host), normalised.

* Text: hashed byte trigrams of the whole lower-cased text, one multinomial per language, counted over
  all rows that declare it. Trigrams overlap, so they count ``GRAM_WEIGHT`` each, ``MOST_GRAMS`` at most.
* Declared markup language: P(declared | l) from the text's posterior masses over all rows.
* Host prior: masses of the text's posteriors grouped by host, smoothed towards those of the address
  suffix, which are smoothed towards those of all rows.

Languages are all declared values of rows with letters, however few. The model has ``BUCKETS`` numbers per
language, on the driver and in every task, so memory grows with the number of distinct declarations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import durable
from .text import free_name, row_key

BUCKETS = 1 << 13
# smoothing counts per bucket, and their sum as a share of a small language's trigrams: unseen trigrams
# stay below LEAST_FIT in every model, so a language of few rows does not claim whatever is unlike the others
SMOOTH, SMOOTH_SHARE = 0.5, 0.1
GRAM_WEIGHT, MOST_GRAMS = 0.3, 60.0
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 10.0, 20.0, 5.0
LEAST_CONFIDENCE = 0.5
# mean log likelihood of a trigram below equal chances: far from any text of the language
LEAST_FIT = -1.5


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the letters, everything else being one space; no letters, no counts."""
    raw = _LETTERS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    raw = raw[(raw != 32) | np.concatenate([[True], raw[:-1] != 32])].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(BUCKETS, dtype=np.int64)
    grams = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(19), minlength=BUCKETS)


_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def document_evidence(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(id, text, declared, host, suffix) of documents: their declared language and source; ``key`` replaces the id."""
    suffix = F.lower(F.regexp_extract(F.coalesce("source", F.lit("")), r"\.([A-Za-z]{2,})$", 1))
    return docs.select((F.col("doc_id") if key is None else key).alias("id"), "text", F.lower("lang").alias("declared"), F.lower("source").alias("host"), F.nullif(suffix, F.lit("")).alias("suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """The same of web pages: visible text, the html element's language, host and last host label."""
    bare = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return pages.select(
        F.col("page_id").alias("id"), bare.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit("")).alias("suffix"),
    )


def languages(rows: DataFrame) -> list[str]:
    return sorted(r.declared for r in rows.where("declared IS NOT NULL AND length(text) > 0").select("declared").distinct().collect())


def text_model(rows: DataFrame, declared: list[str]) -> tuple[list[str], np.ndarray]:
    """The declared languages that have trigrams, and their smoothed log probabilities (language, bucket)."""
    place = {name: i for i, name in enumerate(declared)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, name in zip(batch["text"], batch["declared"], strict=True):
                if text and name in place:
                    sums.setdefault(place[name], np.zeros(BUCKETS, dtype=np.int64))
                    sums[place[name]] += gram_counts(text)
        for i, each in sums.items():
            at = each.nonzero()[0]
            yield pd.DataFrame({"l": np.full(len(at), i, dtype=np.int32), "b": at.astype(np.int32), "n": each[at]})

    found = rows.select("text", "declared").mapInPandas(count, "l int, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    have, at = np.unique(found["l"].to_numpy(), return_inverse=True)
    sums = np.zeros((len(have), BUCKETS))
    sums[at, found["b"]] = found["n"]
    sums += np.minimum(SMOOTH, SMOOTH_SHARE * sums.sum(axis=1, keepdims=True) / BUCKETS)
    return [declared[i] for i in have], np.log(sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)


def _text_likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), len(model)))
            mean = np.full(len(batch), np.nan)
            for i, text in enumerate(batch["text"]):
                counts = gram_counts(text) if text else None
                if counts is not None and (n := counts.sum()):
                    each = model @ counts.astype(np.float32) / n
                    out[i], mean[i] = each * min(n * GRAM_WEIGHT, MOST_GRAMS), each.max()
            soft = np.exp(out - out.max(axis=1, keepdims=True))
            soft /= soft.sum(axis=1, keepdims=True)
            yield batch.drop(columns="text").assign(ll=list(out), soft=list(soft), fit=mean)

    return rows.mapInPandas(score, "id string, declared string, host string, suffix string, ll array<double>, soft array<double>, fit double")


def _masses(scored: DataFrame, *keys: str) -> DataFrame:
    """The posterior mass of each language per key, as a map, and the sum."""
    each = scored.where("fit IS NOT NULL").select(*keys, F.posexplode("soft").alias("l", "p")).where("p > 1e-4")
    sums = each.groupBy(*keys, "l").agg(F.sum("p").alias("m"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("l", "m"))).alias("m"), F.sum("m").alias("sum"))


def _at(masses: str, i: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(masses), i), F.lit(0.0))


def identify(rows: DataFrame) -> DataFrame:
    """(id, language, confidence, text_language, kept) per row of (id, text, declared, host, suffix).

    ``kept`` is false where there is no letter, where the best language explains the letters much worse
    than equal chances of all trigrams, or where no language reaches ``LEAST_CONFIDENCE``. A null
    declaration, host or suffix is no evidence. Without any text that declares a language, nothing can
    be identified: language is null and no row is kept. Equal rows get equal results; an empty table
    gives none. Whole texts are read.
    """
    kind = rows.schema["id"].dataType
    # as text, an id is the same in pandas whatever else is in the batch
    rows = rows.select(F.col("id").cast("string").alias("id"), "text", "declared", "host", "suffix")
    langs, model = text_model(rows, languages(rows))
    if not langs:
        return rows.select(F.col("id").cast(kind).alias("id"), *[F.lit(None).cast(t).alias(c) for c, t in (("language", "string"), ("confidence", "double"), ("text_language", "string"))], F.lit(False).alias("kept"))
    scored = durable(_text_likelihoods(rows, model))
    every = F.sequence(F.lit(0), F.lit(len(langs) - 1))
    whole = _masses(scored.withColumn("_all", F.lit(1)), "_all").collect()
    mass, total = (whole[0]["m"], whole[0]["sum"]) if whole else ({}, 0.0)
    share = F.array(*[F.lit((mass.get(i, 0.0) + 1.0) / (total + len(langs))) for i in range(len(langs))])
    of_lang = F.array(*[F.lit(float(mass.get(i, 0.0))) for i in range(len(langs))])

    suffixes = _masses(scored.where("suffix IS NOT NULL"), "suffix").select(
        "suffix", F.transform(every, lambda i: (_at("m", i) + SUFFIX_WEIGHT * F.get(share, i)) / (F.col("sum") + SUFFIX_WEIGHT)).alias("by_suffix")
    )
    hosts = _masses(scored.where("host IS NOT NULL"), "host").select("host", F.col("m").alias("hm"), F.col("sum").alias("hsum"))
    declared = _masses(scored.where("declared IS NOT NULL"), "declared").select("declared", F.col("m").alias("dm"))
    met = scored.join(suffixes, "suffix", "left").join(hosts, "host", "left").join(declared, "declared", "left")
    base = F.coalesce("by_suffix", share)
    none = F.lit(0.0)
    prior = lambda i: F.log((F.coalesce(F.try_element_at("hm", i), none) + HOST_WEIGHT * F.get("by", i)) / (F.coalesce("hsum", none) + HOST_WEIGHT))
    # an unknown declaration says the same of every language
    said = lambda i: F.when(F.col("dm").isNull(), 0.0).otherwise(F.log((F.coalesce(F.try_element_at("dm", i), none) + DECLARED_WEIGHT / len(langs)) / (F.get(of_lang, i) + DECLARED_WEIGHT)))
    fused = met.withColumn("by", base).withColumn("post", F.transform(every, lambda i: F.get("ll", i) + prior(i) + said(i)))
    top = F.array_max("post")
    names = F.array(*[F.lit(x) for x in langs])
    best = fused.select(
        "id", "fit", F.get(names, F.array_position("post", top).cast("int") - 1).alias("language"),
        (1 / F.aggregate(F.transform("post", lambda x: F.exp(x - top)), none, lambda a, x: a + x)).alias("confidence"),
        F.when(F.col("fit").isNotNull(), F.get(names, F.array_position("ll", F.array_max("ll")).cast("int") - 1)).alias("text_language"),
    )
    kept = F.coalesce((F.col("fit") > LEAST_FIT - float(np.log(BUCKETS))) & (F.col("confidence") >= LEAST_CONFIDENCE), F.lit(False))
    return best.select(F.col("id").cast(kind).alias("id"), "language", "confidence", "text_language", kept.alias("kept"))


def with_known_language(docs: DataFrame) -> DataFrame:
    """The documents whose language could be told, columns as they were, whatever their names.

    Rows of one id, text, language and source share their fate; nulls are values of their own.
    """
    key = row_key("doc_id", "text", "lang", "source")
    mark = free_name(docs.columns, "_key")
    found = identify(document_evidence(docs, key)).where("NOT kept").select(F.col("id").alias("_gone")).distinct()
    marked = docs.withColumn(mark, key)
    return marked.join(found, marked[mark] == found["_gone"], "left_anti").select(*[marked[c] for c in docs.columns])
