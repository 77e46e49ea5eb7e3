"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w with u from a hash and w its quality weight; the
smallest keys are a weighted sample without replacement. Within a source the keys are sorted and the
sizes prefix-summed up to the source's word budget. Whole epochs of a source come first, the sample
fills the fraction that is left, so no document is taken more than ``epochs + 1`` times.

A source may hold most of the rows. It is cut into slices of consecutive keys: a slice number grows
with the key and the number of slices with the source's rows, so that a slice has a bounded number of
rows; sizes of earlier slices are carried over, and no window sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.shared import durable
from .text import row_key, whole, words

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_EPOCHS = 1.5, 2.0
SLICE_ROWS = 20_000
LEAST_QUALITY, MOST_QUALITY = 0.5, 2.0


def quality_weight(text: Column) -> Column:
    """0.5 to 2, from the shares of letters and of characters that are no symbols."""
    chars = F.length(text)
    symbols = chars - F.length(F.translate(text, "#*$%&|<>{}[]=_0123456789", ""))
    return F.when(chars > 0, MOST_QUALITY - (MOST_QUALITY - LEAST_QUALITY) * F.least(4.0 * symbols / chars, F.lit(1.0))).otherwise(LEAST_QUALITY)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with target: ``share`` of all sizes by weight, none above ``most`` sizes.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. The excess over the
    limits is shared again by weight until no source is above: with sources ordered by limit per
    weight, those whose limit is below what is left per weight get their limit.
    One row per source passes here, not documents.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)).withColumn("cap", F.col("source_size") * most)
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levels = weighed.withColumn("level", level).withColumn("free", F.col("level") <= F.col("cap") / F.col("w"))
    common = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"]
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce(common * F.col("w"), F.col("cap"))))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def _keys(docs: DataFrame, seed: int) -> list[Column]:
    """Two hashes of a whole row (of the columns that can be hashed), nulls being values of their own."""
    whole_row = ["doc_id", "source", "text"] + [c for c, t in docs.dtypes if c not in ("doc_id", "source", "text") and not any(x in t for x in ("map<", "variant", "void"))]
    return [row_key(*[f"`{c}`" for c in whole_row], seed=seed), row_key(*[f"`{c}`" for c in reversed(whole_row)], seed=seed + 1)]


def _groups(docs: DataFrame, seed: int, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per distinct row of ``docs`` and what the mix takes of it.

    doc_id, source, size, source_size, target, k1, k2, copies, epochs (takes of each copy) and extra (how
    many of the copies are taken once more; only one row of a source may have some extra and not all).
    """
    text = whole("text")
    k1, k2 = _keys(docs, seed)
    every = docs.select("doc_id", "source", F.size(words(text)).cast("bigint").alias("size"), quality_weight(text).alias("w"), k1.alias("k1"), k2.alias("k2"))
    rows = durable(every.groupBy("doc_id", "source", "size", "w", "k1", "k2").agg(F.count(F.lit(1)).alias("copies")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_w"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    plan = durable(sizes.join(targets.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"), "source_size", "target", "mean_w",
        F.ceil(F.col("n") / SLICE_ROWS).alias("slices"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("epochs"),
    ))
    u = (F.shiftrightunsigned("k1", 11) + 0.5) / F.lit(float(1 << 53))
    keyed = rows.join(plan, rows["source"].eqNullSafe(plan["_s"])).withColumn("key", -F.log(u) / F.col("w"))
    # 1 - exp(-key * mean weight) is close to uniform, so slices are close to even
    placed = keyed.withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean_w"))) * F.col("slices")), F.col("slices") - 1))
    total = F.col("size") * F.col("copies")
    ahead = W.partitionBy("_s").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("_s", "slice").agg(F.sum(total).alias("in_slice")).select(
        F.col("_s").alias("_t"), F.col("slice").alias("_l"), F.coalesce(F.sum("in_slice").over(ahead), F.lit(0)).alias("start")
    )
    within = W.partitionBy("_s", "slice").orderBy("key", "k1", "k2").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum(total).over(within), F.lit(0)))
    met = summed.join(starts, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("slice") == F.col("_l")))
    left = F.col("target") - F.col("epochs") * F.col("source_size") - F.col("start") - F.col("inside")
    # one more copy as long as more than half of it fits
    fits = F.greatest(F.lit(0), F.least(F.col("copies"), F.floor(left / F.greatest("size", F.lit(1)) + 0.5))).cast("bigint")
    extra = F.when(F.col("size") > 0, fits).otherwise(0)
    return met.select("doc_id", "source", "size", "source_size", "target", "k1", "k2", "copies", "epochs", extra.alias("extra"))


def mix(docs: DataFrame, seed: int = 5, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, row key k1, k2) per document of ``doc_id, text, source``.

    ``times`` is how often the mix takes the document. Sizes are words; a null or empty text has size 0
    and is taken as often as its source's whole epochs. The document at the border of the budget is
    taken if more than half of it fits. Keys depend on the row and the seed only: reruns agree, and rows
    that are equal in all columns, being interchangeable, may be taken a different number of times. An
    empty table gives none.
    """
    groups = _groups(docs, seed, weights, share, most)
    each = groups.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    times = F.col("epochs") + (F.col("_nth") <= F.col("extra")).cast("bigint")
    return each.select("doc_id", "source", "size", "source_size", "target", "k1", "k2", times.alias("times"))


def mixed_documents(
    docs: DataFrame, seed: int = 5, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS
) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``, whatever their names."""
    groups = _groups(docs, seed, weights, share, most).where("epochs > 0 OR extra > 0")
    taken = durable(groups.select(F.col("k1").alias("_a"), F.col("k2").alias("_b"), "copies", "epochs", "extra"))
    k1, k2 = _keys(docs, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    met = rows.join(taken, (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b")))
    # every copy alike, and once more where all are; the few left of a border group come from one of its copies
    alike = F.col("epochs") + (F.col("extra") == F.col("copies")).cast("bigint")
    border = (F.col("extra") > 0) & (F.col("extra") < F.col("copies"))
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("bigint"), n))
    most_of = met.where(alike > 0).select("row", times(alike).alias("_n"))
    rest = met.where(border).dropDuplicates(["k1", "k2"]).select("row", times(F.col("extra")).alias("_n"))
    return most_of.unionAll(rest).select("row.*")
