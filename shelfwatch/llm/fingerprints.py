"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of each window, with positions.

Every run of ``GRAM`` code points has a rolling 64-bit polynomial hash, mixed and cut to 32 bits. Of
each ``WINDOW`` consecutive hashes the smallest is kept, of equal ones the rightmost, together with
its position. Two texts that share ``GRAM + WINDOW - 1`` consecutive code points therefore share a
fingerprint, and the kept positions say where. Texts with less than ``8 * WINDOW`` hashes use a window
of an eighth of them (a power of two), so that short texts keep several too: what is smallest in a
window is smallest in each part of it that holds it, so all that a full window would keep is kept and
the guarantee stands. A text under ``GRAM`` code points is one gram, filled up with zeros. The empty
text has no fingerprint.

``with_next`` finds every row's neighbour in the order of ids with a single exchange of the texts: a
first pass over ids and hashes finds where the range partitions begin and end, a second one deals
the texts to those ranges, sends the last row of each to the range after it as well, and reads each
range in order, one row at a time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.shared import durable
from .text import whole

GRAM, WINDOW = 16, 64
GUARANTEED = GRAM + WINDOW - 1
#: rows with one id and text above this share of a range's rows, and this number, are dealt over several
HOT_SHARE, HOT_ROWS = 2.0, 2_000
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ENTRY = np.dtype([("hash", "<u4"), ("gap", "u1")])


def gram_hashes(points: np.ndarray, k: int = GRAM) -> np.ndarray:
    """The mixed 32-bit hash of every run of ``k`` code points (``k`` a power of two), by doubling.

    The hash of 2m points is that of the first m times base^m plus that of the last m, so log2(k)
    passes over the text take the place of a step per character.
    """
    h = points.astype(np.uint64) + np.uint64(1)
    power, m = _BASE, 1
    while m < k:
        h = h[:-m] * np.uint64(power) + h[m:]
        power, m = power * power % 2**64, 2 * m
    h ^= h >> np.uint64(31)
    h *= _MIX
    return (h >> np.uint64(32)).astype(np.uint32)


def window_minima(hashes: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash in each run of ``w`` (a power of two), the rightmost of equal ones, each once."""
    at = np.arange(len(hashes), dtype=np.int64)
    if len(hashes) <= w:
        return at[len(hashes) - 1 - np.argmin(hashes[::-1])][None] if len(hashes) else at
    # the hash above, the distance from the end below: the smallest is the rightmost of the least
    best = (hashes.astype(np.uint64) << np.uint64(32)) | (np.uint64(len(hashes) - 1) - at.astype(np.uint64))
    m = 1
    while m < w:
        best = np.minimum(best[:-m], best[m:])
        m *= 2
    first = np.empty(len(best), dtype=bool)
    first[0] = True
    np.not_equal(best[1:], best[:-1], out=first[1:])
    return len(hashes) - 1 - (best[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept of a text, by position."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if len(points) < GRAM:
        points = np.concatenate([points, np.zeros(GRAM - len(points), dtype="<u4")])
    hashes = gram_hashes(points)
    window = min(WINDOW, 1 << max(0, (len(hashes) // 8).bit_length() - 1))
    at = window_minima(hashes, window)
    return hashes[at], at


@functools.lru_cache(maxsize=4)
def _known(text: str) -> tuple[np.ndarray, np.ndarray]:
    return fingerprint(text)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as text: base64 of (hash, distance to the position before) entries of five bytes."""
    entries = np.empty(len(hashes), dtype=_ENTRY)
    entries["hash"] = hashes
    entries["gap"] = np.diff(positions, prepend=0)  # never above WINDOW
    return base64.b64encode(entries.tobytes()).decode("ascii")


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a written fingerprint."""
    entries = np.frombuffer(base64.b64decode(text), dtype=_ENTRY)
    return entries["hash"].astype(np.uint32), np.cumsum(entries["gap"].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def spliced(text: str, after: str) -> str:
    """``text`` with its last half (rounded down) replaced by the start of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _key() -> Column:
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "k1", "k2")


def _literal(key: dict, kind: str) -> Column:
    return F.struct(
        F.lit(key["known"]).alias("known"), F.lit(key["doc_id"]).cast(kind).alias("doc_id"), F.lit(key["k1"]).alias("k1"), F.lit(key["k2"]).alias("k2")
    )


def _place(cuts: Column, n: int) -> Column:
    """How many of the ``n`` sorted ``cuts`` are not above the row's key, less one: a binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n.bit_length())))])
    further = lambda at, step: F.when((at + step <= n) & (F.get(cuts, at + step - 1) <= F.col("_key")), at + step).otherwise(at)
    return F.greatest(F.aggregate(steps, F.lit(0), further) - 1, F.lit(0))


CHAIN, GUEST, SELF = 0, 1, 2


def with_next(docs: DataFrame, combine: Callable[[str, str, dict | None], dict], schema: str, ranges: int | None = None) -> DataFrame:
    """``combine(text, next text, result of an equal pair before it or None)`` per row of ``doc_id, text``.

    The next document is the one before in ascending order of ids (null first), the first one's is the
    last; rows with one id go by the hash of their text. ``schema`` names what ``combine`` returns.
    ``ranges`` is the number of ranges, by default the session's shuffle partitions; a task holds two
    texts and an Arrow batch. The driver sees the borders of the ranges and the keys that alone exceed
    twice a range's even share, never more than there are ranges. Copies of such a key follow one
    another, so all but one have their own text next: that many are dealt over other ranges.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", whole("text").alias("text"))
    keyed = texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(11), "text")})
    keys = durable(keyed.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("copies")))
    ordered = keys.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), "k1", "k2").withColumn("part", F.spark_partition_id())
    borders = sorted(
        ordered.groupBy("part").agg(F.min(_key()).alias("first"), F.max(_key()).alias("last"), F.sum("copies").alias("rows")).collect()
    )
    if not borders:
        return spark.createDataFrame([], f"doc_id {kind}, {schema}")
    share = sum(b["rows"] for b in borders) / ranges
    hot = keys.where((F.col("copies") > HOT_SHARE * share) & (F.col("copies") > HOT_ROWS)).select(_key().alias("key"), "copies").collect()

    key = F.col("_key")
    cuts = F.array(*[_literal(b["first"].asDict(), kind) for b in borders])
    lasts = F.array(*[_literal(b["last"].asDict(), kind) for b in borders])
    here = F.struct(F.col("_range").alias("at"), F.lit(CHAIN).alias("role"))
    after = F.struct(((F.col("_range") + 1) % len(borders)).alias("at"), F.lit(GUEST).alias("role"))
    is_last = F.get(lasts, F.col("_range")) == key
    goes = F.when(is_last, F.array(here, after)).otherwise(F.array(here))
    if hot:
        alone = F.lit(False)
        for r in hot:
            spread = min(int(r["copies"] // max(share, 1)) + 1, r["copies"] // 500)
            stays = F.col("_salt") % spread == 0  # hundreds of copies stay, so that the chain has one
            alone = alone | ((key == _literal(r["key"].asDict(), kind)) & ~stays)
        away = F.array(F.struct(F.pmod(F.col("_salt"), F.lit(ranges)).cast("int").alias("at"), F.lit(SELF).alias("role")))
        goes = F.when(alone, away).otherwise(goes)
    salted = keyed.withColumn("_salt", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1))
    placed = salted.withColumn("_key", _key()).withColumn("_range", _place(cuts, len(borders)))
    dealt = placed.select("doc_id", "text", "k1", "k2", F.inline(goes))
    rows = dealt.repartitionById(ranges, "at").sortWithinPartitions(
        "at", F.when(F.col("role") == GUEST, 0).otherwise(1), F.col("doc_id").asc_nulls_first(), "k1", "k2", "role"
    ).select("doc_id", "text", "role")
    out_type = StructType.fromDDL(f"doc_id {kind}, {schema}")
    arrow = to_arrow_schema(out_type)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, pair, result = "", None, None
        for batch in batches:
            ids, results = [], []
            for i, (text, role) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                text = text.as_py()
                if role != GUEST:
                    new = (text, text if role == SELF else before)
                    result = combine(*new, result if new == pair else None)
                    pair = new
                    ids.append(i)
                    results.append(result)
                before = text
            columns = [batch.column(0).take(pa.array(ids, pa.int32()))]
            columns += [pa.array([r[f.name] for r in results], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return rows.mapInArrow(walk, out_type)


EDITED = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document of ``doc_id, text``: n_chars, its fingerprint, that of its edited text, and likenesses.

    The edited text has its last half replaced by the start of the next document (the next smaller id;
    the smallest id's next is the largest). Null texts are empty: their fingerprint is empty and alike
    only to an empty one. Equal texts have equal fingerprints; repeated rows keep a row each, and all but
    one of them have their own text next. Null ids come last. Other columns are ignored; an empty table
    gives no rows. Whole texts are read, whatever their length.
    """
    def combine(text: str, after: str, same: dict | None) -> dict:
        if same is not None:
            return same
        edited = spliced(text, after)
        mine, changed = _known(text), fingerprint(edited)
        return {
            "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
            "fingerprint": written(*mine), "edited_fingerprint": written(*changed),
            "near_edited": likeness(mine[0], changed[0]), "near_next": likeness(mine[0], _known(after)[0]),
        }

    return with_next(docs, combine, EDITED, ranges)
