"""Source divergence audit: exact term counts per source through sharded minimal perfect hashes.

The first pass counts in how many documents of its language each term occurs and keeps those in
``LEAST_DOCS`` or more. The kept terms of a language are dealt to shards of about ``SHARD_TERMS`` by
CRC-32, and every shard gets a minimal perfect hash: levels of bit arrays, in which a term that is
alone at its place takes it and the others go on to the next level; a set bit's rank is the slot. The
terms themselves are stored by slot, so that a term that was not kept but meets a set bit is found out.

The second pass reads the documents again with the shards broadcast, numbers a task's terms by language,
looks each numbered term up once and adds to one dense array of slots per (language, source). A broadcast holds at most ``BROADCAST_BYTES`` of shards; more go in
further passes, each over all documents, so a vocabulary of any size is counted exactly. Arrays and
dictionaries of a task are emptied into its output when they exceed a fixed size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import written

LEAST_DOCS, TOP_TERMS = 10, 10
SHARD_TERMS, BROADCAST_BYTES = 20_000, 64 << 20
DICT_ENTRIES, DENSE_CELLS, PENDING_TERMS = 300_000, 6_000_000, 2_000_000
SLOT_BLOCK, SOURCE_BLOCK = 2_048, 96
_GAMMA, _LEAST_BITS = 2, 64
# letters, lower-cased, and every byte of a character beyond ASCII stay; all else parts terms
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of an UTF-8 text, in order."""
    return text.translate(_TABLE).split()


class PerfectHash:
    """A minimal perfect hash over ``names``, which it stores by slot: ``find`` is exact for any term."""

    def __init__(self, sizes: list[int], bits: bytes, names: list[bytes]):
        self.sizes, self.bits, self.names = sizes, bits, names
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.taken = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(self.starts[-1])).astype(bool)
        self.rank = np.cumsum(self.taken) - 1

    @staticmethod
    def _hashed(names: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names)), dtype="<u8").reshape(-1, 2)

    @staticmethod
    def _place(hashed: np.ndarray, level: int, size: int) -> np.ndarray:
        h = hashed[:, 0] + hashed[:, 1] * np.uint64(2 * level + 1)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(20)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, names: list[bytes]) -> PerfectHash:
        """Over distinct names."""
        hashed, left, sizes, levels = cls._hashed(names), np.arange(len(names)), [], []
        while len(left):
            size = max(_LEAST_BITS, _GAMMA * len(left))
            at = cls._place(hashed[left], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=bool)
            bits[at[alone]] = True
            sizes.append(size)
            levels.append(bits)
            left = left[~alone]
        packed = np.packbits(np.concatenate(levels)).tobytes() if levels else b""
        made = cls(sizes, packed, names)
        slots = made._slots(hashed)
        by_slot: list[bytes] = [b""] * len(names)
        for name, slot in zip(names, slots.tolist(), strict=True):
            by_slot[slot] = name
        made.names = by_slot
        return made

    def _slots(self, hashed: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(hashed), -1, dtype=np.int64), np.arange(len(hashed))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + self._place(hashed[left], level, size)
            hit = self.taken[at]
            slots[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return slots

    def find(self, names: list[bytes]) -> np.ndarray:
        """The slot of each name, -1 for one that is not stored."""
        if not names or not self.names:
            return np.full(len(names), -1, dtype=np.int64)
        slots = self._slots(self._hashed(names))
        # a name without a slot is compared with the last one stored, and told by its slot
        same = np.fromiter(map(eq, names, map(self.names.__getitem__, slots.tolist())), bool, len(names))
        return np.where(same & (slots >= 0), slots, -1)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, bytes]]:
    lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    return zip(lang, source, (x.as_py() for x in batch.column(2)), strict=True)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term binary, docs): in how many rows of ``lang, source, text`` each term occurs."""
    names = ["lang", "term", "docs"]

    def out(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for lang, _, text in _rows(batch):
                mine = seen.setdefault(lang, Counter())
                held -= len(mine)
                mine.update(set(terms(text)))
                held += len(mine)
                if held > DICT_ENTRIES:
                    yield from out(seen)
                    seen, held = {}, 0
        yield from out(seen)

    partial = docs.mapInArrow(count, "lang string, term binary, docs bigint")
    return partial.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def _shards(kept: DataFrame) -> DataFrame:
    """(lang, shard, of, sizes, bits, names, n, bytes): the perfect hashes of ``lang, term``, each built by one task."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        made = PerfectHash.build(rows.column("term").to_pylist())
        return pa.table({
            "lang": pa.array([key[0].as_py()], pa.string()), "shard": pa.array([key[1].as_py()], pa.int64()),
            "of": rows.column("of").slice(0, 1), "sizes": pa.array([made.sizes], pa.list_(pa.int32())),
            "bits": pa.array([made.bits], pa.binary()), "names": pa.array([made.names], pa.list_(pa.binary())),
            "n": pa.array([len(made.names)], pa.int64()),
        })

    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SHARD_TERMS).alias("of"))
    dealt = kept.join(sizes, "lang").select("lang", "term", "of", F.pmod(F.crc32("term"), F.col("of")).alias("shard"))
    made = dealt.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard bigint, of bigint, sizes array<int>, bits binary, names array<binary>, n bigint"
    )
    weight = F.aggregate("names", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x) + 16) + 5 * F.octet_length("bits")
    return made.withColumn("bytes", weight)


class _Numbers(dict):
    """Term -> its number, in the order in which terms are first asked for."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _recount(docs: DataFrame, directory: dict[str, tuple[int, dict[int, tuple[int, tuple]]]]) -> DataFrame:
    """(lang, source, slot, n) partial counts of the terms in the broadcast shards.

    ``directory``: language -> (shards of the language, {shard: (its first slot, (sizes, bits, names))}).
    """
    sent = docs.sparkSession.sparkContext.broadcast(directory)
    names = ["lang", "source", "slot", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {lang: (of, {k: (first, PerfectHash(*parts)) for k, (first, parts) in shards.items()}) for lang, (of, shards) in sent.value.items()}
        width = {lang: sum(len(h.names) for _, h in shards.values()) for lang, (_, shards) in known.items()}
        # where the slots of a shard start in a group's dense array, which holds this pass's shards only
        base = {}
        for lang, (_, shards) in known.items():
            at = 0
            for k, (first, h) in sorted(shards.items()):
                base[lang, k] = (at, first)
                at += len(h.names)
        numbers: dict[str, _Numbers] = {lang: _Numbers() for lang in known}
        at: dict[str, np.ndarray] = {lang: np.zeros(0, dtype=np.int64) for lang in known}
        seen: dict[tuple[str, str], list[np.ndarray]] = {}
        dense: dict[tuple[str, str], np.ndarray] = {}
        held = known_terms = 0

        def places(lang: str, found: list[bytes]) -> np.ndarray:
            """Where the dense arrays of a language count these terms, -1 for those that were not kept."""
            of, shards = known[lang]
            home = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % of if of > 1 else np.zeros(len(found), np.int64)
            to = np.full(len(found), -1, dtype=np.int64)
            for k, (_, h) in shards.items():
                mine = np.flatnonzero(home == k)
                slot = h.find(list(map(found.__getitem__, mine.tolist())))
                to[mine] = np.where(slot >= 0, base[lang, k][0] + slot, -1)
            return to

        def settle() -> Iterator[pa.RecordBatch]:
            # a term is looked up once, whatever sources it is in, as long as its number is kept
            for lang, mine in numbers.items():
                at[lang] = np.concatenate([at[lang], places(lang, list(islice(mine, len(at[lang]), None)))])
            cells = sum(map(len, dense.values()))
            for (lang, source), texts in seen.items():
                if (lang, source) not in dense:
                    if cells > DENSE_CELLS:
                        yield from out()
                        cells = 0
                    dense[lang, source] = np.zeros(width[lang], dtype=np.int64)
                    cells += width[lang]
                where = at[lang][np.concatenate(texts)]
                dense[lang, source] += np.bincount(where[where >= 0], minlength=width[lang])
            seen.clear()
            if sum(map(len, numbers.values())) > DICT_ENTRIES:
                for lang in known:
                    numbers[lang], at[lang] = _Numbers(), np.zeros(0, dtype=np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), slots in dense.items():
                found = np.flatnonzero(slots)
                if len(found):
                    heads = sorted(base[lang, k] for k in known[lang][1])
                    which = np.searchsorted([h[0] for h in heads], found, side="right") - 1
                    true = found + (np.array([h[1] - h[0] for h in heads]))[which]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), pa.array(true), pa.array(slots[found])], names
                    )
            dense.clear()

        for batch in batches:
            for lang, source, text in _rows(batch):
                if lang in known:
                    mine, numbered = terms(text), numbers[lang]
                    known_terms -= len(numbered)
                    seen.setdefault((lang, source), []).append(np.fromiter(map(numbered.__getitem__, mine), np.int32, len(mine)))
                    known_terms += len(numbered)
                    held += len(mine) + 16  # an array has a head
                    if held > PENDING_TERMS or known_terms > DICT_ENTRIES:
                        yield from settle()
                        held, known_terms = 0, sum(map(len, numbers.values()))
        yield from settle()
        yield from out()

    return docs.mapInArrow(count, "lang string, source string, slot bigint, n bigint")


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, slot, term) of the kept terms, and (lang, source, slot, n) with n > 0; both written tables.

    ``docs`` has lang, source, text without nulls, text as binary. The driver sees one row per shard
    and, in one pass, ``broadcast_bytes`` of shards or one shard if that is more.
    """
    kept = document_frequencies(docs).where(F.col("docs") >= least_docs).select("lang", "term")
    shards = written(_shards(kept))
    first = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("lang", "shard", "bytes", first.alias("first"))  # a language's shards, not its terms
    passes: list[list[tuple[str, int, int]]] = []
    room = 0
    for r in starts.orderBy("lang", "shard").collect():
        if not passes or room < r["bytes"]:
            passes.append([])
            room = broadcast_bytes
        passes[-1].append((r["lang"], r["shard"], r["first"]))
        room -= r["bytes"]
    slot = F.posexplode("names").alias("at", "term")
    vocabulary = written(
        shards.select("lang", "shard", slot).join(starts.select("lang", "shard", "first"), ["lang", "shard"]).select("lang", (F.col("first") + F.col("at")).alias("slot"), "term")
    )
    counts = docs.sparkSession.createDataFrame([], "lang string, source string, slot bigint, n bigint")
    for part in passes:
        low, high = part[0], part[-1]
        after = (F.col("lang") > low[0]) | ((F.col("lang") == low[0]) & (F.col("shard") >= low[1]))
        until = (F.col("lang") < high[0]) | ((F.col("lang") == high[0]) & (F.col("shard") <= high[1]))
        firsts = {(lang, k): first for lang, k, first in part}
        directory: dict = {}
        for r in shards.where(after & until).collect():
            _, mine = directory.setdefault(r["lang"], (r["of"], {}))
            mine[r["shard"]] = (firsts[r["lang"], r["shard"]], (list(r["sizes"]), bytes(r["bits"]), [bytes(x) for x in r["names"]]))
        counts = counts.unionByName(_recount(docs, directory))
    return vocabulary, written(counts.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")))


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(1000000000 * (count + 2) / (total + 2 * size)), exactly."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    bottom = (total + 2 * size).cast("decimal(20,0)")
    return F.call_function("div", top, bottom).cast("bigint") + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _block_sums(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums over a block of slots of the distances between the sources of one or two blocks of them."""
    lang, _, one, two = (k.as_py() for k in key)
    side, slot, p = (rows.column(c).to_numpy() for c in ("side", "slot", "p"))
    names = np.array(rows.column("source").to_pylist(), dtype=object)
    width = rows.column("width")[0].as_py()

    def matrix(of: int) -> tuple[list[str], np.ndarray]:
        head = np.flatnonzero((side == of) & (slot < 0))
        known = {names[i]: k for k, i in enumerate(head)}
        cells = np.repeat(p[head][:, None], width, axis=1)  # the share of a term that does not occur
        mine = np.flatnonzero((side == of) & (slot >= 0))
        cells[[known[names[i]] for i in mine], slot[mine]] = p[mine]
        return list(known), cells

    a_names, a = matrix(one)
    b_names, b = (a_names, a) if one == two else matrix(two)
    out: tuple[list, list, list] = ([], [], [])
    for i, name in enumerate(a_names):
        start = i + 1 if one == two else 0
        if start < len(b_names):
            gap = a[i] - b[start:]
            total = (gap * gap // (a[i] + b[start:])).sum(axis=1).tolist()
            others = b_names[start:]
            for column, more in zip(out, ([name] * len(others) + others, others + [name] * len(others), total + total), strict=True):
                column.extend(more)
    return pa.table({
        "lang": pa.array([lang] * len(out[0]), pa.string()), "source": pa.array(out[0], pa.string()),
        "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64()),
    })


def _pair_sums(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) over all kept terms.

    ``groups``: lang, source, size (kept terms), p0 (share of a term that does not occur); ``shares``:
    lang, source, slot, p. Sources are dealt to blocks of about ``SOURCE_BLOCK`` by hash; each pair of
    blocks meets once per ``SLOT_BLOCK`` slots, so no task holds more than two blocks of each.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCE_BLOCK).alias("blocks"))
    sources = groups.join(blocks, "lang").where("size > 0").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    last = F.floor((F.col("size") - 1) / SLOT_BLOCK)
    heads = sources.select("lang", "source", "block", "blocks", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("slots"), F.lit(-1).cast("bigint").alias("slot"), F.col("p0").alias("p"))
    cells = shares.join(sources.drop("p0"), ["lang", "source"]).select(
        "lang", "source", "block", "blocks", "size", F.floor(F.col("slot") / SLOT_BLOCK).alias("slots"), F.pmod("slot", F.lit(SLOT_BLOCK)).cast("bigint").alias("slot"), "p"
    )
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    width = F.least(F.lit(SLOT_BLOCK), F.col("size") - F.col("slots") * SLOT_BLOCK)
    dealt = heads.unionByName(cells).select("lang", "source", "slots", "slot", "p", F.col("block").alias("side"), width.alias("width"), others)
    dealt = dealt.withColumns({"one": F.least("side", "other"), "two": F.greatest("side", "other")}).drop("other")
    sums = dealt.groupBy("lang", "slots", "one", "two").applyInArrow(_block_sums, "lang string, source string, item string, value bigint")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``lang, source, text``.

    Part ``pair`` has the divergence of each (language, source) from every other source of the language,
    part ``term`` the ``top`` terms that are more frequent in the source than in its language. Null
    language, source and text are empty strings; documents without terms still make their group, whose
    counts are zero; a language without kept terms has pairs of value 0 and no terms. Repeated rows
    count each. Ties go by UTF-8 order. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.encode(text, "utf-8").alias("text"))
    vocabulary, counts = term_counts(plain, least_docs, broadcast_bytes)
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    zero = F.lit(0).cast("bigint")
    groups = groups.select("lang", "source", F.coalesce("size", zero).alias("size"), F.coalesce("total", zero).alias("total"))
    groups = written(groups.withColumn("p0", F.when(F.col("size") > 0, _share(zero, F.col("total"), F.greatest("size", F.lit(1))))))
    shares = written(counts.join(groups, ["lang", "source"]).select("lang", "source", "slot", "n", _share(F.col("n"), F.col("total"), F.col("size")).alias("p")))

    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("size").alias("size"))
    whole_lang = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).join(of_lang, "lang")
    whole_lang = whole_lang.select("lang", "slot", _share(F.col("n"), F.col("total"), F.col("size")).alias("q"))
    above = shares.join(whole_lang.join(vocabulary, ["lang", "slot"]), ["lang", "slot"]).where("p > q")
    term = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))

    sums = _pair_sums(groups, shares.drop("n"))
    skeleton = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pair = skeleton.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))
