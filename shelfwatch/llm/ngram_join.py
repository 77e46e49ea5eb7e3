"""N-gram Jaccard join: prefix filters under several global token orders, then exact verification.

A document is the set of its distinct 3-word shingles (64-bit hashes). Two sets of similarity J link
if ``100 * |A & B| >= percent * |A | B|``; then ``|A & B| >= percent/100 * max(|A|, |B|)``, from which
every filter below follows without loss.

1. Equal sets are one node, named by a 64-bit hash like the shingles. A set of size n has p(n) = n - ceil(percent * n / 100) + 1 prefix tokens:
   linked sets share at least one of them under *any* global order.
2. Order one is the hash itself. Its prefix is taken l(n) - 1 tokens longer with l = p / 2 rounded up, so
   linked sets share at least l of those tokens; only these are shuffled.
3. Order two is rarity (distinct sets that have the token in their longer prefix). Of the longer prefix
   only the rarest tokens are kept, as many as needed for linked sets still to share one. Passages that
   many documents have are common and so fall off; tokens that one set has link nothing.
4. A parity bitmap of the set (bit ``h mod 256`` flips with each token) bounds the difference from below:
   the bits in which two bitmaps differ are at most ``|A ^ B|``, which links bound from above. Joins on
   tokens let only such pairs through, so a group of similar texts that do not link makes no pairs.
5. Orders three and four are two other hashes: a candidate pair must also share a token of those
   prefixes. All filters are intersected before the sets are compared.

Large groups of near copies are not expanded into all pairs: in each round the documents of a token
that still has several classes are compared with a few leaders (the one with fewest tokens of its own
first, then one of the token's first and last class and one by hash), linked ones share a class from
then on, and pairs within one class are never compared: they are connected by links already found.
A round is made while the one before found links, at most two of them. The last step takes every remaining pair of different classes
that shares a kept token, once, at the first token that both kept. Of two classes a few such pairs are compared first, then more,
at last all that still lie in different classes, so no link between different classes is lost. Components are those of all links together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.shared import durable, stored
from .graph import components, neighbourhoods, written
from .text import free_name, grams, let, whole, words

ROUNDS = 2  # what they leave, however much, the last step compares
BITMAP_ROWS = 1 << 16
PARITY_WORDS = 4
#: so many pairs of two classes are compared in turn before all the others
FEW = (2, 64)
#: a token with this many nodes outside its largest class lets a pair out once, not at every such token
MANY = 24
PARITY = [f"b{k}" for k in range(PARITY_WORDS)]


def shingle_set(text: Column, width: int = 3) -> Column:
    """Sorted distinct hashes of the text's shingles; fewer words are one shingle; none give none."""
    def of(w: Column) -> Column:
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.lit("short"), w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= width, grams(w, width)).otherwise(few)

    return F.sort_array(F.array_distinct(let(words(text, lower=True), of)))


def _prefix(n: Column, percent: int) -> Column:
    return n - F.floor((n * percent + 99) / 100).cast("int") + 1


def _promised(n: Column, percent: int) -> Column:
    """How many tokens of the longer prefixes linked sets share at least: half the prefix, so that a third may be common ones."""
    return F.floor((_prefix(n, percent) + 1) / 2).cast("int")


def _longer(n: Column, percent: int) -> Column:
    return _prefix(n, percent) + _promised(n, percent) - 1


def _needed(n: Column, percent: int) -> Column:
    """The smallest size a linked partner may have."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _hash_prefix(tokens: Column, seed: int, percent: int) -> Column:
    """The prefix under the order of another hash."""
    first = F.slice(F.sort_array(F.transform(tokens, lambda x: F.xxhash64(x, F.lit(seed)))), 1, _prefix(F.size(tokens), percent))
    return F.transform(first, lambda x: F.pmod(x, F.lit(1 << 31)).cast("int"))  # half the bytes; rare clashes only let pairs pass


def _parity(tokens: Column) -> list[Column]:
    """The set's parity bitmap in words of 64 bits."""
    def word(k: int) -> Column:
        mine = F.filter(tokens, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(PARITY_WORDS - 1)) == k)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))))

    return [word(k).alias(name) for k, name in enumerate(PARITY)]


def _close(n: Column, m: Column, bits: list[Column], others: list[Column], percent: int) -> Column:
    """Sizes and bitmaps allow a link."""
    differ = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(bits[1:], others[1:], strict=True)), F.bit_count(bits[0].bitwiseXOR(others[0])))
    return _sizes_fit(n, m, percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per document: set size, the set's hash as its node, and the longer prefix of order one."""
    rows = docs.select("doc_id", shingle_set(whole("text"), width).alias("s"))
    n = F.size("s")
    ext = F.slice("s", 1, F.greatest(_longer(n, percent), F.lit(0)))
    return durable(rows.select("doc_id", n.alias("n"), F.xxhash64("s").alias("node"), ext.alias("ext")))


def _kept_tokens(rows: DataFrame, percent: int) -> DataFrame:
    """(tok, node, n, own): the rarest tokens of each node's longer prefix that another node has too.

    Nodes are counted, so copies are one: any count of a token serves as a global order.
    """
    nodes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("ext").alias("ext"))
    tokens = nodes.select("node", F.explode("ext").alias("tok"))
    # counted where they lie: a join with the counts would shuffle every token twice
    found = tokens.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("tok"))).where("df > 1")
    sizes = nodes.select("node", "n")
    least_shared = _promised(_needed(F.col("n"), percent), percent)  # with the smallest partner
    longer = _longer(F.col("n"), percent)
    by = W.partitionBy("node")
    counted = found.join(sizes, "node").withColumn("own", longer - F.count(F.lit(1)).over(by)).withColumn("rank", F.row_number().over(by.orderBy("df", "tok")))
    kept = durable(counted.where(F.col("rank") + F.col("own") <= longer - least_shared + 1).select("tok", "node", "n", "own"))
    several = kept.groupBy("tok").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("tok")
    return kept.join(several, "tok")


def _maybe(docs: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``docs`` without most rows whose key hash is not in ``wanted`` (one bigint column ``h``), before any shuffle.

    A bitmap of fixed size, at most ``BITMAP_ROWS`` rows of 64 bits, is broadcast; where it is full
    nothing is saved, and rows that pass by chance must be removed by a join.
    """
    place = F.pmod(key, F.lit(64 * BITMAP_ROWS))
    bits = wanted.select(F.pmod("h", F.lit(64 * BITMAP_ROWS)).alias("h")).groupBy(F.shiftright("h", 6).alias("_hi")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("_bits")
    )
    at = docs.withColumn("_place", place)
    met = at.join(F.broadcast(bits), F.shiftright("_place", 6) == F.col("_hi"))
    return met.where(F.expr("getbit(_bits, cast(_place & 63 as int)) = 1")).select(*docs.columns)


class _Texts:
    """The sets of wanted nodes, each made anew from one text that has it: sets are long and few are ever compared."""

    def __init__(self, docs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs.select("doc_id", "text"), width, percent
        self.holders = written(rows.select("doc_id", "node").join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")))

    def of(self, nodes: DataFrame | None = None) -> DataFrame:
        """(node, s) of the nodes, or of all; a node may come more than once."""
        held = self.holders if nodes is None else written(self.holders.join(nodes, "node"))
        hashed = F.xxhash64("doc_id")
        texts = _maybe(self.docs, hashed, held.select(hashed.alias("h")))
        full = texts.select("doc_id", shingle_set(whole("text"), self.width).alias("s")).withColumn("node", F.xxhash64("s"))
        met = full.join(held.select("node", F.col("doc_id").alias("_holder")), "node")
        return met.where(F.col("doc_id").eqNullSafe(F.col("_holder"))).select("node", "s")

    def bitmaps(self) -> DataFrame:
        return self.of().select("node", *_parity(F.col("s"))).dropDuplicates(["node"])

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, s, p3, p4), once per node."""
        other = [_hash_prefix(F.col("s"), seed, self.percent).alias(f"p{seed}") for seed in (3, 4)]
        return durable(self.of(nodes).dropDuplicates(["node"]).select("node", "s", *other))


def _sets_of(pairs: DataFrame, texts: _Texts) -> DataFrame:
    return texts.sets(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct())


def _verified(pairs: DataFrame, texts: _Texts) -> DataFrame:
    """The pairs (a, b) of classes (ca, cb) that share prefix tokens under the other orders and whose sets link."""
    pairs = written(pairs)
    return _linked(pairs, _sets_of(pairs, texts), texts.percent)


def _connecting(pairs: DataFrame, texts: _Texts) -> DataFrame:
    """Links among the pairs (a, b) that connect the classes (ca, cb) which any of them links.

    Two classes often meet in many pairs. A few of these are compared first, then more of what still lies in
    different classes, at last all that does; a pair left out lies in one class and could connect nothing more.
    """
    left = written(pairs)
    sets, links = _sets_of(left, texts), []
    classes = W.partitionBy("ca", "cb").orderBy(F.xxhash64("a", "b"), "a", "b")
    for few in FEW:
        some = written(left.withColumn("_nth", F.row_number().over(classes)).where(F.col("_nth") <= few).drop("_nth"))
        found = _linked(some, sets, texts.percent)
        links.append(found)
        roots = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        left = left.join(some.select("a", "b"), ["a", "b"], "left_anti")
        for side in ("ca", "cb"):
            moved = left.join(roots.select(F.col("node").alias(side), F.col("root").alias("_root")), side, "left")
            left = moved.withColumn(side, F.coalesce("_root", side)).drop("_root")
        left = written(left.where("ca <> cb").select("a", "b", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")))
    links.append(_linked(left, sets, texts.percent))
    return reduce(DataFrame.unionAll, links)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    filters = sets.select("node", "p3", "p4")
    for side in ("a", "b"):
        pairs = pairs.join(filters.select(F.col("node").alias(side), F.col("p3").alias(f"{side}3"), F.col("p4").alias(f"{side}4")), side)
    pairs = pairs.where(F.arrays_overlap("a3", "b3") & F.arrays_overlap("a4", "b4")).select("a", "b", "ca", "cb")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("s").alias(f"s{side}")), side)
    common = F.size(F.array_intersect("sa", "sb"))
    linked = common * 100 >= (F.size("sa") + F.size("sb") - common) * percent
    return written(pairs.where(linked).select("a", "b", "ca", "cb"))


def _merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """The tokens' rows with classes after the links between them."""
    roots = neighbourhoods(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = state.join(roots.withColumnRenamed("node", "comp"), "comp", "left")
    return stored(moved.select("tok", "node", "n", "own", *PARITY, F.coalesce("root", "comp").alias("comp")))


def _pairs(met: DataFrame, other: str, other_class: str) -> DataFrame:
    """Distinct unordered pairs of nodes (a, b) and their classes (ca, cb)."""
    return met.select(
        F.least("node", other).alias("a"), F.greatest("node", other).alias("b"), F.least("comp", other_class).alias("ca"), F.greatest("comp", other_class).alias("cb")
    ).distinct()


def _leader_pairs(state: DataFrame, round_no: int, percent: int) -> DataFrame:
    here = F.struct("node", "n", "comp", *PARITY)
    by_hash = F.xxhash64("node", F.lit(round_no))
    if round_no == 0:
        # the node with the smallest share of tokens of its own is the most central copy
        chosen = [F.min_by(here, F.struct((F.col("own") / F.col("n")).alias("x"), by_hash.alias("y")))]
    else:
        ends = F.struct(F.col("comp").alias("x"), by_hash.alias("y"))
        chosen = [F.min_by(here, ends), F.max_by(here, ends), F.min_by(here, by_hash)]
    leaders = state.groupBy("tok").agg(*[c.alias(f"l{k}") for k, c in enumerate(chosen)], F.min("comp").alias("_low"), F.max("comp").alias("_high"))
    leaders = leaders.where("_low <> _high")  # a token of one class brings nothing
    met = state.join(leaders, "tok").select(
        "node", "n", "comp", *PARITY, F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(len(chosen))]))).alias("l")
    )
    fits = (F.col("comp") != F.col("l.comp")) & _close(F.col("n"), F.col("l.n"), [F.col(b) for b in PARITY], [F.col(f"l.{b}") for b in PARITY], percent)
    return _pairs(met.where(fits), "l.node", "l.comp")


def _rest_pairs(state: DataFrame, percent: int) -> DataFrame:
    """Every pair of different classes that shares a token: one side is outside the token's largest class.

    At tokens with ``MANY`` such nodes a pair comes out at the first of them that both have.
    """
    sizes = state.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("m"))
    most = sizes.groupBy("tok").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), (F.sum("m") - F.max("m")).alias("outside")).where("outside > 0")
    several = stored(state.join(most, "tok").withColumn("many", F.col("outside") >= MANY).drop("own", "outside"))
    crowded = several.where("many")
    mine = crowded.groupBy("node").agg(F.sort_array(F.collect_set("tok")).alias("toks"))
    return _met(several.where("NOT many").drop("many"), None, percent).unionAll(_met(crowded.drop("many").join(mine, "node"), "toks", percent)).distinct()


def _met(several: DataFrame, listed: str | None, percent: int) -> DataFrame:
    renamed = {"node": "x", "n": "nx", "comp": "cx", "main": "mainx", **{b: f"x{b}" for b in PARITY}}
    few = several.where("comp <> main").withColumnsRenamed(renamed | ({listed: "listx"} if listed else {}))
    fits = (F.col("comp") != F.col("cx")) & _close(F.col("n"), F.col("nx"), [F.col(b) for b in PARITY], [F.col(f"x{b}") for b in PARITY], percent)
    # of two sides outside the largest class one order is enough
    fits = fits & ((F.col("comp") == F.col("main")) | (F.col("node") < F.col("x")))
    if listed:
        fits = fits & (F.array_min(F.array_intersect(listed, "listx")) == F.col("tok"))
    return _pairs(several.join(few, "tok").where(fits), "x", "cx")


def ngram_jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document, from columns ``doc_id`` and ``text``.

    Null or empty texts have no shingles and link with nothing; copies share a node; equal ids of
    different texts keep a row each; a null id stays null, and so does the component of nulls alone.
    An empty table gives an empty one; other columns are ignored. Texts are never cut.
    """
    rows = _sets(docs, width, percent)
    kept = _kept_tokens(rows, percent)
    state = kept.select("tok", "node", "n", "own", F.col("node").alias("comp"))

    texts = _Texts(docs, rows, state.select("node").distinct(), width, percent)
    state = stored(state.join(texts.bitmaps(), "node"))

    links = _verified(_leader_pairs(state, 0, percent), texts)
    found, step = links, 1
    while step < ROUNDS and not found.isEmpty():
        state = _merged(state, found)
        found = _verified(_leader_pairs(state, step, percent), texts)
        links, step = links.unionAll(found), step + 1
    state = state if found.isEmpty() else _merged(state, found)
    links = links.unionAll(_connecting(_rest_pairs(state, percent), texts))

    comp = components(links).withColumnRenamed("root", "comp")
    placed = durable(rows.select("doc_id", "n", "node").join(comp, "node", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("comp")))
    smallest = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "comp", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_per_group(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """The documents without their near duplicates: each component keeps its smallest (id, text hash), once.

    Rows are told apart by id and text, so different texts of one id are judged singly and null ids,
    which come last, take part. Rows of equal id and text are one; documents without words are no near
    duplicates and all stay. Columns are those of ``docs``.
    """
    mark = free_name(docs.columns, "_key")
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    found = ngram_jaccard_join(docs.select(key.alias("doc_id"), "text"), width, percent)
    # a component of one key needs no choice; the others are known by members that are not its smallest key
    several = durable(found.where("component_id <> doc_id").select(F.col("component_id").alias("comp"), F.col("doc_id").alias("k")).distinct())
    members = several.unionAll(several.select("comp", F.col("comp").alias("k")).distinct())
    ids = docs.select(key.alias("k"), "doc_id").distinct()
    placed = durable(members.join(ids, "k"))
    best = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")).alias("best"))
    gone = placed.join(best, "comp").where("k <> best.k").select(F.col("k").alias("_gone")).distinct()
    marked = docs.withColumn(mark, key)
    left = marked.join(gone, marked[mark] == gone["_gone"], "left_anti").drop(mark)
    return left.dropDuplicates(["doc_id", "text"])
