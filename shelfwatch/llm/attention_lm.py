"""Language-model scores from a small causal self-attention model, trained in numpy on subword ids.

Words (ASCII A-Z lowered) become subword ids of a public tokenizer. The probability of a subword is

    P(class | context) * P(subword | class, subword before it)

The first factor is a one-layer causal self-attention network over the last subwords. The second is
counted over the whole training corpus: Spark groups its words, each distinct word is segmented once,
and subword and pair counts are weighted sums over the word counts. Both are proper distributions, so
the score is the log10 probability of the text's subwords and its end.

Training: the windows of every training text cover all its subwords and its end, each predicted once;
each partition runs Adam over its own windows, mixed among neighbouring texts, and the weights are averaged by
grouped aggregation. Scoring: overlapping windows of ``CONTEXT + SPAN`` subwords, of which the last
``SPAN`` are scored, so each subword is scored once, with batched masked attention.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import durable

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLOTS = 4096  # most frequent subwords with a slot each; the last slots are: rare, begin, end
CLASSES, ALONE, GROUPS = 128, 40, 512
DIM, HIDDEN, CONTEXT, SPAN = 16, 32, 16, 16
BATCH, RATE, MIXED = 128, 0.01, 1 << 16  # windows of so many subwords, or of one longer text, are mixed
FREQUENT = 100_000  # words whose counts every task holds; the others are joined
CACHE_WORDS, CHUNK = 400_000, 128
BLOCK = 128  # rows that BLAS multiplies without packing them
RARE, BEGIN, END = SLOTS - 3, SLOTS - 2, SLOTS - 1
_WIDTH = CONTEXT + SPAN


class Segmenter:
    """Subword ids of words, each as it stands after a space."""

    def __init__(self, ranks: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(table.values()) + 1
        self.first = np.zeros(self.size, dtype=bool)
        self.first[[i for b, i in table.items() if b.startswith(b" ")]] = True
        self.ids = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __call__(self, word: bytes) -> list[int]:
        return self.ids(" " + word.decode("utf-8", "replace"))


@cache
def segmenter(ranks: str) -> Segmenter:
    """The one of this process: a worker reads the tokenizer's file once, not once per task."""
    return Segmenter(ranks)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lowered; a null text has none."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over the whole texts."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(split_words(text))
            if len(seen) > CACHE_WORDS:
                yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                seen = Counter()
        yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    return train.select("text").mapInPandas(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _subword_counts(counts: DataFrame, ranks: str) -> pd.DataFrame:
    """(id, n): at most as many rows as the tokenizer has ids."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = segmenter(ranks)
        total = np.zeros(cut.size, dtype=np.int64)
        for batch in batches:
            for word, n in zip(batch["word"], batch["n"], strict=True):
                for i in cut(word):
                    total[i] += n
        at = total.nonzero()[0]
        yield pd.DataFrame({"id": at, "n": total[at]})

    return counts.mapInPandas(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()


def _pair_counts(counts: DataFrame, ranks: str, slot_of: np.ndarray) -> pd.DataFrame:
    """(before, slot, n) of subwords within words, at most SLOTS squared rows."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = segmenter(ranks)
        total: Counter = Counter()
        for batch in batches:
            for word, n in zip(batch["word"], batch["n"], strict=True):
                slots = slot_of[cut(word)].tolist()
                for pair in zip(slots, slots[1:], strict=False):
                    total[pair] += n
        yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["before", "slot", "n"])

    return counts.mapInPandas(count, "before int, slot int, n bigint").groupBy("before", "slot").agg(F.sum("n").alias("n")).toPandas()


class Lexicon:
    """Slots, classes and the counted factor of the model."""

    def __init__(self, subwords: pd.DataFrame, size: int, first: np.ndarray, n_docs: int):
        n = np.zeros(size, dtype=np.float64)
        n[subwords["id"]] = subwords["n"]
        top = np.argsort(-n, kind="stable")[: SLOTS - 3]
        self.slot_of = np.full(size, RARE, dtype=np.int32)
        self.slot_of[top] = np.arange(len(top))
        in_rare = self.slot_of == RARE
        self.n = np.zeros(SLOTS)
        np.add.at(self.n, self.slot_of, n)
        self.n[END] = n_docs
        # the share of an id within its slot; rare ids are smoothed
        self.inside = np.zeros(size, dtype=np.float32)
        rare = n[in_rare] + 0.5
        self.inside[in_rare] = np.log(rare / rare.sum())
        self.opens = np.zeros(SLOTS, dtype=bool)
        self.opens[: len(top)] = first[top]
        self.opens[[BEGIN, END]] = True

    def with_pairs(self, pairs: pd.DataFrame) -> Lexicon:
        table = np.zeros((SLOTS, SLOTS), dtype=np.float32)
        table[pairs["before"], pairs["slot"]] = pairs["n"]
        base = (self.n + 0.5) / (self.n + 0.5).sum()
        base[BEGIN] = 1e-12
        order = np.argsort(-self.n[:RARE], kind="stable")
        self.group = 1 + (np.arange(SLOTS) * 7919 % (GROUPS - 1)).astype(np.int32)
        self.group[order[: GROUPS - 1]] = 1 + np.arange(min(GROUPS - 1, len(order)))
        # classes: frequent subwords alone, the others in bins of like neighbours and equal mass
        near = np.log1p(np.vstack([table[order[:256]], table[:, order[:256]].T])).T
        axis = np.linalg.svd(near - near.mean(axis=0), full_matrices=False)[0][:, 0]
        self.cls = np.zeros(SLOTS, dtype=np.int32)
        half = CLASSES // 2
        for kind in (0, 1):
            mine = np.flatnonzero(self.opens == bool(kind))
            mine = mine[np.argsort(-base[mine], kind="stable")]
            self.cls[mine[:ALONE]] = kind * half + np.arange(min(ALONE, len(mine)))
            rest = mine[ALONE:]
            rest = rest[np.argsort(axis[rest], kind="stable")]
            if len(rest):
                share = np.cumsum(base[rest]) / base[rest].sum()
                self.cls[rest] = kind * half + ALONE + np.minimum((share * (half - ALONE)).astype(int), half - ALONE - 1)
        # P(slot | class, group of the slot before); row 0 is for subwords that open a word
        by_group = np.zeros((GROUPS, SLOTS), dtype=np.float64)
        np.add.at(by_group, self.group, table)
        by_group[0] = 0
        by_group[:, self.opens] = 0
        by_group += 20 * base
        by_class = np.zeros((GROUPS, CLASSES))
        np.add.at(by_class.T, self.cls, by_group.T)
        self.cond = np.log(by_group / by_class[:, self.cls]).astype(np.float32)
        return self


def initial_weights(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"E": (SLOTS, DIM), "Wq": (DIM, DIM), "Wk": (DIM, DIM), "Wv": (DIM, HIDDEN), "Wr": (DIM, HIDDEN), "b": (HIDDEN,), "U": (HIDDEN, CLASSES), "c": (CLASSES,), "near": (_WIDTH,)}
    return {k: (rng.normal(0, 0.5 if k == "E" else 1 / np.sqrt(s[0]) if len(s) == 2 else 0.0, s)).astype(np.float32) for k, s in shapes.items()}


# query i stands at position CONTEXT - 1 + i and sees the positions up to its own; nobody sees the last position
_AWAY = (np.arange(SPAN)[:, None] + CONTEXT - 1) - np.arange(_WIDTH)[None, :]
_SEEN = (_AWAY >= 0).astype(np.float32)
_NEAR = np.maximum(_AWAY, 0)
_QUERIES = slice(CONTEXT - 1, CONTEXT - 1 + SPAN)
SAFE = 60  # exp of single floats overflows at 88
PER_E = float(np.log2(np.e))  # exp2 of single floats takes half the time of exp


class Room(dict):
    """Arrays that one step after another fills again; fresh ones would be mapped and unmapped at every step."""

    def __init__(self, dtype: np.dtype):
        super().__init__()
        self.dtype = np.dtype(dtype)

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or self[name].size < size:
            self[name] = np.empty(size, dtype=self.dtype)
        return self[name][:size].reshape(shape)


def _times(x: np.ndarray, y: np.ndarray, out: np.ndarray, rows: int) -> None:
    """``x @ y`` by blocks of so many rows, which BLAS multiplies without packing them."""
    np.matmul(x.reshape(-1, rows, x.shape[1]), y, out=out.reshape(-1, rows, y.shape[1]))


def _crossed(x: np.ndarray, y: np.ndarray, room: Room) -> np.ndarray:
    """``x.T @ y`` as the sum over blocks of 128 rows and the rows left."""
    blocks = len(x) // BLOCK
    whole = blocks * BLOCK
    each = room("crossed", blocks + 1, y.shape[1], x.shape[1])
    np.matmul(y[:whole].reshape(blocks, BLOCK, y.shape[1]).transpose(0, 2, 1), x[:whole].reshape(blocks, BLOCK, x.shape[1]), out=each[:blocks])
    np.matmul(y[whole:].T, x[whole:], out=each[blocks])
    return (np.ones(blocks + 1, dtype=each.dtype) @ each.reshape(blocks + 1, -1)).reshape(each.shape[1:]).T


def _weights_of(scores: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Turns scores into attention weights in place, each row up to a factor; returns the rows' sums."""
    if max(scores.max(), -scores.min()) + np.abs(near).max() <= SAFE:
        np.exp(scores, out=scores)
        scores *= np.exp(near[_NEAR]) * _SEEN
    else:
        scores += near[_NEAR]
        scores -= scores.max(axis=2, keepdims=True, where=_SEEN > 0, initial=-np.inf)
        scores *= _SEEN
        np.exp(scores, out=scores)
        scores *= _SEEN
    return scores.reshape(-1, _WIDTH) @ np.ones(_WIDTH, dtype=scores.dtype)


def _by_slot(ids: np.ndarray, rows: np.ndarray, room: Room) -> np.ndarray:
    """The sum of the rows of each slot."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    out = room("by slot", SLOTS, rows.shape[1])
    out[...] = 0
    out[ids[starts]] = np.add.reduceat(np.take(rows, order, axis=0, out=room("sorted", *rows.shape), mode="clip"), starts, axis=0)
    return out


def _classes(w: dict[str, np.ndarray], h: np.ndarray, goal: np.ndarray, lives: np.ndarray, dh: np.ndarray, room: Room) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of the classes; ``dh`` takes the gradient before the tanh that gave ``h``.

    exp(h U + c) is taken as exp(h U) exp(c), and the factors of rows and columns go into the narrower
    arrays, so that the wide one is passed as seldom as can be.
    """
    d = room("d", len(h), CLASSES)
    _times(h, w["U"] * PER_E, d, SPAN)
    if np.abs(w["U"]).sum(axis=0).max() + np.abs(w["c"]).max() <= SAFE:  # hidden units lie between -1 and 1
        push = np.exp(w["c"])
    else:
        push = np.ones_like(w["c"])
        d += w["c"] * PER_E
        d -= d.max(axis=1, keepdims=True)
    np.exp2(d, out=d)
    sums, n = d @ push, max(lives.sum(), 1)
    cells, of_goal = np.arange(0, d.size, CLASSES) + goal, push[goal]
    picked = d.reshape(-1)[cells]
    loss = -(np.log(picked * of_goal / sums + 1e-20) * lives).sum() / n
    # the gradient of the logits, without the factors, takes the place of the probabilities
    d.reshape(-1)[cells] = picked - sums / of_goal
    weight = (lives / (sums * np.float32(n))).astype(d.dtype)
    weighed = np.multiply(h, weight[:, None], out=room("weighed", *h.shape))
    g = {"U": _crossed(weighed, d, room) * push, "c": weight @ d * push}
    _times(d, np.ascontiguousarray((w["U"] * push).T), dh, SPAN)
    weighed *= h
    np.subtract(weight[:, None], weighed, out=weighed)
    dh *= weighed
    return float(loss), g


def train_step(w: dict[str, np.ndarray], windows: np.ndarray, targets: np.ndarray, live: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients for windows of slots (B, width), target classes (B, SPAN) and which of them count."""
    room = Room(w["E"].dtype) if room is None else room
    size = len(windows)
    ids = windows.ravel().astype(np.int64)
    scale = np.float32(1 / np.sqrt(DIM))
    from_e, from_query = np.hstack([w["Wk"], w["Wv"]]), np.hstack([w["Wq"] * scale, w["Wr"]])
    # products with weights take all windows at once; keys stand beside values, queries beside what h adds
    e = np.take(w["E"], ids, axis=0, out=room("e", len(ids), DIM), mode="clip")
    eq = room("eq", size, SPAN, DIM)
    eq[...] = e.reshape(size, _WIDTH, DIM)[:, _QUERIES]
    eq = eq.reshape(-1, DIM)
    flat_kv, flat_qr = room("kv", len(ids), DIM + HIDDEN), room("qr", len(eq), DIM + HIDDEN)
    _times(e, from_e, flat_kv, _WIDTH)
    _times(eq, from_query, flat_qr, SPAN)
    kv, q = flat_kv.reshape(size, _WIDTH, -1), flat_qr.reshape(size, SPAN, -1)[..., :DIM]
    k, v = kv[..., :DIM], kv[..., DIM:]
    # a is up to the factor 1 / its row's sum, which goes into the narrower arrays
    a = np.matmul(q, k.transpose(0, 2, 1), out=room("a", size, SPAN, _WIDTH))
    shrink = (1 / _weights_of(a, w["near"]))[:, None]
    mixed = np.matmul(a, v, out=room("mixed", size, SPAN, HIDDEN)).reshape(-1, HIDDEN)
    mixed *= shrink
    h = np.add(flat_qr[:, DIM:], w["b"], out=room("h", len(eq), HIDDEN))
    h += mixed
    np.tanh(h, out=h)
    flat_dqr, dh = room("dqr", *flat_qr.shape), room("dh", *h.shape)
    loss, g = _classes(w, h, targets.ravel().astype(np.int64), live.ravel(), dh, room)
    flat_dqr[:, DIM:] = dh
    g["b"] = np.ones(len(dh), dtype=dh.dtype) @ dh
    along = np.einsum("ij,ij->i", dh, mixed)[:, None] * shrink
    dh *= shrink
    by_window, dkv = dh.reshape(size, SPAN, HIDDEN), room("dkv", *kv.shape)
    np.matmul(a.transpose(0, 2, 1), by_window, out=dkv[..., DIM:])
    ds = np.matmul(by_window, v.transpose(0, 2, 1), out=room("ds", *a.shape))
    ds -= along.reshape(size, SPAN, 1)
    ds *= a
    by_place = np.ones(size, dtype=ds.dtype) @ ds.reshape(size, -1)
    g["near"] = np.bincount(_NEAR.ravel(), by_place * _SEEN.ravel(), minlength=_WIDTH).astype(ds.dtype)
    np.matmul(ds, k, out=flat_dqr.reshape(size, SPAN, -1)[..., :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :DIM])
    flat_dkv = dkv.reshape(flat_kv.shape)
    of_e, of_query = _crossed(e, flat_dkv, room), _crossed(eq, flat_dqr, room)
    g["Wk"], g["Wv"], g["Wq"], g["Wr"] = of_e[:, :DIM], of_e[:, DIM:], of_query[:, :DIM] * scale, of_query[:, DIM:]
    moved, at_query = room("moved", *e.shape), room("at query", *eq.shape)
    _times(flat_dkv, np.ascontiguousarray(from_e.T), moved, _WIDTH)
    _times(flat_dqr, np.ascontiguousarray(from_query.T), at_query, SPAN)
    moved.reshape(size, _WIDTH, DIM)[:, _QUERIES] += at_query.reshape(size, SPAN, DIM)
    g["E"] = _by_slot(ids, moved, room)
    return loss, g


class Adam:
    """The moments are kept without their factors 0.1 and 0.01; all weights lie in one array."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.flat = np.concatenate([x.ravel() for x in weights.values()])
        ends = np.cumsum([x.size for x in weights.values()])
        self.w = {k: part.reshape(x.shape) for (k, x), part in zip(weights.items(), np.split(self.flat, ends[:-1]), strict=True)}
        self.t = 0
        self.m, self.v, self.g, self.by = (np.zeros_like(self.flat) for _ in range(4))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = float(RATE / np.sqrt(1 + self.t / 200) * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))  # weights stay single
        np.concatenate([g[k].ravel() for k in self.w], out=self.g)
        m, v, x, by = self.m, self.v, self.g, self.by
        m *= 0.9
        m += x
        v *= 0.99
        x *= x
        v += x
        np.sqrt(v, out=by)
        by += 1e-7
        np.divide(m, by, out=by)
        by *= rate
        self.flat -= by


def windows_of(slots: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, width) over texts laid end to end, and which of their last SPAN positions hold a subword."""
    spans = -(-lengths // SPAN)
    room = CONTEXT + spans * SPAN
    starts = np.concatenate([[0], np.cumsum(room)[:-1]])
    flat = np.full(int(room.sum()), BEGIN, dtype=np.int32)
    used = np.zeros(len(flat), dtype=bool)
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(slots)) + np.repeat(starts + CONTEXT - offset, lengths)
    flat[place], used[place] = slots, True
    first = np.repeat(starts - SPAN * np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + SPAN * np.arange(int(spans.sum()))
    return flat[first[:, None] + np.arange(_WIDTH)], used[first[:, None] + np.arange(CONTEXT, _WIDTH)]


def _trained(train: DataFrame, lexicon: Lexicon, ranks: str) -> dict[str, np.ndarray]:
    """Average of the partitions' weights by the windows they saw."""
    spark, start = train.sparkSession, initial_weights()
    base = np.bincount(lexicon.cls, weights=lexicon.n + 0.5, minlength=CLASSES) + 1e-3
    start["c"] = np.log(base / base.sum()).astype(np.float32)
    shared = spark.sparkContext.broadcast((lexicon.slot_of, lexicon.cls, start))
    sizes = {k: v.size for k, v in start.items()}

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot_of, cls, first = shared.value
        adam, seen = fitted((text for batch in batches for text in batch["text"]), segmenter(ranks), slot_of, cls, first)
        if seen:
            flat = np.concatenate([adam.w[k].ravel() for k in sorted(adam.w)]).astype(np.float64) * seen
            yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat, "n": seen})

    parts = train.select("text").mapInPandas(fit, "i int, x double, n bigint")
    mean = parts.groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    if not len(mean):
        return start
    out, at = {}, 0
    for k in sorted(start):
        out[k] = mean[at : at + sizes[k]].reshape(start[k].shape).astype(np.float32)
        at += sizes[k]
    return out


class _SlotsOf(dict):
    """Word -> its slots as bytes, found when first asked for; a text is then one joining of bytes."""

    def __init__(self, segment: Segmenter, slot_of: np.ndarray):
        super().__init__()
        self.segment, self.slot_of = segment, slot_of.tolist()

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = array("i", map(self.slot_of.__getitem__, self.segment(word))).tobytes()
        return found


def fitted(texts: Iterable[str | None], segment: Segmenter, slot_of: np.ndarray, cls: np.ndarray, first: dict[str, np.ndarray]) -> tuple[Adam, int]:
    """The network after all windows of whole texts, and how many subwords and ends it predicted."""
    adam, rng, room, held, size, seen = Adam(first), np.random.default_rng(3), Room(first["E"].dtype), [], 0, 0
    known = _SlotsOf(segment, slot_of)
    end = np.array([END], dtype=np.int32).tobytes()
    for text in texts:
        if len(known) > CACHE_WORDS:
            known.clear()
        held.append(np.frombuffer(b"".join(map(known.__getitem__, split_words(text))) + end, dtype=np.int32))
        size += len(held[-1])
        if size >= MIXED:
            seen += _update(adam, held, cls, rng, room)
            held, size = [], 0
    if held:
        seen += _update(adam, held, cls, rng, room)
    return adam, seen


def _update(adam: Adam, texts: list[np.ndarray], cls: np.ndarray, rng: np.random.Generator, room: Room) -> int:
    windows, live = windows_of(np.concatenate(texts), np.array([len(t) for t in texts]))
    order = rng.permutation(len(windows))  # windows of one text are alike
    for a in range(0, len(windows), BATCH):
        at = order[a : a + BATCH]
        part = windows[at]
        _, g = train_step(adam.w, part, cls[part[:, CONTEXT:]], live[at], room)
        adam.step(g)
    return int(live.sum())


class Scorer:
    """Log probabilities of slot sequences: per-slot tables, then only gathers and batched products."""

    def __init__(self, w: dict[str, np.ndarray], lexicon: tuple[np.ndarray, ...]):
        self.cls, self.group, self.opens, self.cond = lexicon
        self.from_query = np.hstack([w["E"] @ w["Wq"] / np.float32(np.sqrt(DIM)), w["E"] @ w["Wr"] + w["b"]])
        self.from_e = np.hstack([w["E"] @ w["Wk"], w["E"] @ w["Wv"]])
        self.near, self.u, self.c = w["near"], w["U"] * PER_E, w["c"] * PER_E
        self.safe = np.abs(w["c"]).max() + np.abs(w["U"]).sum(axis=0).max() <= SAFE
        self.push = np.exp(w["c"]) if self.safe else np.ones_like(self.c)
        self.room = Room(self.u.dtype)

    def __call__(self, slots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The natural log probability of each subword slot."""
        windows, live = windows_of(slots, lengths)
        out = np.empty(live.shape, dtype=np.float32)
        for a in range(0, len(windows), CHUNK):
            part = windows[a : a + CHUNK].astype(np.int64)
            size, at, goal = len(part), part[:, _QUERIES].ravel(), part[:, CONTEXT:].ravel()
            kv = np.take(self.from_e, part.ravel(), axis=0, out=self.room("kv", part.size, DIM + HIDDEN), mode="clip").reshape(size, _WIDTH, -1)
            qr = np.take(self.from_query, at, axis=0, out=self.room("qr", len(at), DIM + HIDDEN), mode="clip")
            q = qr.reshape(size, SPAN, -1)[..., :DIM]
            scores = np.matmul(q, kv[..., :DIM].transpose(0, 2, 1), out=self.room("a", size, SPAN, _WIDTH))
            sums = _weights_of(scores, self.near)
            hidden = np.matmul(scores, kv[..., DIM:], out=self.room("mixed", size, SPAN, HIDDEN)).reshape(-1, HIDDEN)
            hidden /= sums[:, None]
            hidden += qr[:, DIM:]
            np.tanh(hidden, out=hidden)
            logits = self.room("d", len(at), CLASSES)
            _times(hidden, self.u, logits, SPAN)
            if not self.safe:
                logits += self.c
                logits -= logits.max(axis=1, keepdims=True)
            of_goal = self.cls[goal]
            chosen = logits.reshape(-1)[np.arange(0, logits.size, CLASSES) + of_goal]
            np.exp2(logits, out=logits)
            before = np.where(self.opens[goal], 0, self.group[at])
            out[a : a + CHUNK] = (chosen / np.float32(PER_E) + np.log(self.push[of_goal] / (logits @ self.push)) + self.cond[before, goal]).reshape(-1, SPAN)
        return out[live]


class Words(dict):
    """Word -> its number in a task; counts and subwords of the numbers lie in arrays that grow."""

    def __init__(self, segment: Segmenter, counts_of: dict[bytes, int]):
        super().__init__()
        self.segment, self.counts_of, self.spelled = segment, counts_of, []
        self.count, self.begin, self.n_pieces, self.pieces = array("q"), array("q"), array("q"), array("i")

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.spelled)
        ids = self.segment(word)
        self.spelled.append(word)
        self.count.append(self.counts_of.get(word, -1))
        self.begin.append(len(self.pieces))
        self.n_pieces.append(len(ids))
        self.pieces.extend(ids)
        return number

    def told(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word its count (-1: not among the frequent) and how many subwords it has; the ids of all of them."""
        if not len(numbers):
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        # views, gone before the arrays grow again
        count, begin, n_pieces = (np.frombuffer(x, dtype=np.int64)[numbers] for x in (self.count, self.begin, self.n_pieces))
        where = np.arange(n_pieces.sum()) + np.repeat(begin - (np.cumsum(n_pieces) - n_pieces), n_pieces)
        return count, n_pieces, np.frombuffer(self.pieces, dtype=np.int32)[where]


def lm_scores(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document of ``doc_id, text``.

    Documents whose crc32 of the id (a null id: the text "None") leaves 1 modulo 5 are held out; the
    others train. ``base_score`` is the smoothed unigram score of the words and the end, ``score`` the
    model's; both are log10. A null or empty text is the end alone. Equal rows get equal scores. With
    no training rows all counts are 0 and the network is untrained. An empty table gives none. Other
    columns are ignored. Texts are scored whole, in windows. ``ranks`` names the tokenizer's file.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))
    train = docs.where(F.crc32(name.cast("binary")) % 5 != 1)
    counts = durable(word_counts(train))
    n_docs = train.count()
    words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = words.n + n_docs, words.v + (n_docs > 0)
    known = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    frequent = dict(zip(known["word"].map(bytes), known["n"].tolist(), strict=True))
    complete = len(frequent) == words.v
    cut = segmenter(ranks)
    lexicon = Lexicon(_subword_counts(counts, ranks), cut.size, cut.first, n_docs)
    lexicon.with_pairs(_pair_counts(counts, ranks, lexicon.slot_of))
    weights = _trained(train, lexicon, ranks)
    shared = spark.sparkContext.broadcast((frequent, lexicon.slot_of, lexicon.inside, (lexicon.cls, lexicon.group, lexicon.opens, lexicon.cond), weights))
    floor = total + 0.5 * (distinct + 1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts_of, slot_of, inside, tables, w = shared.value
        scorer, known = Scorer(w, tables), Words(segmenter(ranks), counts_of)
        for batch in batches:
            for a in range(0, len(batch), 128):  # bounds the arrays, not the texts
                part = batch.iloc[a : a + 128]
                if len(known) > CACHE_WORDS:
                    known = Words(known.segment, counts_of)
                each = [split_words(t) for t in part["text"]]
                n_words, texts = np.array([len(ws) for ws in each]), np.arange(len(each))
                text_of = np.repeat(texts, n_words)
                numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(each)), dtype=np.int64, count=len(text_of))
                c, n_pieces, ids = known.told(numbers)
                text_of_id = np.repeat(text_of, n_pieces)
                lengths = np.bincount(text_of_id, minlength=len(each)) + 1
                slots = np.full(lengths.sum(), END, dtype=np.int32)
                slots[np.arange(len(ids)) + text_of_id] = slot_of[ids]  # an end stands behind each text before
                sums = np.add.reduceat(scorer(slots, lengths).astype(np.float64), np.cumsum(lengths) - lengths)
                sums += np.bincount(text_of_id, inside[ids], minlength=len(each))
                have = c >= 0
                logs = np.where(have, np.log10((np.maximum(c, 0) + 0.5) / floor), np.log10(0.5 / floor) if complete else 0.0)
                to = np.cumsum(np.bincount(text_of, ~have, minlength=len(each))).astype(np.int64).tolist()
                rare = [] if complete else [known.spelled[i] for i in numbers[~have].tolist()]
                yield pd.DataFrame({
                    "n_tokens": n_words + 1, "n_seen": np.bincount(text_of, have, minlength=len(each)).astype(np.int64),
                    "part": np.bincount(text_of, logs, minlength=len(each)), "rare": [rare[i:j] for i, j in zip([0, *to], to, strict=False)],
                    "score": sums / np.log(10), "doc_id": part["doc_id"].to_numpy(),
                })

    # ids travel as text, so that a null stays one and no integer becomes a float
    done = durable(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        score, "n_tokens bigint, n_seen bigint, part double, rare array<binary>, score double, doc_id string"
    ).withColumn("row", F.monotonically_increasing_id()))
    asked = done.select("row", F.explode("rare").alias("word"))
    told = asked.join(counts, "word", "left").groupBy("row").agg(
        F.count("n").alias("more"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(floor))).alias("rest")
    )
    end = float(np.log10((n_docs + 0.5) / floor))
    out = done.join(told, "row", "left").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return out.select(
        "doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")) % 5 == 1).alias("held_out"), "n_tokens",
        (F.col("n_seen") + F.coalesce("more", F.lit(0)) + int(n_docs > 0)).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0)) + end).alias("base_score"), "score",
    )
