"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

Both views start from the labelled documents. In each round each view labels all unlabelled documents
that it is sure of, and the *other* view is fitted to these and the labelled ones. Afterwards each view
is calibrated on labelled documents held back from training, and the calibrated log odds are added
(less the prior, which both contain) to score every document.

The labelled documents are a bounded sample: the ``MAX_LABELLED`` with the smallest id hashes. Every
unlabelled document takes part: its features are stored once, and each Newton step is one pass over
them in which the tasks sum gradients and curvatures; the driver sees those sums, whose size is that of
the features. Pseudo-labels of a class weigh together ``PSEUDO_SHARE`` times as much as the labelled rows
of the class at most, however many they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import durable
from .graph import written

MAX_LABELLED = 12_000
ROUNDS, STEPS, SURE = 4, 3, 0.95
PSEUDO_SHARE = 0.5
TEXT_BUCKETS, META_BUCKETS = 64, 48
HELD_BACK = 5  # every fifth labelled row calibrates
RIDGE = 1.0
LEAST_SCORE = 0.5


def text_features(text: str | None) -> np.ndarray:
    """Shares and logs of the whole text, and hashed shares of its byte bigrams. A null is the empty text."""
    raw = (text or "").encode("utf-8", "replace")
    flat = np.frombuffer(raw, dtype=np.uint8)
    words, lines = raw.split(), raw.split(b"\n")
    size, n = max(len(flat), 1), max(len(words), 1)
    kinds = np.bincount(_KINDS[flat], minlength=6) / size
    stats = [
        np.log1p(len(words)), len(flat) / n / 10, len(set(words)) / n, len(set(lines)) / len(lines), np.log1p(len(lines)),
        sum(map(len, words)) / size, *kinds,
    ]
    pairs = flat[:-1].astype(np.uint32) * 256 + flat[1:]
    hashed = np.bincount((pairs * np.uint32(2654435761)) >> np.uint32(26), minlength=TEXT_BUCKETS) / size
    return np.concatenate([stats, np.sqrt(hashed)]).astype(np.float32)


_KINDS = np.zeros(256, dtype=np.int64)
_KINDS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_KINDS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_KINDS[[*b"0123456789"]] = 3
_KINDS[[*b" \t\r\n"]] = 4
_KINDS[128:] = 5


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed language and source, and the declared length; nulls are a value of their own."""
    out = np.zeros(META_BUCKETS + 4, dtype=np.float32)
    for name, value in (("lang", lang), ("source", source)):
        out[zlib.crc32(f"{name}={value}".encode()) % META_BUCKETS] += 1
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    out[META_BUCKETS:] = [np.log1p(n_chars) / 5, (np.log1p(n_chars) / 5) ** 2, n_chars < 200, 0] if known else [0, 0, 0, 1]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss over rows, the intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    p = _chance(x @ w)
    return x.T @ (p - y), (x * (p * (1 - p) + 1e-6)[:, None]).T @ x


def sure_labels(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows a view is sure are bad, and those it is sure are good."""
    p = _chance(log_odds(x, w))
    return np.flatnonzero(1 - p >= SURE), np.flatnonzero(p >= SURE)


def pool_sums(views: tuple[np.ndarray, np.ndarray], teachers: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """What unlabelled rows add to a Newton step of both views, flat: for each view and label the number of
    rows the other view is sure of, their gradient and their curvature."""
    out = []
    for mine, other in ((0, 1), (1, 0)):
        for label, rows in enumerate(sure_labels(views[other], teachers[other])):
            grad, hess = newton_sums(views[mine][rows], np.full(len(rows), float(label)), weights[mine])
            out += [[len(rows)], grad, hess.ravel()]
    return np.concatenate(out)


def _parts(flat: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, float, np.ndarray, np.ndarray]]:
    at = 0
    for view, d in enumerate(sizes):
        for label in (0, 1):
            yield view, label, flat[at], flat[at + 1 : at + 1 + d], flat[at + 1 + d : at + 1 + d + d * d].reshape(d, d)
            at += 1 + d + d * d


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]) -> dict[str, np.ndarray]:
    """Weights, calibrations and prior from labelled rows (views and 0/1 labels).

    ``pool(teachers, weights)`` gives ``pool_sums`` over all unlabelled rows.
    """
    test = np.arange(len(y)) % HELD_BACK == 0
    views = (text, meta)
    train, known = [v[~test] for v in views], y[~test]
    weights = [fit_logistic(v, known) for v in train]
    sizes = [len(w) for w in weights]
    for _ in range(ROUNDS):
        teachers = [w.copy() for w in weights]
        for _ in range(STEPS):
            sums = [newton_sums(v, known, w) for v, w in zip(train, weights, strict=True)]
            for view, label, n, grad, hess in _parts(pool(teachers, weights), sizes):
                weight = min(1.0, PSEUDO_SHARE * float((known == label).sum()) / n) if n else 0.0
                sums[view] = (sums[view][0] + weight * grad, sums[view][1] + weight * hess)
            moved = 0.0
            for view, (grad, hess) in enumerate(sums):
                penalty = np.full(sizes[view], RIDGE)
                penalty[-1] = 1e-3
                step = np.linalg.solve(hess + np.diag(penalty), grad + penalty * weights[view])
                weights[view] = weights[view] - step
                moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-3:
                break
    scales = [fit_logistic(log_odds(v[test], w)[:, None], y[test], 1e-2) for v, w in zip(views, weights, strict=True)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return {"text": weights[0], "meta": weights[1], "scales": np.array(scales), "prior": np.log(share / (1 - share))}


def _features(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    text = np.stack([text_features(t) for t in batch["text"]])
    meta = np.stack([meta_features(*row) for row in zip(batch["lang"], batch["source"], batch["n_chars"], strict=True)])
    return text, meta


def _with_features(rows: DataFrame) -> DataFrame:
    """(doc_id text, y, text and meta features) of rows with doc_id as text and y."""
    def view(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                text, meta = _features(batch)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "text": list(text), "meta": list(meta)})

    return rows.mapInPandas(view, "doc_id string, y double, text array<float>, meta array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pool_of(features: DataFrame) -> Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]:
    """``pool_sums`` over the stored features of all unlabelled documents, summed by Spark."""

    def total(teachers: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                if batch.num_rows:
                    part = pool_sums((_matrix(batch.column(0)), _matrix(batch.column(1))), teachers, weights)
                    sums = part if sums is None else sums + part
            if sums is not None:
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["i", "v"])

        out = np.zeros(sum(2 * (1 + len(w) + len(w) ** 2) for w in weights))
        for r in features.select("text", "meta").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    return total


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) per document of ``doc_id, text, lang, source, n_chars``.

    ``labels`` has ``doc_id`` and ``quality`` (0, 1 or null: unlabelled); of several labels of one id
    the largest counts, of several documents of a labelled id the least. Nulls are values of their own
    (a null text is the empty one); equal rows get equal scores; ids without a document are ignored.
    Without labels of both kinds nothing can be learnt: the probabilities are null and every document is
    kept. An empty table gives none. Other columns are ignored, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType
    content = ["text", "lang", "source", "n_chars"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    order = F.xxhash64("doc_id", F.lit("co-training"))
    present = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = durable(present.orderBy(order).limit(MAX_LABELLED))  # so the broadcast and the rows below are bounded
    one_each = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*content)).alias("_d")).select("doc_id", "y", "_d.*")
    labelled = _with_features(one_each).toPandas().sort_values("doc_id", ignore_index=True)
    if labelled["y"].nunique() < 2:
        return rows.select(F.col("doc_id").cast(kind), *[F.lit(None).cast("double").alias(c) for c in ("p_text", "p_meta", "score")], F.lit(True).alias("kept"))
    # features first: half a kilobyte a document may be shuffled to the labels, whole texts need not
    every = _with_features(rows.withColumn("y", F.lit(None).cast("double")))
    features = written(every.join(known.select("doc_id"), "doc_id", "left_anti").select("text", "meta"))
    # neighbours in id are often copies; a fixed shuffle deals them to both folds
    labelled = labelled.iloc[np.random.default_rng(10).permutation(len(labelled))].reset_index(drop=True)
    views = [np.stack(labelled[view].to_list()) for view in ("text", "meta")]
    model = co_train(*views, labelled["y"].to_numpy(), _pool_of(features))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            odds = [
                scale[0] * log_odds(x, model[view]) + scale[1]
                for x, view, scale in zip(_features(batch), ("text", "meta"), model["scales"], strict=True)
            ]
            chance = [_chance(o) for o in (*odds, odds[0] + odds[1] - model["prior"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "p_text": chance[0], "p_meta": chance[1], "score": chance[2], "kept": chance[2] >= LEAST_SCORE})

    scored = rows.mapInPandas(score, "doc_id string, p_text double, p_meta double, score double, kept boolean")
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))
