"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Templates are notices and the full texts in ``licence_texts``. Windows of words slide over the whole text,
line ends being spaces. With |A| and |B| bigrams the coefficient is at most 2 min / (|A| + |B|), so a
match has ``t / (2 - t)`` of the template's bigrams at least and ``(2 - t) / t`` times as many at most.
Texts without so many shared bigrams are left after one count; in the others every window that starts
and ends with a bigram of the template is scored, and no other can be the best.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# fixed values: common licence notices
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

_WORD = re.compile(r"[a-z0-9]+")


def normalised(text: str) -> list[str]:
    """Lower-cased words of letters and digits, without copyright lines' holders being treated apart."""
    return _WORD.findall(text.lower())


def bigrams(tokens: list[str]) -> Counter:
    return Counter(zip(tokens, tokens[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def full_texts() -> dict[str, tuple[str, ...]]:
    """The texts of whole licences by name."""
    return {f.stem: (f.read_text(encoding="utf-8"),) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


class Templates:
    """Templates as counts of numbered bigrams, and the search for windows that match them."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        known = [(name, grams) for name, texts in sorted(templates.items()) for grams in (bigrams(normalised(t)) for t in texts) if grams]
        spelled = sorted({w for _, grams in known for pair in grams for w in pair})
        self.words = {w: i + 1 for i, w in enumerate(spelled)}
        self.base = len(spelled) + 1
        code = lambda pair: self.words[pair[0]] * self.base + self.words[pair[1]]
        self.codes = np.array(sorted({code(pair) for _, grams in known for pair in grams}), dtype=np.int64)
        self.names = [name for name, _ in known]
        self.sizes = np.array([grams.total() for _, grams in known], dtype=np.int64)
        # every match shares so many bigrams, and no match has more than so many
        self.least = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9).astype(np.int64)
        self.most = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9).astype(np.int64)
        self.grams = [np.searchsorted(self.codes, sorted(code(pair) for pair in grams)) for _, grams in known]
        self.counts = [np.array([n for _, n in sorted((code(pair), n) for pair, n in grams.items())], dtype=np.int64) for _, grams in known]
        self.all_grams, self.all_counts = (np.concatenate(x) if known else np.zeros(0, dtype=np.int64) for x in (self.grams, self.counts))
        self.heads = np.cumsum([0, *map(len, self.grams)])[:-1]

    def numbered(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the text's bigrams that any template has, and their numbers."""
        ids = np.array([self.words.get(w, 0) for w in normalised(text)], dtype=np.int64)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        pairs = ids[at] * self.base + ids[at + 1]
        place = np.minimum(np.searchsorted(self.codes, pairs), len(self.codes) - 1)
        found = self.codes[place] == pairs
        return at[found], place[found]

    def _windows(self, k: int, at: np.ndarray, grams: np.ndarray) -> list[tuple[float, str, int, int]]:
        """The best matching window (score, name, first, last) from each start, for template ``k``.

        The best windows start and end with a bigram of the template. One counts in a window if fewer
        than the template's number of it lie before it there.
        """
        slot = np.minimum(np.searchsorted(self.grams[k], grams), len(self.grams[k]) - 1)
        mine = self.grams[k][slot] == grams
        at, slot = at[mine], slot[mine]
        size, least, most = self.sizes[k], self.least[k], self.most[k]
        if len(at) < least:
            return []
        order = np.argsort(slot, kind="stable")
        back = np.arange(len(at)) - self.counts[k][slot[order]]
        before = np.full(len(at), -1, dtype=np.int64)
        same = (back >= 0) & (slot[order][np.maximum(back, 0)] == slot[order])
        before[order[same]] = at[order[back[same]]]
        ends = np.searchsorted(at, at + most)
        hits = []
        for i in np.flatnonzero(ends - np.arange(len(at)) >= least):
            shared = np.cumsum(before[i : ends[i]] < at[i])
            scores = 2 * shared / (at[i : ends[i]] - at[i] + 1 + size)
            j = int(scores.argmax())
            if scores[j] >= self.threshold:
                hits.append((float(scores[j]), self.names[k], int(at[i]), int(at[i + j])))
        return hits

    def matches(self, at: np.ndarray, grams: np.ndarray) -> list[tuple[float, str]]:
        """(score, name) of matching windows; one that overlaps a better one does not count."""
        found, parts = [], [(at, grams)]
        while parts:
            at, grams = parts.pop()
            if len(at) < self.least.min(initial=1):
                continue
            present = np.bincount(grams, minlength=len(self.codes))
            enough = np.add.reduceat(np.minimum(present[self.all_grams], self.all_counts), self.heads) >= self.least
            hits = [hit for k in np.flatnonzero(enough) for hit in self._windows(k, at, grams)]
            taken: list[tuple[int, int]] = []
            for score, name, first, last in sorted(hits, key=lambda x: (x[0], x[1], -x[2]), reverse=True):
                where = bisect.bisect(taken, (first,))
                # the last word of a window is not the first of another
                if (where == 0 or taken[where - 1][1] + 1 < first) and (where == len(taken) or taken[where][0] > last + 1):
                    taken.insert(where, (first, last))
                    found.append((score, name))
            if taken:  # what lies between may hold more
                borders = [-1, *[x for first, last in taken for x in (first - 1, last + 2)], at[-1] + 1]
                for low, high in zip(borders[::2], borders[1::2], strict=True):
                    inside = (at >= low) & (at < high)
                    parts.append((at[inside], grams[inside]))
        return found

    def scan(self, text: str) -> tuple[list[str], float, int]:
        """(licences, best coefficient, number of lines that hold a match) of a text."""
        found = self.matches(*self.numbered(text)) if len(self.codes) else []
        if not found:
            return [], 0.0, 0
        n_lines = sum(bool(self.matches(*self.numbered(line))) for line in text.split("\n"))
        return sorted({name for _, name in found}), max(score for score, _ in found), n_lines


def licence_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, licences, score, n_lines) per document of ``doc_id, text``.

    ``licences`` lists the matched names in order, comma-joined, empty if none; ``score`` is the best
    coefficient among matches (0 without one), ``n_lines`` the single lines that hold a match. Null and
    empty texts match nothing. Equal coefficients go to the later name. Without ``templates`` the
    notices and the full licence texts are looked for. Every row is scanned on its own and whole; other
    columns are ignored; an empty table gives none.
    """
    if templates is None:
        whole = full_texts()
        templates = {name: TEMPLATES.get(name, ()) + whole.get(name, ()) for name in {*TEMPLATES, *whole}}
    known = Templates(templates, threshold)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [known.scan(text) if text else ([], 0.0, 0) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "licences": [",".join(f[0]) for f in found], "score": [f[1] for f in found], "n_lines": [f[2] for f in found]})

    # as text, an id is the same in pandas whatever else is in the batch
    found = docs.select(docs["doc_id"].cast("string"), "text").mapInPandas(scan, "doc_id string, licences string, score double, n_lines bigint")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
