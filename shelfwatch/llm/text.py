"""Text expressions shared by the operators: words, hashes and let-bindings, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def whole(text: str | Column) -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, lower: bool = False) -> Column:
    """Runs of anything but ASCII white space, in order; one pass also lowers A-Z if asked."""
    source, target = (SPACES + UPPER, " " * len(SPACES) + LOWER) if lower else (SPACES, " " * len(SPACES))
    return F.array_remove(F.split(F.translate(text, source, target), " "), "")


def grams(tokens: Column, k: int) -> Column:
    """A 64-bit hash of every ``k`` consecutive tokens; empty if there are fewer."""
    def hashes(w: Column) -> Column:
        # zipping shifted copies would build k arrays; get() reads the one array in place
        each = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
        return F.slice(each, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))

    return let(tokens, hashes)


def row_key(*columns: str, seed: int = 0) -> Column:
    """A 64-bit hash in which a null is a value of its own (``xxhash64`` alone passes over nulls)."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def free_name(frame_columns: list[str], wanted: str) -> str:
    """``wanted``, or with underscores before it if the frame has such a column (names ignore case)."""
    taken = {c.lower() for c in frame_columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
