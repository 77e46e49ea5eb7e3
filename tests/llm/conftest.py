import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tok int, row int, shard string, level string"


def odd_rows():
    """Nulls, empty and very long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice(["the", "re", "on", "ti", "an"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "Other"
    rows = [
        (1, base, "en", "a.example"), (2, base.upper(), "en", "b"), (3, " ".join(near), "en", "a.example"), (4, None, None, None), (5, "", "en", "b"),
        (6, " \t\n", "de", None), (7, "One two", "de", "b"), (8, "one  TWO", "en", "b"), (9, prose(20_000), "en", "a.example"),
        (10, "x\nshared line\ny", "en", "s1"), (10, "x\nshared line\ny", "en", "s1"), (None, base, "en", "b"), (None, None, None, None),
        (11, "É 日本 #*$ same same same same same\nq\nq", "fr", "s2"), (12, "\x00nul\x00 byte", "en", "s3"),
    ]
    rows += [(100 + i, f"{prose(60)}\nshared line\n{prose(30)}", "en", f"s{i}") for i in range(12)]
    return [(*r, len(r[1] or ""), 1, 2, "x", "y") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
