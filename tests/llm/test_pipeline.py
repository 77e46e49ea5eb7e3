import random
from collections import Counter

import corpus_pipeline
import brute


def test_pipeline_keeps_what_it_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert [c for c in out.columns if c not in ("shard", "slot")] == docs.columns
    rows = out.select("doc_id", "text", "shard", "slot").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert len(corpus_pipeline.STAGES) == 5
    assert not any(brute.contamination(t, items)[1] for t in {r.text for r in rows})
    ids = sorted({(r.doc_id, r.text) for r in rows})
    assert all(a == b for a, b in brute.near_groups(ids, 5, 80).items())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rng = random.Random(6)

    def prose():
        return " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(90))

    def near(text, word):
        return f"{text} {word}"

    texts = [prose() for _ in range(8)]
    rows = [(None, texts[0]), (None, near(texts[0], "x")), (None, near(texts[0], "y"))]  # one stays
    rows += [(1, texts[1]), (None, near(texts[1], "x")), (2, near(texts[1], "y"))]  # 1 stays
    rows += [(3, texts[2]), (4, near(texts[2], "x")), (4, texts[3])]  # the other text of 4 stays
    rows += [(5, texts[4]), (5, near(texts[4], "x")), (6, near(texts[4], "y"))]  # one row of 5 stays
    rows += [(7, texts[5]), (7, texts[5]), (8, None), (9, None), (None, None), (10, ""), (11, " ")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, source string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    group = brute.near_groups([(k, t) for k, (_, t) in enumerate(distinct)], 5, 80)
    best: dict = {}
    for k, (i, _) in enumerate(distinct):
        best.setdefault(group[k], i)  # the smallest id, null last
    where = {r: group[k] for k, r in enumerate(distinct)}
    assert Counter(where[r] for r in got) == Counter(set(group.values()))  # one row of each group
    assert all(r[0] == best[where[r]] for r in got)
    assert {(1, texts[1]), (3, texts[2]), (4, texts[3]), (7, texts[5])} <= set(got)
