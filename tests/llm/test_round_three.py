"""Fingerprints, whitening and the divergence audit against plain loops, and every registered SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from compare import compare, duck
from shelfwatch.llm import divergence, fingerprints, ngram_join, queries, spectrum, whitening

BIG = 2**53


def plain_fingerprint(text):
    """Winnowing by loops over the hashes of every gram."""
    points = [ord(c) for c in text] + [0] * (max(0, fingerprints.GRAM - len(text)) if text else 0)
    k = fingerprints.GRAM
    hashes = []
    for a in range(len(points) - k + 1):
        h = 0
        for p in points[a : a + k]:
            h = (h * fingerprints._BASE + p + 1) % 2**64
        h ^= h >> 31
        hashes.append(h * int(fingerprints._MIX) % 2**64 >> 32)
    w = 1
    while w < fingerprints.WINDOW and 8 * 2 * w <= len(hashes):
        w *= 2
    kept = set()
    for a in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = range(a, min(a + w, len(hashes)))
        kept.add(min(window, key=lambda i: (hashes[i], -i)))
    return [(hashes[i], i) for i in sorted(kept)]


def plain_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def decoded(text):
    return [(int(h), int(p)) for h, p in zip(*fingerprints.read(text), strict=True)]


def held_against_loops(got, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    prints = {t: plain_fingerprint(t) for t in texts}
    assert [r.doc_id for r in got] == [i for i, _ in order]
    for r, text, after in zip(got, texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert decoded(r.fingerprint) == prints[text]
        changed = plain_fingerprint(edited)
        assert decoded(r.edited_fingerprint) == changed
        assert r.near_edited == pytest.approx(plain_likeness(prints[text], changed))
        assert r.near_next == pytest.approx(plain_likeness(prints[text], prints[after]))


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_fingerprints_against_loops(spark, odd, ranges):
    rows = [(r.doc_id, r.text) for r in odd.where("doc_id <> 10 AND length(text) < 5000 OR doc_id = 4").collect()] + [(BIG + 1, "é" * 90), (BIG + 3, "日本 " * 40), (None, "x")]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id bigint, text string, at int, role int")
    got = fingerprints.edited_fingerprints(docs, ranges).orderBy(F.col("doc_id").desc_nulls_last()).collect()
    held_against_loops(got, rows)


def test_fingerprints_of_repeated_rows(spark, none, odd, monkeypatch):
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert fingerprints.edited_fingerprints(odd).count() == odd.count()
    one = spark.createDataFrame([(5, "only one " * 9)], "doc_id bigint, text string")
    assert [r.near_next for r in fingerprints.edited_fingerprints(one).collect()] == [1.0]
    monkeypatch.setattr(fingerprints, "HOT_ROWS", 100)
    rows = [(i, f"text {i} " * 12) for i in range(40) if i != 7] + [(7, "again and again " * 9)] * 1600 + [(7, "another text of seven")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = fingerprints.edited_fingerprints(docs, 8).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    mine = Counter((r.edited_sha256, r.near_next) for r in got if r.doc_id == 7 and r.n_chars > 100)
    assert sorted(mine.values()) == [1, 1599] and max(mine, key=mine.get)[1] == 1.0


def test_fingerprints_find_every_shared_span():
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("ab cd") for _ in range(n))
    for _ in range(200):
        span = letters(fingerprints.GUARANTEED)
        a, b = letters(rng.randrange(400)) + span + letters(rng.randrange(400)), letters(rng.randrange(400)) + span + letters(rng.randrange(400))
        places = [{p - t.index(span): h for h, p in zip(*map(np.ndarray.tolist, fingerprints.fingerprint(t)), strict=True)} for t in (a, b)]
        inside = [{p for p in x if 0 <= p <= fingerprints.GUARANTEED - fingerprints.GRAM} for x in places]
        assert any(places[0][p] == places[1][p] for p in inside[0] & inside[1])


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_spectrum_against_eigh(d):
    rng = np.random.default_rng(d)
    rows = rng.standard_normal((90, d)) * (1 + np.arange(d)) ** 0.4
    few = np.outer(rows[:, 0], np.ones(d))
    same = np.vstack([np.eye(d), -np.eye(d)]) * 3  # every eigenvalue alike
    near = rows * np.where(np.arange(d) < 2, 1, 1e-3)
    for x in (rows, few, same, near, np.zeros((4, d))):
        v = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) / len(x)
        values, vectors = spectrum.leading(v, 4)
        want = np.linalg.eigvalsh(v)[::-1]
        want = want[want > 1e-12 * max(np.trace(v), 1e-300)][:4]
        assert values == pytest.approx(want, rel=1e-12)
        assert np.abs(v @ vectors.T - vectors.T * values).max(initial=0) <= 1e-12 * max(1, np.trace(v))
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max(initial=0) < 1e-12
        for s in (0.0, float(np.trace(v)) / (d + 0.37), 1.7):
            if np.abs(np.linalg.eigvalsh(v) - s).min() > 1e-9:
                assert spectrum.count_above(v, s) == (np.linalg.eigvalsh(v) > s).sum()


def whitened_by_hand(rows, k=4):
    """{position: [(deviation, whitened up to sign, explained)]} of (id, vector) rows that stay."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, (_, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, x.values())))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    gap = np.array([[c - s / n for c, s in zip(v, total, strict=True)] for v in fit])
    v = gap.T @ gap / n
    e, q = (a[..., ::-1] for a in np.linalg.eigh(v))
    k = min(k, int((e > 1e-12 * e.sum()).sum()))
    mean = np.array(total) / n
    return n, {
        i: [(sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True)), abs((np.array(row) - mean) @ q[:, j]) / math.sqrt(e[j]), e[j] / e.sum()) for j in range(k)]
        for i, row in x.items()
    }


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    mixed = rng.standard_normal((6, 6))
    rows = [(BIG + i, (rng.standard_normal(6) @ mixed).astype(np.float32).tolist()) for i in range(60)]
    rows += [(1, rows[0][1]), (1, rows[0][1]), (None, rows[1][1]), (2, None), (3, [1.0, None] + [0.0] * 4), (4, [math.nan] + [0.0] * 5), (5, [-math.inf] + [0.0] * 5), (6, [-0.0] * 6), (7, [0.0] * 6)]
    other = [(8, [1.0, 2.0]), (9, [])]
    docs = spark.createDataFrame([(i, v, "a", 1) for i, v in rows + other], "vec_id bigint, embedding array<float>, x string, n int").repartition(3)
    got = whitening.whiten(docs).collect()
    n, want = whitened_by_hand(rows)
    assert {r.n for r in got} == {n} == {62 - 1} and all(r.identity_error <= 1e-9 for r in got)
    flat = sorted((rows[i][0] or -1, j + 1, dev, round(w, 8), round(x, 10)) for i, parts in want.items() for j, (dev, w, x) in enumerate(parts))
    assert sorted((r.vec_id or -1, r.component, r.deviation, round(abs(r.whitened), 8), round(r.explained, 10)) for r in got) == flat
    signs = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.vec_id or -1, r.component)):
        signs[r.component].append(r.whitened)
    assert all(abs(np.mean(s)) < 1 for s in signs.values())


def test_whitening_of_little(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in got] == [(1, 2, 512**2, 1.0, 1.0)] * 3


def test_whitening_of_huge_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [1e5, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {r.vec_id: r.deviation for r in got}[1] is None and len(got) >= 3


def audited(rows, least=10, top=10):
    rows = [(lang or "", source or "", [w for w in brute_terms(text)]) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(t for r in mine for t in set(r[2]))
        kept = sorted(t for t, c in df.items() if c >= least)
        by = {s: Counter(t for r in mine if r[1] == s for t in r[2]) for s in {r[1] for r in mine}}
        whole = sum(by.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in by.items()}, shares(whole)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in by if o != s]
            terms = [(t, far(p[s][t], q[t])) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, n) for n, (i, v) in enumerate(ranked, 1) if part == "pair" or n <= top]
    return sorted(out)


def brute_terms(text):
    import re

    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(brute.LOWER))


def audit_rows():
    rng = random.Random(13)
    words = ["the", "The", "of", "é", "日本", "x1y", "don't", "Ωmega", "ÉCOLE", "z_z", "\x7fq"] + [f"t{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)]
    text = lambda: " ".join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "Z"]), text()) for _ in range(300)]
    return rows + [("fr", "only", "un deux"), ("fr", "b", None), ("it", "a", ""), ("en", "no terms", "12 34")] + [rows[0]] * 20


@pytest.mark.parametrize("room", [divergence.BROADCAST_BYTES, 1])
def test_audit_against_loops(spark, none, monkeypatch, room):
    rows = audit_rows()
    monkeypatch.setattr(divergence, "SHARD_TERMS", 9)  # several shards a language, and a pass for each if room is 1
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    docs = spark.createDataFrame([(*r, 1, "n", 0) for r in rows], "lang string, source string, text string, value int, item string, slot int").repartition(3)
    got = divergence.audit(docs, broadcast_bytes=room).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == audited(rows)
    assert divergence.audit(none).count() == 0


def test_perfect_hash():
    rng = random.Random(1)
    for n in (0, 1, 2, 1000):
        names = list({bytes(rng.randrange(97, 123) for _ in range(rng.randrange(1, 9))) for _ in range(n)})
        made = divergence.PerfectHash.build(names)
        again = divergence.PerfectHash(made.sizes, made.bits, made.names)
        assert sorted(again.find(names).tolist()) == list(range(len(names)))
        assert (again.find([b"not " + x for x in names] + [b"?"]) == -1).all()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_registered_sql(spark, sf_dir, name):
    ours, theirs, only_ours, only_theirs = compare(queries.queries()[name](spark, sf_dir), duck(sf_dir), queries.oracle_sql()[name])
    assert (ours, only_ours, only_theirs) == (theirs, [], [])


CLASHING = ("_key", "_k", "_k1", "_times", "_again", "_out", "y", "_metadata", "_gone", "_left", "row", "k1", "copies", "_a")


def test_stages_keep_rows_and_columns_of_any_name(spark, odd):
    import corpus_pipeline
    from shelfwatch.llm import line_spread, sharding

    docs = odd.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHING})
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= given, name
    docs = docs.drop("shard")
    out = sharding.shard(docs, 3)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert Counter(tuple(r)[:-2] for r in out.collect()) == Counter(tuple(r) for r in docs.collect())
    assert line_spread.line_dedup(docs).columns == [*docs.columns, "n_lines", "n_removed"]


def test_mixed_documents_are_what_the_mix_decided(spark):
    from shelfwatch.llm import mixing

    text = lambda i: " ".join(f"w{i}x{k}" for k in range(20 + i % 30))
    rows = [(i, text(i), "A") for i in range(30)] + [(None, text(i), s) for s in ("A", "B", None) for i in range(4)] + [(99, text(5), "B")] * 25 + [(7, None, "B"), (8, "", "A")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id bigint, text string, source string, extra int").repartition(3)
    decided = Counter()
    for r in mixing.mix(docs).collect():
        decided[r.doc_id, r.size, r.source] += r.times
    given = Counter((r.doc_id, len((r.text or "").split()), r.source) for r in mixing.mixed_documents(docs).collect())
    assert given == Counter({k: n for k, n in decided.items() if n})
    for source in ("A", "B", None):
        target = next(r.target for r in mixing.mix(docs).collect() if r.source == source)
        assert abs(sum(k[1] * n for k, n in given.items() if k[2] == source) - target) <= 25


def test_ids_come_back_as_they_were(spark, sf_dir):
    from shelfwatch.llm import cotraining, langid, licences

    ids = [None, BIG + 1, BIG + 3, -5, 2**63 - 1]
    docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog ran", "en", "a.example", 40) for i in ids], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for got in (licences.licence_scan(docs), langid.identify(langid.document_evidence(docs)).withColumnRenamed("id", "doc_id"), cotraining.quality_scores(docs, labels)):
        assert Counter(r.doc_id for r in got.collect()) == Counter(ids) and got.schema["doc_id"].dataType.typeName() == "long"


def test_cotraining_against_one_process(spark, sf_dir):
    from shelfwatch.llm import cotraining

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("y", F.lit("of its own")).union(docs.limit(3).withColumn("y", F.lit("again")))
    got = {r.doc_id: r for r in cotraining.quality_scores(docs, labels).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows and r.quality is not None}
    views = lambda ids: (np.stack([cotraining.text_features(rows[i].text) for i in ids]), np.stack([cotraining.meta_features(rows[i].lang, rows[i].source, float(rows[i].n_chars)) for i in ids]))
    known = sorted(y, key=str)
    known = [known[k] for k in np.random.default_rng(10).permutation(len(known))]
    rest = [r.doc_id for r in docs.collect() if r.doc_id not in y]  # repeated rows count each
    pool = views(rest)
    model = cotraining.co_train(*views(known), np.array([float(y[i]) for i in known]), lambda teachers, weights: cotraining.pool_sums(pool, teachers, weights))
    for i, (t, m) in zip(rows, zip(*views(list(rows)), strict=True), strict=True):
        odds = [s[0] * (x @ model[v][:-1] + model[v][-1]) + s[1] for x, v, s in zip((t, m), ("text", "meta"), model["scales"], strict=True)]
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, odds[0] + odds[1] - model["prior"])))), abs=1e-5)
    assert len(rest) > len(known) / 2


@pytest.mark.parametrize("share", [0.2, 0.3, 0.4])
def test_outliers_withstand_alike_junk(spark, share):
    from shelfwatch.llm import outliers

    def plain(i):
        return " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(80 + i % 40))

    def junk(i):
        return " ".join(f"###w{(i * 5 + k * k) % 991}***" for k in range(100 + i % 9))

    n = int(200 * share)
    rows = [(i, plain(i), "en", "s") for i in range(200 - n)] + [(1000 + i, junk(i), "en", "s") for i in range(n)]
    got = outliers.quality_outliers(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(200 - n))


def plain_mcd(x, floor, steps=60):
    """The same estimate of one group in numpy."""
    from shelfwatch.llm import outliers

    ridge = np.diag(np.square(floor))
    low_median = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    middle = low_median(x)
    spread = np.diag((1.4826 * low_median(np.abs(x - middle))) ** 2) + ridge
    z = (x - middle) / np.sqrt(np.maximum(distance(middle, spread), 1e-12))[:, None]
    ends = []
    for m, c in ((middle, spread), (middle, z.T @ z / len(x) * x.shape[1] + ridge)):
        before = np.inf
        for _ in range(steps):
            d = distance(m, c)
            near = x[d <= np.sort(d)[(len(d) + 1) // 2 - 1]]
            m, c = near.mean(axis=0), np.cov(near.T, bias=True) * outliers.HALF_FACTOR + ridge
            now = np.linalg.slogdet(c)[1]
            if now >= before - 1e-6:
                break
            before = now
        ends.append((now, m, c))
    _, m, c = min(ends, key=lambda e: e[0])
    near = x[distance(m, c) <= outliers.INNER]
    m, c = near.mean(axis=0), np.cov(near.T, bias=True) * outliers.INNER_FACTOR + ridge
    return distance(m, c)


def test_outlier_distances_against_numpy(spark):
    from shelfwatch.llm import outliers

    rng = np.random.default_rng(4)
    rows = []
    for group, n in (("a", 120), ("b", 301), ("c", 64)):
        x = rng.standard_normal((n, 5)) @ rng.standard_normal((5, 5))
        x[: n // 3] += 9
        rows += [(group, *map(float, v)) for v in x]
    frame = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{c} double" for c in outliers.STATS)).repartition(3).cache()
    estimate = outliers.robust_estimates(frame)
    got = frame.join(estimate, "grp").withColumn("d", outliers._distance(frame)).collect()
    for group in "abc":
        mine = sorted((tuple(r[c] for c in outliers.STATS), r.d) for r in got if r.grp == group)
        want = plain_mcd(np.array([k for k, _ in mine]), [outliers.FLOOR[c] for c in outliers.STATS])
        assert [d for _, d in mine] == pytest.approx(want, rel=1e-6)


class _Given:
    """Sets as they are, in place of those made from texts."""

    percent = 80

    def __init__(self, spark, sets):
        rows = spark.createDataFrame(list(sets.items()), "node long, s array<long>")
        self.rows = rows.select("node", "s", *[ngram_join._hash_prefix(F.col("s"), seed, 80).alias(f"p{seed}") for seed in (3, 4)])

    def sets(self, nodes):
        return self.rows.join(nodes, "node")


def test_classes_that_meet_in_many_pairs_are_connected_by_few(spark):
    same, other = list(range(20)), list(range(100, 120))
    sets = {n: same for n in range(20)} | {n: same for n in range(100, 120)}
    # a third class links with the first by one of its twenty nodes
    sets |= {n: other for n in range(200, 219)} | {219: same}
    pairs = [(a, b, 1, 2) for a in range(20) for b in range(100, 120)] + [(a, b, 1, 3) for a in range(20) for b in range(200, 220)]
    frame = spark.createDataFrame(pairs, "a long, b long, ca long, cb long")
    links = ngram_join._connecting(frame, _Given(spark, sets)).collect()
    assert {(r["ca"], r["cb"]) for r in links} == {(1, 2), (1, 3)} and all(r["a"] < 20 and (r["b"] < 120 or r["b"] == 219) for r in links)
    assert sum(r["cb"] == 2 for r in links) <= 2


class _Rows:
    """Stands for the documents: gives out the function that a task would run."""

    def __init__(self):
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        self.value = value
        return self

    def mapInArrow(self, function, schema):  # noqa: N802
        return function


def test_recount_looks_a_term_up_once_whatever_its_sources(monkeypatch):
    monkeypatch.setattr(divergence, "DICT_ENTRIES", 50)
    monkeypatch.setattr(divergence, "PENDING_TERMS", 300)
    names = [b"t%s" % chr(97 + i).encode() for i in range(20)]
    shards = {k: divergence.PerfectHash.build([n for n in names if zlib.crc32(n) % 2 == k]) for k in (0, 1)}
    first = {0: 0, 1: len(shards[0].names)}
    directory = {"en": (2, {k: (first[k], (h.sizes, h.bits, h.names)) for k, h in shards.items()})}
    asked = []
    find = divergence.PerfectHash.find
    monkeypatch.setattr(divergence.PerfectHash, "find", lambda self, found: asked.extend(found) or find(self, found))
    rows = [("en", f"s{i % 40}", b" ".join(names[: 1 + i % 20]) + b" unkept tb") for i in range(200)] + [("xx", "s", b"ta"), ("en", "empty", b"")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], ["lang", "source", "text"])
    got = Counter()
    for out in divergence._recount(_Rows(), directory)(iter([batch])):
        for lang, source, slot, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[lang, source, slot] += n
    slot_of = {n: first[k] + i for k, h in shards.items() for i, n in enumerate(h.names)}
    want = Counter((lang, source, slot_of[w]) for lang, source, text in rows if lang == "en" for w in text.split() if w in slot_of)
    assert got == want and sorted(asked) == sorted([*names, b"unkept"])
