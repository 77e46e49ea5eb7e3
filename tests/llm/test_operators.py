"""Each operator on odd rows and empty tables against plain loops, and its defining properties."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

import brute
from shelfwatch.llm import attention_lm, cotraining, langid, licences, line_spread, mixing, ngram_join, outliers, sharding, winnowing
from pyspark.sql import functions as F


def test_outliers_statistics(odd, none):
    got = outliers.quality_outliers(odd).collect()
    want = Counter(brute.word_statistics(r.text) for r in odd.collect())
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert outliers.quality_outliers(none).count() == 0


def test_outliers_reject_a_far_document(spark):
    plain = [(i, " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(80 + i % 40)), "en", "s") for i in range(80)]
    odd_one = (999, " ".join(f"###w{k}***" for k in range(100)), "en", "s")
    got = outliers.quality_outliers(spark.createDataFrame([*plain, odd_one], "doc_id bigint, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {999}


def test_outliers_small_groups_use_larger_ones(spark):
    def plain(i):
        return " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(80 + i % 40))

    def junk(i):
        return " ".join(f"###w{(i * 5 + k * k) % 991}***" for k in range(100 + i % 9))

    rows = [(i, plain(i), "en", "big") for i in range(120)]
    rows += [(1000 + i, junk(i), "en", "new") for i in range(10)]  # all of a new source alike
    rows += [(2000 + i, plain(i) if i < 2 else "few words", "en", "failed") for i in range(60)] + [(2100, junk(3), "en", "failed")]
    rows += [(3000, junk(4), "xx", "alone"), (3001, plain(4), "yy", None), (3002, junk(5), None, None)]
    got = {r.doc_id: r for r in outliers.quality_outliers(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r.kept} == {*range(120), 2000, 2001, 3001}


def test_sharding_exact_sizes(odd, none):
    got = sharding.shard(odd, 8, seed=1)
    rows = got.collect()
    assert len(rows) == odd.count() and set(got.columns) == {*odd.columns, "slot"}
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.shard(none).count() == 0


def test_communication_matrix_margins_and_range():
    m = sharding.communication_matrix([5, 0, 17, 8], [10, 10, 10], 3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 8] and m.sum(axis=0).tolist() == [10, 10, 10]
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 3 * 10**10, 10**10, 1000) for _ in range(400)]
    assert abs(np.mean(draws) - 750) < 5 and 9 < np.std(draws) < 19


def test_attention_scores(odd, none):
    got = attention_lm.lm_scores(odd).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in odd.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, ws in rows if not held(i) for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(ws) + 1, sum(w in counts for w in [*ws, None]), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), 4)) for i, ws in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert attention_lm.lm_scores(none).count() == 0


def test_attention_trains_on_every_word():
    texts = ["one two three", None, "", "Word " * 70, " ".join(f"w{k}" for k in range(700))]
    cut = attention_lm.Segmenter(attention_lm.RANKS)
    slot_of = np.arange(cut.size, dtype=np.int32) % attention_lm.RARE
    classes = np.arange(attention_lm.SLOTS, dtype=np.int32) % attention_lm.CLASSES
    first = attention_lm.initial_weights()
    adam, seen = attention_lm.fitted(texts, cut, slot_of, classes, first)
    assert seen == sum(len(cut(w)) for t in texts for w in attention_lm.split_words(t)) + len(texts)
    for text in texts[:1] + texts[3:]:  # each text alone moves the embeddings of its own last subword
        alone, _ = attention_lm.fitted([text], cut, slot_of, classes, first)
        last = slot_of[cut(attention_lm.split_words(text)[-1])[-1]]
        assert (alone.w["E"][last] != first["E"][last]).any()


def test_attention_texts_are_joined_from_words_segmented_once():
    asked = []
    known = attention_lm._SlotsOf(lambda word: asked.append(word) or [len(word), 7], np.arange(64, dtype=np.int64) + 1)
    got = np.frombuffer(b"".join(map(known.__getitem__, [b"ab", b"c", b"ab"])), dtype=np.int32)
    assert got.tolist() == [3, 8, 2, 8, 3, 8] and asked == [b"ab", b"c"]


def test_attention_gradients():
    w = {k: x.astype(np.float64) for k, x in attention_lm.initial_weights().items()}
    rng = np.random.default_rng(1)
    slots = rng.integers(0, 50, 70).astype(np.int32)
    windows, live = attention_lm.windows_of(slots, np.array([40, 30]))
    assert live.sum() == 70  # each subword once
    targets = windows[:, attention_lm.CONTEXT :] % attention_lm.CLASSES
    _, grads = attention_lm.train_step(w, windows, targets, live)
    for name, at in (("E", (int(slots[3]), 2)), ("Wq", (1, 2)), ("Wk", (3, 1)), ("Wv", (0, 5)), ("Wr", (2, 2)), ("U", (4, 7)), ("near", (2,)), ("b", (3,))):
        step = 1e-4
        w[name][at] += step
        up = attention_lm.train_step(w, windows, targets, live)[0]
        w[name][at] -= 2 * step
        down = attention_lm.train_step(w, windows, targets, live)[0]
        w[name][at] += step
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-5)


def test_language_fusion(odd, none, spark):
    got = langid.identify(langid.document_evidence(odd)).collect()
    assert len(got) == odd.count()
    assert all(not r.kept for r in got if r.id in (4, 5, 6)) and all(r.kept for r in got if r.id in (1, 2, 9))
    assert langid.identify(langid.document_evidence(none)).count() == 0
    pages = spark.createDataFrame([(1, "http://u@www.Example.de:80/x?y", '<html lang="de"><script>no</script><p>Guten Tag</p></html>'), (2, None, None)], "page_id bigint, url string, html string")
    first, second = langid.page_evidence(pages).orderBy("id").collect()
    assert (first.declared, first.host, first.suffix, first.text.split()) == ("de", "www.example.de", "de", ["Guten", "Tag"])
    assert (second.declared, second.host, second.suffix, second.text) == (None,) * 4


def test_languages_of_few_rows(spark):
    import random

    rng = random.Random(5)

    def prose(letters, n=40):
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 4))) for _ in range(n))

    rows = [(i, prose(["the", "re", "on", "ti", "an"]), "en", "a.example", 0) for i in range(2400)]
    rows += [(5000, prose("αβγδε"), "el", "b.example", 0), (5001, prose("アイウエオ"), "ja", "c.example", 0), (5002, prose("בגדהו"), None, "d.example", 0), (5003, "12 34", "xx", "e.example", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.id: r for r in langid.identify(langid.document_evidence(docs)).where("id >= 5000 OR id < 50").collect()}
    assert all(got[i].language == "en" and got[i].kept for i in range(50))
    assert [(got[i].language, got[i].text_language, got[i].kept) for i in (5000, 5001)] == [("el", "el", True), ("ja", "ja", True)]
    assert not got[5002].kept and not got[5003].kept  # unlike every language; no letters
    assert {r.doc_id for r in langid.with_known_language(docs).where("doc_id >= 5000").collect()} == {5000, 5001}


def test_mixing_targets_and_reruns(odd, none):
    got = mixing.mix(odd).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(odd).collect()))
    sizes = Counter()
    for r in odd.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want = brute.filled(sizes, mixing.WEIGHTS)
    assert all(r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.times <= 2 for r in got)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.times * r.size for r in mine) - want[s]) <= max(r.size for r in mine) / 2 + 1e-6
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.times for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_winnowing(odd, none, spark):
    text = {r.doc_id: r.text for r in odd.collect()}
    items = [(1, " ".join(text[1].split()[20:50])), (2, "one TWO!"), (3, ""), (4, None), (5, " ".join(text[9].split()[500:509])), (6, " ".join(text[9].split()[19_980:])), (None, "nul")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = winnowing.decontaminate(odd, bench).collect()
    import hashlib

    want = Counter()
    for r in odd.collect():
        n, hit, _ = brute.contamination(r.text, items)
        ids = brute.contamination(r.text, [x for x in items if x[0] is not None])[2]
        want[(r.doc_id, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)] += 1
    assert Counter(map(tuple, got)) == want
    assert winnowing.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in winnowing.decontaminate(odd, bench.limit(0)).collect())
    assert winnowing.without_benchmark(odd, bench).count() == sum(n for r, n in want.items() if not r[-1])


def test_line_spread(odd, none):
    got = line_spread.line_dedup(odd)
    assert set(got.columns) == {*odd.columns, "n_lines", "n_removed"}
    rows = {(r.doc_id, r.n_lines, r.n_removed): r.text for r in got.collect()}
    assert rows[10, 3, 1] == "x\ny" and rows[4, 0, 0] is None and rows[5, 1, 0] == ""
    assert sum(r.n_removed for r in got.collect()) == 14
    assert line_spread.line_dedup(none).count() == 0


def test_licence_scan(spark, none):
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "released UNDER the mit license"), (3, None), (4, ""), (5, "the license of the MIT students was released"), (None, "Licensed under CC BY-NC 4.0."),
            (6, "a\n\nLicensed under the Apache License,\nVersion 2.0.\n\nb")]
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k: v.licences for k, v in got.items()} == {1: "MIT", 2: "MIT", 3: "", 4: "", 5: "", None: "CC-BY-NC-4.0", 6: "Apache-2.0"}
    assert licences.licence_scan(none).count() == 0


def test_licence_windows(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    prose = " ".join(f"w{k}" for k in range(300))
    wrapped = "Some words before it. This work is licensed under the\nGNU General Public License, version 3. Some words\nafter it, and more of them."
    rows = {
        1: ("Copyright 2020 Foo. Released under the MIT License.", "MIT"), 2: ("This project is released under the MIT License, see below.", "MIT"),
        3: (f"{gpl} Another sentence follows here.", "GPL-3.0"), 4: (wrapped, "GPL-3.0"), 5: (f"{prose} {gpl} {prose} released under the MIT license {prose}", "GPL-3.0,MIT"),
        6: (prose, ""), 7: ("under the MIT students' work a license of the public was released", ""), 8: ("Licensed under CC BY-SA 4.0. " * 3, "CC-BY-SA-4.0"),
    }
    rows |= {100 + k: (f"{prose}\n{t.replace('<year> <copyright holders>', '2020 Foo Bar')}\n{prose}", name) for k, (name, (t,)) in enumerate(licences.full_texts().items())}
    got = licences.licence_scan(spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id bigint, text string")).collect()
    want = {i: name for i, (_, name) in rows.items()}
    assert {r.doc_id: r.licences for r in got if r.doc_id < 100} == {i: n for i, n in want.items() if i < 100}
    assert all(want[r.doc_id] in r.licences.split(",") and r.score > 0.9 for r in got if r.doc_id >= 100)


def test_licence_windows_against_all_windows():
    import random

    rng = random.Random(8)
    template = "a b c a b d e f"
    known = licences.Templates({"x": (template,)}, 0.8)
    want = licences.bigrams(licences.normalised(template))
    hits = 0
    for _ in range(300):
        tokens = [rng.choice("abcdefz") for _ in range(6)] + [w if rng.random() < 0.85 else "z" for w in template.split()] + [rng.choice("abcdef") for _ in range(6)]
        best = max(licences.dice(licences.bigrams(tokens[i:j]), want) for i in range(len(tokens)) for j in range(i + 2, len(tokens) + 1))
        names, score, _ = known.scan(" ".join(tokens))
        assert (names, score) == ((["x"], pytest.approx(best)) if best >= 0.8 else ([], 0.0))
        hits += best >= 0.8
    assert 30 < hits < 290


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_ngram_join(odd, none, spark, sf_dir, width, percent):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    known = odd.where("doc_id IS NOT NULL")
    want = brute.near_groups(rows, width, percent)
    got = ngram_join.ngram_jaccard_join(known, width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(brute.shingles(t, width)), want[i]) for i, t in rows)
    assert ngram_join.ngram_jaccard_join(odd, width, percent).count() == odd.count()
    assert ngram_join.ngram_jaccard_join(none, width, percent).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute.near_groups([tuple(r) for r in docs.collect()], width, percent)
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs, width, percent).collect()} == want


def test_cotraining(spark, odd, none, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = cotraining.quality_scores(docs, labels).join(labels, "doc_id")
    right = scored.where((F.col("kept").cast("int") == F.col("quality"))).count() / scored.count()
    assert right > 0.9
    assert cotraining.quality_scores(odd, labels).count() == odd.count()
    assert cotraining.quality_scores(none, labels).count() == 0
    assert all(r.kept and r.score is None for r in cotraining.quality_scores(odd, labels.limit(0)).collect())


def test_attention_step_fills_the_same_arrays_again():
    w, room = attention_lm.initial_weights(), attention_lm.Room(np.float32)
    windows = np.random.default_rng(2).integers(0, 90, (24, attention_lm.CONTEXT + attention_lm.SPAN)).astype(np.int32)
    targets, live = windows[:, attention_lm.CONTEXT :] % attention_lm.CLASSES, np.ones((24, attention_lm.SPAN), dtype=bool)
    fresh_loss, fresh = attention_lm.train_step(w, windows, targets, live)
    attention_lm.train_step(w, windows[:7], targets[:7], live[:7], room)
    attention_lm.train_step(w, windows[::-1], targets[::-1], live, room)
    held = {k: x.ctypes.data for k, x in room.items()}
    loss, grads = attention_lm.train_step(w, windows, targets, live, room)
    assert held == {k: x.ctypes.data for k, x in room.items()}
    assert loss == pytest.approx(fresh_loss, rel=1e-6) and all(np.allclose(fresh[k], grads[k], rtol=1e-4, atol=1e-7) for k in fresh)


def test_attention_scores_of_large_weights_stay_finite():
    w = {k: x * np.float32(30) if k in ("E", "U") else x for k, x in attention_lm.initial_weights().items()}
    rng = np.random.default_rng(4)
    tables = (rng.integers(0, attention_lm.CLASSES, attention_lm.SLOTS).astype(np.int32), np.ones(attention_lm.SLOTS, dtype=np.int32),
              np.zeros(attention_lm.SLOTS, dtype=bool), np.zeros((attention_lm.GROUPS, attention_lm.SLOTS), dtype=np.float32))
    slots, lengths = rng.integers(0, 90, 70).astype(np.int32), np.array([40, 30])
    got = attention_lm.Scorer(w, tables)(slots, lengths)
    e, q, k, v, r, u = (w[x].astype(np.float64) for x in ("E", "Wq", "Wk", "Wv", "Wr", "U"))
    want = []
    for window, used in zip(*attention_lm.windows_of(slots, lengths), strict=True):
        for i in np.flatnonzero(used):
            seen = e[window[: attention_lm.CONTEXT + i]]
            scores = seen @ k @ (seen[-1] @ q) / np.sqrt(attention_lm.DIM)
            near = np.exp(scores - scores.max())
            logits = np.tanh(near @ (seen @ v) / near.sum() + seen[-1] @ r) @ u
            want.append(logits[tables[0][window[attention_lm.CONTEXT + i]]] - logits.max() - np.log(np.exp(logits - logits.max()).sum()))
    assert np.isfinite(got).all() and got == pytest.approx(want, rel=1e-3, abs=0.05)


def test_attention_tokenizer_is_read_once_and_words_are_told():
    cut = attention_lm.segmenter(attention_lm.RANKS)
    assert cut is attention_lm.segmenter(attention_lm.RANKS)
    known = attention_lm.Words(cut, {b"one": 5})
    assert [len(x) for x in known.told(np.zeros(0, dtype=np.int64))] == [0, 0, 0]
    for _ in range(2):  # the arrays grow between two questions
        numbers = np.array([known[w] for w in (b"one", b"\xff", b"antidisestablishment", b"one")])
        count, n_pieces, ids = known.told(numbers)
        assert count.tolist() == [5, -1, -1, 5] and ids.tolist() == cut(b"one") + cut(b"\xff") + cut(b"antidisestablishment") + cut(b"one")
        assert n_pieces.sum() == len(ids)
        known[f"more{len(known)}".encode()]
