"""Decontamination, license scans, language models, language ID and quality against plain re-computations."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import decontamination, elias_fano, exchange, language_id, license_scan, lm_score, quality_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def alnum_words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_decontamination(spark, docs, rows, none):
    passage = next(t for d, t, *_ in rows if d == 0).split()
    items = [(1, " ".join(passage[-30:-5])), (2, "a"), (10, None), (3, "zz zz zz"), (None, "a b"), (4, " ".join(passage[-30:-5]).upper()), (5, "!!!"), (6, "edit3"), (7, "İΣ ǅ")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontamination.decontaminate(docs.withColumnRenamed("source", "n_hit"), bench)
    expected = []
    for doc_id, text, *_ in rows:
        w, hit, found = alnum_words(text), set(), set()
        for item, t in items:
            x = alnum_words(t)
            if item is None or not x:
                continue
            n = min(13, len(x))
            for s in range(len(x) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        expected.append((-1 if doc_id is None else doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()]
    assert sorted(got) == sorted(expected)
    assert sum(g[5] for g in got) > 3
    assert decontamination.decontaminate(none, bench).count() == 0
    clean = decontamination.decontaminate(docs, bench.limit(0))
    assert clean.where("n_hit > 0 or contaminated").count() == 0 and clean.count() == len(rows)


def test_license_scan(spark, docs, rows, none):
    more = [(900, "x\nReleased under the MIT License.\ny", "en", "s", 1), (901, "cc by CC-BY all rights reserved; General Public License", "en", "s", 1), (902, "released under\nthe mit license", "en", "s", 1), (903, "cc\nby", "en", "s", 1)]
    out = license_scan.scan(docs.unionByName(spark.createDataFrame(more, docs.schema)))
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    for doc_id, text, *_ in [*rows, *more]:
        if doc_id is None:
            continue
        w, places, labels = alnum_words(text), [], set()
        for phrase, label in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1
    assert got[900].labels == "mit" and got[901].labels == "cc-by,gpl,reserved" and got[902].labels == "" and got[903].base_labels == "cc-by"
    assert license_scan.scan(none).count() == 0


def test_wrapped_notices(spark, tmp_path):
    from graphloom.llm.queries import op5_license_scan

    notices = {
        "mit": "x y\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated",
        "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided",
        "mpl-2.0": "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy",
        "": "redistribution and use in source and binary\n" + "word " * 12 + "\nforms with or without modification are permitted",
    }
    more = [("public-domain", "this work is dedicated\n\nto the public domain"), ("", "this work is dedicated"), ("", "to the public domain"), ("", None), ("", "")]
    rows = [*notices.items(), *more]
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.labels, r.score) for r in op5_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(rows))] == [(label, 1.0 if label else 0.0) for label, _ in rows]


def test_prefix_and_bounds_lose_no_block(spark):
    templates = {"a b c d e f g h i j": "x", "c d k": "y"}
    lines = ["a b c d e f g h z z", "a b c d e f g h i", "k d c", "c d", "j i h g f e d c b a k"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs, templates, containment=0.8).collect()}
    for i, line in enumerate(lines):
        words = set(line.split())
        assert got[i] == ",".join(sorted(label for t, label in templates.items() if len(words & set(t.split())) >= math.ceil(0.8 * len(set(t.split())))))


def _model(texts, held):
    """Log10 probability of each text by its definition, the counts, and the probability of a word after two others."""
    tokens = [[*((t or "").translate(LOWER).encode().split()), None] for t in texts]
    one, two, three = Counter(), Counter(), Counter()
    for h, w in zip(held, tokens, strict=True):
        if not h:
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    n, v, mu = sum(one.values()), len(one), lm_score.PRIOR_TOKENS
    first = lambda x: (one[x] + 1) / (n + v + 1)
    second = lambda a, x: (two[a, x] + mu * first(x)) / (one[a] + mu)
    third = lambda a, b, x: (three[a, b, x] + mu * second(b, x)) / (two[a, b] + mu)
    logs = [sum(math.log10(first(x) if i == 0 else second(w[0], x) if i == 1 else third(w[i - 2], w[i - 1], x)) for i, x in enumerate(w)) for w in tokens]
    return tokens, one, first, third, logs


def test_language_model(docs, rows, none):
    got = lm_score.score(docs.withColumnRenamed("source", "n_tokens").withColumnRenamed("lang", "score")).collect()
    held = [zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, *_ in rows]
    tokens, one, first, third, logs = _model([t for _, t, *_ in rows], held)
    n = sum(one.values())
    expected = [(-1 if d is None else d, h, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(first(x)) for x in w), m) for (d, *_), h, w, m in zip(rows, held, tokens, logs, strict=True)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for g, e in zip(got, sorted(expected), strict=True):
        assert g[:5] == e[:5]
        assert g[5] == pytest.approx(e[5]) and abs(g[6] - e[6]) < 1e-3 * e[2]  # quantised
    assert lm_score.score(none).count() == 0
    # one unknown word has the rest of the unigram distribution
    for a, b in [*zip(tokens[1][:3], tokens[1][1:4], strict=True)]:
        assert sum(third(a, b, x) for x in [*one, b"never seen"]) == pytest.approx(1)


def test_counts_of_many_blocks_are_added(spark):
    """Each block gets the sums of all, of every order, whichever blocks have trained."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 300) % 500) for _ in range(40)]
    held = [i % 3 == 0 for i in range(40)]
    codes = [exchange.Codes(5, width) for width in lm_score.WIDTHS]
    table = lambda b: pa.table({exchange.TEXT: pa.array(texts[b::5]), "held_out": pa.array(held[b::5]), exchange.BLOCK: pa.array([b] * 8, pa.int32())})
    sent = pa.concat_tables([lm_score._send(b, lm_score._Block(table(b), codes, False), codes) for b in range(5)])
    buckets = np.array(sent["bucket"])
    answers = pa.concat_tables([lm_score._answer(sent.filter(pa.array(buckets == k)), codes) for k in np.unique(buckets)])
    total = Counter()
    for t, h in zip(texts, held, strict=True):
        w = [*t.split(), None]
        if not h:
            total.update((tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)))
    for b in range(5):
        own = lm_score._Block(table(b), codes)
        sums = lm_score._answered(own, answers.filter(pa.array(np.array(answers[exchange.BLOCK]) == b)))
        tokens = [x for t in texts[b::5] for x in [*t.split(), None]]
        for n in range(3):
            for place, got in zip(own.place[n].tolist(), sums[n].tolist(), strict=True):
                assert got == total[tuple(tokens[place - n : place + 1])]


def test_language_model_without_training_rows(spark):
    ids = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    got = lm_score.score(spark.createDataFrame([(d, "a b") for d in ids], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 3, 0, 0, 0.0)] * 3


@pytest.mark.parametrize(("n", "universe"), [(0, 1), (1, 1), (10, 5), (1000, 10**6), (5000, 3), (7, 2**40)])
def test_elias_fano(n, universe, tmp_path):
    values = np.sort(np.random.default_rng(n).integers(0, universe, n))
    coded = elias_fano.EliasFano(values, universe, str(tmp_path / "level"))
    assert coded.get(np.arange(n)).tolist() == values.tolist()
    at, value = coded.successor(np.array([universe // 2]), np.array([0]), np.array([n]))
    assert at[0] == np.searchsorted(values, universe // 2)


def test_trie(tmp_path):
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 300 * 300, 4000))
    context, word, logs, weights = keys // 300, keys % 300, -rng.random(len(keys)) * 10, -rng.random(len(keys))
    deep = np.unique(rng.integers(0, len(keys) * 300, 5000))
    deep_logs = -rng.random(len(deep)) * 10
    unigrams, backoffs = -rng.random(300), -rng.random(300)
    trie = elias_fano.Trie(unigrams, backoffs, [(context, word, logs, weights), (deep // 300, deep % 300, deep_logs, None)], str(tmp_path))
    asked = np.concatenate([rng.integers(0, 300 * 300, 5000), keys[:500]])
    found, place = trie.pair(asked // 300, asked % 300)
    known = {int(k): i for i, k in enumerate(keys)}
    assert place.tolist() == [known.get(int(k), -1) for k in asked]
    expected = [logs[p] if p >= 0 else unigrams[k % 300] + backoffs[k // 300] for k, p in zip(asked.tolist(), place.tolist(), strict=True)]
    assert np.abs(found - expected).max() < 1e-3
    below = {int(k): x for k, x in zip(deep, deep_logs, strict=True)}
    pairs, words = np.concatenate([rng.integers(-1, len(keys), 5000), deep // 300]), np.concatenate([rng.integers(0, 300, 5000), deep % 300])
    shorter = -rng.random(len(pairs))
    got = trie.triple(pairs, words, shorter)
    expected = [below.get(p * 300 + w, s + weights[p]) if p >= 0 else s for p, w, s in zip(pairs.tolist(), words.tolist(), shorter, strict=True)]
    assert np.abs(got - expected).max() < 1e-3

def test_gradients_are_those_of_the_loss():
    network = language_id.Network(["a", "b"], 4, 0, np.float64)
    rng = np.random.default_rng(0)
    codes, valid, labels = rng.integers(0, 256, (6, 8)).astype(np.uint8), np.ones((6, 8), bool), np.array([0, 1, 0, 1, 1, 0])
    grads, _ = network.gradients(codes, valid, labels)
    for i, g in enumerate(grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        steps = []
        for sign in (1, -1):
            network.weights[i][at] += sign * 1e-5
            steps.append(network.gradients(codes, valid, labels)[1])
            network.weights[i][at] -= sign * 1e-5
        assert (steps[0] - steps[1]) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-7)


def test_language_id(spark, none):
    rng = np.random.default_rng(3)
    stems = {"xx": ["the", "and", "of", "ing"], "yy": ["über", "schön", "ung", "der"]}
    data = [(i, " ".join(rng.choice(stems[lang], 40)), lang) for i in range(400) for lang in [["xx", "yy"][i % 2]]]
    data += [(1000, None, "xx"), (1001, "123 !!", "yy"), (1002, "", None), (None, "the of", None), (1003, "the and " * 3000, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.Training(per_language=64, passages=2, epochs=6)).collect()
    assert len(got) == len(data)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "xx"]
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(none).count() == 0


def test_quality(docs, rows, none):
    got = quality_rules.judge(docs, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = [x.decode() for x in (r.text or "").encode().split()]
        thrice = list(zip(w, w[1:], w[2:], strict=False))
        times = Counter(thrice)
        repeated = {p for i, t in enumerate(thrice) if times[t] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(repeated)), r.doc_id
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r.kept and r.base_failed) and 0 <= r.quality <= 1
    assert quality_rules.judge(none).count() == 0


def test_posteriors_follow_votes(spark):
    """Rules that agree are trusted: what they call bad is bad, without labels."""
    rng = np.random.default_rng(0)
    votes = []
    for i in range(2000):
        bad = i % 10 == 0
        votes.append((i, [int(-(rng.random() < (0.7 if bad else 0.002))) for _ in range(5)]))
    model = quality_rules.fit(spark.createDataFrame(votes, "id long, votes array<int>")).first()
    assert model.prior == pytest.approx(0.9, abs=0.03)
    assert all(r[0] < -3 and r[1] >= 0 for r in model.ratios)
