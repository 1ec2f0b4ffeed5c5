"""The stages over a small corpus, each against a brute-force version of its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import tiktoken

from graphloom.llm import byte_bpe, language_id

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    long = next(t for d, t, *_ in rows if d == 800).split()
    spark.createDataFrame([(1, " ".join(long[40:70])), (2, next(t for d, t, *_ in rows if d == 700))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What goes into each stage and what comes out, as rows; and the last stage's result."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns
        made.write.parquet(f"{folder}/stage{k}")
        after = spark.read.parquet(f"{folder}/stage{k}")
        out.append(([tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()]))
        docs = after
    out.append(([tuple(r) for r in docs.collect()], corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()))
    return out


def _key(row):
    return tuple("" if x is None else str(x) for x in row)


def _same(found, expected):
    assert sorted(map(_key, found)) == sorted(map(_key, expected))


def test_language(spark, folder, stages):
    before, after = stages[0]
    network = language_id.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    expected = []
    for r in before:
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        if any(c.isalpha() for c in r[1] or "") and network.pooled(data, np.array([0, len(data)])).max() >= corpus_pipeline.LEAST_LANGUAGE:
            expected.append(r)
    _same(after, expected)


def test_near_duplicates(stages):
    before, after = stages[1]
    texts = {r[1] for r in before}
    first = {t: min((2**62 if r[0] is None else r[0]) for r in before if r[1] == t) for t in texts}
    sets = {}
    for t in texts:
        w = [x.translate(LOWER) for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        sets[t] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    df = Counter(s for t in texts for s in sets[t])
    idf = {s: min(1.0, np.log1p(len(texts) / k) / np.log1p(1000)) ** (1 / 3) for s, k in df.items()}
    order = sorted(texts, key=lambda t: (first[t], t))
    label = {t: t for t in texts}

    def top(t):
        while label[t] != t:
            t = label[t]
        return t

    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            both = sum(min(sets[a][s], sets[b][s]) * idf[s] for s in sets[a] if s in sets[b])
            either = sum(v * idf[s] for s, v in (sets[a] | sets[b]).items())
            if either and both / either >= 0.8:
                x, y = sorted((top(a), top(b)), key=order.index)
                label[y] = x
    _same(after, {r for r in before if top(r[1]) == r[1] and (2**62 if r[0] is None else r[0]) == first[r[1]]})


def test_repeated_passages(stages):
    before, after = stages[2]
    first = {}
    number = lambda r: 2**62 if r[0] is None else r[0]
    words = {r: [x for x in re.split(r"[\x20\x09-\x0D]+", r[1]) if x] for r in before}
    for r in before:
        for i in range(len(words[r]) - 49):
            key = tuple(words[r][i : i + 50])
            first[key] = min(first.get(key, 2**63), number(r))
    expected = []
    for r in before:
        keep = [True] * len(words[r])
        for i in range(len(words[r]) - 49):
            if first[tuple(words[r][i : i + 50])] < number(r):
                keep[i : i + 50] = [False] * 50
        if all(keep):
            expected.append(r)
        elif any(keep):
            text = " ".join(w for w, k in zip(words[r], keep, strict=True) if k)
            expected.append((r[0], text, r[2], r[3], len(text)))
    _same(after, expected)


def test_repeated_passages_of_large_blocks(spark):
    """What a block returns takes several batches: 60 MB beside the texts in four blocks."""
    passage = " ".join(f"p{i}" for i in range(60))
    frame = spark.range(60).selectExpr("id as doc_id", f"concat('{passage} d', id) as text", "repeat('y', 1 << 20) as further")
    out = corpus_pipeline.repeated_passages(spark, frame, "").selectExpr("doc_id", "text", "length(further) as size").collect()
    assert sorted(tuple(r) for r in out) == [(d, f"d{d}" if d else f"{passage} d0", 1 << 20) for d in range(60)]


def test_benchmark(spark, folder, stages):
    before, after = stages[3]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    expected = []
    for r in before:
        w, hit = words(r[1]), set()
        for i in range(len(w) - 12):
            if tuple(w[i : i + 13]) in windows:
                hit |= set(range(i, i + 13))
        if not hit or 20 * len(hit) < len(w):
            expected.append(r)
    _same(after, expected)


def test_encoding(stages):
    before, after = stages[4]
    path = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.load(path)
    library = tiktoken.Encoding("plain", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = Counter((r[0], r[1]) for r in before)
    found = Counter()
    for r in after:
        text = bpe.decode(np.array(r.ids, np.int64)).tobytes().decode()
        assert list(r.ids) == library.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        found[r.doc_id, text] += 1
    assert found == texts and len(after) > 20


def test_run_is_the_stages(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder).collect()
    _same([(r.doc_id, r.ids_sha256) for r in got], [(r.doc_id, r.ids_sha256) for r in stages[4][1]])


def test_stages_take_empty_tables_and_clashing_columns(spark, folder, none):
    docs = none.withColumnsRenamed({"source": "n_words", "n_chars": "score"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
