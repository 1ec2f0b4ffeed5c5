"""Removal of repeats and near copies against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import arrays, exchange, near_dedup, substring_dedup, suffix_dedup

LAST = 1 << 62


def _words(text):
    return (text or "").encode().split()


def _removed_words(rows, size=50):
    first = {}
    for doc_id, text, *_ in rows:
        w = _words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, LAST + 1), LAST if doc_id is None else doc_id)
    out = []
    for doc_id, text, *_ in rows:
        w, keep = _words(text), None
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (LAST if doc_id is None else doc_id):
                keep[i : i + size] = [False] * size
        left = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((-1 if doc_id is None else doc_id, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out)


def test_repeated_passages(docs, rows, none):
    out = substring_dedup.remove_repeats(docs.withColumnRenamed("source", "kept_text"))
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "n_words", "n_removed", "kept_sha256", "kept_text"]
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect())
    assert found == _removed_words(rows)
    assert sum(f[2] for f in found) > 1000
    assert substring_dedup.remove_repeats(none).count() == 0


def _wide(spark):
    """Short texts that repeat a passage, and 60 MB beside them in four blocks: what a block returns takes several batches."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, f"{passage} " + " ".join(f"d{d}x{i}" for i in range(30))) for d in range(60)]
    frame = spark.range(60).selectExpr("id as doc_id", f"concat('{passage} ', array_join(transform(sequence(0, 29), i -> concat('d', id, 'x', i)), ' ')) as text", "repeat('y', 1 << 20) as further")
    return rows, frame


def test_repeated_passages_of_large_blocks(spark):
    rows, frame = _wide(spark)
    out = substring_dedup.remove_repeats(frame).selectExpr("doc_id", "n_words", "n_removed", "kept_sha256", "length(further) as size").collect()
    assert sorted(tuple(r)[:4] for r in out) == _removed_words(rows) and {r.size for r in out} == {1 << 20}


def test_automata_locate_all_occurrences_over_shards():
    tiles = np.array([[1, 2, 3], [2, 3, 4], [9, 9, 9]])
    text = np.array([1, 2, 3, 4, 9, 9, 9, 9, 1, 2, 3])
    found = [list(zip(*(x.tolist() for x in substring_dedup.occurrences(machine, text)), strict=True)) for machine in substring_dedup.automata(tiles, shard=2)]
    assert found == [[(2, 0), (3, 1), (10, 0)], [(6, 2), (7, 2)]]


def test_automata_decide(docs, rows, monkeypatch):
    """Without what the automata locate nothing but whole copies is removed."""
    monkeypatch.setattr(substring_dedup, "occurrences", lambda machine, numbers: (np.empty(0, np.int64),) * 2)
    assert sum(r.n_removed for r in substring_dedup.remove_repeats(docs).collect()) < sum(x[2] for x in _removed_words(rows))


def test_words_decide_where_hashes_clash(monkeypatch):
    left, right = [f"a{i}" for i in range(120)], [f"a{i}" for i in range(120)]
    right[60] = "other"
    one, other = (substring_dedup._Words(*arrays.buffer(pa.array([" ".join(x)]))) for x in (left, right))
    assert list(substring_dedup._verified(one, 0, other, 0, 120)) == [(0, 60), (61, 120)]


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 3, 400).astype(np.uint64)
    sums = arrays.prefix(arrays.mix(items + np.uint64(1)))
    offsets = np.array([0, 150, 150, 190, 400])
    hashes = arrays.windows_hash(sums, 5)
    found = set(arrays.anchors(hashes, offsets, 20, 5).tolist())
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        for s in range(a, b - 20 + 1):
            least = min(range(s, s + 16), key=lambda i: (hashes[i], i))
            assert least in found


def _removed_bytes(rows, size=100):
    """Earlier: by id (null last), then the text's place among the rows of one id; repeated rows are one."""
    distinct = sorted({(LAST if d is None else d, t or "") for d, t, *_ in rows})
    seen, out = set(), {}
    for key in distinct:
        data = key[1].encode()
        keep = np.ones(len(data), bool)
        for i in range(len(data) - size + 1):
            w = data[i : i + size]
            if w in seen:
                keep[i : i + size] = False
            seen.add(w)
        gone = ~keep
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        left = np.frombuffer(data, np.uint8)[keep].tobytes()
        out[key] = (len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest())
    return out


def test_repeated_bytes(docs, rows, none):
    out = suffix_dedup.remove_repeats(docs)
    expected = _removed_bytes(rows)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[LAST if r.doc_id is None else r.doc_id, r.text or ""], r.doc_id
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeated_bytes_of_large_blocks(spark):
    rows, frame = _wide(spark)
    out = suffix_dedup.remove_repeats(frame).selectExpr("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "length(further) as size").collect()
    expected = _removed_bytes(rows)
    assert len(out) == len(rows) and {r.size for r in out} == {1 << 20}
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id, r.text] for r in out)


def test_hot_anchors_are_split_without_loss(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", 2)
    some = [r for r in rows if r[0] is not None]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    expected = _removed_bytes(some)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id, r.text or ""] for r in out.collect())


def test_no_anchor_gathers_a_hot_passage(spark, monkeypatch):
    """A passage of 110 bytes in a third of the documents, with other bytes around it each time."""
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", 3)
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    passage = letters(110)
    rows = [(d, letters(150) + (passage if d % 3 == 0 else letters(110)) + letters(150)) for d in range(600)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    marked, first, codes, blocks = exchange.prepared(frame, "doc_id", "text")
    kept = {}

    def contexts(*args):
        kept["contexts"] = out = _contexts(*args)
        return out

    _contexts = suffix_dedup._contexts
    monkeypatch.setattr(suffix_dedup, "_contexts", contexts)
    out = suffix_dedup.remove_repeats(frame).collect()
    expected = _removed_bytes(rows)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id, r.text] for r in out)
    assert sum(r.n_removed > 0 for r in out) == 199
    most = kept["contexts"].groupBy("key").count().agg({"count": "max"}).first()[0] or 0
    assert most <= blocks


@pytest.mark.parametrize("hot", [2, 64])
def test_texts_of_one_id_do_not_remove_each_other(spark, monkeypatch, hot):
    """Earlier: under a smaller id, or before in the same text."""
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    rng = np.random.default_rng(7)
    letters = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    rows = []
    for d in (None, -5, 3, 9):
        x, y = letters(180), letters(150)
        rows += [(d, x + letters(40)), (d, x + letters(70)), (d, letters(30) + x), (d, y + letters(20) + y + letters(20) + y), (d, letters(9) + y)]
    rows += [(20, rows[6][1]), (21, letters(30) + rows[1][1]), (21, letters(10) + rows[6][1] + letters(60)), (21, letters(10) + rows[6][1] + letters(50)), (21, rows[5][1])]
    rows += [rows[7], rows[8]]
    first, expected = {}, []
    for d, text in rows:
        for i in range(len(text) - 99):
            first[text[i : i + 100]] = min(first.get(text[i : i + 100], math.inf), math.inf if d is None else d)
    for d, text in rows:
        gone, own = np.zeros(len(text) + 1, bool), set()
        for i in range(len(text) - 99):
            w = text[i : i + 100]
            if first[w] < (math.inf if d is None else d) or w in own:
                gone[i : i + 100] = True
            own.add(w)
        left = "".join(c for c, g in zip(text, gone, strict=False) if not g)
        expected.append((d, len(text), len(text) - len(left), int((gone[:-1] & ~gone[np.arange(-1, len(text) - 1)]).sum()), hashlib.sha256(left.encode()).hexdigest()))
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_deep_shallow_sorts(seed):
    rng = np.random.default_rng(seed)
    matrix = rng.integers(0, 2 + seed, (300, 32)).astype(np.uint8)
    matrix[100:200] = matrix[0]
    matrix[150:180, 30] = 7
    order, common = suffix_dedup.deep_shallow(matrix)
    rows = [matrix[i].tobytes() for i in range(300)]
    assert [rows[i] for i in order] == sorted(rows)
    for k in range(1, 300):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert common[k] == next((i for i in range(32) if a[i] != b[i]), 32)


def _shingles(text):
    w = [x.lower() for x in _words(text)]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_copies(docs, rows, none):
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    texts = {LAST if d is None else d: t for d, t, *_ in rows if t is not None}  # one text is without an id
    sets = {d: _shingles(t) for d, t in texts.items()}
    n = len({t for t in texts.values()})
    df = Counter(s for t in set(texts.values()) for s in _shingles(t))
    idf = {s: min(1.0, np.log1p(n / k) / np.log1p(1000)) ** (1 / 3) for s, k in df.items()}
    label = {d: d for d in texts}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = sum(min(sets[a][s], sets[b][s]) * idf[s] for s in sets[a] if s in sets[b])
            either = sum(v * idf[s] for s, v in (sets[a] | sets[b]).items())
            if texts[a] == texts[b] or (either and both / either >= 0.8):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    for r in got:
        own = [t for d, t, *_ in rows if d == r.doc_id and (t is None) == (r.text_md5 is None)][0]
        assert r.class_id == (r.doc_id if own is None else top(LAST if r.doc_id is None else r.doc_id)), r.doc_id
        assert r.kept == (own is None or r.class_id == r.doc_id)
    assert sum(r.kept for r in got) < len(got) - 15
    assert near_dedup.classes(none).count() == 0


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    shared, left, right = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (160, 20, 20))
    a, b = np.sort(np.concatenate([shared, left])), np.sort(np.concatenate([shared, right]))
    weight = {int(h): float(w) for h, w in zip(np.concatenate([shared, left, right]), rng.uniform(0.2, 3, 200), strict=True)}
    wa, wb = (np.array([weight[int(h)] for h in x]) for x in (a, b))
    doc = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    _, samples = near_dedup.consistent_samples(doc, np.concatenate([a, b]), np.concatenate([wa, wb]), 3000)
    common = sum(weight[int(h)] for h in shared)
    assert abs((samples[0] == samples[1]).mean() - common / (wa.sum() + wb.sum() - common)) < 0.03


def _family(n, pairs):
    """Texts of one template at about 0.5 to 0.75 of each other, and some with one near copy each."""
    rng = np.random.default_rng(3)
    shared = [f"s{i}" for i in range(400)]
    texts = {}
    for d in range(n):
        own = [f"d{d}x{i}" for i in range(int(rng.integers(50, 90)))]
        texts[d] = " ".join([*shared, *own])
        if d < pairs:
            texts[10_000 + int(rng.integers(0, 10**9))] = " ".join([*shared, *own[:-2], f"e{d}", f"f{d}"])
    return texts


def test_exact_join_finds_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 7)
    texts = _family(60, 15)
    frame = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(2)
    frequent, _ = near_dedup.frequencies(frame, near_dedup.Sampling())
    waiting = frame.selectExpr("id", "id as label")
    found = near_dedup._exact(waiting, frame, frequent, near_dedup.Sampling()).collect()
    ids = sorted(texts)
    expected = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if near_dedup.similarity(texts[a], texts[b], frequent, 5) >= 0.8}
    assert {(r.u, r.v) for r in found} == expected and len(found) == len(expected) >= 15


def test_prefixes_hold_shared_shingles_only(spark, tmp_path):
    """Many texts with their own shingles each, of which a table of counts of one size would take some for shared."""
    own = lambda d, n: [f"d{d}x{i}" for i in range(n)]
    rows = [(d, d, " ".join(own(d, 3000))) for d in range(400)]
    rows += [(1000 + d, 1000, " ".join([*own("same", 40), f"e{d}"])) for d in range(5)]  # of one label
    rows += [(2000 + d, 2000 + d, " ".join([*own("like", 40), f"e{d}"])) for d in range(5)]
    spark.createDataFrame(rows, "id long, label long, text string").repartition(3).write.parquet(f"{tmp_path}/t")
    frame, settings = spark.read.parquet(f"{tmp_path}/t"), near_dedup.Sampling()
    frequent = near_dedup.Frequent(np.empty(0, np.uint64), np.empty(0, np.int64), len(rows), settings)
    found = near_dedup._prefixes(frame, frequent, settings).collect()
    assert {r.id for r in found} == {2000 + d for d in range(5)}
    # 37 shingles, of which the one that ends in the text's own word comes first
    assert len(found) == 5 * 7 and {r.whole for r in found} == {37}
