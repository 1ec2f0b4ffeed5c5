"""Language-model scores from an n-gram trie in Elias-Fano code, learned from the corpus itself.

Each block of documents sends the counts of the tokens, pairs and triples it has, from training documents, and asks
for the sums by that; hash buckets add them up and answer. A block then builds the trie of the model restricted to what
can occur in it, so no task holds more of the model than its own documents need, however large the corpus. All n-grams
seen in training are in the model. Each order is Dirichlet-smoothed towards the shorter one, pairs towards the add-one
unigram distribution, so the probabilities after any context sum to 1.

The levels of a trie are anonymous memory maps: executors have no folder of their own to map files from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import arrays, exchange
from graphloom.llm.common import BLOCK, block_count, extended, tidy
from graphloom.llm.elias_fano import Trie
from graphloom.llm.exchange import HASH, ID, TEXT, Codes

#: Weight of the shorter order's distribution in tokens; orders of the model; compressed bytes of a block.
PRIOR_TOKENS, ORDERS, BLOCK_BYTES = 50.0, 3, 3 << 19
#: Bytes of the codes of tokens, pairs and triples below the bucket's bits. Two pairs or triples of a bucket share a
#: code, and then their counts are added, with a chance of 2 ** -40; a bucket holds about a million of them however large
#: the input, so about one n-gram in a million is counted together with another.
WIDTHS = (6, 5, 5)
END = np.uint64(0x5851F42D4C957F2D)
_PAIR, _TRIPLE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each text's words, and n + 1 token offsets."""
    starts, ends, bounds = arrays.words(data, offsets, arrays.WHITE)
    hashes = arrays.words_hash(data, starts, ends, lower=True)
    texts = np.arange(len(bounds))
    out = np.empty(len(hashes) + len(bounds) - 1, np.uint64)
    at = bounds + texts
    is_end = np.zeros(len(out), bool)
    is_end[at[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = hashes
    return out, at


def grams(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the tokens, of the pairs and of the triples that end at each token, and which tokens have one: a list
    of (hashes, places) by order. None crosses texts."""
    place = np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))
    second = np.flatnonzero(place >= 1)
    two = arrays.mix(hashes[second - 1] * _PAIR + hashes[second])
    third = np.flatnonzero(place >= 2)
    three = arrays.mix(arrays.mix(hashes[third - 2] * _PAIR + hashes[third - 1]) * _TRIPLE + hashes[third])
    return [(hashes, np.arange(len(hashes))), (two, second), (three, third)]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and which each value is."""
    if not len(values):
        return values, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def _counted(codes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and how many of each have weight: both in one sort."""
    if not len(codes):
        return codes, np.empty(0, "<u4")
    both = np.sort(codes << np.uint64(1) | weight.astype(np.uint64))
    ordered = both >> np.uint64(1)
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[begin], np.add.reduceat(both & np.uint64(1), begin).astype("<u4")


class _Block:
    """The n-grams of a block's documents: by order the distinct codes, a place of each among the tokens, which each
    token's is, and counts in training documents. Without ``places`` the codes and counts only."""

    def __init__(self, rows: pa.Table, codes: list[Codes], places: bool = True):
        parts = list(exchange.text_pieces(rows, 1 << 20))
        found = [tokens(data, offsets) for _, data, offsets in parts]
        sizes = np.concatenate([np.diff(at) for _, at in found]) if found else np.empty(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        hashes = np.concatenate([h for h, _ in found]) if found else np.empty(0, np.uint64)
        weight = np.repeat(~rows["held_out"].to_numpy(), sizes)
        self.codes, self.place, self.which, self.tokens, self.counts = [], [], [], [], []
        for how, (values, place) in zip(codes, grams(hashes, self.at), strict=True):
            if not places and how.bits + int(how.low) < 64:
                known, counts = _counted(how.of(values), weight[place])
                self.codes.append(known)
                self.counts.append(counts)
                continue
            known, first, which = distinct(how.of(values))
            self.codes.append(known)
            self.place.append(place[first])
            self.which.append(which.astype(np.int32))
            self.tokens.append(place)
            self.counts.append(np.bincount(which[weight[place]], minlength=len(known)).astype("<u4"))


#: ``codes`` and ``more`` hold three arrays each, one for each order; sizes in codes.
ROWS = f"bucket int, {BLOCK} int, sizes array<int>, codes binary, more binary"


def _split(rows: pa.Table) -> list[list[int]]:
    return rows["sizes"].to_pylist()


def _turned(rows: np.ndarray) -> bytes:
    """Rows of bytes with those of one rank side by side: high bytes of differences and counts hardly change, and so
    compress."""
    return np.ascontiguousarray(rows.T).tobytes()


def _bytes(values: np.ndarray, kind: str) -> np.ndarray:
    """Numbers as rows of bytes, the lowest first."""
    return np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)


def _send(block: int, own: _Block, codes: list[Codes]) -> pa.Table:
    """A row for each bucket: of each order the differences of the sorted codes, and the counts."""
    by_bucket: dict[int, list] = {}
    for order, how in enumerate(codes):
        full = own.codes[order]
        if not len(full):
            continue
        present, first = np.unique((full >> how.low).astype(np.int64), return_index=True)
        low = full & ((np.uint64(1) << how.low) - np.uint64(1))
        steps = low.copy()
        steps[1:] -= low[:-1]
        steps[first] = low[first]
        raw, counts = _bytes(steps, "<u8")[:, : how.width], _bytes(own.counts[order], "<u4")
        for bucket, a, b in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(full)], strict=True):
            row = by_bucket.setdefault(bucket, [[0] * ORDERS, [b""] * ORDERS, [b""] * ORDERS])
            row[0][order], row[1][order], row[2][order] = b - a, _turned(raw[a:b]), _turned(counts[a:b])
    chosen = sorted(by_bucket)
    rows = [by_bucket[b] for b in chosen]
    return pa.table({"bucket": pa.array(chosen, pa.int32()), BLOCK: pa.array([block] * len(chosen), pa.int32()), "sizes": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "codes": pa.array([b"".join(r[1]) for r in rows], pa.binary()), "more": pa.array([b"".join(r[2]) for r in rows], pa.binary())})


def _order(sizes: list[list[int]], blobs: list[bytes], order: int, widths: tuple[int, ...]) -> np.ndarray:
    """The part of each blob that belongs to an order, one after another, turned back to rows of bytes."""
    out, width = [], widths[order]
    for n, b in zip(sizes, blobs, strict=True):
        begin = sum(k * w for k, w in zip(n[:order], widths, strict=False))
        out.append(np.frombuffer(b, np.uint8, n[order] * width, begin).reshape(width, -1).T)
    return np.concatenate(out) if out else np.empty((0, width), np.uint8)


def _sums(rows: pa.Table, codes: list[Codes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one order: how often each distinct code stands in training, which each sent code is, the counts sent, and
    how many each row has."""
    sizes = _split(rows)
    raw = _order(sizes, rows["codes"].to_pylist(), order, WIDTHS)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : WIDTHS[order]] = raw
    counts = np.ascontiguousarray(_order(sizes, rows["more"].to_pylist(), order, (4,) * ORDERS)).view("<u4").reshape(-1)
    lengths = np.array([n[order] for n in sizes], np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide.view("<u8").reshape(-1), dtype=np.uint64)])
    known, _, which = distinct(sums[1:] - np.repeat(sums[np.cumsum(lengths) - lengths], lengths))
    return np.bincount(which, weights=counts, minlength=len(known)).astype("<u8"), which, counts, lengths


def _answer(rows: pa.Table, codes: list[Codes]) -> pa.Table:
    """To each block, in the order it sent its codes: a bit for each, set where the sum isn't what it sent, and these
    sums."""
    n = rows.num_rows
    bits, more = [[] for _ in range(n)], [[] for _ in range(n)]
    for order in range(ORDERS):
        sums, which, counts, lengths = _sums(rows, codes, order)
        answer = sums[which]
        other = answer != counts
        ends = np.cumsum(lengths)
        for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
            bits[i].append(np.packbits(other[a:b]).tobytes())
            more[i].append(_turned(_bytes(answer[a:b][other[a:b]], "<u8")))
    return pa.table({"bucket": rows["bucket"], BLOCK: rows[BLOCK], "sizes": rows["sizes"], "codes": pa.array([b"".join(x) for x in bits], pa.binary()), "more": pa.array([b"".join(x) for x in more], pa.binary())})


def _answered(own: _Block, side: pa.Table) -> list[np.ndarray]:
    """The counts of all blocks, of the block's codes by order."""
    side = side.sort_by("bucket")
    out = [counts.astype(np.int64) for counts in own.counts]
    filled = [0] * ORDERS
    for sizes, bits, more in zip(_split(side), side["codes"].to_pylist(), side["more"].to_pylist(), strict=True):
        begin, used = 0, 0
        for order, n in enumerate(sizes):
            length = (n + 7) // 8
            other = np.unpackbits(np.frombuffer(bits[begin : begin + length], np.uint8), count=n).astype(bool)
            begin += length
            k = int(other.sum())
            sums = np.ascontiguousarray(np.frombuffer(more, np.uint8, 8 * k, used).reshape(8, k).T).view("<u8").reshape(-1)
            out[order][filled[order] : filled[order] + n][other] = sums
            used, filled[order] = used + 8 * k, filled[order] + n
    return out


def model(own: _Block, sums: list[np.ndarray], whole: float) -> tuple[Trie, list[np.ndarray]]:
    """The trie of the block's n-grams that stand in training, and of each distinct pair and triple the word numbers:
    (first word, last word) of pairs, (pair, last word) of triples."""
    one, two, three = sums
    number = own.which[0].astype(np.int64)
    last, before = number[own.place[1]], number[own.place[1] - 1]
    pair_of = np.full(len(number), -1, np.int64)  # the pair that ends at each token
    pair_of[own.tokens[1]] = own.which[1]
    third, first_two = number[own.place[2]], pair_of[own.place[2] - 1]
    mu = PRIOR_TOKENS
    p_one = (one + 1) / whole
    p_two = (two + mu * p_one[last]) / (one[before] + mu)
    middle = pair_of[own.place[2]]  # of a triple, the pair of its last two words
    p_three = (three + mu * p_two[middle]) / (two[first_two] + mu)
    seen = np.flatnonzero(two > 0)
    seen = seen[np.lexsort((last[seen], before[seen]))]
    place = np.full(len(two), -1, np.int64)
    place[seen] = np.arange(len(seen))
    # a triple whose code another one shares may have a count and no pair: it isn't in the model
    deep = np.flatnonzero((three > 0) & (place[first_two] >= 0))
    deep = deep[np.lexsort((third[deep], place[first_two[deep]]))]
    levels = [
        (before[seen], last[seen], np.log10(p_two[seen]), np.log10(mu / (two[seen] + mu))),
        (place[first_two[deep]], third[deep], np.log10(p_three[deep]), None),
    ]
    return Trie(np.log10(p_one), np.log10(mu / (one + mu)), levels), [before, last, first_two, third, middle]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """docs with held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows whose crc32 of the id (as text) modulo ``folds`` isn't ``fold``. base_score sums
    log10((c + 1) / (N + V + 1)) over tokens; score is the log10 probability of the text by the trie.
    Null and empty texts have one token, the end. A row with a null id is not held out. Repeated rows count each;
    further columns pass through, columns with the result's names are replaced. An empty table gives an empty one;
    without a training row N and V are 0.
    """
    blocks = block_count(docs, BLOCK_BYTES)
    codes = [Codes(blocks, width) for width in WIDTHS]
    marked = exchange.keyed(docs.withColumn("held_out", held_out(id_col, folds, fold)), blocks, id_col, text_col)

    def send(rows: pa.Table) -> pa.Table:
        return _send(rows[BLOCK][0].as_py(), _Block(rows, codes, False), codes)

    def totals(rows: pa.Table) -> pa.Table:
        sums = _sums(rows, codes, 0)[0]
        return pa.table({"n_distinct": pa.array([int((sums > 0).sum())], pa.int64()), "total": pa.array([int(sums.sum())], pa.int64())})

    sent = marked.groupBy(BLOCK).applyInArrow(tidy(send), ROWS)
    answers = sent.groupBy("bucket").applyInArrow(tidy(lambda rows: _answer(rows, codes)), ROWS)
    # one row, read as a scalar by every answer; the plan makes the exchanges of both once
    known = sent.groupBy("bucket").applyInArrow(tidy(totals), "n_distinct bigint, total bigint").agg(F.struct(F.sum("n_distinct").alias("n_distinct"), F.sum("total").alias("total")).alias("known"))
    side = answers.withColumn("known", known.scalar())

    fields = [("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    schema = extended(T.StructType([f for f in docs.schema.fields if f.name not in {ID, TEXT, HASH, BLOCK}]), fields)
    passed = [f.name for f in schema.fields[: -len(fields)]]

    def judge(rows: pa.Table, side: pa.Table) -> pa.Table:
        own = _Block(rows, codes)
        total = side["known"][0].as_py()
        whole = total["total"] + total["n_distinct"] + 1
        sums = _answered(own, side)
        trie, (before, last, first_two, third, middle) = model(own, sums, whole)
        logs = trie.unigram(own.which[0])
        two, place = trie.pair(before, last)
        logs[own.tokens[1]] = two[own.which[1]]
        logs[own.tokens[2]] = trie.triple(place[first_two], third, two[middle])[own.which[2]]
        n = np.diff(own.at)
        times = sums[0][own.which[0]]
        made = {
            "n_tokens": n, "n_known": np.add.reduceat((times > 0).astype(np.int64), own.at[:-1]), "train_tokens": np.full(len(n), total["total"]),
            "base_score": np.add.reduceat(np.log10(times + 1), own.at[:-1]) - n * np.log10(whole), "score": np.add.reduceat(logs, own.at[:-1]),
        }
        columns = [pa.array(made[name], pa.int64() if kind == "bigint" else pa.float64()) for name, kind in fields[1:]]
        return pa.table([*exchange.passed(rows, passed, text_col), rows["held_out"], *columns], names=schema.names)

    return exchange.per_block(marked, side, judge, schema)
