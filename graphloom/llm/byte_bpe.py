"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a piece of the corpus are laid out as one chain of symbols. An inverted index takes each
pair of neighbouring tokens to the places where it stands; merges are taken in rank order from a heap, each is applied
to all its places at once, and only the touched neighbours enter the index anew.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import arrays
from graphloom.llm.common import append_columns
from graphloom.llm.pretokens import split

#: Distinct pre-tokens whose ids a task keeps between pieces, and pairs of tokens whose rank it keeps, at most; with
#: the task they go.
CACHE_WORDS, CACHE_PAIRS = 250_000, 400_000


class ByteBpe:
    """The merges of a rank file: lines of a base64 token and its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.pair_rank: dict[int, int] = {}
        self.cache: dict[int, bytes] = {}

    def forget(self) -> None:
        self.cache, self.pair_rank = {}, {}

    def _rank(self, a: int, b: int) -> int:
        """The rank of the token that a and b make; -1 if there is none."""
        key = a << 32 | b
        found = self.pair_rank.get(key)
        if found is None:
            found = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
            if len(self.pair_rank) < CACHE_PAIRS:
                self.pair_rank[key] = found
        return found

    @functools.cached_property
    def _byte_pairs(self) -> np.ndarray:
        """Ranks of all pairs of single bytes."""
        return np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: every merge applied in rank order to all its places, from left to right."""
        out: list[list[int]] = [[] if (whole := self.ranks.get(w)) is None else [whole] for w in words]
        todo = [i for i, ids in enumerate(out) if not ids and words[i]]
        if not todo:
            return out
        raw = np.frombuffer(b"".join(words[i] for i in todo), np.uint8)
        lengths = np.fromiter((len(words[i]) for i in todo), np.int64, len(todo))
        ends = np.cumsum(lengths)
        first = np.append(self._byte_pairs[raw[:-1], raw[1:]], -1)
        first[ends - 1] = -1  # no pair crosses words
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        present, begin = np.unique(first[places], return_index=True)
        index: dict[int, list[int]] = dict(zip(present.tolist(), (x.tolist() for x in np.split(places, begin[1:])), strict=False)) if len(places) else {}
        heap: list[int] = list(index)  # ascending, so a heap
        symbols: list[int] = np.array(self.single)[raw].tolist()
        n = len(symbols)
        after = np.arange(1, n + 1)
        after[ends - 1] = n
        before = np.arange(-1, n - 1)
        before[ends - lengths] = -1
        after, before = after.tolist(), before.tolist()
        symbols.append(-1)
        known, rank, push, pop = self.pair_rank.get, self._rank, heapq.heappush, heapq.heappop
        while heap:
            r = pop(heap)
            places = index.pop(r)
            places.sort()
            for at in places:
                a, right = symbols[at], after[at]
                b = symbols[right]
                if a < 0 or b < 0:
                    continue
                now = known(a << 32 | b)
                if (rank(a, b) if now is None else now) != r:
                    continue  # an earlier merge has touched this place
                symbols[at], symbols[right] = r, -1
                after[at] = beyond = after[right]
                if beyond < n:
                    before[beyond] = at
                    key = r << 32 | symbols[beyond]
                    made = known(key)
                    if made is None:
                        made = rank(r, symbols[beyond])
                    if made >= 0:
                        if made in index:
                            index[made].append(at)
                        else:
                            index[made] = [at]
                            push(heap, made)
                left = before[at]
                if left >= 0:
                    key = symbols[left] << 32 | r
                    made = known(key)
                    if made is None:
                        made = rank(symbols[left], r)
                    if made >= 0:
                        if made in index:
                            index[made].append(left)
                        else:
                            index[made] = [left]
                            push(heap, made)
        final = np.array(symbols[:-1])
        at = np.flatnonzero(final >= 0)
        cuts = np.searchsorted(at, ends).tolist()
        ids, low = final[at].tolist(), 0
        for i, high in zip(todo, cuts, strict=True):
            out[i] = ids[low:high]
            low = high
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and n + 1 offsets."""
        begin, end = split(data, offsets, spaced=True)
        if not len(begin):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = arrays.spans_hash(arrays.bytes_prefix(data), begin, end)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        raw = data.tobytes()
        coded = [self.cache.get(h) for h in keys]
        new = [k for k, found in enumerate(coded) if found is None]
        for k, ids in zip(new, self.replay([raw[begin[first[k]] : end[first[k]]] for k in new]), strict=True):
            coded[k] = np.array(ids, np.uint32).tobytes()
        # the most frequent ones first
        room = CACHE_WORDS - len(self.cache)
        if room > 0 and new:
            times = np.bincount(which, minlength=len(keys))[new]
            for j in np.argsort(-times, kind="stable")[:room].tolist():
                self.cache[keys[new[j]]] = coded[new[j]]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), np.uint32)
        starts = np.cumsum(lengths) - lengths
        ids = flat[arrays.ragged(starts[which], lengths[which])]
        ends = np.concatenate([[0], np.cumsum(lengths[which])])
        return ids, ends[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' tokens, one after another."""
        return self.token_bytes[arrays.ragged(self.token_starts[ids], self.token_lengths[ids])]


@functools.lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_texts(bpe: ByteBpe, texts: Iterable[str]) -> list[list[int]]:
    """Plain interface: the ids of each text."""
    ids, offsets = bpe.encode(*arrays.buffer(pa.array(list(texts), pa.string())))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def encode_documents(docs: DataFrame, vocabulary: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves (``ids array<int>``).

    Each pre-token is encoded separately, without special tokens; the ids are then decoded. No shuffle: every task
    works on its own pieces, so a hot source or very long texts only make more pieces.
    Null and empty texts have no tokens and the hash of nothing. Repeated rows, null ids and further columns pass
    through; columns with the result's names are replaced. An empty table gives an empty one.
    A piece whose decoded bytes differ from its text (two pre-tokens with one 64-bit hash) is encoded again, document
    by document, without the shared hash.
    """

    def make():
        bpe = load(vocabulary)
        bpe.forget()

        def run(texts: pa.Array) -> dict[str, pa.Array]:
            data, offsets = arrays.buffer(texts)
            ids, at = bpe.encode(data, offsets)
            decoded = bpe.decode(ids)
            if not np.array_equal(decoded, data):
                begin, end = split(data, offsets, spaced=True)
                raw = data.tobytes()
                each = bpe.replay([raw[a:b] for a, b in zip(begin, end, strict=True)])
                ids = np.array([x for y in each for x in y], np.uint32)
                ends = np.concatenate([[0], np.cumsum([len(y) for y in each], dtype=np.int64)])
                at, decoded = ends[np.searchsorted(begin, offsets)], bpe.decode(ids)
            where = np.concatenate([[0], np.cumsum(bpe.token_lengths[ids])])[at]
            id_bytes, text_bytes = memoryview(ids.astype("<u4").tobytes()), memoryview(decoded.tobytes())
            out = {
                "n_tokens": pa.array(np.diff(at), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(id_bytes[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(text_bytes[a:b]).hexdigest() for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)], pa.string()),
            }
            if keep_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            return out

        return run

    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "array<int>")] * keep_ids
    return append_columns(docs, make, fields, text_col, piece_bytes=2 << 20, done=lambda: load(vocabulary).forget())
