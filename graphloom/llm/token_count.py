"""Token counts of a word-end BPE by rank-synchronous array merging.

Pre-tokens are held as ragged numpy arrays of symbols. In each round the lowest-ranked neighbouring pair of every
sequence (the leftmost of equal ones) is merged, in all sequences at once; sequences without a pair left drop out. The
symbols that survive are the tokens.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import arrays
from graphloom.llm.common import append_columns
from graphloom.llm.pretokens import split

#: Distinct pre-tokens whose counts a task keeps, at most; with the task they go.
CACHE_WORDS = 200_000
NONE = np.int64(1) << 40


def byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The normaliser's settings, special tokens and merges of a tokenizer file with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        signs = byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + suffix] for s in signs], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        results = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.results = keys[order], order.astype(np.int64), results
        self.cache: dict[int, int] = {}

    def forget(self) -> None:
        self.cache = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; NONE where there is no merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Surviving symbols of each pre-token data[start:start + length]."""
        counts = np.maximum(lengths, 0).astype(np.int64)
        flat = arrays.ragged(starts, lengths)
        symbols = self.inner[data[flat]]
        ends = np.cumsum(lengths)
        has = lengths > 0
        symbols[ends[has] - 1] = self.last[data[flat[ends[has] - 1]]]
        alive = np.flatnonzero(lengths > 1)
        keep = np.repeat(lengths > 1, lengths)
        symbols, sizes = symbols[keep], lengths[alive]
        ranks = None
        while len(alive):
            begin = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            if ranks is None:
                ranks = np.full(len(symbols), NONE)
                ranks[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
                ranks[begin + sizes - 1] = NONE
            least = np.minimum.reduceat(ranks, begin)
            going = least < NONE
            # the leftmost place of the least rank in each sequence that has one
            hit = np.flatnonzero((ranks == least[owner]) & going[owner])
            first = np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]]) if len(hit) else np.empty(0, bool)
            hit = hit[first]
            symbols[hit] = self.results[ranks[hit]]
            counts[alive[going]] -= 1
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            ranks[hit] = NONE
            sizes = sizes - going
            stay_sequence = going & (sizes > 1)
            stay = ~gone & stay_sequence[owner]
            touched = np.zeros(len(symbols), np.int8)
            touched[hit] = 1
            symbols, ranks, owner, touched = symbols[stay], ranks[stay], owner[stay], touched[stay]
            alive, sizes = alive[stay_sequence], sizes[stay_sequence]
            if not len(alive):
                break
            ends = np.cumsum(sizes)
            final = np.zeros(len(symbols), bool)
            final[ends - 1] = True
            at = np.flatnonzero(touched)
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            ranks[again] = NONE
            again = again[~final[again]]
            ranks[again] = self.pair_ranks(symbols[again], symbols[again + 1])
        return counts

    def normal(self, text: str) -> str:
        """NFC, then each character in lower case by itself. White space is left: it only separates."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # no word-final form
        return text.lower()

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, special strings inside it as the special tokens they name."""
        plain, extra = [], np.zeros(len(texts), np.int64)
        bounds = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            parts = self.specials.split(text) if self.specials and "<|" in text else [text]
            extra[i] = len(parts) - 1
            plain.extend(map(self.normal, parts))
            bounds[i + 1] = len(plain)
        data, offsets = arrays.buffer(pa.array(plain, pa.large_string()))
        begin, end = split(data, offsets, spaced=False)
        hashes = arrays.spans_hash(arrays.bytes_prefix(data), begin, end)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        cache = self.cache
        found = [cache.get(h, 0) for h in keys]
        new = np.flatnonzero(np.array(found, np.int64) == 0)
        counts = np.array(found, np.int64)
        if len(new):
            counts[new] = self.merge(data, begin[first[new]], (end - begin)[first[new]])
        room = CACHE_WORDS - len(cache)
        if room > 0 and len(new):  # the most frequent ones first
            times = np.bincount(which, minlength=len(keys))[new]
            chosen = new[np.argsort(-times, kind="stable")[:room]]
            cache.update(zip(distinct[chosen].tolist(), counts[chosen].tolist(), strict=True))
        sums = np.concatenate([[0], np.cumsum(counts[which])])
        per_part = np.diff(sums[np.searchsorted(begin, offsets)])
        parts = np.concatenate([[0], np.cumsum(per_part)])
        return np.diff(parts[bounds]) + extra


@functools.lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, text_col: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    No begin, end or added special tokens, no truncation; special strings in a text count as the special token. No
    shuffle. Null counts as empty: no bytes, no tokens. Repeated rows, null ids and further columns pass through;
    columns with the result's names are replaced. An empty table gives an empty one.
    """

    def make():
        bpe = load(vocabulary)
        bpe.forget()

        def run(texts: pa.Array) -> dict[str, pa.Array]:
            _, offsets = arrays.buffer(texts)
            counts = bpe.count([t or "" for t in texts.to_pylist()])
            return {"n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array(counts > limit)}

        return run

    return append_columns(docs, make, [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")], text_col, piece_bytes=2 << 20, done=lambda: load(vocabulary).forget())
