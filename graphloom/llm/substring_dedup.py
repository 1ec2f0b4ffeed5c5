"""Substring deduplication by repeated-phrase automata.

Every window of 50 words has a phrase of 16 words with the least hash among its phrases; equal windows have the same.
Phrases that recur anywhere are confirmed by an exchange of hashes between blocks, then the windows around them. The
block with the first document of a recurring window publishes it: runs of such windows are passages, whose words go to
the blocks that have some of their windows. A block compiles the passages it gets, wherever they come from, into
Aho-Corasick automata, in shards of bounded size of which one is alive at a time, and streams all its documents through
each. What the automata locate is compared with the passage word by word; runs of 50 words and more are removed.

Streaming every document through the automata of all passages would grow with the square of the input, so hashes tell
which passages a block needs; where they occur is what its automata say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import arrays, exchange
from graphloom.llm.common import BLOCK, extended, tidy
from graphloom.llm.exchange import HASH, ID, ROWS, TEXT

#: Words of a window and of an anchor phrase.
WINDOW, PHRASE = 50, 16
#: Words of a tile of a passage and how far apart tiles start: every window has a whole one. Tiles of one automaton.
TILE, STRIDE, SHARD = 25, 26, 20_000
#: Aligned words that are compared at once.
COMPARED = 1 << 20


def automata(tiles: np.ndarray, shard: int = SHARD) -> Iterator[ahocorasick.Automaton]:
    """Automata over word numbers that know the rows of ``tiles`` by number, ``shard`` of them in each at most; each is
    made when the one before is done with."""
    for start in range(0, len(tiles), shard):
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for number, row in enumerate(tiles[start : start + shard].tolist(), start):
            machine.add_word(tuple(row), number)
        machine.make_automaton()
        yield machine


def occurrences(machine: ahocorasick.Automaton, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tiles of the automaton end in the sequence of word numbers, and which."""
    found = np.array(list(machine.iter(tuple(numbers.tolist()))), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


class _Words:
    """Words of a piece of documents: places, hashes, prefix sums over them, and word offsets of the documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.offsets = arrays.words(data, offsets, arrays.WHITE)
        self.hashes = arrays.words_hash(data, self.starts, self.ends)
        self.sums = arrays.prefix(self.hashes)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        phrases = arrays.windows_hash(self.sums, PHRASE)
        at = arrays.anchors(phrases, self.offsets, WINDOW, PHRASE)
        return at, phrases[at]

    def windows(self, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows that lie in one document (and where ``near`` holds), their hashes, their documents."""
        lo, hi = self.offsets[:-1], self.offsets[1:] - WINDOW + 1
        sizes = np.maximum(hi - lo, 0)
        at, doc = arrays.ragged(lo, sizes), np.repeat(np.arange(len(lo)), sizes)
        if near is not None:
            keep = near[at]
            at, doc = at[keep], doc[keep]
        return at, arrays.windows_hash(self.sums, WINDOW)[at] if len(at) else np.empty(0, np.uint64), doc

    def word(self, at: int) -> bytes:
        return self.data[self.starts[at] : self.ends[at]].tobytes()


class Passages:
    """Passages as sequences of word numbers, and their distinct tiles."""

    def __init__(self, texts: pa.Array, owners: np.ndarray):
        self.words = _Words(*arrays.buffer(texts))
        self.owners, self.offsets = owners, self.words.offsets
        self.vocabulary, self.numbers = np.unique(self.words.hashes, return_inverse=True)
        lengths = np.diff(self.offsets)
        counts = np.maximum((lengths - TILE) // STRIDE + 1, 0)
        which = np.repeat(np.arange(len(lengths)), counts)
        begin = self.offsets[which] + STRIDE * arrays.ragged(np.zeros(len(counts), np.int64), counts)
        rows = self.numbers[begin[:, None] + np.arange(TILE)] if len(begin) else np.empty((0, TILE), np.int64)
        self.tiles, tile = np.unique(rows.astype(np.int32), axis=0, return_inverse=True) if len(rows) else (rows, np.empty(0, np.int64))
        order = np.argsort(tile.reshape(-1), kind="stable")
        self.places, self.owner_of = begin[order], which[order]  # of each tile, one tile after another
        self.bounds = np.searchsorted(tile.reshape(-1)[order], np.arange(len(self.tiles) + 1))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; a word of no passage has a number of its own."""
        has, at = exchange.member(hashes, self.vocabulary)
        return np.where(has, at, len(self.vocabulary)).astype(np.int32)


def _equal_runs(piece: _Words, numbers: np.ndarray, passages: Passages, ends: np.ndarray, tiles: np.ndarray, ids: np.ndarray, use: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of at least a window of a piece's words (from, to) that are words of a passage with a smaller owner, around
    the tiles found. ``ids`` and ``use``: of the piece's documents, and which of them count."""
    counts = np.diff(passages.bounds)[tiles]
    at = arrays.ragged(passages.bounds[:-1][tiles], counts)
    start = np.repeat(ends - TILE + 1, counts)
    which = passages.owner_of[at]
    doc = np.searchsorted(piece.offsets, start, "right") - 1
    shift = start - passages.places[at]
    keep = use[doc] & (ids[doc] > passages.owners[which])
    aligned = np.unique(np.stack([which[keep], doc[keep], shift[keep]], axis=1), axis=0)
    which, doc, shift = aligned.T if len(aligned) else (np.empty(0, np.int64),) * 3
    lo = np.maximum(piece.offsets[doc], passages.offsets[which] + shift)
    size = np.minimum(piece.offsets[doc + 1], passages.offsets[which + 1] + shift) - lo
    keep = size >= WINDOW
    lo, size, shift = lo[keep], size[keep], shift[keep]
    sums = np.cumsum(size)
    first = 0
    while first < len(lo):
        last = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + COMPARED, "right")))
        place = arrays.ragged(lo[first:last], size[first:last])
        other = place - np.repeat(shift[first:last], size[first:last])
        same = numbers[place] == passages.numbers[other]
        edge = np.zeros(len(place) + 1, bool)
        edge[np.concatenate([[0], np.cumsum(size[first:last])])] = True
        begins = np.flatnonzero(same & (edge[:-1] | ~np.concatenate([[False], same[:-1]])))
        stops = np.flatnonzero(same & (edge[1:] | ~np.concatenate([same[1:], [False]]))) + 1
        long = stops - begins >= WINDOW
        for a, b in zip(begins[long].tolist(), stops[long].tolist(), strict=True):
            yield from _verified(piece, int(place[a]), passages.words, int(other[a]), b - a)
        first = last


def _verified(one: _Words, a: int, other: _Words, b: int, size: int) -> Iterator[tuple[int, int]]:
    """The runs, of those words whose hashes agree, in which the words themselves do."""

    def raw(words: _Words, at: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = words.ends[at : at + size] - words.starts[at : at + size]
        return lengths, words.data[arrays.ragged(words.starts[at : at + size], lengths)]

    (n, x), (m, y) = raw(one, a), raw(other, b)
    if np.array_equal(n, m) and np.array_equal(x, y):
        yield a, a + size
        return
    begin = 0
    for k in range(size + 1):
        if k == size or one.word(a + k) != other.word(b + k):
            if k - begin >= WINDOW:
                yield a + begin, a + k
            begin = k + 1


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept_text (kept words joined by a space).

    A word goes if a window of 50 consecutive words that covers it also starts in a document of a smaller id; windows
    are judged on the input. Copies of a whole text follow from its first copy: all their words go, if there are 50.
    Hot passages cost each block one entry; blocks and buckets grow in number with the input. Hashes route, words
    decide: a clash of hashes may only lose a window, as the module of the exchange has it.
    Null and empty texts have no words; a null id counts as larger than any other; rows of one id do not remove each
    other's words. Columns with the result's names are replaced, others pass through. An empty table gives an empty one.
    """
    marked, first, codes, _ = exchange.prepared(docs, id_col, text_col)

    def own(rows: pa.Table, side: pa.Table) -> pa.Table:
        return exchange.one_each(rows, exchange.first_rows(rows, side))

    def send_phrases(rows: pa.Table, side: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return exchange.rows_table(0, [], [], [])
        found = [_Words(data, offsets).anchors()[1] for _, data, offsets in exchange.text_pieces(own(rows, side))]
        return exchange.sent_codes(rows[BLOCK][0].as_py(), found, codes)

    confirmed = exchange.recurring(exchange.per_block(marked, exchange.answers(first), send_phrases, ROWS), codes, 1)

    def send_windows(rows: pa.Table, side: pa.Table) -> pa.Table:
        """Codes of the windows around recurring phrases, each with the block's smallest id that has it, and whether
        another id has it too."""
        known, _ = exchange.side_codes(side, codes)
        if not rows.num_rows or not len(known):
            return exchange.rows_table(0, [], [], [])
        full, ids = [], []
        for part, data, offsets in exchange.text_pieces(own(rows, side)):
            words = _Words(data, offsets)
            at, hashes = words.anchors()
            at = at[exchange.member(codes.of(hashes), known)[0]]
            near = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(near, np.maximum(at - (WINDOW - PHRASE), 0), 1)
            np.add.at(near, at + 1, -1)
            _, hashes, doc = words.windows(np.cumsum(near)[:-1] > 0)
            full.append(codes.of(hashes))
            ids.append(part[ID].to_numpy()[doc])
        full, ids = np.concatenate(full), np.concatenate(ids)
        order = np.lexsort((ids, full))
        full, ids = full[order], ids[order]
        begin = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]])) if len(full) else np.empty(0, np.int64)
        end = np.append(begin[1:], len(full)) - 1 if len(full) else begin
        several = (ids[end] != ids[begin]).astype(np.uint8)
        buckets, blobs, edges = codes.packed(full[begin])
        more = [x + y for x, y in zip(exchange.cut_at(edges, ids[begin].astype("<i8")), exchange.cut_at(edges, several), strict=True)]
        return exchange.rows_table(rows[BLOCK][0].as_py(), buckets, blobs, more)

    def owners(rows: pa.Table) -> pa.Table:
        """To the block of each window's smallest id: the window's code for every block that needs it."""
        full, lengths = codes.unpacked(rows["codes"].to_pylist())
        more = rows["more"].to_pylist()
        ids = np.frombuffer(b"".join(m[: 8 * n] for m, n in zip(more, lengths.tolist(), strict=True)), "<i8")
        several = np.frombuffer(b"".join(m[8 * n :] for m, n in zip(more, lengths.tolist(), strict=True)), np.uint8) > 0
        block = np.repeat(rows[BLOCK].to_numpy(), lengths)
        order = np.lexsort((ids, full))
        full, ids, several, block = full[order], ids[order], several[order], block[order]
        begin = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]])) if len(full) else np.empty(0, np.int64)
        size = np.diff(np.append(begin, len(full)))
        owner = np.repeat(block[begin], size)
        needed = np.ones(len(full), bool)
        needed[begin] = several[begin]
        full, block, owner = full[needed], block[needed], owner[needed]
        order = np.lexsort((full, owner))
        full, block, owner = full[order], block[order], owner[order]
        to, edges = np.unique(owner, return_index=True)
        edges = np.append(edges, len(full))
        raw = np.ascontiguousarray(full.view(np.uint8).reshape(-1, 8)[:, : codes.width])
        bucket = rows["bucket"][0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(to), pa.int32()), BLOCK: pa.array(to, pa.int32()), "codes": pa.array(exchange.cut_at(edges, raw), pa.binary()), "more": pa.array(exchange.cut_at(edges, block.astype("<i4")), pa.binary())})

    asked = exchange.per_block(marked, exchange.answers(first, confirmed), send_windows, ROWS).groupBy("bucket").applyInArrow(tidy(owners), ROWS)
    sent = pa.schema([("bucket", pa.int32()), (BLOCK, pa.int32()), ("codes", pa.binary()), (ID, pa.int64())])

    def send_passages(rows: pa.Table, side: pa.Table) -> pa.Table:
        """Runs of the asked windows, each from the first document that has it, to the blocks that asked."""
        known, more = exchange.side_codes(side, codes)
        if not rows.num_rows or not len(known):
            return sent.empty_table()
        block = np.frombuffer(b"".join(more), "<i4")
        distinct, begin = np.unique(known, return_index=True)
        size = np.diff(np.append(begin, len(known)))
        done = np.zeros(len(distinct), bool)
        out: dict[str, list] = {"to": [], "text": [], "id": []}
        for part, data, offsets in exchange.text_pieces(own(rows, side)):
            words = _Words(data, offsets)
            at, hashes, doc = words.windows()
            has, code = exchange.member(codes.of(hashes), distinct)
            has &= ~done[code]
            at, doc, code = at[has], doc[has], code[has]
            code, place = np.unique(code, return_index=True)  # the first of the piece, which is in order of ids
            done[code] = True
            start, doc = np.repeat(at[place], size[code]), np.repeat(doc[place], size[code])
            to = block[arrays.ragged(begin[code], size[code])]
            order = np.lexsort((start, to))
            start, doc, to = start[order], doc[order], to[order]
            new = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (start[1:] != start[:-1] + 1)])) if len(to) else np.empty(0, np.int64)
            last = np.append(new[1:], len(to)) - 1 if len(to) else new
            ids, raw = part[ID].to_numpy(), data.tobytes()
            out["to"].extend(to[new].tolist())
            out["id"].extend(ids[doc[new]].tolist())
            out["text"].extend(raw[a:b] for a, b in zip(words.starts[start[new]].tolist(), words.ends[start[last] + WINDOW - 1].tolist(), strict=True))
        return pa.table([pa.array([0] * len(out["to"]), pa.int32()), pa.array(out["to"], pa.int32()), pa.array(out["text"], pa.binary()), pa.array(out["id"], pa.int64())], schema=sent)

    passages = exchange.per_block(marked, exchange.answers(first, asked), send_passages, f"bucket int, {BLOCK} int, codes binary, {ID} bigint")
    side_rows = exchange.answers(first).unionByName(passages.select(BLOCK, "bucket", "codes", F.lit(None).cast("binary").alias("more"), ID, F.lit(None).cast("bigint").alias(HASH)))
    fields = [("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string"), ("kept_text", "string")]
    helpers = {ID, TEXT, HASH, BLOCK}
    schema = extended(T.StructType([f for f in docs.schema.fields if f.name not in helpers]), fields)
    passed = [f.name for f in schema.fields[: -len(fields)]]

    def judge(rows: pa.Table, side: pa.Table) -> pa.Table:
        is_first = exchange.first_rows(rows, side)
        given = side.filter(pa.array(side["bucket"].to_numpy() == 0, pa.bool_()))
        texts = pa.concat_arrays(given["codes"].chunks) if given.num_rows else pa.array([], pa.binary())
        known = Passages(texts, given[ID].to_numpy())
        pieces, base = [], 0
        for part, data, offsets in exchange.text_pieces(rows):
            words = _Words(data, offsets)
            numbers = known.number(words.hashes)
            words.hashes = words.sums = None
            use = is_first[base : base + part.num_rows]
            n = np.diff(words.offsets)
            covered = np.zeros(len(words.starts) + 1, np.int64)
            copies = np.flatnonzero(~use & (n >= WINDOW))  # every window of a later copy stands in the first
            np.add.at(covered, words.offsets[copies], 1)
            np.add.at(covered, words.offsets[copies + 1], -1)
            pieces.append((words, numbers, part[ID].to_numpy(), use, covered))
            base += part.num_rows
        for machine in automata(known.tiles):
            for words, numbers, ids, use, covered in pieces:
                # a number no tile has between documents, so that none is found across them
                spaced = np.insert(numbers, words.offsets[1:-1], len(known.vocabulary) + 1)
                ends, tiles = occurrences(machine, spaced)
                ends -= np.searchsorted(words.offsets[1:-1] + np.arange(len(words.offsets) - 2), ends, "right")
                for a, b in _equal_runs(words, numbers, known, ends, tiles, ids, use):
                    covered[a] += 1
                    covered[b] -= 1
        out = {name: [] for name, _ in fields}
        for words, _, _, _, covered in pieces:
            keep = np.cumsum(covered[:-1]) == 0
            raw = words.data.tobytes()
            kept_before = np.concatenate([[0], np.cumsum(keep)])
            kept_at = np.flatnonzero(keep)
            starts, ends = words.starts[kept_at].tolist(), words.ends[kept_at].tolist()
            for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
                lo, hi = kept_before[a], kept_before[b]
                text = b" ".join([raw[x:y] for x, y in zip(starts[lo:hi], ends[lo:hi], strict=True)])
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                out["kept_text"].append(text.decode())
                out["n_removed"].append(int(b - a - (hi - lo)))
            out["n_words"].extend(np.diff(words.offsets).tolist())
        made = {name: pa.array(out[name], pa.int64() if kind == "bigint" else pa.string()) for name, kind in fields}
        return pa.table([*exchange.passed(rows, passed, text_col), *made.values()], names=[*passed, *made])

    return exchange.per_block(marked, side_rows, judge, schema)
