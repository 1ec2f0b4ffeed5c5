"""Suffix-array deduplication of bytes by deep-shallow sorting.

Every window of 100 bytes has an anchor: its 32 bytes with the least hash; equal windows have equal anchors at equal
places. Anchors that recur are confirmed by an exchange of hashes. The suffixes that start at recurring anchors, and
the reversed prefixes that end there, are sorted: multikey quicksort on 8-byte characters to a shallow depth, then
blind tries order the groups with longer common prefixes. From the order and its common prefixes follow, for every
place of the anchor in a window, which windows are equal; all but the earliest are removed. Anchors that very many
blocks have would gather their suffixes in one task: blocks exchange the hashes of the windows around these instead, each
with the earliest place in the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import arrays, exchange
from graphloom.llm.common import BLOCK, extended, tidy, with_block
from graphloom.llm.exchange import HASH, ID, ROWS, TEXT, answers

#: Bytes of a window and of an anchor; bytes of context before and from an anchor's start.
WINDOW, ANCHOR = 100, 32
BEFORE = WINDOW - ANCHOR
#: 8-byte characters that multikey quicksort looks at before blind tries take over, and the range it leaves to them.
SHALLOW, SMALL = 3, 12
#: Blocks that have an anchor from which on its windows go by their own hashes, one entry a block and window, so that
#: nothing gathers by the anchor.
HOT_BLOCKS = 64


class _Branch:
    """A node of a blind trie: the place its children differ at, and the children by byte. A leaf is a row number."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def blind_trie(rows: list[bytes], members: list[int]) -> list[int]:
    """The members in the order of their rows, by a trie that keeps branching places only.

    A row goes down by the branching bytes alone, is compared once with the leaf it meets, and enters where the two
    first differ. Equal rows stay together.
    """
    root: _Branch | list[int] = [members[0]]
    for row in members[1:]:
        text, node = rows[row], root
        while type(node) is _Branch:
            at = node.children.get(text[node.depth])
            node = at if at is not None else next(iter(node.children.values()))
        met = rows[node[0]]
        if met == text:
            node.append(row)
            continue
        size = len(text)
        differ = size - 1 - ((int.from_bytes(met) ^ int.from_bytes(text)).bit_length() - 1) // 8
        above, node = None, root
        while type(node) is _Branch and node.depth < differ:
            above, node = node, node.children[text[node.depth]]
        if type(node) is _Branch and node.depth == differ:
            node.children[text[differ]] = [row]
            continue
        new = _Branch(differ, {met[differ]: node, text[differ]: [row]})
        if above is None:
            root = new
        else:
            above.children[text[above.depth]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is _Branch:
            stack.extend(node.children[b] for b in sorted(node.children, reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows (equal width), and each one's common prefix with the one before; 0 for the first."""
    n, width = matrix.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = matrix.tobytes()
    rows = [raw[i : i + width] for i in range(0, n * width, width)]
    depth = min(SHALLOW, width // 8)
    characters = np.ascontiguousarray(matrix[:, : depth * 8]).view(">u8").astype(np.uint64)
    out: list[np.ndarray] = []
    stack = [(np.arange(n), 0)]
    while stack:
        members, level = stack.pop()
        if len(members) <= SMALL or level == depth:
            out.append(np.array(blind_trie(rows, members.tolist()) if len(members) > 1 else members))
            continue
        key = characters[members, level]
        low, high = key.min(), key.max()
        if low == high:
            stack.append((members, level + 1))
            continue
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        less, equal = key < pivot, key == pivot
        more = ~(less | equal)
        # the last pushed comes first
        if more.any():
            stack.append((members[more], level))
        stack.append((members[equal], level + 1))
        if less.any():
            stack.append((members[less], level))
    order = np.concatenate(out)
    common = np.zeros(n, np.int64)
    for a in range(1, n, 65536):
        b = min(n, a + 65536)
        unlike = matrix[order[a:b]] != matrix[order[a - 1 : b - 1]]
        common[a:b] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    return order, common


def _ranked(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by distinct row; the distinct rows' places in the sorted order, and the sorted common prefixes."""
    width = matrix.shape[1]
    coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(matrix), [None, pa.py_buffer(np.ascontiguousarray(matrix))]).dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    distinct = np.frombuffer(coded.dictionary.buffers()[1], np.uint8)[: len(coded.dictionary) * width].reshape(-1, width)
    order, common = deep_shallow(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return which, place, common


def _later(groups: np.ndarray, ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which members of each group another one comes before, given in order of id, text hash and place: one of a smaller
    id, or of the same text and id. Different texts of one id don't come before each other."""
    order = np.argsort(groups, kind="stable")
    groups, ids, texts = groups[order], ids[order], texts[order]
    new = np.ones(len(order), bool)
    new[1:] = groups[1:] != groups[:-1]
    least = ids[new][np.cumsum(new) - 1]
    again = np.zeros(len(order), bool)
    again[1:] = ~new[1:] & (ids[1:] == ids[:-1]) & (texts[1:] == texts[:-1])
    out = np.empty(len(order), bool)
    out[order] = (ids > least) | again
    return out


def later_windows(ids: np.ndarray, hashes: np.ndarray, places: np.ndarray, before: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose windows around the anchor also stand earlier (under a smaller id, or before in the same text of the
    same id), and the bytes they cover.

    A context is the ``before`` bytes before an anchor's start and the bytes from it on. Returns row numbers, starts
    and ends: all such windows of a row hold its anchor, so their union is one interval.
    """
    n = len(ids)
    order = np.lexsort((places, hashes, ids))
    lengths = np.fromiter(map(len, contexts), np.int64, n)
    after = lengths - before
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.cumsum(lengths) - lengths
    right = np.zeros((n, WINDOW), np.uint8)
    left = np.zeros((n, -(-BEFORE // 8) * 8), np.uint8)
    row = np.repeat(np.arange(n), after)
    right[row, arrays.ragged(np.zeros(n, np.int64), after)] = flat[arrays.ragged(starts + before, after)]
    row = np.repeat(np.arange(n), before)
    left[row, np.repeat(before, before) - 1 - arrays.ragged(np.zeros(n, np.int64), before)] = flat[arrays.ragged(starts, before)]
    which_r, place_r, common_r = _ranked(right)
    which_l, place_l, common_l = _ranked(left)
    most, least = np.full(n, -1), np.full(n, WINDOW)
    sorted_before, sorted_after, sorted_ids, sorted_hashes = before[order], after[order], ids[order], hashes[order]
    slot_r, slot_l = place_r[which_r[order]], place_l[which_l[order]]
    for a in range(BEFORE + 1):
        able = np.flatnonzero((sorted_before >= a) & (sorted_after >= WINDOW - a))
        if len(able) < 2:
            continue
        # equal to the depth: no common prefix below it between the two in the sorted order
        same_r = np.cumsum(common_r < WINDOW - a)[slot_r[able]]
        same_l = np.cumsum(common_l < a)[slot_l[able]]
        rows = order[able[_later(same_r << 32 | same_l, sorted_ids[able], sorted_hashes[able])]]
        most[rows] = a
        least[rows] = np.minimum(least[rows], a)
    found = np.flatnonzero(most >= 0)
    return found, places[found] - most[found], places[found] - least[found] + WINDOW


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = arrays.windows_hash(arrays.bytes_prefix(data), ANCHOR)
    at = arrays.anchors(hashes, offsets, WINDOW, ANCHOR)
    return at, hashes[at]


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[begin:end] of each pair, as a binary array."""
    size = end - begin
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[arrays.ragged(begin, size)]))])


_SENT = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("place", pa.int64()), ("before", pa.int32()), ("context", pa.binary()), ("done", pa.bool_())])


def _contexts(marked: DataFrame, first: DataFrame, confirmed: DataFrame, codes: exchange.Codes) -> DataFrame:
    """The contexts of recurring anchors that aren't hot, by the anchor's hash. Contexts that agree within a block go
    once: of the others the interval they lose is known (done: start and length in place of place and before)."""

    def send(rows: pa.Table, side: pa.Table) -> pa.Table:
        known, more = exchange.side_codes(side, codes)
        if not rows.num_rows or not len(known):
            return _SENT.empty_table()
        hot = np.frombuffer(b"".join(more), np.uint8)
        out = []
        for part, data, offsets in exchange.text_pieces(exchange.one_each(rows, exchange.first_rows(rows, side))):
            at, hashes = _anchors(data, offsets)
            has, where = exchange.member(codes.of(hashes), known)
            has &= hot[where] == 0
            at, hashes = at[has], hashes[has]
            doc = np.searchsorted(offsets, at, "right") - 1
            lo, hi = np.maximum(at - BEFORE, offsets[doc]), np.minimum(at + WINDOW, offsets[doc + 1])
            out.append((hashes, part[ID].to_numpy()[doc], part[HASH].to_numpy()[doc], at - offsets[doc], at - lo, data, lo, hi))
        key, ids, texts, place, before = (np.concatenate([x[i] for x in out]) for i in range(5))
        context = pa.concat_arrays([_slices(data, begin, end) for *_, data, begin, end in out])
        lengths = pc.binary_length(context).to_numpy(zero_copy_only=False)
        like = context.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((place, texts, ids, before, key, like))
        new = np.ones(len(order), bool)
        new[1:] = (like[order[1:]] != like[order[:-1]]) | (before[order[1:]] != before[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
        done = np.zeros(len(order), bool)
        done[order] = _later(np.cumsum(new), ids[order], texts[order])
        columns = [key.view(np.int64), ids, texts, np.where(done, place - before, place), np.where(done, lengths, before).astype(np.int32)]
        return pa.table([*map(pa.array, columns), pc.if_else(pa.array(done), pa.scalar(b"", pa.binary()), context), pa.array(done)], schema=_SENT)

    return exchange.per_block(marked, answers(first, confirmed), send, "key bigint, id bigint, h bigint, place bigint, before int, context binary, done boolean")


def _hot_windows(rows: pa.Table, side: pa.Table, codes: exchange.Codes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each piece of first copies: code, id, text hash and place of the windows around hot anchors."""
    known, more = exchange.side_codes(side, codes)
    hot = known[np.frombuffer(b"".join(more), np.uint8) > 0]
    if not rows.num_rows or not len(hot):
        return
    for part, data, offsets in exchange.text_pieces(exchange.one_each(rows, exchange.first_rows(rows, side))):
        at, hashes = _anchors(data, offsets)
        at = at[exchange.member(codes.of(hashes), hot)[0]]
        if not len(at):
            continue
        doc = np.searchsorted(offsets, at, "right") - 1
        lo, hi = np.maximum(at - BEFORE, offsets[doc]), np.minimum(at, offsets[doc + 1] - WINDOW) + 1
        begin, end = arrays.merged(lo[hi > lo], hi[hi > lo])
        place = arrays.ragged(begin, end - begin)
        doc = np.searchsorted(offsets, place, "right") - 1
        full = codes.of(arrays.windows_hash(arrays.bytes_prefix(data), WINDOW)[place])
        yield full, part[ID].to_numpy()[doc], part[HASH].to_numpy()[doc], place - offsets[doc]


def _hot_spans(marked: DataFrame, first: DataFrame, confirmed: DataFrame, codes: exchange.Codes, spans: str) -> DataFrame:
    """The bytes that windows around hot anchors lose: windows that recur at all are confirmed by their hashes first,
    then each block sends the earliest place of each, and learns the earliest of all."""
    hot = confirmed.withColumn("bucket", F.col("bucket").cast("int"))

    def send(rows: pa.Table, side: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return exchange.rows_table(0, [], [], [])
        return exchange.sent_codes(rows[BLOCK][0].as_py(), [found[0] for found in _hot_windows(rows, side, codes)], codes)

    again = exchange.recurring(exchange.per_block(marked, answers(first, hot), send, ROWS), codes, 1)

    def beside(found: DataFrame) -> DataFrame:
        """Rows of windows go beside those of anchors, told apart by their bucket."""
        return hot.unionByName(found.withColumn("bucket", -2 - F.col("bucket")))

    def windows(side: pa.Table) -> tuple[np.ndarray, list[bytes]]:
        own = side.filter(pa.array(side["bucket"].to_numpy() <= -2, pa.bool_()))
        buckets = pa.array(-2 - own["bucket"].to_numpy(), pa.int32())
        return exchange.side_codes(own.set_column(own.schema.get_field_index("bucket"), "bucket", buckets), codes)

    def send_first(rows: pa.Table, side: pa.Table) -> pa.Table:
        known, _ = windows(side)
        found = [x for x in _hot_windows(rows, side, codes)] if len(known) else []
        if not found:
            return exchange.rows_table(0, [], [], [])
        full, ids, texts, place = (np.concatenate(x) for x in zip(*found, strict=True))
        has = exchange.member(full, known)[0]
        full, ids, texts, place = full[has], ids[has], texts[has], place[has]
        order = np.lexsort((place, texts, ids, full))
        order = order[np.concatenate([[True], full[order][1:] != full[order][:-1]])] if len(order) else order
        buckets, blobs, edges = codes.packed(full[order])
        return exchange.rows_table(rows[BLOCK][0].as_py(), buckets, blobs, exchange.cut_at(edges, np.stack([ids, texts, place], axis=1)[order].astype("<i8")))

    def earliest(rows: pa.Table) -> pa.Table:
        full, lengths = codes.unpacked(rows["codes"].to_pylist())
        triples = np.frombuffer(b"".join(rows["more"].to_pylist()), "<i8").reshape(-1, 3)
        _, which = np.unique(full, return_inverse=True)
        order = np.lexsort((triples[:, 2], triples[:, 1], triples[:, 0], which))
        least = triples[order[np.concatenate([[True], which[order][1:] != which[order][:-1]])]] if len(order) else triples
        ends = np.cumsum(lengths)
        return pa.table({"bucket": rows["bucket"], BLOCK: rows[BLOCK], "codes": rows["codes"], "more": pa.array(exchange.cut_at(np.append(ends - lengths, ends[-1:]), least[which]), pa.binary())})

    known_firsts = exchange.per_block(marked, answers(first, beside(again)), send_first, ROWS).groupBy("bucket").applyInArrow(tidy(earliest), ROWS)

    def strike(rows: pa.Table, side: pa.Table) -> pa.Table:
        known, more = windows(side)
        triples = np.frombuffer(b"".join(more), "<i8").reshape(-1, 3)
        out = [np.empty((0, 4), np.int64)]
        for full, ids, texts, place in _hot_windows(rows, side, codes) if len(known) else ():
            has, where = exchange.member(full, known)
            full, ids, texts, place, least = full[has], ids[has], texts[has], place[has], triples[where[has], 0]
            # the earliest of all may have another text of the same id, which doesn't come before
            order = np.lexsort((place, texts, ids, full))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (full[order[1:]] == full[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]]) & (texts[order[1:]] == texts[order[:-1]])
            later = (ids > least) | again
            ids, texts, place = ids[later], texts[later], place[later]
            # windows that follow each other are one span
            new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]) | (place[1:] != place[:-1] + 1)])) if len(place) else np.empty(0, np.int64)
            last = np.append(new[1:], len(place)) - 1 if len(place) else new
            out.append(np.stack([ids[new], texts[new], place[new], place[last] + WINDOW], axis=1))
        found = np.concatenate(out)
        return pa.table({ID: pa.array(found[:, 0]), HASH: pa.array(found[:, 1]), "start": pa.array(found[:, 2]), "stop": pa.array(found[:, 3])})

    return exchange.per_block(marked, answers(first, beside(known_firsts)), strike, spans)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    A byte goes if a 100-byte string that covers it also starts earlier: in a document of a smaller id, or in the same
    one before. Strings are judged on the input, never cross documents, and may overlap. Copies of a whole text follow
    from its first copy. Contexts that agree within a block travel once; the windows around an anchor that many blocks
    have go by their own hashes, one entry a block, so neither a passage nor a line in a third of all documents gathers
    in one task, whatever stands around it.
    Null and empty texts have no bytes; a null id counts as larger than any other; rows of one id and text count once
    and are treated alike, rows of one id and different texts do not remove each other. Columns with the result's names
    are replaced, others pass through. An empty table gives an empty one.
    """
    marked, first, codes, blocks = exchange.prepared(docs, id_col, text_col)

    def send_anchors(rows: pa.Table, side: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return exchange.rows_table(0, [], [], [])
        own = exchange.one_each(rows, exchange.first_rows(rows, side))
        return exchange.sent_codes(rows[BLOCK][0].as_py(), [_anchors(d, o)[1] for _, d, o in exchange.text_pieces(own)], codes)

    confirmed = exchange.recurring(exchange.per_block(marked, answers(first), send_anchors, ROWS), codes, HOT_BLOCKS)
    contexts = _contexts(marked, first, confirmed, codes)
    spans = f"{ID} bigint, {HASH} bigint, start bigint, stop bigint"

    def resolve(rows: pa.Table) -> pa.Table:
        ids, h = rows["id"].to_numpy(), rows["h"].to_numpy()
        place, before = rows["place"].to_numpy(), rows["before"].to_numpy().astype(np.int64)
        found, start, stop = later_windows(ids, h, place, before, rows["context"].to_pylist())
        return pa.table({ID: pa.array(ids[found]), HASH: pa.array(h[found]), "start": pa.array(start), "stop": pa.array(stop)})

    waiting = contexts.where(~F.col("done")).withColumn("bucket", F.pmod("key", F.lit(4 * blocks)))
    resolved = waiting.groupBy("bucket").applyInArrow(tidy(resolve), spans)
    certain = contexts.where("done").select(F.col("id").alias(ID), F.col("h").alias(HASH), F.col("place").alias("start"), (F.col("place") + F.col("before")).alias("stop"))
    gone = with_block(resolved.unionByName(certain).unionByName(_hot_spans(marked, first, confirmed, codes, spans)), blocks, ID, HASH)
    copies = first.select(BLOCK, F.lit(-1).alias("bucket"), ID, HASH, F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop"))
    side_rows = copies.unionByName(gone.withColumn("bucket", F.lit(0)))

    fields = [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), ("kept", "binary")]
    schema = extended(T.StructType([f for f in docs.schema.fields if f.name not in {ID, TEXT, HASH, BLOCK}]), fields)
    passed = [f.name for f in schema.fields[: -len(fields)]]

    def judge(rows: pa.Table, side: pa.Table) -> pa.Table:
        is_first = exchange.first_rows(rows, side)
        cut = side.filter(pa.array(side["bucket"].to_numpy() == 0, pa.bool_()))
        ids, texts = cut[ID].to_numpy(), cut[HASH].to_numpy()
        order = np.lexsort((texts, ids))
        ids, texts, start, stop = ids[order], texts[order], cut["start"].to_numpy()[order], cut["stop"].to_numpy()[order]
        edges = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])])) if len(ids) else np.empty(0, np.int64)
        where = {(int(ids[a]), int(texts[a])): (a, b) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(ids)][: len(edges)], strict=True)}
        out = {name: [] for name, _ in fields}
        base = 0
        for part, data, offsets in exchange.text_pieces(rows):
            for k, key in enumerate(zip(part[ID].to_pylist(), part[HASH].to_pylist(), strict=True)):
                text = data[offsets[k] : offsets[k + 1]]
                n = len(text)
                if not is_first[base + k] and n >= WINDOW:
                    a, b = np.array([0]), np.array([n])
                elif key in where:
                    lo, hi = where[key]
                    a, b = arrays.merged(start[lo:hi], stop[lo:hi])
                else:
                    a = b = np.empty(0, np.int64)
                keep = np.ones(n, bool)
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    keep[x:y] = False
                left = text[keep].tobytes()
                out["n_bytes"].append(n)
                out["n_removed"].append(n - len(left))
                out["n_spans"].append(len(a))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left)
            base += part.num_rows
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        made = {name: pa.array(out[name], kinds[kind]) for name, kind in fields}
        return pa.table([*exchange.passed(rows, passed, text_col), *made.values()], names=[*passed, *made])

    return exchange.per_block(marked, side_rows, judge, schema)
