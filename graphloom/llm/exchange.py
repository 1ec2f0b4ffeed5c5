"""Exchange of hashes between blocks of documents and hash buckets, as packed arrays.

Documents are dealt to blocks by their id and text. A block reduces its hashes to sorted distinct codes and sends each bucket
(a range of hashes) one row with one packed array, so a hash that stands in a third of all documents costs one entry a
block, and a bucket grows with the number of distinct hashes, not with any hash's frequency. Buckets answer each block
likewise. A code is the top 48 bits of a hash below the bucket's, so it grows with the number of buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.llm.common import BLOCK, BLOCK_BYTES, block_count, pieces, tidy, with_block

#: Stands for a null id: after all others.
LAST_ID = (1 << 63) - 1
ID, TEXT, HASH = "__id", "__text", "__h"


class Codes:
    """How hashes are cut to a bucket and a code of ``width`` bytes; ``bits`` bucket bits, which grow with the blocks.
    Beyond 16 of them a code has the hash's other bits and takes more than it needs of its bytes."""

    def __init__(self, blocks: int, width: int = 6):
        self.width = width
        self.bits = max(1, min(31, (max(1, blocks) - 1).bit_length()))
        self.low = np.uint64(min(8 * width, 64 - self.bits))
        self.shift = np.uint64(64 - self.bits) - self.low

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket and code in one number, in the order of the hashes."""
        return hashes >> self.shift

    def packed(self, full: np.ndarray) -> tuple[list[int], list[bytes], np.ndarray]:
        """Of sorted numbers: the buckets, each one's codes, and where each bucket's start and end."""
        buckets = (full >> self.low).astype(np.int64)
        present, first = np.unique(buckets, return_index=True)
        edges = np.append(first, len(full))
        codes = full & ((np.uint64(1) << self.low) - np.uint64(1))
        raw = np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]).tobytes()
        return present.tolist(), [raw[self.width * a : self.width * b] for a, b in zip(edges[:-1], edges[1:], strict=True)], edges

    def unpacked(self, blobs: list[bytes], buckets: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All blobs' codes, one after another (with their buckets, if given), and the blobs' lengths."""
        width = self.width
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        out = np.zeros((len(raw), 8), np.uint8)
        out[:, :width] = raw
        lengths = np.fromiter((len(b) // width for b in blobs), np.int64, len(blobs))
        full = out.view("<u8").reshape(-1)
        if buckets is not None and len(full):
            full = full | (np.repeat(np.array(buckets, np.uint64), lengths) << self.low)
        return full, lengths


def keyed(docs: DataFrame, blocks: int, id_col: str, text_col: str) -> DataFrame:
    """docs with the working columns: block, id (null last) and the text's hash (null as empty). The text itself is
    renamed, not copied, so that it travels once; ``passed`` names it back."""
    named = docs.withColumnRenamed(text_col, TEXT)
    marked = named.withColumns({ID: F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)), HASH: F.xxhash64(F.coalesce(F.col(TEXT), F.lit("")))})
    return with_block(marked, blocks, ID, HASH)


def passed(rows: pa.Table, names: list[str], text_col: str) -> list[pa.ChunkedArray]:
    """The columns of docs that go on as they are."""
    return [rows[TEXT if name == text_col else name] for name in names]


def firsts(marked: DataFrame, blocks: int) -> DataFrame:
    """Of each distinct text the smallest id that has it: block, id and hash of the text. Pre-aggregated, so a group
    of copies of any size sends one row from each task."""
    return with_block(marked.groupBy(F.md5(F.coalesce(F.col(TEXT), F.lit("")).cast("binary")).alias("__m")).agg(F.min(ID).alias(ID), F.min(HASH).alias(HASH)).drop("__m"), blocks, ID, HASH)


def answers(firsts_: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """What goes to each block beside its documents: the first copies, and rows (bucket, codes, more) if there are any."""
    base = firsts_.select(BLOCK, F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("more"), ID, HASH)
    if found is None:
        return base
    return base.unionByName(found.select(BLOCK, "bucket", "codes", "more", F.lit(None).cast("bigint").alias(ID), F.lit(None).cast("bigint").alias(HASH)))


def per_block(marked: DataFrame, side: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    return marked.groupBy(BLOCK).cogroup(side.groupBy(BLOCK)).applyInArrow(tidy(function), schema)


def first_rows(docs: pa.Table, side: pa.Table) -> np.ndarray:
    """Which rows are the first copy of their text (all rows of one id and text count alike)."""
    ids, hashes = docs[ID].to_numpy(), docs[HASH].to_numpy()
    mask = np.asarray(side["bucket"].to_numpy()) == -1
    own = side.filter(pa.array(mask)) if mask.any() else side.slice(0, 0)
    known = set(zip(own[ID].to_pylist(), own[HASH].to_pylist(), strict=True))
    return np.fromiter(((a, b) in known for a, b in zip(ids.tolist(), hashes.tolist(), strict=True)), bool, len(ids))


def one_each(docs: pa.Table, rows: np.ndarray) -> pa.Table:
    """The given rows (a mask), one for each id and text, in order of id and text hash."""
    at = np.flatnonzero(rows)
    ids, hashes = docs[ID].to_numpy()[at], docs[HASH].to_numpy()[at]
    order = np.lexsort((hashes, ids))
    at, ids, hashes = at[order], ids[order], hashes[order]
    new = np.ones(len(at), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    return docs.select([ID, HASH, TEXT]).take(pa.array(at[new]))


def text_pieces(docs: pa.Table, most: int = 1 << 18) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` text bytes: the rows, their bytes and offsets."""
    texts = docs[TEXT].combine_chunks() if isinstance(docs[TEXT], pa.ChunkedArray) else docs[TEXT]
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    for start, stop in pieces(texts, most):
        yield (docs.slice(start, stop - start), *arrays.buffer(texts.slice(start, stop - start)))


def side_codes(side: pa.Table, codes: Codes) -> tuple[np.ndarray, list[bytes]]:
    """The sorted codes the buckets have answered, and what came with them, in that order."""
    buckets = side["bucket"].to_numpy()
    at = np.flatnonzero(buckets >= 0)
    at = at[np.argsort(buckets[at], kind="stable")]
    rows = side.take(pa.array(at))
    full, _ = codes.unpacked(rows["codes"].to_pylist(), rows["bucket"].to_pylist())
    return full, rows["more"].to_pylist()


def member(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value whether sorted ``known`` has it, and where."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def rows_table(block: int, buckets: list[int], codes: list[bytes], more: list[bytes]) -> pa.Table:
    n = len(buckets)
    return pa.table({"bucket": pa.array(buckets, pa.int32()), BLOCK: pa.array([block] * n, pa.int32()), "codes": pa.array(codes, pa.binary()), "more": pa.array(more, pa.binary())})


ROWS = f"bucket int, {BLOCK} int, codes binary, more binary"


def cut_at(edges: np.ndarray, values: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(values[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def recurring(sent: DataFrame, codes: Codes, hot: int) -> DataFrame:
    """Of the codes all blocks sent (more: a byte for each, 2 if it stands in the block twice or more, else 1), those that
    stand twice or more in all, back to the blocks that have them; more: 1 where ``hot`` blocks at least do, else 0."""

    def run(rows: pa.Table) -> pa.Table:
        full, lengths = codes.unpacked(rows["codes"].to_pylist())
        times = np.frombuffer(b"".join(rows["more"].to_pylist()), np.uint8)
        _, which = np.unique(full, return_inverse=True)
        often = np.bincount(which, weights=times) >= 2
        crowd = np.bincount(which) >= hot
        ends = np.cumsum(lengths)
        keep, crowded = often[which], crowd[which].astype(np.uint8)
        raw = np.ascontiguousarray(full.view(np.uint8).reshape(-1, 8)[:, :6])
        blobs, more = [], []
        for a, b in zip(ends - lengths, ends, strict=True):
            mask = keep[a:b]
            blobs.append(raw[a:b][mask].tobytes())
            more.append(crowded[a:b][mask].tobytes())
        out = pa.table({"bucket": rows["bucket"], BLOCK: rows[BLOCK], "codes": pa.array(blobs, pa.binary()), "more": pa.array(more, pa.binary())})
        return out.filter(pa.array([len(c) > 0 for c in blobs], pa.bool_()))

    return sent.groupBy("bucket").applyInArrow(tidy(run), ROWS)


def sent_codes(block: int, found: list[np.ndarray], codes: Codes) -> pa.Table:
    """The rows a block sends for the hashes found in it."""
    full, counts = np.unique(codes.of(np.concatenate(found)) if found else np.empty(0, np.uint64), return_counts=True)
    buckets, blobs, edges = codes.packed(full)
    return rows_table(block, buckets, blobs, cut_at(edges, np.minimum(counts, 2).astype(np.uint8)))


def prepared(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, Codes, int]:
    """Marked documents, the first copies, the codes' cut and the number of blocks."""
    blocks = block_count(docs, block_bytes)
    marked = keyed(docs, blocks, id_col, text_col)
    return marked, firsts(marked, blocks), Codes(blocks), blocks
