"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of 5-word shingles: term frequency times inverse document frequency. Two documents agree
on a consistent sample with the probability of their weighted Jaccard similarity. Samples are banded into buckets;
pairs from buckets are verified by the exact similarity of the whole texts; links join into classes. What buckets then
leave undecided is joined exactly, by weighted prefixes.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays, exchange
from graphloom.llm.common import BLOCK, block_count, bounded, bytes_of, pieces, released, tidy, with_block, written
from graphloom.llm.components import components

#: Bytes of a table that is broadcast, at most.
BROADCAST_BYTES = 4 << 20
#: Members of a posting that are joined in one cell.
CELL = 1024
#: Rows a task sends at once.
BATCH_ROWS = 1 << 16
#: Documents, or distinct shingles, whose counts a task adds up before it sends the frequent ones.
FLUSH_DOCUMENTS, FLUSH_SHINGLES = 8192, 1 << 21
#: Rows of slim tables that a task takes, about: such a table has no more tasks and files than that asks for.
TASK_ROWS = 50_000
#: Compressed bytes of texts that a task takes, about.
TASK_BYTES = 4 << 20
#: A row without an id goes by a number from here on that its text gives; ids are smaller.
NO_ID = 1 << 62


def _gamma_quantiles(size: int) -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2, by bisection of 1 - (1 + x) exp(-x)."""
    share = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


_GAMMA = _gamma_quantiles(1 << 14)
_LOG_GAMMA = np.log(_gamma_quantiles(1 << 17))


@dataclasses.dataclass(frozen=True)
class Sampling:
    """Words of a shingle, least similarity, bands and samples of each; the share of documents up to which a shingle
    has the full inverse document frequency, and the power it is damped by. With 10 bands of 2, a pair at similarity
    0.8 shares a bucket with probability 1 - (1 - 0.64) ** 10 = 0.99996."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 10
    rows: int = 2
    common: float = 0.001
    damping: float = 1 / 3


class Frequent:
    """Inverse document frequencies: (log(1 + n / df) / log(1 + 1 / common)) ** damping, 1 at most. So only shingles in
    more than the share ``common`` of the documents need an entry, and the number of these is bounded: by the mean
    number of shingles of a document over ``common``. Damped, since a large group of near copies makes its own shingles
    frequent and its few edits rare, and would by plain logarithms fall apart by its size."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, documents: int, settings: Sampling):
        chosen = counts > settings.common * documents
        self.hashes = hashes[chosen]
        self.idf = (np.log1p(documents / np.maximum(counts[chosen], 1)) / np.log1p(1 / settings.common)) ** settings.damping

    def weights(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = times.astype(np.float64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out *= np.where(self.hashes[at] == hashes, self.idf[at], 1.0)
        return out


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash and frequency, in that order. A text with fewer words than a
    shingle, but not none, is one shingle."""
    starts, ends, bounds = arrays.words(data, offsets, arrays.WHITE)
    hashes = arrays.words_hash(data, starts, ends, lower=True)
    sums = arrays.prefix(hashes)
    n = np.diff(bounds)
    full = np.maximum(n - size + 1, 0)
    at = arrays.ragged(bounds[:-1], full)
    short = np.flatnonzero((n > 0) & (n < size))
    doc = np.concatenate([np.repeat(np.arange(len(n)), full), short])
    value = np.concatenate([arrays.windows_hash(sums, size)[at] if len(at) else np.empty(0, np.uint64), arrays.spans_hash(sums, bounds[short], bounds[short + 1])])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return doc[first], value[first], np.diff(np.append(first, len(doc)))


def consistent_samples(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and ``count`` improved consistent weighted samples of each, as hashes.

    For sample k each shingle draws r and c from Gamma(2, 1) and b from [0, 1), all from its hash: with
    t = floor(ln w / r + b), the shingle of the least ln c - r (t - b + 1) is taken, and the sample is (shingle, t).
    """
    if not len(doc):
        return doc, np.empty((0, count), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.append(first, len(doc)))
    log_weight = np.log(weights)
    plain = not log_weight.any()
    out = np.empty((len(first), count), np.uint64)
    low14, low17 = np.uint64((1 << 14) - 1), np.uint64((1 << 17) - 1)
    for k in range(count):
        draw = arrays.mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = _GAMMA[(draw & low14).view(np.int64)]
        b = ((draw >> np.uint64(14)) & low17).astype(np.float64) * (1 / (1 << 17))
        c = _LOG_GAMMA[(draw >> np.uint64(47)).view(np.int64)]
        t = np.zeros(len(r)) if plain else np.floor(log_weight / r + b)
        value = c - r * (t - b + 1)
        least = np.minimum.reduceat(value, first)
        hit = np.flatnonzero(value == np.repeat(least, sizes))
        where = np.searchsorted(hit, first)
        taken = hit[where]
        out[:, k] = arrays.mix(hashes[taken] ^ (t[taken].astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return doc[first], out


def frequencies(texts: DataFrame, settings: Sampling) -> tuple[Frequent, int]:
    """Exact document frequencies, over all rows of texts (text), of the shingles in more than the share ``common``.

    First each run of documents sends the shingles in a quarter of that share of its documents: a shingle above the
    share cannot fall short of three quarters of it in the sums. Those that reach that are counted exactly.
    """
    quarter = settings.common / 4

    def frequent(values: list, counts: list, documents: int):
        value, which = np.unique(np.concatenate(values), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate(counts), minlength=len(value)).astype(np.int64)
        some = n >= quarter * documents
        value, n = value[some].view(np.int64), n[some]
        for a in range(0, len(value), BATCH_ROWS):
            part = slice(a, a + BATCH_ROWS)
            yield pa.RecordBatch.from_pydict({"hash": value[part], "n": n[part], "rows": np.zeros(len(n[part]), np.int64)})
        yield pa.RecordBatch.from_pydict({"hash": pa.array([0], pa.int64()), "n": pa.array([0], pa.int64()), "rows": pa.array([documents], pa.int64())})

    def send(batches):
        values, counts, documents, held = [], [], 0, 0
        for batch in batches:
            column = batch.column(0)
            for start, stop in pieces(column, 2 << 20):
                _, hashes, _ = shingles(*arrays.buffer(column.slice(start, stop - start)), settings.shingle)
                value, n = np.unique(hashes, return_counts=True)
                values.append(value)
                counts.append(n)
                documents, held = documents + stop - start, held + len(value)
                if documents >= FLUSH_DOCUMENTS or held >= FLUSH_SHINGLES:
                    yield from frequent(values, counts, documents)
                    values, counts, documents, held = [], [], 0, 0
        if documents:
            yield from frequent(values, counts, documents)
        values.clear()
        released()

    sent = texts.select("text").mapInArrow(send, "hash bigint, n bigint, rows bigint")
    summed = written(sent.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).coalesce(min(1 << 24, 1 + bytes_of(texts) // TASK_BYTES)))
    documents = summed.agg(F.sum("rows")).first()[0] or 0
    # at most (mean shingles of a document) / (0.75 common) of them
    likely = np.sort(summed.where((F.col("n") >= 3 * quarter * documents) & (F.col("n") > 0)).select("hash").toArrow()["hash"].to_numpy().view(np.uint64))
    if not len(likely):
        return Frequent(likely, np.empty(0, np.int64), documents, settings), documents

    def count(batches):
        total = np.zeros(len(likely), np.int64)
        for batch in batches:
            column = batch.column(0)
            for start, stop in pieces(column, 2 << 20):
                _, hashes, _ = shingles(*arrays.buffer(column.slice(start, stop - start)), settings.shingle)
                at = np.minimum(np.searchsorted(likely, hashes), len(likely) - 1)
                total += np.bincount(at[likely[at] == hashes], minlength=len(likely))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"hash": likely[found].view(np.int64), "n": total[found]})
        released()

    counted = texts.select("text").mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).toArrow()
    hashes, counts = counted["hash"].to_numpy().view(np.uint64), counted["n"].to_numpy()
    order = np.argsort(hashes)
    return Frequent(hashes[order], counts[order], documents, settings), documents


def sketches(texts: DataFrame, frequent: Frequent, settings: Sampling) -> DataFrame:
    """id, the whole weight, and one key for each band, for the rows of texts (id, text) that have words."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for start, stop in pieces(column, 1 << 20):
                data, offsets = arrays.buffer(column.slice(start, stop - start))
                doc, hashes, times = shingles(data, offsets, settings.shingle)
                weights = frequent.weights(hashes, times)
                found, samples = consistent_samples(doc, hashes, weights, settings.bands * settings.rows)
                keys = np.zeros((len(found), settings.bands), np.uint64)
                for row in range(settings.rows):
                    keys = arrays.mix(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, row :: settings.rows])
                ids = batch.column("id").slice(start, stop - start).take(pa.array(found))
                whole = np.bincount(doc, weights=weights, minlength=stop - start)[found]
                flat = pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * settings.bands), flat)
                yield pa.RecordBatch.from_arrays([ids, pa.array(whole), lists], names=["id", "whole", "keys"])
        released()

    return texts.select("id", "text").mapInArrow(run, "id bigint, whole double, keys array<bigint>")


def similarities(ones: pa.Array, others: pa.Array, frequent: Frequent, size: int) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 where one has no word."""
    n = len(ones)
    doc, hashes, times = shingles(*arrays.buffer(pa.concat_arrays([ones, others])), size)
    weights = frequent.weights(hashes, times)
    whole = np.bincount(doc, weights=weights, minlength=2 * n)
    pair = np.where(doc < n, doc, doc - n)
    order = np.lexsort((hashes, pair))
    pair, hashes, weights = pair[order], hashes[order], weights[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1]))
    least = np.bincount(pair[both], weights=np.minimum(weights[both], weights[both + 1]), minlength=n)
    either = whole[:n] + whole[n:] - least
    return np.where((whole[:n] > 0) & (whole[n:] > 0), least / np.maximum(either, 1e-300), 0.0)


def similarity(one: str, other: str, frequent: Frequent, size: int) -> float:
    """Weighted Jaccard similarity of two texts; 0 if either has no word."""
    return float(similarities(pa.array([one], pa.string()), pa.array([other], pa.string()), frequent, size)[0])


def verified(pairs: DataFrame, texts: DataFrame, frequent: Frequent, settings: Sampling) -> DataFrame:
    """The pairs (u, v) with their similarity over whole texts. Texts that no pair names don't move."""
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    needed = texts.join(_small(ids, pairs, 16), "id", "left_semi")
    joined = pairs.join(needed.select(F.col("id").alias("u"), F.col("text").alias("one")), "u").join(needed.select(F.col("id").alias("v"), F.col("text").alias("other")), "v")

    def run(batches):
        for batch in batches:
            ones, others = batch.column("one"), batch.column("other")
            at = 0
            for start, stop in pieces(ones, 1 << 18):
                while at < stop:  # both sides within bounds
                    size = max(1, next(pieces(others.slice(at, stop - at), 1 << 18))[1])
                    found = similarities(ones.slice(at, size), others.slice(at, size), frequent, settings.shingle)
                    yield pa.RecordBatch.from_arrays([batch.column("u").slice(at, size), batch.column("v").slice(at, size), pa.array(found)], names=["u", "v", "similarity"])
                    at += size
        released()

    found = joined.select("u", "v", "one", "other").mapInArrow(run, "u bigint, v bigint, similarity double")
    return found.groupBy("u", "v").agg(F.max("similarity").alias("similarity"))  # an id may have repeated rows


def _slim(df: DataFrame, rows: int) -> DataFrame:
    """df, a table of ids and numbers of about as many rows, written by as many tasks as these ask for at most."""
    return written(df.coalesce(1 + rows // TASK_ROWS))


def _alike(u: str, v: str, settings: Sampling):
    """Whether two whole weights allow the least similarity at all."""
    return F.least(u, v) >= settings.similarity * (1 - 1e-9) * F.greatest(u, v)


def _neighbours(sketched: DataFrame, settings: Sampling) -> DataFrame:
    """Pairs of documents that stand side by side in a bucket, in order of the keys of the bands that follow.

    A range partitioning by key, following keys and id deals a large bucket to many tasks; where a partition ends, the
    bucket's leader still links both sides.
    """
    turned = sketched.select("id", "whole", F.posexplode("keys").alias("band", "key"), F.col("keys")).select(
        "id", "whole", "band", "key", *[F.get("keys", F.pmod(F.col("band") + i, F.lit(settings.bands))).alias(f"k{i}") for i in (1, 2, 3)])
    order = ["band", "key", "k1", "k2", "k3", "id"]
    ranged = turned.repartitionByRange(*order).sortWithinPartitions(*order)
    least = settings.similarity * (1 - 1e-9)

    def run(batches):
        last = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key", "id", "whole")]
            if last is not None:
                columns = [np.concatenate([[x], y]) for x, y in zip(last, columns, strict=True)]
            band, key, ids, whole = columns
            same = (band[1:] == band[:-1]) & (key[1:] == key[:-1]) & (ids[1:] != ids[:-1])
            same &= np.minimum(whole[1:], whole[:-1]) >= least * np.maximum(whole[1:], whole[:-1])
            yield pa.RecordBatch.from_pydict({"u": np.minimum(ids[1:], ids[:-1])[same].astype(np.int64), "v": np.maximum(ids[1:], ids[:-1])[same].astype(np.int64)})
            if len(ids):
                last = band[-1], key[-1], ids[-1], whole[-1]

    return ranged.mapInArrow(run, "u bigint, v bigint")


def _small(df: DataFrame, counted: DataFrame, width: int) -> DataFrame:
    """df, to be broadcast if its rows are within the bound, which ``counted`` (a written table that df has at most two
    rows for each row of) tells; beyond it a join shuffles. A row takes ``width`` bytes, twice that in a hash table."""
    return F.broadcast(df) if counted.count() * 4 * width <= BROADCAST_BYTES else df


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df with its labels replaced by those they belong to."""
    to = labels.select(F.col("node").alias("label"), F.col("label").alias("__to"))
    return df.join(_small(to, labels, 16), "label", "left").withColumn("label", F.coalesce("__to", "label")).drop("__to")


def _prefixes(texts: DataFrame, frequent: Frequent, settings: Sampling) -> DataFrame:
    """id, label, whole weight, and hash and rest (the weight from there on) of each shingle in the prefixes of texts
    (id, label, text), rarest shingles first. The first shingle that two texts at the least similarity share has in
    both a rest of no less than that share of the whole; shingles of one label only come first and are left out.

    Blocks send their distinct shingles to buckets, packed, with how many of their texts have each; buckets answer those
    of several labels with the sum. So no table of counts is as small for a large input as for a small one.
    """
    blocks = block_count(texts)
    codes = exchange.Codes(blocks)
    marked = with_block(texts.select("id", "label", F.col("text").alias(exchange.TEXT)), blocks, "id")
    least = settings.similarity * (1 - 1e-9)
    held = np.dtype([("label", "<i8"), ("n", "<i4"), ("several", "u1")])
    out = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("hash", pa.int64()), ("rest", pa.float64()), ("whole", pa.float64())])

    def send(rows: pa.Table) -> pa.Table:
        found, labels = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for part, data, offsets in exchange.text_pieces(rows, 1 << 20):
            doc, hashes, _ = shingles(data, offsets, settings.shingle)
            found.append(codes.of(hashes))
            labels.append(part["label"].to_numpy()[doc])
        full, label = np.concatenate(found), np.concatenate(labels)
        order = np.lexsort((label, full))
        full, label = full[order], label[order]
        begin = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]])) if len(full) else np.empty(0, np.int64)
        end = np.append(begin[1:], len(full)) - 1 if len(full) else begin
        more = np.empty(len(begin), held)
        more["label"], more["n"], more["several"] = label[begin], end - begin + 1, label[begin] != label[end]
        buckets, blobs, edges = codes.packed(full[begin])
        return exchange.rows_table(rows[BLOCK][0].as_py(), buckets, blobs, exchange.cut_at(edges, more))

    def shared(rows: pa.Table) -> pa.Table:
        full, lengths = codes.unpacked(rows["codes"].to_pylist())
        own = np.frombuffer(b"".join(rows["more"].to_pylist()), held)
        _, first, which = np.unique(full, return_index=True, return_inverse=True)
        unlike = (own["label"] != own["label"][first[which]]) | (own["several"] > 0)
        keep = (np.bincount(which, weights=unlike) > 0)[which]
        n = np.minimum(np.bincount(which, weights=own["n"]), (1 << 31) - 1).astype("<i4")[which]
        raw = np.ascontiguousarray(full.view(np.uint8).reshape(-1, 8)[:, : codes.width])
        edges = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lengths)])]
        table_ = pa.table({"bucket": rows["bucket"], BLOCK: rows[BLOCK], "codes": pa.array(exchange.cut_at(edges, raw[keep]), pa.binary()), "more": pa.array(exchange.cut_at(edges, n[keep]), pa.binary())})
        return table_.filter(pa.array(np.diff(edges) > 0, pa.bool_()))

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        known, more = exchange.side_codes(side, codes)
        if not len(known):
            return out.empty_table()
        n, made = np.frombuffer(b"".join(more), "<i4"), []
        for part, data, offsets in exchange.text_pieces(rows, 1 << 20):
            doc, hashes, times = shingles(data, offsets, settings.shingle)
            weights = frequent.weights(hashes, times)
            has, at = exchange.member(codes.of(hashes), known)
            seen = np.where(has, n[at], 1)
            turn = np.lexsort((hashes, seen, doc))
            hashes, weights, has = hashes[turn], weights[turn], has[turn]
            whole = np.bincount(doc, weights=weights, minlength=part.num_rows)
            sums = np.concatenate([[0.0], np.cumsum(weights)])
            ends = np.searchsorted(doc, np.arange(part.num_rows), "right")
            rest = sums[ends[doc]] - sums[:-1]
            # rounding of the sums must not lose a text's first place
            keep = (rest >= least * whole[doc] - 1e-9 * sums[-1]) & has
            at = doc[keep]
            made.append(pa.table([part["id"].to_numpy()[at], part["label"].to_numpy()[at], hashes[keep].view(np.int64), rest[keep] + 1e-9 * sums[-1], whole[at]], schema=out))
        return pa.concat_tables(made) if made else out.empty_table()

    side = marked.groupBy(BLOCK).applyInArrow(tidy(send), exchange.ROWS).groupBy("bucket").applyInArrow(tidy(shared), exchange.ROWS)
    return exchange.per_block(marked, side, run, "id bigint, label bigint, hash bigint, rest double, whole double")


def _exact(waiting: DataFrame, texts: DataFrame, frequent: Frequent, settings: Sampling) -> DataFrame:
    """All pairs (u, v) of the waiting (id, label) at the least similarity whose labels differ, by an exact weighted
    prefix join. In each posting, members of other labels than its most frequent one meet all members, so one large
    class costs no pairs within itself; a long posting is dealt to cells of a bounded number of members."""
    found = written(_prefixes(written(texts.join(_small(waiting, waiting, 16), "id")), frequent, settings))
    by_label = found.groupBy("hash", "label").agg(F.count("*").alias("n"))
    postings = by_label.groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("major")).where("labels > 1")
    dealt = _slim(found.join(postings.select("hash", "major", F.ceil(F.col("n") / CELL).cast("int").alias("parts")), "hash"), found.count())
    v = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("v")
    u = dealt.where("label <> major").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("u")
    share = settings.similarity / (1 + settings.similarity) * (1 - 1e-9)
    meets = (F.col("u.label") != F.col("v.label")) & ((F.col("v.label") == F.col("v.major")) | (F.col("u.id") < F.col("v.id"))) & _alike("u.whole", "v.whole", settings)
    enough = F.least("u.rest", "v.rest") >= share * (F.col("u.whole") + F.col("v.whole"))
    same = (F.col("u.hash") == F.col("v.hash")) & (F.col("u.part") == F.col("v.part"))
    pairs = _slim(u.join(v, same & meets & enough).select(F.least("u.id", "v.id").alias("u"), F.greatest("u.id", "v.id").alias("v")).distinct(), dealt.count())
    return verified(pairs, texts, frequent, settings).where(F.col("similarity") >= settings.similarity).select("u", "v")


def classes(docs: DataFrame, settings: Sampling | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, kept, text_md5) for each row of docs: the smallest id of its class, the links to
    different texts that the comparisons below have verified for its text, whether it is that document, and the hash
    that tells texts of one id apart.

    Texts that are equal form a class at once and go on as one, the copy with the smallest id. In each bucket every
    text is compared with a leader and with its neighbours in sketch order, so pairs grow with the bucket's size, not
    its square. What buckets of several classes are left with is joined exactly, so no link between texts that share a
    bucket is missed.
    Words are separated by white space, A-Z in lower case; a text of fewer than five words is one shingle. Texts
    without words are like equal texts only. Null texts are classes of their own (class_id is the id). Rows without an
    id belong to classes by their text; a class of such rows only has a null class_id and keeps one text. Rows of one
    id and text are treated alike, ids are below 2 ** 62. An empty table gives an empty one; further columns are not
    read.
    """
    settings = settings or Sampling()
    bounded(docs.sparkSession)
    md5 = F.md5(F.col(text_col).cast("binary"))
    number = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID).bitwiseOR(F.xxhash64(text_col).bitwiseAND(F.lit(NO_ID - 1))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), number.alias("id"), md5.alias("m"))
    usable = rows.where(F.col("text").isNotNull())
    first = usable.groupBy("m").agg(F.min("id").alias("first"))
    texts = written(usable.select("id", "m", "text").join(first.select(F.col("first").alias("id"), "m"), ["id", "m"], "left_semi").select("id", "text").coalesce(min(1 << 24, 1 + bytes_of(docs) // TASK_BYTES)))
    frequent, documents = frequencies(texts, settings)
    rows_ = documents * settings.bands
    sketched = written(sketches(texts, frequent, settings))
    buckets = sketched.select("id", "whole", F.posexplode("keys").alias("band", "key"))
    crowded = buckets.groupBy("band", "key").agg(F.min(F.struct("id", "whole")).alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = _slim(buckets.join(crowded.select("band", "key", "leader"), ["band", "key"]).select("band", "key", "id", "whole", "leader"), rows_)
    led = members.where((F.col("id") != F.col("leader.id")) & _alike("whole", "leader.whole", settings)).select(F.col("leader.id").alias("u"), F.col("id").alias("v"))
    pairs = _slim(led.union(_neighbours(sketched, settings)).distinct(), rows_)
    links = _slim(verified(pairs, texts, frequent, settings).where(F.col("similarity") >= settings.similarity).select("u", "v"), rows_)
    known = _slim(_labelled(members.select("band", "key", "id", F.col("id").alias("label")), components(links)), rows_)
    several = known.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band", "key")
    waiting = _slim(known.join(several, ["band", "key"], "left_semi").select("id", "label").distinct(), documents)
    links = links.union(_slim(_exact(waiting, texts, frequent, settings), rows_))
    per_text = links.select(F.explode(F.array("u", "v")).alias("first")).groupBy("first").agg(F.count("*").alias("n_links"))
    by_text = _labelled(first.withColumn("label", F.col("first")), components(links))
    by_text = by_text.join(per_text, "first", "left").select("m", "label", "n_links")
    given = F.when(F.col("label") < NO_ID, F.col("label"))
    class_id = F.when(F.col("label").isNull(), F.col("doc_id").cast("bigint")).otherwise(given)
    kept = F.col("label").isNull() | (F.col("label") == F.col("id"))
    return rows.select("doc_id", "id", "m").join(by_text, "m", "left").select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), kept.alias("kept"), F.col("m").alias("text_md5"))
