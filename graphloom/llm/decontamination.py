"""Benchmark decontamination as a prefix-filtered set join, in DataFrame and SQL functions alone.

An item's windows are sets of positioned shingles. Documents are scanned once for places whose shingle some window
has; among those, shingles are ordered by rarity, and a window joins on the shingles that no occurrence can lack: for
exact containment one, the rarest. Bounds on position and length drop candidates that would not fit into the document,
and what is left is verified: every shingle of the window must stand at its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import bytes_of, written

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 13, 3
#: Compressed bytes of a benchmark side that is broadcast, at most; beyond it the joins shuffle.
BROADCAST_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    """Words of the text: A-Z in lower case, ASCII signs other than letters and digits between words; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else df


def windows_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: window_id, words, size, and the sorted item ids (strings) they come from."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where((F.size("words") > 0) & F.col("item").isNotNull())
    n = F.least(F.size("words"), F.lit(WINDOW))
    each = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))).alias("words"))
    found = each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return written(found.withColumn("size", F.size("words")).withColumn("window_id", F.monotonically_increasing_id()))


def shingles_of(windows: DataFrame) -> DataFrame:
    """window_id, offset, and the shingle w0, w1, w2 there; a window of fewer words is one shingle with nulls."""
    k = F.least(F.col("size"), F.lit(SHINGLE))
    place = F.posexplode(F.sequence(F.lit(0), F.col("size") - k)).alias("offset", "__i")
    return windows.select("window_id", "size", "words", place).select("window_id", "size", "offset", *[F.get("words", F.col("offset") + i).alias(f"w{i}") for i in range(SHINGLE)])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, items (sorted ids) and contaminated.

    A window is 13 consecutive words of an item, or all words of a shorter one; n_hit counts the document's words
    inside any occurrence of a window, n_items the items with occurring windows; contaminated: a twentieth of the
    words at least. Null and empty texts have no words and no hits; items without an id or a word have no window.
    Repeated rows each get their result; rows with one id and different texts are told apart by the text; null ids
    work. Columns with the result's names are replaced, others pass through. Either table may be empty.
    """
    spark = docs.sparkSession
    windows = windows_of(benchmark, item_col, item_text_col)
    placed = shingles_of(windows)
    vocabulary = written(placed.select("w0", "w1", "w2").distinct().withColumn("sid", F.monotonically_increasing_id()))
    sizes = [r[0] for r in windows.select(F.least(F.col("size"), F.lit(SHINGLE))).distinct().collect()]  # of 1 to 3
    key = ["__id", "__h"]
    tokens = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__h"), words_of(F.col(text_col)).alias("__words"))
    tokens = tokens.withColumn("__n", F.size("__words"))
    parts = []
    for k in sorted(sizes):
        zipped = F.arrays_zip(*[(F.col("__words") if not i else F.slice("__words", F.lit(i + 1), F.greatest(F.col("__n"), F.lit(1)))).alias(f"w{i}") for i in range(k)])
        here = tokens.select(*key, "__n", F.posexplode(zipped).alias("pos", "w")).select(*key, "__n", "pos", *[F.col("w").getField(f"w{i}").alias(f"d{i}") for i in range(k)])
        known = _small(vocabulary.where(F.col(f"w{k - 1}").isNotNull() & (F.col(f"w{k}").isNull() if k < SHINGLE else F.lit(True))))
        parts.append(here.join(known, [F.col(f"d{i}") == F.col(f"w{i}") for i in range(k)]).select(*key, "__n", "pos", "sid"))
    found = parts[0] if parts else spark.createDataFrame([], T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("__h", T.LongType()), T.StructField("__n", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("sid", T.LongType())]))
    for part in parts[1:]:
        found = found.unionByName(part)
    matched = written(found)

    # rarity over all documents; the rarest shingle of each window is its prefix
    rarity = matched.groupBy("sid").agg(F.count("*").alias("n"))
    same = [F.col(f"p.w{i}").eqNullSafe(F.col(f"v.w{i}")) for i in range(SHINGLE)]
    window_shingles = written(placed.alias("p").join(vocabulary.alias("v"), same).select("window_id", "size", "offset", "sid"))
    ranked = window_shingles.join(rarity, "sid", "left").groupBy("window_id", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sid", "offset")).alias("rarest"),
        F.sort_array(F.collect_list(F.struct("offset", "sid"))).alias("shingles"),
    )
    prefix = written(ranked.where("rarest.n > 0").select("window_id", "size", F.col("rarest.sid").alias("sid"), F.col("rarest.offset").alias("offset"), "shingles"))
    start = F.col("pos") - F.col("offset")
    candidates = matched.join(_small(prefix), "sid").where((start >= 0) & (start + F.col("size") <= F.col("__n"))).select(*key, start.alias("start"), "window_id", "size", "shingles").distinct()
    # verification: every shingle of the window at its place
    probes = candidates.select(*key, "start", "window_id", "size", F.size("shingles").alias("needed"), F.explode("shingles").alias("s")).select(
        *key, "start", "window_id", "size", "needed", (F.col("start") + F.col("s.offset")).alias("pos"), F.col("s.sid").alias("sid"))
    places = matched.select(*[F.col(c).alias(f"m{c}") for c in key], F.col("pos").alias("mpos"), F.col("sid").alias("msid"))
    there = probes.join(places, [F.col(c).eqNullSafe(F.col(f"m{c}")) for c in key] + [F.col("pos") == F.col("mpos"), F.col("sid") == F.col("msid")], "left_semi")
    occurs = written(there.groupBy(*key, "start", "window_id", "size").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n = needed").select(*key, "start", "window_id", "size"))

    # words inside any occurrence: the part of each interval that no earlier one has covered
    ends = occurs.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = F.coalesce(F.max("end").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = ends.withColumn("covered", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), before))).groupBy(*key).agg(F.sum("covered").cast("bigint").alias("n_hit"))
    items = occurs.select(*key, "window_id").distinct().join(_small(windows.select("window_id", "items")), "window_id").select(*key, F.explode("items").alias("item")).distinct()
    listed = items.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    result = hits.alias("a").join(listed.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left").select(*[F.col(f"a.{c}").alias(f"r{c}") for c in key], "n_hit", "items")

    new = ["n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"]
    kept = [c for c in docs.columns if c not in new]
    counted = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(kept)], F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__h"), F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), "")).cast("bigint").alias("n_words"))
    out = counted.join(result, [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in key], "left")
    n_hit, found_items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], "n_words", n_hit.cast("bigint").alias("n_hit"), F.size(found_items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found_items, ","), 256).alias("items_sha256"), found_items.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
