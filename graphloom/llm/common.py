"""Session settings, row-wise Arrow maps and shared-folder helpers used by the text operators."""

from __future__ import annotations

import ctypes
import functools
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Compressed input bytes that one block of documents holds, about.
BLOCK_BYTES = 2 << 20
#: Name of the column that deals documents to blocks.
BLOCK = "__block"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the session has it; only where that is unset (tests on
    one machine) a temporary folder is made and set."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    if not configured and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = configured or tempfile.mkdtemp(prefix="checkpoints")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, removed when the driver ends. Columns stay as they are; unlike a
    checkpoint the files are compressed and a reader prunes columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between the JVM and a Python worker, either way.
ARROW_BYTES = 8 << 20
_ARROW, _UNBOUNDED = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded(spark: SparkSession) -> None:
    """Bounds the Arrow batches the session sends, where it has Spark's default: batches lie outside the heap, on both
    sides. What Python returns is cut by ``tidy``: cut by Spark (maxBytesPerOutputBatch), a batch loses its columns."""
    if spark.conf.get(_ARROW, _UNBOUNDED) == _UNBOUNDED:
        spark.conf.set(_ARROW, f"{ARROW_BYTES}b")


def in_parts(table_: pa.Table, most: int = ARROW_BYTES) -> pa.Table:
    """table_ in chunks of at most so many bytes each, or one row."""
    if table_.num_rows < 2 or table_.nbytes <= most:
        return table_
    half = table_.num_rows // 2
    return pa.concat_tables([in_parts(table_.slice(0, half), most), in_parts(table_.slice(half), most)])


def bytes_of(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; for a Parquet scan the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def block_count(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks to deal df's rows to: as many as its size asks for, and no fewer than shuffle partitions."""
    bounded(df.sparkSession)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 24, math.ceil(bytes_of(df) / block_bytes)))


def with_block(df: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """df and the number of each row's block, which follows from the given columns (nulls have one too)."""
    return df.withColumn(BLOCK, F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"))


@functools.lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Gives freed memory back to the system. Python workers outlive their tasks and wait beside those at work, so what
    the allocators keep for later would add up."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def tidy(function: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """function, its result in parts of bounded bytes, and memory released once it is done with a group."""

    def run(*tables):
        try:
            return in_parts(function(*tables))
        finally:
            released()

    # Spark tells a key's argument by the number of parameters
    return (lambda one: run(one)) if function.__code__.co_argcount == 1 else (lambda one, other: run(one, other))


def extended(schema: T.StructType, fields: list[tuple[str, str]]) -> T.StructType:
    """schema and the new fields; a column of the same name gives way."""
    new = {name for name, _ in fields}
    kept = [f for f in schema.fields if f.name not in new]
    return T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])


def pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` text bytes each, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64"))
    start, base = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])


def append_columns(
    df: DataFrame, make: Callable[[], Callable[[pa.Array], dict[str, pa.Array]]], fields: list[tuple[str, str]],
    text_col: str = "text", piece_bytes: int = 4 << 20, done: Callable[[], None] | None = None,
) -> DataFrame:
    """df's rows with the columns ``make()(texts)`` returns, computed on Arrow batches cut to ``piece_bytes`` of text.

    ``make`` runs once in each task and returns the function that takes a string array (nulls kept) to a dict with
    one array for each of ``fields``; ``done()`` ends a task. No shuffle; a column of the same name is replaced.
    """
    bounded(df.sparkSession)
    schema = extended(df.schema, fields)
    kept = [f.name for f in schema.fields[: len(schema) - len(fields)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            texts = batch.column(text_col)
            for start, stop in pieces(texts, piece_bytes):
                part = batch.slice(start, stop - start)
                made = function(part.column(text_col))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + [made[n] for n, _ in fields], names=schema.names)
        if done is not None:
            done()
        released()

    return df.mapInArrow(run, schema)
