"""What the operators of this subpackage share: inputs, scratch tables on the shared store, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word, as every operator here counts it: a run of anything but space and the bytes 9 to 13.
#: On UTF-8 bytes this is exactly what bytes.split() without arguments yields.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one is set only on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"formline-checkpoints-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return jsc.getCheckpointDir().get()


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_tables(into: list[str]) -> Iterator[None]:
    """Adds the paths of tables that materialize() writes meanwhile to a list."""
    before = len(_made)
    try:
        yield
    finally:
        into += _made[before:]


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Delete tables that materialize() has written in this process, all or some. For callers that have stored every result built on them."""
    for path in list(_made if paths is None else paths):
        if path in _made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _made.remove(path)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few thousand driver-side rows as a DataFrame without any Python on the executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bytes of an Arrow batch that a Python operator takes at once; one longer row is a batch of its own.
CHUNK = 4 << 20


def chunks(batch: pa.RecordBatch, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes, one row at least, so that long texts do not multiply a worker's memory."""
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        piece = batch.slice(at, step)
        if piece.num_rows > 1 and piece.nbytes > 2 * most:
            half = piece.num_rows // 2
            yield from chunks(piece.slice(0, half), most)
            yield from chunks(piece.slice(half), most)
        else:
            yield piece


def give_back() -> None:
    """Returns what a worker has freed to the system: workers live on after a task, and what they hold is memory that later stages lack."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # there in some C libraries alone
        trim(0)


def settled(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, a function over a task's batches, with give_back() when the task ends."""

    def batches(it: Iterator) -> Iterator:
        try:
            yield from f(it)
        finally:
            give_back()

    return batches


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], schema: str | T.StructType, most: int = CHUNK, after: Callable[[], None] | None = None) -> DataFrame:
    """f applied to slices of df's Arrow batches, of about `most` bytes; it returns columns by name (lists or arrays), or None for no rows.

    after is called when a task ends.
    """
    spark_schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(spark_schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in it:
                yield from results(batch)
        finally:
            if after is not None:
                after()
            give_back()

    def results(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batch, most):
            if (out := f(piece)) is not None:
                yield pa.RecordBatch.from_arrays([x.cast(c.type) if isinstance(x := out[c.name], pa.Array) else pa.array(x, c.type) for c in arrow], schema=arrow)

    return df.mapInArrow(batches, spark_schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; empty for null."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
