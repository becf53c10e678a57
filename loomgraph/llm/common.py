"""What the corpus operators share: table access, the shared folder, row keys."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``). Where it is unset a local master, as in tests, gets a folder of
    its own; a cluster raises, since its executors share no temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-"))
    return context.getCheckpointDir()


_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="tables")


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables that are written inside go to a folder of their own, which ``forget`` can delete."""
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, name: str = "tables") -> None:
    """Delete the tables that this session has written in a scope; DataFrames that read them can't be used after."""
    _delete(spark, f"{shared_dir(spark)}/loomgraph/{name}")


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` made, when nothing that is still to be computed reads them."""
    for t in tables:
        _delete(t.sparkSession, t.written_at)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The reread table has a size the planner knows, so later joins broadcast it only if it is below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{_scope.get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


#: Bytes of text of which an Arrow function holds Python objects at once.
PART_BYTES = 1 << 22

_remembered: dict[str, dict] = {}


def remembered(name: str) -> dict:
    """What a Python worker remembers between batches for one function. A worker that goes on to another function, as in the next
    stage of a pipeline, forgets the rest, so its memory doesn't add up."""
    if name not in _remembered:
        if _remembered:
            _remembered.clear()
            release()
        _remembered[name] = {}
    return _remembered[name]


def release() -> None:
    """Give memory that this process has freed back to the system. Workers stay when a stage ends, and what their allocators keep
    counts against the executor while the next stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
    if trim is not None:
        trim(0)


def parts(column: pa.Array) -> Iterator[slice]:
    """Where slices of about ``PART_BYTES`` of a column of texts lie, at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = base = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, base + PART_BYTES, "right")))
        yield slice(start, stop)
        start, base = stop, int(ends[stop - 1])


def in_parts(column: pa.Array, function: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``function`` over the ``parts`` of a column of texts, put together again."""
    done = [function(column[at]) for at in parts(column)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def words(text: Column) -> Column:
    """Number of maximal runs of non-space characters; NULL text has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))
