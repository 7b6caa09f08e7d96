"""Shared helpers of the training-data operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: bytes of text that one vectorised step holds at a time
BATCH_BYTES = 2 << 20
#: a key with more than this part of all rows is hot
HOT_KEYS = 1000
#: how many bytes an Arrow batch may have
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: removes a query's shuffle files when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session leaves it unset (tests on one machine) is one made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="sourceloom-")
        found = _own[app]
    return found.rstrip("/")


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what lies
    before. The shuffle files of the write go with it, as nothing reads them
    again; the files written go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def stored_counting(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """``stored``, and how many rows meet ``condition`` (all without one), counted while they are written.

    Looking into the stored table instead takes further jobs, several where no row is found.
    A stage that runs again may count twice: only zero and more than zero are certain.
    """
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(F.lit(True) if condition is None else condition).alias("n")))
    return out, seen.get["n"]


_forget: dict[str, Callable[[], None]] = {}


def keeps(name: str, forget: Callable[[], None]) -> None:
    """A worker process keeps something between tasks, until one begins that does not use it."""
    _forget[name] = forget


def drop_others(uses: str) -> None:
    for name, forget in _forget.items():
        if name != uses:
            forget()


def give_back() -> None:
    """What this worker process no longer uses goes back to the system: it is used again by other stages, beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, unless the session says how large: by rows alone, those of long texts fill the JVM and the worker."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(4 * BATCH_BYTES))


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[Iterator[list[list]]], Iterator[dict]], schema: str, uses: str = "") -> DataFrame:
    """``mapInArrow`` over chosen columns; ``uses`` names what the worker process may keep (see ``keeps``).

    ``fn`` gets an iterator of chunks (lists of Python columns, at most about
    BATCH_BYTES of text each) and yields dicts of column lists.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)
    limit = BATCH_BYTES

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        for batch in batches:
            rows = batch.num_rows
            size = sum(c.nbytes for c in batch.columns)
            step = max(1, min(rows, int(rows * limit / max(size, 1)) or 1)) if rows else 1
            for at in range(0, rows, step):
                yield [c.slice(at, step).to_pylist() for c in batch.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(uses)
        for cols in fn(chunks(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return df.select(*columns).mapInArrow(run, out)


def keep_rows(df: DataFrame, text: str, judge: Callable[[], Callable[[list[bytes]], list]], keeps: Callable[[object], bool]) -> DataFrame:
    """The rows, all columns as they are, of whose texts ``keeps`` accepts the judgement (null: empty text).

    ``judge`` is called once in each task and gives what judges a list of texts.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("")
        judged = judge()
        for batch in batches:
            size = max(1, batch.column(at).nbytes)
            step = max(1, min(batch.num_rows, int(batch.num_rows * BATCH_BYTES / size)))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                verdicts = judged([(x or "").encode() for x in part.column(at).to_pylist()])
                yield part.filter(pa.array([keeps(v) for v in verdicts], pa.bool_()))
        del judged
        give_back()

    numbered = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # names with dots and the like stay out of it
    return numbered.mapInArrow(run, numbered.schema).toDF(*df.columns)


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """All columns in one, ``row``, beside those named: whatever is added then clashes with no column's name."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *names)


def brought_back(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns set aside, some of them anew."""
    return df.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the one row of ``right`` (stored) for its key; ``n`` of ``right`` says how many rows of ``left`` have it.

    Keys with over a HOT_KEYS-th of all rows are HOT_KEYS at most: those rows of
    ``right`` are broadcast, so that no task gets all of a hot key's rows.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(right.where(F.col("n") > total // HOT_KEYS).drop("n"))
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("n") <= total // HOT_KEYS).drop("n"), key)
    return left.join(hot, key).unionByName(rest)


def with_bytes(df: DataFrame, text: str = "text") -> DataFrame:
    """The text as UTF-8 bytes (null: empty), as column ``raw``."""
    return df.withColumn("raw", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
