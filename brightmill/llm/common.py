"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightmill.session import shared_folder, ship_package


#: Bytes of one batch between the JVM and a Python worker. With long texts, batches of Spark's default size
#: take several times their size in either process.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; prepares the session for the operators' Python workers."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def check_names(*tables: DataFrame) -> None:
    """Column names that begin with two underscores are the operators' own."""
    for df in tables:
        if taken := [c for c in df.columns if c.startswith("__")]:
            raise ValueError(f"columns {taken}: names that begin with two underscores are reserved")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of checkpoints that nothing reads any more, instead of when the driver's garbage is collected."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def rest_driver(df: DataFrame) -> None:
    """Between the many small jobs of a loop: plans and generated classes that are done with otherwise stay until the driver's
    heap is full, with native memory that the heap doesn't show. What the JVM has freed of that goes back to the system, where
    the JVM knows how to; the C library keeps it otherwise, in an arena for each of some hundred threads."""
    gc.collect()
    jvm = df.sparkSession._jvm
    jvm.System.gc()
    invoke = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    arguments = df.sparkSession.sparkContext._gateway.new_array(jvm.Object, 4)
    arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JJavaError:  # an older JVM, or not Linux
        pass


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Characters of text that numpy work in a task holds at a time.
SLICE = 1 << 18


def slices(texts: list[str | None], chars: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of at most `chars` characters, or of one longer text; null texts are empty."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > chars:
            yield start, run
            start, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield start, run


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives its memory back when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):  # noqa: ANN001, ANN202  the annotations are those of `run`
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    """Gives freed memory back at a task's end; the worker process lives on beside later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
