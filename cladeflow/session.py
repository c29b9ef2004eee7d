"""Session helpers: tables, shared scratch folders, shipping the package to executors."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, on whatever store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is missing (tests, a local master) a fresh temporary folder is set as the
    checkpoint folder; on a cluster the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cladeflow-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Scratch paths of this process that are still there, in the order they were made.
_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder, removed when the driver ends or by drop_scratch."""
    path = f"{shared_dir(spark).rstrip('/')}/cladeflow-{name}-{uuid.uuid4().hex[:12]}"
    if not _scratch:
        atexit.register(drop_scratch, spark)
    _scratch.append(path)
    return path


def scratch_mark() -> int:
    """What drop_scratch needs to spare the tables that are there now."""
    return len(_scratch)


def drop_scratch(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Remove the scratch tables made after `since` marks, except the `last` newest; frames that read them can't be used any more."""
    end = max(since, len(_scratch) - last)
    for path in _scratch[since:end]:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # at the driver's end the JVM may be gone already
            pass
    del _scratch[since:end]


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: it cuts lineage and survives lost executors.

    With `files` its last tasks are merged to so many at most (see few_files).
    """
    path = scratch(df.sparkSession, name)
    merged(df, files).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame, files: int | None) -> DataFrame:
    """df with its partitions merged, without a shuffle, to so many at most; None: as it is."""
    return df.coalesce(files) if files else df


def few_files(docs: DataFrame, rows: DataFrame | None = None) -> int | None:
    """Files for tables that are small beside docs: one for 4 MB or 4,096 rows of docs (counted in `rows`, if given), one a core at least.

    None where a shuffle has no more partitions than that, or the size of docs isn't known (Spark takes it as huge).
    A small table behind a shuffle of many partitions is otherwise a tiny file from each of them. On a local
    folder, without Hadoop's native library, every file has the executor start two processes (chmod), which until they
    run their own program share the JVM's memory and are counted with it.
    """
    spark = docs.sparkSession
    least, most = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(least, int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // (4 << 20) + 1)
    if files < most:
        files = max(files, (docs if rows is None else rows).count() // 4096 + 1)
    return files if files < most else None


def trimmed(run: Callable, rows: int = 512) -> Callable:
    """run for mapInArrow, on batches of at most `rows`, with memory given back at the end: a Python worker
    lives on for the next task, and Spark's batches of thousands of texts would stand in it several times."""

    def cut(batches: Iterator) -> Iterator:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)

    def kept_small(batches: Iterator) -> Iterator:
        try:
            yield from run(cut(batches))
        finally:
            import ctypes

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return kept_small


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="cladeflow-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
