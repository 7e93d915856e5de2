"""Sessions, and Python code on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that Python workers are handed at a time, where the session leaves Spark's setting alone.
BATCH_BYTES = "4m"
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each application."""
    if spark.conf.get(_BATCH_KEY, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="tempolith-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(name)
    atexit.register(Path(name).unlink, missing_ok=True)
    _shipped.add(sc.applicationId)


def give_back() -> None:
    """Hand memory that is free back to the system: workers stay, and wait beside their JVM."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def map_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``df.mapInPandas(f, schema)`` with this package importable on the executors."""
    ship(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        give_back()

    return df.mapInPandas(run, schema)


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="tempolith-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves that unset in local mode (tests) is a temporary
    folder of this process used; on a cluster that is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (told or _own_dir()).rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tempolith-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    so a lost executor costs a re-read, not a recomputation."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tempolith_path = path  # type: ignore[attr-defined]
    return back


def drop_written(*dfs: DataFrame) -> None:
    """Remove tables of :func:`written` that no later step reads."""
    for df in dfs:
        path = getattr(df, "_tempolith_path", None)
        if path:
            jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def local_session(cpus: int = 8, partitions: int | None = None, name: str = "tempolith") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
