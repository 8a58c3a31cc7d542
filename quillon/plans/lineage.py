"""Cutting lineage in iterative plans, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Folders of settled tables by application, swept when the driver's Python ends.
_ROOTS: dict[str, tuple] = {}
#: Parts of one table that are written at the same time.
AT_ONCE = 4
#: The tables settled within the open ``temporary`` blocks of a thread.
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set and the session is local."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def _delete(jvm, conf, at: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(conf).delete(path, True)


def _sweep() -> None:
    for at, (jvm, conf) in _ROOTS.items():
        try:
            _delete(jvm, conf, at)
        except (Py4JError, OSError):  # the JVM is gone already; the folder stays for whoever owns it
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name within the shared folder; what is written there goes when the driver ends."""
    root = f"{shared_dir(spark)}/settled/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        if not _ROOTS:
            atexit.register(_sweep)
        _ROOTS[root] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return f"{root}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them again.

    Iterative plans stay short, and a lost executor costs no recomputation.  The rows go with the ``temporary`` block
    around the call, by ``release``, or when the driver ends.
    """
    return settle_all([df])


def settle_all(parts: list[DataFrame]) -> DataFrame:
    """``settle`` of the union of parts with the same columns: each is planned and written by itself, all are read as one table.

    Parts are written a few at a time, as the last tasks of one leave cores idle.
    """
    spark, at, columns = parts[0].sparkSession, scratch(parts[0].sparkSession, "table"), parts[0].columns
    to = [at] if len(parts) == 1 else [f"{at}/{k}" for k in range(len(parts))]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        write = inheritable_thread_target(spark)(lambda part, path: part.select(*columns).write.option("compression", "zstd").parquet(path))
        list(pool.map(write, parts, to))
    out = spark.read.schema(parts[0].schema).parquet(*to)
    out._settled_at = at
    for made in getattr(_OPEN, "blocks", ())[-1:]:
        made.append(out)
    return out


def keep(table: DataFrame) -> DataFrame:
    """Takes a settled table out of the ``temporary`` block around it: a plan that outlives the block reads it."""
    blocks = getattr(_OPEN, "blocks", [])
    if blocks:
        blocks[-1][:] = [t for t in blocks[-1] if t is not table]
        if len(blocks) > 1:
            blocks[-2].append(table)
    return table


@contextmanager
def temporary() -> Iterator[None]:
    """Deletes the tables that are settled within the block when it ends, but those of ``keep``."""
    _OPEN.blocks = [*getattr(_OPEN, "blocks", ()), made := []]
    try:
        yield
    finally:
        _OPEN.blocks = _OPEN.blocks[:-1]
    release(*made)


def release(*tables: DataFrame) -> None:
    """Deletes settled tables; only for tables that no plan still to run reads."""
    for t in tables:
        at = t.__dict__.get("_settled_at")
        if at:
            _delete(t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration(), at)
