"""What a Spark session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent
        archive = os.path.join(tempfile.mkdtemp(prefix="partweave-"), "partweave-package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, f"{package.name}/{path.relative_to(package)}")
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


#: A scan's rows are dealt anew where one of its partitions has more than this many times the share of a core.
MOST_SHARES = 2


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A plain scan's rows dealt to all cores, by ``keys`` if given, where few row groups hold them; else the scan as it is.

    For work that is heavy for each row. A file's splits do not tell: a row group goes to one of them whole, and
    the others are empty. So where there are as many splits as cores, rows are counted by split, which
    reads no column that ``scan`` does not filter by.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan._jdf.queryExecution().toRdd().getNumPartitions()
    if splits >= cores:
        counts = scan.select(F.spark_partition_id().alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
        most, rows = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if most * cores <= MOST_SHARES * rows:
            return scan
    return scan.repartition(max(cores, splits), *keys)


#: Rows of one task where many small rows are sorted by a key.
TASK_ROWS = 200_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, about ``n``, by ``keys`` in as many partitions as keep each to ``TASK_ROWS``, the session's number at least.

    Joins and groups by these keys keep that number, so what a task sorts does not grow with the table.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // TASK_ROWS)), *keys)


#: Bytes of one Arrow batch, for row functions that make or hold several times what comes in.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> SparkSession:
    """Lowers the bytes of the session's Arrow batches to ``most``, so that a worker's memory depends on the longest row and not on the table.

    Plans read that setting when they run, after the operator has returned, so it stays set. A session
    that has chosen less keeps it.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)) <= most:
        spark.conf.set(setting, str(most))
    return spark


def give_back() -> None:
    """Returns what a worker has freed to the system; workers serve many operators and otherwise keep the most that any of them held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than the one that keeps it
        pass


_work: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder of this application below ``spark.checkpoint.dir``, which driver and executors share.

    A local run without that setting has a temporary folder; a cluster without it raises.
    """
    context = spark.sparkContext
    if context.applicationId not in _work:
        top = context.getConf().get("spark.checkpoint.dir", None)
        if not top:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="partweave-work-")
            atexit.register(shutil.rmtree, top, True)
        _work[context.applicationId] = f"{top.rstrip('/')}/partweave-work-{context.applicationId}"
    return f"{_work[context.applicationId]}/{uuid.uuid4().hex}"
