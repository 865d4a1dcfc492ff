"""Session helpers that several operators of this folder share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.session import ship

#: Words are maximal runs of other characters than these six (space, tab, LF, VT, FF, CR).
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Rows of one Arrow batch: with whole texts in a row, fewer than Spark's default keeps workers small.
ARROW_ROWS = 512

_folders: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, arrow_rows: int | None = ARROW_ROWS) -> SparkSession:
    """Sends executors this package, and lowers the session's Arrow batches to ``arrow_rows`` for operators that hold whole texts.

    Plans read that setting when they run, after the operator has returned, so it stays set. A session
    that has chosen fewer rows keeps them; with None the setting is left alone.
    """
    ship(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if arrow_rows is not None and not 0 < int(spark.conf.get(setting)) <= arrow_rows:
        spark.conf.set(setting, str(arrow_rows))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for written tables, below ``spark.checkpoint.dir``.

    Where that setting is absent, a local run (tests) has a temporary folder in its place; on a cluster,
    whose executors would each write to a disk of their own, it raises. The folder goes when the driver
    ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not top:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = os.path.join(tempfile.gettempdir(), "partweave-tables")
        _folders[app] = f"{top.rstrip('/')}/partweave-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:  # the session ended first; the folder stays for the cluster's own cleaning
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as a table to the shared folder and read again.

    What follows has the table's real size and plain scans: joins on it can be broadcast or split by
    Spark as that size and its skew ask for, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _paths[written] = path
    return written


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that ``cut`` wrote, once all that is derived from them is written itself; others are left alone."""
    for df in tables:
        path = _paths.pop(df, None) if df is not None else None
        if path is not None:
            _remove(df.sparkSession, path)


def fold(key: Column, folds: int) -> Column:
    """Fold number of a row: crc32 of the key written as text, modulo the number of folds."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
