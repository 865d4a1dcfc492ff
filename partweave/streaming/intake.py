"""Files that arrive in a folder: each is processed once, logged, and moved away by the stream's own source.

The log has one folder per number of a micro-batch and is only added to, since a stream whose checkpoint is lost
counts from 0 again. A file is named by its path: one that is logged is not processed again, neither by a
batch that runs again after a failure nor by a new stream. The source moves a batch's files once the batch is committed, so a restart
finds them either in the folder or in the archive and moves none twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What a log says of each file.
LOG = "path string, success boolean, batch long"


def arriving(spark: SparkSession, folder: str, archive: str, pattern: str = "*.{doc,docx}", most_files: int = 1000) -> DataFrame:
    """A stream of a folder's files, at most ``most_files`` a batch, whose finished ones the source moves to ``archive``."""
    options = {"pathGlobFilter": pattern, "cleanSource": "archive", "sourceArchiveDir": archive, "maxFilesPerTrigger": most_files}
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").options(**options).load(folder)


def logged(spark: SparkSession, log: str) -> DataFrame:
    """The rows of a log, none where it was never written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(log)


def take_in(files: DataFrame, process: Callable[[DataFrame], DataFrame], log: str, checkpoint: str) -> StreamingQuery:
    """Runs ``process`` over each batch of new files, for all that is there now, and logs its result.

    ``process`` gives ``path`` and ``success`` of every file it got and writes what it makes by itself, in a way that
    may be repeated. Files without a result are logged as failed.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = logged(spark, log).select("path")
        new = rows.join(before, "path", "left_anti")
        done = process(new).groupBy("path").agg(F.min("success").alias("success"))
        result = new.select("path").join(done, "path", "left").select("path", F.coalesce("success", F.lit(False)).alias("success"))
        result.write.mode("append").json(f"{log}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
