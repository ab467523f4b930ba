"""Tables written once in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir or the context names; a folder of one's own only in a local session that names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(folder)
    return folder


#: How many rows go to Python at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, batch: int | None = None) -> DataFrame:
    """``df`` as a Parquet table, read again: its lineage is cut, and a lost executor costs no more than one read.

    With ``batch``, no more rows than this go to Python at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    if batch is not None and not 0 < int(before) <= batch:
        spark.conf.set(BATCH, str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.millrace_folder = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables that nothing still to be computed reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.millrace_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
