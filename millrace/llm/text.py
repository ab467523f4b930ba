"""What the corpus operators share: words, folds, and the tables they read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are none of space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same folding for UTF-8 bytes; bytes above 127 stay.
FOLD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_is(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def n_words(text: Column) -> Column:
    """Words of a text, 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def others(df: DataFrame, *replaced: str) -> list[str]:
    """The names of ``df``'s columns but for the replaced ones, quoted for use in a select."""
    gone = {c.lower() for c in replaced}
    return [quoted(c) for c in df.columns if c.lower() not in gone]


def prefix(df: DataFrame) -> str:
    """What no column name of ``df`` begins with."""
    found = "_"
    while any(c.startswith(found) for c in df.columns):
        found += "_"
    return found


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: what spark.checkpoint.dir or the context names; of one's own only in a local session."""
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
    """``df`` written as a Parquet table in the shared folder and read again; its lineage is cut. ``drop`` deletes it.

    With ``batch``, no more rows than this go to Python at once: wide rows fill an executor's memory in the session's number.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    if batch is not None and not 0 < int(before) <= batch:
        spark.conf.set(BATCH, str(batch))
    try:
        df.write.option("compression", "zstd").parquet(path)
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
