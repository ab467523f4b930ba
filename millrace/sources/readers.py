"""One facade over Spark's readers and writers, with modality detection and target separation."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import nan_to_null
from millrace.sources.modality import EXTENSIONS, by_extension

#: JSON fields that may hold a record's text, in order (fixed values).
TEXT_FIELDS = ("text", "content", "message", "body", "description")
ARRAY_FIELDS = ("text", "content", "data", "items")


class EngineError(Exception):
    """Base of this package's errors."""


class DataNotFound(EngineError):
    """A path or a column isn't there."""


class UnsupportedFormat(EngineError):
    """No reader for a format here."""


@dataclass(frozen=True)
class DatasetSpec:
    """Which columns of a table are the row key, the features and the target, and its modality."""

    key: str
    features: tuple[str, ...]
    target: str | None = None
    modality: str = "tabular"

    def separate(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(key and features, key and target); a missing target is an error."""
        if self.target is None:
            return df.select(self.key, *self.features), None
        if self.target not in df.columns:
            raise DataNotFound(f"no target column {self.target!r} among {df.columns}")
        return df.select(self.key, *(f for f in self.features if f != self.target)), df.select(self.key, self.target)


def modality_of(path: str) -> str:
    name = os.path.basename(path.rstrip("/"))
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    return next((kind for kind, names in EXTENSIONS.items() if ext in names), "unknown")


def read(spark: SparkSession, path: str, modality: str | None = None) -> DataFrame:
    """A table for whatever lies at ``path``, by its modality and extension."""
    kind, ext = modality or modality_of(path), path.rpartition(".")[2].lower()
    if kind == "tabular":
        if ext in ("csv", "tsv"):
            return nan_to_null(spark.read.csv(path, header=True, inferSchema=True, sep="\t" if ext == "tsv" else ","))
        if ext == "parquet":
            return nan_to_null(spark.read.parquet(path))
        if ext == "feather":
            return read_feather(spark, path)
        raise UnsupportedFormat(f"no reader for .{ext} files here")
    if kind == "text":
        return read_json_text(spark, path) if ext in ("json", "jsonl") else read_lines(spark, path)
    if kind in ("image", "audio", "video"):
        return media(spark, path, kind)
    raise UnsupportedFormat(f"can't tell what {path} is")


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Feather files through a binary scan, each read by the task that holds it; the schema comes from one file's header."""
    import pyarrow as pa
    import pyarrow.feather as feather

    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.limit(1).mapInArrow(_feather_schema, "schema binary").first()
    if head is None:
        raise DataNotFound(path)
    schema = pa.ipc.read_schema(pa.py_buffer(bytes(head[0])))
    from pyspark.sql.pandas.types import from_arrow_schema

    def tables(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from feather.read_table(pa.BufferReader(content.as_buffer())).to_batches()

    return nan_to_null(files.mapInArrow(tables, from_arrow_schema(schema)))


def _feather_schema(batches):
    import pyarrow as pa
    import pyarrow.feather as feather

    for batch in batches:
        for content in batch.column(0):
            schema = feather.read_table(pa.BufferReader(content.as_buffer())).schema
            yield pa.RecordBatch.from_arrays([pa.array([schema.remove_metadata().serialize().to_pybytes()], pa.binary())], names=["schema"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that aren't empty."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias("text")).where("text <> ''")


def text_of_json(record: Column, fields=TEXT_FIELDS) -> Column:
    """The first of the text fields that a JSON record has, else the record itself."""
    return F.coalesce(*(F.get_json_object(record, f"$.{f}") for f in fields), record)


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """Texts of a JSON Lines file, or of the elements of one JSON array per file."""
    if path.endswith("jsonl"):
        return spark.read.text(path).where("trim(value) <> ''").select(text_of_json(F.col("value")).alias("text"))
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>")
    many = whole.where(F.rlike("value", F.lit(r"^\s*\["))).select(F.explode(items).alias("item")).select(text_of_json(F.col("item")).alias("text"))
    one = whole.where(~F.rlike("value", F.lit(r"^\s*\["))).select(text_of_json(F.col("value"), ARRAY_FIELDS).alias("text"))
    return many.unionAll(one)


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, class_name, class_id) of a directory of texts with a sub-directory for each class; empty ones go."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = files.select(F.input_file_name().alias("path"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    return with_class_ids(rows.withColumn("class_name", F.element_at(F.split("path", "/"), -2)))


def with_class_ids(df: DataFrame, name: str = "class_name", out: str = "class_id") -> DataFrame:
    """``df`` with the place of each class among the sorted class names; -1 for no class. Classes are few and counted by Spark."""
    from pyspark.sql import Window as W

    ids = df.where(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct().withColumn("_id", F.row_number().over(W.orderBy("_name")) - 1)
    return df.join(ids, F.col(name) == F.col("_name"), "left").select(*df.columns, F.coalesce("_id", F.lit(-1)).alias(out))


def media(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Paths, sizes and times of media files of one modality; contents are read only if a later step selects them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(by_extension(F.col("path")) == kind)


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Results as parquet, json or csv."""
    if form not in ("parquet", "json", "csv"):
        raise UnsupportedFormat(form)
    options = {"header": "true"} if form == "csv" else {}
    df.write.mode(mode).options(**options).format(form).save(path)


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Every leaf of nested structs as a column named by its path."""
    from pyspark.sql import types as T

    def leaves(schema, above):
        for f in schema:
            here = [*above, f.name]
            yield from leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [here]

    return df.select(*(F.col(".".join(f"`{p}`" for p in leaf)).alias(separator.join(leaf)) for leaf in leaves(df.schema, [])))


def rows_at(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among ``keys`` (a table with a column of that name)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def require_rows(df: DataFrame, least: int) -> DataFrame:
    """``df``, or an error if it has fewer rows; no more than ``least`` are read."""
    if df.limit(least).count() < least:
        raise EngineError(f"fewer than {least} rows")
    return df
