"""File modality by extension, MIME type and content, as expressions over paths and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The extensions of each modality.
EXTENSIONS = {
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "svg", "ico"],
    "text": ["txt", "md", "rst", "log", "json", "xml", "html", "htm"],
    "tabular": ["csv", "tsv", "xlsx", "xls", "parquet", "feather", "h5", "hdf5"],
    "audio": ["wav", "mp3", "flac", "aac", "ogg", "m4a", "wma"],
    "video": ["mp4", "avi", "mov", "mkv", "wmv", "flv", "webm", "m4v"],
}
#: MIME types with a modality of their own; others go by what stands before the slash.
MIME_EXACT = {
    "application/json": "text",
    "application/xml": "text",
    "text/csv": "tabular",
    "application/vnd.ms-excel": "tabular",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "tabular",
}
MIME_FAMILIES = ["image", "text", "audio", "video"]
#: First bytes in hex, tried in this order.
SIGNATURES = [
    ("image", ["FFD8FF", "89504E470D0A1A0A", "47494638", "424D", "52494646", "00000100"]),
    ("audio", ["494433", "FFFB", "664C6143", "4F676753"]),
    ("video", ["00000018667479706D7034", "00000020667479706D7034"]),
]
SNIFFED = 1024


def extension(path: Column) -> Column:
    """What follows the last dot of the last path segment, in lower case; NULL without one."""
    found = F.lower(F.regexp_extract(path, r"[^/]\.([^./?#]+)$", 1))
    return F.when(found != "", found)


def by_extension(path: Column) -> Column:
    ext = extension(path)
    out = F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        out = F.coalesce(out, F.when(ext.isin(names), F.lit(kind)))
    return F.coalesce(out, F.lit("unknown"))


def is_supported(path: Column) -> Column:
    return by_extension(path) != "unknown"


def supported_extensions(spark: SparkSession) -> DataFrame:
    rows = [(kind, e) for kind, names in EXTENSIONS.items() for e in names]
    return spark.createDataFrame(rows, "modality string, extension string")


def by_mime(mime: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in MIME_EXACT.items():
        out = F.coalesce(out, F.when(mime == name, F.lit(kind)))
    for family in MIME_FAMILIES:
        out = F.coalesce(out, F.when(F.startswith(mime, F.lit(family + "/")), F.lit(family)))
    return F.coalesce(out, F.lit("unknown"))


def by_bytes(content: Column) -> Column:
    """Modality of binary content by its first bytes; NULL for content without a NUL byte, which is text."""
    head = F.hex(F.substring(content, 1, SNIFFED))
    out = F.lit(None).cast("string")
    for kind, heads in SIGNATURES:
        for h in heads:
            out = F.coalesce(out, F.when(F.startswith(head, F.lit(h)), F.lit(kind)))
    return F.when(F.rlike(head, F.lit("^(..)*?00")), F.coalesce(out, F.lit("unknown")))


def by_text(content: Column) -> Column:
    """``tabular`` if a delimiter is about as frequent on lines 2 and 3 as on line 1 (by one at most), else ``text``."""
    lines = F.split(F.regexp_replace(content, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), "\n")
    count = lambda line, d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    hit = F.lit(False)
    for d in (",", "\t", ";"):
        first = count(F.get(lines, F.lit(0)), d)
        near = _near(lines, d, first, count)
        hit = hit | ((first > 0) & near)
    return F.when((F.size(lines) >= 2) & hit, "tabular").otherwise("text")


def _near(lines: Column, d: str, first: Column, count) -> Column:
    return F.forall(F.slice(lines, 2, 2), lambda line: F.abs(count(line, d) - first) <= 1)


def directory_majority(files: DataFrame, path: str = "path") -> DataFrame:
    """The modality of most files (unknown ones aside) with its count; of ties the first by name."""
    counts = files.select(by_extension(F.col(path)).alias("modality")).where("modality <> 'unknown'").groupBy("modality").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "modality").limit(1)
