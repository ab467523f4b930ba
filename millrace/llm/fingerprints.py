"""Document fingerprints by context-triggered piecewise hashing.

A hash over a window of seven bytes rolls along the text; where it ends in k
zero bits a chunk ends, so an edit moves only the chunks around it. Each chunk
gives one character. k is the least that makes 64 chunks or fewer, and the
fingerprint ``block:signature:signature`` holds the signatures at block sizes
2**k and 2**(k + 1). Fingerprints of equal or neighbouring block sizes are
compared by edit distance; others have likeness 0.

Defined results: a null text counts as empty; the empty text's fingerprint is
``1::``; equal texts have equal fingerprints and likeness 1; texts of any length
are read whole, with larger chunks; an empty table gives an empty result. In ``edited_pairs``, rows of one doc_id stand in the
order of their texts, rows without doc_id after all others, and a lone row is
its own next; columns other than the key and the text aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import others, quoted

WINDOW = 7
MOST_CHUNKS = 64
#: Signatures must share so many characters in a row (short ones a quarter of theirs); else they are alike by chance.
COMMON = 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _byte_values() -> np.ndarray:
    """A spread value for each byte."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(13)
    return (x ^ (x >> np.uint64(17))).astype(np.uint32)


def _rolling(data: np.ndarray) -> np.ndarray:
    """The mixed hash of the window that ends at each byte."""
    values = _byte_values()[data]
    rolled, factor = values.copy(), 1
    for back in range(1, min(WINDOW, len(data))):
        factor = factor * 0x01000193 % 2**32
        rolled[back:] += values[:-back] * np.uint32(factor)
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x2C1B3C6D)
    rolled ^= rolled >> np.uint32(12)
    return rolled


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return "1::"
    rolled = _rolling(data)
    k, ends = 0, np.arange(len(data))
    while len(ends) >= MOST_CHUNKS:
        ends = ends[(rolled[ends] >> np.uint32(k)) & np.uint32(1) == 0]
        k += 1
    spread = rolled.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def signature(ends: np.ndarray) -> str:
        starts = np.concatenate(([0], ends + 1))
        starts = starts[starts < len(data)]
        sums = np.add.reduceat(spread, starts) * np.uint64(0xD6E8FEB86659FD93)
        return "".join([ALPHABET[c] for c in (sums >> np.uint64(58)).tolist()])

    return f"{1 << k}:{signature(ends)}:{signature(ends[(rolled[ends] >> np.uint32(k)) & np.uint32(1) == 0])}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in one integer."""
    places: dict[str, int] = {}
    for n, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << n
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) over both lengths."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = max(1, min(COMMON, len(a) // 4, len(b) // 4))
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    return 2.0 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1 for two fingerprints."""
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_alike(x1, y1), _alike(x2, y2))
    if x == 2 * y:
        return _alike(x1, y2)
    return _alike(x2, y1) if y == 2 * x else 0.0


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each text."""
    made = F.arrow_udf(lambda a: pa.array([fingerprint(t.as_py()) for t in a], pa.string()), "string")
    return df.select(*others(df, out), made(F.col(quoted(text))).alias(out))


def _buckets(ids: DataFrame, parts: int) -> tuple[list[int], dict[int, int | None]]:
    """Places that cut the keys in about ``parts`` buckets, and each bucket's largest key; a few numbers for each bucket."""
    at = [n / parts for n in range(1, parts)] or [0.5]
    cuts = ids.agg(F.percentile_approx("doc_id", at, 100 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    heads = ids.groupBy(_bucket(cuts).alias("b")).agg(F.max("doc_id").alias("head")).collect()
    return cuts, {r["b"]: r["head"] for r in heads}


def _bucket(cuts: list[int]):
    """Bucket of a key: 0 for the largest keys, null keys with the smallest."""
    edges = np.array(cuts, np.int64)

    def place(keys: pa.Array) -> pa.Array:
        known = keys.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array((len(edges) - np.searchsorted(edges, known, "right")).astype(np.int32))

    return F.arrow_udf(place, "int")(F.col("doc_id"))


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    """Rows in order, bucket by bucket; each is finished by the row after it. A bucket ends with the row that follows it elsewhere."""
    held = None  # (bucket, doc_id, text, fingerprint) of the row that waits for its next
    for batch in batches:
        rows = []
        for bucket, follows, key, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "follows", "doc_id", "text")), strict=True):
            if held is None and follows:
                continue
            text = text or ""
            mark = fingerprint(text)
            if held is not None:
                _, last_key, last, last_mark = held
                half = len(last) // 2
                edited = last[: len(last) - half] + text[:half]
                edited_mark = fingerprint(edited)
                rows.append((last_key, len(last), hashlib.sha256(edited.encode()).hexdigest(), last_mark, edited_mark, likeness(last_mark, edited_mark), likeness(last_mark, mark)))
            held = None if follows else (bucket, key, text, mark)
        columns = list(zip(*rows)) or [[]] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def edited_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint against its edited text's and the next document's, by descending key.

    Texts are dealt once, by ranges of keys, and stand in order within each
    range; only the first text of each range goes to two places.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    cuts, heads = _buckets(docs.select("doc_id"), parts)
    order = sorted(heads)
    before = {b: order[n - 1] for n, b in enumerate(order)}  # the first bucket follows the last
    rows = docs.select(_bucket(cuts).alias("bucket"), F.lit(False).alias("follows"), "doc_id", "text")
    if order:
        known = [h for h in heads.values() if h is not None]
        is_head = F.col("doc_id").isin(known) if len(known) == len(heads) else F.col("doc_id").isNull() | F.col("doc_id").isin(known)
        back = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
        first = docs.where(is_head).select(_bucket(cuts).alias("bucket"), "doc_id", "text")
        rows = rows.unionAll(first.select(F.element_at(back, F.col("bucket")).alias("bucket"), F.lit(True), "doc_id", "text"))
    dealt = rows.repartitionById(parts, F.pmod(F.col("bucket"), F.lit(parts)))
    return dealt.sortWithinPartitions("bucket", "follows", F.desc_nulls_last("doc_id"), "text").mapInArrow(_pairs, SCHEMA)
