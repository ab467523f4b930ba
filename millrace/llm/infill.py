"""Fill-in-the-middle examples by bit-parallelism on big integers.

A text's bytes become masks of one bit a byte: ``bytes.translate`` marks the
bytes of a class, and Python's integers hold the mask. Shifts and boolean
operations mark the first byte of each line and the three letters of a
sentinel, ``bit_count`` counts lines and code points, and the k-th line's first
byte is selected by halving the mask until one bit is left.

A line is everything up to a line feed and the feed itself, or what follows the
last one. The text is cut at two line starts, drawn by a digest of the key, so
reruns and other partitionings agree.

Defined results: a null text counts as empty; empty texts and texts with a
sentinel stay as they are (``plain``); a null key draws as the empty key;
repeated rows give equal rows; texts of any length are taken whole, in masks as
large as the text; an empty table gives an empty result; other columns are
carried along, and a column whose name is one of the result's is replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import fresh, others, quoted

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _marks(these: bytes) -> bytes:
    """A translation table: 1 for the bytes of a class, 0 for others, as digits."""
    return bytes(49 if b in these else 48 for b in range(256))


FEED, LESS, LETTER, GREATER = _marks(b"\n"), _marks(b"<"), _marks(b"PSM"), _marks(b">")
#: A code point's first byte is any but a continuation.
FIRST = _marks(bytes(b for b in range(256) if b & 0xC0 != 0x80))


def mask(data: bytes, table: bytes) -> int:
    """Bit i is set where byte i is of the class. Base 2 is read in linear time."""
    return int(data[::-1].translate(table), 2) if data else 0


def line_starts(data: bytes) -> int:
    """The bits of the lines' first bytes: the text's first, and each after a line feed that isn't the last byte."""
    return (mask(data, FEED) << 1 | 1) & ((1 << len(data)) - 1)


def has_sentinel(data: bytes) -> bool:
    if b"<" not in data:
        return False
    return mask(data, LESS) & mask(data, LETTER) >> 1 & mask(data, GREATER) >> 2 != 0


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit that has ``rank`` set bits below it, by halving: each step keeps the half that holds it."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    return at


def cut(data: bytes, first: int, second: int) -> tuple[int, int, int]:
    """(lines, and the bytes where prefix and middle end), for two draws."""
    starts = line_starts(data)
    n = starts.bit_count()
    place = lambda unit: len(data) if unit == n else select(starts, unit, len(data))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, place(low), place(high)


def transform(text: str | None, draw: str, rate: int = 100, spm: int = 50) -> tuple[int, str, str, int | None, int | None]:
    """(n, form, output, prefix_chars, middle_chars); ``draw`` is a hexadecimal digest, of which the first four groups of eight digits count."""
    data = (text or "").encode()
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in range(0, 32, 8))
    n, a, b = cut(data, h1, h2)
    if not data or has_sentinel(data) or h3 % 100 >= rate:
        return n, "plain", text or "", None, None
    points = mask(data, FIRST)
    before = (points & ((1 << a) - 1)).bit_count()
    middle = (points & ((1 << b) - 1)).bit_count() - before
    p, m, s = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    if h4 % 100 < spm:
        return n, "spm", f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}", before, middle
    return n, "psm", f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}", before, middle


FIELDS = {"n": "bigint", "form": "string", "output": "string", "prefix_chars": "bigint", "middle_chars": "bigint"}


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``df`` with n (lines), form (``psm``, ``spm`` or ``plain``), output, prefix_chars and middle_chars.

    ``rate`` per cent of the texts are transformed, ``spm`` per cent of those with the suffix first. One pass, no shuffle.
    """
    if not (0 <= rate <= 100 and 0 <= spm <= 100):
        raise ValueError("rate and spm are per cent")

    def run(texts: pa.Array, draws: pa.Array) -> pa.Array:
        rows = [transform(t.as_py(), d.as_py(), rate, spm) for t, d in zip(texts, draws, strict=True)]
        n, form, output, before, middle = zip(*rows) if rows else ((),) * 5
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip((n, form, output, before, middle), types, strict=True)], list(FIELDS))

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))), 256)
    made = fresh(df, "_infill")
    out = df.withColumn(made, F.arrow_udf(run, "struct<" + ",".join(f"{c}:{k}" for c, k in FIELDS.items()) + ">")(quoted(text), draw))
    return out.select(*others(df, *FIELDS), *(F.col(made)[c].alias(c) for c in FIELDS))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. No text with a sentinel is, and none arises where the parts meet, so the three are found exactly."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    whole = {name: F.concat(*(F.get(part, F.lit(n)) for n in places)) for name, places in order.items()}
    return F.when(form == "psm", whole["psm"]).when(form == "spm", whole["spm"]).otherwise(output)
