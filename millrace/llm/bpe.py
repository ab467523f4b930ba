"""Byte-level BPE by a pair occurrence index.

In each partition the distinct pieces of the texts are laid end to end as
symbols. An index maps each pair to all its positions; the active ranks are
applied in ascending order, each to all positions of its pair at once, and the
lists of the pairs that appear beside a merged symbol are updated. A merge only
makes pairs of higher rank (``load`` checks it), so this gives what merging each
piece on its own by lowest rank gives.

Defined results: a null text counts as empty and has no ids; ids that aren't in
the vocabulary are skipped when decoding; repeated rows are encoded alike;
texts of any length are encoded whole; an empty table gives an empty result;
other columns are carried along, and a column whose name is one of the result's
is replaced. A vocabulary file that asks for more than this module does
(``load``) is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import others, quoted

#: What splits text into pieces before merging: the vocabulary's own pattern, frequent pieces first and without backtracking.
PIECES = r" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Encoded pieces that a task remembers between batches; beyond it the memory starts anew.
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


@dataclass
class Bpe:
    """start: the id of each byte; merges: (left, right) to (rank, id, left, right); tokens: the bytes of each id; special: texts that are ids as they stand."""

    start: list[int]
    merges: dict[tuple[int, int], tuple[int, int, int, int]]
    tokens: dict[int, bytes]
    special: dict[str, int]


def load(path: str) -> Bpe:
    """The vocabulary of a file; ValueError if it normalises or splits text in another way than this module, or has options beyond plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": "", "end_of_word_suffix": "", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    wrong = [n for n, v in plain.items() if (model.get(n) or v) != v]
    if wrong or model.get("type", "BPE") != "BPE" or spec.get("normalizer") or (spec.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError(f"not a plain byte-level BPE: {wrong or 'normalizer, decoder or type'}")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("texts are split in another way")
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec["added_tokens"]):
        raise ValueError("added tokens have options")
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    start = [0] * 256
    for c, b in letters.items():
        start[b] = vocab[c]
    merges, made = {}, {}
    for rank, (a, b) in enumerate(spec["model"]["merges"]):
        if max(made.get(a, -1), made.get(b, -1)) >= rank:
            raise ValueError("a merge comes before the merge that makes its part")
        made.setdefault(a + b, rank)
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b], vocab[a], vocab[b])
    return Bpe(start, merges, tokens | {i: t.encode() for t, i in special.items()}, special)


def merge_pieces(pieces: list[str], bpe: Bpe) -> list[list[int]]:
    """The ids of each of some distinct pieces, through one index of their pairs."""
    symbols: list[int] = []
    firsts: list[int] = []
    start, merge = bpe.start, bpe.merges.get
    for p in pieces:
        firsts.append(len(symbols))
        symbols += [start[b] for b in p.encode()]
        symbols.append(-1)  # ends a piece; no pair holds it
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    positions: dict[tuple, list[int]] = {}  # by the merge, which stands for its pair
    for at, pair in enumerate(zip(symbols, symbols[1:])):
        if (found := merge(pair)) is not None:
            if found in positions:
                positions[found].append(at)
            else:
                positions[found] = [at]
    active = list(positions)
    heapq.heapify(active)
    while active:
        _, made, left, right = found = heapq.heappop(active)
        for at in sorted(positions.pop(found)):  # ascending, so that of overlapping pairs the left one merges
            second = after[at]
            if symbols[at] != left or symbols[second] != right:
                continue  # a part has merged with its other neighbour
            symbols[at], symbols[second] = made, -2
            third = after[at] = after[second]
            before[third] = at
            first = before[at]
            if (new := merge((symbols[first], made))) is not None:
                if new in positions:
                    positions[new].append(first)
                else:
                    positions[new] = [first]
                    heapq.heappush(active, new)
            if (new := merge((made, symbols[third]))) is not None:
                if new in positions:
                    positions[new].append(at)
                else:
                    positions[new] = [at]
                    heapq.heappush(active, new)
    out = []
    for first in firsts:
        ids, at = [], first
        while (symbol := symbols[at]) != -1:
            ids.append(symbol)
            at = after[at]
        out.append(ids)
    return out


class Encoder:
    """Encodes batches of texts; what ``form`` makes of the ids of pieces seen before in the partition is remembered."""

    def __init__(self, bpe: Bpe, form=lambda ids: array("i", ids)):  # compact: a partition has many
        self.bpe, self.known, self.form = bpe, {}, form
        self.split = regex.compile(PIECES).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True))) + ")") if bpe.special else None

    def pieces(self, text: str) -> list[str]:
        """Ordinary pieces, and special tokens as they stand."""
        if self.special is None or not self.special.search(text):
            return self.split(text)
        parts = self.special.split(text)
        return list(chain.from_iterable([p] if n % 2 else self.split(p) for n, p in enumerate(parts)))

    def learn(self, texts: list[str]) -> list[list[str]]:
        split = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = sorted(set(chain.from_iterable(split)).difference(self.known, self.bpe.special))
        self.known.update(zip(new, map(self.form, merge_pieces(new, self.bpe)), strict=True))
        self.known.update({t: self.form([i]) for t, i in self.bpe.special.items()})
        return split

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = self.learn([t or "" for t in texts])
        known = self.known
        return [list(chain.from_iterable([known[p] for p in ps])) for ps in split]


def id_bytes(ids: list[int] | None, bpe: Bpe) -> bytes:
    """The bytes that some ids stand for, in order; those of several stretches of ids join up to the whole's."""
    get = bpe.tokens.get
    return b"".join([get(i, b"") for i in ids or ()])


def decode_ids(ids: list[int] | None, bpe: Bpe) -> str:
    """The text of some ids; bytes that aren't UTF-8 become U+FFFD."""
    return id_bytes(ids, bpe).decode("utf-8", "replace")


#: Texts that are encoded at once, in characters, so that ids of few texts are in memory.
STEP = 500_000


def _steps(texts: list[str | None]):
    begun = size = 0
    for n, t in enumerate(texts):
        size += len(t or "")
        if size > STEP:
            yield begun, n + 1
            begun, size = n + 1, 0
    if begun < len(texts) or not texts:
        yield begun, len(texts)


def _with(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(new.values()), names=keep + list(new))


def _mapped(df: DataFrame, column: str, fields: str, make) -> DataFrame:
    """``df`` with the columns that ``make()(values)`` gives for the values of ``column``, batch by batch.

    Columns go by numbered names meanwhile, as mapInArrow reads a dot in a name as a step into a struct.
    """
    new = [f.split(":")[0] for f in fields.split(",")]
    keep = [c for c in df.columns if c.lower() not in new]
    plain = [f"c{n}" for n in range(len(keep))]
    kept = [F.col(quoted(c)).alias(n) for c, n in zip(keep, plain, strict=True)]
    source = plain[keep.index(column)] if column in keep else "value"
    data = df.select(*kept) if column in keep else df.select(F.col(quoted(column)).alias("value"), *kept)

    def run(batches):
        f = make()
        for batch in batches:
            values = batch.column(source).to_pylist()
            for a, b in _steps(values):
                yield _with(batch.slice(a, b - a), plain, f(values[a:b]))

    schema = ", ".join([f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, plain, strict=True)] + [f.replace(":", " ") for f in fields.split(",")])
    return data.mapInArrow(run, schema).select(*(F.col(n).alias(c) for c, n in zip(keep, plain, strict=True)), *new)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``: array<int>, and ``n_tokens``."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))  # the vocabulary's size is fixed

    def make():
        encoder = Encoder(shared.value, lambda ids: array("i", ids).tobytes())

        def f(texts):
            split = encoder.learn([t or "" for t in texts])
            known = encoder.known
            ids = [b"".join([known[p] for p in pieces]) for pieces in split]
            ends = np.cumsum([0] + [len(i) // 4 for i in ids])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            return {"n_tokens": pa.array(np.diff(ends), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)}

        return f

    return _mapped(df, text, "n_tokens:bigint,ids:array<int>", make)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of its ids."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make():
        return lambda rows: {"decoded": pa.array([decode_ids(r, shared.value) for r in rows], pa.string())}

    decoded = F.arrow_udf(lambda a: make()(a.to_pylist())["decoded"], "string")(quoted(ids))
    return df.select(*others(df, "decoded"), decoded.alias("decoded"))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens and the digests of its ids and of the text decoded from them; ids don't leave the task.

    Ids are written out and decoded once for each distinct piece; a text joins what its pieces' ids gave.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make():
        bpe = shared.value
        encoder = Encoder(bpe, lambda ids: (",".join(map(str, ids)).encode(), id_bytes(ids, bpe)))
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def one(pieces: list[str]) -> tuple[int, str, str]:
            known = encoder.known
            found = [known[p] for p in pieces]
            ids = b",".join([i for i, _ in found])
            decoded = b"".join([d for _, d in found]).decode("utf-8", "replace")
            return ids.count(b",") + 1 if found else 0, sha(ids), sha(decoded.encode())

        def f(texts):
            rows = [one(pieces) for pieces in encoder.learn([t or "" for t in texts])]
            counts, ids, decoded = zip(*rows) if rows else ((), (), ())
            return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

        return f

    return _mapped(df, text, "n_tokens:bigint,ids_sha256:string,decoded_sha256:string", make)
