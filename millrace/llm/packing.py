"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are tokenised and cut into pieces where they stand; only longer ones
than a sequence are cut. How pieces go together depends on their lengths alone,
of which there are as many as the capacity, so the plan is made of one count for
each length, whatever the size of the corpus:

* Large pieces, above a third of the capacity, meet at most in twos. From the
  longest down, each is matched with the longest that still fits beside it,
  which leaves as few sequences as twos can.
* Smaller ones, from the longest down, go where they leave the least room, and
  open a new sequence where none has room.

Each step places as many pieces of one length as there are sequences of the
same room, and is written down as a run: ranks of a length, and where they go.
A sequence's room at least halves whenever a length visits it, so the runs are
bounded by the capacity too. Pieces are then ranked within their length
(``ordering``) and look up their run.

Defined results: a null text counts as empty and is the end token alone;
repeated rows are packed each; ties go by key, piece and digest; texts of any
length are tokenised whole; an empty table gives an empty result; columns other
than the key and the text are neither read nor returned.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.ordering import places
from millrace.llm.text import drop, quoted, stored

CAPACITY, END = 4096, 1
#: Words whose ids a Python worker remembers, and as many of those before.
REMEMBERED = 500_000

#: How a vocabulary file must split text for words to be encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space to the file's pattern; no piece and no composed character crosses it.
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: White space to str.split alone.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Words of these characters are in composed form, and Python folds and classes them as the file's rules do.
PLAIN = regex.compile(r"[!-~\xa1-\u012f\u0131-\u024f]+")
PIECES = regex.compile(SPLIT)
#: A piece of its own after a word of letters.
MARKS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


class Words(dict):
    """Ids of words as little-endian 32-bit integers; a word that is looked up for the first time is encoded.

    What the memory before this one knows is taken from there, so that frequent words outlive it.
    """

    def __init__(self, encoder: Encoder, before: Words | None = None):
        super().__init__()
        self.encoder, self.letters = encoder, byte_letters()
        self.before: dict[str, bytes] = dict(before or {})
        self.pieces: dict[str, bytes] = before.pieces if before and len(before.pieces) < REMEMBERED else {}

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = array("I", [t.id for t in self.encoder.tokenize(shown)]).tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        """Plain words piece by piece, each distinct piece once; others by the library's whole path."""
        found = self.before.get(word)
        if found is None:
            body, mark = (word, "") if word.isalpha() else (word[:-1], word[-1:])
            if body.isalpha() and mark in MARKS and (body.isascii() or PLAIN.fullmatch(body)):
                found = self.piece(body.lower()) + (self.piece(mark) if mark else b"")
            elif PLAIN.fullmatch(word) and "<|" not in word:
                found = b"".join([self.piece(p) for p in PIECES.findall(word.lower())])
            else:
                found = self.encoder.whole(word)
        self[word] = found
        return found


class Encoder:
    """Ids of texts as little-endian 32-bit integers, each distinct word encoded once in a Python worker."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.by_word = self._by_word(json.loads(spec))
        self.words = Words(self)

    @staticmethod
    def _by_word(spec: dict) -> bool:
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        steps = split.get("pretokenizers") or [{}, {}]
        plain = (steps[0].get("pattern") or {}).get("Regex") == SPLIT and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        added = all("<|" in t["content"] and not SPACE.search(t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        return bool(plain and byte_level and added and (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and model.get("type", "BPE") == "BPE" and not model.get("dropout"))

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.whole(text)
        words = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin and end.

        Words are split and numbered in Arrow; each distinct word of the texts is looked up once.
        """
        texts = texts.fill_null("")
        if len(self.words) > REMEMBERED:
            self.words = Words(self, self.words)
        if not self.by_word or pc.any(pc.match_substring_regex(texts, SEPARATORS.pattern)).as_py():
            each = [self.encode(t.as_py()) for t in texts]
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([0, *(len(e) // 4 for e in each)])
        split = pc.utf8_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        word = numbered.indices.to_numpy()
        # No word holds a space, so the distinct words are one string, split once.
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary), " ")[0].as_py().split(" ") if len(word) else []
        ids = list(map(self.words.__getitem__, distinct))
        length = np.array([len(i) // 4 for i in ids], np.int64)
        data = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(length) - length
        end = np.cumsum(length[word]) if len(word) else np.zeros(0, np.int64)
        # The n-th token of a word lies n after the word's first in ``data``.
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(first[word] - end + length[word], length[word])
        ends = np.concatenate(([0], end))
        return data[at], ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder a vocabulary in each Python worker."""
    name = zlib.crc32(spec.encode())
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(spec)
    return _ENCODERS[name]


#: Texts that are encoded at once, in code points, so that the ids of few texts are in memory.
STEP = 8_000_000


def steps(sizes: list[int]):
    """Ranges of rows of about STEP in all."""
    begun = total = 0
    for n, size in enumerate(sizes):
        total += size
        if total > STEP:
            yield begun, n + 1
            begun, total = n + 1, 0
    if begun < len(sizes):
        yield begun, len(sizes)


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of each text's ids and the end token, cut at multiples of the capacity."""
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size is fixed
    kind = df.schema[key].dataType
    last = np.array([end], "<u4")

    def cut(key: pa.Array, texts: pa.Array, encoder: Encoder) -> pa.RecordBatch:
        at, piece, start, length, crc, tokens = [], array("i"), array("q"), array("q"), array("q"), []
        data, bounds = encoder.encode_all(texts)
        for n, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            whole = np.concatenate((data[a:b], last))
            for k, c in enumerate(range(0, len(whole), capacity)):
                part = whole[c : c + capacity]
                at.append(n)
                piece.append(k)
                start.append(c)
                length.append(len(part))
                crc.append(zlib.crc32(part))
                if ids:
                    tokens.append(part.astype("i4"))
        columns = [key.take(pa.array(at, pa.int64())), *(pa.array(np.array(c)) for c in (piece, start, length, crc))]
        columns += [pa.array(tokens, pa.list_(pa.int32()))] if ids else []
        return pa.RecordBatch.from_arrays(columns, names=["key", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    def run(batches):
        known = encoder(shared.value)
        for batch in batches:
            for a, b in steps(pc.utf8_length(batch.column("text")).fill_null(0).to_pylist()):
                some = batch.slice(a, b - a)
                yield cut(some.column("key"), some.column("text"), known)

    schema = f"key {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    out = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


class Run(NamedTuple):
    """Pieces of ``length`` with ranks from ``first``, ``count`` of them: ``each`` to a sequence, from ``sequence`` on, the first at ``offset``."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def matched(left: dict[int, int], capacity: int) -> list[tuple[int, int | None, int]]:
    """(longer, partner or None, times) of large pieces, from the longest down, each with the longest that fits beside it."""
    counts = {n: c for n, c in left.items() if 3 * n > capacity and c}
    active, out = sorted(counts), []
    while active:
        longest = active[-1]
        while counts[longest]:
            at = bisect_right(active, capacity - longest) - 1
            if at >= 0 and active[at] == longest and counts[longest] == 1:
                at -= 1  # it isn't its own partner
            partner = active[at] if at >= 0 else None
            times = counts[longest] if partner is None else counts[longest] // 2 if partner == longest else min(counts[longest], counts[partner])
            out.append((longest, partner, times))
            counts[longest] -= times
            if partner is not None:
                counts[partner] -= times
                if not counts[partner] and partner != longest:
                    active.pop(at)
        active.pop()
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """The runs that place every piece, of so many of each length."""
    runs: list[Run] = []
    used: dict[int, int] = defaultdict(int)
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room to (first sequence, sequences)
    order: list[int] = []  # rooms that some sequence has
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not rooms[room]:
                insort(order, room)
            rooms[room].append((first, n))

    def place(length: int, count: int, first: int, each: int, offset: int) -> None:
        runs.append(Run(length, used[length], count, first, each, offset))
        used[length] += count

    for longer, partner, times in matched(counts, capacity):
        place(longer, times, sequences, 1, 0)
        if partner is not None:
            place(partner, times, sequences, 1, longer)
        leave(capacity - longer - (partner or 0), sequences, times)
        sequences += times
    for length in sorted((n for n, c in counts.items() if c and 3 * n <= capacity), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length  # with one in, the sequence has less room than any other that has enough, so the next goes there too
            full, rest = divmod(min(left, n * each), each)
            if full:
                place(length, full * each, first, each, capacity - room)
                leave(room - each * length, first, full)
            if rest:
                place(length, rest, first + full, rest, capacity - room)
                leave(room - rest * length, first + full, 1)
            leave(room, first + full + bool(rest), n - full - bool(rest))
            left -= full * each + rest
    return runs


def placed(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    ranked = places(cut, ["length"], [key, "piece", "ids_crc32"])
    # A count for each length: bounded by the capacity.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    shared = cut.sparkSession.sparkContext.broadcast(tuple(np.array(c, "i8") for c in zip(*runs)) if runs else None)

    def find(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = (a.to_numpy(zero_copy_only=False) for a in (lengths, ranks))
        runs_length, first, _, sequence, each, offset = shared.value
        # Runs of a length cover its ranks without gaps, so the last one that begins at or before a rank holds it.
        at = np.searchsorted(_joint(runs_length, first), _joint(length, rank), "right") - 1
        inner = rank - first[at]
        columns = [pa.array(sequence[at] + inner // each[at]), pa.array(offset[at] + inner % each[at] * length)]
        return pa.StructArray.from_arrays(columns, ["sequence_id", "offset"])

    where = F.arrow_udf(find, "struct<sequence_id:bigint,offset:bigint>")(F.col("length"), F.col("place"))
    return ranked.withColumn("_where", where).select(*(quoted(c) for c in cut.columns), "_where.sequence_id", "_where.offset")


#: Ranks are below this; a length and a rank make one number.
RANKS = 1 << 48


def _joint(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return length.astype("i8") * RANKS + rank


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece of every text, packed."""
    if not 0 < capacity < 1 << 14:
        raise ValueError("a length and a rank must fit 62 bits: the capacity is below 16,384")
    cut = stored(pieces(df, path, key, text, capacity, end, ids))
    out = placed(cut, key, capacity)
    drop(cut)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids) of packed pieces with their ids; a sequence has no more tokens than the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), parts.alias("parts")).select("sequence_id", "n_pieces", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
