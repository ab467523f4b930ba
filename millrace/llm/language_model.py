"""Scoring texts with a log-bilinear neural language model, and with unigram counts.

Texts are read once. Each chunk of an Arrow batch, ``CHUNK_BYTES`` of text at
most or one longer text, turns its words into numbers of the chunk's own
dictionary, and the dictionary's words carry the chunk's counts. Counting, and
looking counts up, is then a matter of dictionaries, each of which names a word
once a chunk rather than once an occurrence.

The model covers the whole vocabulary by a factored output. Words in the order
of their reversed spelling are cut into clusters, so that words of one ending
lie together. Every word seen ``LEAST`` times has vectors of its own, as many
as ``MOST`` (which bounds what is broadcast); in each cluster one further
member stands for its rarer words, each of which has its own part of that
member by its own count, as have words never seen. A token's probability is
its cluster's given the two words before it, times its member's within the
cluster given the same, times its own part of the member: these sum to 1.

The members' vectors, a matrix for each place of the context, and the clusters'
vectors are trained by noise-contrastive estimation. Texts, cut into pieces,
are dealt over copies of the model by a hash of what they are, so that the
model doesn't depend on how the table is laid out; each copy trains on its own
part, and copies are averaged, weighted by how often they met a word. A first
round on one copy in ``WARM`` gives all copies their start. Scores come from
batched matrix products and are normalised over all members.

Defined results: a null text counts as empty and is one end token; texts
without a key are scored but not learnt from; repeated rows are texts of their
own, each counted; a text of any length is scored whole, ``PIECE`` tokens at a
time; equally frequent words are taken alike; with nothing to learn from,
counts are 0 and the model is uniform; an empty table gives an empty result;
columns other than the key and the text aren't carried along.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import drop, stored

#: Text of a chunk, in bytes.
CHUNK_BYTES = 24 << 20
#: Occurrences from which on a word has vectors (fewer are enough while no more than FEW words have any), and words that may have them.
LEAST, FEW, MOST = 64, 4096, 50_000
SIZE = 16
#: Noise clusters of a batch, and noise words of an event within its cluster.
NOISE, WITHIN = 32, 2
BATCH, RATE = 8192, 0.4
#: Tokens that a copy trains on, about; copies at most; of so many copies one trains in the first round.
COPY_TOKENS, MOST_COPIES, WARM = 1 << 22, 4096, 8
#: Tokens that are shuffled together for training; tokens of a piece of a text, and those that are scored at a time.
SEGMENT, PIECE = 1 << 20, 1 << 18
#: Rows of a slice of the parameters, and slices that are averaged in one task.
SLICE, SLICES = 1024, 64

ENCODED = "chunk bigint, doc_id bigint, learn boolean, n_words bigint, ids binary, word string, id int, n bigint"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _slices(sizes: np.ndarray, most: int) -> list[slice]:
    """Runs of consecutive items whose sizes sum to ``most`` or less, or of one item."""
    out, begun, total = [], 0, 0
    for n, size in enumerate(sizes.tolist()):
        if n > begun and total + size > most:
            out.append(slice(begun, n))
            begun, total = n, 0
        total += size
    return [*out, slice(begun, len(sizes))] if len(sizes) else out


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many words each text has, and all words, A-Z as a-z."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = split.flatten(), np.diff(split.offsets.to_numpy()).cumsum()
    solid = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty string
    many = np.diff(np.concatenate(([0], np.cumsum(solid)))[np.concatenate(([0], ends))])
    return many, (flat if solid.all() else flat.filter(pa.array(solid))).dictionary_encode()


def _encode(batches):
    """Rows of two kinds for each chunk: texts (word null) as numbers, and the dictionary's words with their learnable counts."""
    task, chunks = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column("text").fill_null("")
        for part in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), CHUNK_BYTES):
            chunk, d = task << 32 | chunks, part.stop - part.start
            chunks += 1
            many, words = _words(texts[part])
            learn = batch.column("learn")[part]
            at, v = words.indices.to_numpy(), len(words.dictionary)
            every = np.bincount(at, minlength=v)
            order = np.argsort(-every, kind="stable")  # small numbers for frequent words
            number = np.empty(v, np.int32)
            number[order] = np.arange(v, dtype=np.int32)
            known = np.bincount(at[np.repeat(learn.to_numpy(zero_copy_only=False), many)], minlength=v)
            ends = pa.array(np.concatenate(([0], np.cumsum(many * 4))).astype(np.int32)).buffers()[1]
            ids = pa.BinaryArray.from_buffers(pa.binary(), d, [None, ends, pa.py_buffer(number.take(at))])
            none = lambda kind, n: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, chunk)), batch.column("doc_id")[part], learn, pa.array(many, pa.int64()), ids,
                 none(pa.string(), d), none(pa.int32(), d), none(pa.int64(), d)], names=_names(ENCODED),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(v, chunk)), none(pa.int64(), v), none(pa.bool_(), v), none(pa.int64(), v), none(pa.binary(), v),
                 words.dictionary, pa.array(number), pa.array(known)], names=_names(ENCODED),
            )


class LogBilinear:
    """The model's parameters: members' vectors in and out and biases, a matrix for each place of the context, and the clusters' vectors and biases.

    ``mass`` is each member's count and ``cluster`` its cluster, ascending.
    """

    def __init__(self, mass: np.ndarray, cluster: np.ndarray, seed: int = 3):
        rng, k = np.random.default_rng(seed), len(mass)
        small = lambda *shape: rng.normal(0, 0.05, shape).astype(np.float32)
        self.cluster = cluster.astype(np.uint16)
        self.edges = np.append(np.flatnonzero(np.diff(cluster, prepend=-1)), k)
        whole = np.add.reduceat(mass, self.edges[:-1])
        self.shares = whole / whole.sum()
        self.bias = np.log(mass / whole[cluster]).astype(np.float32)
        self.inside = self.bias + np.float32(math.log(WITHIN))
        self.inward, self.outward = small(k, SIZE), small(k, SIZE)
        self.place = np.stack([np.eye(SIZE, dtype=np.float32), np.eye(SIZE, dtype=np.float32) * np.float32(0.5)]) + small(2, SIZE, SIZE)
        self.top, self.top_bias = small(len(self.shares), SIZE), np.log(self.shares).astype(np.float32)
        self.past = None

    def rows(self) -> np.ndarray:
        """All parameters as rows of one width: members, clusters, places."""
        top = np.concatenate([self.top, np.zeros_like(self.top), self.top_bias[:, None]], 1)
        place = np.concatenate([*self.place, np.zeros((SIZE, 1), np.float32)], 1)
        return np.concatenate([np.concatenate([self.inward, self.outward, self.bias[:, None]], 1), top, place])

    def load(self, rows: np.ndarray) -> LogBilinear:
        words, top, place = np.split(rows, [len(self.bias), len(rows) - SIZE])
        self.inward, self.outward, self.bias = words[:, :SIZE].copy(), words[:, SIZE:-1].copy(), words[:, -1].copy()
        self.top, self.top_bias = top[:, :SIZE].copy(), top[:, -1].copy()
        self.place = np.stack([place[:, :SIZE], place[:, SIZE:-1]])
        return self

    def train(self, two: np.ndarray, one: np.ndarray, word: np.ndarray, seed: int = 1, begin: float = 0, end: float = 1) -> None:
        """One pass of noise-contrastive estimation over all events, in a seeded order, with Adagrad steps.

        Steps shrink as a whole training, of which this is the part from
        ``begin`` to ``end``, nears its end. The noise words of an event are
        words of other events of its batch and cluster, turned round by a
        random number of places.
        """
        rng, groups = np.random.default_rng(seed), len(self.shares)
        share, edges = np.log(NOISE * self.shares).astype(np.float32), np.cumsum(self.shares)
        if self.past is None:
            self.past = [np.full_like(p, 1e-6) for p in (self.inward, self.outward, self.bias, self.place, self.top, self.top_bias)]
        order = rng.permutation(len(word))
        for begun in range(0, len(order), BATCH):
            rows = order[begun : begun + BATCH]
            rows = rows.take(np.argsort(word.take(rows), kind="stable"))  # by word, and so by cluster
            a, b, w = two.take(rows), one.take(rows), word.take(rows)
            g, n = self.cluster.take(w), len(rows)
            scale = np.float32(1 / n)
            in_a, in_b = self.inward.take(a, 0), self.inward.take(b, 0)
            q = in_a @ self.place[0] + in_b @ self.place[1]
            drawn = np.searchsorted(edges, rng.random(NOISE) * edges[-1]).clip(0, groups - 1)
            above, noise = self.top.take(g, 0), self.top.take(drawn, 0)
            level = self.top_bias - share
            true = 1 - _sigmoid(_dots(q, above) + level.take(g))
            false = -_sigmoid(q @ noise.T + level.take(drawn))
            out, low = self.outward.take(w, 0), (self.bias - self.inside).take(w)
            right = 1 - _sigmoid(_dots(q, out) + low)
            to_q = true[:, None] * above + false @ noise + right[:, None] * out
            to_out = np.concatenate([right[:, None] * q, right[:, None]], 1)
            first = _firsts(g)
            size = np.diff(first, append=n)
            start, many = np.repeat(first, size), np.repeat(size, size)
            at = np.arange(n) - start
            for _ in range(WITHIN):
                turn = np.repeat(rng.integers(0, size), size)
                there, back = start + (at + turn) % many, start + (at - turn) % many
                met = out.take(there, 0)
                wrong = -_sigmoid(_dots(q, met) + low.take(there))
                to_q += wrong[:, None] * met
                wrong = wrong.take(back)
                to_out[:, :-1] += wrong[:, None] * q.take(back, 0)
                to_out[:, -1] += wrong
            to_q *= scale
            to_top = np.zeros((groups, SIZE + 1), np.float32)
            to_top[g.take(first)] = np.add.reduceat(np.concatenate([true[:, None] * q, true[:, None]], 1), first) * scale
            np.add.at(to_top, drawn, np.concatenate([false.T @ q, false.sum(0)[:, None]], 1) * scale)
            words = _firsts(w)
            sums = np.add.reduceat(to_out, words) * scale
            at = w.take(words)
            contexts, to_in = _sums(np.concatenate([a, b]), np.concatenate([to_q @ self.place[0].T, to_q @ self.place[1].T]))
            steps = [
                (self.inward, contexts, to_in),
                (self.outward, at, sums[:, :-1]),
                (self.bias, at, sums[:, -1]),
                (self.place, ..., np.stack([in_a.T @ to_q, in_b.T @ to_q])),
                (self.top, ..., to_top[:, :-1]),
                (self.top_bias, ..., to_top[:, -1]),
            ]
            rate = np.float32(RATE * max(0.02, 1 - begin - (end - begin) * begun / len(order)))
            for (p, where, step), past in zip(steps, self.past, strict=True):
                seen = past[where] + step * step
                past[where] = seen
                p[where] += rate * step / np.sqrt(seen)

    def ready(self) -> LogBilinear:
        """Prepares for scoring: what each word, in each place, adds to every cluster.

        A sum over clusters of exp(x + y) is then a product of two rows.
        """
        self.a, self.b = self.inward @ self.place[0], self.inward @ self.place[1]
        self.all_a, self.all_b = self.a @ self.top.T, self.b @ self.top.T + self.top_bias
        self.most_a, self.most_b = self.all_a.max(1), self.all_b.max(1)
        for rows, most in ((self.all_a, self.most_a), (self.all_b, self.most_b)):
            rows -= most[:, None]
            np.exp(rows, out=rows)
        return self

    def log10(self, two: np.ndarray, one: np.ndarray, word: np.ndarray, step: int = 2048) -> np.ndarray:
        """Normalised log10 probabilities of members after two others."""
        out, g = np.empty(len(word)), self.cluster.take(word)
        for begun in range(0, len(word), step):
            a, b = two[begun : begun + step], one[begun : begun + step]
            sums = _dots(self.all_a.take(a, 0), self.all_b.take(b, 0))
            out[begun : begun + step] = -(np.log(np.maximum(sums, 1e-30)) + self.most_a.take(a) + self.most_b.take(b))
            for n in np.flatnonzero(sums < 1e-30):  # the two words' clusters hardly meet
                out[begun + n] = -_log_sum((self.a[a[n]] + self.b[b[n]]) @ self.top.T + self.top_bias)
        order = np.argsort(g, kind="stable")
        ends = np.searchsorted(g.take(order), np.arange(len(self.top) + 1))
        for c in np.flatnonzero(np.diff(ends)):
            low, high = self.edges[c], self.edges[c + 1]
            for begun in range(ends[c], ends[c + 1], step):
                rows = order[begun : min(begun + step, ends[c + 1])]
                q = self.a.take(two.take(rows), 0) + self.b.take(one.take(rows), 0)
                logits = q @ self.outward[low:high].T
                logits += self.bias[low:high]
                own = logits[np.arange(len(rows)), word.take(rows).astype(np.int64) - low]
                out[rows] += own - _log_sum(logits) + q @ self.top[c] + self.top_bias[c]
        return out / math.log(10)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """Logarithms of sums of exponentials, along the last axis of ``logits``, which it overwrites."""
    if -60 < logits.min() and logits.max() < 60:  # exponentials keep within their range
        return np.log(np.exp(logits, out=logits).sum(-1))
    top = logits.max(-1, keepdims=True)
    logits -= top
    return top[..., 0] + np.log(np.exp(logits, out=logits).sum(-1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    z = np.exp(-np.clip(z, -30, 30))
    z += 1
    return np.reciprocal(z, out=z)


def _firsts(rows: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of the values that go to each."""
    order = np.argsort(rows, kind="stable")
    rows = rows.take(order)
    first = _firsts(rows)
    return rows.take(first), np.add.reduceat(values.take(order, 0), first)


class Vocabulary:
    """The model's members: in each cluster one for its rare words, then words with vectors by their reversed spelling; the end of a text is in the first."""

    def __init__(self, heads: list[tuple[str, int]], ends: int):
        found = sorted((w.encode()[::-1], w, c) for w, c in heads)
        clusters = max(1, math.ceil(math.sqrt(len(found))))
        width = max(1, math.ceil(len(found) / clusters))
        self.bounds = [found[n][0] for n in range(width, len(found), width)]
        self.rest, self.number, mass, cluster = [], {}, [], []
        for c in range(len(self.bounds) + 1):
            self.rest.append(len(mass))
            mass.append(0)
            if c == 0:
                self.end = len(mass)
                mass.append(ends + 1)
            for _, w, n in found[c * width : (c + 1) * width]:
                self.number[w] = len(mass)
                mass.append(n)
            cluster += [c] * (len(mass) - len(cluster))
        self.mass, self.cluster = np.array(mass, float), np.array(cluster)

    def rest_class(self) -> Column:
        """For a column ``word``: the member for rare words of its cluster."""
        bounds, rest = self.bounds, self.rest

        def run(words: pa.Array) -> pa.Array:
            return pa.array([rest[bisect_right(bounds, w.encode()[::-1])] for w in words.to_pylist()], pa.int32())

        return F.arrow_udf(run, "int")("word")


def heads(counted: DataFrame) -> list[tuple[str, int]]:
    """The words that have vectors, MOST at most, with their counts. Which count is enough is read off a histogram of counts."""
    c = F.col("c")
    bin_ = F.when(c < LEAST, c).otherwise(LEAST + F.floor(F.log2(c / LEAST) * 8)).cast("int")
    bins = sorted(counted.where(c > 0).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), reverse=True)
    enough, total = None, 0
    for b, n, least in bins:
        total += n
        if total > (MOST if b >= LEAST else FEW):
            break
        enough = least
    return [(r["word"], r["c"]) for r in counted.where(c >= enough).collect()] if enough else []


PREPARED = "doc_id bigint, learn boolean, n_words bigint, n_known bigint, base double, apart double, ids binary"


def _preparer(known: dict):
    """A row for each text: as numbers of members, two ends before it and one after, and what of the scores needs only counts."""

    def run(key, texts: pa.Table, words: pa.Table) -> pa.Table:
        texts, words = texts.combine_chunks(), words.combine_chunks()
        place = words.column("place").to_numpy()
        counts, classes = np.zeros(len(place), np.int64), np.zeros(len(place), np.uint16)
        counts[place >> 16], classes[place >> 16] = words.column("c").to_numpy(), place & 0xFFFF
        below = known["rest"].take(classes)
        apart = np.where(below > 0, np.log10((counts + 1) / np.maximum(below, 1)), 0.0)
        base = np.log10((counts + 1) / (known["tokens"] + known["distinct"] + 1))
        many = texts.column("n_words").to_numpy()
        flat = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in texts.column("ids")])
        ends = np.cumsum(many + 3)
        begin = ends - many - 3
        word = np.ones(ends[-1], bool)
        word[begin] = word[begin + 1] = word[ends - 1] = False
        ids = np.full(len(word), known["end"], np.uint16)
        ids[word] = classes.take(flat)
        sums = lambda values, each: np.add.reduceat(np.insert(values.take(flat), np.cumsum(many), each), np.cumsum(many + 1) - many - 1)
        offsets = pa.array(np.concatenate(([0], ends * 2)).astype(np.int32)).buffers()[1]
        return pa.table({
            "doc_id": texts.column("doc_id"), "learn": texts.column("learn"), "n_words": texts.column("n_words"),
            "n_known": pa.array(sums((counts > 0).astype(np.int64), int(known["texts"] > 0))),
            "base": pa.array(sums(base, math.log10((known["texts"] + 1) / (known["tokens"] + known["distinct"] + 1)))), "apart": pa.array(sums(apart, 0.0)),
            "ids": pa.BinaryArray.from_buffers(pa.binary(), len(many), [None, offsets, pa.py_buffer(ids)]),
        })

    return run


COPIES = "slice int, copy int, weights binary, moved binary"


def _trainer(shared, n_round: int, expected: float):
    """Rows come copy by copy. For each copy, rows with slices of how far the parameters have moved, and how often it met each."""

    def run(batches):
        known = shared.value
        started, model, waiting = known["rows"], None, []
        copy = seen = held = 0
        met = None

        def learn():
            nonlocal waiting, held, seen, met
            two, one, word = (np.concatenate([x[n : len(x) - 2 + n] for x in waiting]) for n in range(3))
            begin, end = (min(1.0, n / expected) for n in (seen, seen + held))
            model.train(two, one, word, n_round * 1_000_003 + seen % 1_000_003 + 1, begin, end)
            for x in (two, one, word):
                met[: len(model.bias)] += np.bincount(x, minlength=len(model.bias))
            met[len(model.bias) : -SIZE] += np.bincount(model.cluster.take(word), minlength=len(model.top))
            met[-SIZE:] += len(word)
            waiting, seen, held = [], seen + held, 0

        def finished():
            if waiting:
                learn()
            moved = (model.rows() - started).astype(np.float16)
            parts = range(0, len(moved), SLICE)
            for part in (parts[n : n + 16] for n in range(0, len(parts), 16)):
                columns = [[at // SLICE for at in part], [copy] * len(part), [met[at : at + SLICE].tobytes() for at in part], [moved[at : at + SLICE].tobytes() for at in part]]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_names(COPIES))

        for batch in batches:
            for b, raw in zip(batch.column("copy").to_pylist(), batch.column("ids"), strict=True):
                if model is None or b != copy:
                    if model is not None:
                        yield from finished()
                    model, copy, seen = LogBilinear(known["mass"], known["cluster"]).load(started), b, 0
                    met = np.ones(len(started), np.float32)
                waiting.append(np.frombuffer(raw.as_py(), np.uint16))
                held += len(waiting[-1]) - 2
                if held >= SEGMENT:
                    learn()
        if model is not None:
            yield from finished()

    return run


def _merged(copies: pa.Table) -> pa.Table:
    """A slice averaged over copies, each row weighted by how often the copy met it."""
    copies = copies.sort_by("copy")
    total = weights = 0
    for w, m in zip(copies.column("weights").to_pylist(), copies.column("moved").to_pylist(), strict=True):
        w = np.frombuffer(w, np.float32).astype(float)
        total = total + w[:, None] * np.frombuffer(m, np.float16).reshape(len(w), -1)
        weights = weights + w
    return pa.table({
        "slice": copies.column("slice")[:1].cast(pa.int32()), "copy": copies.column("copy")[:1].cast(pa.int32()),
        "weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "moved": pa.array([(total / weights[:, None]).astype(np.float16).tobytes()], pa.binary()),
    })


def averaged(copies: DataFrame, rows: np.ndarray, n_copies: int) -> np.ndarray:
    """``rows`` after the mean move of each over the copies; as many numbers as the model has come to the driver."""
    if n_copies > SLICES:
        copies = copies.groupBy("slice", F.pmod("copy", F.lit(math.ceil(math.sqrt(n_copies)))).alias("g")).applyInArrow(_merged, COPIES)
    rows = rows.copy()
    for r in copies.groupBy("slice").applyInArrow(_merged, COPIES).select("slice", "moved").collect():
        part = rows[r["slice"] * SLICE : (r["slice"] + 1) * SLICE]
        part += np.frombuffer(r["moved"], np.float16).reshape(part.shape)
    return rows


SCORED = "doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scorer(shared):
    def run(batches):
        known = shared.value
        model = LogBilinear(known["mass"], known["cluster"]).load(known["rows"]).ready()
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("ids")]
            likely = np.zeros(len(ids))
            for part in _slices(np.array([len(x) for x in ids]), PIECE):
                many = np.array([len(x) - 2 for x in ids[part]])
                two, one, word = (np.concatenate([x[n : len(x) - 2 + n] for x in ids[part]]) for n in range(3))
                each = [model.log10(*(x[at : at + 2 * PIECE] for x in (two, one, word))) for at in range(0, len(word), 2 * PIECE)]
                likely[part] = np.add.reduceat(np.concatenate(each), np.cumsum(many) - many)
            columns = [batch.column("doc_id"), batch.column("learn"), pc.add(batch.column("n_words"), 1), batch.column("n_known"), batch.column("base"), pc.add(batch.column("apart"), pa.array(likely))]
            yield pa.RecordBatch.from_arrays(columns, names=_names(SCORED))

    return run


def score(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, base_score, score, train_tokens), learning from the rows where ``learn`` holds."""
    spark = df.sparkSession
    texts = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    encoded = stored(texts.mapInArrow(_encode, ENCODED))
    words = encoded.where("word IS NOT NULL").select("chunk", "word", "id", "n")
    counted = stored(words.groupBy("word").agg(F.sum("n").alias("c")))
    ends = encoded.where("word IS NULL AND learn").count()
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    top = heads(counted)
    vocabulary = Vocabulary(top, ends)
    # A row for each word with vectors, which MOST bounds.
    numbered = spark.createDataFrame(pa.table({"w": pa.array(list(vocabulary.number), pa.string()), "own": pa.array(list(vocabulary.number.values()), pa.int32())}))
    classed = counted.join(F.broadcast(numbered), counted.word == numbered.w, "left").select(F.col("word").alias("w"), "c", "own", F.coalesce("own", vocabulary.rest_class()).alias("class"))
    rest = np.zeros(len(vocabulary.mass))
    rest[vocabulary.rest] = 1
    for r in classed.where("own IS NULL").groupBy("class").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("d")).collect():  # a row for each cluster
        vocabulary.mass[r["class"]] = r["n"]
        rest[r["class"]] = r["n"] + r["d"] + 1
    vocabulary.mass[vocabulary.rest] += 1
    known = {"tokens": total[0] + ends, "distinct": total[1] + (ends > 0), "texts": ends, "end": vocabulary.end, "rest": rest}
    looked_up = words.join(classed.select("w", "c", "class"), words.word == F.col("w")).select(F.col("chunk").alias("of"), F.expr("shiftleft(cast(id AS bigint), 16) | class").alias("place"), "c")
    rows = encoded.where("word IS NULL").select("chunk", "doc_id", "learn", "n_words", "ids")
    prepared = stored(rows.groupBy("chunk").cogroup(looked_up.groupBy("of")).applyInArrow(_preparer(known), PREPARED))
    drop(encoded, counted)
    model = LogBilinear(vocabulary.mass, vocabulary.cluster)
    shared = {"mass": vocabulary.mass, "cluster": vocabulary.cluster, "rows": model.rows()}
    n_copies = max(1, min(MOST_COPIES, math.ceil(known["tokens"] / COPY_TOKENS)))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_words") / PIECE)))
    pieces = prepared.where("learn").select("doc_id", "ids", part.alias("part")).select("doc_id", "part", F.substring("ids", F.col("part").cast("int") * (2 * PIECE) + 1, F.lit(2 * PIECE + 4)).alias("ids"))
    order = F.xxhash64("doc_id", "part", "ids")
    pieces = pieces.select(order.alias("order"), F.pmod(order, F.lit(n_copies)).cast("int").alias("copy"), "ids")
    for n_round in range(2):
        shared_now = spark.sparkContext.broadcast(shared)  # MOST bounds its size
        some = pieces.where(F.col("copy") % WARM == 0) if n_round == 0 else pieces
        dealt = some.repartitionById(n_copies, "copy").sortWithinPartitions("copy", "order", "ids").select("copy", "ids")
        trained = stored(dealt.mapInArrow(_trainer(shared_now, n_round, known["tokens"] / n_copies), COPIES))
        shared = shared | {"rows": averaged(trained, shared["rows"], n_copies)}
        drop(trained)
    scored = prepared.mapInArrow(_scorer(spark.sparkContext.broadcast(shared)), SCORED)
    return scored.withColumn("train_tokens", F.lit(known["tokens"]).cast("long"))
