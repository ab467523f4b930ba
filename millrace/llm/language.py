"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed byte n-grams
learns each bit. A text's bit margins are decoded by the loss they have against
every codeword, each bit weighted by how well its classifier did on rows it
didn't learn from. The nearest codeword wins; a text whose two nearest
codewords are about as near is flagged ambiguous.

The classifiers learn from ``SAMPLE`` or so whole texts, as many of each
language, drawn by a hash of the key. Prediction reads whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text if there is nothing to learn from; rows without a language
or key aren't learnt from; repeated rows are predicted alike; equally near
languages go by their code points; texts of any length are read whole, one at a
time; an empty table gives an empty result; other columns are carried along, and
a column whose name is one of the result's is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import fresh, others, quoted

#: Whole texts that the classifiers learn from, about; every language has the same share.
SAMPLE = 3000
#: Hashed n-gram features, and the lengths of the n-grams in bytes.
BITS, ORDERS = 13, (2, 3, 4)
#: Up to so many languages have the exhaustive code; more have random codewords.
EXHAUSTIVE = 5
#: Texts whose best probability leads the next by less are ambiguous.
MARGIN = 0.2


def code_words(n: int, seed: int = 11) -> np.ndarray:
    """A row of -1 and 1 for each of n languages; columns differ and split the languages."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns).T.astype(float)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, width))
        apart = min((code[i] != code[i + 1 :]).sum(1).min() for i in range(n - 1))
        if apart > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart
    return best


FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)


def vector(text: str) -> np.ndarray:
    """Square roots of the hashed n-gram counts of a whole text, scaled to length 1."""
    data = FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]
    counts = np.zeros(1 << BITS)
    gram = data.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            break
        gram = gram[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in ORDERS:
            counts += np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    counts = np.sqrt(counts)
    return (counts / (np.linalg.norm(counts) or 1)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages: a softmax of the negative weighted losses against each codeword."""
        margins = x @ self.weights + self.offsets
        losses = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.code[None], -30, 30))) @ self.trust
        gain = np.exp(losses.min(1, keepdims=True) - losses)
        return gain / gain.sum(1, keepdims=True)


def sample(df: DataFrame, learn: Column, key: str, text: str, lang: str) -> DataFrame:
    """About SAMPLE learnable rows, as many of each language, by a hash of the key; texts aren't shuffled."""
    able = df.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = able.groupBy("l").agg(F.count("*").alias("n")).collect()  # a row for each language, as the model has
    if not counts:
        return able
    share = F.create_map(*(x for r in counts for x in (F.lit(r["l"]), F.lit(SAMPLE / r["n"] / len(counts)))))
    unit = F.pmod(F.xxhash64(F.lit(3), "k"), F.lit(1 << 30)) / float(1 << 30)
    return able.where(unit < F.element_at(share, F.col("l")))


def fit(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", steps: int = 150) -> Model:
    """The classifiers of all bits, by logistic regression; the sample's vectors, not its texts, come to the driver."""
    packed = F.arrow_udf(lambda a: pa.array([vector(t.as_py()).astype(np.float16).tobytes() for t in a], pa.binary()), "binary")
    rows = sorted(sample(df, learn, key, text, lang).select("l", "k", packed("t").alias("v")).collect(), key=lambda r: (str(r["k"]), r["l"], r["v"]))
    languages = sorted({r["l"] for r in rows}, key=lambda s: s.encode())
    code = code_words(len(languages))
    width = code.shape[1] if len(languages) else 1
    weights, offsets = np.zeros((1 << BITS, width), np.float32), np.zeros(width, np.float32)
    if not rows:
        return Model([], code, weights, offsets, np.ones(width))
    x = np.stack([np.frombuffer(r["v"], np.float16) for r in rows]).astype(np.float32)
    y = code[[languages.index(r["l"]) for r in rows]].astype(np.float32)
    kept = np.arange(len(rows)) % 5 == 0
    a, t = x[~kept], y[~kept]
    counts = np.bincount([languages.index(r["l"]) for r, k in zip(rows, kept, strict=True) if not k], minlength=len(languages))
    importance = (1.0 / np.maximum(counts, 1))[[languages.index(r["l"]) for r, k in zip(rows, kept, strict=True) if not k]].astype(np.float32)
    importance = (importance / importance.sum())[:, None] if len(a) else importance[:, None]
    speed_w, speed_o = np.zeros_like(weights), np.zeros_like(offsets)
    for _ in range(steps if len(a) else 0):
        pull = -t / (1 + np.exp(np.clip(t * (a @ weights + offsets), -30, 30))) * importance
        speed_w = 0.9 * speed_w - 20.0 * (a.T @ pull + 1e-6 * weights)
        speed_o = 0.9 * speed_o - 2.0 * pull.sum(0)
        weights, offsets = weights + speed_w, offsets + speed_o
    right = ((x[kept] @ weights + offsets) * y[kept] > 0).mean(0) if kept.any() else np.ones(width)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return Model(languages, code, weights, offsets, trust / trust.mean())


STRUCT = "struct<lang_pred:string,score:double,ambiguous:boolean>"


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and ambiguous, from the text alone."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS and the number of languages

    def run(texts: pa.Array) -> pa.Array:
        m: Model = shared.value
        names, scores, unsure = [], [], []
        for begun in range(0, len(texts), 256):
            part = [t.as_py() for t in texts[begun : begun + 256]]
            able = [n for n, t in enumerate(part) if m.languages and t and any(map(str.isalpha, t))]
            lang, score, flag = ["und"] * len(part), [0.0] * len(part), [True] * len(part)
            if able:
                p = m.decode(np.stack([vector(part[n]) for n in able]))
                top = np.sort(p, 1)
                lead = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
                for n, best, prob, gap in zip(able, p.argmax(1), top[:, -1], lead, strict=True):
                    lang[n], score[n], flag[n] = m.languages[best], float(prob), bool(gap < MARGIN)
            names, scores, unsure = names + lang, scores + score, unsure + flag
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], ["lang_pred", "score", "ambiguous"])

    keep, name = others(df, "lang_pred", "score", "ambiguous"), fresh(df, "_found")
    out = df.select(*keep, F.arrow_udf(run, STRUCT)(quoted(text)).alias(name))
    return out.select(*keep, *(f"{name}.{c}" for c in ("lang_pred", "score", "ambiguous")))
