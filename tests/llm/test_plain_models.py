"""The learned operators replayed in plain Python from their fitted numbers, sharing no code with them but the numbers."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints, language, language_model, quality_model
from millrace.llm.queries import QUERIES
from millrace.llm.text import fold_is
from tests.llm.test_corpus_operators import SF

M32, M64 = 2**32 - 1, 2**64 - 1


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# Fingerprints: byte by byte


def byte_value(b):
    x = ((b + 1) * 0x9E3779B97F4A7C15 & M64) >> 13
    return (x ^ x >> 17) & M32


def plain_fingerprint(text):
    data = text.encode()
    if not data:
        return "1::"
    hashes = []
    for n in range(len(data)):
        h = sum(byte_value(data[n - back]) * pow(0x01000193, back, 2**32) for back in range(min(7, n + 1))) & M32
        h ^= h >> 15
        h = h * 0x2C1B3C6D & M32
        hashes.append(h ^ h >> 12)
    zeros = lambda h: (h & -h).bit_length() - 1 if h else 32

    def ends_at(k):
        return [n for n, h in enumerate(hashes) if zeros(h) >= k]

    k = 0
    while len(ends_at(k)) >= 64:
        k += 1

    def signature(k):
        ends, out, total, open_ = set(ends_at(k)), "", 0, False
        for n, h in enumerate(hashes):
            total, open_ = (total + h * 0x9E3779B97F4A7C15) & M64, True
            if n in ends:
                out, total, open_ = out + letter(total), 0, False
        return out + letter(total) if open_ else out

    return f"{2**k}:{signature(k)}:{signature(k + 1)}"


def letter(total):
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(total * 0xD6E8FEB86659FD93 & M64) >> 58]


def plain_alike(a, b):
    """By the table of edit distances (insertions and deletions), where the two share a run."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = max(1, min(4, len(a) // 4, len(b) // 4))
    if not any(a[i : i + run] in b for i in range(len(a) - run + 1)):
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return 1 - row[-1] / (len(a) + len(b))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (x, *s), (y, *t) = a.split(":"), b.split(":")
    found = [plain_alike(s[i], t[j]) for i in (0, 1) for j in (0, 1) if int(x) * 2**i == int(y) * 2**j]
    return max(found, default=0.0)


def test_fingerprints_byte_by_byte(spark, documents):
    rows = sorted((r for r in documents if len(r[1]) < 3000), key=lambda r: -r[0])[:60]
    docs = spark.createDataFrame([*rows, (-1, ""), (-2, "a"), (-3, "é" * 300)], "doc_id long, text string")
    rows = [*rows, (-1, ""), (-2, "a"), (-3, "é" * 300)]
    got = {r.doc_id: r for r in fingerprints.edited_pairs(docs).collect()}
    for n, (key, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_fingerprint(text), plain_fingerprint(edited))
        assert r.near_edited == pytest.approx(plain_likeness(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(plain_likeness(r.fingerprint, plain_fingerprint(after)))


def test_likeness_by_table():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(2))
        x, y = f"{2 ** rng.randrange(3)}:{a}:{a[::2]}", f"{2 ** rng.randrange(3)}:{b}:{b[::2]}"
        assert fingerprints.likeness(x, y) == pytest.approx(plain_likeness(x, y))


# Language identification: margins, losses and the nearest codeword


def plain_language(text, model):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = f" {text} ".encode()
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    counts = {}
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            g = data[i]
            for b in data[i + 1 : i + n]:
                g = (g * 0x01000193 + b) & M32
            at = (g * 0x9E3779B1 & M32) >> 19
            counts[at] = counts.get(at, 0) + 1
    norm = math.sqrt(sum(counts.values()))  # of the square roots
    margins = [float(model.offsets[k]) + sum(math.sqrt(c) / norm * float(model.weights[f, k]) for f, c in counts.items()) for k in range(model.code.shape[1])]
    losses = [sum(float(model.trust[k]) * math.log1p(math.exp(-m * row[k])) for k, m in enumerate(margins)) for row in model.code]
    gains = [math.exp(min(losses) - v) for v in losses]
    best = min(range(len(losses)), key=lambda n: losses[n])
    return model.languages[best], gains[best] / sum(gains)


def test_languages_by_plain_decoding(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, F.col("doc_id").isNotNull() & ~fold_is(F.col("doc_id"), 5, 0))
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    assert len(got) == len(documents)
    for key, text in documents:
        if len(text) < 4000:
            lang, score = plain_language(text, model)
            assert got[key].lang_pred == lang and got[key].score == pytest.approx(score, abs=1e-4)


# Quality: statistics, rules and their weights


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(n - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    letters = sum(c.isalpha() for c in text)
    capitals = sum(len(m) for m in re.findall(r"[A-Z]+", text)) + sum(1 for c in text if c > "\x7f" and c.isupper())
    over = lambda a, b: a / b if b else 0.0
    return [float(n), over(chars, n), over(len(re.findall(r"[#*$%&|<>]", text)), n), over(text.count("!"), n), over(len(lines) - len(set(lines)), len(lines)), over(len(repeated), n), over(letters, chars), over(capitals, letters), over(n, len(lines))]


def test_quality_by_plain_rules(spark, documents):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.fit(docs.select("doc_id", "text"), labels, F.col("doc_id").isNotNull() & ~fold_is(F.col("doc_id"), 5, 0))
    assert len(model.rules) > 3
    got = {r.doc_id: r for r in QUERIES["op7_quality_classifier"](spark, SF).collect()}
    for key, text in documents:
        x = plain_statistics(text)
        z = model.intercept
        for rule, weight in model.rules:
            if all((x[f] < cut) if below else (x[f] >= cut) for f, below, cut in rule.parts):
                z += weight
        score = 1 / (1 + math.exp(-z))
        assert got[key].score == pytest.approx(score, abs=1e-9), text[:80]
        assert got[key].predicted == (got[key].score >= 0.3)


# Log-bilinear model: every word's probability by the formula


def test_log_bilinear_scores_by_formula():
    """log p(w | u, v) = log p(cluster) + log p(w in its cluster), both softmaxes over q = C1 r(u) + C2 r(v)."""
    rng = np.random.default_rng(2)
    mass, cluster = rng.integers(1, 50, 12).astype(float), np.repeat([0, 1, 2, 3], 3)
    model = language_model.LogBilinear(mass, cluster)
    for part in (model.inward, model.outward, model.bias, model.place, model.top, model.top_bias):
        part += rng.normal(0, 0.4, part.shape).astype(np.float32)
    inward, outward, place = (np.array(p, float) for p in (model.inward, model.outward, model.place))
    bias, top, top_bias = (np.array(p, float) for p in (model.bias, model.top, model.top_bias))
    two, one, word = (rng.integers(0, 12, 200).astype(np.uint16) for _ in range(3))
    got = model.ready().log10(two, one, word)
    for n in range(200):
        q = [sum(inward[two[n], i] * place[0, i, j] + inward[one[n], i] * place[1, i, j] for i in range(inward.shape[1])) for j in range(place.shape[2])]
        dot = lambda row: sum(a * b for a, b in zip(q, row, strict=True))  # noqa: B023, E731
        tops = [dot(top[c]) + top_bias[c] for c in range(4)]
        c = int(cluster[word[n]])
        members = {w: dot(outward[w]) + bias[w] for w in range(12) if cluster[w] == c}
        softmax = lambda x, all_: x - math.log(sum(map(math.exp, all_)))
        want = softmax(tops[c], tops) + softmax(members[word[n]], members.values())
        assert got[n] == pytest.approx(want / math.log(10), abs=2e-4)
