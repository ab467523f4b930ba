"""A quality classifier as a sparse ensemble of rules.

Boosted trees over text statistics are cut into their paths, each a conjunction
of comparisons; logistic regression with an L1 penalty weighs the conjunctions
and drops most. What is left compiles into one Spark column expression over the
statistics, so scoring is plain projection after one pass that measures texts.

The ensemble learns from at most about ``SAMPLE`` labelled rows, drawn by a
hash of the key.

Defined results: a null text counts as empty and is scored by its statistics,
which are all 0; without labelled rows every score is 0.5; rows that repeat a
key are scored on their own, and equal statistics have equal scores; texts of
any length are measured whole; an empty table gives an empty result; other
columns are carried along, and a column whose name is one of the result's is
replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import boosting
from millrace.llm.quality_rules import MEASURES, measured
from millrace.llm.text import fresh, others, quoted

#: Labelled rows that the ensemble learns from, about.
SAMPLE = 20_000
ROUNDS, DEPTH, PENALTY = 24, 3, 4e-4

#: SQL over the measurements of the rule ledger.
STATISTICS = {
    "words": "cast(n_words as double)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0D)",
    "symbols": "coalesce(try_divide(n_symbols, n_words), 0D)",
    "exclaims": "coalesce(try_divide(n_exclaim, n_words), 0D)",
    "line_repeats": "coalesce(try_divide(n_dup_lines, n_lines), 0D)",
    "word_repeats": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
    "letters": "coalesce(try_divide(n_letters, word_chars), 0D)",
    "capitals": "coalesce(try_divide(n_upper, n_letters), 0D)",
    "line_words": "coalesce(try_divide(n_words, n_lines), 0D)",
}


def statistics(df: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """``df`` with ``out``: a struct of a double for each of STATISTICS."""
    name = fresh(df, "_measured")
    measures = df.select("*", measured(text).alias(name))
    of = lambda sql: F.expr(re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"{name}.\1", sql))
    return measures.select(*others(df, out), F.struct(*(of(sql).alias(n) for n, sql in STATISTICS.items())).alias(out))


@dataclass(frozen=True)
class Rule:
    """All of the comparisons (feature, below, cut): feature < cut if below, else feature >= cut."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, below, cut in self.parts:
            out &= (x[:, f] < cut) == below
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for f, below, cut in self.parts:
            out = out & (F.col(names[f]) < cut if below else F.col(names[f]) >= cut)
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, statistics: str = "statistics") -> Column:
        z = F.lit(self.intercept)
        names = [f"{statistics}.{n}" for n in STATISTICS]
        for rule, weight in self.rules:
            z = z + F.when(rule.column(names), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def paths(tree: boosting.Node, above: dict | None = None) -> list[Rule]:
    """The conjunction on the way to every node but the root; of comparisons of one feature on one side the tightest stays."""
    above = above or {}
    if tree.feature < 0:
        return []
    found = []
    for below, child in ((True, tree.left), (False, tree.right)):
        key = (tree.feature, below)
        tight = min if below else max
        here = above | {key: tight(above.get(key, tree.cut), tree.cut)}
        found += [Rule(tuple(sorted((f, b, c) for (f, b), c in here.items()))), *paths(child, here)]
    return found


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty (not on the intercept), by accelerated proximal steps."""
    n, width = x.shape
    rate = 1.0 / (0.25 * (np.linalg.norm(x, 2) ** 2 / n + 1))
    w, b = np.zeros(width), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        error = (boosting.sigmoid(x @ v + c) - y) / n
        step = v - rate * (x.T @ error)
        new_w, new_b = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), c - rate * error.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, float(new_b), new_t
    return b, w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", label: str = "quality", text: str = "text") -> Ensemble:
    """The ensemble for ``label`` (0 or 1) from labelled rows where ``learn`` (over the key) holds."""
    able = labels.where(learn & F.col(quoted(label)).isNotNull()).select(F.col(quoted(key)).alias("k"), F.col(quoted(label)).cast("double").alias("y"))
    unit = F.pmod(F.xxhash64(F.lit(7), "k"), F.lit(1 << 30)) / float(1 << 30)
    chosen = able.where(unit < SAMPLE / max(1, able.count()))
    # SAMPLE bounds what is broadcast; texts stay where they are.
    texts = docs.select(F.col(quoted(key)).alias("doc"), F.col(quoted(text)).alias("text"))
    rows = statistics(texts.join(F.broadcast(chosen), F.col("doc") == F.col("k")).select("k", "y", "text"))
    got = np.array(sorted(tuple(r) for r in rows.select("k", "y", "statistics.*").collect()), float).reshape(-1, 2 + len(STATISTICS))
    y, x = got[:, 1], got[:, 2:]
    if not len(y):
        return Ensemble(0.0, ())
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    _, trees = boosting.boost(x, y, ROUNDS, DEPTH, least=1.0, seed=13, share=0.6)
    held: dict[bytes, Rule] = {}
    for rule in dict.fromkeys(r for t in trees for r in paths(t)):
        holds = rule.holds(x)
        if 0 < holds.sum() < len(y):
            held.setdefault(np.packbits(holds).tobytes(), rule)  # of rules that hold for the same rows one is enough
    if not held:
        return Ensemble(prior, ())
    rules = list(held.values())
    intercept, weights = lasso(np.stack([r.holds(x) for r in rules], 1).astype(float), y, PENALTY)
    return Ensemble(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def predict(df: DataFrame, model: Ensemble, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with score and predicted."""
    name = fresh(df, "_statistics")
    return statistics(df, text, name).select(*others(df, "score", "predicted"), model.score(name).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
