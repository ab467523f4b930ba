"""Quality rules as a ledger of bits.

``ledger`` evaluates every rule once for each document and stores the
measurements together with one long whose bit b says that rule b failed. What a
policy keeps, and what each rule costs, are then bitwise operations on that
column: changing a policy never reads a text again.

Defined results: a null text has no words, fails ``few_words`` and is rejected;
repeated rows each get their own equal row; texts of any length are measured
whole, one at a time; an empty table gives an empty ledger; other columns of the
input are carried along, and a column whose name is one of the ledger's is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import fresh, others, quoted

SYMBOLS = "#*$%&|<>"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_exclaim",
)


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements; integers only, so that every engine agrees."""

    name: str
    bit: int
    failed: str


#: A rule keeps its bit for good; new rules take new bits, so old ledgers stay readable.
RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", 2, "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", 3, "10 * n_dup_lines > 6 * n_lines"),
    Rule("short_words", 4, "word_chars < 3 * n_words"),
    Rule("long_words", 5, "word_chars > 15 * n_words"),
    Rule("shouting", 6, "10 * n_upper > 4 * n_letters"),
    Rule("exclaiming", 7, "10 * n_exclaim > 3 * n_words"),
    Rule("no_letters", 8, "n_letters < n_words"),
)
BASE = ("few_words", "repeated_windows")


def mask(*names: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in names)


#: Versioned policies: the rules a document must not fail.
POLICIES = {
    "v1": mask(*BASE),
    "v2": mask(*BASE, "symbol_heavy", "repeated_lines"),
    "v3": mask(*(r.name for r in RULES)),
}
CURRENT = "v3"


UPPER, LETTERS = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{L}+")


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()  # bytes split at space and \t to \r, as words are defined
    seen, lines, repeated = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            repeated += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    covered = 0
    if len(set(windows)) < len(windows):
        once, again = set(), set()
        for w in windows:
            (again if w in once else once).add(w)
        end = 0
        for i, w in enumerate(windows):
            if w in again:
                covered += i + 5 - max(i, end)
                end = i + 5
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        repeated,
        covered,
        lines,
        sum(map(len, LETTERS.findall(text))),
        sum(map(len, UPPER.findall(text))),
        text.count("!"),
    )


def _measure(texts: pa.Array) -> pa.Array:
    rows = [measure_text(t.as_py()) for t in texts]
    columns = zip(*rows) if rows else [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


def measured(text: str) -> Column:
    """The measurements of a text column, as a struct."""
    return F.arrow_udf(_measure, "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")(quoted(text))


def fail_bits() -> Column:
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements and ``fail_bits``; one pass, no shuffle."""
    rest, name = others(df, *MEASURES, "fail_bits"), fresh(df, "_measured")
    out = df.select(*rest, measured(text).alias(name))
    return out.select(*rest, *(F.col(f"{name}.{m}").alias(m) for m in MEASURES)).withColumn("fail_bits", fail_bits())


def policy_bits(policy: str | int) -> int:
    """The rules of a policy, given by its name or as bits."""
    if isinstance(policy, str):
        if policy not in POLICIES:
            raise ValueError(f"no policy {policy}; there are {', '.join(POLICIES)}")
        return POLICIES[policy]
    return policy


def passes(policy: str | int = CURRENT) -> Column:
    """Whether a ledger row fails none of a policy's rules."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy_bits(policy))) == 0


def ablation(ledgered: DataFrame, policy: str | int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    The rows meet in one count for each distinct bit pattern, made before the
    shuffle; at most 2**rules rows go on.
    """
    bits = policy_bits(policy)
    patterns = ledgered.groupBy(F.col("fail_bits").bitwiseAND(F.lit(bits)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if bits >> r.bit & 1]
    rule = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules)))
    out = patterns.select("bits", "n", rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit, others = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return out.groupBy("rule").agg(
        count(hit).alias("n_failed"),
        count(hit & (others == 0)).alias("n_only"),
        count(others == 0).alias("n_kept_without"),
        F.bit_or(F.when(hit, F.col("bits"))).alias("fails_with"),
    )


def quality_rules(df: DataFrame, policy: str | int = CURRENT, text: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and the verdict ``kept`` of a policy; base rules always reject."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(*BASE))) != 0
    return ledger(df, text).withColumn("base_failed", base).withColumn("kept", ~base & passes(policy))


# The same in SQL. Letters and upper case are matched by the same classes.
_BITS = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM t
), windows AS (
  SELECT doc_id, i, words[i:i+4] AS win FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS j FROM hits) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(lines) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dup.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    coalesce(dup.n_lines, 0)::BIGINT AS n_lines,
    len(regexp_extract_all(text, '\p{L}'))::BIGINT AS n_letters,
    len(regexp_extract_all(text, '\p{Lu}'))::BIGINT AS n_upper,
    len(regexp_extract_all(text, '!'))::BIGINT AS n_exclaim
  FROM w LEFT JOIN repeats ON repeats.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id
), bits AS (
  SELECT *, (""" + " + ".join(f"CASE WHEN {r.failed} THEN {1 << r.bit} ELSE 0 END" for r in RULES) + r""")::BIGINT AS fail_bits FROM m
)"""
ORACLE = f"""{_BITS}
SELECT *, fail_bits & {mask(*BASE)} <> 0 AS base_failed, fail_bits & {POLICIES[CURRENT]} = 0 AS kept, fail_bits & {POLICIES["v1"]} = 0 AS kept_v1, fail_bits & {POLICIES["v2"]} = 0 AS kept_v2 FROM bits
"""
ABLATION_ORACLE = f"""{_BITS}, rules(rule, bit) AS (VALUES {", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES)})
SELECT rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (fail_bits = bit)::BIGINT AS n_only,
  count(*) FILTER (fail_bits & ~bit = 0)::BIGINT AS n_kept_without, bit_or(fail_bits) FILTER (fail_bits & bit <> 0)::BIGINT AS fails_with
FROM bits, rules GROUP BY rule
"""
