"""Secret scanning through a trigram inverted index, with DataFrame functions only.

Each rule is a regex. From its syntax a Boolean query over trigrams is derived
(``trigram_query``): an OR of clauses, each an AND of trigrams that every match
must hold. ``posting_lists`` is the inverted index of the rules' trigrams: for
each trigram the lists of texts that hold it, one list for each shard of texts,
so that no list grows with the corpus. ``candidates`` intersects the lists of
each clause, shard by shard; only candidates are verified with the regex.
Rules without mandatory trigrams scan every text.

A text is named by the hash of its content, so keys don't matter, copies are
listed once, and a clash of hashes gives a candidate more but loses none. The
index is folded to lower case, so a case-sensitive rule gets a superset of its
candidates. Candidates are broadcast up to ``BROADCAST`` of them, a few bytes
each, so that texts stay where they are; more meet the texts in a join.

Defined results: a null text counts as empty; rows that share a doc_id (or have
none) and repeated rows are each verified on their own text; texts of any
length are scanned whole, in time that grows with their length and their hits;
an empty table gives an empty result; other columns are carried along, and a
column whose name is one of the result's is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import fresh, others, quoted, stored


@dataclass(frozen=True)
class SecretRule:
    """A match of ``pattern`` counts if group ``group`` has ``least`` characters or more; failing matches are consumed."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
#: The contract's kinds, in its order.
BASE_RULES = (
    SecretRule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A run is maximal, so runs of 24 and more are just the matches that count.
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that are added to them: formats with a fixed prefix.
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
)
RULES = BASE_RULES + MORE_RULES
#: More literal alternatives than this in one clause are given up: the trigrams around them remain.
MAX_EXPANSION = 64
#: Postings of a shard, about, and candidates that may be broadcast.
SHARD, BROADCAST = 1 << 20, 1 << 20
#: Items that are folded together; the folds of all blocks before it go to each block.
BLOCK = 256
#: Code points of a piece that a position is sought in.
PIECE = 1024


def _strings(nodes) -> list[str] | None:
    """All strings that a parsed piece of a regex matches, in lower case; None if they are many or unbounded."""
    found = [""]
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            options = [chr(arg).lower()]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            options = sorted({chr(c).lower() for _, c in arg})
        elif name == "SUBPATTERN":
            options = _strings(arg[-1])
        elif name == "BRANCH":
            each = [_strings(x) for x in arg[1]]
            options = None if None in each else sorted({s for x in each for s in x})
        elif name == "MAX_REPEAT" and arg[1] <= 1 and (inner := _strings(arg[2])) is not None:
            options = sorted({*inner, ""}) if arg[0] == 0 else inner
        else:
            options = None
        if options is None or len(found) * len(options) > MAX_EXPANSION:
            return None
        found = [a + b for a, b in product(found, options)]
    return found


def trigram_query(pattern: str) -> list[list[str]]:
    """An OR of ANDs of trigrams which every match of ``pattern`` satisfies; empty if none is mandatory."""
    runs: list[list[str]] = [[""]]
    for node in _parser.parse(pattern):
        options = _strings([node])
        if options is not None and len(runs[-1]) * len(options) <= MAX_EXPANSION:
            runs[-1] = [a + b for a, b in product(runs[-1], options)]
        else:
            runs += [options if options is not None else [""]]
    grams = lambda s: frozenset(s[k : k + 3] for k in range(len(s) - 2))
    # Every run is mandatory, so the query of any one is sound; the one whose weakest clause is longest says most.
    queries = [q for q in ({grams(s) for s in run} for run in runs) if all(q)]
    if not queries:
        return []
    best = max(queries, key=lambda q: (min(map(len, q)), -len(q)))
    return sorted(sorted(c) for c in best if not any(d < c for d in best))


def postings(df: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """A row (gram, place) for each trigram that a text holds, by its number in ``grams``; ``place`` is the text's hash."""
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("folded"), F.lit(g)), F.lit(n)) for n, g in enumerate(grams))))
    folded = df.select(F.xxhash64(quoted(text)).alias("place"), F.lower(quoted(text)).alias("folded"))
    return folded.select("place", F.explode(held).alias("gram"))


def posting_lists(found: DataFrame, shards: int) -> DataFrame:
    """The inverted index: (shard, gram, places), a list of texts for each trigram and shard."""
    return found.groupBy(F.pmod("place", F.lit(shards)).alias("shard"), "gram").agg(F.collect_set("place").alias("places"))


def candidates(df: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """(place, bits): bit n says that the posting lists of rule n's query intersect in the text. Stored."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for clause in q for g in clause})
    if not grams:
        return stored(df.select(F.lit(0).cast("long").alias("place"), F.lit(0).alias("bits")).limit(0))
    found = stored(postings(df, grams, text))
    lists = posting_lists(found, max(1, found.count() // SHARD))
    shard = lists.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "places"))).alias("lists"))
    none = F.array().cast("array<bigint>")
    of = lambda g: F.coalesce(F.element_at("lists", F.lit(grams.index(g))), none)
    met = []
    for n, query in enumerate(queries):
        for clause in query:
            both = of(clause[0])
            for g in clause[1:]:
                both = F.array_intersect(both, of(g))
            met.append(F.struct(F.lit(1 << n).alias("bit"), both.alias("places")))
    hits = shard.select(F.explode(F.array(*met)).alias("m")).select("m.bit", F.explode("m.places").alias("place"))
    return stored(hits.groupBy("place").agg(F.bit_or("bit").alias("bits")))


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _befores(items: Column, value, merge) -> Column:
    """For each item of an array, the fold by ``merge`` (from 0) of the values of all items before it.

    Items are folded in blocks, so that no array grows item by item.
    """
    zero, none = F.lit(0), F.array().cast("array<int>")

    def along(part: Column, start: Column, of) -> Column:
        begun = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(part, begun, lambda acc, x: F.struct(merge(acc["at"], of(x)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def by_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: merge(acc, value(x))))
        return F.flatten(F.zip_with(blocks, along(whole, zero, lambda x: x), lambda b, start: along(b, start, value)))

    cut = F.transform(F.sequence(zero, F.greatest(zero, F.floor((F.size(items) - 1) / BLOCK).cast("int"))), lambda n: F.slice(items, n * BLOCK + 1, BLOCK))
    return _let(cut, by_blocks)


SPANS = "array<struct<start:int,end:int>>"


def rule_spans(text: Column, rule: SecretRule) -> Column:
    """array<struct<start,end>> of a rule's matches that count, in code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so
    running lengths give the places.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), judged.alias("judged"))
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    parts = F.transform(zipped, lambda p: F.struct(size(p["gap"]).alias("gap"), size(p["hit"]).alias("hit"), (size(p["judged"]) >= rule.least).alias("ok")))

    def placed(parts: Column) -> Column:
        befores = _befores(parts, lambda p: p["gap"] + p["hit"], lambda a, b: a + b)
        each = F.zip_with(parts, befores, lambda p, b: F.struct((b + p["gap"]).alias("start"), (b + p["gap"] + p["hit"]).alias("end"), p["ok"].alias("ok")))
        return F.transform(F.filter(each, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return F.when(F.rlike(text, F.lit(rule.pattern)), _let(parts, placed)).otherwise(F.array().cast(SPANS))


def _tagged(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def scan(df: DataFrame, rules=RULES, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """``df`` with ``out``: array<struct<start,rank,end,kind>> of all rules' spans, by start, then rule."""
    keep = others(df, out)
    bits, at = fresh(df, "_bits"), fresh(df, "_place")
    found = candidates(df, rules, text).select(F.col("place").alias(at), F.col("bits").alias(bits))
    found = F.broadcast(found) if found.count() <= BROADCAST else found
    joined = df.join(found, F.xxhash64(quoted(text)) == F.col(at), "left")
    whole = F.coalesce(F.col(quoted(text)), F.lit(""))
    spans = []
    for n, rule in enumerate(rules):
        each = rule_spans(whole, rule)
        if trigram_query(rule.pattern):
            each = F.when(F.col(bits).bitwiseAND(F.lit(1 << n)) != 0, each).otherwise(F.array().cast(SPANS))
        spans.append(F.transform(each, _tagged(n, rule.kind)))
    return joined.select(*keep, F.array_sort(F.concat(*spans)).alias(out))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by ``mark``; null stays null.

    The text is cut in pieces of PIECE code points, so that a place is found
    without a walk from the text's beginning.
    """

    def between(pieces: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        piece = lambda n: F.coalesce(F.get(pieces, n), F.lit(""))
        one = F.substring(piece(first), start % PIECE + 1, end - start)
        more = F.concat(
            F.substring(piece(first), start % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.substring(piece(last), F.lit(1), end % PIECE)
        )
        return F.when(first == last, one).otherwise(more)

    def masked(x: Column) -> Column:
        ends = _befores(x["spans"], lambda s: s["end"], F.greatest)
        gaps = F.filter(F.zip_with(x["spans"], ends, lambda s, b: F.struct(b.alias("start"), s["start"].alias("end"))), lambda g: g["start"] <= g["end"])
        kept = F.transform(gaps, lambda g: between(x["pieces"], g["start"], g["end"]))
        return F.concat(F.array_join(kept, mark), F.lit(mark), between(x["pieces"], F.array_max(F.transform(x["spans"], lambda s: s["end"])), x["size"]))

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = F.struct(pieces.alias("pieces"), spans.alias("spans"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, _let(whole, masked)).otherwise(text)


def _oracle() -> str:
    """The same spans in SQL, by scanning every text with every rule."""
    each = []
    for n, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        each.append(
            f"SELECT doc_id, {n} AS rank, '{r.kind}' AS kind, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits, "
            f"regexp_extract_all(text, '{p}', {r.group}) AS judged, {r.least} AS least FROM t WHERE regexp_matches(text, '{p}')"
        )
    joined = lambda cond: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER ({cond}), '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(each)}),
u AS (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM m),
p AS (SELECT doc_id, rank, kind, length(judged[i]) >= least AS ok,
  list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)::BIGINT AS s,
  length(hits[i]) AS len FROM u),
f AS (SELECT doc_id, rank, kind, s, s + len AS e FROM p WHERE ok)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({joined("rank < 3")}) AS base_sha256, {joined("rank IS NOT NULL")} AS spans
FROM t LEFT JOIN f ON f.doc_id = t.doc_id GROUP BY t.doc_id
"""


ORACLE = _oracle()
