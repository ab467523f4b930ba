"""The pipeline's stages on odd rows, and its result against stages made by hand."""

import collections
import hashlib
import math
import re

import public_tokenizers
import pytest

import corpus_pipeline
from millrace.llm import mixing, quality_rules, secrets
from tests.llm.test_corpus_operators import ODD, SCHEMA, SF, brute_components, brute_targets


def test_stages_survive_odd_and_empty_tables(spark):
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            assert n + 1 == len(corpus_pipeline.STAGES) or docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
            docs.count()


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    mask = quality_rules.POLICIES[quality_rules.CURRENT]

    def passes(text):
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure_text(text), strict=True))
        return not any(eval(r.failed, {}, m) for r in quality_rules.RULES if mask >> r.bit & 1)

    good = {i: t for i, t in rows.items() if passes(t)}
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality_rules"](spark, docs, SF)
    assert {r.doc_id: r.text for r in one.collect()} == good
    kept = {i for i, (_, c) in brute_components(list(good.items()), 5).items() if c == i}
    two = stage["near_dedup"](spark, one, SF)
    assert {r.doc_id for r in two.collect()} == kept
    three = {r.doc_id: r for r in stage["secret_scan"](spark, two, SF).collect()}
    assert three.keys() == kept
    for i, r in three.items():
        assert r.n_chars == len(r.text)
        assert all(len(m[x.group]) < x.least for x in secrets.RULES for m in re.finditer(x.pattern, r.text))
        assert r.text == good[i] or "[SECRET]" in r.text


def test_run(spark):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) > 100
    decoded = [(texts[r.doc_id], theirs.decode(r.ids)) for r in got]
    sources = len({r.source for r in got})
    # A source's last document may be cut, and secrets are masked; all others come whole.
    assert sum(a != b and "[SECRET]" not in b for a, b in decoded) <= sources
    assert all(a.startswith(b) for a, b in decoded if "[SECRET]" not in b)
    assert all(r.n_tokens == len(r.ids) for r in got)


def plain_mix(rows, block=mixing.BLOCK, repeats=mixing.MAX_REPEATS, seed=mixing.SEED):
    """(text, times, cut text or None) of each row (doc_id, source, text), block by block and document by document."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    draw = lambda key, s: int(hashlib.md5(f"{s}:{key}".encode()).hexdigest()[:15], 16)
    sizes = collections.Counter()
    for _, source, text in rows:
        sizes[source] += len(words(text))
    targets = brute_targets(sizes)

    def dealt(votes, seats, most):
        """Sainte-Laguë seat by seat; ties go to the lesser party."""
        quotients = sorted((-v / (2 * k + 1), (p is None, p if p is not None else ""), p) for p, v in votes.items() if v > 0 for k in range(seats + 1))[:seats]
        got = collections.Counter(p for *_, p in quotients)
        return {p: min(got[p], most[p]) for p in votes}

    cap = lambda n: math.ceil(n * repeats / block)
    by_source = dealt(targets, round(sum(targets.values()) / block), {s: cap(n) for s, n in sizes.items()})
    out = []
    for source in sizes:
        mine = [r for r in rows if r[1] == source]
        n = min(mixing.MOST_SHARDS, -(-len(mine) // mixing.SHARD_ROWS))
        shards = {}
        for r in mine:
            shards.setdefault(draw(r[0], seed) % n, []).append(r)
        held = {s: sum(len(words(r[2])) for r in part) for s, part in shards.items()}
        quota = dealt({s: float(v) for s, v in held.items()}, by_source[source], {s: cap(v) for s, v in held.items()})
        for s, part in shards.items():
            left = quota[s] * block
            whole = min(repeats, left // held[s]) if held[s] else 0
            over = left - whole * held[s] if whole < repeats else 0
            for key, _, text in sorted(part, key=lambda r: (draw(r[0], seed + 1), r[0])):
                size = len(words(text))
                more, over = min(size, over), max(0, over - size)
                out += [(key, text)] * (whole if size else 0)
                if more:
                    out.append((key, "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)[:more]) if more < size else text))
    return out


@pytest.mark.parametrize("shard_rows", [40, 512])
def test_mixing_and_encoding_stages_against_brute_force(spark, monkeypatch, shard_rows):
    from tokenizers import Tokenizer

    monkeypatch.setattr(mixing, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(mixing.mix, "__defaults__", tuple(shard_rows if d == 512 else d for d in mixing.mix.__defaults__))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)
    mixed = stage["source_mixing"](spark, docs, SF)
    want = sorted(plain_mix(rows))
    found = mixed.collect()
    assert len(want) > 100 and sorted((r.doc_id, r.text) for r in found) == want
    assert all(r.n_chars == len(r.text) for r in found)
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = sorted((r.doc_id, r.n_tokens, list(r.ids)) for r in stage["bpe_encode"](spark, mixed, SF).collect())
    assert ids == sorted((k, len(e := theirs.encode(t, add_special_tokens=False).ids), e) for k, t in want)
