"""The manifest, fill-in-the-middle and packing on odd inputs, and against plain loops."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import infill, manifest, packing
from millrace.llm.queries import QUERIES
from tests.llm.test_corpus_operators import ODD, SCHEMA, SF, clash

WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Manifest


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_path(nodes, at):
    """(root, [(sibling or None, it is on the left)]) of a list of digests."""
    path = []
    while len(nodes) > 1:
        run = at // 2 * 2
        path.append((nodes[run] if at % 2 else nodes[run + 1] if run + 1 < len(nodes) else None, at % 2 == 1))
        nodes, at = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], path


def plain_manifest(rows):
    """{(doc_id, leaf): (subroot, root, path)} of rows of FIELDS."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], plain_leaf(r)))
    names = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    roots = [plain_path([h for _, h in groups[g]], 0)[0] for g in names]
    out = {}
    for n, g in enumerate(names):
        for at, (key, h) in enumerate(groups[g]):
            out.setdefault((key, h), []).append((roots[n], plain_path(roots, 0)[0], plain_path([x for _, x in groups[g]], at)[1] + plain_path(roots, n)[1]))
    return out


def check_manifest(rows, df):
    want = {k: sorted(map(repr, v)) for k, v in plain_manifest(rows).items()}
    got = {}
    for r in df.withColumn("up", manifest.fold(F.col("leaf"), F.col("steps"))).collect():
        assert r["up"] == r["root"]
        got.setdefault((r["doc_id"], r["leaf"]), []).append(repr((r["subroot"], r["root"], [(s["digest"], s["left"]) for s in r["steps"]])))
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest_brute_force(spark, monkeypatch, bits):
    """With blocks of two and four as with 256: trees of one to many tiers."""
    monkeypatch.setattr(manifest, "BITS", bits)
    monkeypatch.setattr(manifest, "WIDTH", 1 << bits)
    rng = random.Random(bits)
    sizes = {None: 3, "": 1, "é": 17, "en": 33, "z": 16, "fr": 2}
    rows = [(n, rng.choice([None, "s", "t一"]), g, rng.choice([None, n]), "x" * n) for n, g in enumerate(x for x, c in sizes.items() for _ in range(c))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    check_manifest(rows, manifest.manifest(df, FIELDS))


def test_manifest_odd(spark, odd, none):
    rows = [(i, s, g, n, t) for i, t, g, s, n in ODD]
    check_manifest(rows, manifest.manifest(clash(odd, "place", "of", "steps", "tree", "a.b"), FIELDS))
    assert manifest.manifest(none, FIELDS).count() == 0
    one = manifest.manifest(odd.where("doc_id = 7"), FIELDS).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["steps"] == []


def test_tampered_rows_do_not_verify(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_merkle_manifest"](spark, SF).collect()
    assert len(got) == len(docs) and len({r["root"] for r in got}) == 1
    for r in got:
        bad = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and docs[r["doc_id"]]["n_chars"] is not None
        assert r["verified"] is (not bad)
        assert (r["folded_root"] == r["root"]) is r["verified"]


# Fill in the middle


def plain_infill(text, key, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(sha(f"{seed}:{'' if key is None else key}")[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text):
        return n, "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return n, *(("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")), len(p), len(m)


def test_infill_brute_force(spark):
    rng = random.Random(3)
    rows = [(n, "".join(rng.choice(["\n", "\n", "a", "é", "\U0001f600", "\r", "<", "P", "S>", ">", " ", " ", "word"]) for _ in range(rng.randint(0, 40)))) for n in range(600)]
    rows += [(-1, "\n"), (-2, "\n\n"), (-3, "no feed"), (-4, "<P>"), (-5, "<" * 9 + ">"), (-6, "<M\n>"), (-7, "x\n" * 50_000), (-8, "y" * 200_000)]
    df = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = {r["doc_id"]: r for r in df.collect()}
    assert {f for r in got.values() for f in [r["form"]]} == {"plain", "psm", "spm"}
    for key, text in rows:
        r = got[key]
        assert (r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == plain_infill(text, key)
        assert r["back"] == text


def test_infill_odd(odd, none):
    got = infill.fill_in_middle(clash(odd, "n", "Form", "a.b", "_infill")).collect()
    assert sorted((r["doc_id"] or -1, r["output"]) for r in got) == sorted((i or -1, plain_infill(t, i)[2]) for i, t, *_ in ODD)
    assert all(r["a.b"] == r["_infill"] == "mine" for r in got)
    assert infill.fill_in_middle(none).count() == 0
    assert {r["form"] for r in infill.fill_in_middle(odd, rate=0).collect()} == {"plain"}
    assert "spm" not in {r["form"] for r in infill.fill_in_middle(odd, spm=0).collect()}
    with pytest.raises(ValueError):
        infill.fill_in_middle(odd, rate=101)


def test_select_by_halving():
    rng = random.Random(5)
    for width in (1, 2, 3, 64, 1000):
        bits = rng.getrandbits(width) | 1 << rng.randrange(width)
        places = [i for i in range(width) if bits >> i & 1]
        assert [infill.select(bits, n, width) for n in range(len(places))] == places


# Packing


def plain_rooms(lengths, capacity):
    """The rooms that matching and best fit, one piece at a time, leave."""
    large, rooms = sorted((n for n in lengths if 3 * n > capacity), reverse=True), []
    while large:
        first = large.pop(0)
        second = next((n for n in large if n <= capacity - first), None)
        if second is not None:
            large.remove(second)
        rooms.append(capacity - first - (second or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        enough = [r for r in rooms if r >= n]
        if enough:
            rooms.remove(min(enough))
        rooms.append((min(enough) if enough else capacity) - n)
    return sorted(rooms)


def fewest(lengths, capacity):
    """The least number of sequences, by exhaustive search."""
    best = len(lengths)

    def search(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for r in {x for x in rooms if x >= rest[0]}:
            others = list(rooms)
            others.remove(r)
            search(rest[1:], [*others, r - rest[0]])
        search(rest[1:], [*rooms, capacity - rest[0]])

    search(sorted(lengths, reverse=True), [])
    return best


def rooms_of(runs, capacity):
    """The rooms that runs leave; every rank is placed once and there are no gaps."""
    held, used = {}, Counter()
    for r in sorted(runs):
        assert r.first == used[r.length]
        used[r.length] += r.count
        for i in range(r.count):
            held.setdefault(r.sequence + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
    rooms = []
    for items in held.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        rooms.append(capacity - at)
    assert sorted(held) == list(range(len(held))) and all(r >= 0 for r in rooms)
    return used, sorted(rooms)


def test_plan_brute_force():
    for seed in range(400):
        rng = random.Random(seed)
        capacity = rng.choice([1, 2, 3, 7, 12, 30, 100])
        lengths = [rng.randint(1, capacity if rng.random() < 0.7 else max(1, capacity // 4)) for _ in range(rng.randint(0, 50))]
        used, rooms = rooms_of(packing.plan(Counter(lengths), capacity), capacity)
        assert used == Counter(lengths) and rooms == plain_rooms(lengths, capacity)


def test_matching_leaves_as_few_sequences_as_can_be():
    for seed in range(60):
        rng = random.Random(seed)
        large = [rng.randint(11, 30) for _ in range(8)]
        assert len(rooms_of(packing.plan(Counter(large), 30), 30)[1]) == fewest(large, 30)
        mixed = large[:5] + [rng.randint(1, 10) for _ in range(4)]
        assert len(rooms_of(packing.plan(Counter(mixed), 30), 30)[1]) <= fewest(mixed, 30) + 1


def test_plan_is_bounded_by_the_capacity():
    rng = random.Random(1)
    assert len(packing.plan({n: rng.randint(1, 10**9) for n in range(1, 4097)})) < 5 * 4096


def check_packed(rows, got, capacity, path=WORD_PATH):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    held, pieces = {}, {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    want = {}
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        cut = [ids[a : a + capacity] for a in range(0, len(ids), capacity)]
        want.setdefault(key, []).extend((n, n * capacity, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for n, c in enumerate(cut))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for items in held.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == len(plain_rooms([p[2] for v in want.values() for p in v], capacity))
    return len(held)


def test_packing_query_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op13_best_fit_packing"](spark, SF).collect()
    n = check_packed(rows, got, 4096)
    assert n <= -(-sum(r["length"] for r in got) // 4096) + 1


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing_odd(spark, odd, none, capacity):
    rows = [(i, t) for i, t, *_ in ODD]
    packed = packing.pack(clash(odd, "length", "piece", "a.b"), WORD_PATH, capacity=capacity)
    got = packed.collect()
    check_packed(rows, got, capacity)
    assert all(len(r["ids"]) == r["length"] for r in got)
    joined = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in got:
        assert joined[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack(none, WORD_PATH).count() == 0


def test_words_are_encoded_as_whole_texts_are():
    from tokenizers import Tokenizer

    with open(WORD_PATH, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    assert encoder.by_word
    library = Tokenizer.from_file(WORD_PATH)
    rng = random.Random(2)
    some = [*"aAzZ09 \t\n\r\x0b\x1c\x1f\x85\xa0  ​ 　﻿̧́éÉßİıΣσẞ한한Å\U0001f600'<>|_-.,!", "'s", "'RE", "don't", "<|endoftext|>", "<|startoftext|>", "hello", "World", " the ", "  ", "é", "\u0000", "\x7f"]
    for _ in range(4000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 24)))
        want = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(want)}I", encoder.encode(text))) == want, repr(text)


def test_another_vocabulary_is_encoded_whole(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(odd, path, ids=False).collect()
    check_packed([(i, t) for i, t, *_ in ODD], got, 4096, path)
