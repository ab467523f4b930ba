"""Near-duplicate documents by HyperMinHash.

A text's shingle hashes are dealt over ``BUCKETS`` buckets by their first bits;
each bucket stores the least of the rest as a count of leading zeros and a few
bits of mantissa, 16 bits in all. Empty buckets borrow from others in a fixed
order, so that registers of small sets agree as often as large ones'. Bands of
``ROWS`` registers propose candidates; the share of equal registers, corrected
for chance collisions, estimates their Jaccard similarity; full sets decide.

Links are never spread out as all pairs of a group:

1. Documents of one shingle set are one class, with its smallest key standing
   for it.
2. In each band bucket every class meets one seeded leader; a class verifies
   its most promising leaders. Components follow.
3. A bucket that still holds several components has its minorities compared
   with all its members in blocks of bounded bytes: first on registers, and only
   classes that have a promising partner of another component then on full
   sets. Only links leave a block. So any two classes that share a band are
   either connected already or compared.

Two sets of similarity 0.8 share no band with a chance of about 3 in a million.

Defined results: texts without words, or null, have no shingles and stand
alone; rows that share a key are one document of all their texts; rows without
a key stand alone, with a null component, and are kept; texts of any length are
signed whole; of equally promising leaders the one with the larger key is
verified first; an empty table gives an empty result; other columns are carried
along, and a column whose name is one of the result's is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.shingles import BASE, Hasher, mixed, overlap, overlaps
from millrace.llm.text import drop, fresh, others, quoted, stored

WORDS, THRESHOLD = 5, 0.8
BUCKETS, MANTISSA = 256, 10
ROWS, BANDS = 6, 42
EMPTY = 0xFFFF
#: Candidates whose estimate is lower by more than this (over five standard deviations) aren't verified.
SLACK = 0.15
#: Leaders that a class verifies in step 2.
LEADERS = 3
#: Texts that are signed at once.
STEP = 500
#: Keys, of 8 bytes each, that may be broadcast.
BROADCAST = 1 << 22
#: Bytes of a block's side in step 3, and what a class takes beside its set; a bucket whose sides fit is one block, and its rows aren't repeated.
SIDE, CLASS = 1 << 22, 1 << 10
#: Pairs whose registers are compared at once, and hashes of sets that are looked up in another at once.
TILE, STRETCH = 1 << 12, 1 << 13
#: For each bucket, the order in which it looks for another to borrow from.
BORROW = np.random.default_rng(7).permuted(np.tile(np.arange(BUCKETS, dtype=np.int16), (BUCKETS, 1)), axis=1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The register of each bucket for sorted hashes; EMPTY where a bucket has none."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    bucket = (hashes >> np.uint64(56)).astype(np.int16)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (hashes[first] & np.uint64((1 << 56) - 1)) >> np.uint64(4)  # 52 bits, exact as doubles
    zeros = (52 - np.frexp(rest.astype(np.float64))[1]).astype(np.uint64)
    mantissa = ((rest << zeros) >> np.uint64(51 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first]] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def filled(table: np.ndarray) -> np.ndarray:
    """Rows of registers with empty ones borrowed; a row that is all empty stays so."""
    out = table.copy()
    row, column = np.nonzero((table == EMPTY) & (table != EMPTY).any(1, keepdims=True))
    step = 0
    while len(row):
        got = table[row, BORROW[column, step]]
        out[row, column] = got
        again = got == EMPTY
        row, column, step = row[again], column[again], step + 1
    return out


def bands(table: np.ndarray) -> np.ndarray:
    """A hash of each band of each row of registers."""
    part = table[:, : ROWS * BANDS].astype(np.uint64).reshape(len(table), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * BASE, part.shape[:2]).copy()
    for i in range(ROWS):
        out = mixed(out * BASE + part[:, :, i])
    return out.view(np.int64)


def chances(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of unlike sets of sizes n and m agree by chance, for each pair of sizes."""
    zeros = np.arange(53)
    scaled = [np.maximum(s, 1)[:, None] / BUCKETS for s in (n, m)]
    share = [np.exp(-s / 2.0 ** (zeros + 1)) - np.exp(-s / 2.0**zeros) for s in scaled]
    return (share[0] * share[1]).sum(1) / 2**MANTISSA


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair from rows of registers of sets of sizes n and m."""
    by_chance = chances(n, m)
    return np.maximum(0.0, ((a == b).mean(1) - by_chance) / (1 - by_chance))


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from the registers of sets of sizes n and m."""
    return float(estimates(a[None], b[None], np.array([n]), np.array([m]))[0])


#: Rows with whole texts, sets or registers that go to Python at once.
WIDE = 1_000
SIGNATURE = "struct<n_shingles:bigint,set_key:binary,registers:binary,bands:array<bigint>>"


def _signed(k: int):
    def few(texts: pa.Array, hasher: Hasher) -> pa.Array:
        sizes, keys, tables = [], [], []
        for t in texts:
            s = hasher.shingles(t.as_py(), k)
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            tables.append(registers(s))
        table = filled(np.stack(tables))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * BANDS), pa.array(bands(table).ravel()))
        binary = pa.array([row.tobytes() for row in table], pa.binary())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), binary, lists], ["n_shingles", "set_key", "registers", "bands"])

    def run(texts: pa.Array) -> pa.Array:
        hasher, empty = Hasher(), pa.array([], pa.struct([("n_shingles", pa.int64()), ("set_key", pa.binary()), ("registers", pa.binary()), ("bands", pa.list_(pa.field("item", pa.int64())))]))
        parts = [few(texts[at : at + STEP], hasher) for at in range(0, len(texts), STEP)]
        return pa.concat_arrays(parts) if parts else empty

    return F.arrow_udf(run, SIGNATURE)


def _estimated():
    def run(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        tables = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, BUCKETS) for x in (a, b))
        return pa.array(estimates(*tables, n.to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False)), pa.float64())

    # A filter on a deterministic one is moved below it and computes it again, with a second Python worker for every task.
    return F.arrow_udf(run, "double").asNondeterministic()


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sets' Jaccard similarity is ``threshold`` or more, in whole hundredths exactly."""
    least, most = sorted((len(a), len(b)))
    hundredths = round(threshold * 100)
    if 100 * least < hundredths * most:
        return False
    return enough(len(a), len(b), overlap(a, b), threshold)


def enough(n: int, m: int, both: int, threshold: float) -> bool:
    """Whether sets of sizes n and m that share ``both`` are linked."""
    return 100 * both >= round(threshold * 100) * (n + m - both)


def _verified(threshold: float):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    return F.arrow_udf(run, "boolean")


def _promising(threshold: float):
    """The classes of a block whose registers and sizes allow a link to a class of another component."""

    def found(key: int, few: list, many: list, told: set):
        for i, j in _near(key, few, many, threshold):
            for x in [*(few[u][0] for u in np.unique(i)), *(many[v][0] for v in np.unique(j))]:
                if x not in told:
                    told.add(x)
                    yield (x,)

    return _over_blocks(found, lambda p: (np.frombuffer(p["registers"], np.uint16), p["n_shingles"]), ("rid",))


def _linking(threshold: float):
    """Links between the minority classes (side 0) and all classes (side 1) of each block, at most one a class and component."""

    def links(key: int, few: list, many: list, told: set):
        for i, j in _near(key, few, many, threshold):
            for own in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
                u, _, _, _, s = few[i[own[0]]]
                partners = [many[v] for v in j[own]]
                for some in _stretches([len(v[4]) for v in partners]):
                    asked = [v for v in partners[some] if (u, v[1]) not in told]
                    for v, both in zip(asked, overlaps(s, [v[4] for v in asked]), strict=True):
                        if (u, v[1]) not in told and enough(len(s), len(v[4]), both, threshold):
                            told.add((u, v[1]))
                            yield u, v[0]

    return _over_blocks(links, lambda p: (np.frombuffer(p["registers"], np.uint16), p["n_shingles"], np.frombuffer(p["shingles"], np.uint64)), ("u", "v"))


def _stretches(sizes: list[int]) -> list[slice]:
    """Sets that are compared with another at once: STRETCH hashes and one set at most."""
    ends = [*(np.flatnonzero(np.diff(np.cumsum(sizes) // STRETCH)) + 1), len(sizes)]
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def _near(key: int, few: list, many: list, threshold: float):
    """Index arrays of the pairs of ``few`` and ``many``, of different components, whose registers and sizes allow a link.

    A pair meets in the bucket of every band that it shares; only the first one's has it.
    """
    (mine, n, comp), (there, m, other) = _stacked(few), _stacked(many)
    my_bands, their_bands = bands(mine), bands(there)
    at = np.nonzero(my_bands == key)[1][:1]  # the bucket's band
    hundredths, step = round(threshold * 100), max(1, TILE // len(many))
    for start in range(0, len(few), step):
        own = slice(start, start + step)
        sizes = 100 * np.minimum(n[own, None], m) >= hundredths * np.maximum(n[own, None], m)
        near = (_equal(mine[own], there) >= BUCKETS * (threshold - SLACK)) & (comp[own, None] != other) & sizes
        i, j = np.nonzero(near)
        if len(at) and len(i):
            first = (my_bands[own][i] == their_bands[j]).argmax(1) == at
            i, j = i[first], j[first]
        yield i + start, j


def _stacked(side: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack([x[2] for x in side]), np.array([x[3] for x in side]), np.array([x[1] for x in side])


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many registers each row of ``a`` has in common with each row of ``b``."""
    return np.bitwise_count(np.packbits(a[:, None] == b, axis=2).view(np.uint64)).sum(2, dtype=np.uint16)


def _over_blocks(compared, opened, names: tuple[str, ...]):
    """Rows come block by block, side 0 first, which is held; side 1 passes by in stretches.

    ``compared`` gets the bucket's key, both sides' (class, component, *opened payload) and a set for what it told of the block before.
    """

    def run(batches):
        at, of, few, told = None, None, [], set()
        for batch in batches:
            out, many = [], []
            for block, key, side, rid, comp, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "side", "rid", "comp", "payload")), strict=True):
                if block != at:
                    out += compared(of, few, many, told) if few and many else ()
                    at, of, few, many, told = block, key, [], [], set()
                (many if side else few).append((rid, comp, *opened(payload)))
            out += compared(of, few, many, told) if few and many else ()
            yield _table(out)

    def _table(rows: list) -> pa.RecordBatch:
        columns = zip(*dict.fromkeys(rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))

    return run


def classes(signed: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(set_key, component): the smallest document reachable from each class of equal sets. Stored."""
    able = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # All documents of a class have the same signature, so any one's will do.
    reps = stored(able.groupBy("set_key").agg(F.min("doc_id").alias("rid"), F.any_value(F.struct("n_shingles", "registers", "bands")).alias("s")).select("set_key", "rid", "s.*"))
    member = reps.select("rid", F.explode("bands").alias("key"))
    seeded = F.struct(F.xxhash64("key", "rid").alias("h"), F.col("rid").alias("leader"))
    buckets = stored(member.groupBy("key").agg(F.count("*").alias("n"), F.min(seeded)["leader"].alias("leader")).where("n > 1"))
    shared = stored(member.join(buckets, "key").select("key", "rid", "leader").distinct())
    regs = reps.select("rid", "n_shingles", "registers")
    side = lambda df, x: df.select(*(F.col(c).alias(f"{c}_{x}") for c in df.columns))
    pairs = shared.where("rid <> leader").select(F.col("rid").alias("u"), F.col("leader").alias("v")).distinct()
    ru, rv = side(regs, "u"), side(regs, "v")
    est = pairs.join(ru, pairs.u == ru.rid_u).join(rv, F.col("v") == rv.rid_v)
    est = est.select("u", "v", _estimated()("registers_u", "registers_v", "n_shingles_u", "n_shingles_v").alias("est")).where(F.col("est") >= threshold - SLACK)
    best = F.slice(F.sort_array(F.collect_list(F.struct("est", "v")), False), 1, LEADERS)  # at most BANDS in the list
    chosen = stored(est.groupBy("u").agg(best.alias("best")).select("u", F.explode("best").alias("b")).select("u", "b.v"), WIDE)
    sets = _sets(texts, chosen.select(F.explode(F.array("u", "v")).alias("rid")), k)
    edges = stored(_check(chosen, sets, threshold), WIDE)
    drop(sets, chosen, buckets)
    several = able.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b").select("doc_id")
    if not several.isEmpty():  # a document of several texts ties their classes
        tied = able.select("doc_id", "set_key").join(several, "doc_id").join(reps.select("set_key", "rid"), "set_key").select(F.col("doc_id").alias("u"), F.col("rid").alias("v"))
        edges = stored(edges.unionAll(tied.where("u <> v").distinct()))
    labels = components(edges)
    more = _minorities(shared, labels, regs, texts, k, threshold)
    if more is not None:
        labels = components(edges.unionAll(more))
    found = stored(reps.select("set_key", "rid").join(labels, F.col("rid") == labels.node, "left").select("set_key", F.coalesce("component", "rid").alias("component")))
    drop(reps, shared, edges, labels)
    return found


def _sets(texts: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(rid, shingles): the full sets of the classes ``rid``. Stored; texts stay where they are while BROADCAST bounds the classes."""
    needed = needed.distinct()
    needed = F.broadcast(needed) if needed.count() <= BROADCAST else needed
    hashed = F.arrow_udf(_hashes(k), "binary")
    found = texts.join(needed, texts.doc_id == needed.rid).select("rid", hashed("text").alias("shingles"))
    return stored(found.groupBy("rid", F.xxhash64("shingles").alias("h")).agg(F.any_value("shingles").alias("shingles")).select("rid", "shingles"), WIDE)


def _hashes(k: int):
    def run(texts: pa.Array) -> pa.Array:
        hasher = Hasher()
        return pa.array([hasher.shingles(t.as_py(), k).tobytes() for t in texts], pa.binary())

    return run


def _check(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose full sets are linked."""
    su = sets.select(F.col("rid").alias("ru"), F.col("shingles").alias("su"))
    sv = sets.select(F.col("rid").alias("rv"), F.col("shingles").alias("sv"))
    both = pairs.join(su, pairs.u == su.ru).join(sv, F.col("v") == sv.rv)
    return both.where(_verified(threshold)("su", "sv")).select("u", "v").distinct()


def _minorities(shared: DataFrame, labels: DataFrame, regs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame | None:
    """Step 3: links across the components of a bucket, stored; None without any."""
    placed = stored(shared.join(labels, shared.rid == labels.node, "left").select("key", "rid", F.coalesce("component", "rid").alias("comp"), F.lit(CLASS).cast("long").alias("bytes")))
    near = stored(_in_blocks(placed, regs.select("rid", F.struct("n_shingles", "registers").alias("payload")), _promising(threshold), "rid bigint"), WIDE)
    if near.isEmpty():
        drop(placed, near)
        return None
    sets = _sets(texts, near, k)
    some = placed.join(near.join(regs.select("rid", "n_shingles"), "rid"), "rid").select("key", "rid", "comp", (F.col("bytes") + 8 * F.col("n_shingles")).alias("bytes"))
    payload = sets.join(regs, "rid").select("rid", F.struct("n_shingles", "registers", "shingles").alias("payload"))
    links = stored(_in_blocks(some, payload, _linking(threshold), "u bigint, v bigint"), WIDE)
    drop(placed, near, sets)
    return links


def _in_blocks(placed: DataFrame, payload: DataFrame, compared, schema: str) -> DataFrame:
    """The distinct rows that ``compared`` finds in the blocks of buckets with several components; ``payload`` has a row or more for each class.

    Both sides are cut by what their classes take, so that a bucket's rows are repeated only where a side goes beyond SIDE.
    """
    sizes = placed.groupBy("key", "comp").agg(F.sum("bytes").alias("n"))
    mixed_ = stored(
        sizes.groupBy(F.col("key").alias("k"))
        .agg(F.sum("n").alias("total"), F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"))
        .where("comps > 1")
        .select("k", F.col("main.comp").alias("main"), F.ceil((F.col("total") - F.col("main.n")) / SIDE).cast("int").alias("fews"), F.ceil(F.col("total") / SIDE).cast("int").alias("manys"))
    )
    rows = placed.join(mixed_, placed.key == mixed_.k)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "rid"), n).cast("int")
    block = F.struct("key", "few", "many").alias("block")
    few = rows.where("comp <> main").select("key", "rid", "comp", mine(F.col("fews"), 1).alias("few"), every(F.col("manys")).alias("many"))
    many = rows.select("key", "rid", "comp", every(F.col("fews")).alias("few"), mine(F.col("manys"), 2).alias("many"))
    blocks = few.select(block, F.lit(0).alias("side"), "rid", "comp").unionAll(many.select(block, F.lit(1).alias("side"), "rid", "comp"))
    carried = blocks.join(payload, "rid").select(F.xxhash64("block.key", "block.few", "block.many").alias("block"), "block.key", "side", "rid", "comp", "payload")
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = carried.repartition(parts, "block").sortWithinPartitions("block", "side", "rid")
    return dealt.mapInArrow(compared, schema).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with n_shingles, component_id and kept (whether the row's key is its component's)."""
    texts = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(texts.select("doc_id", _signed(words)("text").alias("s")).select("doc_id", "s.*"), WIDE)
    found = classes(signed, texts, words, threshold)
    of = signed.select("doc_id", "n_shingles", "set_key").join(found.withColumnRenamed("set_key", "of_set"), F.col("set_key") == F.col("of_set"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    result = of.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))
    if {c.lower() for c in df.columns} <= {key.lower(), text.lower()}:
        return result.withColumnRenamed("doc_id", key)
    return _attached(df, result, key)


def _attached(df: DataFrame, result: DataFrame, key: str) -> DataFrame:
    rest, of = others(df, "n_shingles", "component_id", "kept"), fresh(df, "_of")
    each = result.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(of)).agg(F.min("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = df.select(*rest).join(each, F.col(quoted(key)).cast("long") == F.col(of), "left")
    return out.select(*rest, "n_shingles", "component_id", (F.col(quoted(key)).isNull() | (F.col("component_id") == F.col(quoted(key)))).alias("kept"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that near-deduplication keeps, unchanged, one row a document.

    Of rows that share a key the one with the least text stays; of rows without
    a key and of one text, one stays.
    """
    found, at = near_duplicates(df, key, text), F.col(quoted(key))
    columns = [quoted(c) for c in df.columns]
    kept = found.where("kept").select(*columns)
    again = stored(df.groupBy(at.alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"))
    if again.isEmpty():
        return kept
    same = at.eqNullSafe(F.col("again"))
    row = F.struct(*columns)
    once = kept.join(again, same, "left_semi").groupBy(at, F.when(at.isNull(), F.col(quoted(text)))).agg(F.min_by(row, F.coalesce(F.col(quoted(text)), F.lit(""))).alias("row"))
    return kept.join(again, same, "left_anti").unionAll(once.select("row.*"))


# The classes of two-word shingle sets in SQL, by counting the shingles that any two texts share.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(words) < 2 THEN words ELSE list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1]) END) AS sh FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM shared JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 80 * (nu.n + nv.n - c)
), ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, ways.v FROM reach JOIN ways ON ways.u = reach.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
