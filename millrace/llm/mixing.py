"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Words are dealt in equal blocks. Sources get whole blocks by the highest
quotients target / (2k + 1); each source's blocks go to its shards (hash
fractions of its documents) by the same rule on their sizes; in a shard the
blocks lie along its documents in a seeded order, and the quota takes them from
the start, in up to ``MAX_REPEATS`` passes.

No block is ever a row: seats that every divisor in question grants are
computed, and only the at most two a party that the last seats hang on are
ranked (``apportion``).

Defined results: a null text has size 0 and takes 0; a null source is a source
of its own, after all others; repeated rows are documents of their own, and
which of them is taken first doesn't show; texts of any length are counted whole
and may be cut after any word; an empty table gives an empty result; other
columns are carried along, and a column whose name is one of the result's is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.text import WORD, n_words, others, prefix, quoted, stored

#: Words in a block.
BLOCK = 16
#: Documents of a shard, about, and shards of a source at most. A shard cuts one document at most, and hot sources have many.
SHARD_ROWS, MOST_SHARDS = 512, 65_536
#: How often a document is taken at most.
MAX_REPEATS = 3
SEED = 17
#: Weights of the sources by their rank, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the total shared by weight under caps.

    A source stops at ``repeats`` times its size and the rest is reshared. Let
    sources stand by cap / weight; those before some place are capped, and the
    others get an equal share of the rest for each unit of weight. The place is
    the first whose cap isn't below that share. One row for each source; the
    windows here hold sources, never documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * repeats).cast("double")
    by_need = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_need.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    return (
        sizes.select("source", "source_size", weight.alias("weight"), cap.alias("cap"))
        .withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("share", F.col("rest") / F.col("open"))
        .withColumn("place", F.row_number().over(by_need))
        .withColumn("level", F.min(F.when(F.col("cap") >= F.col("weight") * F.col("share"), F.struct("place", "share"))).over(every)["share"])
        .select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))
    )


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, most: str) -> DataFrame:
    """``parties`` with ``quota``: the group's ``seats`` by Sainte-Laguë on ``votes``, at most ``most`` for each.

    With divisor d a party has floor(votes / d + 1/2) seats. For p parties,
    d = total / (seats - p/2) grants no seat too many and d = total / (seats +
    p/2) none too few, so only the quotients between, two a party on average,
    are ranked. Ties go to the lesser party. Seats beyond ``most`` aren't given.
    """
    all_ = W.partitionBy(*group)
    within = lambda d: F.floor(F.col(votes) / d + 0.5).cast("long")
    base = (
        parties.withColumn("_v", F.sum(votes).over(all_))
        .withColumn("_p", F.count(F.lit(1)).over(all_) / 2.0)
        .withColumn("_sure", F.when((F.col(seats) > F.col("_p")) & (F.col("_v") > 0), within(F.col("_v") / (F.col(seats) - F.col("_p")))).otherwise(F.lit(0).cast("long")))
        .withColumn("_may", F.when(F.col("_v") > 0, within(F.col("_v") / (F.col(seats) + F.col("_p"))) + 1).otherwise(F.lit(0).cast("long")))
        .withColumn("_left", F.col(seats) - F.sum("_sure").over(all_))
    )
    ks = F.when(F.col("_may") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_may") - 1)).otherwise(F.array().cast("array<bigint>"))
    ranked = (
        base.select(*group, party, votes, "_left", F.explode(ks).alias("_k"))
        .withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("_k") + 1)), F.col(party).asc_nulls_last(), "_k")))
        .where("_r <= _left")
    )
    more = ranked.groupBy(*group, party).agg(F.count("*").alias("_more"))
    renamed = more.select(*(F.col(c).alias(f"_g{n}") for n, c in enumerate([*group, party])), "_more")
    same = F.lit(True)
    for n, c in enumerate([*group, party]):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{n}"))
    quota = F.least(F.col("_sure") + F.coalesce("_more", F.lit(0)), F.col(most))
    return base.join(renamed, same, "left").select(*parties.columns, quota.alias("quota"))


def seeded(key: Column, seed: int) -> Column:
    """60 bits of the md5 of seed and key, which any engine can make."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED, weights=WEIGHTS, repeats: int = MAX_REPEATS,
) -> DataFrame:
    """``df`` with size, source_size, target and taken. Words are counted once, in a stored table of keys, sources and sizes."""
    p = prefix(df)
    at_key, at_source = F.col(quoted(key)), F.col(quoted(source))
    lean = stored(df.select(at_key.alias("key"), at_source.alias("source"), n_words(F.col(quoted(text))).alias("size")))
    # A row for each source; whether it is small enough to broadcast is for Spark to see.
    split = lean.groupBy(F.col("source").alias("split")).agg(F.least(F.lit(MOST_SHARDS), F.ceil(F.count("*") / shard_rows)).cast("long").alias("shards"))
    sharded = lean.join(split, F.col("source").eqNullSafe(F.col("split")))
    sized = sharded.select("source", "size", F.pmod(seeded(F.col("key"), seed), F.col("shards")).alias("shard"))
    blocks = lambda words: F.ceil(words * repeats / block).cast("long")
    shard = stored(sized.groupBy("source", F.col("shard").alias("_shard")).agg(F.sum("size").alias("_shard_size")))
    per_source = targets(shard.groupBy("source").agg(F.sum("_shard_size").alias("source_size")), weights, repeats)
    seats = (
        apportion(
            per_source.withColumn("_seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")).withColumn("_most", blocks(F.col("source_size"))),
            [], "source", "target", "_seats", "_most",
        )
        .select(F.col("source").alias("_of"), "source_size", "target", F.col("quota").alias("_seats"))
    )
    quotas = (
        apportion(
            shard.join(seats, F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("_votes", F.col("_shard_size").cast("double")).withColumn("_most", blocks(F.col("_shard_size"))),
            ["source"], "_shard", "_votes", "_seats", "_most",
        )
        .select(F.col("source").alias(f"{p}of"), F.col("_shard").alias(f"{p}s"), F.col("source_size").alias(f"{p}whole"), F.col("target").alias(f"{p}target"), F.col("_shard_size").alias(f"{p}part"), (F.col("quota") * block).alias(f"{p}words"))
    )
    rest, mine = others(df, "size", "source_size", "target", "taken"), lambda c: F.col(p + c)
    shards = split.select(F.col("split").alias(f"{p}split"), F.col("shards").alias(f"{p}shards"))
    counted = df.select(*rest, at_key.alias(f"{p}key"), at_source.alias(f"{p}source"), n_words(F.col(quoted(text))).alias(f"{p}size"))
    dealt = counted.join(shards, mine("source").eqNullSafe(mine("split"))).withColumn(f"{p}shard", F.pmod(seeded(mine("key"), seed), mine("shards")))
    order = W.partitionBy(f"{p}source", f"{p}shard").orderBy(seeded(mine("key"), seed + 1), f"{p}key", f"{p}size").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn(f"{p}end", F.sum(f"{p}size").over(order))
    joined = placed.join(quotas, mine("source").eqNullSafe(mine("of")) & (mine("shard") == mine("s")), "left")
    passes = F.least(F.lit(repeats), F.floor(mine("words") / mine("part")))
    over = F.when(passes < repeats, mine("words") - passes * mine("part")).otherwise(F.lit(0))
    part = F.least(mine("size"), F.greatest(F.lit(0), over - (mine("end") - mine("size"))))
    taken = F.when(mine("size") > 0, passes * mine("size") + part).otherwise(F.lit(0))
    return joined.select(*rest, mine("size").alias("size"), mine("whole").alias("source_size"), mine("target").alias("target"), taken.cast("long").alias("taken"))


def materialize(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The documents that a mix takes: a row for each whole repeat, and one cut after the words taken from a last, partial one.

    A null or empty text takes nothing and isn't there; equal rows are each
    there as often as they are taken.
    """
    columns, turn = others(mixed, "size", "source_size", "target", "taken"), F.col(prefix(mixed) + "turn")
    whole = F.floor(F.col("taken") / F.col("size"))
    part = F.col("taken") - whole * F.col("size")
    turns = F.sequence(F.lit(1).cast("long"), whole + F.when(part > 0, 1).otherwise(0))
    out = mixed.where("taken > 0").select("*", F.explode(turns).alias(prefix(mixed) + "turn"))
    begun = F.array_join(F.slice(F.regexp_extract_all(F.col(quoted(text)), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, part.cast("int")), "")
    cut = F.when(turn <= whole, F.col(quoted(text))).otherwise(begun)
    return out.select(*(cut.alias(text) if c == quoted(text) else F.col(c) for c in columns))


# The same mix in SQL, by ranking every block's quotient.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 15))::BIGINT AS h, ('0x' || substr(md5('{SEED + 1}:' || doc_id::VARCHAR), 1, 15))::BIGINT AS o FROM documents
), k AS (
  SELECT source, least({MOST_SHARDS}, ceil(count(*) / {SHARD_ROWS}.0))::BIGINT AS shards, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS w, ({MAX_REPEATS} * source_size)::DOUBLE AS cap FROM k
), f AS (
  SELECT *, row_number() OVER need AS place, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open
  FROM r WINDOW need AS (ORDER BY cap / w, source NULLS LAST), before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(rest / open, place) FILTER (cap >= w * (rest / open)) AS level FROM f
), t AS (
  SELECT source, shards, source_size, least(cap, coalesce(w * level, cap)) AS target FROM f, l
), all_seats AS (
  SELECT round(sum(target) / {BLOCK})::BIGINT AS n FROM t
), sq AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS place
  FROM (SELECT source, target, unnest(generate_series(0, (source_size * {MAX_REPEATS} / {BLOCK})::BIGINT + 2)) AS k FROM t)
), s AS (
  SELECT t.source, t.source_size, t.target, least((SELECT count(*) FROM sq, all_seats WHERE sq.source IS NOT DISTINCT FROM t.source AND place <= n), ceil(source_size * {MAX_REPEATS} / {BLOCK}.0)::BIGINT) AS seats FROM t
), h AS (
  SELECT d.source, h % shards AS shard, sum(size)::BIGINT AS shard_size FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source GROUP BY ALL
), hq AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
  FROM (SELECT source, shard, shard_size, unnest(generate_series(0, (shard_size * {MAX_REPEATS} / {BLOCK})::BIGINT + 2)) AS k FROM h WHERE shard_size > 0)
), hn AS (
  SELECT hq.source, hq.shard, count(*) AS n FROM hq JOIN s ON hq.source IS NOT DISTINCT FROM s.source WHERE hq.place <= s.seats GROUP BY hq.source, hq.shard
), q AS (
  SELECT h.source, h.shard, h.shard_size, s.source_size, s.target, {BLOCK} * least(coalesce(hn.n, 0), ceil(h.shard_size * {MAX_REPEATS} / {BLOCK}.0)::BIGINT) AS words
  FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source LEFT JOIN hn ON hn.source IS NOT DISTINCT FROM h.source AND hn.shard = h.shard
), p AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, least({MAX_REPEATS}, words // nullif(shard_size, 0)) AS passes, words, shard_size, sum(size) OVER (PARTITION BY d.source, h % shards ORDER BY o, d.doc_id, size ROWS UNBOUNDED PRECEDING) - size AS begun
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN q ON q.source IS NOT DISTINCT FROM d.source AND q.shard = h % k.shards
)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN passes * size + least(size, greatest(0, CASE WHEN passes < {MAX_REPEATS} THEN words - passes * shard_size ELSE 0 END - begun)) ELSE 0 END::BIGINT AS taken FROM p
"""
