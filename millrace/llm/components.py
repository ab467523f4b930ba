"""Connected components of an edge table, by joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import drop, stored

#: Rows of one key that a join may leave together, and hot keys for each shuffle partition at most.
HOT, HOT_KEYS = 512, 4


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v): the smallest node reachable. Stored.

    In each round a node takes the least label among its neighbours' and its
    own, then its label's label; labels only fall, and rounds go with the
    logarithm of a path's length. No node's neighbours are gathered: they meet
    in a minimum that is combined before the shuffle, and the joins deal the
    rows of a hot node or a large component over many tasks (``spread``).

    Defined results: edges to oneself, repeated edges and edges without an end
    change nothing; nodes without other edges don't appear; no edges give no
    rows.
    """
    clean = edges.where("u <> v")
    both = stored(clean.select("u", "v").unionAll(clean.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    n = both.count()
    hot_nodes = _hot(both, "v", n)
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("component")))
    while True:
        near = spread(both, "v", labels, "node", hot_nodes).groupBy(F.col("u").alias("at")).agg(F.min("component").alias("near"))
        lower = stored(labels.join(near, labels.node == near.at).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")))
        if lower.where("was <> component").isEmpty():
            drop(both, lower)
            return labels
        roots = lower.select(F.col("node").alias("root"), F.col("component").alias("further"))
        further = spread(lower, "component", roots, "root", _hot(lower, "component", n)).select("node", F.col("further").alias("component"))
        before, labels = labels, stored(further)
        drop(before, lower)


def _hot(rows: DataFrame, key: str, n: int) -> DataFrame | None:
    """(hot, parts) for the keys with too many rows, HOT_KEYS for each shuffle partition at most, and the parts to deal them in; None without any."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(HOT, n // (HOT_KEYS * parts))
    hot = rows.groupBy(F.col(key).alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    found = hot.select("hot", F.ceil(F.col("n") / most).cast("int").alias("parts")).collect()  # HOT_KEYS bounds them
    # As an Arrow table, which no Python worker reads.
    table = pa.table({"hot": pa.array([r.hot for r in found], pa.int64()), "parts": pa.array([r.parts for r in found], pa.int32())})
    return rows.sparkSession.createDataFrame(table) if found else None


def spread(rows: DataFrame, key: str, unique: DataFrame, other: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` joined on ``key`` to the one row of ``unique`` that has it as ``other``; rows of hot keys are dealt over parts, each with its copy of that row."""
    if hot is None:
        return rows.join(unique, rows[key] == unique[other])
    rest = [c for c in rows.columns if c != key]
    hot = F.broadcast(hot)
    dealt = rows.join(hot, rows[key] == hot.hot, "left").select(*rows.columns, F.pmod(F.xxhash64(*rest), F.coalesce("parts", F.lit(1))).alias("part"))
    copies = unique.join(hot, unique[other] == hot.hot, "left").select(*unique.columns, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("of_part"))
    return dealt.join(copies, (F.col(key) == F.col(other)) & (F.col("part") == F.col("of_part"))).drop("part", "of_part")
