"""A Merkle manifest of a table, with proofs looked up by coordinates.

Each row is a leaf; the leaves of a group make a binary tree, and the trees'
roots make another, whose root stands for the table. A node is known by its
tree, level and place, so a leaf's siblings follow from its place and its tree's
size alone: proofs explode these coordinates, join the stored nodes and put
them in order.

Trees are built and proved in tiers of ``BITS`` levels. A block of 2**BITS
neighbours is one row, hashed level by level; its root is one unit of the next
tier. A leaf explodes the coordinates inside its block only, and the block's
root those of the tier above, once for all its leaves. So no node is looked up
by more than 2**BITS rows, however large the tree, and the number of tiers
grows with the logarithm of the table.

Defined results: missing values are ``-`` and count as any other; rows without
a key come first in their group, and rows of one key go by their leaf, so
repeated rows are leaves of their own; texts of any length are hashed whole; a
group of one row has its leaf as root; an empty table has no root and gives no
rows. Columns that aren't among the fields are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ordering import places
from millrace.llm.text import quoted, stored

#: Levels of a tier; a block has 2**BITS nodes at most.
BITS = 8
WIDTH = 1 << BITS
#: A step of a path: the sibling's digest (null: the node is alone and hashed by itself), and whether it stands on the left.
STEPS = "array<struct<level:int,left:boolean,digest:string>>"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields' length-prefixed values."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def _parents(nodes: Column) -> Column:
    """Digests of two neighbours each; the last may be alone."""
    pair = lambda n: F.sha2(F.concat(F.get(nodes, 2 * n), F.coalesce(F.get(nodes, 2 * n + 1), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def _depth(of: Column) -> Column:
    """Levels of a tier above its units: up to the root of a tree that ends here, else all of the tier."""
    return F.least(F.length(F.bin(of - 1)) - (of == 1).cast("int"), F.lit(BITS))


def _power(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), exponent)


@dataclass
class Forest:
    """The stored blocks of each tier: tree, block, of (units of the tree in this tier), and the digests of each level."""

    tiers: list[DataFrame]

    def units(self, tier: int) -> DataFrame:
        """(tree, place, of): what a tier's blocks are made of, above the leaves."""
        below = self.tiers[tier - 1].where(F.col("of") > WIDTH)
        return below.select("tree", F.col("block").alias("place"), F.ceil(F.col("of") / WIDTH).alias("of"))

    def nodes(self, tier: int) -> DataFrame:
        """(tree, level, place, digest): the nodes of a tier that have a parent in it."""
        levels = F.posexplode(F.array(*(F.when(F.lit(k) < _depth(F.col("of")), F.col(f"level{k}")) for k in range(BITS))))
        each = self.tiers[tier].select("tree", "block", levels.alias("level", "digests")).where("digests IS NOT NULL")
        each = each.select("tree", "block", "level", F.posexplode("digests").alias("at", "digest"))
        place = F.col("block") * _power(F.lit(BITS) - F.col("level")) + F.col("at")
        return each.select("tree", "level", place.alias("place"), "digest")

    def roots(self) -> DataFrame:
        """(tree, root) of every tree."""
        parts = [t.where(F.col("of") <= WIDTH).select("tree", F.col("root").alias("root")) for t in self.tiers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out


def grow(units: DataFrame) -> Forest:
    """Trees from their units: tree, place, of, digest."""
    largest = units.agg(F.max("of").alias("n")).first()["n"] or 0
    tiers: list[DataFrame] = []
    while not tiers or largest > WIDTH:
        if tiers:
            below = tiers[-1].where(F.col("of") > WIDTH)
            units = below.select("tree", F.col("block").alias("place"), F.ceil(F.col("of") / WIDTH).alias("of"), F.col("root").alias("digest"))
            largest = -(-largest // WIDTH)
        # One row a block: of at most WIDTH digests.
        block = F.shiftright("place", BITS).alias("block")
        rows = units.groupBy("tree", block).agg(F.max("of").alias("of"), F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("_units"))
        rows = rows.select("tree", "block", "of", F.transform("_units", lambda u: u["digest"]).alias("level0"))
        for k in range(BITS):
            rows = rows.withColumn(f"level{k + 1}", F.when(F.lit(k) < _depth(F.col("of")), _parents(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
        tiers.append(stored(rows.select("tree", "block", "of", *(f"level{k}" for k in range(BITS)), F.get(f"level{BITS}", F.lit(0)).alias("root"))))
    return Forest(tiers)


def _steps(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, place, steps) of units (tree, place, of) within their blocks."""
    level = F.explode_outer(F.when(_depth(F.col("of")) > 0, F.sequence(F.lit(0), _depth(F.col("of")) - 1)))
    each = units.select("tree", "place", "of", level.alias("level"))
    power = _power(F.col("level"))
    own = F.floor(F.col("place") / power)
    other = own.bitwiseXOR(F.lit(1).cast("long"))
    needed = each.select("tree", "place", "level", (other < own).alias("left"), F.when(other < F.ceil(F.col("of") / power), other).alias("sibling"))
    found = nodes.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("place").alias("_place"), "digest")
    same = (F.col("tree") == F.col("_tree")) & (F.col("level") == F.col("_level")) & (F.col("sibling") == F.col("_place"))
    step = F.when(F.col("level").isNotNull(), F.struct("level", "left", "digest"))  # collect_list leaves nulls out
    return needed.join(found, same, "left").groupBy("tree", "place").agg(F.sort_array(F.collect_list(step)).alias("steps"))


def _above(steps: DataFrame, tails: DataFrame, carried: list[str]) -> DataFrame:
    """Paths inside blocks, continued by their blocks' own."""
    tail = tails.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), F.col("steps").alias("_rest"), *carried)
    on = (F.col("tree") == F.col("_tree")) & (F.shiftright("place", BITS) == F.col("_block"))
    return steps.join(tail, on).select("tree", "place", F.concat("steps", "_rest").alias("steps"), *carried)


def prove(forest: Forest, leaves: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, place, steps, ...) of leaves (tree, place, of); ``above`` has steps beyond each tree's root, and what else is to be carried."""
    carried = [c for c in above.columns if c not in ("tree", "steps")]
    tails = None
    for tier in range(len(forest.tiers) - 1, -1, -1):
        last = forest.tiers[tier].where(F.col("of") <= WIDTH).select("tree", "block").join(above, "tree").select("tree", "block", "steps", *carried)
        if tails is None:
            tails = last
        else:
            inner = _above(_steps(forest.units(tier + 1), forest.nodes(tier + 1)), tails, carried)
            tails = last.unionAll(inner.withColumnRenamed("place", "block"))
    return _above(_steps(leaves, forest.nodes(0)), stored(tails), carried)


def manifest(df: DataFrame, fields: list[str], key: str = "doc_id", by: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """(key, by, leaf, subroot, root, steps) of each row, and what ``carry`` makes of it.

    Leaves hash ``fields`` and ascend by ``key`` within ``by``; groups go by UTF-8 bytes, the missing one first.
    """
    carry = carry or {}
    # A tree's name: '' for the missing group, which sorts before '=' and any value's bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col(quoted(by)).cast("string")), F.lit(""))
    lean = df.select(F.col(quoted(key)).alias("key"), tree.alias("tree"), leaf([F.col(quoted(f)) for f in fields]).alias("digest"), *(c.alias(f"carry{n}") for n, c in enumerate(carry.values())))
    leaves = stored(places(lean, ["tree"], ["key", "digest"]))
    groups = grow(leaves)
    roots = places(groups.roots().select(F.lit("").alias("all"), "tree", F.col("root").alias("digest")), ["all"], ["tree"])
    roots = stored(roots.select(F.col("all").alias("tree"), F.col("tree").alias("group"), "digest", "place", "of"))
    whole = grow(roots)
    top = prove(whole, roots, whole.roots().select("tree", F.array().cast(STEPS).alias("steps"), "root"))
    named = roots.select(F.col("group").alias("_group"), F.col("digest").alias("subroot"), F.col("place").alias("_place"))
    above = stored(top.join(named, F.col("place") == F.col("_place")).select(F.col("_group").alias("tree"), "steps", "subroot", "root"))
    proofs = prove(groups, leaves, above)
    mine = leaves.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), "key", F.col("digest").alias("leaf"), *(f"carry{n}" for n in range(len(carry))))
    joined = mine.join(proofs, (F.col("_tree") == F.col("tree")) & (F.col("_place") == F.col("place")))
    group = F.when(F.col("_tree") != "", F.substring("_tree", 2, 1 << 30)).cast(df.schema[by].dataType)
    return joined.select(F.col("key").alias(key), group.alias(by), "leaf", "subroot", "root", "steps", *(F.col(f"carry{n}").alias(c) for n, c in enumerate(carry)))


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    up = lambda node, s: F.sha2(F.when(s["digest"].isNull(), node).when(s["left"], F.concat(s["digest"], node)).otherwise(F.concat(node, s["digest"])), 256)
    return F.aggregate(steps, digest, up)


def siblings_digest(steps: Column) -> Column:
    """SHA-256 of the siblings' digests, from the leaf's to the root's."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: s["digest"]), ""), 256)
