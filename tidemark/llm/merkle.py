"""A Merkle manifest of a table: digests of rows, of runs of rows within each group, and of the groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import with_group_places, with_places
from .shared import cut

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the values one after another: - for null, else its UTF-8 byte count, a colon and the value."""
    texts = [c.cast("string") for c in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level from the row to the root, each level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf leads to with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


@dataclass
class Manifest:
    """nodes: a row per node, proofs: a row per row of the table; merkle_manifest says with which columns."""

    nodes: DataFrame
    proofs: DataFrame


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> Manifest:
    """Builds the digests of docs and every row's proof.

    A row's leaf is leaf_digest of its fields. In a group the leaves stand in order of id; while there are several nodes,
    each fanout of them in a row (the last run may be shorter, even one) become the SHA-256 of their digests. What is left
    is the group's subroot, which is the leaf itself for a single row. The subroots, in order of the groups' UTF-8 bytes
    with the null group first, become the root in the same way.

    A level is one aggregation: the children of a node are spread over fanout columns by their slot. Joining those columns
    gives the node, leaving out a slot's own column gives its siblings. Levels are written once; the way down joins every
    level with the one above it, so a level's siblings are made once for all rows below them. Groups that have come to
    their subroot leave the rounds. Places come from range partitions of (group, id, leaf), so a group of any size is split.

    proofs has the id column, the columns of carry (expressions over docs), leaf, subroot, root and path, an array of
    (before, after) from the row to the root: the digests of the siblings to the left and to the right, one after another.
    nodes has group, level (0 for leaves; levels of groups and those above the subroots are told apart by over_groups),
    place and digest.

    A null id is a value like another and comes first; rows of equal ids go by leaf, and rows that are equal in all fields
    have equal leaves, each with a place of its own. Null fields are told apart from empty ones. Values count as Spark
    casts them to text. An empty table has no nodes and no proofs. Columns that aren't fields are not read.
    """
    carry = carry or {}
    own = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(
        F.when(own.isNull(), "").otherwise(F.concat(F.lit("+"), own)).alias("tree"), F.col(f"`{id_col}`").alias("id"),
        leaf_digest([F.col(f"`{c}`") for c in fields]).alias("node"), F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("carried"),
    )
    levels = _climb(with_group_places(cut(rows, "leaves"), "tree", ("id", "node")), fanout, ("node", "id", "carried"))
    subroots = cut(_tops(levels), "subroots")
    over = with_places(subroots, ("tree",)).select(F.lit("").alias("tree"), "place", "node", F.col("tree").alias("group"))
    over_levels = _climb(over, fanout, ("node", "group"))
    none = F.array().cast("array<struct<before: string, after: string>>")
    root = _tops(over_levels).select("tree", F.col("node").alias("root"), none.alias("path"))
    groups = _descend(over_levels, root, fanout).select(F.col("child.group").alias("tree"), F.col("child.node").alias("subroot"), "root", "path")
    proofs = _descend(levels, cut(groups, "group-paths"), fanout)
    proofs = proofs.select(F.col("child.id").alias(id_col), *[F.col(f"child.carried.{n}").alias(n) for n in carry], F.col("child.node").alias("leaf"), "subroot", "root", "path")
    return Manifest(_nodes(levels, False, fanout).unionByName(_nodes(over_levels, True, fanout)), proofs)


#: A node without siblings at place 0 has none at all: it is its tree's top and isn't hashed again.
_LONE = "place = 0 AND c1 IS NULL"


def _climb(nodes: DataFrame, fanout: int, payload: Sequence[str]) -> list[DataFrame]:
    """The levels over nodes (tree, place, node and payload columns): tree, place and children c0, c1, ... as structs."""
    levels = []
    child = F.struct(*payload)
    while True:
        slots = [F.first(F.when(F.pmod("place", F.lit(fanout)) == k, child), ignorenulls=True).alias(f"c{k}") for k in range(fanout)]
        level = cut(nodes.groupBy("tree", F.floor(F.col("place") / fanout).alias("place")).agg(*slots), "level")
        levels.append(level)
        parents = level.where(f"NOT ({_LONE})")
        if parents.isEmpty():
            return levels
        nodes = parents.select("tree", "place", F.sha2(F.concat_ws("", *[f"c{k}.node" for k in range(fanout)]), 256).alias("node"))
        child = F.struct("node")


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, node): the last node of each tree, at whatever level that is."""
    tops = [level.where(_LONE).select("tree", "c0.node") for level in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """A row per node of the lowest level: child (its payload), path, and the columns of tops (tree, path and more)."""
    given = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for k in reversed(range(len(levels))):
        lone = levels[k].where(_LONE).join(tops, "tree").select("tree", "place", *given, F.col("c0").alias("child"), "path")
        if above is None:
            found = lone
        else:
            slots = []
            for j in range(fanout):
                side = F.struct(F.concat_ws("", *[f"c{i}.node" for i in range(j)]).alias("before"), F.concat_ws("", *[f"c{i}.node" for i in range(j + 1, fanout)]).alias("after"))
                slots.append(F.when(F.col(f"c{j}").isNotNull(), F.struct((F.col("place") * fanout + j).alias("at"), F.col(f"c{j}").alias("child"), side.alias("side"))))
            parents = levels[k].where(f"NOT ({_LONE})").join(above, ["tree", "place"])
            children = parents.select("tree", *given, "path", F.explode(F.array_compact(F.array(*slots))).alias("x"))
            children = children.select("tree", F.col("x.at").alias("place"), *given, F.col("x.child").alias("child"), F.concat(F.array("x.side"), "path").alias("path"))
            found = lone.unionByName(children)
        above = cut(found.drop("child"), "paths") if k else None
    return found


def _nodes(levels: list[DataFrame], over_groups: bool, fanout: int) -> DataFrame:
    out = None
    for k, level in enumerate(levels):
        children = F.explode(F.array_compact(F.array(*[F.when(F.col(f"c{j}").isNotNull(), F.struct((F.col("place") * fanout + j).alias("place"), F.col(f"c{j}.node").alias("digest"))) for j in range(fanout)])))
        group = F.lit(None).cast("string") if over_groups else F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1))
        rows = level.select(group.alias("group"), F.lit(over_groups).alias("over_groups"), F.lit(k).alias("level"), children.alias("x")).select("group", "over_groups", "level", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out
