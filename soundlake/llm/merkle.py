"""A manifest of a table as a tree of hashes per group, with a proof for every row; joins of Spark only.

A row's leaf is the hash of its fields.  The leaves of a group ascend by key; their places come from one range sort, whose
partitions are counted, so that a group may hold most rows.  Level by level, every node is joined with its siblings by
their computed places (exclusive or with one in runs of two, slot offsets in longer runs), and the rows in slot zero emit
the parents.  The groups' roots are the leaves of one more tree of the same kind.  On the way down each node passes its
own siblings and its parent's path to its children, so all paths together cost twice the last level, not a join per level
of every leaf.  Each level is a written table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundlake.llm.common import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:binary,after:binary>>"


def leaf_digest(fields: list[Column]) -> Column:
    """Hex hash of the fields, each ``-`` if null, else its length in bytes, a colon and its text."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _hash(digests: Column) -> Column:
    """Binary hash of digests (binary, concatenated), which are hashed as hex text."""
    return F.unhex(F.sha2(_hex(digests).cast("binary"), 256))


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that ``leaf`` (hex) and a path lead to."""
    return F.aggregate(path, leaf, lambda now, step: F.sha2(F.concat(_hex(step["before"]), now, _hex(step["after"])).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """Hex hash of all siblings of a path, level by level, left to right."""
    empty = F.lit(b"")
    return F.sha2(_hex(F.aggregate(path, empty, lambda now, step: F.concat(now, step["before"], step["after"]))).cast("binary"), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with grp (number of the row's group, by rising ``_group``, null first), idx (place in it) and n (rows of it)."""
    ranged = rows.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
    fixed = cut(ranged.withColumn("_m", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_part", F.shiftright("_m", 33))
    runs = cut(fixed.groupBy("_part", "_group").agg(F.min("_m").alias("_first"), F.count("*").alias("_rows")))
    groups = runs.groupBy("_group").agg(F.sum("_rows").alias("n"))
    ranged = groups.repartitionByRange("_group").sortWithinPartitions("_group")
    groups = cut(ranged.withColumn("_m", F.monotonically_increasing_id()).withColumn("_gpart", F.shiftright("_m", 33)))
    # one row per partition of the groups
    before = Window.orderBy("_gpart").rowsBetween(Window.unboundedPreceding, -1)
    sizes = groups.groupBy("_gpart").agg(F.count("*").alias("_size")).select("_gpart", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_ahead"))
    groups = groups.join(F.broadcast(sizes), "_gpart").select("_group", "n", (F.col("_ahead") + F.col("_m") - F.shiftleft("_gpart", 33)).alias("grp"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_earlier", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    runs = cut(runs.join(groups, runs["_group"].eqNullSafe(groups["_group"])).select("_part", "_first", "_earlier", "n", "grp", runs["_group"]))
    # the partition is in the key, so no group is a hot one
    same = (fixed["_part"] == runs["_part"]) & fixed["_group"].eqNullSafe(runs["_group"])
    return fixed.join(runs, same).select(*[fixed[c] for c in rows.columns if c != "_group"], "grp", "n", (F.col("_m") - F.col("_first") + F.col("_earlier")).alias("idx"))


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with before and after: the digests of the run's other nodes, concatenated."""
    slot = F.col("idx") % fanout
    out = nodes
    for k in range(1, fanout):
        there = F.expr("idx ^ 1") if fanout == 2 else F.col("idx") - slot + (slot + k) % fanout
        other = nodes.select(F.col("grp"), F.col("idx").alias("_there"), F.col("digest").alias(f"_s{k}"))
        out = out.withColumn("_there", there).join(other, ["grp", "_there"], "left").drop("_there")
    sibling = [F.coalesce(F.col(f"_s{k}"), F.lit(b"")) for k in range(1, fanout)]
    # slot + k wraps around: what wrapped stands before the node
    wrapped = [F.when(slot + k >= fanout, s).otherwise(F.lit(b"")) for k, s in enumerate(sibling, 1)]
    ahead = [F.when(slot + k < fanout, s).otherwise(F.lit(b"")) for k, s in enumerate(sibling, 1)]
    return out.withColumn("before", F.concat(*wrapped)).withColumn("after", F.concat(*ahead)).drop(*[f"_s{k}" for k in range(1, fanout)])


def _levels(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], set[int]]:
    """Tables of nodes (grp, idx, n nodes of its group, digest, before, after; leaves keep their columns), leaves first, until
    each group has one node; and the levels at which some group has come to its one node (at most 64 numbers)."""
    heights = set(leaves.agg(F.collect_set(_height(F.col("n"), fanout))).first()[0])
    found, nodes = [], leaves
    for level in range(max(heights, default=0) + 1):
        if level:
            nodes = nodes.where((F.col("n") > 1) & (F.col("idx") % fanout == 0)).select(
                "grp", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), _hash(F.concat("digest", "after")).alias("digest"))
        nodes = cut(_with_siblings(nodes, fanout))
        found.append(nodes)
    return found, heights


def _height(n: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree with ``n`` of them."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, fanout)))


def _paths(levels: list[DataFrame], heights: set[int], tops: DataFrame, fanout: int) -> DataFrame:
    """The leaves with what ``tops`` (grp, top, path: one row per group) holds of their group, the path begun at the leaf."""
    above = None
    for level in reversed(range(len(levels))):
        nodes, parts = levels[level], []
        if level in heights or not heights:
            parts.append(nodes.where("n = 1").join(tops, "grp").drop("before", "after"))
        if above is not None:
            step = F.array(F.struct("before", "after"))
            parents = above.select("grp", F.col("idx").alias("_up"), "top", "path")
            below = nodes.where("n > 1").withColumn("_up", F.floor(F.col("idx") / fanout)).join(parents, ["grp", "_up"])
            below = below.withColumn("path", F.concat(step, "path")).drop("_up", "before", "after")
            parts.append(below.select(*parts[0].columns) if parts else below)
        above = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        above = cut(above) if level else above
    return above


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, fanout: int = 2,
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs`` (runs of ``fanout``, 2 to 36 nodes): ``key``, leaf, subroot, root (hex) and path (siblings before and after, leaf to root).

    With ``tampered`` (changed fields) also tampered_leaf.  Leaves of a group ascend by ``key`` (null first), then by leaf, so
    repeated rows each keep a place; groups ascend bytewise, null first.  A group of one is its own subroot, a single
    subroot the root; an empty table gives no rows.  Nulls count as ``-``; other columns, whatever their names, play no part.
    """
    now = {c: F.col(c) for c in fields}
    changed = [leaf_digest([(tampered or {}).get(c, v) for c, v in now.items()]).alias("tampered_leaf")]
    rows = docs.select(F.col(group).cast("string").alias("_group"), F.col(key).alias("_key"),
                       F.unhex(leaf_digest(list(now.values()))).alias("digest"), *(changed if tampered else []))
    placed = _placed(cut(rows), ["_key", "digest", *(["tampered_leaf"] if tampered else [])])
    trees, heights = _levels(cut(placed), fanout)
    ends = [trees[k].where("n = 1").select("grp", "digest") for k in sorted(heights) or [0]]
    subroots = cut(reduce(DataFrame.unionByName, ends))
    count = F.lit(subroots.count()).cast("long")
    upper, height = _levels(cut(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), count.alias("n"), "digest")), fanout)
    root = upper[-1].where("n = 1").select("grp", F.col("digest").alias("top"), F.array().cast(PATH).alias("path"))
    ends = _paths(upper, height, root, fanout)
    tops = cut(ends.select(F.col("idx").alias("grp"), F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top"), "path"))
    leaves = _paths(trees, heights, tops, fanout)
    return leaves.select(F.col("_key").alias(key), _hex(F.col("digest")).alias("leaf"), *(["tampered_leaf"] if tampered else []),
                         _hex(F.col("top.subroot")).alias("subroot"), _hex(F.col("top.root")).alias("root"), "path")


def tamper_check(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """Every row's proof against a copy in which n_chars is one more where 7 divides crc32 of the id's decimal text.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.  A null id is never tampered with; a null n_chars stays.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(hit, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars").cast("decimal(38,0)"))
    found = manifest(docs, fanout=fanout, tampered={"n_chars": changed})
    folded = fold(F.col("tampered_leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
