"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard, results merged.

Nearness is the largest inner product.  Vectors get one more component, the root of what their squared norm lacks to the
largest one, and queries a zero: then the nearest in Euclidean distance has the largest product, and a graph can be walked.
Equal vectors are one node.  A shard's graph is flat arrays of neighbours, level by level; each query walks every shard's
graph and the best of all shards are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundlake.llm.common import cut, partitions

DEGREE, BUILD, SEARCH, SHARD = 16, 80, 120, 8192
BATCH, STEP = 256, 4   # vectors that walk a graph together, nodes that each of them expands in a round
ROOM = 1 << 20         # distances compared at a time when rows of neighbours are chosen anew


class Graph:
    """``links[level]`` is a table of neighbours by node, -1 where there is none; level 0 holds twice ``degree``.

    Nodes are numbered by falling level, ``order`` gives the row of each, so the first one is the entry on every level.  They are inserted a
    batch at a time: a batch searches the graph of the earlier nodes together and sees its own members by comparing them all.
    """

    def __init__(self, points: np.ndarray, degree: int = DEGREE, build: int = BUILD, seed: int = 3):
        n = len(points)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 12)
        self.order = np.argsort(-level, kind="stable")
        self.points, self.level, self.degree, self.build = points[self.order], level[self.order], degree, build
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        self.links = [np.full((n, degree * (1 if k else 2)), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        first = 1
        while first < n:
            end = min(n, first + min(BATCH, max(1, first // 2)))
            self._insert(np.arange(first, end))
            first = end

    def _walk(self, asked: np.ndarray, near: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search from ``near`` for many vectors at once: the ``width`` nearest found (distance less the own square, node), padded by inf and -1.

        Each round expands the nearest few open nodes of every vector that still has one among its ``width`` best.
        """
        m, table = len(asked), self.links[level]
        step = min(STEP, width)
        rows = np.arange(m)
        far = np.full((m, width), np.inf, np.float32)
        node = np.full((m, width), -1, np.int32)
        done = np.ones((m, width), bool)
        seen = np.zeros((m, len(self.points)), bool)
        far[:, 0] = self.squares[near] - 2 * np.einsum("ij,ij->i", asked, self.points[near])
        node[:, 0], done[:, 0], seen[rows, near] = near, False, True
        active = rows
        while True:
            active = active[~done[active].all(axis=1)]
            if not len(active):
                return far, node
            place = np.argsort(done[active], axis=1, kind="stable")[:, :step]
            fresh = ~done[active[:, None], place]
            done[active[:, None], place] = True
            around = np.where(fresh[:, :, None], table[node[active[:, None], place]], -1).reshape(len(active), -1)
            around[(around >= 0) & seen[active[:, None], around]] = -1
            around.sort(axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            r, c = np.nonzero(around >= 0)
            x = around[r, c]
            seen[active[r], x] = True
            more = np.full(around.shape, np.inf, np.float32)
            more[r, c] = self.squares[x] - 2 * np.einsum("ij,ij->i", asked[active[r]], self.points[x])
            far_, node_ = np.hstack([far[active], more]), np.hstack([node[active], around])
            done_ = np.hstack([done[active], np.isinf(more)])
            best = np.argsort(far_, axis=1, kind="stable")[:, :width]
            far[active], node[active], done[active] = (np.take_along_axis(a, best, axis=1) for a in (far_, node_, done_))

    def _spread(self, own: np.ndarray, far: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node of ``own``, of its candidates those nearer to it than to one already chosen; places left over go to the nearest of the others.

        ``far`` rises along a row and holds squared distances, inf where there is no candidate.  The chosen come back in the same form.
        """
        points, square = self.points[node], self.squares[node]
        apart = square[:, :, None] + square[:, None, :] - 2 * (points @ points.transpose(0, 2, 1))
        chosen, count = np.zeros(far.shape, bool), np.zeros(len(own), int)
        for i in range(far.shape[1]):
            hidden = (chosen & (apart[:, i] < far[:, i, None])).any(axis=1)
            chosen[:, i] = ~hidden & (count < most) & np.isfinite(far[:, i])
            count += chosen[:, i]
        first = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
        far, node = np.take_along_axis(far, first, axis=1), np.take_along_axis(node, first, axis=1)
        return far, np.where(np.isfinite(far), node, -1)

    def _insert(self, batch: np.ndarray):
        near = np.zeros(len(batch), np.int64)
        for level in range(int(self.level[0]), -1, -1):
            here = self.level[batch] >= level
            if not here.all():
                near[~here] = self._walk(self.points[batch[~here]], near[~here], level, 1)[1][:, 0]
            own = batch[here]
            if not len(own):
                continue
            far, node = self._walk(self.points[own], near[here], level, self.build)
            near[here] = node[:, 0]
            mates = self.squares[own] - 2 * (self.points[own] @ self.points[own].T)
            np.fill_diagonal(mates, np.inf)
            far = np.hstack([far, mates]) + self.squares[own, None]
            node = np.hstack([node, np.broadcast_to(own.astype(np.int32), mates.shape)])
            best = np.argsort(far, axis=1, kind="stable")[:, :self.build]
            far, node = self._spread(own, np.take_along_axis(far, best, axis=1), np.take_along_axis(node, best, axis=1), self.degree)
            self.links[level][own, :self.degree] = node
            r, c = np.nonzero(node >= 0)
            self._link_back(level, node[r, c], own[r].astype(np.int32), far[r, c])

    def _link_back(self, level: int, to: np.ndarray, new: np.ndarray, far: np.ndarray):
        """Links from each node of ``to`` to the one of ``new`` beside it; where a row is full its neighbours are chosen anew."""
        table = self.links[level]
        order = np.lexsort((far, to))
        to, new, far = to[order], new[order], far[order]
        at, begin, size = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(begin, size)
        used = (table[at] >= 0).sum(axis=1)
        fits = used + size <= table.shape[1]
        flat = np.repeat(fits, size)
        table[to[flat], (np.repeat(used, size) + rank)[flat]] = new[flat]
        full = np.flatnonzero(~fits)
        full = full[np.argsort(-size[full], kind="stable")]
        while len(full):
            wide = table.shape[1] + int(size[full[0]])
            part, full = np.split(full, [max(1, ROOM // (wide * wide))])
            own = at[part]
            extra = np.arange(wide - table.shape[1])
            source = begin[part, None] + np.minimum(extra, size[part, None] - 1)
            node = np.hstack([table[own], np.where(extra < size[part, None], new[source], -1)])
            gap = self.squares[node] + self.squares[own, None] - 2 * np.einsum("ijk,ik->ij", self.points[node], self.points[own])
            gap = np.where(node >= 0, gap, np.inf)
            best = np.argsort(gap, axis=1, kind="stable")
            table[own] = self._spread(own, np.take_along_axis(gap, best, axis=1), np.take_along_axis(node, best, axis=1), table.shape[1])[1]

    def search(self, asked: np.ndarray, k: int, width: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """(number of the vector asked for, row) of the ``k`` nearest rows that a walk finds for each vector."""
        which, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first in range(0, len(asked) if len(self.points) else 0, BATCH):
            part = asked[first:first + BATCH]
            near = np.zeros(len(part), np.int64)
            for level in range(int(self.level[0]), 0, -1):
                near = self._walk(part, near, level, 1)[1][:, 0]
            node = self._walk(part, near, 0, max(k, width))[1][:, :k]
            r, c = np.nonzero(node >= 0)
            which.append(r + first)
            rows.append(self.order[node[r, c]])
        return np.concatenate(which), np.concatenate(rows)


def usable(vector: str) -> F.Column:
    """Not null, not zero, and all components finite."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard: int = SHARD, width: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors of largest inner product found for each ``vec_id`` divisible by ``every``.

    ``vectors`` has vec_id and embedding.  Unusable vectors and null ids take no part; vectors are compared only with those of as many
    components.  Rows with one id are one vector: the query's own id is never among its neighbours, and of rows with
    the same id the one with the smallest vector (compared as an array) counts.  Equal products rank by the smaller vec_id.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = cut(good.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).withColumn(
        "key", F.xxhash64("v")).withColumn("key2", F.xxhash64(F.lit(5), "v")))
    one = Window.partitionBy("key", "key2", "slice").orderBy("vec_id")
    again = Window.partitionBy("key", "key2").orderBy("vec_id")
    # of equal vectors the k + 1 smallest ids can be among a query's neighbours; they are found slice by slice, then over the slices
    low = rows.select("vec_id", "key", "key2", F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("slice")).withColumn(
        "n", F.row_number().over(one)).where(F.col("n") <= k + 1)
    members = cut(low.withColumn("n", F.row_number().over(again)).where(F.col("n") <= k + 1).select("vec_id", "key", "key2", "n"))
    nodes = members.where("n = 1").select("vec_id").join(rows, "vec_id").select("key", "key2", "dim", "v")
    nodes = cut(nodes.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    n, longest = nodes.agg(F.count("*"), F.max("norm")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    shards = -(-n // shard)
    queries = cut(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "dim", "v"))
    # every query goes to every shard: a stated set of queries against all vectors
    spread = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(int(shards) - 1)))).select("shard", "dim", "query_id", "v")
    dealt = nodes.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).select("shard", "dim", "key", "key2", "v")

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            points, asked = _matrix(left.column("v")), _matrix(right.column("v"))
            lack = np.sqrt(np.maximum(0.0, longest - np.einsum("ij,ij->i", points, points)))
            graph = Graph(np.column_stack([points, lack]).astype(np.float32))
            # one more than asked for, as a query may find itself
            which, at = graph.search(np.column_stack([asked, np.zeros(len(asked))]).astype(np.float32), k + 1, width)
            out = [right.column("query_id").to_numpy()[which], left.column("key").to_numpy()[at], left.column("key2").to_numpy()[at]]
            score = np.einsum("ij,ij->i", asked[which], points[at])
        else:
            score = np.zeros(0)
        return pa.table({"query_id": out[0], "key": out[1], "key2": out[2], "score": score})

    # more partitions than shards, so that few shards meet in one task
    parts = max(partitions(spark), min(4 * shards, 20_000))
    dealt, spread = (side.repartition(parts, "shard", "dim") for side in (dealt, spread))
    found = dealt.groupBy("shard", "dim").cogroup(spread.groupBy("shard", "dim")).applyInArrow(walk, "query_id long, key long, key2 long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # of the shards' answers, the k + 1 best vectors of a query hold its k neighbours (ties at the end stay in)
    top = found.withColumn("_r", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).where(F.col("_r") <= k + 1)
    named = top.join(members.select("vec_id", "key", "key2"), ["key", "key2"]).where("vec_id <> query_id")
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
