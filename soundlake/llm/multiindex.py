"""Embedding near-dedup on an inverted multi-index.

Unit vectors, less their label's mean, are cut in halves with a codebook each; a vector lies in the grid cell (i, j) of its
nearest codewords.  The distance from a half to another codeword's region is at least that to the plane between the two
codewords, so each cell has a lower bound for a vector, the sum of both halves' squares.  A vector visits cells by rising
bound up to the one that no link can exceed, so no link is missed.  What is met is verified in double precision.

Equal vectors are one node with a count.  Cells of one first codeword go to a task together, in blocks of bounded size; a task
returns link counts and a forest of its links, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundlake.llm.common import cut
from soundlake.llm.graph import components
from soundlake.llm.graphs import _matrix, usable

TRAIN, BLOCK = 8192, 4096


def _kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points if len(points) else np.zeros((1, points.shape[1]))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin(_squares(points, centres), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def bounds(half: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and for every codeword the square of the least distance to its region."""
    d = _squares(half, book)
    own = np.argmin(d, axis=1)
    between = np.sqrt(_squares(book, book))[own]
    gap = d - d[np.arange(len(d)), own][:, None]
    low = np.where(between > 0, gap / np.maximum(2 * between, 1e-300), 0.0)
    return own, np.maximum(0, low - 1e-9) ** 2


class Index:
    """Label means and codebooks by number of components, from a bounded sample of rows (label, unit vector)."""

    def __init__(self, labels: np.ndarray, dims: np.ndarray, units: list[np.ndarray], codewords: int):
        self.means, self.books = {}, {}
        for dim in set(dims.tolist()):
            rows = np.flatnonzero(dims == dim)
            data, own = np.stack([units[i] for i in rows]), labels[rows]
            for label in set(own.tolist()):
                self.means[dim, label] = data[own == label].mean(axis=0)
            data = data - np.stack([self.means[dim, label] for label in own.tolist()])
            self.books[dim] = (_kmeans(data[:, :dim // 2], codewords), _kmeans(data[:, dim // 2:], codewords))

    def cells(self, labels: np.ndarray, units: np.ndarray):
        """Own codewords and bounds of both halves."""
        dim = units.shape[1]
        none = np.zeros(dim)
        moved = units - np.stack([self.means.get((dim, label), none) for label in labels.tolist()])
        books = self.books.get(dim, (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))))
        return bounds(moved[:, :dim // 2], books[0]), bounds(moved[:, dim // 2:], books[1])


def _units(column) -> np.ndarray:
    x = _matrix(column)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _by_dim(batch, column: str):
    """Row numbers of each number of components."""
    dims = np.diff(batch.column(column).offsets.to_numpy())
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the true cells of ``near`` (rows left, columns right) connect."""
    out = []
    rows_left = near.any(axis=1)
    while rows_left.any():
        first = int(np.argmax(rows_left))
        rows, columns = np.zeros(len(left), bool), np.zeros(len(right), bool)
        rows[first] = True
        edge = rows.copy()
        while edge.any():
            new = near[edge].any(axis=0) & ~columns
            columns |= new
            edge = near[:, new].any(axis=1) & ~rows
            rows |= edge
        root = left[first]
        out += [(x, root) for x in left[rows].tolist() if x != root] + [(x, root) for x in right[columns].tolist() if x != root]
        rows_left &= ~rows
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Links join rows of one label whose vectors have a cosine of ``least`` or more; null labels, unusable vectors, null ids
    and vectors of another number of components link with nothing.  Rows are vectors, also where ids repeat.  A row
    that is linked to nothing is its own component.
    """
    spark = vectors.sparkSession
    limit = 2 - 2 * least  # squared distance of unit vectors
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("v")
    keyed = cut(rows.select("vec_id", fit.alias("fit"), F.xxhash64("label").alias("label"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(3), "v").alias("k2"),
                            F.when(fit, F.col("v")).alias("v")))
    nodes = cut(keyed.where("fit").groupBy("label", "k1", "k2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("node", F.xxhash64("label", "k1", "k2")))
    many = nodes.count()
    empty = keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not many:
        return empty
    # the sample that codebooks are fitted on: rows of smallest hash, at most TRAIN
    sample = nodes.orderBy("node").limit(TRAIN).select("label", "v", "node", "n").toArrow()
    lists = [np.asarray(x, float) for x in sample.column("v").to_pylist()]
    units = [x / np.sqrt(x @ x) for x in lists]
    labels, dims = sample.column("label").to_numpy(), np.array([len(x) for x in lists])
    codewords = int(min(256, max(8, np.sqrt(many / 256))))
    index = Index(labels, dims, units, codewords)
    shared = spark.sparkContext.broadcast(index)

    # blocks of bounded size in each (label, first codeword)
    def deal(batches):
        known = shared.value
        for batch in batches:
            for _, at in _by_dim(batch, "v"):
                part = batch.take(pa.array(at))
                unit, label = _units(part.column("v")), part.column("label").to_numpy()
                (own, low), (_, other) = known.cells(label, unit)
                row, first = np.nonzero(low + other.min(axis=1)[:, None] <= limit)
                side = (first != own[row]).astype(np.int8)  # in its own cell's task a vector is both met and a visitor
                yield pa.RecordBatch.from_arrays([part.column("label").take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(side),
                                                  part.column("node").take(pa.array(row)), part.column("n").take(pa.array(row)), part.column("v").take(pa.array(row))],
                                                 names=["label", "first", "side", "node", "n", "v"])

    dealt = cut(nodes.select("label", "node", "n", "v").mapInArrow(deal, "label long, first int, side byte, node long, n long, v array<double>"))
    sizes = cut(dealt.groupBy("label", "first").agg(F.sum((F.col("side") == 0).cast("long")).alias("own"), F.count("*").alias("all")))
    sizes = sizes.select("label", "first", F.ceil(F.col("own") / BLOCK).cast("int").alias("m"), F.ceil(F.col("all") / BLOCK).cast("int").alias("p")).where("m > 0")
    placed = dealt.join(sizes, ["label", "first"])
    met = placed.where("side = 0").withColumn("b", F.pmod(F.xxhash64("node"), "m").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    visiting = placed.withColumn("q", F.pmod(F.xxhash64("node", F.lit(1)), "p").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    group = ["label", "first", "b", "q"]

    def verify(key, left: pa.Table, right: pa.Table) -> pa.Table:
        known = shared.value
        out = {"u": [], "v": [], "n": []}

        def emit(u, v, n):
            out["u"].append(np.asarray(u, np.int64))
            out["v"].append(np.asarray(v, np.int64))
            out["n"].append(np.asarray(n, np.int64))

        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            l_dim, r_dim = (np.diff(t.column("v").combine_chunks().offsets.to_numpy()) for t in (left, right))
            for dim in np.intersect1d(l_dim, r_dim):
                a, b = left.take(pa.array(np.flatnonzero(l_dim == dim))), right.take(pa.array(np.flatnonzero(r_dim == dim)))
                x, y = _units(a.column("v")), _units(b.column("v"))  # met, visiting
                a_node, b_node, a_n = a.column("node").to_numpy(), b.column("node").to_numpy(), a.column("n").to_numpy()
                _, (cell, _) = known.cells(a.column("label").to_numpy(), x)
                (_, low1), (_, low2) = known.cells(a.column("label").to_numpy()[:1].repeat(len(y)), y)
                reached = low1[:, key["first"]][:, None] + low2 <= limit
                total = np.zeros(len(y), np.int64)
                for j in np.unique(cell):
                    rows, who = np.flatnonzero(cell == j), np.flatnonzero(reached[:, j])
                    for lo in range(0, len(who), 2048):
                        some = who[lo:lo + 2048]
                        near = (y[some] @ x[rows].T >= least) & (b_node[some][:, None] != a_node[rows][None, :])
                        total[some] += near @ a_n[rows]
                        pairs = _forest(near, b_node[some], a_node[rows])
                        if pairs:
                            u, v = zip(*pairs)
                            emit(u, v, np.zeros(len(u)))
                hit = np.flatnonzero(total)
                emit(b_node[hit], b_node[hit], total[hit])
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})

    def solve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return verify({"first": key[1].as_py()}, left, right)

    met = met.select(*(F.col(c).alias(c) for c in (*group, "node", "n", "v")))
    visiting = visiting.select(*(F.col(c).alias(c) for c in (*group, "node", "v")))
    found = cut(met.groupBy(*group).cogroup(visiting.groupBy(*group)).applyInArrow(solve, "u long, v long, n long"))
    links = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("n = 0").select("u", "v"))
    named = cut(nodes.select("label", "k1", "k2", "node", "n", "least").join(links, "node", "left").join(roots, "node", "left").select(
        "label", "k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    low = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(named.join(low, "root").select("label", "k1", "k2", "n_links", "component_id"))
    joined = keyed.join(named, ["label", "k1", "k2"], "left")
    linked = F.col("fit") & F.col("n_links").isNotNull()
    out = joined.select("vec_id", F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
                        F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
