"""SimHash near-dedup through segment popcounts.

A fingerprint of 64 bits is cut into segments of two bits; the vector of their bit counts moves by at most the Hamming
distance in Manhattan metric.  Two fingerprints at most three bits apart therefore have one half of their vector (16 counts)
at Manhattan distance one or less.  Each half is a cell of an integer grid: a fingerprint stands in its own cell and looks
into the cells one count up, so every such pair of halves meets in exactly one of them.  Candidates are verified on all bits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundlake.llm.common import WORDS, bit_counts, byte_list, cut, partitions, row_key, text_of
from soundlake.llm.graph import components

SEED, SHINGLE, REACH = 42, 3, 3
_CELLS = 3 ** np.arange(16, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the word shingles of ``text``, repeats included; no words give zero."""
    words = re.findall(WORDS, text.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    take = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    total, set_bits, step = len(words) - take + 1, np.zeros(64, np.int64), 1 << 16
    for lo in range(0, total, step):
        hi = min(total, lo + step)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), ends[lo + take - 1:hi + take - 1].tolist())], np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2 (row key) and fp: the fingerprint as a signed 64-bit number."""
    r1, r2 = row_key("doc_id", text_of())

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x) for x in byte_list(batch.column(3))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps)], names=["doc_id", "r1", "r2", "fp"])

    return docs.select(F.col("doc_id").cast("long"), r1.alias("r1"), r2.alias("r2"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, r1 long, r2 long, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments of each fingerprint."""
    fps = fps.view(np.uint64)
    return np.stack([bit_counts((fps >> np.uint64(2 * i)) & np.uint64(3)) for i in range(32)], axis=1).astype(np.int64)


def _cells(batches):
    """Own cells (side 0) and the cells one count up (side 1) of both halves."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        counts = segment_counts(fps)
        for half in (0, 1):
            part = counts[:, 16 * half:16 * half + 16]
            own = part @ _CELLS
            row, segment = np.nonzero(part < 2)
            cell = np.concatenate([own, own[row] + _CELLS[segment]]) * 2 + half
            side = np.zeros(len(cell), np.int8)
            side[len(own):] = 1
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate([fps, fps[row]])), pa.array(side)],
                                             names=["cell", "fp", "side"])


def _links_in_cell(own: np.ndarray, up: np.ndarray) -> list[np.ndarray]:
    """Links that connect what the cell's pairs connect: own with own, own with up.  No more than a forest of the cell.

    Pivots: all rows near the first are hung on it at once; rows that are hung need only be compared across pivots that
    are near enough for a link between their rows.  ``up`` rows are not compared with each other: other cells do that.
    """
    rows = np.concatenate([own, up]).view(np.uint64)
    is_own = np.arange(len(rows)) < len(own)
    owner = np.full(len(rows), -1)
    pivots, edges = [], []
    root = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(own)):
        if owner[i] >= 0:
            continue
        owner[i] = i
        root[i] = i
        near = (bit_counts(rows ^ rows[i]) <= REACH) & (owner < 0)
        owner[near] = i
        if near.any():
            edges.append(np.stack([np.full(near.sum(), rows[i]), rows[near]], axis=1))
        pivots.append(i)
    loose = np.flatnonzero(owner < 0)  # up rows that are near no pivot may still be near a row hung on one
    for i in loose:
        hit = np.flatnonzero((bit_counts(rows[:len(own)] ^ rows[i]) <= REACH))
        if len(hit):
            groups, first = np.unique([find(owner[j]) for j in hit], return_index=True)
            edges.append(np.stack([np.full(len(groups), rows[i]), rows[hit[first]]], axis=1))
            for g in groups[1:]:
                root[int(g)] = int(groups[0])
    where = np.array(pivots, np.int64)
    members = {p: np.flatnonzero(owner == p) for p in pivots} if len(pivots) < len(own) or len(up) else {p: np.array([p]) for p in pivots}
    for k, p in enumerate(pivots):
        close = where[k + 1:][bit_counts(rows[where[k + 1:]] ^ rows[p]) <= 3 * REACH]
        for q in close.tolist():
            if find(p) == find(q):
                continue
            a, b = members[p], members[q]
            for lo in range(0, len(a), 256):
                d = bit_counts(rows[a[lo:lo + 256], None] ^ rows[b][None, :]) <= REACH
                d &= is_own[a[lo:lo + 256], None] | is_own[b][None, :]
                if d.any():
                    x, y = np.argwhere(d)[0]
                    edges.append(np.array([[rows[a[lo + x]], rows[b[y]]]], np.uint64))
                    root[find(p)] = find(q)
                    break
    return edges


def _verify(batches):
    """Rows sorted by cell, whole cells at a time."""
    held = []
    for batch in batches:
        cell, fp, side = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(cell):
            continue
        held.append((cell, fp, side))
        if held[0][0][0] == cell[-1]:
            continue  # still one cell
        cell, fp, side = (np.concatenate(x) for x in zip(*held))
        done = np.searchsorted(cell, cell[-1])
        held = [(cell[done:], fp[done:], side[done:])]
        yield from _emit(cell[:done], fp[:done], side[:done])
    if held:
        yield from _emit(*(np.concatenate(x) for x in zip(*held)))


def _emit(cell, fp, side):
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[start, len(cell)])
    owns = np.add.reduceat(side == 0, start)
    out = []
    # cells of a few rows, all at once: each row with the k-th one after it
    few = (size > 1) & (size <= 12) & (owns > 0)
    last = np.repeat(np.where(few, start + size, 0), size)
    for k in range(1, 12):
        i = np.flatnonzero(np.arange(len(cell)) + k < last)
        if not len(i):
            break
        ok = (bit_counts((fp[i] ^ fp[i + k]).view(np.uint64)) <= REACH) & ((side[i] == 0) | (side[i + k] == 0))
        out.append(np.stack([fp[i[ok]], fp[i[ok] + k]], axis=1))
    for s, n in zip(start[(size > 12) & (owns > 0)], size[(size > 12) & (owns > 0)]):
        rows, own = fp[s:s + n], side[s:s + n] == 0
        out.extend(x.view(np.int64) for x in _links_in_cell(rows[own], rows[~own]))
    links = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, 0])), pa.array(np.ascontiguousarray(links[:, 1]))], names=["u", "v"])


def links(fps: DataFrame) -> DataFrame:
    """Verified links u, v between distinct fingerprints (column fp): they connect whatever lies ``REACH`` bits apart or closer."""
    n = partitions(fps.sparkSession)
    cells = fps.select("fp").mapInArrow(_cells, "cell long, fp long, side byte")
    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_verify, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2 (row key), fp, component_id: the smallest doc_id among all rows reachable over links; and root.

    Null texts are empty and have fingerprint zero, linked like any other.  Null ids never name a component unless it
    has no other id.  Components with one component_id may be several, as ids can repeat or be null: ``root``, a
    component's smallest fingerprint, tells them apart.
    """
    rows = cut(fingerprints(docs))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct))
    rooted = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = cut(rooted.join(named, "root").select("fp", "component_id", "root"))
    return rows.join(by_fp, "fp")
