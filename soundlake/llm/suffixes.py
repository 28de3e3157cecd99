"""Removal of long byte strings that occur more than once, by interval expansion on Burrows-Wheeler transforms.

Strings of ``length`` bytes that are equal have the same minimiser (the smallest hash of their inner grams, the leftmost of
equals) at the same place, so each start belongs to one anchor, and equal strings belong to anchors of equal hash.  The
starts of an anchor are consecutive; they and the bytes they need are its context.  All strings of a context that occurs
twice or more are repeated, those of an anchor's only context that occurs once are not.  So bytes travel only for anchors with
several contexts of which one occurs once: each distinct context once, with its number of occurrences.

The contexts of an anchor come together in one task.  Many contexts at a time form one text; its suffixes are
sorted as far as ``length`` bytes and give its transform.  Backward extension, breadth first from the empty string,
then finds the borders between suffixes by increasing length of their common prefix and stops at ``length``: the intervals
left are the classes of equal strings, and a class whose starts occur twice or more in all is repeated.  An anchor with so many
distinct contexts that one task should not hold them (mostly the edges of a passage in very many documents) has its strings
counted one by one under 128-bit hashes instead, which no hot anchor can hold up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundlake.llm.common import byte_list, cut, mix, partitions, row_key, text_of

GRAM = 32
CHUNK = 1 << 20        # starts of a long text are handled this many at a time
TEXT = 1 << 17         # bytes of contexts per transform, about: its arrays stay in a core's cache
CROWD = 4096           # distinct contexts of one anchor beyond which its strings are dealt out one by one, by hash


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` (a power of two) bytes."""
    h, width, factor = mix(data), 1, 0x9E3779B97F4A7C15
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    return mix(h)


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and hash of each anchor's run of starts."""
    gram = min(GRAM, 1 << (length.bit_length() - 2))
    h = _gram_hashes(data, gram)
    width = length - gram + 1  # grams in a string
    starts = len(data) - length + 1
    blocks = -(-len(h) // width)
    bits = np.uint64(width.bit_length())
    padded = np.full(blocks * width, ~np.uint64(0), np.uint64)
    padded[:len(h)] = h
    place = np.arange(width, dtype=np.uint64)
    # the hash with its place in the block below it: minima of these are the leftmost of equals
    packed = ((padded.reshape(blocks, width) >> bits) << bits) | place
    before = np.minimum.accumulate(packed, axis=1).ravel()
    after = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.arange(starts)
    left, right = after[first], before[first + width - 1]
    block = first // width
    use_left = (left >> bits) <= (right >> bits)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    at = np.where(use_left, block * width + (left & mask).astype(np.int64), (first + width - 1) // width * width + (right & mask).astype(np.int64))
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return begin, np.diff(np.r_[begin, starts]), h[at[begin]]


def _contexts(text: bytes, length: int):
    """(start, starts, anchor hash, context hash) of every anchor's run in a text, a chunk at a time."""
    for base in range(0, len(text) - length + 1, CHUNK):
        part = text[base:base + CHUNK + length - 1]
        begin, size, h = _anchors(np.frombuffer(part, np.uint8), length)
        digest = xxhash.xxh3_64_intdigest
        seen = np.fromiter((digest(part[a:a + n + length - 1]) for a, n in zip(begin.tolist(), size.tolist())), np.uint64, len(begin))
        yield begin + base, size, h.view(np.int64), seen.view(np.int64)


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """A row per row of ``docs`` and distinct context: key, anchor hash h, context hash c, the starts, their count."""
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("row", "h", "c", "size", "lists")}
            for i, text in enumerate(byte_list(batch.column(2))):
                if len(text) < length:
                    continue
                begin, size, h, c = (np.concatenate(x) for x in zip(*_contexts(text, length)))
                order = np.lexsort((begin, c, h))
                begin, size, h, c = begin[order], size[order], h[order], c[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
                out["row"].append(np.full(len(new), i))
                out["h"].append(h[new])
                out["c"].append(c[new])
                out["size"].append(size[new])
                out["lists"].append((begin, np.diff(np.r_[new, len(begin)])))
            if not out["row"]:
                continue
            row = pa.array(np.concatenate(out["row"]))
            counts = np.concatenate([n for _, n in out["lists"]])
            at = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(np.concatenate([b for b, _ in out["lists"]])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(out["h"])),
                                              pa.array(np.concatenate(out["c"])), pa.array(np.concatenate(out["size"]).astype(np.int32)), at],
                                             names=["r1", "r2", "h", "c", "size", "at"])

    return docs.select("r1", "r2", "text").mapInArrow(run, "r1 long, r2 long, h long, c long, size int, at array<long>")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (numbers from 0 to 256) in the order of their first ``depth`` or more symbols."""
    n = len(text)
    padded = np.zeros(n + 7, np.int64)
    padded[:n] = text
    key = np.zeros(n, np.int64)
    for k in range(7):  # seven symbols of nine bits
        key = (key << 9) | padded[k:k + n]
    order = np.argsort(key)
    sorted_ = key[order]
    fresh = np.r_[True, sorted_[1:] != sorted_[:-1]]
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    known = 7
    while known < depth:
        # only suffixes that still have equals are sorted on
        tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
        if not len(tied):
            break
        rows = order[tied]
        key = (rank[rows] << 32) | rank[np.minimum(rows + known, n)]
        again = np.argsort(key)
        order[tied] = rows[again]
        key = key[again]
        fresh[tied] = np.r_[True, key[1:] != key[:-1]]
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))[tied] + 1
        known *= 2
    return order


def borders(last: np.ndarray, length: int) -> np.ndarray:
    """Which places of the suffix order begin a new class of equal ``length``-symbol prefixes.

    ``last`` is the transform.  The interval of a string w ends where a border was found; for each symbol in it, the interval of
    that symbol before w goes from the symbol's first to its last occurrence, mapped to their suffixes.  Level by level this finds
    every border at the length of the common prefix it cuts.
    """
    n = len(last)
    by_symbol = np.argsort(last, kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)
    before, follow = np.full(n, -1), np.full(n, n)  # the symbol's places around this one
    same = last[by_symbol[1:]] == last[by_symbol[:-1]]
    follow[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    begin, end = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(end):
            break
        size = end - begin
        place = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        # intervals of one level are apart, so the sorted first and last places of their symbols belong together
        first = np.sort(to[place[before[place] < np.repeat(begin, size)]])
        final = np.sort(to[place[follow[place] >= np.repeat(end, size)]]) + 1
        new = ~border[final]
        begin, end = first[new], final[new]
        border[end] = True
    return border[:n]


def repeated_starts(data: np.ndarray, lens: np.ndarray, sizes: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Which of the first ``size`` starts of each context begin a string that occurs twice or more, copies counted.

    ``data`` has the bytes of all contexts, one after another; the answers come in that order, ``size`` for each context.
    """
    begin = np.cumsum(lens + 1) - lens - 1
    text = np.zeros(len(data) + len(lens), np.int16)
    text[np.arange(len(data)) + np.repeat(np.arange(len(lens)), lens)] = data.astype(np.int16) + 1
    order = suffix_order(text, length)
    border = borders(text[order - 1], length)
    weight = np.zeros(len(text))
    own = np.repeat(begin, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weight[own] = np.repeat(weights, sizes)
    group = np.cumsum(border) - 1
    total = np.bincount(group, weights=weight[order])
    hit = np.zeros(len(text), bool)
    hit[order] = total[group] > 1
    return hit[own]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _expand(length: int):
    """Contexts sorted by anchor to the runs of repeated starts of those that occur once; an anchor's contexts stay together."""
    def solve(rows: pa.Table):
        h, c, size, n = (rows.column(k).to_numpy() for k in ("h", "c", "size", "n"))
        context = rows.column("context").combine_chunks().cast(pa.large_binary())
        at = np.frombuffer(context.buffers()[1], np.int64)[context.offset:context.offset + len(context) + 1]
        size = size.astype(np.int64)
        flags = repeated_starts(np.frombuffer(context.buffers()[2], np.uint8)[at[0]:at[-1]], np.diff(at), size, n.astype(float), length)
        flags &= np.repeat(n == 1, size)
        first = np.cumsum(size) - size
        inner = np.ones(len(flags) + 1, bool)  # not between two contexts
        inner[first] = inner[-1] = False
        a = np.flatnonzero(flags & ~(np.r_[False, flags[:-1]] & inner[:-1]))
        b = np.flatnonzero(flags & ~(np.r_[flags[1:], False] & inner[1:])) + 1
        owner = np.repeat(np.arange(len(size)), size)[a]
        runs = np.bincount(owner, minlength=len(size))
        some = np.flatnonzero(runs)
        pairs = pa.StructArray.from_arrays([pa.array((x - first[owner]).astype(np.int32)) for x in (a, b)], names=["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(runs[some])].astype(np.int32)), pairs)
        return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(c[some]), lists], names=["h", "c", "runs"])

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(x.nbytes for x in held) < TEXT:
                continue
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            ends = np.cumsum(pc.binary_length(rows.column("context")).to_numpy())
            border = np.flatnonzero(h[1:] != h[:-1]) + 1  # the last anchor may go on in the next batch
            lo = 0
            while True:
                k = np.searchsorted(ends[border - 1], (ends[lo - 1] if lo else 0) + TEXT)
                if k == len(border):
                    break
                yield solve(rows.slice(lo, border[k] - lo))
                lo = border[k]
            held = rows.slice(lo).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _fetch(length: int):
    """Texts with the places of wanted contexts to the contexts' bytes; of crowded anchors, to two hashes of each single string."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        for batch in batches:
            whole, single = [], []
            for text, wanted in zip(byte_list(batch.column(0)), batch.column(1).to_pylist()):
                for w in wanted:
                    context = text[w["at"]:w["at"] + w["size"] + length - 1]
                    if w["crowded"]:
                        single += [(digest(context[k:k + length]), digest(context[k:k + length], seed=1), w["n"], w["h"], w["c"], k) for k in range(w["size"])]
                    else:
                        whole.append((w["h"], w["c"], w["size"], context, w["n"]))
            h, c, size, context, n = zip(*whole) if whole else [()] * 5
            s1, s2, sn, sh, sc, sk = zip(*single) if single else [()] * 6
            none = [None] * len(single)
            hashes = np.array([s1, s2], np.uint64).view(np.int64)
            columns = (pa.array([*h, *sh], pa.int64()), pa.array([*c, *sc], pa.int64()), pa.array([*size, *sk], pa.int32()), pa.array([*context, *none], pa.binary()),
                       pa.array([*n, *sn], pa.int64()), pa.array([*[None] * len(whole), *hashes[0].tolist()], pa.int64()), pa.array([*[None] * len(whole), *hashes[1].tolist()], pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns), names=["h", "c", "size", "context", "n", "s1", "s2"])
    return run


def _remove(length: int):
    def run(batches):
        for batch in batches:
            kept = []
            for text, spans in zip(byte_list(batch.column("_text")), batch.column("_spans").to_pylist()):
                if not spans:
                    kept.append((text, 0, 0))
                    continue
                step = np.zeros(len(text) + 1, np.int64)
                for span in spans:
                    at = np.array(span["at"], np.int64)
                    for r in span["runs"]:
                        np.add.at(step, at + r["a"], 1)
                        np.add.at(step, at + r["b"] - 1 + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                data = np.frombuffer(text, np.uint8)
                kept.append((data[~gone].tobytes(), int(gone.sum()), len(_runs(gone))))
            own = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("_text", "_spans")]
            names = [name for name in batch.schema.names if name not in ("_text", "_spans")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([k[0] for k in kept], pa.binary()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()),
                 pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept])], names=[*names, "kept", "n_removed", "n_spans", "kept_sha256"])
    return run


def remove_repeats(docs: DataFrame, length: int = 200, crowded: int = CROWD) -> DataFrame:
    """``docs`` without text, with kept (remaining bytes), n_bytes, n_removed, n_spans and kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in any row (null text: empty); all
    strings are judged on the input.  Rows that are equal in id and text count as two occurrences of their text.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    text = text_of()
    r1, r2 = row_key("doc_id", text)
    own = [c for c in docs.columns if c not in ("text", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    keyed = docs.select(r1.alias("r1"), r2.alias("r2"), F.struct(*own).alias("_own"), text.alias("text"))
    anchors = cut(_scan(keyed, length))
    twice = cut(anchors.groupBy("h").agg(F.sum(F.size("at")).alias("_n")).where("_n > 1").select("h"))
    shared = cut(anchors.join(twice, "h", "left_semi"))
    chosen = shared.groupBy("h", "c").agg(F.min(F.struct("r1", "r2", F.col("at")[0].alias("at"), "size")).alias("_at"), F.sum(F.size("at")).alias("n"))
    chosen = cut(chosen)
    # what occurs twice or more is repeated as a whole; bytes are needed where an anchor has other contexts beside one that occurs once
    mixed = cut(chosen.groupBy("h").agg(F.count("*").alias("_k"), F.min("n").alias("_least")).where("_k > 1 and _least = 1").select(
        "h", (F.col("_k") > crowded).alias("crowded")))
    whole = chosen.where("n > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("a"), F.col("_at.size").alias("b"))).alias("runs"))
    chosen = chosen.join(mixed, "h")
    wanted = chosen.groupBy(F.col("_at.r1").alias("r1"), F.col("_at.r2").alias("r2")).agg(
        F.collect_list(F.struct("h", "c", F.col("_at.size").alias("size"), F.col("_at.at").alias("at"), "n", "crowded")).alias("wanted"))
    # of rows with one key (equal rows) one gives the bytes
    texts = keyed.select("r1", "r2", "_own", "text")
    first = Window.partitionBy("r1", "r2").orderBy(F.lit(0))
    fetched = cut(texts.join(wanted, ["r1", "r2"]).withColumn("_k", F.row_number().over(first)).where("_k = 1").select("text", "wanted").mapInArrow(
        _fetch(length), "h long, c long, size int, context binary, n long, s1 long, s2 long"))
    runs = whole.unionByName(cut(fetched.where("context is not null").select("h", "c", "size", "context", "n").repartition(n, "h").sortWithinPartitions("h", "c").mapInArrow(
        _expand(length), "h long, c long, runs array<struct<a:int,b:int>>")))
    if not mixed.where("crowded").isEmpty():
        single = (fetched.where("context is null").select("h", "c", F.col("size").alias("k"), "n", "s1", "s2"))
        again = cut(single.groupBy("s1", "s2").agg(F.sum("n").alias("n")).where("n > 1").select("s1", "s2"))
        hits = single.where("n = 1").join(again, ["s1", "s2"], "left_semi").groupBy("h", "c").agg(
            F.collect_list(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))).alias("runs"))
        runs = runs.unionByName(hits)
    spans = shared.select("r1", "r2", "h", "c", "at").join(runs, ["h", "c"]).dropDuplicates(["r1", "r2", "h", "c"]).groupBy("r1", "r2").agg(
        F.collect_list(F.struct("at", "runs")).alias("_spans"))
    joined = texts.join(spans, ["r1", "r2"], "left").select("_own", F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").alias("_text"), "_spans")
    shape = joined.select("_own", "n_bytes").schema
    for name, kind in (("kept", "binary"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        shape = shape.add(name, kind)
    made = joined.mapInArrow(_remove(length), shape)
    return made.select(*[F.col("_own")[c].alias(c) for c in own], *made.columns[1:])
