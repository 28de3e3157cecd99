"""Benchmark passages in training text, by suffix arrays of the training text.

Tasks cut their rows' words into shards and sort each shard's suffixes as far as a benchmark passage can reach: several word
numbers form one key, ranks are doubled from there, and only suffixes with equals are sorted on.  Words that the benchmark
lacks are one number that ends a suffix.  Every benchmark suffix is looked for in every shard by binary search, key by key
inside the interval that its words so far have left; the interval of a whole window is all its places, and the last interval
that is not empty gives the longest verbatim match.  Neighbouring shards of a long text share as many words as a passage has, so
none is lost at a border.  No document and no shard is shuffled: the benchmark is cut into blocks of a bounded number of
words, which meet all rows one after another.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundlake.llm.common import cut, mix, row_key, text_of
from soundlake.operators.ordered import sorted_index

PIECE = 1 << 20     # bytes whose words are hashed at a time
TEXTS = 8 << 20     # bytes of texts handled together, about
SHARD = 1 << 20     # words of a shard
BLOCK = 1 << 20     # benchmark words broadcast at a time
SEGMENT = 4096      # longer benchmark texts are cut; neighbours share all but one word of a window

BASE = 0x9E3779B97F4A7C15
_BYTES = np.arange(256)
_LOWERED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
IN_WORD = ((_LOWERED >= 48) & (_LOWERED <= 57)) | ((_LOWERED >= 97) & (_LOWERED <= 122)) | (_LOWERED >= 128)
VALUE = np.where(IN_WORD, mix(_LOWERED), np.uint64(0))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """(text number, hash) arrays of the words of texts that lie one after another in ``data``, a piece at a time.

    A word's hash is a polynomial of its bytes, from differences of running sums; a word over a piece's end is put together.
    """
    size = min(PIECE, max(1, len(data)))
    up, down = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
    held = None  # start, hash and length of a word that may go on
    with np.errstate(over="ignore"):
        for base in range(0, len(data), size):
            part = data[base:base + size]
            inside, first = IN_WORD[part], np.zeros(len(part), bool)
            cuts = offsets[np.searchsorted(offsets, base):np.searchsorted(offsets, base + len(part))]
            first[cuts - base] = True
            goes_on = np.r_[inside[1:] & ~first[1:], False]
            begins = np.flatnonzero(inside & (first | ~np.r_[False, inside[:-1]]))
            ends = np.flatnonzero(inside & ~goes_on) + 1
            sums = np.r_[np.uint64(0), np.cumsum(VALUE[part] * up[:len(part)], dtype=np.uint64)]
            h = (sums[ends] - sums[begins]) * down[begins]
            at, length = begins + base, ends - begins
            if held is not None:
                if inside[0] and not first[0]:
                    h[0] = np.uint64(held[1]) + h[0] * np.uint64(pow(BASE, held[2], 1 << 64))
                    at[0], length[0] = held[0], length[0] + held[2]
                else:
                    at, h, length = np.r_[held[0], at], np.r_[np.uint64(held[1]), h], np.r_[held[2], length]
                held = None
            if len(part) and inside[-1] and base + len(part) < len(data):
                held = int(at[-1]), int(h[-1]), int(length[-1])
                at, h = at[:-1], h[:-1]
            yield np.searchsorted(offsets, at, side="right") - 1, mix(h)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """63 // bits consecutive word numbers in one key for each place, and one place more."""
    k = 63 // bits
    padded = np.zeros(len(words) + k + 1, np.int64)
    padded[:len(words)] = words
    key = np.zeros(len(words) + 1, np.int64)
    for j in range(k):
        key = (key << bits) | padded[j:j + len(key)]
    return key


def runs_of(words: np.ndarray) -> np.ndarray:
    """How many numbers that are not zero follow from each place."""
    n = len(words)
    stop = np.where(words == 0, np.arange(n), n)
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def suffix_array(words: np.ndarray, keys: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Places of the numbers that are not zero, in the order of what follows up to the first zero or ``depth`` numbers or more."""
    n = len(words)
    run = runs_of(words)
    order = np.flatnonzero(words)
    order = order[np.argsort(keys[order])]
    line = keys[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = line[1:] != line[:-1]
    place = np.arange(len(order))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0)) + 1
    known = 63 // bits
    while known < depth:
        tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
        # equals that ended before ``known`` numbers stay equals
        tied = tied[run[order[tied]] >= known]
        if not len(tied):
            break
        rows = order[tied]
        line = (rank[rows] << 32) | rank[rows + known]
        again = np.argsort(line)
        order[tied] = rows[again]
        line = line[again]
        fresh[tied] = np.r_[True, line[1:] != line[:-1]]
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, place, 0))[tied] + 1
        known *= 2
    return order


class Shard:
    """A shard's sorted suffixes; searches narrow intervals of them."""

    def __init__(self, words: np.ndarray, bits: int, depth: int):
        self.bits, self.k = bits, 63 // bits
        self.keys = word_keys(words, bits)
        self.order = suffix_array(words, self.keys, bits, depth)

    def _bound(self, lo, hi, depth, key, mask, right):
        """First place in [lo, hi) whose key at ``depth`` under ``mask`` is not below (``right``: above) ``key``."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            here = self.keys[self.order[mid] + depth[open_]] & mask[open_]
            below = here <= key[open_] if right else here < key[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        return lo

    def narrow(self, lo, hi, depth, key, count):
        """Intervals left in [lo, hi) by ``count`` (up to k) more words of ``key`` at ``depth``."""
        mask = ~((np.int64(1) << ((self.k - count) * self.bits)) - 1)
        key = key & mask
        left = self._bound(lo, hi, depth, key, mask, False)
        return left, self._bound(left, hi, depth, key, mask, True)

    def intervals(self, keys, starts, lengths):
        """Intervals of suffixes that begin with ``lengths`` words at ``starts`` of the text behind ``keys``."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order))
        live = np.arange(len(starts))
        depth = 0
        while len(live):
            count = np.minimum(self.k, lengths[live] - depth)
            at = np.full(len(live), depth)
            lo[live], hi[live] = self.narrow(lo[live], hi[live], at, keys[starts[live] + depth], count)
            depth += self.k
            live = live[(hi[live] > lo[live]) & (lengths[live] > depth)]
        return lo, hi

    def longest(self, keys, starts, lengths):
        """Length of the longest match of each suffix (at most ``lengths`` words), and a place of the order that has it."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order))
        best, where = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        live = np.flatnonzero(hi > lo)
        depth = 0
        while len(live):
            at, key = np.full(len(live), depth), keys[starts[live] + depth]
            most = np.minimum(self.k, lengths[live] - depth)
            full = np.full(len(live), self.k)
            place = self._bound(lo[live], hi[live], at, key, np.full(len(live), -1), False)
            for beside in (place - 1, place):  # the closest suffixes before and after
                ok = (beside >= lo[live]) & (beside < hi[live])
                other = self.keys[self.order[np.where(ok, beside, lo[live])] + depth]
                same = np.zeros(len(live), np.int64)
                for j in range(1, self.k + 1):
                    shift = (self.k - j) * self.bits
                    same += ok & (other >> shift == key >> shift)
                length = depth + np.minimum(same, most)
                better = length > best[live]
                best[live] = np.where(better, length, best[live])
                where[live] = np.where(better, beside, where[live])
            lo[live], hi[live] = self.narrow(lo[live], hi[live], at, key, full)
            depth += self.k
            live = live[(hi[live] > lo[live]) & (lengths[live] > depth) & (best[live] == depth)]
        return best, where


def _segments(benchmark: DataFrame, item_id: str, window: int) -> DataFrame:
    """Rows item, start (in words), n, words (hashes as bytes) of at most SEGMENT words; texts without words have none."""
    def run(batches):
        for batch in batches:
            data, offsets = _texts(batch.column(1))
            found = list(word_hashes(data, offsets))
            text = np.concatenate([t for t, _ in found] or [np.zeros(0, np.int64)])
            h = np.concatenate([x for _, x in found] or [np.zeros(0, np.uint64)])
            ends = np.searchsorted(text, np.arange(len(batch)), side="right")
            rows = []
            for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
                for start in range(0, max(1, b - a - window + 1) if b > a else 0, SEGMENT - window + 1):
                    part = h[a + start:min(b, a + start + SEGMENT)]
                    rows.append((i, start, len(part), part.tobytes()))
            i, start, n, words = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int64())), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(words, pa.binary())],
                                             names=["item", "start", "n", "words"])

    return benchmark.select(F.col(item_id).cast("string").alias("item"), text_of()).mapInArrow(run, "item string, start long, n long, words binary")


class Block:
    """Benchmark segments made ready for searching: word numbers, suffix starts, distinct windows and their items."""

    def __init__(self, rows: pa.Table, window: int):
        parts = [np.frombuffer(x, np.uint64) for x in rows["words"].to_pylist()]
        self.vocabulary = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        lens = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(lens + 1) - lens - 1
        self.words = np.zeros(int((lens + 1).sum()), np.int64)
        for b, p in zip(begin, parts):
            self.words[b:b + len(p)] = np.searchsorted(self.vocabulary, p) + 1
        self.depth = int(lens.max(initial=1))
        self.keys = word_keys(self.words, self.bits)
        self.items = rows["item"].to_pylist()
        self.begin, self.start = begin, np.array(rows["start"].to_pylist(), np.int64)
        self.suffixes = np.flatnonzero(self.words)
        self.left = runs_of(self.words)[self.suffixes]
        self._windows(np.minimum(lens, window))

    def _windows(self, size):
        """Distinct windows: a start and a length each; and the segments that hold each."""
        order = suffix_array(self.words, self.keys, self.bits, self.depth)
        segment = np.searchsorted(self.begin, order, side="right") - 1
        length = size[segment]
        own = runs_of(self.words)[order] >= length
        order, segment, length = order[own], segment[own], length[own]
        self.at, self.length, holders, counts = [], [], [], []
        for w in np.unique(length).tolist():
            some = length == w
            o, s = order[some], segment[some]
            new = np.zeros(len(o), bool)
            new[0] = True
            for d in range(0, w, 63 // self.bits):
                shift = max(0, 63 // self.bits - (w - d)) * self.bits
                line = self.keys[o + d] >> shift
                new[1:] |= line[1:] != line[:-1]
            self.at.append(o[new])
            self.length.append(np.full(int(new.sum()), w))
            holders.append(s)
            counts.append(np.diff(np.r_[np.flatnonzero(new), len(o)]))
        none = [np.zeros(0, np.int64)]
        self.at, self.length = np.concatenate(self.at or none), np.concatenate(self.length or none)
        self.holders, counts = np.concatenate(holders or none), np.concatenate(counts or none)
        self.first = np.r_[0, np.cumsum(counts)]

    def number(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, 0 for words that the block lacks."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.int32)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the intervals, and the interval of each."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size), which


def _groups(offsets: np.ndarray):
    """Ranges of rows of about TEXTS bytes."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + TEXTS, side="right")) - 1)
        yield a, b
        a = b


def _numbered(block: Block, data: np.ndarray, offsets: np.ndarray):
    """Word numbers of texts, a 0 after each text, and where each text begins."""
    counts, found = np.zeros(len(offsets) - 1, np.int64), []
    for text, h in word_hashes(data, offsets):
        counts += np.bincount(text, minlength=len(counts))
        found.append(block.number(h))
    begin = np.cumsum(counts + 1) - counts - 1
    words = np.zeros(int((counts + 1).sum()), np.int32)
    own = np.ones(len(words), bool)
    own[begin + counts] = False
    words[own] = np.concatenate([*found, np.zeros(0, np.int32)])
    return words, begin, counts


def _shards(block: Block, words: np.ndarray):
    """Each shard with its first place; it sees as many words beyond its last as a segment can need."""
    step = max(SHARD, 2 * block.depth)
    for base in range(0, len(words), step):
        yield base, Shard(words[base:base + step + block.depth], block.bits, block.depth)


def _hits(block: Block, words: np.ndarray, begin: np.ndarray):
    """Which words a window covers, and distinct (text, segment) pairs."""
    step = np.zeros(len(words) + 1, np.int64)
    pairs = [np.zeros((2, 0), np.int64)]
    for base, shard in _shards(block, words):
        lo, hi = shard.intervals(block.keys, block.at, block.length)
        for w in np.unique(block.length[hi > lo]).tolist():
            some = np.flatnonzero((block.length == w) & (hi > lo))
            place, which = _spread(lo[some], hi[some])
            at = shard.order[place] + base
            step += np.bincount(at, minlength=len(step)) - np.bincount(at + w, minlength=len(step))
            text = np.searchsorted(begin, at, side="right") - 1
            code = np.unique(text * len(block.at) + some[which])
            text, kind = code // len(block.at), code % len(block.at)
            holder, which = _spread(block.first[kind], block.first[kind + 1])
            code = np.unique(text[which] * len(block.begin) + block.holders[holder])
            pairs.append(np.stack([code // len(block.begin), code % len(block.begin)]))
    return np.cumsum(step[:-1]) > 0, np.unique(np.concatenate(pairs, axis=1), axis=1)


def _report(shared):
    """Rows to their keys, n_words, spans of hit words and names of items."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        block = shared.value
        for batch in batches:
            data, offsets = _texts(batch.column(batch.schema.names.index("text")))
            counts, spans, items = [], [], []
            for a, b in _groups(offsets):
                words, begin, n = _numbered(block, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                hit, (text, segment) = _hits(block, words, begin)
                edge = np.diff(np.r_[False, hit, False].astype(np.int8))
                first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                owner = np.searchsorted(begin, first, side="right") - 1
                own = [[] for _ in range(b - a)]
                for t, x, y in zip(owner.tolist(), (first - begin[owner]).tolist(), (end - begin[owner]).tolist()):
                    own[t].append({"first": x, "end": y})
                names = [set() for _ in range(b - a)]
                for t, s in zip(text.tolist(), segment.tolist()):
                    names[t].add(block.items[s])
                counts += n.tolist()
                spans += own
                items += [list(x - {None}) for x in names]
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                                             names=[*[x for x in batch.schema.names if x != "text"], "n_words", "spans", "items"])
    return run


def _longest(shared):
    """Rows to each segment's longest match in each shard."""
    def run(batches):
        block = shared.value
        segment = np.searchsorted(block.begin, block.suffixes, side="right") - 1
        for batch in batches:
            data, offsets = _texts(batch.column(1))
            for a, b in _groups(offsets):
                words, begin, _ = _numbered(block, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                for base, shard in _shards(block, words):
                    best, where = shard.longest(block.keys, block.suffixes, block.left)
                    order = np.lexsort((-best, segment))
                    top = order[np.flatnonzero(np.r_[True, segment[order][1:] != segment[order][:-1]])] if len(order) else order
                    top = top[best[top] > 0]
                    at = shard.order[where[top]] + base
                    text = np.searchsorted(begin, at, side="right") - 1
                    s = segment[top]
                    start = block.suffixes[top] - block.begin[s] + block.start[s]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.items[x] for x in s.tolist()], pa.string()), pa.array(best[top]), pa.array(start),
                         batch.column(0).take(pa.array(text + a)), pa.array(at - begin[text])], names=["item_id", "length", "item_start", "doc_id", "doc_start"])
    return run


def _blocks(benchmark: DataFrame, item_id: str, window: int, words: int):
    """The benchmark's blocks, one after another; each is at most ``words`` words and one segment."""
    spark = benchmark.sparkSession
    placed = cut(sorted_index(_segments(benchmark, item_id, window), ["item", "start"], "ahead", "n").select(
        F.floor(F.col("ahead") / words).alias("block"), "item", "start", "n", "words"))
    last = placed.agg(F.max("block")).first()[0] or 0
    for k in range(last + 1):
        yield spark.sparkContext.broadcast(Block(placed.where(F.col("block") == k).select("item", "start", "words").toArrow(), window))


def covered(spans: Column) -> Column:
    """How many whole numbers lie in the spans."""
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), begin, lambda now, s: F.struct(
        F.greatest(now["end"], s["end"]).alias("end"), (now["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["first"], now["end"]))).alias("n")), lambda now: now["n"])


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", window: int = 10, block_words: int = BLOCK) -> DataFrame:
    """A row per row of ``docs``: its columns as the struct ``doc``, n_words, spans (of hit words), items (names), n_hit, contaminated.

    A window is ``window`` consecutive words of a benchmark text, or all of a shorter one; a word of a document inside any
    occurrence of a window is hit.  Nulls and texts without words have no windows and no hits; repeated rows are judged each for
    itself; an item without id marks words but has no name; items of equal id are one.  Spans of different blocks may overlap.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), text_of().alias("text"))
    shape = "n_words long, spans array<struct<first:long,end:long>>, items array<string>"
    result, extra = None, []
    for shared in _blocks(benchmark, item_id, window, block_words):
        if result is None:
            kind = rows.select("doc").schema
            for field in rows.sparkSession.createDataFrame([], shape).schema:
                kind = kind.add(field)
            result = rows.mapInArrow(_report(shared), kind)
        else:  # further blocks: only rows that they hit travel
            r1, r2 = row_key(doc_id, text_of())
            found = docs.select(r1.alias("r1"), r2.alias("r2"), text_of().alias("text")).mapInArrow(_report(shared), f"r1 long, r2 long, {shape}")
            extra.append(cut(found.where("size(spans) > 0").drop("n_words").dropDuplicates(["r1", "r2"])))
    if extra:
        more = extra[0]
        for x in extra[1:]:
            more = more.unionByName(x)
        more = cut(more.groupBy("r1", "r2").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items")))
        r1, r2 = row_key(f"doc.{doc_id}", text_of("doc.text"))
        result = cut(result).withColumns({"r1": r1, "r2": r2}).join(more, ["r1", "r2"], "left")
        result = result.select("doc", "n_words", F.concat("spans", F.coalesce("_spans", F.array().cast("array<struct<first:long,end:long>>"))).alias("spans"),
                               F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))).alias("items"))
    return result.withColumn("items", F.array_sort("items")).withColumn("n_hit", covered(F.col("spans"))).withColumn("contaminated", F.size("spans") > 0)


def remove(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark."""
    return find(docs, benchmark, **how).where("not contaminated").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", block_words: int = BLOCK) -> DataFrame:
    """For each item with a word in ``docs``: the longest run of its words that a document holds, and one place of it.

    item_id (as text), length, item_start, doc_id, doc_start, all in words; runs are followed for SEGMENT words at most.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), text_of().alias("text"))
    found = None
    for shared in _blocks(benchmark, item_id, 2, block_words):
        part = rows.mapInArrow(_longest(shared), "item_id string, length long, item_start long, doc_id string, doc_start long")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("item_id").agg(F.max(F.struct("length", (-F.col("item_start")).alias("s"), "doc_id", (-F.col("doc_start")).alias("d"))).alias("b"))
    return best.select("item_id", "b.length", (-F.col("b.s")).alias("item_start"), "b.doc_id", (-F.col("b.d")).alias("doc_start"))


def leak_report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the names, sorted as text, joined by commas), contaminated."""
    found = find(docs, benchmark, **how)
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
