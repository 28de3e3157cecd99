"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Texts are tokenised once; what goes on is one small row per piece.  The histogram has at most ``capacity`` entries whatever
the corpus, so the program over it (patterns of lengths that fill one sequence) is solved in one place: multiplicative
weights on the lengths, each round priced by a knapsack dynamic program.  Whole multiples of the fractional solution are
taken, and what is left is packed best-fit.  The plan is a table of (pattern, copies);
pieces are numbered within their length and find their sequence and offset by that number.
"""

from __future__ import annotations

import zlib
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundlake.llm.common import cut, partitions, text_of

END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str):
    """Text to ids, by the ranks that belong to the vocabulary file: the same ids, from the faster library.

    Added tokens are one id where their text stands.
    """
    import json

    import public_tokenizers
    import tiktoken
    # the .json file holds printable stand-ins for bytes; the ranks are its entries, in order, as bytes
    made = json.load(open(path))
    vocab, special = made["model"]["vocab"], {t["content"]: t["id"] for t in made["added_tokens"]}
    stand_in, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            stand_in[chr(b)] = b
        else:
            stand_in[chr(256 + extra)] = b
            extra += 1
    ranks = {bytes(stand_in[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode_text(path: str):
    """Any text to its ids.  A run of about a million blanks is too much for the faster library's pattern; the other one takes such texts."""
    fast, slow = encoder(path).encode_to_numpy, []

    def encode(text):
        try:
            return fast(text, allowed_special="all")
        except ValueError:
            if not slow:
                import tokenizers
                slow.append(tokenizers.Tokenizer.from_file(path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.int64)
    return encode


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of a document's pieces: only longer documents are cut, and the first piece takes the remainder."""
    return [0] if n <= capacity else [0, *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024) -> DataFrame:
    """A row per piece of every document (null text: empty): doc_id, piece, start, length, ids_crc32."""
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(batches):
        import public_tokenizers
        encode = encode_text(public_tokenizers.path(tokenizer))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), END).astype("<u4")
                starts = cut_points(len(ids), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES)


def _best_values(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: for each room the value of the best multiset of lengths, and the length it takes (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            some = lengths[:fits[c]]
            gains = price[:fits[c]] + best[c - some]
            k = int(gains.argmax())
            if gains[k] > best[c]:
                best[c], take[c] = gains[k], some[k]
    return best, take


def _filled(take: np.ndarray, room: int, at: dict[int, int], first: int | None = None) -> tuple[tuple[int, int], ...]:
    """The multiset behind ``_best_values``, after ``first``: (place of the length, times) pairs."""
    found = {} if first is None else {first: 1}
    while room > 0:
        if take[room]:
            k = at[int(take[room])]
            found[k] = found.get(k, 0) + 1
            room -= int(take[room])
        else:
            room -= 1
    return tuple(sorted(found.items()))


def fractional(counts: np.ndarray, capacity: int, rates: tuple[float, ...] = (0.3, 0.1, 0.03, 0.01), gap: float = 0.003, convex: float = 1.1,
               rounds: int = 400) -> tuple[list, np.ndarray, float]:
    """Patterns, amounts that cover ``counts``, and a lower bound on any such total: the program by multiplicative weights.

    A length's weight falls by exp(-rate) each time its demand is covered once more; a pattern is worth its lengths' weights per
    demanded piece.  Patterns within ``rate`` of the most valuable one are bought in units that cover their scarcest
    length once; when none is left, the knapsack program prices again.  Its most valuable pattern bounds the optimum from below
    (weights over that value are a dual solution); all amounts over the least coverage cover everything.  Finer rates go on from
    the weights of the best bound and count coverage anew.  It ends once solution and bound are within ``gap``, or after ``rounds``
    pricings at the finest rate.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    at = {int(length): k for k, length in enumerate(lengths)}
    # at first a length is worth its share of a sequence, long ones a little more: they are harder to place
    price = duals = (lengths / capacity) ** convex
    # to begin with, each length by itself
    each = capacity // lengths
    patterns, units = [((k, int(n)),) for k, n in enumerate(each)], (need / each).tolist()
    known, best_amounts, bound = set(patterns), need / each, 0.0
    best_total = best_amounts.sum()
    places, many = np.arange(len(lengths))[:, None], each[:, None].astype(float)   # the patterns as padded rows
    for rate in rates:
        price = duals / duals.max()
        cover, bought = np.zeros(len(lengths)), np.zeros(len(patterns))
        for _ in range(rounds):
            values, take = _best_values(price, lengths, capacity)
            top = values[capacity]
            if need @ price / top > bound:
                bound, duals = float(need @ price / top), price
            least = (1 - rate) * top
            # values only fall, so a pattern that has become too cheap stays so until the next pricing
            live, spent = price.tolist(), cover.tolist()

            def buy(pattern, unit):
                amount = 0.0
                while sum([live[j] * times for j, times in pattern]) >= least:
                    amount += unit
                    for j, times in pattern:
                        step = unit * times / need[j]
                        spent[j] += step
                        live[j] *= exp(-rate * step)
                return amount
            for i in np.flatnonzero((price[places] * many).sum(axis=1) >= least).tolist():
                bought[i] += buy(patterns[i], units[i])
            # then the best pattern around every length that has one worth buying; those bought are kept
            fresh, amounts = len(patterns), []
            for k in np.flatnonzero(price + values[capacity - lengths] >= least).tolist():
                pattern = _filled(take, capacity - int(lengths[k]), at, k)
                unit = min([need[j] / times for j, times in pattern])
                amount = 0.0 if pattern in known else buy(pattern, unit)
                if amount:
                    known.add(pattern)
                    patterns.append(pattern)
                    units.append(unit)
                    amounts.append(amount)
            if amounts:
                widest = max(places.shape[1], max(len(p) for p in patterns[fresh:]))
                grown, times = np.zeros((len(patterns), widest), np.int64), np.zeros((len(patterns), widest))
                grown[:fresh, :places.shape[1]], times[:fresh, :places.shape[1]] = places, many
                for i, pattern in enumerate(patterns[fresh:], fresh):
                    grown[i, :len(pattern)], times[i, :len(pattern)] = zip(*pattern)
                places, many, bought = grown, times, np.r_[bought, amounts]
            total = bought.sum()
            price, cover = np.array(live), np.array(spent)
            lowest = cover.min()
            if lowest > 0 and total / lowest < best_total:
                best_total, best_amounts = total / lowest, bought / lowest
            if best_total <= bound * (1 + gap):
                return patterns[:len(best_amounts)], best_amounts, bound
            if rate != rates[-1] and lowest > 1 / rate:
                break
    return patterns[:len(best_amounts)], best_amounts, bound


def best_fit_decreasing(counts: np.ndarray, capacity: int, begun: list[tuple[np.ndarray, int]] = ()) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing on counts, into the sequences ``begun`` and new ones: sequences with the same content are one
    entry, so the work follows the lengths."""
    open_ = {}  # room left -> list of [pattern, copies]
    for pattern, copies in begun:
        open_.setdefault(capacity - int(pattern @ np.arange(capacity + 1)), []).append([pattern, copies])
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for room in sorted(r for r in open_ if r >= size):
            while left and open_.get(room):
                # a sequence takes the length again while that is still its best fit
                pattern, copies = open_[room].pop()
                per = room // size
                times = min(copies, left // per) if left >= per else 0
                if times:
                    left -= times * per
                    grown, rest = pattern.copy(), copies - times
                    grown[size] += per
                    open_.setdefault(room - per * size, []).append([grown, times])
                else:
                    grown, rest = pattern.copy(), copies - 1
                    grown[size] += left
                    open_.setdefault(room - left * size, []).append([grown, 1])
                    left = 0
                if rest:
                    open_[room].append([pattern, rest])
        per = capacity // size
        for times, each in ((left // per, per), (1, left % per)):
            if times and each:
                pattern = np.zeros(capacity + 1, np.int64)
                pattern[size] = each
                open_.setdefault(capacity - each * size, []).append([pattern, times])
    return [(p, n) for entries in open_.values() for p, n in entries]


def plan(counts: np.ndarray, capacity: int = 1024, gap: float = 0.003) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and whole numbers of copies that use each piece exactly once.

    Amounts of the fractional solution are rounded up, the largest first, as long as all pieces of a copy are there.  The pieces
    that this leaves go best-fit decreasing into the room that is left, and into new sequences.
    """
    left, chosen = counts.astype(np.int64).copy(), []
    if left.any():
        lengths = np.flatnonzero(left)
        patterns, amounts, _ = fractional(left, capacity, gap=gap)
        order = np.argsort(-amounts, kind="stable").tolist()
        for i in order:
            pattern = np.zeros(capacity + 1, np.int64)
            for k, times in patterns[i]:
                pattern[lengths[k]] = times
            # a pattern's part of a copy is rounded up while all its pieces are there
            copies = ceil(amounts[i] - 1e-6)
            used = pattern > 0
            copies = min(copies, int((left[used] // pattern[used]).min())) if copies else 0
            if copies:
                left -= pattern * copies
                chosen.append((pattern, copies))
        chosen = best_fit_decreasing(left, capacity, chosen)
    return np.array([p for p, _ in chosen]).reshape(-1, capacity + 1), np.array([n for _, n in chosen], np.int64)


def place(pieces_: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces_`` (with a length column) with sequence_id and offset, gapless from 0."""
    spark = pieces_.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces_.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    table, copies = plan(counts, capacity)
    first = np.cumsum(copies) - copies
    # for each length, its slots in order: (pieces up to here, pattern, offset of the first, how many in one copy)
    slots = {}
    for length in np.flatnonzero(counts):
        at = np.flatnonzero(table[:, length])
        per = table[at, length]
        longer = (table[at, length + 1:] * np.arange(length + 1, capacity + 1)).sum(axis=1)
        slots[int(length)] = (np.cumsum(per * copies[at]), first[at], per, longer)
    shared = spark.sparkContext.broadcast(slots)  # bounded by patterns x lengths in a pattern

    # a number for each piece within its length: numbers within (length, salt), shifted by the counts of the lower salts
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * partitions(spark)))
    salted = pieces_.withColumn("_salt", salt)
    shift = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn(
        "_shift", F.coalesce(F.sum("_n").over(shift), F.lit(0))).drop("_n"))
    inner = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(inner)).join(shifts.hint("merge"), ["length", "_salt"]).withColumn(
        "_rank", F.col("_rank") + F.col("_shift") - 1).drop("_salt", "_shift")

    def run(batches):
        known = shared.value
        for batch in batches:
            rank, length = batch.column("_rank").to_numpy(), batch.column("length").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                upto, base, per, longer = known[size]
                slot = np.searchsorted(upto, rank[rows], side="right")
                within = rank[rows] - (np.r_[0, upto[:-1]][slot])
                sequence[rows] = base[slot] + within // per[slot]
                offset[rows] = longer[slot] + size * (within % per[slot])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    shape = ", ".join(f"`{c}` {t}" for c, t in pieces_.dtypes if c != "length")
    return ranked.select(*[c for c in pieces_.columns if c != "length"], "length", "_rank").mapInArrow(
        run, f"{shape}, length long, sequence_id long, offset long").select(*pieces_.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece; equal rows are packed each for itself."""
    return place(cut(pieces(docs, tokenizer, capacity)), capacity)
