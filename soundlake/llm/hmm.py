"""Hidden Markov language model over words.

States emit word classes (a hash of a word's last bytes, so that short words stand nearly alone and long ones share
endings), and a class emits its words by their counts over all training documents.  Baum-Welch runs over all training texts:
each partition adds up expected transitions and emissions, the sums are aggregated, and a bounded table goes back.  The
scaled forward recursion then gives the exact probability of each text.

Word counts grow with the corpus and are never broadcast.  Each text is read and split once, in blocks: a block numbers its
own distinct words, and from then on its texts are these numbers.  The blocks' words meet by word, which gives their counts
over all texts; numbers and counts of a block meet in one task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundlake.llm.common import byte_list, cut, remainder, text_of

CLASSES, STATES, TAIL = 8192, 8, 4
ADD = 0.1
PASSES = 6
CELLS = 1 << 19       # tokens handled at a time
SEGMENT = 2048        # longer training texts are learned from as several sequences
BLOCK_BYTES = 16_000_000
END = CLASSES - 1     # the class of the end token, and of nothing else


def word_class(word: bytes) -> int:
    """The class of a word: by its last bytes and whether it has more of them."""
    return xxhash.xxh32_intdigest(word[-TAIL:] + (b"+" if len(word) > TAIL else b"")) % (CLASSES - 1)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, and between \x20 and \x09-\x0D only


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Texts of about ``block_bytes`` in all as numbers: rows of documents and rows of words, each with its block.

    A document has doc_id, held_out, the classes of its tokens (16-bit numbers, the end included) and, for each, its word's rank
    among the block's words of that class, in as many bytes as the largest needs.  A word has its class k, that rank, and how often it stands in
    the block's training texts.
    """
    def block(number: int, words: dict[bytes, int], rows: list[tuple]):
        k = np.fromiter(map(word_class, words), np.int64, len(words))
        by_class = np.argsort(k, kind="stable")
        in_order = k[by_class]
        rank = np.empty(len(k), np.int64)
        rank[by_class] = np.arange(len(k)) - np.searchsorted(in_order, in_order)
        learned = [ids for _, held_out, ids in rows if not held_out]
        n = np.bincount(np.concatenate(learned) if learned else np.zeros(0, int), minlength=len(k))
        codes, ranks = [], []
        for _, _, ids in rows:
            codes.append(np.append(k[ids], END).astype("<u2").tobytes())
            of = np.append(rank[ids], 0)
            ranks.append(of.astype("<u1" if (most := of.max()) < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes())
        for size, columns in ((len(rows), ([r[0] for r in rows], [r[1] for r in rows], codes, ranks, None, None, None, None)),
                              (len(k), (None, None, None, None, list(words), k, rank, n))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, number)), *(pa.nulls(size, kind) if x is None else pa.array(x, kind) for x, kind in zip(columns, (
                    pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64())))],
                names=["block", "doc_id", "held_out", "codes", "ranks", "word", "k", "rank", "n"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        words, rows, size = defaultdict(), [], 0
        words.default_factory = words.__len__  # numbers in the order of first sight
        for batch in batches:
            for doc_id, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_list(batch.column(2))):
                found = words_of(text)
                rows.append((doc_id, held_out, np.fromiter(map(words.__getitem__, found), np.int32, len(found))))
                size += len(text) + 1
                if size >= block_bytes:
                    yield from block(number, words, rows)
                    words.clear()
                    number, rows, size = number + 1, [], 0
        if rows:
            yield from block(number, words, rows)

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "block long, doc_id long, held_out boolean, codes binary, ranks binary, word binary, k int, rank int, n long")


def _groups(codes: list[np.ndarray]):
    """Sequences of similar length side by side: (which, matrix of codes, lengths), the matrix within ``CELLS``."""
    order = np.argsort([-len(c) for c in codes], kind="stable")
    at = 0
    while at < len(order):
        width = len(codes[order[at]])
        which = order[at:at + max(1, CELLS // width)]
        sizes = np.array([len(codes[i]) for i in which])
        block = np.zeros((width, len(which)), np.int64)
        for k, i in enumerate(which):
            block[:len(codes[i]), k] = codes[i]
        yield which, block, sizes
        at += len(which)


def expectations(codes: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Expected starts, transitions and emissions (classes x states) of the sequences, and their log likelihood."""
    k = len(start)
    starts, moves, likelihood = np.zeros(k), np.zeros((k, k)), 0.0
    emissions = np.zeros((emit.shape[0], k))
    # single precision does for expected counts, as each step is scaled; they are added up in double
    start, move, emit, ones = (x.astype(np.float32) for x in (start, move, emit, np.ones(k)))
    turned = np.ascontiguousarray(move.T)
    for _, block, sizes in _groups(codes):
        width, many = block.shape
        shown = emit[block]  # width x many x k
        forward, scale = np.empty((width, many, k), np.float32), np.ones((width, many), np.float32)
        alive = np.searchsorted(-sizes, -np.arange(width + 1), side="left").tolist()  # sequences longer than t: sizes fall
        for t in range(width):
            n = alive[t]
            a = forward[t, :n]
            np.multiply(start if t == 0 else forward[t - 1, :n] @ move, shown[t, :n], out=a)
            s = np.dot(a, ones, out=scale[t, :n])
            a /= s[:, None]
        likelihood += np.log(scale).sum(dtype=float)
        back = np.ones((many, k), np.float32)
        shown /= scale[:, :, None]
        for t in range(width - 1, -1, -1):
            n, later = alive[t], alive[t + 1]
            if later:
                carried = shown[t + 1, :later] * back[:later]
                moves += forward[t, :later].T @ carried
                np.dot(carried, turned, out=back[:later])
            forward[t, :n] *= back[:n]  # the posterior takes the place of the forward value, which is done with
        starts += forward[0].sum(axis=0)
        real = np.arange(width)[:, None] < sizes[None, :]
        flat, posterior = block[real], forward[real].astype(float)
        for j in range(k):
            emissions[:, j] += np.bincount(flat, weights=posterior[:, j], minlength=emit.shape[0])
    return starts, moves * move, emissions, likelihood


def log_likelihoods(codes: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log of each sequence's probability, by the scaled forward recursion."""
    out, ones = np.zeros(len(codes)), np.ones(len(start))
    for which, block, sizes in _groups(codes):
        a, total = None, np.zeros(len(which))
        alive = np.searchsorted(-sizes, -np.arange(len(block)), side="left").tolist()
        for t, n in enumerate(alive):
            a = (start if t == 0 else a[:n] @ move) * emit[block[t, :n]]
            s = a @ ones
            total[:n] += np.log(s)
            a /= s[:, None]
        out[which] = total
    return out


def _first_guess(totals: np.ndarray):
    """States that tend to stay, with the classes' shares shifted at random."""
    rng = np.random.default_rng(7)
    share = (totals + ADD) / (totals + ADD).sum()
    emit = share[:, None] * rng.uniform(0.5, 1.5, (CLASSES, STATES))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0)


def train(coded: DataFrame, totals: np.ndarray, passes: int = PASSES):
    """Baum-Welch over the training rows of ``coded``; start, transition and emission probabilities."""
    spark = coded.sparkSession
    model = _first_guess(totals)
    if not totals.sum():
        return model
    rows = coded.where("not held_out").select("codes")
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))]
            held, size = [], 0

            def add():
                for total, part in zip(sums, expectations(held, *shared.value)):
                    total += part

            for batch in batches:
                for value in byte_list(batch.column(0)):
                    codes = np.frombuffer(value, "<u2").astype(np.int64)
                    for lo in range(0, len(codes), SEGMENT):
                        held.append(codes[lo:lo + SEGMENT])
                        size += len(held[-1])
                    if size >= 4 * CELLS:
                        add()
                        held, size = [], 0
            if held:
                add()
            table = np.concatenate([sums[2], sums[1], sums[0][None, :]])
            used = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(table[used, j]) for j in range(STATES)], names=["i", *(f"s{j}" for j in range(STATES))])

        parts = rows.mapInArrow(run, "i long, " + ", ".join(f"s{j} double" for j in range(STATES)))
        summed = parts.groupBy("i").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(STATES))).collect()  # classes and states: bounded
        table = np.zeros((CLASSES + STATES + 1, STATES))
        for row in summed:
            table[row[0]] = row[1:]
        share = (totals + ADD) / (totals + ADD).sum()
        emit = table[:CLASSES] + 0.5 * CLASSES * share[:, None] * 0.01
        move, start = table[CLASSES:-1] + 0.1, table[-1] + 0.1
        model = (start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        shared.unpersist()
    return model


def score(docs: DataFrame, fold: int = 0, folds: int = 10, passes: int = PASSES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row (null text: only the end token).

    ``base_score`` is the smoothed unigram model's, ``score`` the hidden Markov model's log10 probability.  Unseen words are
    one word of their class, with the same smoothing.  Without training texts both models know nothing but that word.
    """
    spark = docs.sparkSession
    made = cut(_blocks(docs.select(F.col("doc_id").cast("long"), (remainder("doc_id", folds) == fold).alias("held_out"), text_of().alias("text")), block_bytes))
    coded = made.where("codes is not null").select("block", "doc_id", "held_out", "codes", "ranks")
    # a word has a row per block that holds it; the first of them counts it as a word
    same = Window.partitionBy("word")
    counts = cut(made.where("word is not null").select(
        "block", "k", "rank", F.sum("n").over(same).alias("n"), (F.min("block").over(same) == F.col("block")).alias("first")))

    per_class = counts.where("first and n > 0").groupBy("k").agg(F.sum("n"), F.count("*")).collect()  # at most CLASSES rows
    totals, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, n, v in per_class:
        totals[k], kinds[k] = n, v
    trained = coded.where("not held_out").count()
    totals[END], kinds[END] = trained, float(trained > 0)
    all_tokens, all_words = int(totals.sum()), int(kinds.sum())
    model = train(coded, totals, passes)
    shared = spark.sparkContext.broadcast((model, totals, kinds))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        (start, move, emit), class_total, class_kinds = shared.value
        k = right.column("k").to_numpy()
        held = np.bincount(k, minlength=CLASSES)
        held[END] = 1
        first = np.cumsum(held) - held
        counts = np.zeros(held.sum())
        counts[first[k] + right.column("rank").to_numpy()] = right.column("n").to_numpy()
        counts[first[END]] = class_total[END]
        count_logs = np.log10(counts + ADD)
        in_class = np.log10(class_total + ADD * (class_kinds + 1))
        seen, logs, codes = [], [], []
        for code, rank in zip(byte_list(left.column("codes").combine_chunks()), byte_list(left.column("ranks").combine_chunks())):
            code = np.frombuffer(code, "<u2").astype(np.int64)
            at = first[code] + np.frombuffer(rank, f"<u{len(rank) // len(code)}")
            seen.append(int((counts[at] > 0).sum()))
            logs.append(float(count_logs[at].sum()))
            codes.append(code)
        hidden = log_likelihoods(codes, start, move, emit) / np.log(10)
        size = np.array([len(c) for c in codes])
        logs = np.array(logs)
        plain = logs - size * np.log10(all_tokens + ADD * (all_words + 1))
        scores = hidden + logs - np.array([in_class[c].sum() for c in codes])
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(size), "n_known": pa.array(seen, pa.int64()),
                         "train_tokens": pa.array(np.full(len(size), all_tokens)), "base_score": pa.array(plain), "score": pa.array(scores)})

    return coded.groupBy("block").cogroup(counts.select("block", "k", "rank", "n").groupBy("block")).applyInArrow(
        meet, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
