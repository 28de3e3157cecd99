"""Quality classifier on supervised subword embeddings.

Words and the character n-grams inside them are hashed to learned vectors; a document is their average, and a softmax over
two outputs reads its quality.  Training is stochastic gradient descent in numpy over a bounded sample of labelled rows.
As the output is linear in the average, each word adds one number to a document's score, which scoring looks up once a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundlake.llm.common import byte_list, mix, remainder, text_of

BUCKETS, DIM, GRAMS = 1 << 17, 16, (3, 4)
MAX_TRAIN_ROWS = 4096
_REMEMBER = 400_000
SAME = b"\x00="  # stands for a word that repeats the one before it


def tokens(text: bytes) -> list[bytes]:
    """Words between blanks; a word that repeats its predecessor becomes one fixed token."""
    words = text.split()
    return words[:1] + [SAME if a == b else b for a, b in zip(words, words[1:])]


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features (the word itself, then its n-grams with word ends marked) and each feature's word."""
    marked = b"".join(b"<" + w + b">" for w in words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    raw = np.frombuffer(marked, np.uint8).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(raw)) - start[word]
    base = np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), base, np.uint64))
        whole = np.add.reduceat(mix(raw) * power[place], start)
        found, owner = [whole], [np.arange(len(words))]
        for n in GRAMS:
            at = np.flatnonzero(place + n <= size[word])
            gram = np.full(len(at), n, np.uint64)
            for k in range(n):
                gram = gram * np.uint64(1_000_003) + raw[at + k]
            found.append(gram)
            owner.append(word[at])
    return (mix(np.concatenate(found)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owner)


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and their shares of all its features."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    index: dict[bytes, int] = {}
    which = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    bucket, owner = word_features(list(index))
    ids, inverse = np.unique(bucket, return_inverse=True)
    shares = np.bincount(inverse, weights=np.bincount(which)[owner])
    return ids.astype(np.int32), (shares / shares.sum()).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, fold: int, label: str, max_rows: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and labels of at most ``max_rows`` labelled documents outside the held-out fold: those of smallest hash.

    Of several labels of one id the mean decides; null labels and ids take no part.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    picked = known.where(remainder("doc_id", 4) != fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_rows).repartition(docs.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        for batch in batches:
            rows = [document_features(x) for x in byte_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.tobytes() for a, _ in rows], pa.binary()),
                                              pa.array([b.tobytes() for _, b in rows], pa.binary())], names=["doc_id", "y", "ids", "shares"])

    rows = texts.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, ids binary, shares binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.ids)))
    return [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.shares, np.float32), r.y) for r in rows]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.15, seed: int = 1) -> tuple[np.ndarray, float]:
    """Each bucket's part of the log odds of label 1, and their constant.  Without rows of both labels the score is a constant.

    Steps are scaled for each vector by the gradients it has seen, as frequent and rare n-grams get very unequal ones.
    """
    ones = sum(y for _, _, y in rows)
    if not rows or ones in (0, len(rows)):
        return np.zeros(BUCKETS, np.float32), float(np.log((ones + 1) / (len(rows) - ones + 1)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    seen = np.full(BUCKETS, 1e-8, np.float32)
    out, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    out_seen = np.full((DIM, 2), 1e-4, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            ids, shares, y = rows[i]
            hidden = shares @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            scores = hidden @ out + bias
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[y] -= 1
            slope = out @ p
            g = np.outer(hidden, p)
            out_seen += g * g
            out -= step * g / np.sqrt(out_seen)
            bias -= 0.1 * step * p
            if len(ids):
                seen[ids] += shares * shares * (slope @ slope) / DIM
                vectors[ids] -= (step * shares / np.sqrt(seen[ids]))[:, None] * slope
    apart = out[:, 1] - out[:, 0]
    return (vectors @ apart).astype(np.float32), float(bias[1] - bias[0])


def scorer(weights: np.ndarray, constant: float):
    """A function from texts to scores between 0 and 1."""
    index: dict[bytes, int] = {}
    sums, sizes = np.zeros(0), np.zeros(0)

    def run(texts: list[bytes]) -> np.ndarray:
        nonlocal sums, sizes
        if len(index) > _REMEMBER:
            index.clear()
            sums, sizes = np.zeros(0), np.zeros(0)
        known, rows = len(sums), []
        for text in texts:
            words = tokens(text)
            rows.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
        fresh = list(index)[known:]
        if fresh:
            bucket, owner = word_features(fresh)
            sums = np.concatenate([sums, np.bincount(owner, weights=weights[bucket], minlength=len(fresh))])
            sizes = np.concatenate([sizes, np.bincount(owner, minlength=len(fresh))])
        odds = np.array([sums[r].sum() / sizes[r].sum() if len(r) else 0.0 for r in rows]) + constant
        return 1 / (1 + np.exp(-odds))

    return run


def score(docs: DataFrame, labels: DataFrame, fold: int = 2, label: str = "quality", threshold: float = 0.7,
          max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted.  Only texts are read by the score; empty and null texts get the constant."""
    weights, constant = train(sample(docs, labels, fold, label, max_rows))
    model = docs.sparkSession.sparkContext.broadcast((weights, constant))  # BUCKETS numbers

    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(F.struct(*own).alias("doc"), text_of().alias("text"), (remainder("doc_id", 4) == fold).alias("held_out"))
    shape = rows.select("doc").schema

    def run(batches):
        rate = scorer(*model.value)
        for batch in batches:
            texts = byte_list(batch.column(batch.num_columns - 2))
            # short slices keep the remembered words bounded
            scores = np.concatenate([rate(texts[i:i + 64]) for i in range(0, len(texts), 64)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], batch.column(batch.num_columns - 1), pa.array(scores)],
                                             names=[*batch.schema.names[:-2], "held_out", "score"])

    out = rows.mapInArrow(run, shape.add("held_out", "boolean").add("score", "double"))
    return out.select(*[F.col("doc")[c].alias(c) for c in own], "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
