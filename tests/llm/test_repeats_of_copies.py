"""Repeated strings where contexts occur several times: bytes travel only where they decide, results are those of brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from soundlake.llm import suffixes


def removed(texts, length):
    seen = Counter(x[i:i + length] for x in texts for i in range(len(x) - length + 1))
    want = Counter()
    for key, x in enumerate(texts):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                gone[i:i + length] = True
        want[key, int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()] += 1
    return want


def near_copies():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    texts = []
    for times in (1, 2, 3, 5):
        base = word(1500)
        texts += [base] * times
        for _ in range(3):
            at, n = int(rng.integers(0, 1400)), int(rng.integers(1, 60))
            changed = base[:at] + word(n) + base[at + n:]
            texts += [changed, word(30) + changed + word(30)][:int(rng.integers(1, 3))]
        texts += [base[200:900] + base[100:700], base[:199], base[5:205]]
    return texts + ["ab" * 700, "ab" * 300 + "c" + "ab" * 300]


@pytest.mark.parametrize("crowded", [4096, 2, 1])
def test_near_copies(spark, crowded):
    texts = near_copies()
    got = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 200, crowded)
    assert Counter(map(tuple, got.select("doc_id", "n_removed", "n_spans", "kept_sha256").collect())) == removed([t.encode() for t in texts], 200)


def test_bytes_of_whole_copies_stay(spark, monkeypatch):
    made, cut = [], suffixes.cut
    monkeypatch.setattr(suffixes, "cut", lambda df: made.append(cut(df)) or made[-1])
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefgh "), 3000)) for _ in range(6)] * 4
    got = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("n_removed").collect()
    assert [r[0] for r in got] == [3000] * 24
    assert next(df for df in made if "context" in df.columns).count() == 0


@pytest.mark.parametrize("rows,text", [(1, 1), (7, 300), (1000, 2000), (1000, 1 << 17)])
def test_anchors_stay_together(monkeypatch, rows, text):
    monkeypatch.setattr(suffixes, "TEXT", text)
    rng = np.random.default_rng(6)
    length, table = 8, []
    for h in range(40):
        base = rng.integers(97, 100, 40).astype(np.uint8).tobytes()
        for c in range(int(rng.integers(1, 7))):
            lo = int(rng.integers(0, 20))
            part = base[lo:lo + int(rng.integers(length, 21))] if c % 2 else rng.integers(97, 99, 12).astype(np.uint8).tobytes()
            table.append((h, c, len(part) - length + 1, part, int(rng.integers(1, 3))))
    # strings count inside a transform only, so each anchor's must be its own here
    table = [(h, c, size, bytes(b + 4 * h for b in part) if h < 38 else bytes(b - 97 + 3 * (h - 38) for b in part), n) for h, c, size, part, n in table]
    seen = defaultdict(Counter)
    for h, _, size, part, n in table:
        for k in range(size):
            seen[h][part[k:k + length]] += n
    want = {}
    for h, c, size, part, n in table:
        flags = np.array([n == 1 and seen[h][part[k:k + length]] > 1 for k in range(size)])
        if flags.any():
            want[h, c] = [{"a": a, "b": b} for a, b in suffixes._runs(flags)]
    h, c, size, part, n = zip(*table)
    whole = pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(size, pa.int32()), pa.array(part, pa.binary()), pa.array(n, pa.int64())],
                                       names=["h", "c", "size", "context", "n"])
    batches = [whole.slice(lo, rows) for lo in range(0, whole.num_rows, rows)]
    got = {(r["h"], r["c"]): r["runs"] for b in suffixes._expand(length)(iter(batches)) for r in b.to_pylist()}
    assert got == want
