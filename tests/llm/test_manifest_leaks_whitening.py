"""Manifest, decontamination and whitening against plain versions, with nulls, ties, repeats, long texts, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from soundlake.llm import leaks, merkle, queries, whitening


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- manifest -----------------------------------------------------------------------------------------------------------------

CLASH = "grp string, idx string, n string, digest string, path string, _key string, _group string, top string, leaf string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def manifest_rows():
    rows = [(i, f"text {i}", "en", "web", 5 + i) for i in range(23)]
    rows += [(i, "é" * i, None, None, None) for i in range(7)]
    rows += [(50, None, "", "a", 0), (51, "", "ü", "b", 1), (52, "x" * 2_000_000, "ü", "b", 1), (None, "no id", "ü", None, 3)]
    rows += [(3, "other text, same id", "en", "web", 2), (3, "text 3", "en", "web", 8), (3, "text 3", "en", "web", 8)]
    return [(*r, *["clash"] * 9) for r in rows]


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, add=0):
    doc_id, text, lang, source, n = row[:5]
    values = (doc_id, source, lang, None if n is None else n + add, text)
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, fanout):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(paths)):
            first = at[i] - at[i] % fanout
            run = nodes[first:first + fanout]
            paths[i].append((run[:at[i] - first], run[at[i] - first + 1:]))
            at[i] //= fanout
        nodes = [H("".join(nodes[k:k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    tampered = {id(r): leaf_of(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)) for r in rows}
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r), tampered[id(r)])) for lang in langs}
    trees = {lang: plain_tree([leaf_of(r) for r in own[lang]], fanout) for lang in langs}
    root, upper = plain_tree([trees[lang][0] for lang in langs], fanout)
    out = []
    for lang, top in zip(langs, upper):
        for r, path in zip(own[lang], trees[lang][1]):
            now = tampered[id(r)]
            for before, after in path + top:
                now = H("".join(before) + now + "".join(after))
            proof = H("".join("".join(a) + "".join(b) for a, b in path + top))
            out.append((r[0], leaf_of(r), trees[lang][0], root, proof, now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest(spark, fanout):
    rows = manifest_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = rows_of(merkle.tamper_check(df, fanout))
    assert got == plain_manifest(rows, fanout)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_and_none(spark):
    one = manifest_rows()[:1]
    assert rows_of(merkle.tamper_check(spark.createDataFrame(one, DOCS))) == plain_manifest(one, 2)
    none = merkle.tamper_check(spark.createDataFrame([], DOCS))
    assert none.collect() == [] and none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_many_groups_of_any_size(spark):
    rows = [(i, "t", f"g{i * i % 41}", "s", 1, *["clash"] * 9) for i in range(160)]
    assert rows_of(merkle.tamper_check(spark.createDataFrame(rows, DOCS).repartition(4))) == plain_manifest(rows, 2)


# --- decontamination ----------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = "doc_id long, text string, words string, spans string, items string, doc string, r1 long, n_words long"


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_report(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        ws = words_of(text)
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1) if ws else ():
            windows[tuple(ws[k:k + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        ws, hit, found = words_of(text), set(), set()
        for n in lengths:
            for k in range(len(ws) - n + 1):
                if (key := tuple(ws[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(ws), len(hit), len(names), H(",".join(names)), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(3)
    bag = ["a", "b", "c", "Dé", "e9", "日本", "x" * 30]

    def text(n):
        return "".join(rng.choice(bag) + rng.choice([" ", ", ", "\n", "\0"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(None, None), (1, ""), (2, "a" * 3_000_000), (3, text(6000)), (3, "a b c"), (None, None), (None, docs[5][1]), (5, docs[5][1])]
    items = [(i, text(rng.randint(0, 14))) for i in range(40)]
    items += [(100, text(25)), (None, "c c c c"), (101, None), (102, docs[7][1]), (103, "A" * 3_000_000), (102, "a b c"), (104, docs[63][1]), (105, " ")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, "w", "s", "i", "d", 1, 2) for r in docs], TEXTS).repartition(3)
    return d, spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string").repartition(2)


@pytest.mark.parametrize("settings", [{}, {"block_words": 700}, {"window": 3}])
def test_decontamination(spark, leaked, settings):
    d, b = frames(spark, *leaked)
    assert rows_of(leaks.leak_report(d, b, **settings)) == plain_report(*leaked, settings.get("window", 10))


def test_small_shards_and_segments(leaked, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(leaks, "SHARD", 64)
    monkeypatch.setattr(leaks, "PIECE", 37)
    docs, items = leaked
    docs = [d for d in docs if len(d[1] or "") < 1_000_000]
    items = [x for x in items if len(words_of(x[1])) and len(x[1]) < 1_000_000]
    vocabulary = {}

    def hashes(texts):
        data = "".join(texts).encode()
        offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
        out = [[] for _ in texts]
        for number, h in leaks.word_hashes(np.frombuffer(data, np.uint8), offsets):
            for i, x in zip(number.tolist(), h.tolist()):
                out[i].append(x)
        for t, hs in zip(texts, out):
            assert len(hs) == len(words_of(t))
            for w, x in zip(words_of(t), hs):
                assert vocabulary.setdefault(w, x) == x
        return out
    parts = hashes([t for _, t in items])
    table = pa.table({"item": [str(i) for i, _ in items], "start": [0] * len(items), "words": [np.array(p, np.uint64).tobytes() for p in parts]})
    block = leaks.Block(table, 10)
    texts = [t or "" for _, t in docs]
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    words, begin, n = leaks._numbered(block, np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    hit, pairs = leaks._hits(block, words, begin)
    got = [(int(k), int(hit[b:b + k].sum()), len({items[s][0] for t, s in pairs.T if t == i})) for i, (b, k) in enumerate(zip(begin, n))]
    want = {(d, i): r for i, (d, t) in enumerate(docs) for r in plain_report([(d, t)], [(x if x is not None else -1, t2) for x, t2 in items])}
    assert got == [want[d, i][1:4] for i, (d, _) in enumerate(docs)]
    assert len(set(vocabulary.values())) == len(vocabulary)


def test_longest_matches(spark, leaked):
    docs, items = leaked
    docs, items = [d for d in docs if len(words_of(d[1])) < 100], [x for x in items if 0 < len(words_of(x[1])) < 30 and x[0] not in (None, 102)]
    d, b = frames(spark, docs, items)
    got = {int(r.item_id): r for r in leaks.longest_matches(d, b).collect()}
    by_id = defaultdict(list)
    for i, t in docs:
        by_id[str(i)].append(words_of(t))
    for item, text in items:
        ws, most = words_of(text), 0
        for i in range(len(ws)):
            for _, t in docs:
                dw = words_of(t)
                for k in range(len(dw)):
                    n = 0
                    while i + n < len(ws) and k + n < len(dw) and ws[i + n] == dw[k + n]:
                        n += 1
                    most = max(most, n)
        r = got.get(item)
        assert (r.length if r else 0) == most
        if r:
            assert any(dw[r.doc_start:r.doc_start + most] == ws[r.item_start:r.item_start + most] for dw in by_id[r.doc_id])


def test_removal_and_empty_tables(spark, leaked):
    docs, items = leaked
    d, b = frames(spark, docs, items)
    kept = leaks.remove(d, b)
    assert kept.columns == d.columns
    clean = sorted(repr(x[0]) for x in plain_report(docs, items) if not x[-1])
    assert sorted(repr(r.doc_id) for r in kept.collect()) == clean
    assert rows_of(leaks.leak_report(d, b.where("false"))) == plain_report(docs, [])
    assert leaks.leak_report(d.where("false"), b).collect() == []
    assert leaks.longest_matches(d.where("false"), b).collect() == []


# --- whitening ----------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x string, part string, _v string, component string"


def usable(rows):
    ok = [r for r in rows if r[1] is not None and len(r[1]) and all(v is not None and np.isfinite(v) and abs(v) <= whitening.LARGEST for v in r[1])]
    sizes = [len(r[1]) for r in ok]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    return [r for r in ok if len(r[1]) == size]


def check_whitening(got, rows, parts=16):
    rows = usable(rows)
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(parts, int((e > 1e-10 * e[0]).sum()))
    assert sorted((repr(r.vec_id), r.component) for r in got) == sorted((repr(r[0]), j) for r in rows for j in range(1, k + 1))
    want = ((x * n - s) / n) @ q[:, :k] / np.sqrt(e[:k])
    exact = ((x.astype(object) * n - s) ** 2).sum(1)
    by_row = defaultdict(list)
    for r, w, d in zip(rows, want, exact):
        by_row[r[0]].append((int(d), np.abs(w)))
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
        assert any(d == r.deviation and abs(abs(r.whitened) - w[r.component - 1]) < 1e-8 for d, w in by_row[r.vec_id])


def vectors(d, n, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * np.linspace(.2, 3, d)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, []), (n + 2, [float("nan")] * d), (n + 3, [None] + x[0][1:]), (n + 4, [float("inf")] + x[0][1:]), (n + 5, [0.0] * d),
             (n + 6, x[0]), (None, x[1]), (None, x[1]), (3, x[4]), (n + 7, x[0] + [1.0]), (n + 8, [3e38] + x[0][1:])]
    return rows + [(n + 9 + i, x[2]) for i in range(30)]


@pytest.mark.parametrize("d,n", [(20, 300), (5, 60), (24, 9)])
def test_whitening(spark, d, n):
    rows = vectors(d, n)
    df = spark.createDataFrame([(*r, 0, "x", "p", "v", "c") for r in rows], VECTORS).repartition(6)
    check_whitening(whitening.whiten(df).collect(), rows)


def test_whitening_without_variance(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(none).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], 0, "x", "p", "v", "c") for i in range(4)], VECTORS)
    assert whitening.whiten(same).collect() == []
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(8)]
    got = whitening.whiten(spark.createDataFrame([(*r, 0, "x", "p", "v", "c") for r in line], VECTORS)).collect()
    check_whitening(got, line)
    assert {r.component for r in got} == {1}


def test_spectra_with_equal_values_and_merges():
    rng = np.random.default_rng(2)
    for d, n in ((6, 40), (12, 5), (3, 30)):
        x = np.floor(rng.normal(size=(n, d)) * 3)
        x[:, -1] = x[:, 0]
        x = np.r_[x, np.eye(d) * 4, -np.eye(d) * 4]  # equal eigenvalues
        parts = [whitening.Spectrum(d) for _ in range(3)]
        for i, v in enumerate(x):
            parts[i % 3].add(v)
        total = whitening.Spectrum(d)
        for p in parts:
            total.merge(whitening.Spectrum.unpacked(p.packed(), d))
        c = (x - x.mean(0)).T @ (x - x.mean(0))
        assert np.abs(total.vectors * total.values @ total.vectors.T - c).max() < 1e-9 * np.abs(c).max()
        assert np.abs(total.vectors.T @ total.vectors - np.eye(len(total.values))).max() < 1e-10


def test_secular_roots():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        d = np.cumsum(rng.uniform(1e-6, 1, n))
        z = rng.normal(size=n) * 10.0 ** rng.uniform(-4, 1, n)
        origin, mu = whitening.secular_roots(d, z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.abs(d[origin] + mu - want).max() < 1e-12 * want[-1]


def test_whitening_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(queries.QUERIES["op11_embedding_whitening"](spark, sf_dir).collect(), rows)
