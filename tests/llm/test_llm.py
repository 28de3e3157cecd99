"""The training-data operators against plain versions on small tables with nulls, empty texts, ties, repeats and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from soundlake.llm import graphs, hmm, lines, multiindex, packing, pieces, pii, quality, simhash, suffixes

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, r1 string, h string, keep int, score string"


def corpus():
    rng = np.random.default_rng(5)
    bag = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 7))) for _ in range(150)]
    word = lambda n: " ".join(rng.choice(bag, n))
    passage = word(70)
    texts = [None, "", " \n\t", "one", "two words", "a" * 700, word(4000), passage, f"{word(40)}\n{passage}\n{word(30)}", f"{word(25)}\n{passage}"]
    texts += [f"{word(30)}\n  A Shared Line here \n{word(10)}\nshort", f"a shared line HERE\n{word(20)}\na shared line here"]
    base = word(120)
    texts += [base, base, base + " tail", base.upper(), "naïve café ▁ 日本 \U0001F600\0 " + word(20)]
    texts += [word(int(n)) for n in rng.integers(5, 60, 8)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, passage), (None, passage), (None, None), (3, "one")]
    return [(i, t, "en", "s", None, "r", "h", 1, "x") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SHAPE).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


def plain_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("crowded", [4096, 1])
def test_repeated_strings(docs, crowded):
    rows = [(r[0], (r[1] or "").encode()) for r in corpus()]
    seen = Counter(x[i:i + 200] for _, x in rows for i in range(len(x) - 199))
    want = Counter()
    for key, x in rows:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if seen[x[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        want[key, len(x), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = suffixes.remove_repeats(docs, 200, crowded).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_interval_borders():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 400).astype(np.int16)
    text[-1] = 0
    order = suffixes.suffix_order(text, 9)
    keys = [tuple(text[i:i + 9]) for i in order]
    assert keys == sorted(keys)
    assert suffixes.borders(text[order - 1], 5).tolist() == [i == 0 or keys[i][:5] != keys[i - 1][:5] for i in range(len(keys))]


def test_packing(docs):
    rows = packing.pack(docs, capacity=64).collect()
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for r in corpus():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        cuts = packing.cut_points(len(ids), 64)
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            assert b - a == 64 or k == 0
            want[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for at in held.values():
        at.sort()
        assert [o for o, _ in at] == [sum(n for _, n in at[:i]) for i in range(len(at))] and sum(n for _, n in at) <= 64
    assert len(held) <= 1.1 * sum(r.length for r in rows) / 64 + 2


def test_added_tokens_are_one_id(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "half <|endoftext of it"]
    ids = [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    assert [x.count(50256) for x in ids] == [1, 2, 0]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.length, r.ids_crc32) for r in got} == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


def test_packing_plan_is_near_its_bound():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.clip(rng.lognormal(5, 1, 30_000).astype(int), 1, 256), minlength=257)
    table, copies = packing.plan(counts, 256)
    assert ((table * copies[:, None]).sum(axis=0) == counts).all() and (table @ np.arange(257)).max() <= 256
    assert copies.sum() <= 1.01 * max((counts @ np.arange(257)) / 256, counts[129:].sum())


def test_packing_program_meets_its_bound():
    counts = np.zeros(1025, np.int64)
    counts[[400, 312, 224]] = 1000, 3000, 1000      # best fit takes 1625 sequences
    patterns, amounts, bound = packing.fractional(counts, 1024)
    assert amounts.sum() <= 1.005 * bound and bound <= 1556
    covered = np.zeros(3)
    for pattern, amount in zip(patterns, amounts):
        assert sum(times * (224, 312, 400)[k] for k, times in pattern) <= 1024
        for k, times in pattern:
            covered[k] += times * amount
    assert (covered >= np.array([1000, 3000, 1000]) - 1e-6).all()
    table, copies = packing.plan(counts)
    assert ((table * copies[:, None]).sum(axis=0) == counts).all() and copies.sum() <= 1560


@pytest.mark.parametrize("few", [{1: 1}, {1024: 3}, {1: 5, 1024: 2}, {600: 4}])
def test_packing_plans_of_few_pieces(few):
    counts = np.zeros(1025, np.int64)
    counts[list(few)] = list(few.values())
    table, copies = packing.plan(counts)
    assert ((table * copies[:, None]).sum(axis=0) == counts).all() and (table @ np.arange(1025)).max() <= 1024


def test_hidden_markov_scores(docs):
    rows = hmm.score(docs, passes=2, block_bytes=4000).collect()
    train, tokens = Counter(), []
    for r in corpus():
        words = [w for w in WORDS.findall((r[1] or "").encode().lower())] + [None]
        held = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0
        tokens.append((r[0], held, words))
        if not held:
            train.update(words)
    n, v = sum(train.values()), len(train)
    want = Counter((i, h, len(w), sum(train[x] > 0 for x in w), n, round(sum(np.log10((train[x] + .1) / (n + .1 * (v + 1))) for x in w), 6)) for i, h, w in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert sum(r.score for r in rows if not r.held_out) > sum(r.base_score for r in rows if not r.held_out)


def test_expectations_and_likelihood():
    start, move, emit = hmm._first_guess(np.ones(hmm.CLASSES))
    codes = [np.random.default_rng(n).integers(0, hmm.CLASSES, n) for n in (3, 1, 6, 6)]
    starts, moves, emissions, total = hmm.expectations(codes, start, move, emit)
    logs, all_moves = [], np.zeros_like(move)
    for c in codes:
        f, b = [start * emit[c[0]]], [np.ones(len(start))]
        for x in c[1:]:
            f.append(f[-1] @ move * emit[x])
        for x in c[:0:-1]:
            b.insert(0, move @ (emit[x] * b[0]))
        p = f[-1].sum()
        logs.append(np.log(p))
        for t in range(len(c) - 1):
            all_moves += np.outer(f[t], emit[c[t + 1]] * b[t + 1]) * move / p
    assert np.allclose(hmm.log_likelihoods(codes, start, move, emit), logs) and np.isclose(total, sum(logs), rtol=1e-5)
    assert np.allclose(moves, all_moves, atol=1e-5) and np.isclose(emissions.sum(), sum(map(len, codes)), rtol=1e-5) and np.isclose(starts.sum(), len(codes))


def test_quality_scores(spark, docs, nothing):
    rows = [(i, ("calm words here again " * 5) + str(i) if i % 2 else ("LOUD!! NOISE!! $$$ " * 5) + str(i)) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(texts, labels).collect()
    assert len(got) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == r.doc_id % 2 for r in got if r.held_out) >= .95 * sum(r.held_out for r in got)
    other = quality.score(docs, labels.limit(0))
    assert other.count() == len(corpus()) and set(docs.columns) - {"score"} <= set(other.columns)
    assert quality.score(nothing, labels).count() == 0


def test_fingerprints_and_groups(docs):
    rows = [(r[0], simhash.fingerprint((r[1] or "").encode())) for r in corpus()]
    import xxhash
    for (_, got), r in zip(rows, corpus()):
        w = WORDS.findall((r[1] or "").encode().lower())
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    roots = plain_components(len(rows), lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() <= 3)
    least = {g: min((rows[i][0] for i in range(len(rows)) if roots[i] == g and rows[i][0] is not None), default=None) for g in set(roots)}
    want = Counter((rows[i][0], rows[i][1], least[roots[i]]) for i in range(len(rows)))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_links_in_a_crowded_cell():
    rng = np.random.default_rng(2)
    own = np.unique(np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 7)).tolist())) for _ in range(300)], np.uint64))
    own, up = own[:200].view(np.int64), own[200:].view(np.int64)
    rows = np.concatenate([own, up]).view(np.uint64).tolist()
    want = plain_components(len(rows), lambda i, j: (i < len(own) or j < len(own)) and (rows[i] ^ rows[j]).bit_count() <= 3)
    at = {x: i for i, x in enumerate(rows)}
    linked = {(at[int(a)], at[int(b)]) for part in simhash._links_in_cell(own, up) for a, b in part}
    assert plain_components(len(rows), lambda i, j: (i, j) in linked or (j, i) in linked) == want


def test_line_dedup(docs):
    rows, holder = [(r[0], (r[1] or "").split("\n")) for r in corpus()], {}
    rank = lambda i: (i is None, i or 0)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    for i, parts in rows:
        for x in parts:
            if len(key(x)) >= 10:
                holder[key(x)] = min(holder.get(key(x), rank(i)), rank(i))
    want = Counter()
    for i, parts in rows:
        kept = [x for x in parts if len(key(x)) < 10 or holder[key(x)] == rank(i)]
        want[i, "\n".join(kept), len(parts), len(parts) - len(kept)] += 1
    got = lines.dedup_lines(docs).collect()
    assert Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got) == want


def test_pseudonyms(spark):
    texts = ["mail a.b@c.org, call +1 (310) 555-4510 or 310-555-4510", "card 4111 1111 1111 1111, not 4111 1111 1111 1112", "ip 10.0.0.255 not 10.0.0.256, v1.2.3",
             "born 1980-02-29 and 31.12.1999, not 1981-02-29", "ssn 078-05-1120 not 666-12-3456", "DE89 3704 0044 0532 0130 00 but DE88370400440532013000",
             "again 4111-1111-1111-1111 a.b@c.org", None, "", "plain 12345 text", 'token = "0123456789abcdef0123"']
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_found for i in range(len(texts))] == [3, 1, 1, 2, 1, 1, 2, 0, 0, 0, 1]
    assert got[7].text is None and got[8].text == "" and got[9].text == texts[9] and "4111 1111 1111 1112" in got[1].text
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", got[1].text)[1].replace(" ", "")
    assert card != "4111111111111111" and re.sub("-", "", got[6].text.split()[1]) == card
    digits = [int(c) for c in card[::-1]]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert got[6].text.split()[2] == got[0].text.split()[1].rstrip(",") and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[0].text)
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d and \d\d\.\d\d\.\d{4}, not 1981-02-29", got[3].text)
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", got[5].text)[0].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1 and "DE88370400440532013000" in got[5].text


def test_numbers_followed_by_what_looks_like_more_of_them(spark):
    texts = ["card 4111 1111 1111 1111 2024", "ES91 2100 0418 4502 0005 1332 NEXT WORD", "ES9121000418450200051332 NEXT"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0].endswith(" 2024") and "4111 1111" not in got[0]
    assert got[1].endswith(" NEXT WORD") and got[2].endswith(" NEXT") and "0418" not in got[1]
    assert got[1][:29].replace(" ", "") == got[2][:24]


def test_numbers_within_what_looks_like_a_longer_one(spark):
    texts = ["since 2019 415-555-0132", "2024 212-555-0143", "pin 1234 4111 1111 1111 1111", "4111 1111 1111 1111 5500 0000 0000 0004", "AB12 DE89 3704 0044 0532 0130 00 x",
             "DE89 3704 0044 0532 0130 00 ES91 2100 0418 4502 0005 1332", "+49 30 1234567 4111 1111 1111 1111", "1212 555 0143 9999", "1234 4111 1111 1111 1112", "4111 1111 1111 1111 4111 1111 1111 1111"]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_found for i in range(len(texts))] == [1, 1, 1, 2, 1, 2, 2, 1, 0, 2]
    assert [got[i].kinds for i in (0, 1, 2, 3, 4, 5, 6)] == [["phone"], ["phone"], ["card"], ["card"], ["iban"], ["iban"], ["card", "phone"]]
    assert got[2].text.startswith("pin 1234 ") and got[4].text.startswith("AB12 DE") and got[4].text.endswith(" x") and got[8].text == texts[8]
    assert all(len(got[i].text) == len(texts[i]) and "1111 1111" not in got[i].text and "0000 0000" not in got[i].text for i in range(8))
    assert got[9].text[:19] == got[9].text[20:] == got[2].text[9:]


def test_dates_stay_apart_in_each_notation(spark):
    from pyspark.sql import functions as F
    days = spark.range(146_097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d")).repartition(8)
    for form, some, many in (("dd/MM/yyyy", "day(d) > 12", 88_497), ("MM/dd/yyyy", "year(d) between 1980 and 1999", 7_305)):
        known, new = pii._date(F.col("text"), "k")
        out = days.where(some).select(F.date_format("d", form).alias("text")).select(known.alias("known"), new.alias("new"), F.to_date(F.try_to_timestamp(new, F.lit(form))).alias("back"))
        out = out.persist()
        row = out.agg(F.count("*").alias("n"), F.countDistinct("new").alias("different"), F.count("back").alias("valid"), F.bool_and("known").alias("known"))
        assert row.first().asDict() == {"n": many, "different": many, "valid": many, "known": True}
        if form == "dd/MM/yyyy":
            assert out.where("int(substr(new, 1, 2)) <= 12").isEmpty()


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F
    out = spark.range(189 * 7).select(pii.feistel(F.col("id") % 189, F.floor(F.col("id") / 189), 189, 7, "k", "x").alias("f"))
    assert out.distinct().count() == 189 * 7 and out.where("f.l < 0 or f.l >= 189 or f.r < 0 or f.r >= 7").isEmpty()


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 8))
    rows = [(i, base[i], int(i % 3)) for i in range(120)]
    rows += [(200 + i, base[i % 5] * 2 if i % 2 else base[i % 5] + rng.normal(0, .02, 8), int(i % 5 % 3)) for i in range(40)]
    rows += [(300, base[0], 0), (301, base[0], 0), (302, base[0], None), (303, None, 0), (304, np.zeros(8), 0), (305, np.full(8, np.nan), 0), (306, base[0][:4], 0), (None, base[1], 1)]
    return rows, spark.createDataFrame([(i, None if v is None else [float(x) for x in v], c, "x") for i, v, c in rows], "vec_id long, embedding array<double>, label int, node string")


def test_nearest_vectors(spark):
    rows, df = vectors(spark)
    good = [(i, v) for i, v, _ in rows if i is not None and v is not None and np.isfinite(v).all() and v.any()]
    got = defaultdict(list)
    for r in graphs.nearest(df, 20, 5, shard=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, v in good:
        if q % 20 == 0:
            want = sorted(((-float(v @ w), i) for i, w in good if i != q and len(w) == len(v)))[:5]
            hits += len({i for _, i in want} & {i for i, _ in got[q]}) / 5
            assert len(got[q]) == 5 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert hits >= .9 * len(got)
    assert graphs.nearest(df.limit(0)).count() == 0


def test_embedding_groups(spark):
    rows, df = vectors(spark)

    def linked(i, j):
        (a, v, x), (b, w, y) = rows[i], rows[j]
        if None in (a, b, x, y) or x != y or v is None or w is None or len(v) != len(w) or not (np.isfinite(v).all() and np.isfinite(w).all() and v.any() and w.any()):
            return False
        return v @ w / np.sqrt((v @ v) * (w @ w)) >= .98
    roots = plain_components(len(rows), linked)
    want = Counter((rows[i][0], sum(linked(i, j) for j in range(len(rows)) if j != i), min((rows[j][0] for j in range(len(rows)) if roots[j] == roots[i]), key=lambda x: (x is None, x))) for i in range(len(rows)))
    got = multiindex.near_duplicates(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert multiindex.near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_beside_a_dominant_group(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=-1, keepdims=True))
    base = unit(rng.normal(size=(1500, 16)))
    aside = rng.normal(size=base.shape)
    aside = unit(aside - (aside * base).sum(axis=1)[:, None] * base)
    cosine = rng.uniform(.981, .995, 1500)[:, None]
    hot = unit(unit(rng.normal(size=16)) + rng.normal(0, .001, (1500, 16)))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine ** 2) * aside, hot])
    near = unit(x) @ unit(x).T >= .98
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in multiindex.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    assert all(got[i + 1500].component_id == got[i].component_id for i in range(1500))


def test_sampled_pieces(docs):
    got = pieces.encode(docs).collect()
    assert all(r.lossless for r in got) and Counter(r.doc_id for r in got) == Counter(r[0] for r in corpus())
    again = pieces.encode(docs.repartition(5)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r.doc_id, tuple(r.ids)) for r in again)


def test_pieces_are_drawn_with_their_probability():
    import public_tokenizers
    v = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))

    def ways(u):
        return [((), 1.0)] if not u else [((v.ids[u[:k]], *q), v.weight[v.ids[u[:k]]] * w) for k in range(1, len(u) + 1) if u[:k] in v.ids for q, w in ways(u[k:])]
    every = ways(pieces.BLANK + "then")
    total, n = sum(w for _, w in every), 20_000
    drawn = Counter(tuple(x.tolist()) for x in pieces.Sampler(v).draw(["then"] * n, np.arange(n)))
    assert max(abs(drawn[q] / n - w / total) for q, w in every) < .02


def test_empty_tables(nothing):
    for made in (suffixes.remove_repeats(nothing), packing.pack(nothing), hmm.score(nothing), simhash.near_duplicates(nothing),
                 lines.dedup_lines(nothing), pii.pseudonymise(nothing), pieces.encode(nothing)):
        assert made.count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline
    stages = dict(corpus_pipeline.STAGES)
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars")
    after = stages["line dedup"](spark, wide, "")
    assert after.columns == wide.columns and after.count() == wide.count()
    once = stages["SimHash near-dedup"](spark, wide, "")
    assert once.columns == wide.columns
    assert once.count() == simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert stages["PII"](spark, wide, "").columns == wide.columns


def test_unlike_texts_stay_though_their_group_has_no_own_id(spark):
    import corpus_pipeline
    rng = np.random.default_rng(8)
    a, b, c, d = (" ".join(map(str, rng.integers(0, 10 ** 6, 40))) for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (4, c), (4, d), (5, d)]
    wide = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, wide, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, a), (None, b), (4, c), (4, d)])
