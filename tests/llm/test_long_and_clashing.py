"""Long repetitions of every form, and input columns named like those the operators make on the way."""

import re
import zlib

import numpy as np
import pytest

from soundlake.llm import packing, pieces, pii, quality, suffixes

NAMES = "_text _key _spans _was _any _numbers _own _found _new doc was any found new r1 r2 h c at size held ids2".split()


@pytest.mark.parametrize("unit,head,tail", [
    ("b.", "x@", "com"), ("bb.", "x@", ""), ("b-", "x@", ".com"), ("a.", "", "@b.com"), ("1.", "", "1"), ("4111 ", "", ""), ("12/", "", ""), ("A1 ", "DE89", ""), ("+1 ", "", ""), ("(", "+1", ""),
    ("key=", "", "A" * 20), ("x@b.com ", "", "")])
def test_repeated_forms_do_not_overflow(spark, unit, head, tail):
    text = head + unit * 50_000 + tail
    got = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1).transform(pii.pseudonymise).first()
    assert got.text is not None


def test_mail_domains_match_as_before(spark):
    old = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    rng = np.random.default_rng(1)
    texts = ["x@" + "".join(rng.choice(list("ab.-1.c"), rng.integers(1, 14))) + " end" for _ in range(800)]
    form = dict(pii.FORMS)["email"]
    from pyspark.sql import functions as F
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.regexp_extract_all("t", F.lit(form), F.lit(0)).alias("m")).collect()
    assert [r.m for r in sorted(got)] == [old.findall(t) for t in texts]


def test_runs_of_blanks_are_packed(spark):
    import public_tokenizers
    import tokenizers
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"a{' ' * 1_100_000}b", "\n" * 1_100_000 + "<|endoftext|>", "x" * 300_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(packing.pieces(rows).collect())
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        mine = [r for r in got if r.doc_id == i]
        assert sum(r.length for r in mine) == len(ids)
        assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)


def test_clashing_columns_pass(spark):
    shape = "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES)
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(["call 212-555-0143 or a@b.com " * 12, None, "", "call 212-555-0143 or a@b.com " * 12])]
    docs = spark.createDataFrame(rows, shape)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    for out in (pii.pseudonymise(docs), pieces.encode(docs), quality.score(docs, labels), suffixes.remove_repeats(docs)):
        got = {r.doc_id: r for r in out.collect()}
        assert all(got[i][n] == f"{n}{i}" for i in range(4) for n in NAMES), out.columns
    assert "212-555" not in pii.pseudonymise(docs).where("doc_id = 0").first().text
