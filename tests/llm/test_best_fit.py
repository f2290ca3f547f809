"""Packing against brute force, bounds against exhaustive search, ids against the library."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from featspark.llm import best_fit, word_ids  # noqa: E402
from featspark.llm.bytepair import public_path  # noqa: E402

PATH = public_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def want_ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_plain_character(library):
    """Each character alone, between letters, after a letter and a digit: the short way equals the library."""
    coder = word_ids.word_ids(PATH)
    plain = [c for c in map(chr, range(0x110000)) if word_ids.PLAIN.fullmatch(c)]
    assert len(plain) > 30_000
    for k in range(0, len(plain), 64):
        group = plain[k:k + 64]
        text = "".join(f"a{c}b {c} 1{c}2{c.lower()}{c}." for c in group)
        assert coder.ids(text) == want_ids(library, text), (k, group)
    pairs = "".join(a + b for a, b in itertools.pairwise(plain))
    assert coder.ids(pairs) == want_ids(library, pairs)


def test_odd_texts(library):
    coder = word_ids.word_ids(PATH)
    rng = random.Random(3)
    letters = "abcDEéÑüß't's'LL <|startoftext|> \n\t\x85\xa0.,!?#123½日本語ΣσςİiÅ한🙂é‍\x1c"
    odd = ["", " ", "<|endoftext|>", "x<|startoftext|>y <|endoftext|", "ΟΔΟΣ ΣΑΣ", "İstanbul", "é", "\x1c\x1d", "'sa 't' I'LL", "x" * 5000]
    for t in odd + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]:
        assert coder.ids(t) == want_ids(library, t), repr(t)


def fewest(lengths, capacity):
    """Exhaustive: the least number of bins."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best[0]


def test_bound_is_below_the_optimum():
    rng, met = random.Random(1), 0
    for _ in range(60):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))]
        least = best_fit.lower_bound(np.bincount(lengths, minlength=21), 20)
        optimum = fewest(sorted(lengths, reverse=True), 20)
        assert least <= optimum
        met += least == optimum
    assert met > 50
    assert best_fit.lower_bound(np.bincount([11, 11, 11], minlength=21), 20) == 3  # a sum would give 2


def test_best_fit_is_best_fit():
    rng = random.Random(2)
    lengths = sorted((rng.randrange(1, 50) for _ in range(400)), reverse=True)
    node, bins = best_fit._Node(50), []
    for x in lengths:
        at, offset = node.put(x)
        fits = [50 - b for b in bins if 50 - b >= x]
        if fits:
            assert 50 - bins[at] == min(fits) and offset == bins[at]
            bins[at] += x
        else:
            assert at == len(bins) and offset == 0
            bins.append(x)


def check(docs, packing, library, capacity):
    rows = packing.sequences.collect()
    want = []
    for d in docs.collect():
        ids = want_ids(library, d.text or "") + b"\0\0\0\0"
        for k, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at:at + 4 * capacity]
            want.append((d.doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) == packing.n_sequences >= packing.bound
    return len(by)


def test_pack_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    p = best_fit.pack(docs, nodes=16)
    check(docs, p, library, 2048)
    assert p.n_sequences <= p.bound + 1 and p.rounds >= 1  # sixteen nodes need 98, the exchange closes their gaps


def test_exchange_never_loses(spark, library):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(["a"] * rng.randrange(0, 30))) for i in range(300)], "doc_id long, text string")
    one, many = best_fit.pack(docs, capacity=20, nodes=1), best_fit.pack(docs, capacity=20, nodes=12)
    assert check(docs, many, library, 20) <= check(docs, one, library, 20) + 1
    held = best_fit.pack(docs, capacity=20, nodes=12, node_rows=10)  # no exchange may take place
    assert held.rounds == 0 and check(docs, held, library, 20) >= many.n_sequences


def test_edges(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None), (None, "word " * 5000, "z"), (-7, "<|endoftext|> İ", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    check(docs, best_fit.pack(docs), library, 2048)
    none = best_fit.pack(docs.limit(0))
    assert none.sequences.count() == 0 and none.n_sequences == none.bound == 0
    assert best_fit.pack(docs.filter("doc_id is null").withColumn("text", F.lit("a " * 2047))).n_sequences == 1
