"""Token operators against the tokenizers library: whole texts, every prefix, round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from featspark.llm import bpe_split, prefix_tokens  # noqa: E402
from featspark.llm.bytepair import public_path  # noqa: E402

PATH = public_path()
ODD = ["", " ", "  ", "a  b", "x \n\n y", "\n\n\n", "don't we'll they're I'd 'tis ''", "'ll", "<|endoftext|>", "a<|endoftext|>b <|endoftext|", "naïve café ß Ñandú ǅ", "日本語 テスト", "12³ ½ 3.14",
       "a b c", "\x1c\x1d \x85", "ÀÖ×÷øɏɐ", "🙂🙂 ok", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "#### $$$ *** &&&", "\t tab\r\nend ", "hello worlds", "é"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    letters = "abcdeéñüs't l<|>endoftext \n\n  .,!?#12345日本🙂"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)]


def test_every_prefix(library):
    c = prefix_tokens.counter(PATH)
    for t in texts():
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert c.counts(t).tolist() == want, repr(t)


def test_encode_decode(library):
    c = bpe_split.codec(PATH)
    for t in [*texts(), "word " * 3000, "x" * 20000]:
        e = library.encode(t, add_special_tokens=False)
        assert c.encode(t) == e.ids, repr(t)
        assert c.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False), repr(t)


def test_forced_boundaries_are_outside_all_tokens():
    v = bpe_split.codec(PATH).v
    for word in ["naïve", "日本語", "hello", "#$%&"]:
        parts = bpe_split.fragments(v, word.encode())
        assert b"".join(parts) == word.encode()
        assert all(a[-1:] + b[:1] not in v.joined for a, b in zip(parts, parts[1:]))


def test_queries_on_edges(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None), (None, "word " * 600, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.n_bytes, r.over_limit, r.fit_chars) for r in prefix_tokens.token_counts(docs).collect()}
    long = len(library.encode("word " * 600, add_special_tokens=False).ids)
    assert {(1, 0, 0, False, 0), (2, 0, 0, False, 0), (3, 2, 3, False, 3)} <= got
    assert [g for g in got if g[0] is None][0][1:4] == (long, 3000, True)
    both = bpe_split.decode(bpe_split.encode(docs))
    assert sorted(both.filter("doc_id = 3").select("text").collect()) == [("a b",), ("a b",)]
    r = bpe_split.round_trip(docs).filter(F.col("doc_id") == 2).first()
    assert r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256
    assert bpe_split.round_trip(docs.limit(0)).count() == 0 and prefix_tokens.token_counts(docs.limit(0)).count() == 0


def test_budget():
    c = prefix_tokens.counter(PATH).counts("one two three four")
    assert prefix_tokens.fitting_chars(c, 2) == len("one two") and prefix_tokens.fitting_chars(np.array([0]), 5) == 0
