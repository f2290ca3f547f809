"""Spelling variants against plain Python: near words by comparing all pairs, chains by walking."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featspark.llm import variants as V


def near(a, b):
    """Exactly one inserted, deleted or replaced character."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({ord(c): c.lower() for c in V.UPPER})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def expected(words):
    out = set()
    form, found = {}, {}
    for w, n in words.items():
        mine = [x for x in words if near(w, x)]
        best = min(mine, key=lambda x: (-words[x], x), default=None)
        found[w] = len(mine)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, found[w], words.get(form[w])))
    return out


def some_words(rng, n, letters="abcdéÀ×"):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(n // 3)]
    out = list(base)
    for w in base * 2:
        k, c = rng.randrange(len(w)), rng.choice(letters)
        out.append(rng.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]]))
    return out


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefé×ÿ"), (3, "abc")])
def test_index_against_comparison(seed, letters):
    rng = random.Random(seed)
    words = sorted({w for w in some_words(rng, 400, letters) if len(w) >= 4})
    asked = words + ["zz" + words[0], words[1][:-1] + "q"]
    queries = [(w, p) for w in asked for p in "10"]
    who, what = V.near_words(queries, words, lambda q, e: q[0] != e and V.common_path(q[0], e, 1) == q[1])
    got = [(queries[q][0], words[e]) for q, e in zip(who.tolist(), what.tolist())]
    assert len(got) == len(set(got))  # each pair once
    assert set(got) == {(a, b) for a in asked for b in words if near(a, b)}


def test_interval_counts():
    rng = random.Random(4)
    import numpy as np
    text = np.array([0, *(rng.randrange(4) for _ in range(300)), 0])
    index, s = V.BothWays(text, 4), "".join(map(str, text))
    for _ in range(100):
        low = back = np.zeros(1, np.int64)
        size, pattern = np.array([len(text)]), ""
        for _ in range(5):
            way, c = rng.randrange(2), rng.randrange(4)
            low, back, size = index.step(way, low, back, size, np.array([c]))
            pattern = str(c) + pattern if way == 0 else pattern + str(c)
            whole = s + s[:len(pattern) - 1]  # rotations
            want = {k for k in range(len(s)) if whole.startswith(pattern, k)}
            assert size[0] == len(want)
            if not want:
                break
            assert set(index.suffixes[low[0]:low[0] + size[0]].tolist()) == want


def test_paths_lead_pairs_to_one_shard():
    rng = random.Random(5)
    words = sorted({w for w in some_words(rng, 150, "abc") if len(w) >= 5})
    for a in words:
        for b in words:
            if near(a, b):
                for depth in (1, 2, 3):
                    path = V.common_path(a, b, depth)
                    assert V.query_key(a, path) in V.entry_keys(b, path)


@pytest.mark.parametrize("letters,hot", [(60_000, 2_000), (300, 3)])
def test_words_against_brute_force(spark, letters, hot):
    rng = random.Random(6)
    base = some_words(rng, 200) + ["common" + w for w in some_words(rng, 60, "abcd")]
    text = [(rng.randrange(50), " ".join(rng.choices(base, k=60)) + rng.choice([" ", ".", "-"]) + rng.choice(base).upper()) for _ in range(80)]
    rows = text + [(None, text[0][1]), (1, None), (2, ""), text[1], text[1], (6, "kettl " * 4 + "kettle " * 9 + "kettles " * 20), (-5, "straße Straße STRASSE straße straße, über ÜBER")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as word", "7 as n")
    words = V.word_counts(docs)
    assert {r.word: r.n for r in words.collect()} == counted(rows)
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in V.forms(V.near_counts(words, letters, hot)).collect()}
    assert got == expected(counted(rows))
    assert any(g[1] != g[2] for g in got if g[1])  # chains of more than one step


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = V.variants(docs).collect()
    want = expected(counted([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert V.variants(docs.limit(0)).count() == 0
    assert V.variants(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
