"""Finding of the fourth review: sequences were shuffled to as many tasks as their lengths have blocks."""

import random
import time

import numpy as np
import pytest

from featspark.operators import clusters as K
from test_clusters import greedy

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def relatives(rng, n, lengths, letters=LETTERS):
    """Families whose members differ from their base in about as many places as similar sequences may."""
    base = ["".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(n // 10)]
    out = []
    for _ in range(n):
        x = list(rng.choice(base))
        for k in rng.sample(range(len(x)), int(len(x) * rng.choice([0.02, 0.1, 0.15, 0.19, 0.2, 0.21]))):
            x[k] = rng.choice(letters)
        out.append("".join(x[:len(x) - rng.randrange(1 + len(x) // 5) * (rng.random() < 0.3)]))
    return out


def test_each_letter_is_shuffled_a_few_times_only(spark):
    rng = random.Random(41)
    rows = [(i, "".join(rng.choices(LETTERS, k=rng.randrange(1000, 3000)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "protein_id long, sequence string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    time.sleep(1)
    before = written()
    assert K.cluster_sequences(df).filter("protein_id <> leader_id").count() == 0
    time.sleep(1)
    assert written() - before < 3 * sum(len(x) for _, x in rows)


@pytest.mark.parametrize("seed,lengths,letters,thr,crowd", [(1, [30, 60], "ACDE", 0.8, 4), (2, [400, 480], LETTERS, 0.8, 4), (3, [1700, 2000], LETTERS, 0.8, 1024), (4, [600, 700], LETTERS, 0.6, 4), (5, [900], LETTERS, 0.87, 4), (6, [7, 8, 9], "AC", 0.8, 4)])
def test_some_comb_has_every_similar_pair(monkeypatch, seed, lengths, letters, thr, crowd):
    """Up to the last row that all combs tell of, no similar pair is missing."""
    monkeypatch.setattr(K, "CROWD", crowd)
    monkeypatch.setattr(K, "FEW", 2)
    monkeypatch.setattr(K, "AHEAD", 3)
    monkeypatch.setattr(K, "KEYS", 5000)
    monkeypatch.setattr(K, "PAIRS", 100)
    rng = random.Random(seed)
    seqs = list(dict.fromkeys(x for x in relatives(rng, 150, lengths, letters) if len(x) > thr * min(lengths)))
    n = np.array([len(x) for x in seqs])
    upper = n[n >= min(lengths)]
    how = K._group(len(n), int(upper.min()), int(upper.max()), thr)
    first = np.array([rng.choice([0, 0, i // 2, len(n)]) for i in range(len(n))])
    for owner in (None, np.array([rng.randrange(2) for _ in n])):
        found, last = set(), np.full(len(n), len(n))
        for comb in range(how.combs):
            cells = np.zeros((len(n), how.slots), np.uint16)
            for row, x in zip(cells, seqs):
                p = K._pieces(K._codes(x), how.q)[comb::how.combs]
                row[:len(p)] = p
            x, y, end = K._pairs(cells, n, first, owner, comb, how, thr, 1)
            found |= set(zip(x.tolist(), y.tolist()))
            last = np.minimum(last, end)
        assert how.combs > 1 or seed not in (2, 3)
        similar = 0
        for x in range(len(n)):
            for y in range(first[x], min(x, last[x] + 1)):
                if max(n[x], n[y]) >= how.shortest and (owner is None or owner[x] != owner[y]) and sum(a == b for a, b in zip(seqs[x], seqs[y])) / max(n[x], n[y]) > thr:
                    assert (x, y) in found
                    similar += 1
        assert similar


@pytest.mark.parametrize("text", [False, True])
def test_groups_cut_into_blocks_and_ids_that_are_no_numbers(spark, monkeypatch, text):
    monkeypatch.setattr(K, "ROWS", 60)
    monkeypatch.setattr(K, "NARROW", 3)
    rng = random.Random(7)
    rows = list(zip(rng.sample(range(1000), 200), relatives(rng, 200, [150, 180, 420])))
    rows = [(f"p{i:04d}", x) for i, x in rows] if text else rows
    got = K.cluster_sequences(spark.createDataFrame(rows, f"protein_id {'string' if text else 'int'}, sequence string"))
    assert got.schema["leader_id"].dataType == got.schema["protein_id"].dataType
    want = greedy(rows, 0.8)
    assert {r.protein_id: r.leader_id for r in got.collect()} == want and len(set(want.values())) < 170
