"""Leader clustering against the greedy loop."""

import random
import time

import pytest

from featspark.operators import clusters as K


def greedy(rows, thr):
    """The sequential rule: in id order, join the first similar leader or lead."""
    leaders, home = [], {}
    for i, s in sorted(rows):
        s = s or ""
        for j, t in leaders:
            if s == t or (max(len(s), len(t)) and sum(a == b for a, b in zip(s, t)) / max(len(s), len(t)) > thr):
                home[i] = j
                break
        else:
            leaders.append((i, s))
            home[i] = i
    return home


def families(rng, n, letters, lengths):
    base = ["".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(max(2, n // 8))]
    rows = []
    for i in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(1 + len(s) // 4)):
            if s:
                s[rng.randrange(len(s))] = rng.choice(letters)
        if rng.random() < 0.3:
            s = s[:len(s) - rng.randrange(1 + len(s) // 5)]
        rows.append((i, "".join(s)))
    ids = list(range(n))
    rng.shuffle(ids)
    return [(ids[i], s) for i, s in rows]


def run(spark, rows, thr):
    got = K.cluster_sequences(spark.createDataFrame(rows, "protein_id long, sequence string"), thr).collect()
    assert len(got) == len(rows)
    home = {r.protein_id: r.leader_id for r in got}
    size = {}
    for j in home.values():
        size[j] = size.get(j, 0) + 1
    assert all(r.size == size[r.leader_id] for r in got)
    return home


@pytest.mark.parametrize("seed,letters,lengths,thr", [(1, "ACDEFGHIKL", [20, 31, 40], 0.8), (2, "AC", [6, 7, 11, 16], 0.8), (3, "ACDE", [12, 25], 0.6), (4, "ACD", [9, 30], 0.9)])
def test_equal_to_the_greedy_loop(spark, seed, letters, lengths, thr):
    rows = families(random.Random(seed), 160, letters, lengths)
    assert run(spark, rows, thr) == greedy(rows, thr)


def test_chain_of_neighbours(spark):
    """Each is similar to the next only: leaders and members alternate, found over several rounds."""
    s, rows = list("A" * 20), []
    for i in range(12):
        rows.append((i, "".join(s)))
        for k in range(3):
            s[(3 * i + k) % 20] = "BCDEFGHIKLMN"[i]
    assert run(spark, rows, 0.8) == greedy(rows, 0.8)


def test_edges_and_near_copies(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("ACDEFGHIKL") for _ in range(60))
    copies = [(100 + i, base[:i % 60] + "W" + base[i % 60 + 1:]) for i in range(400)]
    rows = [(1, None), (2, ""), (3, "A"), (4, "A"), (5, "B"), (6, base), (7, base), (8, "AB")] + copies
    assert run(spark, rows, 0.8) == greedy(rows, 0.8)
    assert K.cluster_sequences(spark.createDataFrame([], "protein_id long, sequence string")).count() == 0
    with pytest.raises(ValueError):
        K.cluster_sequences(spark.createDataFrame(rows, "protein_id long, sequence string"), 1.0)


def test_pieces_always_meet():
    for thr in (0.5, 0.6, 0.8, 0.9, 0.95):
        q = K.piece_length(thr)
        assert q >= 1 and all(m // q > -(-round((1 - thr) * m, 9) // 1) - 1 for m in range(q, 3000) if -(-round((1 - thr) * m, 9) // 1) > 1)


def test_pieces_and_candidates_are_not_shuffled(spark):
    """Unrelated sequences of few letters share many pieces; only the sequences travel, a few times each."""
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("ACD") for _ in range(600))) for i in range(150)] + [(200, "A" * 4), (201, "AAAAC")]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert run(spark, rows, 0.8) == greedy(rows, 0.8)
    time.sleep(1)
    assert written() - before < 1 << 20
    assert run(spark, [(1, "AAAAA"), (2, "AAAAAC"), (3, "AAAAC")], 0.8) == {1: 1, 2: 1, 3: 3}
