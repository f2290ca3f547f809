"""Near duplicates, chunk passages and the mix against brute force; edge cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from featspark.llm import chunk_dedup, mix_sources, prob_minhash


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def shingle_set(text):
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    """Single linkage over all pairs, for small tables."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    return sorted(tuple(sorted(g, key=lambda d: (d is None, d))) for g in groups.values())


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    a, b = (e[:200], rng.random(200) * 3 + 0.2), (e[60:260], rng.random(200) * 3 + 0.2)
    a[1][60:], b[1][:140] = (x := rng.random(140) + 0.5), x * (1 + 0.2 * rng.random(140))
    wa, wb = dict(zip(*a)), dict(zip(*b))
    want = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in {*wa, *wb}) for i in wa.keys() & wb.keys())
    sig = prob_minhash.signatures([a, b], 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    assert np.array_equal(prob_minhash.signatures([b], 4096)[0], sig[1])


def edited(rng, w, share):
    w = list(w)
    for i in rng.sample(range(len(w)), int(len(w) * share)):
        w[i] = "".join(rng.choice("xyz") for _ in range(6))
    return w


def near_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 120))) for i in range(30)]
    base = rows[0][1].split()
    rows += [(100 + i, " ".join(edited(rng, base, 0.02))) for i in range(40)]
    chain = words(rng, 200)
    for i in range(6):  # neighbours are similar, the ends are not
        rows.append((200 + i, " ".join(chain[i * 12:i * 12 + 140])))
    rows += [(300, rows[3][1]), (301, rows[3][1].upper()), (302, None), (303, " "), (304, "one two"), (305, "one  two"), (306, "one"), (None, "one two"), (307, rows[5][1]), (307, rows[5][1]), (400, " ".join(words(rng, 9000)))]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, class_id int, component string").repartition(5)
    got = prob_minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in got:
        groups[r.class_id].append(r)
    assert sorted(tuple(sorted((r.doc_id for r in g), key=lambda d: (d is None, d))) for g in groups.values()) == brute_classes(rows)
    for g in groups.values():
        assert sum(r.kept for r in g) == 1 and {r.class_size for r in g} == {len(g)} and [r.doc_id for r in g if r.kept] == [g[0].class_id]
    stay = prob_minhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert prob_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_borders_resist_shifts():
    rng = random.Random(1)
    text = " ".join(words(rng, 800)).encode()
    a = chunk_dedup.borders(text)
    b = chunk_dedup.borders(b"inserted words " + text)
    assert len(set(a) & {x - 15 for x in b}) >= len(a) - 3 and a[-1] == len(text) and len(a) > len(text) / 80
    h = chunk_dedup.gear_hashes(np.frombuffer(text, np.uint8))
    want = 0
    for i, c in enumerate(text[:300]):
        want = ((want << 1) + int(chunk_dedup.GEAR[c])) & 0xFFFFFFFF
        assert int(h[i]) == want


def test_passages(spark):
    rng = random.Random(8)
    shared = [" ".join(words(rng, 55)) for _ in range(20)]
    rows = [(i, " ".join(words(rng, 150)) + ". " + shared[i % 20] + " " + " ".join(words(rng, 100))) for i in range(60)]
    rows += [(100 + i, " ".join(words(rng, 200))) for i in range(40)]
    line = " ".join(words(rng, 5))
    rows += [(200 + i, " ".join(words(rng, 60)) + "\n" + line) for i in range(10)]
    own = " ".join(words(rng, 60))
    rows += [(300, own + "\n" + own), (301, None), (302, ""), (None, shared[0] + " " + " ".join(words(rng, 20))), (5, rows[5][1])]
    docs = spark.createDataFrame([(d, t, [1], 2) for d, t in rows], "doc_id long, text string, words array<int>, number int").repartition(4)
    got = chunk_dedup.passages(docs).collect()
    found = {r.doc_id for r in got}
    assert len(found & set(range(60))) >= 54 and found <= {*range(60), None}
    text = dict(rows)
    for r in got:
        assert r.n_words >= 12 and r.kept == (r.doc_id == r.first_doc_id or (r.doc_id is None and r.first_doc_id is None))
        if r.doc_id is not None and not r.kept and r.doc_id != 5:
            assert text[r.doc_id].encode()[r.start_byte:r.end_byte] in text[r.first_doc_id].encode()
    assert chunk_dedup.passages(docs.limit(0)).count() == 0


def brute_mix(rows, most=3.0):
    """Targets by sharing and resharing; then, per source, whole copies and documents in rank order where they fit."""
    by = defaultdict(int)
    for _, source, size in rows:
        by[source] += size
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(by.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > most * by[s] + 1e-9]
        if not over:
            target |= {s: weight[s] * unit for s in open_}
            break
        for s in over:
            target[s] = most * by[s]
            left -= target[s]
            open_.discard(s)
    return by, target


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c", "d", None, "Z"]), rng.choice([0, 3, 20, 50, 200, 1500])) for i in range(300)] + [(1000 + i, "tiny", 4) for i in range(2)] + [(7, "a", 30), (7, "a", 30), (None, "b", 10), (None, "b", 10)]
    docs = spark.createDataFrame([(d, " ".join(["w"] * n) if n else None, s, 5) for d, s, n in rows], "doc_id long, text string, source string, size int").repartition(3)
    got = mix_sources.mix(docs).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.source, r.size) for r in got) == Counter(rows)
    by, target = brute_mix(rows)
    taken, largest = defaultdict(int), {s: max(n for _, t, n in rows if t == s) for s in by}
    for r in got:
        assert r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= max(largest[s] / 2, 0.02 * target[s]), s
    again = mix_sources.mix(docs.repartition(6)).collect()
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in got if r.doc_id not in (7, None)) == Counter((r.doc_id, r.source, r.size, r.copies) for r in again if r.doc_id not in (7, None))
    rows_out = mix_sources.mixed_documents(docs)
    assert rows_out.columns == docs.columns and rows_out.count() == sum(r.copies for r in got)
    assert mix_sources.mix(docs.limit(0)).count() == 0


def test_mix_takes_the_smallest_ranks(spark):
    """Without giants and gaps to fill, the chosen documents are exactly those of the smallest Pareto ranks."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    got = mix_sources.mix(docs, seed=3).toPandas()
    for _, g in got.groupby("source"):
        p = float(g.target.iloc[0] / g.source_size.iloc[0]) % 1
        u = spark.createDataFrame(g[["doc_id"]]).select("doc_id", ((F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).toPandas().set_index("doc_id").u
        extra = g.copies - int(g.target.iloc[0] / g.source_size.iloc[0])
        chosen, left = u[g.doc_id[extra == 1].values], u[g.doc_id[extra == 0].values]
        assert chosen.max() < left.min() and abs(len(chosen) - p * len(g)) <= 1


@pytest.mark.parametrize("source", ["only", None])
def test_mix_one_source(spark, source):
    docs = spark.createDataFrame([(1, "a b", source), (2, None, source)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.copies, r.taken) for r in mix_sources.mix(docs).collect()) == [(1, 1, 2), (2, 1, 0)]


def test_repeated_lines_are_candidates(spark):
    """Repeats change no set similarity, so pairs with a block repeated in one copy only are found like others."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        text, block = words(rng, 204), words(rng, 36)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text + block * 30))]
    sets = [set(prob_minhash.shingles(prob_minhash.words_of(t)).tolist()) for _, t in rows]
    assert all(len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets[::2], sets[1::2]))
    got = prob_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i // 2 * 2 for i in range(120)}


def passages_by_hand(rows, least=12):
    """The whole query of op5 in plain Python."""
    import xxhash

    docs, seen = [], {}
    for k, (doc, text) in enumerate(rows):
        data = (text or "").encode()
        ends = chunk_dedup.borders(data).tolist() if data else []
        parts = [data[a:b] for a, b in zip([0, *ends], ends)]
        own = (doc is None, k if doc is None else doc)
        docs.append((doc, own, data, ends, [xxhash.xxh3_64_intdigest(p) for p in parts]))
        for d in docs[-1][4]:
            seen.setdefault(d, set()).add(own)
    out = []
    for doc, own, data, ends, digests in docs:
        begins = [i for i in range(len(data)) if data[i:i + 1].strip(b" \t\n\v\f\r") and (i == 0 or not data[i - 1:i].strip(b" \t\n\v\f\r"))]
        words = lambda z: sum(b < z for b in begins)  # noqa: B023,E731
        at = 0
        while at < len(digests):
            stop = at
            while stop < len(digests) and len(seen[digests[stop]]) > 1:
                stop += 1
            if stop > at:
                start = ends[at - 1] if at else 0
                n = words(ends[stop - 1]) - words(start)
                first = [min(seen[d]) for d in digests[at:stop]]
                if n >= least:
                    out.append((doc, start, ends[stop - 1], n, stop - at, None if min(first)[0] else min(first)[1], all(f == own for f in first)))
            at = max(stop, at + 1)
    return out


def test_passages_against_plain_python(spark):
    """Negative, null and repeated ids, copies, shared passages and short texts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, whole = text(70), text(120)
    rows = [(-5, whole), (8, whole), (None, whole), (-1, text(30) + " " + shared + " " + text(40)), (0, shared), (None, text(25) + "\n" + shared), (3, None), (4, ""), (5, "short"), (5, "short"), (6, text(200)), (7, text(60) + " é日本 " + shared), (-9, text(10))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in chunk_dedup.passages(df).select("doc_id", "start_byte", "end_byte", "n_words", "n_chunks", "first_doc_id", "kept").collect()]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(passages_by_hand(rows), key=key)
    assert {(r[0], r[5], r[6]) for r in got if r[0] in (-5, 8)} == {(-5, -5, True), (8, -5, False)}
