"""Conversation repair against enumeration of all edits and a plain whole-table version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from featspark.llm import turn_repair as T


def faults_of(rows):
    """blank, duplicate, truncated or None for each (role, text), first fault only."""
    seen, out = set(), []
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def enumerated(rows):
    """All edit sequences with at most two insertions in one place: (cost, audit, repaired lines) of the best."""
    found, best = faults_of(rows), [(10 ** 9, "", None)]

    def go(i, cost, audit, done, inserted):
        if cost > best[0][0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in done)):
                best[0] = min(best[0], (cost, audit, list(done)), key=lambda b: b[:2])
        else:
            (role, text), late = rows[i], int(found[i] == "truncated")
            go(i + 1, cost + 3, audit + "D", done, 0)
            if found[i] not in ("blank", "duplicate"):
                if role[:1] in "sua" and role:
                    go(i + 1, cost + late, audit + "K", done + [(role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + late, audit + "R", done + [(new, text)], 0)
        if inserted < 2:
            for new in ("user", "assistant"):
                go(i, cost + 2, audit + "I", done + [(new, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return best[0]


def programme(rows):
    """The same by forward dynamic programming over whole edit strings, for longer conversations."""
    found, state = faults_of(rows), {0: (0, "", ())}

    def put(to, s, value):
        if s not in to or value[:2] < to[s][:2]:
            to[s] = value

    def inserted(states):
        for _ in range(3):
            for s, (c, a, d) in list(states.items()):
                put(states, 3 if s == 2 else 2, (c + 2, a + "I", d + (("assistant" if s == 2 else "user", ""),)))
        return states

    for (role, text), fault in zip(rows, found):
        to, late = {}, int(fault == "truncated")
        for s, (c, a, d) in inserted(state).items():
            put(to, s, (c + 3, a + "D", d))
            if fault not in ("blank", "duplicate"):
                nxt = {"s": 1 if s == 0 else None, "u": None if s == 2 else 2, "a": 3 if s == 2 else None}.get(role[:1])
                if nxt:
                    put(to, nxt, (c + late, a + "K", d + ((role, text),)))
                put(to, 3 if s == 2 else 2, (c + 2 + late, a + "R", d + (("assistant" if s == 2 else "user", text),)))
        state = to
    return min((v for s, v in inserted(state).items() if s in (0, 3)), key=lambda v: v[:2])


def expected(rows, repair):
    """The query for rows (conv_id, turn, role, text) in plain Python."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        space = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        plain = [r[1:] for r in found]
        marks, turns = faults_of(plain), {r[0] for r in found} - {None}
        illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(plain))
        cost, audit, done = repair(plain)
        text = "\n".join(f"{r}:{t}" for r, t in done)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(spark, rows, size=T.CHUNK):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = T.repair(T.damaged(df), df, size).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


def random_rows(rng, conv, n):
    return [(conv, rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["Hi.", "So", "", " \n", "Why? ", None, "x!", "a b"])) for _ in range(n)]


def test_the_two_references_agree():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(r or " ", t or " ") for _, _, r, t in random_rows(rng, 0, rng.randrange(4))]
        assert enumerated(rows) == (*programme(rows)[:2], list(programme(rows)[2])), rows


def test_matrices_runs_and_stretches():
    rng = random.Random(2)
    for symbol in range(13):
        m = T.power(symbol, 0)
        for n in (1, 2, 3, 7, 600):
            want = m
            for _ in range(n - 1):
                want = T.product(want, m)
            assert T.run_matrix(symbol, n) == want
            costs = T.CLOSING
            for _ in range(n):
                costs = T.applied(m, costs)
            assert T.advance(symbol, n, T.CLOSING) == costs
    for _ in range(40):  # cutting a run into stretches changes nothing
        runs = [(rng.randrange(13), rng.choice([1, 2, 5, 700])) for _ in range(4)]
        ones = [(s, 1) for s, n in runs for _ in range(n)]
        assert T.unrolled(runs, T.CLOSING) == T.unrolled(ones, T.CLOSING)


@pytest.mark.parametrize("size", [1, 3, T.CHUNK])
def test_small_conversations_by_enumeration(spark, size):
    rng = random.Random(size)
    rows = [r for conv in range(60) for r in random_rows(rng, conv, rng.randrange(1, 5))]
    assert got(spark, rows, size) == expected(rows, enumerated)


def test_long_and_odd_conversations(spark):
    rng = random.Random(9)
    rows = [r for conv in (None, 1, 2, -3) for r in random_rows(rng, conv, 400)]
    rows += [(7, t, "user", "same.") for t in range(900)] + [(8, 0, "user", "same.")] * 700 + [(9, t, "assistant", "no end") for t in range(1200)]
    assert got(spark, rows, 64) == expected(rows, programme)
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.repaired(df).count() == 0


def test_whole_table_and_clashing_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()], programme)
    extra = df.selectExpr("*", "1 as part", "'x' as sha", "2 as copies")
    assert {r.conv_id: tuple(r)[1:] for r in T.repaired(extra).collect()} == want
    clean = T.repair(T.as_they_are(df), df)
    assert clean.filter("cost = 0").count() > 0
