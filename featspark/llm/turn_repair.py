"""Repair of conversation structure by a run-length dynamic programme.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Every row is kept (0), given the role user or
assistant (2) or deleted (3; the only choice for blank rows and duplicates), and empty turns are inserted anywhere (2
each); truncated rows that stay cost 1 more. Four states (nothing yet, after s, after u, after a) make each row a
4 x 4 min-plus matrix that holds the insertions before it. Equal consecutive role/fault symbols are one run, and a run
advances a cost vector through cached binary powers of its matrix.

No step holds a conversation as a whole, so one that has a third of all rows is only long, not large:

1. Rows that agree in conversation, turn, role and text are counted; the first turn of each (conversation, role, text)
   comes from a second aggregation and meets them again in a third. Hot keys shrink before each shuffle; there is no join.
2. The counted rows are ordered by ranges over all keys, so a long conversation spreads over many tasks. A task cuts
   every conversation into chunks of at most ``CHUNK`` counted rows: runs, product matrix, counts.
3. Backwards over the chunks of a conversation, costs to the end are carried (one matrix each).
4. Every chunk by itself unrolls the cheapest, then ASCII-least edits for each of the four states it may start in.
5. Forwards over chunks and texts in one order, a task carries the state, picks the edits and hashes the repaired
   text as it passes. A SHA-256 is sequential by definition, so this last reading of a conversation is one stream.

Defined results: a null counts as one space, in the damage as well; a null conversation is a conversation. Rows of one
turn are ordered by role, then by the SHA-256 of their text, so equal rows are neighbours. A conversation without rows
has zeros, an empty audit and the hash of the empty string. Repeated input rows count as rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

CHUNK = 4096
#: Longest stretch of a run that is unrolled at once; longer ones repeat stretches that are already known.
STRETCH = 256
NEVER = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: Symbols: 3 * role class (s, u, a, other) + 0, or + 1 for truncated; GONE for rows that must be deleted.
CLASS = {"s": 0, "u": 1, "a": 2}
GONE = 12
INSERTED = ((0, NEVER, 2, 4), (NEVER, 0, 2, 4), (NEVER, NEVER, 0, 2), (NEVER, NEVER, 2, 0))
#: Costs after the last row: only insertions are left.
CLOSING = (0, 4, 2, 0)

Matrix = tuple[tuple[int, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(x + y for x, y in zip(row, col)), NEVER) for col in zip(*b)) for row in a)


def applied(m: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(x + y for x, y in zip(row, costs)) for row in m)


def kept_from(symbol: int, state: int) -> int | None:
    """State after a row is kept as it is, None if it may not be."""
    role = symbol // 3
    if symbol == GONE or role == 3:
        return None
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if state == USER else None


def rerolled(state: int) -> int:
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The matrix of ``2 ** k`` equal rows; there are 13 symbols and at most 63 powers of each."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    edit = [[NEVER] * 4 for _ in range(4)]
    late = symbol % 3 == 1 and symbol != GONE
    for s in range(4):
        edit[s][s] = 3
        if symbol != GONE:
            edit[s][rerolled(s)] = min(edit[s][rerolled(s)], 2 + late)
            if (to := kept_from(symbol, s)) is not None:
                edit[s][to] = min(edit[s][to], int(late))
    return product(INSERTED, tuple(map(tuple, edit)))


def run_matrix(symbol: int, n: int) -> Matrix:
    out, k = None, 0
    while n:
        if n & 1:
            out = power(symbol, k) if out is None else product(out, power(symbol, k))
        n, k = n >> 1, k + 1
    return out


def advance(symbol: int, n: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before ``n`` equal rows from the costs after them."""
    k = 0
    while n:
        if n & 1:
            costs = applied(power(symbol, k), costs)
        n, k = n >> 1, k + 1
    return costs


@lru_cache(maxsize=100_000)
def stretch(symbol: int, n: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """Cheapest, then ASCII-least edits of ``n`` equal rows and the state behind them; ``after`` is relative to its least entry."""
    costs = [after]
    for _ in range(n):
        costs.append(applied(power(symbol, 0), costs[-1]))
    letters, late = [], int(symbol % 3 == 1 and symbol != GONE)
    for here, then in zip(costs[:0:-1], costs[-2::-1]):
        while True:
            if 3 + then[state] == here[state]:
                letters.append("D")
            elif 2 + here[rerolled(state)] == here[state]:
                letters.append("I")
                state = rerolled(state)
                continue
            elif (to := kept_from(symbol, state)) is not None and late + then[to] == here[state]:
                letters.append("K")
                state = to
            else:
                letters.append("R")
                state = rerolled(state)
            break
    return "".join(letters), state


def unrolled(runs: list[tuple[int, int]], after: tuple[int, ...]) -> list[tuple[str, int]]:
    """For each of the four states before these runs: the edits and the state behind them."""
    pieces = [(symbol, min(STRETCH, n - at)) for symbol, n in runs for at in range(0, n, STRETCH)]
    ends = [after]
    for symbol, n in reversed(pieces[1:]):
        ends.append(advance(symbol, n, ends[-1]))
    ends.reverse()
    out = []
    for state in range(4):
        letters = []
        for (symbol, n), costs in zip(pieces, ends):
            least = min(costs)
            more, state = stretch(symbol, n, tuple(c - least for c in costs), state)
            letters.append(more)
        out.append(("".join(letters), state))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, has_turn, turn, role, text, copies after the damage of the contract (crc32 of ``conv_id:turn`` modulo 20)."""
    turn = F.col("turn").cast("long")
    conv = F.col("conv_id").cast("long")
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    d = conversations.select(conv.alias("conv_id"), turn.isNotNull().alias("has_turn"), turn.alias("turn"), text_of(F.col("role")).alias("role"), text_of(F.col("text")).alias("text"),
                             (F.crc32(F.concat(text_of(conv), F.lit(":"), text_of(turn)).cast("binary")) % 20).alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv_id", "has_turn", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def as_they_are(conversations: DataFrame) -> DataFrame:
    """The same columns without any damage, to repair real tables."""
    turn = F.col("turn").cast("long")
    space = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.isNotNull().alias("has_turn"), turn.alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(1).cast("long").alias("copies"))


def _digest():
    return F.unhex(F.sha2("text", 256)).alias("sha")


def faults(rows: DataFrame) -> DataFrame:
    """One line per (conv_id, turn, role, text) with its number of rows, whether it is the first of its role and text, blank, truncated."""
    key = ["conv_id", "has_turn", "turn", "role", "sha"]
    r = rows.select("conv_id", "has_turn", "turn", "role", _digest(), "copies", (~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).alias("blank"), (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("cut"))
    r = stash(r.groupBy(*key).agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    first = r.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("has_turn", "turn")).alias("at"))
    first = first.select("conv_id", "at.has_turn", "at.turn", "role", "sha", F.lit(0).cast("long").alias("n"), F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("cut"), F.lit(True).alias("first"))
    both = r.withColumn("first", F.lit(False)).unionByName(first)
    return both.groupBy(*key).agg(F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("first").alias("first"))


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
CHUNKS = ("conv_id long, part int, chunk long, has_turn boolean, turn long, role string, sha binary, symbols binary, lengths array<long>, matrix array<long>, "
          "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, last_turn long, first_turn long, head string, tail string")
CHUNK_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int64()), ("has_turn", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("sha", pa.binary()),
                          ("symbols", pa.binary()), ("lengths", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64())), *[(c, pa.int64()) for c in COUNTS], ("low", pa.int64()), ("high", pa.int64()),
                          ("last_turn", pa.int64()), ("first_turn", pa.int64()), ("head", pa.string()), ("tail", pa.string())])


class _Chunk:
    """Runs and counts of neighbouring counted rows of one conversation."""

    def __init__(self, row: dict, number: int):
        self.row, self.number, self.size, self.runs = row, number, 0, []
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.last_turn = self.first_turn = self.tail = None
        self.head = row["role"][:1]

    def run(self, symbol: int, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([symbol, n])

    def add(self, row: dict) -> None:
        self.size += 1
        n, initial, turn = row["n"], row["role"][:1], row["turn"]
        if row["blank"]:
            self.count["blank"] += n
            self.run(GONE, n)
        else:
            alive = int(row["first"])
            self.count["duplicate"] += n - alive
            self.count["truncated"] += alive * row["cut"]
            self.run(3 * CLASS.get(initial, 3) + int(row["cut"]), alive)
            self.run(GONE, n - alive)
        self.count["illegal"] += (self.tail is not None and not legal(self.tail, initial)) + (n - 1) * (not legal(initial, initial))
        self.tail = initial
        if turn is not None:
            self.count["turns"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.low, self.high, self.last_turn = (turn if self.low is None else self.low), turn, turn

    def line(self) -> dict:
        matrix = None
        for symbol, n in self.runs:
            m = run_matrix(symbol, n)
            matrix = m if matrix is None else product(matrix, m)
        r = self.row
        return {"conv_id": r["conv_id"], "part": r["part"], "chunk": self.number, "has_turn": r["has_turn"], "turn": r["turn"], "role": r["role"], "sha": r["sha"],
                "symbols": bytes(s for s, _ in self.runs), "lengths": [n for _, n in self.runs], "matrix": [x for row in matrix for x in row], **self.count,
                "low": self.low, "high": self.high, "last_turn": self.last_turn, "first_turn": self.first_turn, "head": self.head, "tail": self.tail}


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au") and bool(a) and bool(b)


def _lines(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def chunks(counted: DataFrame, size: int = CHUNK) -> DataFrame:
    """Counted rows in order, cut into chunks of one conversation each; (part, chunk) is their order."""
    key = ["conv_id", "has_turn", "turn", "role", "sha"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is None or held.row["conv_id"] != row["conv_id"] or held.size == size:
                    if held is not None:
                        out.append(held.line())
                    held, number = _Chunk(row, number), number + 1
                held.add(row)
            if out:
                yield _lines(out, CHUNK_SCHEMA)
        if held is not None:
            yield _lines([held.line()], CHUNK_SCHEMA)

    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counted.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())
    return ordered.mapInArrow(cut, CHUNKS)


def _square(flat: list[int]) -> Matrix:
    return tuple(tuple(flat[k:k + 4]) for k in range(0, 16, 4))


def edits(cut: DataFrame) -> DataFrame:
    """Chunks with the edits and end state for each start state, and the cost from their start to the end of the conversation."""
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, costs = False, CLOSING
        conv = None
        for batch in batches:
            after, before = [], []
            for c, m in zip(batch["conv_id"].to_pylist(), batch["matrix"].to_pylist()):
                if not seen or c != conv:
                    seen, conv, costs = True, c, CLOSING
                after.append(list(costs))
                costs = applied(_square(m), costs)
                before.append(costs[START])
            cols = [batch[n] for n in ("conv_id", "part", "chunk", "symbols", "lengths")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(after, pa.list_(pa.int64())), pa.array(before, pa.int64())], names=["conv_id", "part", "chunk", "symbols", "lengths", "after", "cost"])

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unrolled(list(zip(s, n)), tuple(a)) for s, n, a in zip(batch["symbols"].to_pylist(), batch["lengths"].to_pylist(), batch["after"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["part"], batch["chunk"], batch["cost"], pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string())), pa.array([[x for _, x in f] for f in found], pa.list_(pa.int32()))],
                                             names=["part", "chunk", "cost", "audits", "ends"])

    back = cut.select("conv_id", "part", "chunk", "symbols", "lengths", "matrix").repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("chunk"))
    back = back.mapInArrow(backwards, "conv_id long, part int, chunk long, symbols binary, lengths array<long>, after array<long>, cost long")
    free = back.repartition(parts, "part", "chunk").mapInArrow(unroll, "part int, chunk long, cost long, audits array<string>, ends array<int>")
    return cut.drop("symbols", "lengths", "matrix").join(free, ["part", "chunk"])


RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Conversation:
    """What the forward pass holds: counts, state, edits not yet used, the running hash."""

    def __init__(self, conv):
        self.conv, self.count, self.cost, self.state = conv, dict.fromkeys(COUNTS, 0), None, START
        self.low = self.high = self.last_turn = self.tail = None
        self.audit, self.waiting, self.at = [], [], 0
        self.hash, self.any, self.out = hashlib.sha256(), False, START

    def chunk(self, r: dict) -> None:
        if self.cost is None:
            self.cost = r["cost"]
        for c in COUNTS:
            self.count[c] += r[c]
        if self.tail is not None:
            self.count["illegal"] += not legal(self.tail, r["head"])
        self.tail = r["tail"]
        if r["low"] is not None:
            self.count["turns"] -= r["first_turn"] == self.last_turn
            self.low, self.high, self.last_turn = (r["low"] if self.low is None else self.low), r["high"], r["last_turn"]
        letters = r["audits"][self.state]
        self.state = r["ends"][self.state]
        self.audit.append(letters)
        self.waiting.append(letters)

    def letter(self) -> str:
        while self.at == len(self.waiting[0]):
            self.waiting.pop(0)
            self.at = 0
        self.at += 1
        return self.waiting[0][self.at - 1]

    def write(self, role: str, text: str) -> None:
        self.hash.update(("\n" * self.any + role + ":" + text).encode())
        self.any = True

    def given(self) -> str:
        self.out = rerolled(self.out)
        return "user" if self.out == USER else "assistant"

    def text(self, role: str, text: str) -> None:
        while (letter := self.letter()) == "I":
            self.write(self.given(), "")
        if letter == "R":
            self.write(self.given(), text)
        elif letter == "K":
            self.write(role, text)
            self.out = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    def line(self) -> dict:
        for _ in range({SYSTEM: 2, USER: 1}.get(self.state, 0)):
            self.audit.append("I")
            self.write(self.given(), "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.count["turns"]
        return {"conv_id": self.conv, "gaps": gaps, **{c: self.count[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": self.cost or 0,
                "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def repair(rows: DataFrame, conversations: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` are the rows to repair, from :func:`damaged` or :func:`as_they_are`.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = edits(stash(chunks(stash(faults(rows)), size)))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    more = [("cost", "long"), ("audits", "array<string>"), ("ends", "array<int>"), *[(c, "long") for c in COUNTS], ("low", "long"), ("high", "long"), ("last_turn", "long"), ("first_turn", "long"), ("head", "string"), ("tail", "string")]
    shared = ["conv_id", "has_turn", "turn", "role", "sha"]
    marks = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).groupBy("conv_id").agg(F.lit(0).alias("kind"))
    marks = marks.select("conv_id", none("boolean", "has_turn"), none("long", "turn"), none("string", "role"), none("binary", "sha"), "kind", none("long", "chunk"), none("string", "text"), none("long", "copies"), *[none(t, n) for n, t in more])
    plans = plan.select(*shared, F.lit(1).alias("kind"), F.shiftleft(F.col("part").cast("long"), 40).bitwiseOR(F.col("chunk")).alias("chunk"), none("string", "text"), none("long", "copies"), *[n for n, _ in more])
    texts = rows.select("conv_id", "has_turn", "turn", "role", _digest(), F.lit(2).alias("kind"), none("long", "chunk"), "text", "copies", *[none(t, n) for n, t in more])
    stream = marks.unionByName(plans).unionByName(texts).repartition(parts, "conv_id").sortWithinPartitions(*shared, "kind", "chunk")

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out, kinds, texts, roles, copies = [], batch["kind"].to_pylist(), batch["text"], batch["role"], batch["copies"].to_pylist()
            convs = batch["conv_id"].to_pylist()
            for k, kind in enumerate(kinds):
                if held is None or held.conv != convs[k]:
                    if held is not None:
                        out.append(held.line())
                    held = _Conversation(convs[k])
                if kind == 1:
                    held.chunk(batch.slice(k, 1).to_pylist()[0])
                elif kind == 2:
                    for _ in range(copies[k]):
                        held.text(roles[k].as_py(), texts[k].as_py())
            if out:
                yield _lines(out, RESULT)
        if held is not None:
            yield _lines([held.line()], RESULT)

    return stream.mapInArrow(forwards, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """The contract's query: damage, then repair."""
    return repair(damaged(conversations), conversations)
