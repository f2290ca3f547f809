"""Greedy leader clustering of sequences by positional identity.

In id order a sequence joins the first leader it is similar to (equal letters at equal positions / longer length > thr)
or becomes a leader itself. The sequential rule is kept exactly:

* Equal sequences are one, under their smallest id.
* Similar sequences lie in the same band of lengths or in neighbouring ones. A group is a band with the one below; in it
  a sequence is cut into pieces of ``q`` letters at fixed positions, and every ``combs``-th piece makes a comb. Of two similar
  sequences some comb differs in no more than its share of the places. So a task gets one comb of a group, all its sequences in
  half a byte a letter: each letter travels to two tasks, however many sequences there are, and pairs arise inside a task.
* In a comb so many pieces agree that two of them fall into the same of ``buckets`` sets of places. Rows that agree in two
  pieces of a set are found by sorting, and kept if the comb differs in few enough letters. Only these pairs are compared whole.
* Links elect leaders in rounds: without an earlier similar sequence that leads or is undecided, a sequence leads; if the
  first of these leads, it is the home. A task returns the first ``AHEAD`` pairs of a sequence; if there were more and all these
  turned out members or not similar, it is asked again beyond them, once nothing else can be decided.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


#: Earlier sequences that a task returns for one sequence.
AHEAD = 8
#: Pieces of a comb, about; pieces that agree in it at least, if a group has several combs.
SLOTS, AGREE = 48, 6
#: Of rows with the same two pieces all pairs are compared up to so many rows; beyond that, each with the first few.
CROWD, FEW = 1024, 64
#: Sequences of a task at most, about (rows have 20 bits), keys and pairs that it holds at a time.
ROWS, KEYS, PAIRS = 900_000, 1 << 20, 1 << 16
#: Ids up to which a table of them is broadcast, so that the sequences are not shuffled for it.
NARROW = 1 << 19
BITS = np.uint64(20)
#: What ``after`` is for those who ask for all.
ALL = -(1 << 63)


def piece_length(thr: float, longest: int = 5000) -> int:
    """The longest pieces of which two similar sequences always share at least one."""
    allowed = [(m, ceil(round((1 - thr) * m, 9)) - 1) for m in range(1, longest + 1)]
    differing = [(m, d) for m, d in allowed if d > 0]  # below, only equal sequences are similar
    return next((q for q in range(differing[0][0] if differing else 1, 0, -1) if all(m // q > d for m, d in differing)), 1)


def allowed(n, thr: float):
    """Differing places that a sequence of ``n`` letters may have at most to a similar one, its surplus of letters included."""
    return np.ceil(np.round((1 - thr) * np.asarray(n, float), 9)).astype(np.int64) - 1


class Group(NamedTuple):
    """How the sequences of a group are cut; ``shortest``: of the band that the longer of two belongs to; ``slots``: pieces of a comb at most."""

    q: int
    combs: int
    slots: int
    buckets: int
    shortest: int
    blocks: int


def _group(n: int, shortest: int, longest: int, thr: float) -> Group | None:
    """For ``n`` sequences of a group, and the lengths of its upper band; nothing if only equal ones can be similar."""
    m = np.arange(shortest, longest + 1)
    may = allowed(m, thr)
    if n < 2 or may.max() < 1:
        return None
    q = next(q for q in (4, 2, 1) if (m // q > may).all())
    agree = lambda combs: int((m // q // combs - may // combs).min())
    combs = next(k for k in range(max(1, shortest // (q * SLOTS)), 0, -1) if k == 1 or agree(k) >= AGREE)
    return Group(q, combs, -(-(longest // q) // combs), agree(combs) - 1, shortest, 1 if n <= ROWS else ceil(2 * n / (ROWS * 0.8)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _pieces(codes: np.ndarray, q: int) -> np.ndarray:
    """All whole pieces in 16 bits each: four letters in four bits each, two in eight, or one. What differs there differs in the letters."""
    codes = codes[:len(codes) // q * q]
    if q == 1:
        return codes.astype(np.uint16)
    if q == 2:
        return codes.astype(np.uint8).view("<u2")
    x = (codes & 15).astype(np.uint8).view("<u4")
    x = (x | x >> 4) & 0x00FF00FF
    return (x | x >> 8).astype(np.uint16)


def _differing(q: int) -> np.ndarray:
    """Letters that differ in two pieces, by their xor."""
    x = np.arange(1 << 16)
    return sum(((x >> k * (16 // q)) % (1 << (16 // q)) > 0).astype(np.uint8) for k in range(q))


def _pairs(cells: np.ndarray, n: np.ndarray, first: np.ndarray, owner: np.ndarray | None, comb: int, how: Group, thr: float, wider: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, earlier row) of pairs whose comb differs in few enough letters, and for each row the last earlier one up to which they are complete.

    ``cells``: the comb's pieces of each sequence, in id order; ``n``: letters; ``first``: the first row that a row asks for (all rows: it doesn't ask);
    ``owner``: if given, pairs of different owners only; ``wider``: times the usual numbers of pairs.
    """
    rows, last = len(n), np.full(len(n), len(n), np.int64)
    have = (n // how.q - comb + how.combs - 1) // how.combs
    may = allowed(n, thr)
    most, surplus, table = may // how.combs, np.arange(how.slots), _differing(how.q)
    if how.buckets > 0:
        sets = [np.arange(b, how.slots, how.buckets) for b in range(how.buckets)]
        one, two = np.concatenate([np.stack([x[k] for k in np.triu_indices(len(x), 1)]) for x in sets], 1)
    else:
        one = two = np.arange(how.slots)
    across, mask, pairs = np.ascontiguousarray(cells.T), (np.uint64(1) << BITS) - np.uint64(1), np.zeros(0, np.int64)
    step = max(1, min(1 << 12, KEYS // rows))
    for at in range(0, len(one), step):
        a, b = one[at:at + step], two[at:at + step]
        key = across[a].astype(np.uint64) << np.uint64(16) | across[b] | np.arange(len(a), dtype=np.uint64)[:, None] << np.uint64(32)
        key = np.sort((key << BITS | np.arange(rows, dtype=np.uint64))[have > b[:, None]])
        if not len(key):
            continue
        start = np.flatnonzero(np.r_[True, key[1:] >> BITS != key[:-1] >> BITS])
        size = np.diff(np.r_[start, len(key)])
        start, size = start[size > 1], size[size > 1]
        start, size, place = np.repeat(start, size), np.repeat(size, size), np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)
        place += start
        row = (key[place] & mask).astype(np.int64)
        start = np.maximum(start, np.searchsorted(key, key[place] & ~mask | first[row].astype(np.uint64))) if first.any() else start
        count, limit = np.maximum(place - start, 0), np.where(size > CROWD * wider, FEW * wider, size)
        cut = np.flatnonzero(count > limit)
        np.minimum.at(last, row[cut], (key[(start + limit)[cut] - 1] & mask).astype(np.int64))
        some = np.flatnonzero(count)
        row, start, count = row[some], start[some], np.minimum(count, limit)[some]
        found = [pairs]
        for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(count.cumsum() // PAIRS)) + 1):
            k = count[part]
            x = np.repeat(row[part], k)
            y = (key[np.arange(k.sum()) + np.repeat(start[part] - k.cumsum() + k, k)] & mask).astype(np.int64)
            long, short = np.where(n[x] >= n[y], x, y), np.where(n[x] >= n[y], y, x)
            good = (y <= last[x]) & (n[long] >= how.shortest) & (n[long] - n[short] <= may[long])
            if owner is not None:
                good &= owner[x] != owner[y]
            x, y, long, short = x[good], y[good], long[good], short[good]
            wrong = table[cells[x] ^ cells[y]] * (surplus < have[short][:, None])
            good = wrong.sum(1, dtype=np.int64) + have[long] - have[short] <= most[long]
            found.append(x[good] << 20 | y[good])
        if sum(map(len, found)) > len(pairs):
            pairs = np.unique(np.concatenate(found))
            x, y = pairs >> 20, pairs & int(mask)
            begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            nth = np.arange(len(x)) - np.repeat(begin, np.diff(np.r_[begin, len(x)]))
            over = np.flatnonzero(nth == AHEAD * wider)
            last[x[over]] = np.minimum(last[x[over]], y[over - 1])
            pairs = pairs[y <= last[x]]
    pairs = pairs[(pairs & int(mask)) <= last[pairs >> 20]]
    return pairs >> 20, pairs & int(mask), last


def _candidates(seqs: DataFrame, thr: float, wider: int) -> DataFrame:
    """(id, leader, last): of ``seqs`` (id, sequence, after: null if it doesn't ask) the earlier ones beyond ``after`` that may be similar; ``last``: more may follow it."""
    n = F.length("sequence")
    band = F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(log(1 / thr) * (1 + 1e-9)))
    rows = seqs.filter(n > 0).select("id", "sequence", "after", band.cast("int").alias("band"))
    sizes = {r.band: r for r in rows.groupBy("band").agg(F.count("*").alias("n"), F.count("after").alias("asking"), F.min(n).alias("shortest"), F.max(n).alias("longest")).collect()}  # a row for each power of 1 / thr
    below = {b: sizes.get(b - 1) for b in sizes}
    groups = {b: _group(r.n + (below[b].n if below[b] else 0), r.shortest, r.longest, thr) for b, r in sizes.items() if r.asking or below[b] and below[b].asking}
    groups = {b: g for b, g in groups.items() if g}
    tile = "group int, comb int, i int, j int"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bands, after = batch["id"].to_numpy(), batch["band"].to_numpy(), batch["after"].fill_null(-ALL - 1).to_numpy()
            for b in np.unique(bands).tolist():
                at = np.flatnonzero(bands == b)
                codes = [_codes(batch["sequence"][i].as_py()) for i in at.tolist()]
                lengths = np.array([len(x) for x in codes], np.int32)
                for g, how in ((g, groups[g]) for g in (b, b + 1) if g in groups):
                    cells = np.zeros((len(at), how.slots * how.combs), np.uint16)
                    for row, x in zip(cells, codes):
                        row[:len(x) // how.q] = _pieces(x, how.q)
                    block = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % how.blocks
                    for k in range(how.blocks):
                        own = np.flatnonzero(block == k)
                        if not len(own):
                            continue
                        combs = cells[own].reshape(len(own), how.slots, how.combs).transpose(2, 0, 1)
                        meta = (k, ids[at[own]].tobytes(), lengths[own].tobytes(), after[at[own]].tobytes())
                        for other in range(how.blocks):
                            out = [(g, s, min(k, other), max(k, other), *meta, x.tobytes()) for s, x in enumerate(combs)]
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int32()] * 5 + [pa.binary()] * 4)], names=["group", "comb", "i", "j", "block", "ids", "n", "after", "cells"])

    def run(table: pa.Table) -> pa.Table:
        g, comb, i, j = (table[c][0].as_py() for c in ("group", "comb", "i", "j"))
        joined = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[c]])
        ids, n, after, cells = joined("ids", np.int64), joined("n", np.int32).astype(np.int64), joined("after", np.int64), joined("cells", np.uint16)
        block = np.repeat(table["block"].to_numpy(), [len(x.as_buffer()) // 8 for x in table["ids"]])
        order = np.argsort(ids)
        ids, n, after, cells = ids[order], n[order], after[order], cells.reshape(len(ids), -1)[order]
        first = np.where(after == ALL, 0, np.searchsorted(ids, after, "right"))
        x, y, last = _pairs(cells, n, first, block[order] if i < j else None, comb, groups[g], thr, wider)
        more = np.flatnonzero(last < len(ids))
        return pa.table({"id": np.r_[ids[x], ids[more]], "leader": np.r_[ids[y], ids[last[more]]], "last": np.r_[np.zeros(len(x), bool), np.ones(len(more), bool)]})

    spark = seqs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = rows.mapInArrow(deal, f"{tile}, block int, ids binary, n binary, after binary, cells binary")
    return dealt.repartition(parts, "group", "comb", "i", "j").groupBy("group", "comb", "i", "j").applyInArrow(run, "id long, leader long, last boolean")


def _narrow(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(NARROW + 1).count() <= NARROW else ids


def _similar(pairs: DataFrame, seqs: DataFrame, thr: float) -> DataFrame:
    """Those of ``pairs`` (id, leader) whose sequences are similar."""
    texts = seqs.join(_narrow(pairs.select(F.explode(F.array("id", "leader")).alias("id")).distinct()), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["sequence"], batch["other"]):
                x, y = _codes(x.as_py()), _codes(y.as_py())
                m = min(len(x), len(y))
                good.append(int((x[:m] == y[:m]).sum()) / max(len(x), len(y)) > thr)
            yield batch.select(["id", "leader"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts, "id").join(texts.select(F.col("id").alias("leader"), F.col("sequence").alias("other")), "leader")
    return both.select("id", "leader", "sequence", "other").mapInArrow(run, "id long, leader long")


def cluster_sequences(proteins: DataFrame, thr: float = 0.8) -> DataFrame:
    """(protein_id, leader_id, size): the clusters of the greedy rule in id order; ``proteins``: protein_id, sequence.

    A null sequence counts as empty; empty sequences are equal to each other.
    """
    if not 0 < thr < 1:
        raise ValueError("thr must lie between 0 and 1")
    rows = proteins.select("protein_id", F.coalesce("sequence", F.lit("")).alias("sequence"))
    named = rows.withColumn("sha", F.sha2("sequence", 256))
    ids = named.groupBy("sha").agg(F.min("protein_id").alias("name"), F.any_value("sequence").alias("sequence"))
    kind = ids.schema["name"].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    seqs = cut_lineage(ids.withColumn("id", F.col("name").cast("long")) if whole else ids)
    if not whole:  # numbers in the order of the ids
        names = cut_lineage(seqs.select("name").orderBy("name").withColumn("id", F.monotonically_increasing_id()))
        seqs = seqs.join(names, "name")
    same = named.select("protein_id", "sha").join(seqs.select("sha", "id"), "sha")
    seqs = seqs.select("id", "sequence")
    undecided = seqs.filter(F.length("sequence") > 0).select("id", F.lit(ALL).alias("after"), F.lit(False).alias("more"), F.lit(True).alias("ask"))
    links = home = None  # (id, leader): links of the undecided to leaders and undecided ones; homes of the decided
    wider, before = 1, -1
    while True:
        undecided = cut_lineage(undecided)
        left = undecided.count()
        if not left:
            break
        if links is None or left == before:
            asked = cut_lineage(undecided.filter("ask").select("id", "after"))
            # Members lead nobody: they take no part any more.
            still = seqs.withColumn("after", F.lit(ALL)) if home is None else seqs.join(_narrow(home.filter("id <> leader").select("id")), "id", "left_anti").join(_narrow(asked), "id", "left")
            new = cut_lineage(_candidates(still, thr, wider))
            known = cut_lineage(new.filter("last").groupBy("id").agg(F.min("leader").alias("known")))  # of earlier ones beyond, some tasks told nothing
            new = new.filter("not last").select("id", "leader").distinct().join(known, "id", "left").filter("known is null or leader <= known").select("id", "leader")
            new = cut_lineage(_similar(cut_lineage(new), seqs, thr))
            undecided = undecided.join(known, "id", "left").select("id", F.when(F.col("ask"), F.col("known")).otherwise(F.col("after")).alias("after"), F.when(F.col("ask"), F.col("known").isNotNull()).otherwise(F.col("more")).alias("more"))
            left = -1
            links = cut_lineage(new if links is None else links.unionByName(new))
            wider *= 8
        before = left
        first = undecided.join(links.groupBy("id").agg(F.min("leader").alias("leader")), "id", "left")
        leaders = first.filter("leader is null and not more").select("id", F.col("id").alias("leader"))
        home = cut_lineage(leaders if home is None else home.unionByName(leaders))
        heads = home.filter("id = leader").select("leader")
        settled = first.join(heads, "leader", "left_semi").select("id", "leader")
        home = cut_lineage(home.unionByName(settled))
        links = cut_lineage(links.join(home.select("id"), "id", "left_anti").join(home.filter("id <> leader").select(F.col("id").alias("leader")), "leader", "left_anti").select("id", "leader"))
        undecided = undecided.join(home, "id", "left_anti")
        undecided = undecided.join(links.select("id").distinct().withColumn("linked", F.lit(True)), "id", "left").select("id", "after", "more", (F.col("linked").isNull() & F.col("more")).alias("ask"))
    home = seqs.select("id", F.col("id").alias("leader")).limit(0) if home is None else home
    out = same.join(home, "id", "left").select("protein_id", F.coalesce("leader", "id").alias("id"))
    out = out.select("protein_id", F.col("id").cast(kind).alias("leader_id")) if whole else out.join(names, "id").select("protein_id", F.col("name").alias("leader_id"))
    out = cut_lineage(out)  # else the sequences are made and hashed once more for the sizes
    return out.join(out.groupBy("leader_id").agg(F.count("*").alias("size")), "leader_id").select("protein_id", "leader_id", "size")
