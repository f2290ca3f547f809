"""Near-duplicate groups by ProbMinHash over five-word shingles.

A text is the set of its five-word shingles (a text of fewer words is one shingle), each with weight 1 however
often it occurs, since links are verified by the similarity of the sets. Every shingle sends a Poisson process of
arrivals, its rate the weight; each arrival falls on one of the signature's slots, and a slot keeps the shingle
that arrives first. A shingle stops as soon as its next arrival is later than the latest slot, so all but a few
send one. With equal weights two signatures agree in a slot with the Jaccard similarity of the sets. Signatures are cut into ``bands`` bands of ``rows`` slots; texts
that agree in a band are candidates, and a candidate link counts only after the exact Jaccard similarity
of the two shingle sets has been verified to be at least ``threshold``.

Equal texts (same words) are one class from the start, so copies are never compared. In each bucket all members
are compared with one hub first, the member that shares most with the rest; linked members form components.
Only buckets whose members lie in different components are looked at again: small ones pair by pair, large
ones in bounded tiles whose tasks return a spanning forest of the links they find. So no link that joins two
groups is lost, and no task emits the pairs of a group. Skewed buckets are split by the join.

Defined results: null text counts as empty; all texts without a word are one class; rows with the same
identifier are members like others, exactly one row of a class stays (smallest identifier, null last); ties and
repeated rows are copies; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .bytepair import Memo
from .common import ids_and_text, map_rows, numbered, pick, stash

SHINGLE = 5
_U = np.uint64
_STEP, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the five-word windows; one of all words if there are fewer, none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k:len(h) - width + 1 + k]) * _M1 + _STEP
    return _mix(out)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    """ProbMinHash signatures [sets, slots] of (elements, weights); all sets advance together, arrival by arrival."""
    n = len(sets)
    sizes = [len(e) for e, _ in sets]
    element = np.concatenate([e for e, _ in sets]) if n else np.zeros(0, np.uint64)
    rate = np.concatenate([w for _, w in sets]) if n else np.zeros(0)
    owner = np.repeat(np.arange(n), sizes)
    best, who = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    time, stream = np.zeros(len(element)), element.copy()
    with np.errstate(over="ignore"):
        while len(element):
            stream = stream + _STEP
            r = _mix(stream)
            time = time - np.log1p(-((r >> _U(11)).astype(np.float64) * 2.0 ** -53)) / rate
            slot = owner * slots + (_mix(r ^ _M2) % _U(slots)).astype(np.int64)
            first = np.flatnonzero(time < best[slot])
            at = slot[first]
            np.minimum.at(best, at, time[first])
            won = first[time[first] == best[at]]
            who[slot[won]] = element[won]
            go = np.flatnonzero(time < best.reshape(n, slots).max(1)[owner])
            element, rate, owner, time, stream = element[go], rate[go], owner[go], time[go], stream[go]
    return who.reshape(n, slots)


def sketch(base: DataFrame, bands: int, rows: int) -> DataFrame:
    """Of numbered rows (doc_id, text, row_id): doc_id, row_id, key (digest of the words), n_shingles, bands array<long> of every whole text."""
    slots = bands * rows

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, sets, at, place = [], [], [], {}
        for t in b["text"]:
            words = words_of(t.as_py())
            key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            keys.append(key)
            if key not in place:
                place[key] = len(sets)
                element = np.unique(shingles(words))
                sets.append((element, np.ones(len(element))))
            at.append(place[key])
        sig = np.concatenate([signatures(sets[i:i + 64], slots) for i in range(0, len(sets), 64)])
        with np.errstate(over="ignore"):
            h = np.zeros((len(sig), bands), np.uint64)
            for k in range(rows):
                h = (h ^ sig.reshape(-1, bands, rows)[:, :, k]) * _M1 + _STEP
            h = _mix(h + np.arange(bands, dtype=np.uint64) * _M2).astype(np.int64)
        out = [h[i] if len(sets[i][0]) else [] for i in at]
        return pa.RecordBatch.from_arrays([b["doc_id"], b["row_id"], pa.array(keys, pa.binary()), pa.array([len(sets[i][0]) for i in at], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "row_id", "key", "n_shingles", "bands"])

    return map_rows(base, run, "doc_id long, row_id long, key binary, n_shingles long, bands array<long>", rows=512)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of (u, v) with u < v, the pairs whose texts are similar enough, with the exact similarity."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        memo: dict[int, np.ndarray] = {}

        def of(i, t):
            if i not in memo:
                if len(memo) > 64:
                    memo.clear()
                memo[i] = np.unique(shingles(words_of(t)))
            return memo[i]

        us, vs = b["u"].to_pylist(), b["v"].to_pylist()
        sims = [similarity(of(u, x.as_py()), of(v, y.as_py())) for u, v, x, y in zip(us, vs, b["tu"], b["tv"])]
        keep = [i for i, s in enumerate(sims) if s >= threshold]
        return pa.RecordBatch.from_arrays([pa.array([us[i] for i in keep], pa.int64()), pa.array([vs[i] for i in keep], pa.int64()), pa.array([sims[i] for i in keep], pa.float64())], names=["u", "v", "similarity"])

    both = pick(pick(pairs, texts.select(F.col("row_id").alias("u"), F.col("text").alias("tu")), "u", "inner"), texts.select(F.col("row_id").alias("v"), F.col("text").alias("tv")), "v", "inner")
    return map_rows(both, run, "u long, v long, similarity double", rows=4096)


def _ordered(a, b):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def near_links(base: DataFrame, reps: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (u, v, similarity) between representatives and (node, component) of all linked ones."""
    entry = reps.select("row_id", "n_shingles", F.explode("bands").alias("bucket"))
    sizes = entry.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    entry = stash(entry.join(sizes, "bucket"))  # bucket, row_id, n_shingles, size
    share = entry.groupBy("row_id").agg(F.sum("size").alias("shared"))
    ranked = entry.join(share, "row_id").select("bucket", "row_id", "n_shingles", "shared")
    hub = ranked.groupBy("bucket").agg(F.max(F.struct("shared", (-F.col("row_id")).alias("neg"), "n_shingles")).alias("h")).select("bucket", (-F.col("h.neg")).alias("hub"), F.col("h.n_shingles").alias("n_hub"))
    fits = F.least("n_shingles", "n_hub") >= F.lit(threshold) * F.greatest("n_shingles", "n_hub")
    star = entry.join(hub, "bucket").filter((F.col("row_id") != F.col("hub")) & fits).select(*_ordered(F.col("row_id"), F.col("hub")))
    star = stash(star.groupBy("u", "v").agg(F.count("*").alias("n_bands")).drop("n_bands"))
    texts = stash(pick(base.select("row_id", "text"), entry.select("row_id").distinct(), "row_id"))
    links = stash(verify(star, texts, threshold))
    comp = components(links.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    # members of a bucket in different components have not been compared yet, unless one of them was the hub
    placed = stash(entry.join(comp, entry["row_id"] == comp["node"], "left").select("bucket", "row_id", "n_shingles", "size", F.coalesce("component", "row_id").alias("component")))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("bucket")
    more = stash(cross_links(stash(placed.join(mixed, "bucket", "left_semi")), star, texts, threshold))
    if more.isEmpty():
        return links, comp
    # the new links join components, so only the graph of components is searched again
    joined = components(more.select(F.col("cu").alias("src"), F.col("cv").alias("dst")))
    nodes = comp.unionByName(more.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("cu").alias("component")), F.struct(F.col("v").alias("node"), F.col("cv").alias("component")))).alias("x")).select("x.*")).distinct()
    whole = nodes.join(joined.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return links.unionByName(more.select("u", "v", "similarity")), stash(whole)


#: Buckets of up to SMALL members are compared pair by pair (at most half of SMALL rows a member), larger ones in tiles of TILE members.
SMALL, TILE = 16, 512


def cross_links(members: DataFrame, done: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v, similarity, cu, cv) between members of a bucket in different components, enough to join all that belong together.

    A large bucket is cut into tiles by a hash of the member; every two tiles meet in one task, which counts common
    shingles through an inverted list and returns a spanning forest of the links it finds, never its pairs.
    """
    few, many = members.filter(F.col("size") <= SMALL), members.filter(F.col("size") > SMALL)
    a, b = few.alias("a"), few.alias("b")
    possible = (F.col("a.row_id") < F.col("b.row_id")) & (F.col("a.component") != F.col("b.component")) & (F.least("a.n_shingles", "b.n_shingles") >= F.lit(threshold) * F.greatest("a.n_shingles", "b.n_shingles"))
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & possible).select(F.col("a.row_id").alias("u"), F.col("b.row_id").alias("v")).distinct().join(done, ["u", "v"], "left_anti")
    home = members.select("row_id", "component").distinct()
    found = verify(pairs, texts, threshold).join(home.select(F.col("row_id").alias("u"), F.col("component").alias("cu")), "u").join(home.select(F.col("row_id").alias("v"), F.col("component").alias("cv")), "v")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    many = many.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("row_id"), F.col("tiles")).cast("int"))
    many = many.join(texts, "row_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    many = many.select("bucket", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"), "own", "row_id", "component", "text")
    schema = "u long, v long, similarity double, cu long, cv long"
    tiled = many.groupBy("bucket", "ta", "tb").applyInPandas(lambda pdf: _tile_links(pdf, threshold), schema)
    return found.select("u", "v", "similarity", "cu", "cv").unionByName(tiled)


def _tile_links(pdf, threshold: float):
    """Links between different components of the rows of two tiles: a spanning forest of the components they join."""
    import pandas as pd

    pdf = pdf.sort_values("row_id", ignore_index=True)
    sets = [np.unique(shingles(words_of(t))) for t in pdf["text"]]
    ids, comp, own = pdf["row_id"].tolist(), pdf["component"].tolist(), pdf["own"].to_numpy()
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holder = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    start = np.searchsorted(flat[order], np.arange(flat.max() + 2))
    holder, ends = holder[order], size.cumsum()
    parent = {c: c for c in comp}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    apart = own.min() != own.max()
    out = []
    for i in range(1, len(sets)):
        codes = flat[ends[i] - size[i]:ends[i]]
        both = np.bincount(np.concatenate([holder[start[k]:start[k + 1]] for k in codes]), minlength=len(sets))[:i]
        sim = both / (size[:i] + size[i] - both)
        for j in np.flatnonzero((sim >= threshold) & ((own[:i] != own[i]) | (not apart))).tolist():
            x, y = root(comp[i]), root(comp[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((ids[j], ids[i], float(sim[j]), comp[j], comp[i]))
    return pd.DataFrame(out, columns=["u", "v", "similarity", "cu", "cv"]).astype({"u": "int64", "v": "int64", "similarity": "float64", "cu": "int64", "cv": "int64"})


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 24, rows: int = 6, row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, row_id, class_id, class_size, n_links, kept.

    ``class_id`` is the smallest doc_id of the class, ``n_links`` the verified links found for the row's text
    to different texts, ``kept`` is true for one row of each class. ``row`` names a column that
    already tells the rows apart.
    """
    if row is None:
        docs, row = numbered(ids_and_text(docs))
    base = ids_and_text(docs, F.col(row).alias("row_id"))
    prints = stash(sketch(base, bands, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("r")
    own = stash(prints.groupBy("key").agg(first, F.count("*").alias("n")).select("key", "n", "r.no_id", "r.doc_id", "r.row_id"))
    reps = prints.select("row_id", "n_shingles", "bands").join(own.select("row_id"), "row_id", "left_semi").filter("n_shingles > 0")
    links, comp = near_links(base, reps, threshold)
    degree = links.select(F.explode(F.array("u", "v")).alias("row_id")).groupBy("row_id").agg(F.count("*").alias("n_links"))
    member = own.join(comp.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("component", F.coalesce("component", "row_id")).join(degree, "row_id", "left")
    member = stash(member.select("key", "n", "no_id", "doc_id", "row_id", "component", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    top = member.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "row_id")).alias("c"), F.sum("n").alias("class_size")).select("component", F.col("c.doc_id").alias("class_id"), F.col("c.row_id").alias("keep_row"), "class_size")
    out = stash(member.join(top, "component").select("key", "class_id", "keep_row", "class_size", "n_links"))
    return prints.select("doc_id", "row_id", "key").join(out, "key").select("doc_id", "row_id", "class_id", "class_size", "n_links", (F.col("row_id") == F.col("keep_row")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, all columns kept."""
    base, row = numbered(docs)
    stay = near_duplicates(base, row=row, **options).filter("kept").select(F.col("row_id").alias(row))
    return pick(base, stay, row).drop(row)
