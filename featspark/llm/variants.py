"""Groups of spelling variants: all words at edit distance one, found with bidirectional FM indexes.

Words are counted over all texts. A near word agrees with a word in its left or in its right half, so both halves of
every word are keys. Words are sent to the shards of their keys, once as *queries* (their own halves) and up to four
times as *entries* (the halves a word one longer, equal or one shorter would have). A shard joins its entries with
delimiters into one text and builds its FM index in both directions. Every query matches one half exactly, from the
middle outwards to the delimiter, and then turns round and extends across the other half, allowing one inserted, deleted
or replaced character, up to the other delimiter. Suffix-rank intervals of both directions are kept in step; all
queries of a shard advance together as arrays. A near word that agrees in both halves' common part is counted on the
left only, so every pair is found exactly once. A shard returns per query the number of its near words and the best of
them, never the pairs.

A key with more than ``HOT`` entries (a half that very many words share) is split: what is left of such words is halved
again and again, and these smaller keys take its place, so no shard grows with one key.

Defined results: null text has no words; a null doc_id is written as an empty string in the digest; repeated rows count
as often as they occur; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ids_and_text, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a shard's text, and entries of one key beyond which the key is split.
SHARD_LETTERS, HOT = 60_000, 2_000


def word_counts(docs: DataFrame, least: int = 3, shortest: int = 5) -> DataFrame:
    """word, n: runs of letters after the contract's deletions, with ``shortest`` characters and ``least`` occurrences or more."""
    d = ids_and_text(docs).filter("text is not null")
    doc = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    d = d.select(doc.alias("doc"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run"))
    d = d.filter(F.length("run") >= shortest).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("doc", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % 97 == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    return d.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def open_span(length: int, path: str) -> tuple[int, int]:
    """Where the error may be after the choices of ``path``: 1 = the left half is exact, 0 = the right one."""
    a, b = 0, length
    for step in path:
        m = (a + b) // 2
        a, b = (m, b) if step == "1" else (a, m)
    return a, b


def query_key(word: str, path: str) -> str:
    a, b = open_span(len(word), path)
    return f"{path} {word[:a]} {word[b:]}"


def entry_keys(word: str, path: str) -> list[str]:
    """Keys under which a query of one letter less, as many or one more would look for ``word``."""
    out = {}
    for length in (len(word) - 1, len(word), len(word) + 1):
        a, b = open_span(length, path)
        out[f"{path} {word[:a]} {word[len(word) - (length - b):] if length > b else ''}"] = None
    return list(out)


def common_path(query: str, found: str, depth: int) -> str:
    """The choices a pair takes: left where the left half agrees."""
    a, b, path = 0, len(query), ""
    for _ in range(depth):
        m = (a + b) // 2
        if found[:m] == query[:m]:
            a, path = m, path + "1"
        else:
            b, path = m, path + "0"
    return path


KEYED = "word string, n long, path string, key long, entry boolean"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n, path, entry or null for both) to rows of the two longer paths."""
    for batch in batches:
        rows = []
        for word, n, path, entry in zip(*(batch[c].to_pylist() for c in ("word", "n", "path", "entry"))):
            for step in "10":
                if entry is not True:
                    rows.append((word, n, path + step, query_key(word, path + step), False))
                if entry is not False:
                    rows += [(word, n, path + step, k, True) for k in entry_keys(word, path + step)]
        words, ns, paths, keys, entries = zip(*rows) if rows else [()] * 5
        codes = [zlib.crc32(k.encode()) << 31 ^ zlib.adler32(k[::-1].encode()) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(paths, pa.string()), pa.array(codes, pa.int64()), pa.array(entries, pa.bool_())], names=["word", "n", "path", "key", "entry"])


def keyed(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Queries and entries with their keys; keys of more than ``hot`` entries are split further while their words can be."""
    rows = stash(words.select("word", "n", F.lit("").alias("path"), F.lit(None).cast("boolean").alias("entry")).mapInArrow(_keyed, KEYED))
    out, longest, depth = None, words.agg(F.max(F.length("word"))).first()[0] or 0, 1
    while True:
        often = cut_lineage(rows.filter("entry").groupBy("key").agg(F.count("*").alias("entries")).filter(F.col("entries") > hot).select("key"))
        if 1 << depth > longest or often.isEmpty():
            return rows if out is None else out.unionByName(rows)
        calm = rows.join(often, "key", "left_anti")
        out = calm if out is None else out.unionByName(calm)
        rows = stash(rows.join(often, "key", "left_semi").select("word", "n", "path", "entry").distinct().mapInArrow(_keyed, KEYED))
        depth += 1


class BothWays:
    """FM index of a text and of its reverse; an interval is [low, low + size) here and [back, back + size) there."""

    def __init__(self, text: np.ndarray, letters: int):
        self.n, self.letters = len(text), letters
        self.ranks, self.smaller = [], []
        self.suffixes = self._suffixes(text)
        for t, order in ((text, self.suffixes), (text[::-1], self._suffixes(text[::-1]))):
            seen = np.zeros((self.n + 1, letters), np.int32)
            seen[np.arange(1, self.n + 1), t[order - 1]] = 1
            np.cumsum(seen, axis=0, out=seen)
            self.ranks.append(seen)
            self.smaller.append(np.cumsum(seen, axis=1, dtype=np.int32) - seen)
        counts = np.bincount(text, minlength=letters)
        self.first = (np.cumsum(counts) - counts).astype(np.int64)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Order of all rotations by prefix doubling; the text ends with its least letter, so it is that of the suffixes."""
        n, k = len(text), 1
        rank = text.astype(np.int64)
        while True:
            pair = rank * (n + 1) + np.roll(rank, -k)
            order = np.argsort(pair, kind="stable")
            new = np.empty(n, np.int64)
            s = pair[order]
            new[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            rank, k = new, 2 * k
            if k >= n or rank[order[-1]] == n - 1:
                return order

    def step(self, way: int, low, back, size, letter):
        """Extend by ``letter`` to the left (way 0) or to the right (way 1): the new low, back, size."""
        near, far = (low, back) if way == 0 else (back, low)
        ranks, smaller = self.ranks[way], self.smaller[way]
        start = ranks[near, letter]
        new = ranks[near + size, letter] - start
        far = far + smaller[near + size, letter] - smaller[near, letter]
        near = self.first[letter] + start
        return (near, far, new) if way == 0 else (far, near, new)

    def next_letters(self, way: int, low, back, size):
        """Pairs (which interval, letter) with at least one occurrence, delimiters left out."""
        near = low if way == 0 else back
        found = self.ranks[way][near + size] > self.ranks[way][near]
        found[:, 0] = False
        return np.nonzero(found)


def near_words(queries: list[tuple[str, str]], entries: list[str], keep) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query number, entry number): all entries at distance one of a query that ``keep`` accepts.

    A query is (word, path); the first letter of its path tells which half is exact.
    """
    letters = {c: k for k, c in enumerate(sorted(set("".join(entries))), 1)}
    text = np.array([x for w in entries for x in (0, *map(letters.__getitem__, w))] + [0], np.int64)
    owner = np.cumsum(text == 0) - 1  # the delimiter before a word belongs to it
    index = BothWays(text, len(letters) + 1)
    found = []
    for left_exact in (True, False):
        mine = [k for k, (_, path) in enumerate(queries) if path.startswith("1") == left_exact]
        if mine:
            found.append(_search(index, letters, owner, queries, np.array(mine), left_exact))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    good = [keep(queries[q], entries[e]) for q, e in pairs.tolist()]
    pairs = pairs[np.array(good, bool)] if len(pairs) else pairs
    return pairs[:, 0], pairs[:, 1]


def _search(index: BothWays, letters: dict, owner: np.ndarray, queries: list, mine: np.ndarray, left_exact: bool) -> np.ndarray:
    words = [queries[k][0] for k in mine.tolist()]
    length = np.array([len(w) for w in words])
    code = np.full((len(words), length.max() + 2), -1, np.int64)  # -1: a letter no entry has; columns 0 and length + 1: delimiters
    for k, w in enumerate(words):
        code[k, :len(w) + 2] = [0, *(letters.get(c, -1) for c in w), 0]
    middle = length // 2
    # The exact half outwards: from its inner end to the delimiter; then the other half from its inner end to the other delimiter.
    way = 0 if left_exact else 1
    move = -1 if left_exact else 1
    at = middle.copy() if left_exact else middle + 1
    last = np.zeros(len(words), np.int64) if left_exact else length + 1
    who = np.arange(len(words))
    low, back, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), index.n)
    exact = []
    while len(who):
        letter = code[who, at]
        low, back, size = index.step(way, low, back, size, np.maximum(letter, 0))
        alive = (size > 0) & (letter >= 0)
        ended = alive & (at == last[who])
        exact.append(np.stack([who[ended], low[ended], back[ended], size[ended]], 1))
        go = alive & ~ended
        who, at, low, back, size = who[go], at[go] + move, low[go], back[go], size[go]
    who, low, back, size = np.concatenate(exact).T
    # Turn round. ``at`` is the next letter of the word; ``wrong`` tells whether the error is spent.
    way, move = 1 - way, -move
    at = middle[who] + 1 if left_exact else middle[who]
    end = length + 1 if left_exact else np.zeros(len(words), np.int64)
    wrong = np.zeros(len(who), bool)
    hits = []

    def took(who, at, low, back, size, wrong, letter):
        low, back, size = index.step(way, low, back, size, np.maximum(letter, 0))
        ok = (size > 0) & (letter >= 0)
        return [x[ok] for x in (who, at, low, back, size, wrong)]

    while len(who):
        # Deletions consume a letter of the word and none of the text: close over them first.
        skip = ~wrong & (at != end[who])
        who, low, back, size = (np.concatenate([x, x[skip]]) for x in (who, low, back, size))
        at, wrong = np.concatenate([at, at[skip] + move]), np.concatenate([wrong, np.ones(int(skip.sum()), bool)])
        letter = code[who, at]
        closing = (at == end[who]) & wrong
        w, _, lo, _, s, _ = took(who[closing], at[closing], low[closing], back[closing], size[closing], wrong[closing], letter[closing])
        if len(w):
            rows = np.repeat(np.arange(len(w)), s)
            place = lo[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(s) - s, s)
            # The match starts at a delimiter: that of its word.
            hits.append(np.stack([w[rows], owner[index.suffixes[place]]], 1))
        on = at != end[who]
        parts = [took(who[on], at[on] + move, low[on], back[on], size[on], wrong[on], letter[on])]
        free = np.flatnonzero(~wrong)
        if len(free):
            k, c = index.next_letters(way, low[free], back[free], size[free])
            k = free[k]
            other = (c != letter[k]) & on[k]
            true = np.ones(len(k), bool)
            parts.append(took(who[k][other], at[k][other] + move, low[k][other], back[k][other], size[k][other], true[other], c[other]))  # replaced
            parts.append(took(who[k], at[k], low[k], back[k], size[k], true, c))  # inserted
        who, at, low, back, size, wrong = (np.concatenate(x) for x in zip(*parts))
    if not hits:
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate(hits)
    return np.stack([mine[pairs[:, 0]], pairs[:, 1]], 1)


BEST = "word string, n long, found long, best_n long, best string"


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by shard: the near words of its queries, counted, with the best of each."""

    def answered(queries: list, entries: dict) -> pa.RecordBatch:
        names = sorted(entries)
        same = lambda q, e: q[0] != e and common_path(q[0], e, len(q[1])) == q[1]
        rows = []
        if queries and names:
            who, what = near_words([(w, p) for w, _, p in queries], names, same)
            best: dict[int, tuple[int, str]] = {}
            for q, e in zip(who.tolist(), what.tolist()):
                mark = (-entries[names[e]], names[e])
                if q not in best or mark < best[q]:
                    best[q] = mark
            count = np.bincount(who, minlength=len(queries))
            rows = [(queries[q][0], queries[q][1], int(count[q]), -m[0], m[1]) for q, m in best.items()]
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["word", "n", "found", "best_n", "best"])

    shard, queries, entries = None, [], {}
    for batch in batches:
        for s, word, n, path, entry in zip(*(batch[c].to_pylist() for c in ("shard", "word", "n", "path", "entry"))):
            if s != shard:
                if shard is not None:
                    yield answered(queries, entries)
                shard, queries, entries = s, [], {}
            if entry:
                entries[word] = n
            else:
                queries.append((word, n, path))
    if shard is not None:
        yield answered(queries, entries)


def near_counts(words: DataFrame, shard_letters: int = SHARD_LETTERS, hot: int = HOT) -> DataFrame:
    """word, n, n_near, best, best_n for every word; best is the near word of largest n (then the least), null if there is none."""
    rows = keyed(words, hot)
    size = rows.filter("entry").agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = max(1, -(-int(size) // shard_letters))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    dealt = dealt.repartition(F.col("shard")).sortWithinPartitions("shard").select("shard", "word", "n", "path", "entry")
    found = dealt.mapInArrow(_shard, BEST)
    none = words.select("word", "n", F.lit(0).cast("long").alias("found"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best"))))
    return found.unionByName(none).groupBy("word", "n").agg(F.sum("found").alias("n_near"), best.alias("b")).select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def forms(near: DataFrame, ratio: int = 2) -> DataFrame:
    """Adds form, form_n and root. Every step at least doubles n, so chains are short and jumping ends after a few joins."""
    ok = F.col("best_n") >= ratio * F.col("n")
    table = stash(near.select("word", "n", "n_near", F.when(ok, F.col("best")).alias("form"), F.when(ok, F.col("best_n")).alias("form_n")))
    links = table.filter("form is not null").select("word", F.col("form").alias("to"))
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        links_next = cut_lineage(links.join(ahead, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
        moved = not links_next.filter("moved").isEmpty()
        links = links_next.drop("moved")
        if not moved:
            break
    return table.join(links, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n over all texts."""
    return forms(near_counts(stash(word_counts(docs))))
