"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are letter words and their first four, five and six letters; every term of the whole text counts. Words are
known by hashes of 62 bits, first letters by their Latin-1 characters as a number, or by hashes of 61 bits where they have others. The index holds the labelled examples, a bounded, documented sample of training rows
(``per_class`` expected rows of each label, chosen by a hash of the identifier); document frequencies are counted
over all documents, for terms of the examples as well as for those that occur in no example.

A term without an example cannot add to a cosine, only to the length of the document's vector. So the nearest
examples are found by the terms of the index alone, and the squares of the other weights are added up by a
join on numbers afterwards. Examples are put into groups that share frequent words (languages, as a rule). The frequent
terms of a group are rows of its dense tile, all other weights are sparse postings; nothing is skipped. A text with many
terms of a tile is scored by a product, one with few by adding up their rows. Neighbours vote with weight 1 / (distance + 0.05); a monotone map
fitted on the sample, each example scored without itself, calibrates the share. The closest examples are evidence.

Defined results: null text counts as empty; a text without any term of an example gets the label rate of
training examples without terms, or else of all; without a positive training label every score is 0; equal
cosines are ordered by doc_id of the example; repeated label rows of a document count once, toxic if any says so;
rows are independent.
"""

from __future__ import annotations

import pickle
import re
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest as digest

from .common import ids_and_text, map_rows, stash

WORD = re.compile(r"[^\W\d_]+")
#: Latin-1 with a space in place of all that is in no word.
LETTERS = bytes(c if WORD.match(chr(c)) else 32 for c in range(256))
#: Terms that are rows of the dense tile of a group, at most; a row also needs one weight in SPARSE places.
DENSE, SPARSE = 1536, 12
#: Groups of examples, and how many terms of a tile a text may have to be scored row by row.
GROUPS, FEW = 8, 48
#: Texts are coded together until they hold so many letters. It bounds memory, not results.
CACHE = 1 << 21
#: Odd, for products that mix the bits of a word; a word of more than LONG letters is hashed by xxh3.
MIX, LONG = np.uint64(0x9E3779B97F4A7C15), 64
#: Characters that are no Latin-1.
OTHER = re.compile("[^\x00-\xff]")


def words_of(text: str | None) -> list:
    """The letter words of a whole text in lower case, as Latin-1 where it has no other characters."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(LETTERS).split()
    except UnicodeEncodeError:
        return WORD.findall(text)


def _hash(data: bytes) -> int:
    return int.from_bytes(digest(data), "big")


def latin_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the terms of each different word of lower-case Latin-1 texts, how many of the four columns are in use,
    and of each word in the texts its number there and the number of its text. Words are read eight letters at a time."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    blob = (b" " + b" ".join(texts) + b" " * 16).translate(LETTERS)
    edge = np.flatnonzero(np.diff(np.frombuffer(blob, np.uint8) != 32)) + 1
    start, length = edge[::2], edge[1::2] - edge[::2]
    eights = np.ndarray(len(blob) - 7, "<u8", blob, strides=(1,))
    keep = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    first = eights[start] & keep[np.minimum(length, 8)]
    whole = first * MIX
    whole ^= whole >> np.uint64(32)
    for at in range(8, LONG, 8):
        more = np.flatnonzero(length > at)
        if not len(more):
            break
        h = (whole[more] ^ (eights[start[more] + at] & keep[np.minimum(length[more] - at, 8)])) * MIX
        whole[more] = h ^ (h >> np.uint64(32))
    for i in np.flatnonzero(length > LONG).tolist():
        whole[i] = _hash(blob[start[i]:start[i] + length[i]])
    whole |= np.uint64(3 << 62)
    order = np.argsort(whole)
    new = np.diff(whole[order], prepend=np.uint64(0)) != 0
    number = np.empty(len(whole), np.int64)
    number[order] = np.cumsum(new) - 1
    some = order[new]
    codes = np.stack([whole[some], *(first[some] & keep[k] | np.uint64(1 << 63) for k in (4, 5, 6))], axis=1).view(np.int64)
    return codes, np.clip(length[some] - 2, 1, 4), number, np.searchsorted(size.cumsum(), start - 1, side="right")


def other_terms(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same codes and numbers of columns for words that have other characters than Latin-1."""

    def code(letters: str) -> int:
        return 1 << 61 | _hash(letters.encode("utf-8", "surrogatepass")) & (1 << 61) - 1 if OTHER.search(letters) else int.from_bytes(letters.encode("latin-1"), "little")

    codes = [[3 << 62 | _hash(w.encode("utf-8", "surrogatepass")), *(1 << 63 | code(w[:k]) for k in (4, 5, 6))] for w in words]
    return np.array(codes, np.uint64).reshape(-1, 4).view(np.int64), np.clip([len(w) - 2 for w in words], 1, 4).astype(np.int64)


def portions(texts: pa.Array, rows: int = 256):
    """The texts in lists of at most ``rows``, shorter where they are long."""
    for lo in range(0, len(texts), rows):
        part, size = [], 0
        for t in texts[lo:lo + rows].to_pylist():
            part.append(t)
            size += len(t or "")
            if size >= CACHE:
                yield part
                part, size = [], 0
        if part:
            yield part


def places(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``terms`` in the ascending ``vocabulary``, and which of them are there."""
    at = np.minimum(np.searchsorted(vocabulary, terms), max(len(vocabulary) - 1, 0))
    return at, vocabulary[at] == terms if len(vocabulary) else np.zeros(len(terms), bool)


class Terms:
    """Codes of the terms of texts: the place in an ascending vocabulary of codes, or the code itself, which is negative.

    Texts are coded many at a time: their different words are looked up once, all together.
    """

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary

    def coded(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all terms of the whole texts, each as often as it occurs, and the numbers of their texts."""
        latin, other, owner = [], [], []
        for i, t in enumerate(texts):
            t = (t or "").lower()
            try:
                latin.append(t.encode("latin-1"))
            except UnicodeEncodeError:
                words = words_of(t)
                latin.append(" ".join([w for w in words if not OTHER.search(w)]).encode("latin-1"))
                found = [w for w in words if OTHER.search(w)]
                other.extend(found)
                owner.extend([i] * len(found))
        codes, width, number, text = latin_terms(latin)
        if other:
            numbers = {w: n for n, w in enumerate(dict.fromkeys(other), len(codes))}
            parts = other_terms(list(numbers))
            codes, width = np.concatenate([codes, parts[0]]), np.concatenate([width, parts[1]])
            number, text = np.concatenate([number, [numbers[w] for w in other]]), np.concatenate([text, owner])
        order = np.argsort(codes, axis=None)  # places are looked up in ascending order, which stays in the processor's cache
        at, hit = places(self.vocabulary, codes.ravel()[order])
        codes.ravel()[order[hit]] = at[hit]
        width = width[number]
        return codes[number][np.arange(4) < width[:, None]], np.repeat(text, width)

    def known(self, codes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of ``n`` texts the places of its terms in the vocabulary, ascending, their counts, and where each text ends."""
        use, many = codes >= 0, max(len(self.vocabulary), 1)
        pairs = text[use] * many + codes[use]
        pairs.sort()
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        counts, pairs = np.diff(first, append=len(pairs)), pairs[first]
        ends = np.searchsorted(pairs, np.arange(1, n + 1) * many)
        return pairs - np.repeat(np.arange(n) * many, np.diff(ends, prepend=0)), counts, ends

    def absent(self, codes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the codes of terms that are not in the vocabulary."""
        use = codes < 0
        codes, text = codes[use], text[use]
        order = np.lexsort((codes, text))
        codes, text = codes[order], text[order]
        first = np.flatnonzero((np.diff(codes, prepend=0) != 0) | (np.diff(text, prepend=-1) != 0))
        return codes[first], np.diff(first, append=len(codes)), np.searchsorted(text[first], np.arange(n), side="right")

    def codes(self, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each whole text the codes of its terms, ascending, and their counts."""
        found = self.coded(texts)
        parts = [self.absent(*found, len(texts)), self.known(*found, len(texts))]
        split = [[np.split(x, ends[:-1]) for x in (codes, counts)] for codes, counts, ends in parts]
        return [tuple(map(np.concatenate, zip(a, b))) for a, b in zip(*(zip(*x) for x in split))] if texts else []

    def found_in(self, texts: list) -> np.ndarray:
        """In how many of the texts each term of the vocabulary occurs."""
        return np.bincount(self.known(*self.coded(texts), len(texts))[0], minlength=len(self.vocabulary))


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(False))


def training_sample(labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, toxic, share: about ``per_class`` training rows of each label, and the share of its class they are."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = F.broadcast(known.groupBy("toxic").count().select("toxic", F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("count")).alias("share")))
    draw = F.pmod(F.xxhash64(F.lit("tox"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return known.join(sizes, "toxic").filter(draw < F.col("share"))


def example_terms(examples: DataFrame) -> list[dict]:
    """The examples with the terms and counts of their whole texts, by doc_id, each once."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pairs = Terms(np.zeros(0, np.int64)).codes(b["text"].to_pylist())
        made = [pa.array([x[0].tobytes() for x in pairs], pa.binary()), pa.array([x[1].astype(np.int32).tobytes() for x in pairs], pa.binary())]
        return pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], b["share"], *made], names=["doc_id", "toxic", "share", "terms", "tfs"])

    rows = map_rows(examples, run, "doc_id long, toxic int, share double, terms binary, tfs binary").dropDuplicates(["doc_id"]).toArrow().to_pylist()
    for r in rows:
        r["terms"], r["tfs"] = np.frombuffer(r["terms"], np.int64), np.frombuffer(r["tfs"], np.int32)
    return sorted(rows, key=lambda r: r["doc_id"])


def tied_to_label(vocabulary: np.ndarray, rows: list[dict], least: float) -> np.ndarray:
    """Of each term, whether a chi-square test on at least three examples ties it to the label by ``least``."""
    with_, toxic = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for r in rows:
        at = places(vocabulary, r["terms"])[0]
        with_[at] += 1
        toxic[at] += r["toxic"] > 0
    n, p = len(rows), sum(r["toxic"] > 0 for r in rows)
    det = toxic * (n - p) - (with_ - toxic) * p
    return (with_ >= 3) & (n * det * det / np.maximum(p * (n - p) * with_ * np.maximum(n - with_, 1.0), 1e-300) >= least)


def document_frequencies(docs: DataFrame, terms) -> tuple[int, np.ndarray]:
    """How many documents there are, and in how many of them each term of the (broadcast) vocabulary occurs; added up in each task."""

    def run(batches):
        v = terms.value
        n, seen = 0, np.zeros(len(v.vocabulary), np.int64)
        for b in batches:
            n += b.num_rows
            for texts in portions(b["text"]):
                seen += v.found_in(texts)
        t = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *t], pa.int64()), pa.array([n, *seen[t]], pa.int64())], names=["t", "n"])

    got = ids_and_text(docs).select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    t, n = got["t"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(len(terms.value.vocabulary), np.int64)
    out[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), out


def alike(rows: np.ndarray, k: int) -> np.ndarray:
    """A group for each column of ``rows``: some rounds of k-means by cosine, from columns at even steps."""
    x = rows / np.maximum(np.linalg.norm(rows, axis=0), 1e-9)
    centres = x[:, np.linspace(0, x.shape[1] - 1, k).astype(int)]
    for _ in range(8):
        group = np.argmax(centres.T @ x, axis=0)
        centres = x @ np.eye(k, dtype=x.dtype)[group]
        centres /= np.maximum(np.linalg.norm(centres, axis=0), 1e-9)
    return group


class Postings:
    """Inverted index of unit vectors: a dense tile for the frequent terms of each group of examples, sparse lists for the rest.

    Its size is bounded by the terms of the examples, whose number is a parameter.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        ids = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        owner = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        group = self._groups(ids, weight, owner, n_terms) if self.n else np.zeros(0, np.int64)
        order = np.argsort(group, kind="stable")
        self.place = np.argsort(order, kind="stable")  # example -> its column when groups lie side by side
        size = np.bincount(group, minlength=GROUPS)
        self.tiles, sparse = [], np.ones(len(ids), bool)  # a tile: term -> its row, weights, first column
        for g in np.flatnonzero(size):
            mine = np.flatnonzero(group[owner] == g)
            count = np.bincount(ids[mine], minlength=n_terms)
            often = np.argsort(-count, kind="stable")[:DENSE]
            often = often[count[often] > max(16, size[g] / SPARSE)]
            row = np.full(n_terms, -1, np.int16)
            row[often] = np.arange(len(often))
            mine = mine[row[ids[mine]] >= 0]
            first = int(size[:g].sum())
            block = np.zeros((len(often), size[g]))
            block[row[ids[mine]], self.place[owner[mine]] - first] = weight[mine]
            sparse[mine] = False
            if len(often):
                self.tiles.append((row, block, first))
        ids, weight, owner = ids[sparse], weight[sparse], owner[sparse]
        order = np.argsort(ids, kind="stable")
        self.weight, self.owner = weight[order], owner[order]
        self.start = np.searchsorted(ids[order], np.arange(n_terms + 1))

    def _groups(self, ids: np.ndarray, weight: np.ndarray, owner: np.ndarray, n_terms: int) -> np.ndarray:
        """Groups of examples by their weights of the 256 terms with most postings."""
        often = np.argsort(-np.bincount(ids, minlength=n_terms), kind="stable")[:256]
        row = np.full(n_terms, -1, np.int16)
        row[often] = np.arange(len(often))
        use = row[ids] >= 0
        rows = np.zeros((len(often), self.n), np.float32)
        rows[row[ids[use]], owner[use]] = weight[use]
        return alike(rows, GROUPS)

    def scores(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The products of the queries (terms, weights) with all examples."""
        terms = np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in queries)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in queries)])
        return self.products(terms, weights, np.cumsum([len(ids) for ids, _ in queries], dtype=np.int64))

    def products(self, terms: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """:meth:`scores` of queries that lie one behind the other, with their ends."""
        query = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        out = np.zeros((len(ends), self.n))
        for row, block, first in self.tiles:
            r = row[terms]
            use = np.flatnonzero(r >= 0)
            r, i, w = r[use], query[use], weights[use]
            n = np.bincount(i, minlength=len(ends))
            end = n.cumsum()
            q = np.zeros((len(ends), len(block)))
            q[i, r] = w
            many = np.flatnonzero(n > FEW)
            out[many, first:first + block.shape[1]] = q[many] @ block
            for j in np.flatnonzero((n > 0) & (n <= FEW)):
                part = slice(end[j] - n[j], end[j])
                out[j, first:first + block.shape[1]] = w[part] @ block[r[part]]
        out = out[:, self.place]
        first = self.start[terms]
        size = self.start[terms + 1] - first
        use = np.flatnonzero(size)
        ends = np.searchsorted(use, ends)
        first, size, weights = first[use], size[use], weights[use]
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            if a < b:
                at = np.repeat(first[a:b] - size[a:b].cumsum() + size[a:b], size[a:b])
                at += np.arange(len(at))
                x = self.weight.take(at)
                x *= np.repeat(weights[a:b], size[a:b])
                out[i] += np.bincount(self.owner.take(at), x, self.n)
        return out

    def best(self, acc: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k largest positive products and their examples; ties in the order of the examples."""
        if without >= 0:
            acc[without] = 0.0
        edge = np.partition(acc, len(acc) - k)[len(acc) - k] - 1e-11 if len(acc) > k else 0.0  # only the best and their ties are sorted
        who = np.flatnonzero(acc >= edge if edge > 0 else acc > 0)
        who = who[np.lexsort((who, -np.round(acc[who], 12)))[:k]]
        return acc[who], who

    def nearest(self, ids: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.best(self.scores([(ids, w)])[0], k, without)


#: Its name while terms were few and blocks were visited by bound.
BlockMaxIndex = Postings


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression by pooling neighbours: knots and their values."""
    if not len(x):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.01) / (p[2] + 0.02) if p[2] > 0 else 0 for p in pools])


class Votes:
    """The model without its calibration: vocabulary, idf, terms and labels of the examples.

    It travels as term numbers and counts, packed; every worker makes weights and index of them once.
    """

    def __init__(self, rows: list[dict], vocabulary: np.ndarray, idf: np.ndarray, k: int):
        self.terms, self.idf, self.k = Terms(vocabulary), idf, k
        kept, empty, ids, tfs = [], [], [], []
        for r in rows:
            at = places(vocabulary, r["terms"])[0].astype(np.int32)
            use = idf[at] > 0
            (kept if use.any() else empty).append(r)
            ids.append(at[use])
            tfs.append(r["tfs"][use])
        self.ends = np.cumsum([0, *(len(x) for x in ids if len(x))])
        self.ids, self.tfs = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (ids, tfs))
        self.doc_id = np.array([r["doc_id"] for r in kept], np.int64)
        self.y = np.array([float(r["toxic"] > 0) for r in kept])
        self.c = np.array([1 / r["share"] for r in kept])
        weight = sum(1 / r["share"] for r in empty)
        everyone = weight + self.c.sum()
        self.rate = (sum((r["toxic"] > 0) / r["share"] for r in empty) / weight if weight else float((self.y * self.c).sum() / everyone) if everyone else 0.0)

    def __getstate__(self):
        state = {k: v for k, v in self.__dict__.items() if k not in ("index", "vectors")}
        return zlib.compress(pickle.dumps(state | {"ids": np.diff(self.ids, prepend=np.int32(0))}), 1)

    def __setstate__(self, packed):
        self.__dict__.update(pickle.loads(zlib.decompress(packed)))
        self.ids = np.cumsum(self.ids, dtype=np.int32)

    @cached_property
    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [slice(a, b) for a, b in zip(self.ends, self.ends[1:])]
        return [(self.ids[p], self.unit(self.ids[p], self.tfs[p])[0]) for p in parts]

    @cached_property
    def index(self) -> Postings:
        return Postings(self.vectors, len(self.terms.vocabulary))

    def unit(self, ids: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, float]:
        w = (1 + np.log(tfs)) * self.idf[ids]
        length = float(np.sqrt(w @ w))
        return w / max(length, 1e-300), length

    def queries(self, codes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of the index in each of ``n`` texts with weights of length one, where each text ends, and that length before."""
        ids, tfs, ends = self.terms.known(codes, text, n)
        w, owner = (1 + np.log(tfs)) * self.idf[ids], np.repeat(np.arange(n), np.diff(ends, prepend=0))
        length = np.sqrt(np.bincount(owner, w * w, n))
        w /= np.maximum(length, 1e-300)[owner]
        use = np.flatnonzero(w > 0)  # an idf of 0 takes a term out
        return ids[use], w[use], np.searchsorted(use, ends), length

    def share(self, sims: np.ndarray, who: np.ndarray) -> float:
        if not len(sims):
            return self.rate
        v = self.c[who] / (1.05 - np.minimum(sims, 1.0))
        return float((v * self.y[who]).sum() / v.sum())


def own_shares(spark, model) -> np.ndarray:
    """The share that every example of the (broadcast) model gets from the others."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, out = model.value, []
        ids = b["id"].to_pylist()
        for lo in range(0, len(ids), 256):
            part = ids[lo:lo + 256]
            out += [m.share(*m.index.best(acc, m.k, without=i)) for i, acc in zip(part, m.index.scores([m.vectors[i] for i in part]))]
        return pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.float64())], names=["id", "share"])

    got = map_rows(spark.range(len(model.value.y)), run, "id long, share double").toArrow()
    out = np.zeros(len(model.value.y))
    out[got["id"].to_numpy()] = got["share"].to_numpy()
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, k: int = 32, per_class: int = 4000, least: float = 0.0) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (closest examples), similarity (their cosines).

    All terms of all texts count. ``least`` > 0 is for callers who want only terms that a chi-square test ties to the label.
    """
    spark = docs.sparkSession
    sample = stash(training_sample(labels, per_class).coalesce(1))
    near = F.broadcast(sample)  # about 2 * per_class rows of three numbers
    rows = example_terms(ids_and_text(docs).join(near, "doc_id"))
    vocabulary = np.unique(np.concatenate([r["terms"] for r in rows])) if rows else np.zeros(0, np.int64)
    n, df = document_frequencies(docs, spark.sparkContext.broadcast(Terms(vocabulary)))
    idf = np.log((n + 1) / (df + 1.0)) + 1e-6
    if least > 0:
        idf = np.where(tied_to_label(vocabulary, rows, least), idf, 0.0)
    votes = Votes(rows, vocabulary, idf, k)
    del rows
    toxic = bool(votes.y.any()) or votes.rate > 0
    model = spark.sparkContext.broadcast(votes)

    def lists(sizes: list, values: list, kind) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, kind), *values]).astype(kind, copy=False)))

    def rank(b: pa.RecordBatch) -> pa.RecordBatch:
        m = model.value
        sims, who, length, absent, tfs, sizes = [], [], [], [], [], []
        for texts in portions(b["text"]):
            found = (*m.terms.coded(texts), len(texts))
            *queries, norm = m.queries(*found)
            for s, w in (m.index.best(acc, k) for acc in m.index.products(*queries)):
                sims.append(s)
                who.append(w)
            codes, n, ends = m.terms.absent(*found)
            length.append(norm)
            if least <= 0:
                absent.append(codes)
                tfs.append(n)
                sizes.extend(np.diff(ends, prepend=0))
            else:
                sizes.extend([0] * len(texts))
        near = list(map(len, sims))
        made = [lists(near, sims, np.float64), lists(near, who, np.int32), pa.array(np.concatenate([np.zeros(0), *length])), lists(sizes, absent, np.int64), lists(sizes, tfs, np.int32)]
        return pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], *made], names=["doc_id", "held_out", "sims", "who", "length", "absent", "tfs"])

    ranked = map_rows(ids_and_text(docs, held_out().alias("held_out")), rank, "doc_id long, held_out boolean, sims array<double>, who array<int>, length double, absent array<long>, tfs array<int>")
    ranked = stash(ranked.withColumn("row_id", F.monotonically_increasing_id()))
    knots = monotone(own_shares(spark, model), votes.y, votes.c)

    # a term of no example is in as many documents as it has rows here
    away = ranked.select("row_id", F.explode(F.arrays_zip("absent", "tfs")).alias("x")).select("row_id", F.col("x.absent").alias("term"), F.col("x.tfs").alias("tf"))
    seen = away.groupBy("term").agg(F.count("*").alias("df"))
    weight = (1 + F.log(F.col("tf").cast("double"))) * (F.log(F.lit(n + 1.0) / (F.col("df") + 1.0)) + 1e-6)
    rest = away.join(seen.hint("merge"), "term").groupBy("row_id").agg(F.sum(weight * weight).alias("rest"))
    whole = ranked.drop("absent", "tfs").join(rest.hint("merge"), "row_id", "left").drop("row_id")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = model.value
        score, ids, cosines = [], [], []
        for sims, who, length, rest in zip(b["sims"].to_pylist(), b["who"].to_pylist(), b["length"].to_pylist(), b["rest"].to_pylist()):
            who = np.array(who, np.int64)
            sims = np.array(sims) * (length / np.sqrt(length * length + rest)) if rest else np.array(sims)
            s = float(np.interp(m.share(sims, who), *knots)) if len(sims) else m.rate
            score.append(min(1.0, max(0.0, s)) if toxic else 0.0)
            ids.append(m.doc_id[who[:3]].tolist())
            cosines.append(np.round(sims[:3], 6).tolist())
        return pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score, pa.float64()), pa.array([int(x >= 0.5) for x in score], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))],
                                          names=["doc_id", "held_out", "score", "predicted", "evidence", "similarity"])

    return map_rows(whole, run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>, similarity array<double>")
