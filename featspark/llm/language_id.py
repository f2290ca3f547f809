"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 (``dims`` of them). A trigram is bound as the product of
its letters' vectors, the first rotated by two places and the second by one, so order matters. A text is the
bundle (sum) of its trigram vectors; white space and all other non-letters are one letter "blank". A language
prototype is the bundle of the unit vectors of its training texts. The mean of all prototypes, what the
languages share, is removed from both sides, and the language with the largest cosine wins.

Prototypes are fitted on a bounded sample: about ``per_lang`` training texts of each language, chosen by a
hash of the identifier. Vectors of the letters depend on the code point only, so all workers agree.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language
by code point; without a training language every text is ``und``; rows are independent of each other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, map_rows

BLANK = 32
#: Widest batch alphabet for which trigrams are counted in a direct table; wider ones are sorted.
DIRECT = 160


@lru_cache(maxsize=200_000)
def _is_letter(cp: int) -> bool:
    return chr(cp).isalpha()


@lru_cache(maxsize=20_000)
def letter_vector(cp: int, dims: int) -> np.ndarray:
    return (np.random.Generator(np.random.Philox(key=cp)).integers(0, 2, dims) * 2 - 1).astype(np.int8)


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the distinct trigrams [g, 3], counts [texts, g]) of a batch."""
    joined = [" " + t.lower() + " " for t in texts]
    cps = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(joined)), [len(x) for x in joined])
    distinct, local = np.unique(cps, return_inverse=True) if len(cps) < 4096 else _alphabet(cps)
    letter = np.array([_is_letter(int(c)) for c in distinct])
    names = np.concatenate([[BLANK], distinct[letter]])
    place = np.zeros(len(distinct), np.int64)
    place[letter] = np.arange(1, len(names))
    x = place[local]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0) | (owner[1:] != owner[:-1])
    x, owner = x[keep], owner[keep]
    inside = owner[2:] == owner[:-2]
    a = len(names)
    codes, rows = (x[:-2] * a + x[1:-1])[inside] * a + x[2:][inside], owner[2:][inside]
    if a <= DIRECT:
        present = np.zeros(a ** 3, bool)
        present[codes] = True
        grams = np.flatnonzero(present)
        column = np.zeros(a ** 3, np.int32)
        column[grams] = np.arange(len(grams))
        at = column[codes]
    else:
        grams, at = np.unique(codes, return_inverse=True)
    counts = np.bincount(rows * max(1, len(grams)) + at, minlength=len(texts) * len(grams)).reshape(len(texts), len(grams)) if len(grams) else np.zeros((len(texts), 0))
    return np.stack([names[grams // (a * a)], names[grams // a % a], names[grams % a]], 1).reshape(-1, 3), counts.astype(np.float32)


def _alphabet(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table = np.zeros(0x110000, bool)
    table[cps] = True
    distinct = np.flatnonzero(table)
    place = np.zeros(0x110000, np.int32)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[cps]


def bundles(texts: list[str], dims: int) -> np.ndarray:
    """Bundle of every text [texts, dims]; zero for a text without a letter."""
    out = np.zeros((len(texts), dims), np.float32)
    grams, counts = trigram_counts(texts)
    for at in range(0, len(grams), 4096):  # bounds the memory of the trigram vectors
        part = grams[at:at + 4096]
        letters, index = np.unique(part, return_inverse=True)
        index = index.reshape(part.shape)
        v = np.stack([letter_vector(int(c), dims) for c in letters])
        bound = np.roll(v, 2, 1)[index[:, 0]] * np.roll(v, 1, 1)[index[:, 1]] * v[index[:, 2]]
        out += counts[:, at:at + 4096] @ bound.astype(np.float32)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


def _slices(texts: list[str | None], most: int = 2_000_000) -> list[list[int]]:
    """Positions in groups of at most ``most`` characters, one text at least."""
    out, size = [[]], 0
    for i, t in enumerate(texts):
        if out[-1] and size + len(t or "") > most:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(t or "")
    return [x for x in out if x]


def prototypes(train: DataFrame, dims: int, per_lang: int) -> dict[str, np.ndarray]:
    """Bundle of unit text vectors per language from (doc_id, text, lang)."""
    sizes = F.broadcast(train.groupBy("lang").count().select("lang", (F.lit(float(per_lang)) / F.col("count")).alias("share")))
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = train.join(sizes, "lang").filter(draw < F.col("share")).select("lang", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, texts, sums = b["lang"].to_pylist(), b["text"].to_pylist(), {}
        for part in _slices(texts):
            for i, v in zip(part, unit(bundles([texts[i] for i in part], dims))):
                sums[langs[i]] = sums.get(langs[i], 0) + v
        return pa.RecordBatch.from_arrays([pa.array([*sums], pa.string()), pa.array([x.astype(float) for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = map_rows(sample, run, "lang string, v array<double>", rows=128)
    rows = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()  # languages x dims
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(dims))[r.i] = r.x
    return out


def identify(docs: DataFrame, train: DataFrame, dims: int = 1024, per_lang: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; ``train`` has doc_id, text, lang."""
    found = prototypes(train, dims, per_lang)
    langs = sorted(found)
    p = unit(np.stack([found[x] for x in langs]).astype(np.float32)) if langs else np.zeros((0, dims), np.float32)
    mean = p.mean(0) if len(langs) > 1 else np.zeros(dims, np.float32)
    centred = unit(p - mean)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b["text"].to_pylist()
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        for part in _slices(texts) if langs else []:
            v = bundles([texts[i] or "" for i in part], dims)
            seen = (v * v).sum(1) > 0
            cos = unit(unit(v) - mean) @ centred.T
            for i, ok, c in zip(part, seen, cos):
                if ok:
                    k = int(c.argmax())
                    pred[i], score[i] = langs[k], float(min(1.0, max(0.0, c[k])))
        for i, t in enumerate(texts):
            if not t or not any(map(str.isalpha, t)):
                pred[i], score[i] = "und", 0.0
        return pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_rows(ids_and_text(docs, held_out().alias("held_out")), run, "doc_id long, held_out boolean, lang_pred string, score double", rows=256)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_profiles(docs: DataFrame, dims: int = 1024, per_lang: int = 600) -> DataFrame:
    """Learn from rows that are not held out and have a language; identify all rows."""
    train = ids_and_text(docs, F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null and doc_id is not null").filter(~held_out())
    return identify(docs, train, dims, per_lang)
