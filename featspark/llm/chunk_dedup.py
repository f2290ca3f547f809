"""Repeated passages by content-defined chunking with a gear rolling hash.

A gear hash runs over the bytes of every whole text: ``h = (h << 1) + gear[byte]``, 32 bits wide, so it depends
on the last bytes only. A position is a candidate where five middle bits are zero, and a border where no
other candidate lies in the ``apart`` bytes before it. Borders thus follow from some twenty bytes of
content wherever these stand, and an insertion moves only the borders beside it. Chunks are compared by a
64-bit digest; a chunk is repeated if another document has it. Neighbouring repeated chunks form a passage,
reported from ``min_words`` words on, which no chance collision of one digest reaches.

Rows of the shuffle are (digest, document, number); texts are never moved. Counting is pre-aggregated, so a
chunk of a third of all documents costs a row per partition, and the join back is split where it is skewed.

Defined results: null and empty texts have no chunk; a text without a border is one chunk; repeats inside one
document only are not passages; rows with the same doc_id are one document; a null doc_id is a document of its
own, larger than all others; every occurrence is reported, ``kept`` for the document with the smallest doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, map_rows, stash

GEAR = np.random.Generator(np.random.Philox(key=32)).integers(0, 1 << 32, 256, dtype=np.uint32)
MASK = np.uint32(0x1F << 16)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte; doubling the window five times gives all 32 shifts."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)
    return h


def borders(data: bytes, apart: int = 4) -> np.ndarray:
    """Ends of the chunks, the end of the data last."""
    h = gear_hashes(np.frombuffer(data, np.uint8))
    at = np.flatnonzero((h & MASK) == 0) + 1
    if len(at):
        far = np.ones(len(at), bool)
        far[1:] = at[1:] - at[:-1] > apart
        at = at[far & (at < len(data))]
    return np.append(at, len(data))


def chunk(docs: DataFrame, apart: int = 4) -> DataFrame:
    """doc_id, row_id, digests, ends (byte offsets), words (words begun before each end) of every text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        digests, ends, words = [], [], []
        for t in b["text"]:
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            if not data:
                digests.append([]), ends.append([]), words.append([])
                continue
            e = borders(data, apart)
            stops = e.tolist()
            digests.append([xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip([0, *stops], stops)])
            blank = _BLANK[np.frombuffer(data, np.uint8)]
            begins = ~blank
            begins[1:] &= blank[:-1]
            ends.append(e)
            words.append(np.searchsorted(np.flatnonzero(begins), e))
        flat = np.array([d for x in digests for d in x], np.uint64).view(np.int64)
        offsets = pa.array(np.cumsum([0, *map(len, digests)]), pa.int32())
        return pa.RecordBatch.from_arrays([b["doc_id"], b["row_id"], pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(ends, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))], names=["doc_id", "row_id", "digests", "ends", "words"])

    rows_in = ids_and_text(docs).withColumn("row_id", F.monotonically_increasing_id())
    return map_rows(rows_in, run, "doc_id long, row_id long, digests array<long>, ends array<int>, words array<int>", rows=512)


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """row_id, number, first_doc of every chunk that another document has as well.

    A document is (no_id, doc): its doc_id, or, where that is null, its row; null ids are larger than all others.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", "row_id").alias("doc"))
    c = chunks.select(order.alias("at"), "row_id", F.posexplode("digests").alias("number", "digest"))
    # written apart from the join, so that the join has an exchange of its own and can split a frequent digest
    twice = stash(c.groupBy("digest").agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a <> b").select("digest", F.col("a").alias("first_doc")))
    return c.join(twice, "digest").select("row_id", "number", "first_doc")


def passages(docs: DataFrame, min_words: int = 12, apart: int = 4) -> DataFrame:
    """doc_id, start_byte, end_byte, n_words, n_chunks, first_doc_id, kept: one row per repeated passage and place."""
    chunks = stash(chunk(docs, apart))
    hits = repeated_chunks(chunks).groupBy("row_id").agg(F.collect_list(F.struct("number", "first_doc")).alias("hits"))
    both = chunks.select("doc_id", "row_id", "ends", "words").join(hits, "row_id")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, row, ends, words, found in zip(*(b[c].to_pylist() for c in ("doc_id", "row_id", "ends", "words", "hits"))):
            own = (doc is None, row if doc is None else doc)
            found = sorted((h["number"], (h["first_doc"]["no_id"], h["first_doc"]["doc"])) for h in found)
            at = 0
            while at < len(found):
                stop = at + 1
                while stop < len(found) and found[stop][0] == found[stop - 1][0] + 1:
                    stop += 1
                a, z = found[at][0], found[stop - 1][0]
                n = words[z] - (words[a - 1] if a else 0)
                if n >= min_words:
                    others = [f for _, f in found[at:stop]]
                    no_id, first = min(others)
                    out.append((doc, ends[a - 1] if a else 0, ends[z], n, stop - at, None if no_id else first, all(f == own for f in others)))
                at = stop
        cols = [*zip(*out)] or [[]] * 7
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "start_byte", "end_byte", "n_words", "n_chunks", "first_doc_id", "kept"])

    return map_rows(both, run, "doc_id long, start_byte long, end_byte long, n_words long, n_chunks long, first_doc_id long, kept boolean", rows=512)
