"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side in no token of the vocabulary can never be joined by a merge,
so a cut between them is certain. A text is first cut into the pieces of the vocabulary's pattern, each piece
is cut at its forced boundaries, the fragments are encoded independently and their ids concatenated. Frequent
pieces are looked up in a bounded cache. Decoding joins the bytes of the ids.

Defined results: null text counts as empty; an empty text has no ids; special strings inside a text become
their special id, as the tokenizer's default has it; rows are independent of each other, so repeated rows give
repeated results.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepair import Memo, Vocabulary, pieces, public_path, vocabulary
from .common import ids_and_text, map_rows


def fragments(v: Vocabulary, data: bytes) -> list[bytes]:
    """Cut where two neighbouring bytes occur together in no token."""
    joined, out, start = v.joined, [], 0
    for i in range(1, len(data)):
        if data[i - 1:i + 1] not in joined:
            out.append(data[start:i])
            start = i
    out.append(data[start:])
    return out


class Codec:
    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.piece = Memo(lambda p: tuple(chain.from_iterable(map(self.v.merge, fragments(self.v, p.encode())))))
        self.name = [str(i) for i in range(len(self.v.bytes_of))]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part, special in self.v.sections(text):
            if special is not None:
                ids.append(special)
            else:
                ids.extend(chain.from_iterable(map(self.piece.__getitem__, pieces(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the token ids of every whole text."""
    path = path or public_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t or "") for t in b["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_rows(ids_and_text(docs), run, "doc_id long, ids array<int>", rows=256)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    path = path or public_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array([c.decode(i or []) for i in b["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string", rows=256)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, results as digests."""
    path = path or public_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        n, ids_sha, text_sha = [], [], []
        for t in b["text"]:
            ids = c.encode(t.as_py() or "")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(c.name.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(ids_and_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, exact: a corpus ready for training; ``exact`` says that the ids decode to the text."""
    path = path or public_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids, same = [], []
        for t in b["text"]:
            text = t.as_py() or ""
            ids.append(np.array(c.encode(text), np.int32))
            same.append(c.decode(ids[-1].tolist()) == text)
        return pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], b["source"], pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["doc_id", "lang", "source", "n_tokens", "ids", "exact"])

    rows = ids_and_text(docs, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return map_rows(rows, run, "doc_id long, lang string, source string, n_tokens long, ids array<int>, exact boolean", rows=256)
