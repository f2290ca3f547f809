"""Exact token counts at every prefix of a text by dynamic programming.

For a byte-level BPE the last token of a string's encoding, taken over all prefixes, determines everything:
the encoding of ``s[:i]`` is the encoding of ``s[:i - len(t)]`` followed by ``t`` for exactly one token ``t``
that ends at ``i`` and is *compatible* with the last token before it (the two, encoded together, stay apart).
So ``count[i] = count[i - len(t)] + 1``, filled from left to right. Tables of pieces are computed once per
distinct piece, kept in a bounded cache, and laid end to end with running offsets. The stored array answers
"how many tokens has this prefix" and "how much text fits into k tokens" without encoding again.

Three places need care because the piece borders of a prefix differ from those of the text: runs of white space
(a prefix that ends inside one is one piece), contractions (half of one is two pieces) and special strings
(half of one is ordinary text). They are counted separately, so every entry equals the encoding of that prefix.

Defined results: null text counts as empty; an empty text has the single entry 0; rows are independent.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytepair import CONTRACTIONS, SPACES, Memo, pieces, public_path, vocabulary
from .common import ids_and_text, map_rows


class PrefixCounter:
    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.apart = Memo(lambda ab: self.v.merge(self.v.bytes_of[ab[0]] + self.v.bytes_of[ab[1]]) == [*ab])
        self.table = Memo(self._table)

    def last_tokens(self, data: bytes) -> list[int]:
        """count[i] for i = 1..len(data)."""
        id_of, longest, apart = self.v.id_of, self.v.longest, self.apart
        last, count = [-1], [0]
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                t = id_of.get(data[j:i])
                if t is not None and (j == 0 or apart[last[j], t]):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
        return count

    def _table(self, piece: str) -> bytes:
        """Counts at the ends of the piece's characters, 4 bytes each."""
        if piece in CONTRACTIONS and len(piece) == 3:
            whole = self.last_tokens(piece.encode())[-1]
            half = self.last_tokens(piece[:1].encode())[-1]
            rest = self.last_tokens(piece[1:2].encode())[-1]
            return np.array([half, half + rest, whole], np.int32).tobytes()
        data = piece.encode()
        count = self.last_tokens(data)
        if len(data) == len(piece):
            return np.array(count[1:], np.int32).tobytes()
        ends = [i for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]
        return np.array([count[i] for i in ends], np.int32).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        found = pieces(text)
        within = np.frombuffer(b"".join(map(self.table.__getitem__, found)), np.int32).copy()
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = lengths.cumsum() - 1
        total = within[ends].cumsum()
        within[lengths[0]:] += np.repeat(total[:-1], lengths[1:]).astype(np.int32)
        for m in SPACES.finditer(text):
            before = int(within[m.start() - 1]) if m.start() else 0
            within[m.start():m.end()] = before + np.frombuffer(self.table[m.group()], np.int32)
        return within

    def counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i from 0 to len(text)."""
        sections = self.v.sections(text)
        if len(sections) == 1 and sections[0][1] is None:
            return np.concatenate([np.zeros(1, np.int32), self._plain(text)])
        out, base, before = [np.zeros(1, np.int32)], 0, ""
        for part, special in sections:
            if special is None:
                got = self._plain(part)
                before = part
            else:
                got = self._plain(before + part)[len(before):]
                offset = int(self._plain(before)[-1]) if before else 0
                got = got - offset
                got[-1] = 1
                before = ""
            out.append(got + base)
            base = int(out[-1][-1])
        return np.concatenate(out)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, counts array<int>: entry i is the exact number of tokens of the first i characters."""
    path = path or public_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array([c.counts(t or "") for t in b["text"].to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return map_rows(ids_and_text(docs), run, "doc_id long, counts array<int>", rows=64)


def fitting_chars(counts: np.ndarray, budget: int) -> int:
    """Length of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars: read off the stored prefix counts."""
    path = path or public_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        size, n, fit = [], [], []
        for t in b["text"]:
            text = t.as_py() or ""
            counts = c.counts(text)
            size.append(len(text.encode()))
            n.append(int(counts[-1]))
            fit.append(fitting_chars(counts, limit))
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return map_rows(ids_and_text(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
