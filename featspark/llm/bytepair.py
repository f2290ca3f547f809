"""A public byte-level BPE vocabulary inside a task: pieces of a text, merges, bytes of an id."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex

# The piece pattern of this family of vocabularies, once for any text and once with plain
# ranges for texts below U+0250, which Python's own matcher runs several times faster.
ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_S, _L, _N = "\\t-\\r \\x85\\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")
SPACES = regex.compile(r"\p{White_Space}{2,}")
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}

#: Entries a worker keeps per cache; beyond it, pieces are computed anew. It bounds memory, not results.
CACHE = 400_000


def pieces(text: str) -> list[str]:
    """The parts of a text over whose borders no token reaches."""
    return (ANY if BEYOND_LATIN.search(text) else LATIN).findall(text)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that vocabulary files of this family use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """A dictionary that computes what it lacks and keeps at most CACHE results."""

    def __init__(self, fn):
        self.fn = fn

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) < CACHE:
            self[key] = value
        return value


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()

        def raw(token):
            return bytes(letters[c] for c in token)

        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*self.id_of.values(), *self.special.values()]))
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.ranks[self.id_of[a], self.id_of[b]] = (r, self.id_of[a + b])
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.id_of))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: Pairs of neighbouring bytes inside some token; between all other pairs a border is certain.
        self.joined = {t[i:i + 2] for t in self.id_of for i in range(len(t) - 1)}

    def sections(self, text: str) -> list[tuple[str, int | None]]:
        """Plain stretches with None, special strings with their id, in order."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [(text, None)]
        return [(x, self.special.get(x) if k % 2 else None) for k, x in enumerate(self.split_special.split(text)) if x]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one fragment: the pair learned first is joined first, from the left."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        ranks = self.ranks
        while len(ids) > 1:
            best = None
            for pair in zip(ids, ids[1:]):
                found = ranks.get(pair)
                if found is not None and (best is None or found < best):
                    best, joined = found, pair
            if best is None:
                break
            out, i, last, new = [], 0, len(ids) - 1, best[1]
            while i <= last:
                if i < last and ids[i] == joined[0] and ids[i + 1] == joined[1]:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for fragments of any length."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heap = [(r, i, a, b, new) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and path."""
    return Vocabulary(path)


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
