"""Ids of a lower-casing word vocabulary (``word_bpe_49k.json``) as bytes, distinct words encoded once per worker.

Its library composes characters (NFC), lower-cases, cuts a text into words, numbers and signs and encodes each of them
by itself, so that the ids of a text are those of its words in order. Texts made of characters for which Python and the
library agree one by one (see ``PLAIN``; the tests compare all of them) are cut here and looked up word by word; every
other text, and every text that holds a special string, goes to the library as a whole. Words are always encoded by the
library.
"""

from __future__ import annotations

import os
import re
import struct
from collections import ChainMap
from functools import lru_cache

import numpy as np
import regex

from .bytepair import byte_letters

# The pattern of this family of vocabularies, once for any text and once for texts below U+0250.
ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_S, _L, _N = "\\t-\\r \\x85\\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
LATIN_ONLY = re.compile("[\\x00-\\u012f\\u0131-\\u024f]*")
#: Latin, Greek, Cyrillic, punctuation, kana, Han and Hangul without combining marks, conjoining letters, the dotted
#: capital I and what NFC replaces.
PLAIN = re.compile("[\\x00-\\u012f\\u0131-\\u02ff\\u0384-\\u0386\\u0388-\\u0482\\u048a-\\u052f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf\\u3001-\\u3029\\u3041-\\u3096\\u30a0-\\u30ff\\u4e00-\\u9fff\\uac00-\\ud7a3]*")


class WordIds:
    """``ids(text)``: the ids as unsigned little-endian 32-bit numbers in one bytes object."""

    #: Entries kept, and the longest word kept; others are encoded anew with each slice of texts. Both bound memory, not results.
    ENTRIES, LONGEST = 1_200_000, 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        self.letters = {x: c for c, x in byte_letters().items()}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def words(self, text: str) -> list[str] | None:
        """The words of a text, None if only the library may cut it."""
        if any(s in text for s in self.special):
            return None
        if LATIN_ONLY.fullmatch(text):
            return LATIN.findall(text.lower())
        if PLAIN.fullmatch(text):
            return ANY.findall(text.replace("Σ", "σ").lower())  # a capital sigma is lower-cased by itself, without its context
        return None

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words by the library's model alone; the words are normalised and cut already, only bytes get their stand-ins."""
        tokenize, letters, out = self.library.model.tokenize, self.letters, {}
        for w in words:
            ids = [t.id for t in tokenize(w if w.isascii() and w.isprintable() else "".join([letters[x] for x in w.encode()]))]
            out[w] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words that are not kept are encoded together."""
        cut = [self.words(t) for t in texts]
        kept = self.kept
        missing = list(set().union(*(w for w in cut if w is not None)).difference(kept))
        known = kept
        if missing:
            found = self.encoded(missing)
            if len(kept) + len(found) > self.ENTRIES or max(map(len, missing)) > self.LONGEST:
                known = ChainMap(found, kept)
                known = {w: known[w] for words in cut if words is not None for w in words}
                room = self.ENTRIES - len(kept)
                kept.update([(w, x) for w, x in found.items() if len(w) <= self.LONGEST][:max(0, room)])
            else:
                kept.update(found)
        return [self.whole(t) if words is None else b"".join([known[w] for w in words]) for t, words in zip(texts, cut)]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker and path."""
    return WordIds(path)
