"""The index of op2 in tiles, and words as Latin-1, against plain products and the plain pattern."""

from collections import Counter

import numpy as np
import pyarrow as pa

from featspark.llm import toxicity


def test_tiles_and_lists_give_all_products():
    rng = np.random.default_rng(3)
    vectors = []
    for i in range(600):  # two languages of 150 terms each, 100 terms of both; every sixth text is long
        own = np.concatenate([np.arange(150) + 150 * (i % 2), np.arange(300, 400)])
        ids = np.sort(rng.choice(own, 90 if i % 6 == 0 else 12, replace=False))
        w = rng.random(len(ids)) + 0.1
        vectors.append((ids, w / np.sqrt(w @ w)))
    plain = np.zeros((600, 400))
    for i, (ids, w) in enumerate(vectors):
        plain[i, ids] = w
    index = toxicity.Postings(vectors, 400)
    used = [np.array([(row[ids] >= 0).sum() for ids, _ in vectors]) for row, _, _ in index.tiles]
    assert len(used) > 1 and any((n > toxicity.FEW).any() for n in used) and any(((n > 0) & (n <= toxicity.FEW)).any() for n in used) and len(index.weight)
    assert np.allclose(index.scores(vectors), plain @ plain.T, rtol=0, atol=1e-13)


def test_words_are_those_of_the_pattern():
    texts = [None, "", "Été ª µ² 12ab_c ÿÀ", "“Quote” naïve—Ωmega İstanbul", "K Kelvin", "a_b c1d²e x\x85y\xa0z\x1cq", "ſtraße ẞ", "".join(map(chr, range(256)))]
    for t in texts:
        got = [w.decode("latin-1") if isinstance(w, bytes) else w for w in toxicity.words_of(t)]
        assert got == toxicity.WORD.findall((t or "").lower())
    latin, other = (toxicity.Terms(np.zeros(0, np.int64)).codes([t])[0] for t in ("naïveté abc", "naïveté abc Ω"))
    assert set(latin[0]) < set(other[0])  # a word has the same terms in either form


def test_codes_past_the_cache(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE", 3)
    texts = ["alpha beta gamma", "delta alpha alpha", "epsilon", "", "beta delta alpha"]
    whole = toxicity.Terms(np.zeros(0, np.int64)).codes(texts)
    vocabulary = np.unique(np.concatenate([c for c, _ in whole[:2]]))
    terms = toxicity.Terms(vocabulary)
    for t, (hashes, n) in zip(texts, whole):
        (codes, m), = terms.codes([t])
        back = np.concatenate([codes[codes < 0], vocabulary[codes[codes >= 0]]])
        assert np.array_equal(np.sort(back), hashes) and n.sum() == m.sum()
    df = terms.found_in(texts)
    assert df.tolist() == [sum(t in c for c, _ in whole) for t in vocabulary]


def test_terms_are_those_of_plain_words(monkeypatch):
    """Terms and counts of odd words against plain strings; only words that numpy cannot read eight letters at a time are hashed one by one."""
    rng = np.random.default_rng(7)
    letters = {"latin": list("abcdeéßÿªµ"), "other": list("abéΩжવ語")}
    word = lambda kind: "".join(rng.choice(letters[kind], int(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 15, 16, 17, 24, 63, 64, 65, 200]))))
    texts = [None, "", " .", "àªµ વ abcdefgh abcdefghi", "Straße " * 3, *(" ".join(word(k) for _ in range(300)) for k in ("latin", "other", "latin"))]
    texts.append(texts[-1] + " \x85Ω")

    def plain(t):
        bag = Counter()
        for w in toxicity.WORD.findall((t or "").lower()):
            bag.update([w, *(w[:k] + "~" for k in (4, 5, 6) if len(w) >= k)])
        return bag

    calls, digest = [], toxicity.digest
    monkeypatch.setattr(toxicity, "digest", lambda x: calls.append(x) or digest(x))
    bags, code = list(map(plain, texts)), {}
    for bag, (codes, counts) in zip(bags, toxicity.Terms(np.zeros(0, np.int64)).codes(texts)):
        assert sorted(bag.values()) == sorted(counts.tolist()) and (np.diff(codes) > 0).all() and (codes < 0).all()
        for t in bag:  # a term has one code in whichever text it is
            alone = toxicity.Terms(np.zeros(0, np.int64)).codes([t]) if "~" not in t else None
            if alone is not None:
                assert set(alone[0][0]) <= set(codes)
                code.setdefault(t, set()).update(alone[0][0])
    assert len({frozenset(c) for c in code.values()}) == len(code)
    calls.clear()
    many = [" ".join("".join(rng.choice(letters["latin"][:8], 12)) for _ in range(400)) for _ in range(5)]
    vocabulary = np.unique(np.concatenate([c for c, _ in toxicity.Terms(np.zeros(0, np.int64)).codes(many[:2])]))
    assert toxicity.Terms(vocabulary).found_in(many).tolist() == [sum(x in set(c) for c, _ in toxicity.Terms(np.zeros(0, np.int64)).codes(many)) for x in vocabulary]
    assert not calls


def test_portions_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE", 5)
    texts = ["ab", None, "abcdefgh", "", "c", "dd", "eeeee", None]
    parts = list(toxicity.portions(pa.array(texts), rows=4))
    assert sum(parts, []) == texts and all(sum(len(t or "") for t in p[:-1]) < 5 and len(p) <= 4 for p in parts)
    assert list(toxicity.portions(pa.array([], pa.string()))) == []
