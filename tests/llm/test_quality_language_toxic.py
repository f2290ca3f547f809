"""Line CRF, language profiles and toxicity neighbours against plain definitions, and their edge cases."""

import re
from collections import Counter
from itertools import product

import numpy as np

from featspark.llm import language_id, line_crf, toxicity

W = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(text):
    text = text or ""
    words = W.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


TEXTS = [None, "", " \n ", "a b c a b c", "x\ny\nx\nx ", "é ñ z # $$ <|>", "a a a a a", "one two", "\x1ca\x1d b", "w " * 5000, "line one\n\n\nline one\nline two\r\nline one\r\n"]


def test_counts():
    rng = np.random.default_rng(3)
    for t in TEXTS + [" ".join(rng.choice(list("abcd"), 40)) + "\n" * int(rng.integers(3)) for _ in range(30)]:
        assert line_crf.measure(t)[0] == brute_counts(t), repr(t)


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(0)
    for n in range(1, 7):
        field = line_crf.LineField(rng.normal(size=(line_crf.N_OBS, 2)), rng.normal(size=(2, 2)))
        obs = np.stack([rng.integers(a, b, n) for a, b in zip(line_crf.OFFSETS, line_crf.OFFSETS[1:])], 1)
        e = field.emit[obs].sum(1)

        def score(y):
            return sum(e[i, v] for i, v in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))

        assert score(tuple(field.decode(obs))) == max(map(score, product((0, 1), repeat=n)))


def quality_tables(spark):
    rng = np.random.default_rng(9)
    plain = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(90)) + "." for _ in range(60)]
    docs = [(i, t if i % 2 else t.replace(" ", "$$$ ").upper(), "s", True) for i, t in enumerate(plain)]
    docs += [(None, "x", None, None), (99, None, "s", None), (1, docs[1][1], "s", True), (98, "word " * 40000, "s", False)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, kept boolean"), spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 1, None), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_line_quality(spark):
    docs, labels = quality_tables(spark)
    got = line_crf.line_quality(docs, labels).collect()
    assert len(got) == docs.count()
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] == bool(i % 2) for i in range(60)) and not kept[99] and not kept[98]
    assert all(r.base_failed for r in got if r.doc_id in (98, 99, None))
    stay = line_crf.keep_quality(docs, labels)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted([*range(1, 60, 2), 1])
    assert line_crf.line_quality(docs.limit(0), labels).count() == 0 and line_crf.keep_quality(docs, labels.limit(0)).count() > 30
    lines = {r.doc_id: r.lines for r in line_crf.content_lines(docs, labels).collect()}
    assert lines[3] == [0] and lines[2] == [] and lines[99] == []


def test_bundles_are_sums_of_bound_vectors():
    dims = 64
    for text in ["Ab c", "Hello, Wörld 12 x", "日本語テスト"]:
        letters = [ord(c) if c.isalpha() else language_id.BLANK for c in " " + text.lower() + " "]
        letters = [c for i, c in enumerate(letters) if not (i and c == letters[i - 1] == language_id.BLANK)]
        want = sum(np.roll(language_id.letter_vector(a, dims), 2) * np.roll(language_id.letter_vector(b, dims), 1) * language_id.letter_vector(c, dims).astype(int) for a, b, c in zip(letters, letters[1:], letters[2:]))
        got = language_id.bundles(["zz", text, ""], dims)
        assert np.array_equal(got[1], want) and not got[2].any()


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.language_profiles(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "12 !!", None, 1.0), (None, "the thing", None, 1.0), (5, "the thing and the other " * 9000, "en", 0.5), (5, "und der die das", "de", 0.5), (5, "und der die das", "de", 0.5)], "doc_id long, text string, lang string, score double")
    rows = language_id.language_profiles(odd).collect()
    assert len(rows) == 7 and all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3)) and all(0 <= r.score <= 1 for r in rows)
    assert language_id.language_profiles(odd.limit(0)).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        ids = np.sort(rng.choice(40, int(rng.integers(1, 6)), replace=False))
        w = rng.random(len(ids)) + 0.1
        vectors.append((ids, w / np.sqrt(w @ w)))
    dense = np.zeros((500, 40))
    for i, (ids, w) in enumerate(vectors):
        dense[i, ids] = w
    index = toxicity.BlockMaxIndex(vectors, 40)
    for q in range(60):
        for without in (-1, q):
            sims, who = index.nearest(*vectors[q], 10, without)
            all_ = dense @ dense[q]
            if without >= 0:
                all_[without] = 0
            order = np.lexsort((np.arange(500), -np.round(all_, 12)))[:10]
            order = order[all_[order] > 0]
            assert np.array_equal(who, order) and np.allclose(sims, all_[order])


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    clean, bad = [r.score for r in got if not r.toxic], [r.score for r in got if r.toxic]
    assert np.mean([[b > c for c in clean] for b in bad]) > 0.6  # 32 toxic examples only; larger tables give 0.95 and more


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 2 else "fine day ") + "and the rest", 0.0) for i in range(80)] + [(500, None, 0.0), (501, "", 0.0), (None, "idiot", 0.0), (7, "you idiot and the rest", 0.0), (502, "idiot " * 50000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(80)] + [(1, 0, 1), (2, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(docs, labels, least=10.0).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == 85 and len(by[7]) == 2 and all(by[i][0].predicted == i % 2 for i in range(80))
    assert by[None][0].predicted == 1 and not by[None][0].held_out and by[502][0].predicted == 1 and by[500][0].score == by[501][0].score
    assert all(r.score == 0 for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect())
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_toxicity_cosine_is_over_all_terms(spark):
    """Against brute force: every term of the whole text counts, also terms that no example has or no label is tied to."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeg"), int(rng.integers(1, 9))))
    pool = [word() for _ in range(60)]
    texts = [" ".join([*rng.choice(pool, 8), *(word() for _ in range(4)), f"slur{chr(97 + i // 2)}" if i % 2 else "fine"]) for i in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(36)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    examples = [r.doc_id for r in toxicity.training_sample(labels, 4000).orderBy("doc_id").collect()]
    bags = []
    for t in texts:
        bag = Counter()
        for w in t.split():
            bag.update([w, *(w[:k] + "~" for k in (4, 5, 6) if len(w) >= k)])
        bags.append(bag)
    df = Counter(t for b in bags for t in b)
    vec = [{t: (1 + np.log(n)) * (np.log(52 / (df[t] + 1)) + 1e-6) for t, n in b.items()} for b in bags]
    norm = [np.sqrt(sum(w * w for w in v.values())) for v in vec]
    assert any(t not in {x for e in examples for x in bags[e]} for t in bags[49])
    for i, v in enumerate(vec):
        cos = sorted(((-round(sum(w * vec[e].get(t, 0) for t, w in v.items()) / norm[i] / norm[e], 9), e) for e in examples))[:3]
        assert [c for c in got[i].similarity] == [round(-c, 6) for c, _ in cos] or np.allclose(got[i].similarity, [-c for c, _ in cos], atol=2e-6)
        assert got[i].evidence[0] == cos[0][1]
    assert got[50].evidence == [] and len(got) == 51
