"""Quality rules by labelling the lines of a text with a linear-chain conditional random field.

Every line with a word is described by eight binned observations: symbols, capitals, exclamation marks,
digits, words inside three-word windows that repeat, number of words, mean word length, and whether the line
repeats an earlier one. The field has two labels, content and boilerplate; emission weights per observation
and a 2 x 2 transition matrix are fitted by maximum likelihood on a bounded, documented sample of labelled
documents (``per_class`` expected ones of each quality, chosen by a hash of the identifier), whose lines all
carry the label of the document. Viterbi decoding labels the lines of every whole text; the share of words on
content lines decides whether the document is kept. Hard limits (fewer than 50 words, or more than half of
all words inside repeated windows) reject it before.

Defined results: null or empty text has no words and fails; lines without a word carry no label; ties in
decoding go to content; without labels of both kinds every line is content; repeated label rows of a document
count once, as bad if any says so; rows are independent of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, map_rows, stash

# Classes of bytes.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_CLASSES = np.zeros((4, 256), bool)
_CLASSES[0] = _SYMBOL
_CLASSES[1, ord("A"):ord("Z") + 1] = True
_CLASSES[2, ord("!")] = True
_CLASSES[3, ord("0"):ord("9") + 1] = True
#: Upper bin limits of the observations.
BINS = [np.array(x) for x in ([1e-9, 0.01, 0.04], [0.02, 0.08, 0.3], [1e-9, 0.02, 0.05], [1e-9, 0.05, 0.2], [1e-9, 0.2, 0.5, 0.8], [2.5, 8.5, 30.5, 120.5], [2.5, 4.0, 8.0, 12.0], [0.5])]
OFFSETS = np.cumsum([0, *(len(b) + 1 for b in BINS)])
N_OBS = int(OFFSETS[-1])
CONTENT = 1


def repeated_words(words: list[bytes]) -> np.ndarray:
    """True for words inside a three-word window that occurs at least twice in the list."""
    n = len(words)
    mark = np.zeros(n, bool)
    if n < 4:
        return mark
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    k = len(number)
    two = ids[:-2] * k + ids[1:-1]
    if k > 2_000_000:  # the product of three numbers would not fit into 64 bits
        two = np.unique(two, return_inverse=True)[1]
    code = two * k + ids[2:]
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    mark[:-2] |= again
    mark[1:-1] |= again
    mark[2:] |= again
    return mark


def measure(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the contract; per line with a word: observation codes [lines, 8], its words, its line number."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0, 0, int(_SYMBOL[np.frombuffer(data, np.uint8)].sum()), 0, 0), np.zeros((0, len(BINS)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    blank = _BLANK[b]
    lead = (b & 0xC0) != 0x80
    solid = lead & ~blank
    begins = ~blank
    begins[1:] &= blank[:-1]
    word_at = np.flatnonzero(begins)
    breaks = np.flatnonzero(b == 10)
    line_of = np.searchsorted(breaks, word_at)
    starts = np.concatenate([[0], breaks + 1])
    n_lines = len(starts)
    mark = repeated_words(words)
    per_line = np.bincount(line_of, minlength=n_lines)
    marked = np.bincount(line_of, weights=mark, minlength=n_lines)
    cum = np.zeros(len(b) + 1, np.int64)
    np.cumsum(solid, out=cum[1:])
    ends = np.concatenate([breaks, [len(b)]])
    chars = cum[ends] - cum[starts]
    lines = np.flatnonzero(per_line)
    seen, repeat = set(), np.zeros(n_lines, bool)
    for i, line in enumerate(data.split(b"\n")):
        if per_line[i]:
            repeat[i] = line in seen
            seen.add(line)
    size = np.maximum(chars[lines], 1)
    values = []
    for cls in _CLASSES:
        at = np.flatnonzero(cls[b])
        values.append(np.bincount(np.searchsorted(breaks, at), minlength=n_lines)[lines] / size)
    values += [marked[lines] / per_line[lines], per_line[lines], chars[lines] / per_line[lines], repeat[lines]]
    obs = np.stack([np.searchsorted(e, v) + o for e, v, o in zip(BINS, values, OFFSETS)], 1)
    return (len(words), int(cum[-1]), int(_SYMBOL[b].sum()), int(repeat.sum()), int(mark.sum())), obs, per_line[lines], lines


class LineField:
    """Linear-chain CRF with labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, obs: np.ndarray) -> np.ndarray:
        """Viterbi: the most likely label sequence."""
        if not len(obs):
            return np.zeros(0, np.int64)
        e = self.emit[obs].sum(1)
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = e[0].tolist()
        back = []
        for a, b in e[1:].tolist():
            x0, x1, y0, y1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((x1 >= x0, y1 >= y0))
            s0, s1 = max(x0, x1) + a, max(y0, y1) + b
        label = int(s1 >= s0)
        out = [label]
        for p in reversed(back):
            label = int(p[label])
            out.append(label)
        return np.array(out[::-1], np.int64)

    @classmethod
    def fit(cls, sequences: list[tuple[np.ndarray, int]], rounds: int = 120, l2: float = 1e-2) -> LineField:
        """Maximum likelihood by Adam; forward-backward runs over all sequences at once, position by position."""
        emit, move = np.zeros((N_OBS, 2)), np.zeros((2, 2))
        sequences = [s for s in sequences if len(s[0])]
        if len({y for _, y in sequences}) < 2:
            emit[:, CONTENT] = 1.0
            return cls(emit, move)
        sequences.sort(key=lambda s: -len(s[0]))
        length = np.array([len(o) for o, _ in sequences])
        obs = np.concatenate([o for o, _ in sequences])
        first = np.concatenate([[0], length.cumsum()[:-1]])
        y = np.repeat([v for _, v in sequences], length)
        alive = [int((length > t).sum()) for t in range(int(length.max()))]  # sequences that reach position t
        weight = np.repeat(1.0 / np.bincount([v for _, v in sequences], minlength=2)[[v for _, v in sequences]], length) * len(sequences) / 2
        n = float(weight.sum())
        want_emit = np.zeros((N_OBS, 2))
        for lab in (0, 1):
            np.add.at(want_emit[:, lab], obs[y == lab].ravel(), np.repeat(weight[y == lab], obs.shape[1]))
        want_move = np.zeros((2, 2))
        heads = np.zeros(len(y), bool)
        heads[first] = True
        for lab in (0, 1):
            want_move[lab, lab] = weight[(y == lab) & ~heads].sum()
        m1, m2 = np.zeros(N_OBS * 2 + 4), np.zeros(N_OBS * 2 + 4)
        for step in range(1, rounds + 1):
            e = emit[obs].sum(1)
            alpha = e.copy()
            for t in range(1, len(alive)):
                at = first[:alive[t]] + t
                alpha[at] += np.logaddexp(alpha[at - 1, 0, None] + move[0], alpha[at - 1, 1, None] + move[1])
            beta = np.zeros_like(e)
            for t in range(len(alive) - 1, 0, -1):
                at = first[:alive[t]] + t
                nxt = e[at] + beta[at]
                beta[at - 1] = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
            tail = first + length - 1
            z = np.repeat(np.logaddexp(alpha[tail, 0], alpha[tail, 1]), length)
            p = np.exp(alpha + beta - z[:, None]) * weight[:, None]
            got_emit = np.stack([np.bincount(obs.ravel(), np.repeat(p[:, lab], obs.shape[1]), N_OBS) for lab in (0, 1)], 1)
            inner = np.flatnonzero(~heads)
            pair = np.exp(alpha[inner - 1][:, :, None] + move[None] + (e[inner] + beta[inner])[:, None, :] - z[inner, None, None])
            got_move = (pair * weight[inner, None, None]).sum(0)
            grad = np.concatenate([((want_emit - got_emit) / n - l2 * emit).ravel(), ((want_move - got_move) / n - l2 * move).ravel()])
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
            delta = 0.15 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
            emit, move = emit + delta[:-4].reshape(emit.shape), move + delta[-4:].reshape(2, 2)
        return cls(emit, move)


def training_lines(docs: DataFrame, labels: DataFrame, per_class: int) -> list[tuple[np.ndarray, int]]:
    """Observations and label of about ``per_class`` documents of each quality."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = F.broadcast(known.groupBy("quality").count().select("quality", (F.lit(float(per_class)) / F.col("count")).alias("share")))
    draw = F.pmod(F.xxhash64(F.lit("crf"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = F.broadcast(stash(known.join(sizes, "quality").filter(draw < F.col("share")).select("doc_id", "quality").coalesce(1)))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        obs = [measure(t)[1].astype(np.int8).tobytes() for t in b["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([b["doc_id"], b["quality"], pa.array(obs, pa.binary())], names=["doc_id", "quality", "obs"])

    rows = map_rows(ids_and_text(docs).join(sample, "doc_id").select("doc_id", "text", "quality"), run, "doc_id long, quality int, obs binary").collect()
    return [(np.frombuffer(bytes(r.obs), np.int8).astype(np.int64).reshape(-1, len(BINS)), int(r.quality > 0)) for r in sorted(rows, key=lambda r: (r.doc_id, bytes(r.obs)))]


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"


def judge(text: str | None, field: LineField, least: float) -> tuple:
    (n, chars, symbols, dup, rep), obs, words, _ = measure(text)
    failed = n < 50 or 100 * rep > 50 * n
    label = field.decode(obs)
    share = float((words * label).sum() / n) if n else 0.0
    return n, chars, symbols, dup, rep, failed, not failed and share >= least, share, len(obs), int(label.sum())


def line_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept, content_share and line numbers for every row."""
    field = LineField.fit(training_lines(docs, labels, per_class))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = [*zip(*(judge(t.as_py(), field, least) for t in b["text"]))]
        schema = pa.schema([("doc_id", pa.int64()), *((c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]]) for c in COLUMNS.split(", "))])
        return pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, f.type) for c, f in zip(cols, [*schema][1:]))], schema=schema)

    return map_rows(ids_and_text(docs), run, f"doc_id long, {COLUMNS}", rows=512)


def content_lines(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """doc_id, lines array<int>: the numbers of the lines labelled content."""
    field = LineField.fit(training_lines(docs, labels, per_class))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in b["text"]:
            _, obs, _, lines = measure(t.as_py())
            out.append(lines[field.decode(obs) == CONTENT])
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "lines"])

    return map_rows(ids_and_text(docs), run, "doc_id long, lines array<int>", rows=512)


def keep_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, least: float = 0.5) -> DataFrame:
    """``docs`` without the rejected rows, all columns kept: the verdict is computed beside each row, without a join."""
    field = LineField.fit(training_lines(docs, labels, per_class))

    @F.pandas_udf("boolean")
    def verdict(text):
        return text.map(lambda t: judge(t if isinstance(t, str) else None, field, least)[6]).astype(bool)

    return docs.filter(verdict(F.col("text").cast("string")))
