"""Sums over all feature pairs in tiles: one block of features against another.

The pair space is cut into tiles of ``block`` x ``block`` features. A task folds its Arrow batches into the tiles it
meets and sends each tile once, as one binary array; tiles are merged where they meet by (keys, bi, bj), one at a time,
and unfold into one row per pair only after the merge. So a wide dictionary spreads over as many tasks as it has tiles, a
hot layer or family cannot become a hot task, and the shuffle carries whole blocks instead of F^2 rows per task.
Folding runs in as many tasks as the session has slots (``coalesce``, no shuffle): more would only send more copies of
the tiles.

Dense input has two array columns per row. Sparse input has one row per token with the codes of its active features
and their values; its tiles come from the pairs that are active together, or from one dense product where a tile is
crowded, and only their non-zero cells travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 256
#: Rows of one product, bytes of tiles a fold holds before it sends them, pairs from which a sparse tile is multiplied densely.
SLICE, HELD, CROWDED = 2048, 512 << 20, 200_000
#: Which layer pairs a mode asks for.
MODES = {"same": lambda a, b: a == b, "adjacent": lambda a, b: b == a + 1, "cross": lambda a, b: a < b, "upper": lambda a, b: a <= b}


def matrix(col) -> np.ndarray:
    """A column of equally long lists as a float matrix."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(arr), -1).astype(np.float64, copy=False) if len(arr) else np.zeros((0, 0))


def _slots(df: DataFrame) -> DataFrame:
    return df.coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism))


def _typed(df: DataFrame, keys: list[str]):
    """SQL and Arrow types of the key columns."""
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys), [to_arrow_type(df.schema[k].dataType) for k in keys]


def fold(pairs: DataFrame, keys: list[str], product: Callable, block: int = BLOCK, x: str = "x", y: str = "y", weight: str | None = None,
         wanted: Callable[[tuple, int, int], bool] | None = None) -> DataFrame:
    """Partial tiles (keys, bi, bj, h, w, sums): ``product(xs, ys, weights)`` gives the sums of some rows as a flat array.

    ``wanted(key, bi, bj)`` says which tiles are computed at all.
    """
    src = pairs.select(*keys, x, y, *([weight] if weight else []))
    head, kinds = _typed(src, keys)
    nk = len(keys)

    def lines(acc):
        for (key, bi, bj), (h, w, sums) in acc.items():
            cols = [pa.array([v], t) for v, t in zip(key, kinds)] + [pa.array([v], pa.int32()) for v in (bi, bj, h, w)] + [pa.array([sums.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "bi", "bj", "h", "w", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                labels = list(zip(*[b.column(k).to_pylist() for k in range(nk)])) if nk else [()] * b.num_rows
                codes: dict = {}
                ids = np.array([codes.setdefault(k, len(codes)) for k in labels])
                for key, code in codes.items():
                    rows = pa.array(np.flatnonzero(ids == code))
                    xs, ys = matrix(b.column(nk).take(rows)), matrix(b.column(nk + 1).take(rows))
                    ws = b.column(nk + 2).take(rows).to_numpy(zero_copy_only=False) if weight else None
                    for bi in range(-(-xs.shape[1] // block)):
                        for bj in range(-(-ys.shape[1] // block)):
                            if wanted is not None and not wanted(key, bi, bj):
                                continue
                            xb, yb = xs[:, bi * block:(bi + 1) * block], ys[:, bj * block:(bj + 1) * block]
                            sums = product(xb, yb, ws)
                            if (key, bi, bj) in acc:
                                acc[key, bi, bj][2][:] += sums
                            else:
                                acc[key, bi, bj] = (xb.shape[1], yb.shape[1], sums)
                                size += sums.nbytes
            if size > HELD:
                yield from lines(acc)
                acc, size = {}, 0
        yield from lines(acc)

    return _slots(src).mapInArrow(run, head + "bi int, bj int, h int, w int, sums binary")


def merge(parts: DataFrame, keys: list[str], emit: Callable, columns: str) -> DataFrame:
    """Sum the tiles that meet and unfold them: ``emit(key, bi, bj, h, w, sums)`` gives the arrays i, j and the values of ``columns``.

    Tiles arrive sorted, so a task holds one at a time.
    """
    head, kinds = _typed(parts, keys)
    names = [c.split()[0] for c in columns.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    out = [types[c.split()[1]] for c in columns.split(", ")]
    nk = len(keys)

    def done(tile, h, w, sums):
        key, bi, bj = tile[:nk], tile[nk], tile[nk + 1]
        i, j, *values = emit(key, bi, bj, h, w, sums)
        n = len(i)
        cols = [pa.array([k] * n, t) for k, t in zip(key, kinds)] + [pa.array(i, pa.int32()), pa.array(j, pa.int32())] + [pa.array(v, t) for v, t in zip(values, out)]
        return pa.RecordBatch.from_arrays(cols, names=[*keys, "i", "j", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for b in batches:
            tiles = list(zip(*[b.column(k).to_pylist() for k in range(nk + 2)]))
            for k, found in enumerate(tiles):
                sums = np.frombuffer(b.column(nk + 4)[k].as_buffer(), np.float64)
                if found != tile:
                    if tile is not None:
                        yield done(tile, h, w, total)
                    tile, h, w, total = found, b.column(nk + 2)[k].as_py(), b.column(nk + 3)[k].as_py(), sums.copy()
                else:
                    total += sums
        if tile is not None:
            yield done(tile, h, w, total)

    order = [*keys, "bi", "bj"]
    return parts.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, f"{head}i int, j int, {columns}")


# moments -----------------------------------------------------------------------------------

MOMENTS = "n double, sx double, sxx double, sy double, syy double, sxy double"


def _moment_sums(xs, ys, _):
    return np.concatenate([[len(xs)], xs.sum(0), (xs * xs).sum(0), ys.sum(0), (ys * ys).sum(0), (xs.T @ ys).ravel()])


def moments(pairs: DataFrame, keys: list[str], block: int = BLOCK, x: str = "x", y: str = "y", half: Callable[[tuple], bool] | None = None) -> DataFrame:
    """n, sx, sxx, sy, syy, sxy per (keys, i, j) for rows of two dense vectors; ``half(key)``: only i < j for this key."""

    def emit(key, bi, bj, h, w, s):
        n, s = s[0], s[1:]
        sx, sxx, sy, syy, sxy = s[:h], s[h:2 * h], s[2 * h:2 * h + w], s[2 * h + w:2 * (h + w)], s[2 * (h + w):]
        i, j = np.divmod(np.arange(h * w), w)
        keep = slice(None) if half is None or not half(key) else bi * block + i < bj * block + j
        i, j, sxy = i[keep], j[keep], sxy[keep]
        return bi * block + i, bj * block + j, np.full(len(i), n), sx[i], sxx[i], sy[j], syy[j], sxy

    wanted = None if half is None else lambda key, bi, bj: bi <= bj or not half(key)
    return merge(fold(pairs, keys, _moment_sums, block, x, y, wanted=wanted), keys, emit, MOMENTS)


# joint counts ------------------------------------------------------------------------------


def _counter(nx: int, ny: int):
    def count(xs, ys, weights):
        """How often code a of feature i meets code b of feature j, in this order of axes: i, a, j, b."""
        xs, ys = xs.astype(np.int64), ys.astype(np.int64)
        h, w = xs.shape[1], ys.shape[1]
        if nx * ny <= 600:  # one product of one-hot rows
            def hot(m, k):
                out = np.zeros((len(m), m.shape[1] * k), np.float64 if weights is not None else np.float32)
                out[np.arange(len(m))[:, None], np.arange(m.shape[1])[None, :] * k + m] = 1.0
                return out
            a, b = hot(xs, nx), hot(ys, ny)
            return ((a if weights is None else a * weights[:, None]).T @ b).astype(np.float64).ravel()
        out = np.zeros(h * nx * w * ny)
        right = np.arange(w)[None, :] * ny + ys
        for i in range(h):
            cells = (xs[:, i, None] * (w * ny) + right).ravel()
            out[i * nx * w * ny:(i + 1) * nx * w * ny] = np.bincount(cells, None if weights is None else np.repeat(weights, w), nx * w * ny)
        return out

    return count


def joint_scores(pairs: DataFrame, keys: list[str], nx: int, ny: int, score: Callable, name: str, block: int = 32, weight: str | None = None,
                 half: Callable[[tuple], bool] | None = None) -> DataFrame:
    """One number per feature pair from its joint counts: ``score(counts[i, a, j, b])`` gives a matrix over (i, j).

    ``x`` and ``y`` hold codes 0 .. nx-1 and 0 .. ny-1. A tile's counts never leave it: they are merged as a block,
    scored in numpy and dropped. A score of NaN means no row.
    """

    def emit(key, bi, bj, h, w, s):
        with np.errstate(divide="ignore", invalid="ignore"):
            value = score(s.reshape(h, nx, w, ny)).ravel()
        i, j = np.divmod(np.arange(h * w), w)
        i, j = bi * block + i, bj * block + j
        keep = ~np.isnan(value) & ((i < j) if half is not None and half(key) else True)
        return i[keep], j[keep], value[keep]

    wanted = None if half is None else lambda key, bi, bj: bi <= bj or not half(key)
    return merge(fold(pairs, keys, _counter(nx, ny), block, weight=weight, wanted=wanted), keys, emit, f"{name} double")


def joint_cells(pairs: DataFrame, keys: list[str], nx: int, ny: int, block: int = 32, half: Callable[[tuple], bool] | None = None) -> DataFrame:
    """(keys, i, j, bx, by, n): the joint counts themselves, cells without any occurrence left out."""

    def emit(key, bi, bj, h, w, s):
        at = np.flatnonzero(s)
        i, a, j, b = np.unravel_index(at, (h, nx, w, ny))
        i, j = bi * block + i, bj * block + j
        keep = (i < j) if half is not None and half(key) else np.ones(len(i), bool)
        return i[keep], j[keep], a[keep].astype(np.int32), b[keep].astype(np.int32), s[at][keep].astype(np.int64)

    wanted = None if half is None else lambda key, bi, bj: bi <= bj or not half(key)
    return merge(fold(pairs, keys, _counter(nx, ny), block, wanted=wanted), keys, emit, "bx int, by int, n long")


def information(counts: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """Mutual information in nats of every (i, j): sum of p ln(p / (px py + eps)); NaN where nothing was counted."""
    n = counts.sum((1, 3))
    p = counts / n[:, None, :, None]
    outer = p.sum(3, keepdims=True) * p.sum(1, keepdims=True) + eps
    return np.where(n > 0, np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0) / np.where(p > 0, outer, 1.0)), 0.0).sum((1, 3)), np.nan)


def transfer(counts: np.ndarray, bins: int) -> np.ndarray:
    """Transfer entropy of every (i, j): axis a is x before, axis b is ``y now * bins + y before``; floor 0."""
    h, nx, w, _ = counts.shape
    c = counts.reshape(h, nx, w, bins, bins)
    n = c.sum((1, 3, 4))
    now_before, x_before, before = c.sum(1, keepdims=True), c.sum(3, keepdims=True), c.sum((1, 3), keepdims=True)
    ratio = np.where(c > 0, c * before / np.where(c > 0, now_before * x_before, 1.0), 1.0)
    return np.where(n > 0, np.maximum(0.0, (c * np.log(ratio)).sum((1, 3, 4)) / n), np.nan)


# sparse moments ----------------------------------------------------------------------------


class _Entries:
    """The entries of one block for a slice of rows, sorted by row."""

    def __init__(self, rows, cols, values, n_rows):
        self.rows, self.cols, self.values = rows, cols, values
        self.count = np.bincount(rows, minlength=n_rows)
        self.start = np.cumsum(self.count) - self.count

    def dense(self, block: int) -> np.ndarray:
        out = np.zeros((len(self.count), block))
        out[self.rows, self.cols] = self.values
        return out


def _split(codes, values, block: int) -> dict[int, _Entries]:
    offsets = np.asarray(codes.offsets)
    n = len(codes)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    flat, vals = codes.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    where = flat // block
    order = np.argsort(where, kind="stable")
    where, rows, cols, vals = where[order], rows[order], (flat % block)[order], vals[order]
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(where) else [0]
    return {int(where[a]): _Entries(rows[a:b], cols[a:b], vals[a:b], n) for a, b in zip(cuts, cuts[1:])}


def _sparse_product(a: _Entries, b: _Entries, block: int) -> np.ndarray | None:
    pairs = int((a.count * b.count).sum())
    if not pairs:
        return None
    if pairs > CROWDED:
        return (a.dense(block).T @ b.dense(block)).ravel()
    each = b.count[a.rows]
    left = np.repeat(np.arange(len(a.rows)), each)
    right = np.repeat(b.start[a.rows] - (np.cumsum(each) - each), each) + np.arange(len(left))
    return np.bincount(a.cols[left] * block + b.cols[right], a.values[left] * b.values[right], block * block)


def sparse_products(rows: DataFrame, wanted: Callable[[int, int], bool], seeds: list[tuple[int, int]] | None = None, block: int = BLOCK) -> DataFrame:
    """(i, j, sxy): sums of products over rows with arrays xi, xv, yi, yv of codes and values.

    Cells that are zero are left out, but a tile named in ``seeds`` returns all of its cells.
    """
    full = set(seeds or ())
    names, schema = ["bi", "bj", "cells", "vals"], "bi int, bj int, cells binary, vals binary"

    def lines(acc):
        for (bi, bj), sums in acc.items():
            cells = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([cells.astype(np.int32).tobytes()], pa.binary()), pa.array([sums[cells].tobytes()], pa.binary())], names=names)

    def fold_rows(batches):
        acc: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                xs = _split(b.column(0), b.column(1), block)
                ys = _split(b.column(2), b.column(3), block)
                for bi, left in xs.items():
                    for bj, right in ys.items():
                        if wanted(bi, bj) and (sums := _sparse_product(left, right, block)) is not None:
                            if (bi, bj) in acc:
                                acc[bi, bj] += sums
                            else:
                                acc[bi, bj] = sums
                if len(acc) * block * block * 8 > HELD:
                    yield from lines(acc)
                    acc = {}
        yield from lines(acc)

    def unfold(tile, sums):
        cells = np.arange(block * block) if tile in full else np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(tile[0] * block + cells // block, pa.int64()), pa.array(tile[1] * block + cells % block, pa.int64()), pa.array(sums[cells], pa.float64())], names=["i", "j", "sxy"])

    def merge_rows(batches):
        tile, total = None, None
        for b in batches:
            for k, found in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if found != tile:
                    if tile is not None:
                        yield unfold(tile, total)
                    tile, total = found, np.zeros(block * block)
                cells = np.frombuffer(b.column(2)[k].as_buffer(), np.int32)
                total[cells] += np.frombuffer(b.column(3)[k].as_buffer(), np.float64)
        if tile is not None:
            yield unfold(tile, total)

    parts = _slots(rows.select("xi", "xv", "yi", "yv")).mapInArrow(fold_rows, schema)
    if seeds:
        empty = rows.sparkSession.createDataFrame([(a, b, b"", b"") for a, b in seeds], schema)
        parts = parts.unionByName(empty)
    return parts.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(merge_rows, "i long, j long, sxy double")


class Codes:
    """Codes of (layer, feature): every layer starts at a multiple of the block, so a tile has one layer on each side."""

    def __init__(self, layers: int, width: int, block: int = BLOCK):
        self.layers, self.width, self.block = layers, width, block
        self.span = -(-width // block) * block

    @classmethod
    def of(cls, act: DataFrame, width: int | None = None, block: int = BLOCK) -> "Codes":
        top = act.agg(F.max("layer").alias("l"), F.max("feature").alias("f")).first()
        return cls((top.l if top.l is not None else -1) + 1, max(width or 0, (top.f if top.f is not None else -1) + 1), block)

    def code(self):
        return F.col("layer").cast("long") * self.span + F.col("feature")

    def layer(self, col):
        return F.floor(F.col(col) / self.span).cast("int")

    def feature(self, col):
        return (F.col(col) % self.span).cast("int")

    def block_layer(self, b: int) -> int:
        return b * self.block // self.span if self.span else 0

    def tiles(self, wanted) -> list[tuple[int, int]]:
        n = self.layers * self.span // self.block
        return [(a, b) for a in range(n) for b in range(n) if wanted(a, b)]


def sparse_rows(act: DataFrame, codes: Codes, by: tuple[str, ...] = ("protein_id", "pos"), every: DataFrame | None = None) -> DataFrame:
    """One row per group ``by`` with the arrays code and value of its activations; ``every`` names groups that may have none."""
    g = act.withColumn("code", codes.code()).groupBy(*by).agg(F.collect_list(F.struct("code", F.col("value").cast("double").alias("value"))).alias("v"))
    if every is not None:
        g = every.select(*by).distinct().join(g, list(by), "left")
    empty = F.coalesce("v", F.array().cast("array<struct<code:bigint,value:double>>"))
    return g.select(*by, F.transform(empty, lambda e: e.code).alias("code"), F.transform(empty, lambda e: e.value).alias("value"))


def _side(rows: DataFrame, i: str, v: str, names: tuple[str, str, str]) -> DataFrame:
    e = rows.select(F.explode(F.arrays_zip(F.col(i).alias("c"), F.col(v).alias("v"))).alias("e")).select("e.*")
    return e.groupBy(F.col("c").alias(names[0])).agg(F.sum("v").alias(names[1]), F.sum(F.col("v") * F.col("v")).alias(names[2]))


def sparse_moments(rows: DataFrame, codes: Codes, mode: str = "upper", all_pairs: bool = True, half: bool = True) -> DataFrame:
    """The columns of :func:`moments` with layers la, lb for rows xi, xv, yi, yv; with ``half`` only i < j inside a layer.

    ``all_pairs``: pairs that are never active together are returned too (sxy 0), as for dense vectors; the result
    then has as many rows as there are pairs. Without it only pairs with a non-zero sum are.
    """
    same = MODES[mode]

    def wanted(a, b, lay=codes.block_layer):
        la, lb = lay(a), lay(b)
        return same(la, lb) and (la != lb or not half or a <= b)

    p = sparse_products(rows, wanted, codes.tiles(wanted) if all_pairs else None, codes.block)
    if half:
        p = p.filter((codes.layer("i") != codes.layer("j")) | (F.col("i") < F.col("j")))
    p = p.filter((codes.feature("i") < codes.width) & (codes.feature("j") < codes.width))
    n = rows.agg(F.count("*").cast("double").alias("n"))
    x, y = _side(rows, "xi", "xv", ("i", "sx", "sxx")), _side(rows, "yi", "yv", ("j", "sy", "syy"))
    m = p.join(x, "i", "left").join(y, "j", "left").join(F.broadcast(n))  # one row per feature: broadcast at run time where small
    zero = lambda k: F.coalesce(k, F.lit(0.0)).alias(k)
    return m.select(codes.layer("i").alias("la"), codes.layer("j").alias("lb"), codes.feature("i").alias("i"), codes.feature("j").alias("j"), "n",
                    zero("sx"), zero("sxx"), zero("sy"), zero("syy"), "sxy")


def sparse_pair_moments(act: DataFrame, mode: str = "upper", tokens: DataFrame | None = None, width: int | None = None, all_pairs: bool = True, block: int = BLOCK) -> DataFrame:
    """Moments of feature pairs from long activations (protein_id, pos, layer, feature, value).

    ``tokens`` (protein_id, pos) are all tokens, those without any activation included; default: tokens of ``act``.
    """
    codes = Codes.of(act, width, block)
    r = sparse_rows(act, codes, every=tokens).select(F.col("code").alias("xi"), F.col("value").alias("xv"), F.col("code").alias("yi"), F.col("value").alias("yv"))
    return sparse_moments(r, codes, mode, all_pairs)


def sparse_lag_moments(act: DataFrame, lag: int = 1, tokens: DataFrame | None = None, width: int | None = None, all_pairs: bool = True, block: int = BLOCK) -> DataFrame:
    """The same for x taken ``lag`` positions earlier in the same protein; la <= lb, all i and j."""
    codes = Codes.of(act, width, block)
    r = sparse_rows(act, codes, every=tokens)
    past = r.select("protein_id", (F.col("pos") + lag).alias("pos"), F.col("code").alias("xi"), F.col("value").alias("xv"))
    both = past.join(r.withColumnsRenamed({"code": "yi", "value": "yv"}), ["protein_id", "pos"])
    return sparse_moments(both, codes, "upper", all_pairs, half=False)
