"""Statistics on feature pairs: correlation, information, causality.

Everything pairwise is computed from distributed sums (``gram``): second moments or joint code
counts, whose size depends on the feature count only and which are folded in tiles (``blocks``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec as V
from ..functions.num import c, pearson, pearson_agg, ratio
from ..session import broadcast_if_small
from ..sources.views import to_long
from . import blocks
from .gram import cross_moments, lag_moments, layer_pairs, pair_moments, with_corr
from .quantiles import percentile_table, ranks

# information -------------------------------------------------------------------------------


def mutual_info(counts: DataFrame, keys: list[str], eps: float = 1e-10) -> DataFrame:
    """Sum of p ln(p / (px py + eps)) per pair, in nats; windows stay inside one pair's cells."""
    pair = [*keys, "i", "j"]
    t, wx, wy = Window.partitionBy(*pair), Window.partitionBy(*pair, "bx"), Window.partitionBy(*pair, "by")
    tot = F.sum("n").over(t)
    p = counts.select(*pair, (F.col("n") / tot).alias("p"), (F.sum("n").over(wx) / tot).alias("px"), (F.sum("n").over(wy) / tot).alias("py"))
    return p.groupBy(*pair).agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py") + eps))).alias("mutual_info"))


def quantile_codes(vec: DataFrame, edges: int = 10) -> DataFrame:
    """Replace ``vec`` by codes 0 .. edges-1 of each feature's linear percentiles in its layer."""
    e = percentile_table(to_long(vec), ["layer", "feature"], "value", [k / (edges - 1) for k in range(edges)])
    per_layer = e.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "edges"))), lambda s: s.edges).alias("grid"))
    code = F.transform("vec", lambda v, k: F.size(F.filter(F.element_at("grid", k + 1), lambda x: x <= v)) - 1)
    return vec.join(broadcast_if_small(per_layer), "layer").select("protein_id", "pos", "layer", code.alias("vec"))


def uniform_codes(vec: DataFrame, bins: int = 10) -> DataFrame:
    """Replace ``vec`` by equal-width codes between each feature's minimum and maximum in its layer."""
    r = to_long(vec).groupBy("layer", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    per_layer = r.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("feature", "lo", "hi"))).alias("grid"))

    def code(v, k):
        g = F.element_at("grid", k + 1)
        z = F.floor(F.coalesce(F.try_divide(v - g.lo, g.hi - g.lo), F.lit(0.0)) * bins)
        return F.greatest(F.lit(0), F.least(F.lit(bins - 1), z)).cast("int")

    return vec.join(broadcast_if_small(per_layer), "layer").select("protein_id", "pos", "layer", F.transform("vec", code).alias("vec"))


def binned_mutual_info(vec: DataFrame, mode: str = "adjacent", bins: int = 10, eps: float = 1e-10) -> DataFrame:
    """MI of quantile codes of feature pairs of two layers, scored tile by tile; in ``same``/``upper`` mode only i < j inside a layer."""
    half = (lambda key: key[0] == key[1]) if mode in ("upper", "same") else None
    return blocks.joint_scores(layer_pairs(quantile_codes(vec, bins), mode), ["la", "lb"], bins, bins, lambda n: blocks.information(n, eps), "mutual_info", half=half)


def info_flow_median(vec: DataFrame) -> DataFrame:
    """Mean over feature pairs of the MI of median-split values, consecutive layers."""
    med = percentile_table(to_long(vec), ["layer", "feature"], "value", [0.5])
    per_layer = med.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "edges"))), lambda s: s.edges[0]).alias("m"))
    split = vec.join(broadcast_if_small(per_layer), "layer").select(
        "protein_id", "pos", "layer", F.zip_with("vec", "m", lambda v, m: F.when(v > m, 1.0).otherwise(0.0)).alias("vec"))
    m = pair_moments(split, "adjacent")
    return m.groupBy("la").agg(F.avg(binary_information("n", "sx", "sy", "sxy")).alias("information_flow"))


def binary_information(n: str, x: str, y: str, both: str):
    """MI in nats of two yes/no states from their counts."""
    n, x, y, k = (F.col(v) for v in (n, x, y, both))

    def term(k, a, b):
        p, q = k / n, (a / n) * (b / n)
        return F.when(k > 0, p * F.log(p / q)).otherwise(0.0)

    return term(k, x, y) + term(x - k, x, n - y) + term(y - k, n - x, y) + term(n - x - y + k, n - x, n - y)


def layer_flow(vec: DataFrame, method: str = "mutual_information", bins: int = 10) -> DataFrame:
    """Flow between every two layers over all flattened values: binned MI or |correlation|."""
    p = layer_pairs(vec, "cross")
    if method == "correlation":
        s = p.select("la", "lb", F.size("x").alias("n"), V.asum("x").alias("sx"), V.asum("y").alias("sy"), V.sq_norm("x").alias("sxx"),
                     V.sq_norm("y").alias("syy"), V.dot("x", "y").alias("sxy"))
        m = s.groupBy("la", "lb").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
        half = m.select("la", "lb", F.abs(pearson("n", "sx", "sy", "sxx", "syy", "sxy")).alias("flow"))
    elif method == "mutual_information":
        r = vec.groupBy("layer").agg(F.min(F.array_min("vec")).alias("lo"), F.max(F.array_max("vec")).alias("hi"))
        ra, rb = (F.broadcast(r.select(F.col("layer").alias(k), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}"))) for k in ("la", "lb"))
        code = lambda v, k: F.least(F.lit(bins - 1), F.floor((v - F.col(f"lo_{k}")) / (F.col(f"hi_{k}") - F.col(f"lo_{k}")) * bins)).cast("int")
        cells = p.join(ra, "la").join(rb, "lb").select("la", "lb", F.explode(F.zip_with("x", "y", lambda a, b: F.struct(code(a, "la").alias("bx"), code(b, "lb").alias("by")))).alias("c"))
        n = cells.groupBy("la", "lb", "c.bx", "c.by").agg(F.count("*").alias("n")).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
        half = mutual_info(n, ["la", "lb"]).select("la", "lb", F.col("mutual_info").alias("flow"))
    else:
        raise ValueError(f"unknown flow method {method!r}")
    return half.unionByName(half.select(F.col("lb").alias("la"), F.col("la").alias("lb"), "flow"))


# correlation -------------------------------------------------------------------------------


def pearson_matrix(vec: DataFrame, mode: str = "same", tokens: DataFrame | None = None, width: int | None = None) -> DataFrame:
    return with_corr(pair_moments(vec, mode, tokens, width)).select("la", "lb", "i", "j", "corr")


def pearson_standardized(vec: DataFrame) -> DataFrame:
    """Helper form: features standardised with sample std + 1e-8, product divided by n."""
    m = pair_moments(vec, "adjacent")
    sd = lambda s, q: F.sqrt(F.greatest(F.lit(0.0), (c(q) - c(s) * c(s) / F.col("n")) / (F.col("n") - 1))) + 1e-8
    cov = F.col("sxy") / F.col("n") - F.col("sx") * F.col("sy") / (F.col("n") * F.col("n"))
    return m.select("la", "lb", "i", "j", (cov / (sd("sx", "sxx") * sd("sy", "syy"))).alias("corr"))


def mean_abs_correlation(vec: DataFrame) -> DataFrame:
    """Mean |correlation| of distinct features over all tokens of all layers."""
    m = with_corr(cross_moments(vec.select(F.col("vec").alias("x"), F.col("vec").alias("y")), []))
    return m.filter("i <> j").agg(F.avg(F.abs("corr")).alias("feature_correlation"))


def spearman_matrix(vec: DataFrame, method: str = "average") -> DataFrame:
    """Rank correlation of feature pairs of consecutive layers; ranks are exact over all tokens."""
    r = ranks(to_long(vec), ["layer", "feature"], "value", method, ["protein_id", "pos"])
    rv = r.groupBy("protein_id", "pos", "layer").agg(F.array_sort(F.collect_list(F.struct("feature", "rank"))).alias("s"))
    rv = rv.select("protein_id", "pos", "layer", F.transform("s", lambda e: e.rank.cast("double")).alias("vec"))
    return with_corr(pair_moments(rv, "adjacent")).select("la", "lb", "i", "j", F.col("corr").alias("spearman"))


def conservation_spearman(vec: DataFrame, residues: DataFrame) -> DataFrame:
    """Spearman of token strength (mean |v|) and conservation per (protein, layer) with more than 10 positions."""
    t = vec.select("protein_id", "pos", "layer", (F.aggregate("vec", F.lit(0.0), lambda s, v: s + F.abs(v)) / F.size("vec")).alias("strength"))
    j = t.join(residues.select("protein_id", "pos", "conservation"), ["protein_id", "pos"]).filter("conservation >= 0")
    w = Window.partitionBy("protein_id", "layer")

    def rk(col):
        return F.rank().over(w.orderBy(col)) + (F.count("*").over(Window.partitionBy("protein_id", "layer", col)) - 1) / F.lit(2.0)

    r = j.select("protein_id", "layer", rk("strength").alias("a"), rk("conservation").alias("b"))
    return r.groupBy("protein_id", "layer").agg(pearson_agg("a", "b").alias("spearman"), F.count("*").alias("n")).filter("n > 10 and spearman is not null")


def conservation_correlation(vec, residues) -> DataFrame:
    return conservation_spearman(vec, residues).agg(F.avg("spearman").alias("value"), F.stddev_pop("spearman").alias("std"))


# causality ---------------------------------------------------------------------------------


def causal_strength(vec: DataFrame, tokens: DataFrame | None = None, width: int | None = None, all_pairs: bool = True) -> DataFrame:
    """(corr(x[t-1], y[t]) + 1) / 2 for all layer pairs la <= lb, i < j inside a layer; dense or sparse activations."""
    m = with_corr(lag_moments(vec, tokens, width, all_pairs)).filter("la < lb or i < j")
    return m.select("la", "lb", "i", "j", ((F.col("corr") + 1) / 2).alias("causal_strength"))


def lag_rows(vec: DataFrame, lag: int) -> DataFrame:
    """(layer, x, y): x the vector ``lag`` positions back in the same protein, y the current one."""
    w = Window.partitionBy("protein_id", "layer").orderBy("pos")
    return vec.select("layer", "pos", F.lag("vec", lag).over(w).alias("x"), F.lag("pos", lag).over(w).alias("pp"), F.col("vec").alias("y")) \
        .filter(F.col("pp") == F.col("pos") - lag).select("layer", "x", "y")


def granger_f(vec: DataFrame, max_lag: int = 3) -> DataFrame:
    """F statistic of adding x[t-lag] to the autoregression of y, per layer, pair and lag."""
    rows = None
    for lag in range(1, max_lag + 1):
        r = lag_rows(vec, lag).select("layer", F.lit(lag).alias("lag"), "x", F.concat("y", "x").alias("y"))
        rows = r if rows is None else rows.unionByName(r)
    m = cross_moments(rows, ["layer", "lag"])
    width = vec.agg(F.max(F.size("vec")).alias("f"))
    m = m.join(F.broadcast(width))
    now = m.filter("j < f").select("layer", "lag", "i", "j", "n", F.col("sxx").alias("xx"), F.col("sxy").alias("xc"), F.col("sy").alias("sc"), F.col("syy").alias("cc"))
    past = m.filter("j >= f").select("layer", "lag", "i", (F.col("j") - F.col("f")).alias("j"), F.col("sxy").alias("xy"), F.col("syy").alias("yy"), F.col("sy").alias("sl"))
    auto = now.filter("i = j").select("layer", "lag", "j", F.col("xc").alias("yc"))
    d = now.join(past, ["layer", "lag", "i", "j"]).join(auto, ["layer", "lag", "j"]).filter("i <> j")
    c1 = F.coalesce(pearson("n", "sl", "sc", "yy", "cc", "yc"), F.lit(0.0))
    mse1 = (F.col("cc") - 2 * c1 * F.col("yc") + c1 * c1 * F.col("yy")) / F.col("n")
    det = F.col("yy") * F.col("xx") - F.col("xy") * F.col("xy")
    singular = det <= 1e-9 * F.col("yy") * F.col("xx")
    b1 = F.when(~singular, F.try_divide(F.col("yc") * F.col("xx") - F.col("xc") * F.col("xy"), det)).otherwise(F.try_divide("yc", "yy"))
    b2 = F.when(~singular, F.try_divide(F.col("xc") * F.col("yy") - F.col("yc") * F.col("xy"), det)).otherwise(0.0)
    mse2 = (F.col("cc") - F.coalesce(b1, F.lit(0.0)) * F.col("yc") - F.coalesce(b2, F.lit(0.0)) * F.col("xc")) / F.col("n")
    dof = F.col("n") - 2  # pairs stay inside proteins, so each protein loses ``lag`` of them
    d = d.withColumn("mse1", mse1).withColumn("mse2", mse2).withColumn("dof", dof)
    enough = F.col("n") + F.col("lag") >= max_lag + 10
    f = F.when(enough & (F.col("mse2") < F.col("mse1")) & (F.col("mse2") > 1e-12), (F.col("mse1") - F.col("mse2")) / F.col("mse2") * F.col("dof"))
    return d.select("layer", "lag", "i", "j", f.alias("f_stat"), "dof")


def _log_gamma(x):
    coef = np.array([76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.1208650973866179e-2, -0.5395239384953e-5])
    t = x + 5.5 - (x + 0.5) * np.log(x + 5.5)
    s = 1.000000000190015 + sum(g / (x + k + 1) for k, g in enumerate(coef))
    return -t + np.log(2.5066282746310005 * s / x)


def f_tail(f: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(F(1, dof) > f): regularised incomplete beta I_x(dof/2, 1/2), x = dof / (dof + f), by Lentz's fraction."""
    a, b, x = dof / 2.0, np.full_like(f, 0.5), dof / (dof + f)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - (_log_gamma(p) + _log_gamma(q) - _log_gamma(p + q))) / p
        cc, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                cc = 1 + num / cc
                cc = np.where(np.abs(cc) < tiny, tiny, cc)
                h = h * d * cc
            if np.all(np.abs(d * cc - 1) < 1e-14):
                break
        tail = front * h
    return np.where(f <= 0, 1.0, np.where(flip, 1 - tail, tail))


@F.pandas_udf(T.DoubleType())
def f_tail_udf(f: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(f_tail(f.fillna(0).to_numpy(float), dof.to_numpy(float)))


def granger(vec: DataFrame, max_lag: int = 3, alpha: float = 0.05) -> DataFrame:
    """Best 1 - p over lags where p < alpha, else 0; the test runs on the pair table only."""
    s = granger_f(vec, max_lag).withColumn("p", f_tail_udf("f_stat", "dof"))
    score = F.when(F.col("f_stat").isNotNull() & (F.col("p") < alpha), 1 - F.col("p")).otherwise(0.0)
    return s.groupBy("layer", "i", "j").agg(F.max(score).alias("granger"))


def transfer_entropy(vec: DataFrame, bins: int = 10) -> DataFrame:
    """TE(i -> j) = sum p(y,x1,y1) ln[p(y,x1,y1) p(y1) / (p(y,y1) p(x1,y1))], floor 0, per layer."""
    rows = lag_rows(uniform_codes(vec, bins), 1)
    now = F.zip_with("y", "x", lambda now, was: now * bins + was)
    te = blocks.joint_scores(rows.select("layer", "x", now.alias("y")), ["layer"], bins, bins * bins, lambda n: blocks.transfer(n, bins), "transfer_entropy", block=16)
    return te.filter("i <> j")


def covariances(vec: DataFrame) -> DataFrame:
    """Population covariance of every ordered feature pair inside a layer."""
    m = cross_moments(layer_pairs(vec, "same"), ["la"])
    return m.select(F.col("la").alias("layer"), "i", "j", (F.col("sxy") / F.col("n") - F.col("sx") * F.col("sy") / (F.col("n") * F.col("n"))).alias("cov"))


def _residual_corr(take: int, zs: list[int]):
    @F.pandas_udf(T.DoubleType())
    def fn(i: pd.Series, j: pd.Series, ci: pd.Series, cj: pd.Series, zz: pd.Series, cij: pd.Series, cii: pd.Series, cjj: pd.Series) -> pd.Series:
        if len(i) == 0:
            return pd.Series([], dtype=float)
        ids = np.array(zs)
        a, b = np.stack(ci.to_numpy()).astype(float), np.stack(cj.to_numpy()).astype(float)
        z = np.stack([np.stack(m) for m in zz.to_numpy()]).astype(float)
        used = (ids[None, :] == i.to_numpy()[:, None]) | (ids[None, :] == j.to_numpy()[:, None])
        order = np.argsort(used, axis=1, kind="stable")[:, :take]
        ok = ~np.take_along_axis(used, order, 1)
        r = np.arange(len(i))
        wa, wb = np.zeros(order.shape), np.zeros(order.shape)
        for s in range(order.shape[1]):
            k = order[:, s]
            var = z[r, k, k]
            live = ok[:, s] & (var > 1e-15)
            for w, base in ((wa, a), (wb, b)):
                cov = base[r, k] - sum(w[:, m] * z[r, order[:, m], k] for m in range(s))
                w[:, s] = np.where(live, cov / np.where(live, var, 1.0), 0.0)
        zo = z[r[:, None, None], order[:, :, None], order[:, None, :]]
        ao, bo = np.take_along_axis(a, order, 1), np.take_along_axis(b, order, 1)
        quad = lambda u, v: np.einsum("ni,nij,nj->n", u, zo, v)
        vx = cii.to_numpy() - 2 * (wa * ao).sum(1) + quad(wa, wa)
        vy = cjj.to_numpy() - 2 * (wb * bo).sum(1) + quad(wb, wb)
        xy = cij.to_numpy() - (wb * ao).sum(1) - (wa * bo).sum(1) + quad(wa, wb)
        fine = (vx > 1e-15) & (vy > 1e-15)
        return pd.Series(np.where(fine, xy / np.sqrt(np.where(fine, vx * vy, 1.0)), 0.0))

    return fn


def partial_corr(cov: DataFrame, zs: list[int] | None = None) -> DataFrame:
    """|partial correlation| of i and j given all other features of the layer, or given the stated set ``zs``.

    Without ``zs`` it follows from the inverse of the layer's covariance matrix (pseudo-inverse if features
    depend on each other); one task holds one F x F matrix, the size of the result's layer. With ``zs`` the
    features are regressed out one by one (proper slopes) and only their rows travel.
    """
    if zs is None:
        return cov.groupBy("layer", "i").agg(F.array_sort(F.collect_list(F.struct("j", "cov"))).alias("r")).groupBy("layer").applyInPandas(_inverse_corr, "layer int, i int, j int, partial_corr double")
    ids, take = zs, len(zs)
    near = cov.filter(F.col("j").isin(ids))
    pos = F.array_position(F.array(*[F.lit(k) for k in ids]), F.col("j"))
    rows = near.groupBy("layer", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("k"), F.col("cov").alias("v")))), lambda s: s.v).alias("cz"))
    posi = F.array_position(F.array(*[F.lit(k) for k in ids]), F.col("i"))
    zz = rows.filter(F.col("i").isin(ids)).groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct(posi.alias("k"), "cz"))), lambda s: s.cz).alias("zz"))
    var = cov.filter("i = j").select("layer", F.col("i").alias("f"), F.col("cov").alias("var"))
    side = lambda k: rows.join(var, (rows.layer == var.layer) & (rows.i == var.f)).select(
        rows.layer, rows.i.alias(k), rows.cz.alias(f"c{k}"), F.col("var").alias(f"v{k}"))
    p = cov.filter("i <> j").join(side("i"), ["layer", "i"]).join(side("j"), ["layer", "j"]).join(F.broadcast(zz), "layer")
    fn = _residual_corr(take, ids)
    return p.select("layer", "i", "j", F.abs(fn("i", "j", "ci", "cj", "zz", "cov", "vi", "vj")).alias("partial_corr"))


def _inverse_corr(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("i")
    ids = pdf["i"].to_numpy(np.int32)
    m = np.array([[x["cov"] for x in r] for r in pdf["r"]], float)
    sd = np.sqrt(np.maximum(np.diag(m), 0))
    live = sd > 1e-8
    inv = np.zeros_like(m)
    inv[np.ix_(live, live)] = np.linalg.pinv(m[np.ix_(live, live)] / np.outer(sd[live], sd[live]), rcond=1e-10, hermitian=True)
    d = np.sqrt(np.maximum(np.diag(inv), 1e-300))
    out = np.where(np.outer(live, live), np.minimum(np.abs(inv) / np.outer(d, d), 1.0), 0.0)
    i, j = np.nonzero(~np.eye(len(ids), dtype=bool))
    return pd.DataFrame({"layer": np.int32(pdf["layer"].iloc[0]), "i": ids[i], "j": ids[j], "partial_corr": out[i, j]})


def combine_tests(scores: list) -> tuple:
    """Mean of the tests and their confidence: harmonic mean x (1 - pop std / mean) of the positive ones."""
    arr = F.filter(F.array(*scores), lambda s: s > 0)
    n = F.size(arr)
    mean = V.asum(arr) / n
    harm = n / F.aggregate(arr, F.lit(0.0), lambda a, s: a + 1 / s)
    std = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, s: a + (s - mean) * (s - mean)) / n)
    conf = F.when(n > 0, harm * (1 - std / (mean + 1e-10))).otherwise(0.0)
    return sum(scores[1:], scores[0]) / len(scores), conf


def pairwise_causality(vec: DataFrame, max_lag: int = 3, thr: float = 0.3) -> DataFrame:
    key = ["layer", "i", "j"]
    j = granger(vec, max_lag).join(transfer_entropy(vec), key).join(partial_corr(covariances(vec)), key)
    strength, conf = combine_tests([F.col("granger"), F.col("transfer_entropy"), F.col("partial_corr")])
    return (j.withColumn("strength", strength).withColumn("confidence", conf).filter(F.col("strength") > thr)
            .select("layer", F.col("i").alias("cause"), F.col("j").alias("effect"), "strength", "confidence"))


def mediation(edges: DataFrame, cov: DataFrame, thr: float = 0.3) -> DataFrame:
    """cause -> mediator -> effect without a direct edge, where controlling the mediator moves the correlation by > thr.

    Two-step paths are joined on the mediator, so a hub's paths are spread by the second key.
    """
    a = edges.select("layer", F.col("cause").alias("i"), F.col("effect").alias("k"), F.col("strength").alias("s1"))
    b = edges.select("layer", F.col("cause").alias("k"), F.col("effect").alias("j"), F.col("strength").alias("s2"))
    direct = edges.select("layer", F.col("cause").alias("i"), F.col("effect").alias("j"))
    paths = a.join(b, ["layer", "k"]).filter("i <> j").join(direct, ["layer", "i", "j"], "left_anti")
    var = cov.filter("i = j").select("layer", F.col("i").alias("f"), F.col("cov").alias("v"))
    for k in ("i", "j", "k"):
        paths = paths.join(var.select("layer", F.col("f").alias(k), F.col("v").alias(f"v{k}")), ["layer", k])
    for u, v in (("i", "k"), ("k", "j"), ("i", "j")):
        paths = paths.join(cov.select("layer", F.col("i").alias(u), F.col("j").alias(v), F.col("cov").alias(f"c{u}{v}")), ["layer", u, v])
    col = F.col
    corr = lambda cxy, vx, vy: F.try_divide(col(cxy), F.sqrt(col(vx) * col(vy)))
    p = paths.withColumn("a", corr("cik", "vi", "vk")).withColumn("b", corr("ckj", "vk", "vj")).withColumn("c", corr("cij", "vi", "vj"))
    num = col("cij") - col("b") * col("cik") - col("a") * col("ckj") + col("a") * col("b") * col("vk")
    vx = col("vi") - 2 * col("a") * col("cik") + col("a") * col("a") * col("vk")
    vy = col("vj") - 2 * col("b") * col("ckj") + col("b") * col("b") * col("vk")
    effect = F.abs(col("c") - F.coalesce(F.try_divide(num, F.sqrt(vx * vy)), F.lit(0.0)))
    return (p.withColumn("strength", effect).filter(col("strength") > thr)
            .select("layer", col("i").alias("cause"), col("j").alias("effect"), col("k").alias("mediator"), "strength", F.least("s1", "s2").alias("confidence")))


def adjust_confounders(relations: DataFrame, cov: DataFrame, confounders: list[int], thr: float = 0.3) -> DataFrame:
    rel = relations.filter(~F.col("cause").isin(confounders) & ~F.col("effect").isin(confounders))
    pc = partial_corr(cov, zs=confounders).select("layer", F.col("i").alias("cause"), F.col("j").alias("effect"), F.col("partial_corr").alias("adjusted"))
    return (rel.join(pc, ["layer", "cause", "effect"]).filter(F.col("adjusted") > thr)
            .select("layer", "cause", "effect", F.col("adjusted").alias("strength"), (F.col("confidence") * 0.9).alias("confidence")))


def temporal_causality(vec: DataFrame, thr: float = 0.3) -> DataFrame:
    """|corr| over positions of protein-averaged features of consecutive layers."""
    prof = to_long(vec).groupBy("layer", "pos", "feature").agg(F.avg("value").alias("v"))
    mean_vec = prof.groupBy("layer", "pos").agg(F.array_sort(F.collect_list(F.struct("feature", "v"))).alias("s"))
    mv = mean_vec.select(F.lit(0).alias("protein_id"), "pos", "layer", F.transform("s", lambda e: e.v).alias("vec"))
    m = with_corr(pair_moments(mv, "adjacent")).filter(F.abs("corr") > thr)
    return m.select(F.col("la").alias("layer"), F.col("i").alias("cause"), F.col("j").alias("effect"), F.abs("corr").alias("strength"),
                    F.lit(0.8).alias("confidence"), F.lit(1).alias("lag"))


def union_relations(**kinds: DataFrame) -> DataFrame:
    """One relation table from several kinds, tagged by mechanism, with the lag and the mediators of each relation."""
    out = None
    for name, df in kinds.items():
        lag = F.col("lag").cast("int") if "lag" in df.columns else F.lit(0)
        via = F.array(F.col("mediator").cast("int")) if "mediator" in df.columns else F.array().cast("array<int>")
        part = df.select("layer", "cause", "effect", "strength", "confidence", F.lit(name).alias("mechanism"), lag.alias("lag"), via.alias("mediators"))
        out = part if out is None else out.unionByName(part)
    return out


def causality_summary(relations: DataFrame) -> DataFrame:
    n = lambda k: F.sum(F.when(F.col("mechanism") == k, 1).otherwise(0)).alias(f"n_{k}")
    return relations.agg(F.count("*").alias("n_relations"), n("direct"), n("mediated"), n("temporal"),
                         F.avg("strength").alias("avg_strength"), F.avg("confidence").alias("avg_confidence"))



def causal_edges(relations: DataFrame) -> DataFrame:
    """One edge per (layer, cause, effect): temporal < direct < mediated, the later list wins; best strength inside a list."""
    from ..functions.num import lookup
    rank = lookup("mechanism", {"temporal": 0, "direct": 1, "adjusted": 1, "mediated": 2})
    best = F.max_by(F.struct("strength", "confidence", "mechanism"), F.struct(rank.alias("r"), F.round("strength", 9).alias("s")))
    return relations.groupBy("layer", "cause", "effect").agg(best.alias("b")).select("layer", "cause", "effect", "b.*")


def top_causes(edges: DataFrame, k: int = 5, side: str = "cause") -> DataFrame:
    return edges.groupBy(F.col(side).alias("feature")).agg(F.sum("strength").alias("degree")).orderBy(F.desc("degree"), "feature").limit(k)


# dictionaries ------------------------------------------------------------------------------


def match_dictionaries(a: DataFrame, b: DataFrame, metric: str = "cosine", tile: int = 2048) -> DataFrame:
    """Best match in ``b`` for every row of ``a`` (columns ``id``, ``vec``).

    Rows are hashed into tiles; each a-tile meets each b-tile once in a numpy product that keeps
    only the best per row, so no pair is ever emitted.
    """
    if metric not in ("cosine", "correlation", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    na, nb = max(1, -(-a.count() // tile)), max(1, -(-b.count() // tile))
    at = a.select(F.pmod(F.xxhash64("id"), F.lit(na)).cast("int").alias("ta"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("tb"), "id", "vec")
    bt = b.select(F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("ta"), F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("tb"), "id", "vec")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "match": [], "score": []})
        x, y = np.stack(left.vec.to_numpy()).astype(float), np.stack(right.vec.to_numpy()).astype(float)
        if metric == "l2":
            s = -np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T))
        else:
            if metric == "correlation":
                x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
            y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-8)
            s = x @ y.T
        k = s.argmax(1)
        return pd.DataFrame({"id": left.id.to_numpy(), "match": right.id.to_numpy()[k], "score": s[np.arange(len(k)), k]})

    parts = at.groupBy("ta", "tb").cogroup(bt.groupBy("ta", "tb")).applyInPandas(best, "id long, match long, score double")
    return parts.groupBy("id").agg(F.max_by("match", "score").alias("match"), F.max("score").alias("score"))


def match_summary(matches: DataFrame) -> DataFrame:
    return matches.agg(F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))


# bootstrap ---------------------------------------------------------------------------------


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def poisson_weights(ids: np.ndarray, replicates: int, seed: int = 0) -> np.ndarray:
    """Poisson(1) resampling weights [rows, replicates] from a hash of (row id, replicate): the same in any partitioning."""
    cuts = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 12)])))
    with np.errstate(over="ignore"):
        rep = _mixed(np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        h = _mixed(_mixed(ids + np.uint64(1))[:, None] ^ rep[None, :])
    return np.searchsorted(cuts, (h >> np.uint64(11)).astype(np.float64) / 2.0 ** 53, side="right").astype(float)


class MeanOf:
    """A weighted mean of one column. The interface of every statistic here: ``width`` sums per replicate,
    ``add(columns, weights)`` gives [replicates, width] of some rows, sums of parts add up, ``finish`` turns them into values."""

    width = 2

    def add(self, columns: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
        return np.stack([weights.sum(0), columns[0] @ weights], 1)

    def finish(self, sums: np.ndarray) -> np.ndarray:
        return sums[:, 1] / sums[:, 0]


class CorrelationOf:
    """Pearson correlation of two columns."""

    width = 6

    def add(self, columns, weights):
        x, y = columns
        return np.stack([weights.sum(0), x @ weights, y @ weights, (x * x) @ weights, (y * y) @ weights, (x * y) @ weights], 1)

    def finish(self, sums):
        n, sx, sy, sxx, syy, sxy = sums.T
        return (n * sxy - sx * sy) / np.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))


class QuantileOf:
    """Quantile ``q`` of one column from a histogram between ``low`` and ``high``; exact to one of ``cells`` cells."""

    def __init__(self, q: float, low: float, high: float, cells: int = 2048):
        self.q, self.low, self.high, self.width = q, low, high, cells

    def add(self, columns, weights):
        at = np.clip(((columns[0] - self.low) / max(self.high - self.low, 1e-300) * self.width).astype(np.int64), 0, self.width - 1)
        order = np.argsort(at, kind="stable")
        at, w = at[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.array([], int)
        out = np.zeros((weights.shape[1], self.width))
        if len(first):
            out[:, at[first]] = np.add.reduceat(w, first, axis=0).T
        return out

    def finish(self, sums):
        run = np.cumsum(sums, 1)
        want = self.q * run[:, -1:]
        cell = (run < want).sum(1).clip(0, self.width - 1)
        r = np.arange(len(sums))
        before = run[r, cell] - sums[r, cell]
        inside = (want[:, 0] - before) / np.where(sums[r, cell] > 0, sums[r, cell], 1.0)
        return self.low + (cell + inside) * (self.high - self.low) / self.width


def bootstrap(df: DataFrame, id_col: str, values: list[str], statistic, replicates: int = 1000, confidence: float = 0.95, seed: int = 0, block: int = 50) -> DataFrame:
    """Estimate and percentile interval of any statistic of mergeable sums, all replicates in one pass over ``df``.

    A task sends one array per block of replicates; blocks merge where they meet and leave one number per replicate.
    Rows with a null among ``values`` are left out.
    """
    blocks_of = range(0, replicates, block)

    def fold(batches):
        total = [np.zeros((min(block, replicates - at), statistic.width)) for at in blocks_of]
        for b in batches:
            ids = b.column(0).to_numpy().view(np.uint64)
            cols = [b.column(k + 1).to_numpy() for k in range(len(values))]
            for at in range(0, len(ids), 4096):
                w = poisson_weights(ids[at:at + 4096], replicates, seed)
                for k, first in enumerate(blocks_of):
                    total[k] += statistic.add([c[at:at + 4096] for c in cols], w[:, first:first + block])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["b", "sums"])

    def merge(batches):
        at, total = None, None

        def done():
            rows = total.reshape(-1, statistic.width)
            with np.errstate(all="ignore"):
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32) + at * block), pa.array(statistic.finish(rows), pa.float64())], names=["rep", "m"])

        for b in batches:
            for k, found in enumerate(b.column(0).to_pylist()):
                part = np.frombuffer(b.column(1)[k].as_buffer(), np.float64)
                if found != at:
                    if at is not None:
                        yield done()
                    at, total = found, part.copy()
                else:
                    total += part
        if at is not None:
            yield done()

    src = df.select(F.xxhash64(id_col).alias("h"), *[F.col(v).cast("double").alias(v) for v in values]).dropna()
    parts = src.mapInArrow(fold, "b int, sums binary").repartition("b").sortWithinPartitions("b")
    m = parts.mapInArrow(merge, "rep int, m double").filter(~F.isnan("m"))
    lo, hi = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    return m.agg(F.avg("m").alias("estimate"), F.expr(f"percentile(m, {lo})").alias("ci_low"), F.expr(f"percentile(m, {hi})").alias("ci_high"))


def bootstrap_ci(df: DataFrame, id_col: str, value: str, replicates: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean from Poisson(1) resampling weights."""
    return bootstrap(df, id_col, [value], MeanOf(), replicates, confidence, seed)
