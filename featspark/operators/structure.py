"""3-D structure analytics: neighbour joins on a grid, backbone geometry, shapes, interactions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import clip, count_if, ratio
from ..functions.vec import cross3, dot3, norm3, sub3
from .graph import components, network_properties
from .sequence import charge_of, hbond_sites, in_region, residue_properties, runs

PROT = ["protein_id"]


def radius_pairs(points: DataFrame, r: float, extra: list[str] | None = None, key: str = "pos", inclusive: bool = False) -> DataFrame:
    """Pairs i < j of the same protein closer than ``r``: equi-join on the grid cell, 27 cells on one side.

    Work follows the local density, not the protein length squared.
    """
    extra = extra or []
    cell = lambda k: F.floor(F.col(k) / r).cast("long")
    p = points.select("protein_id", F.col(key).alias("i"), "x", "y", "z", *extra).withColumn("cx", cell("x")).withColumn("cy", cell("y")).withColumn("cz", cell("z"))
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d).alias("d")) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)]))
    left = p.withColumn("o", near).select("protein_id", "i", "x", "y", "z", *extra, (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"), (F.col("cz") + F.col("o.d")).alias("cz"))
    right = p.select("protein_id", F.col("i").alias("j"), *[F.col(k).alias(f"{k}2") for k in ("x", "y", "z", *extra)], "cx", "cy", "cz")
    j = left.join(right, ["protein_id", "cx", "cy", "cz"]).filter("i < j")
    dx, dy, dz = (F.col(k) - F.col(f"{k}2") for k in ("x", "y", "z"))
    j = j.withColumn("distance", F.sqrt(dx * dx + dy * dy + dz * dz)).drop("cx", "cy", "cz")
    return j.filter(F.col("distance") <= r if inclusive else F.col("distance") < r)


def contacts(coords: DataFrame, r: float = 8.0, min_sep: int = 3) -> DataFrame:
    return radius_pairs(coords, r).filter(F.col("j") - F.col("i") >= min_sep).select("protein_id", "i", "j", "distance")


def both_ways(pairs: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or []
    return pairs.select("protein_id", "i", "j", *cols).unionByName(pairs.select("protein_id", F.col("j").alias("i"), F.col("i").alias("j"), *cols))


def salt_bridges(res: DataFrame, coords: DataFrame, r: float = 4.0, scorer=None, thr: float = 0.5) -> DataFrame:
    """Oppositely charged residues within ``r``; ``scorer(df) -> Column`` may add a learned gate."""
    q = charge_of()
    ch = res.select("protein_id", "pos", F.when(q > 0.5, 1).when(q < -0.5, -1).otherwise(0).alias("q")).filter("q <> 0")
    p = radius_pairs(coords.join(ch, ["protein_id", "pos"]), r, ["q"]).filter("q * q2 < 0")
    out = p.select("protein_id", F.when(F.col("q") > 0, F.col("i")).otherwise(F.col("j")).alias("positive"), F.when(F.col("q") > 0, F.col("j")).otherwise(F.col("i")).alias("negative"), "distance")
    return out if scorer is None else out.filter(scorer(out) > thr)


def hbond_pairs(res: DataFrame, coords: DataFrame, lo: float = 2.5, hi: float = 3.5, scorer=None, thr: float = 0.5) -> DataFrame:
    """Directed donor -> acceptor pairs at least two residues apart inside the geometric window."""
    sites = hbond_sites(res).select("protein_id", "pos", F.col("donor").cast("int").alias("dn"), F.col("acceptor").cast("int").alias("ac"))
    p = radius_pairs(coords.join(sites, ["protein_id", "pos"]), hi, ["dn", "ac"], inclusive=True).filter((F.col("distance") >= lo) & (F.col("j") - F.col("i") >= 2))
    fwd = p.filter("dn = 1 and ac2 = 1").select("protein_id", F.col("i").alias("donor"), F.col("j").alias("acceptor"), "distance")
    bwd = p.filter("dn2 = 1 and ac = 1").select("protein_id", F.col("j").alias("donor"), F.col("i").alias("acceptor"), "distance")
    out = fwd.unionByName(bwd)
    return out if scorer is None else out.filter(scorer(out) > thr)


def hbond_geometry(pairs: DataFrame, angle: float = 180.0) -> DataFrame:
    return (pairs.withColumn("dist_feat", F.exp(-F.col("distance") / 3.5)).withColumn("angle_feat", F.lit(math.cos(math.radians(180 - angle))))
            .withColumn("sep_feat", F.abs(F.col("acceptor") - F.col("donor")) / 10.0))


def hbond_energy(pairs: DataFrame) -> DataFrame:
    """Energy per protein: -5 per unit strength, the strength being the distance feature."""
    return hbond_geometry(pairs).groupBy("protein_id").agg((F.sum("dist_feat") * -5.0).alias("energy"), F.count("*").alias("n_bonds"))


def hbond_motifs(pairs: DataFrame) -> DataFrame:
    d = F.col("acceptor") - F.col("donor")
    base = pairs.groupBy("protein_id").agg(count_if(d == 4).alias("h"), count_if(d >= 5).alias("s"), count_if(d == 3).alias("beta_turn"))
    caps = (pairs.filter(d == 4).select("protein_id", (F.col("donor") - 1).alias("donor")).filter("donor >= 0").withColumn("acceptor", F.col("donor") + 3)
            .join(pairs.select("protein_id", "donor", "acceptor"), ["protein_id", "donor", "acceptor"], "left_semi").groupBy("protein_id").agg(F.count("*").alias("helix_cap")))
    two = lambda k: F.when(F.col(k) >= 2, F.col(k)).otherwise(0)
    return base.join(caps, "protein_id", "left").select("protein_id", two("h").alias("alpha_helix"), two("s").alias("beta_sheet"), "beta_turn", F.coalesce("helix_cap", F.lit(0)).alias("helix_cap"))


def electrostatic_energy(res: DataFrame, coords: DataFrame, cutoff: float = 15.0, dielectric: float = 80.0) -> DataFrame:
    q = coords.join(res.select("protein_id", "pos", charge_of().alias("q")), ["protein_id", "pos"]).filter("q <> 0")
    p = radius_pairs(q, cutoff, ["q"]).filter("distance > 0")
    d = F.col("distance")
    e = p.groupBy("protein_id").agg(F.sum(332.0 * F.col("q") * F.col("q2") / (dielectric * d / 4.0 * d)).alias("energy"))
    return coords.select("protein_id").distinct().join(e, "protein_id", "left").fillna(0.0, ["energy"])


def dipole(res: DataFrame, coords: DataFrame) -> DataFrame:
    """Dipole about the charge centre, or about the centroid when the net charge vanishes."""
    j = coords.join(res.select("protein_id", "pos", charge_of().alias("q")), ["protein_id", "pos"])
    g = j.groupBy("protein_id").agg(F.sum("q").alias("t"), *[F.sum(F.col("q") * F.col(k)).alias(f"q{k}") for k in "xyz"], *[F.avg(k).alias(f"m{k}") for k in "xyz"])
    centre = lambda k: F.when(F.abs("t") > 1e-6, F.col(f"q{k}") / F.when(F.abs("t") > 1e-6, F.col("t"))).otherwise(F.col(f"m{k}"))
    g = g.select("protein_id", "t", *[(F.col(f"q{k}") - F.col("t") * centre(k)).alias(f"d{k}") for k in "xyz"])
    mag = norm3((F.col("dx"), F.col("dy"), F.col("dz")))
    return g.select("protein_id", F.col("t").alias("net_charge"), mag.alias("magnitude"), *[(F.col(f"d{k}") / (mag + 1e-8)).alias(f"dir_{k}") for k in "xyz"])


# local geometry ----------------------------------------------------------------------------


def _xyz(k: int, w) -> tuple:
    at = lambda n: F.col(n) if k == 0 else (F.lead(n, k).over(w) if k > 0 else F.lag(n, -k).over(w))
    return at("x"), at("y"), at("z")


def backbone(coords: DataFrame) -> DataFrame:
    """Bond length to the next residue, curvature and bond angle at interior residues."""
    w = Window.partitionBy("protein_id").orderBy("pos")
    pts = coords.select("protein_id", "pos", "x", "y", "z", *[a.alias(f"{n}p") for n, a in zip("xyz", _xyz(-1, w))], *[a.alias(f"{n}n") for n, a in zip("xyz", _xyz(1, w))])
    p, q, n = (tuple(F.col(f"{k}{s}") for k in "xyz") for s in ("p", "", "n"))
    v1, v2 = sub3(q, p), sub3(n, q)
    u1, u2 = tuple(a / (norm3(v1) + 1e-8) for a in v1), tuple(a / (norm3(v2) + 1e-8) for a in v2)
    angle = F.acos(clip(dot3(v1, v2) / (norm3(v1) * norm3(v2) + 1e-8), -1.0, 1.0))
    inner = F.col("xp").isNotNull() & F.col("xn").isNotNull()
    return pts.select("protein_id", "pos", norm3(v2).alias("bond_length"), F.when(inner, F.acos(clip(dot3(u1, u2), -1.0, 1.0))).otherwise(0.0).alias("curvature"), F.when(inner, angle).alias("bond_angle"))


def dihedrals(coords: DataFrame) -> DataFrame:
    """Signed dihedral over residues pos .. pos+3."""
    w = Window.partitionBy("protein_id").orderBy("pos")
    cols = [a.alias(f"{n}{k}") for k in range(4) for n, a in zip("xyz", _xyz(k, w))]
    t = coords.select("protein_id", "pos", *cols).filter("x3 is not null")
    pt = [tuple(F.col(f"{n}{k}") for n in "xyz") for k in range(4)]
    v1, v2, v3 = sub3(pt[1], pt[0]), sub3(pt[2], pt[1]), sub3(pt[3], pt[2])
    n1, n2 = cross3(v1, v2), cross3(v2, v3)
    for k, col in enumerate((*n1, *n2, *v2)):
        t = t.withColumn(f"t{k}", col)
    n1, n2, v2 = (tuple(F.col(f"t{k}") for k in r) for r in ((0, 1, 2), (3, 4, 5), (6, 7, 8)))
    l1, l2 = norm3(n1) + 1e-8, norm3(n2) + 1e-8
    angle = F.acos(clip(dot3(n1, n2) / (l1 * l2), -1.0, 1.0))
    return t.select("protein_id", "pos", F.when(dot3(cross3(n1, n2), v2) < 0, -angle).otherwise(angle).alias("dihedral")).withColumn("unsigned", F.abs("dihedral"))


def ss_consistency(res: DataFrame, coords: DataFrame) -> DataFrame:
    """Mean agreement of helix (i, i+4) and strand (i, i+2) distances; the last 4 / 2 members are skipped."""
    j = coords.join(res.select("protein_id", "pos", "ss"), ["protein_id", "pos"])
    w = Window.partitionBy("protein_id").orderBy("pos")

    def part(states, gap, score):
        kind = F.col("ss").isin(states)
        wk = Window.partitionBy("protein_id", "kind")
        t = j.withColumn("kind", kind).withColumn("rank", F.row_number().over(wk.orderBy("pos"))).withColumn("n", F.count("*").over(wk))
        t = t.withColumn("d", norm3(sub3(_xyz(gap, w), _xyz(0, w))))
        return t.filter((F.col("kind")) & (F.col("rank") <= F.col("n") - gap) & F.col("d").isNotNull()).select("protein_id", score(F.col("d")).alias("s"))

    h = part(["H", "G"], 4, lambda d: F.exp(-((d - 5.4) / 2.0) * ((d - 5.4) / 2.0)))
    e = part(["E"], 2, lambda d: F.when(d > 6.0, 1.0).otherwise(d / 6.0))
    return h.unionByName(e).groupBy("protein_id").agg(F.avg("s").alias("consistency"), F.count("*").alias("n"))


def local_geometry(coords: DataFrame, r: float = 10.0) -> DataFrame:
    """Neighbours within ``r`` (self excluded), 1 / (1 + local radius of gyration), normalised depth."""
    p = radius_pairs(coords, r)
    a = p.select("protein_id", "i", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("z2").alias("z"))
    b = p.select("protein_id", F.col("j").alias("i"), "x", "y", "z")
    own = coords.select("protein_id", F.col("pos").alias("i"), "x", "y", "z")
    sq = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    g = own.unionByName(a).unionByName(b).groupBy("protein_id", "i").agg(F.count("*").alias("n"), *[F.avg(k).alias(f"m{k}") for k in "xyz"], F.avg(sq).alias("q"))
    rg = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("mx") * F.col("mx") - F.col("my") * F.col("my") - F.col("mz") * F.col("mz")))
    dens = g.select("protein_id", F.col("i").alias("pos"), (F.col("n") - 1).alias("density"), F.when(F.col("n") > 1, 1 / (1 + rg)).otherwise(0.0).alias("compactness"))
    w = Window.partitionBy("protein_id")
    d = coords.withColumn("d", norm3(tuple(F.col(k) - F.avg(k).over(w) for k in "xyz")))
    return dens.join(d.select("protein_id", "pos", (1 - ratio("d", F.max("d").over(w))).alias("depth")), ["protein_id", "pos"])


def exposure(atoms: DataFrame, r: float = 5.0, crowd: int = 10) -> DataFrame:
    """Share of a residue's atoms with fewer than ``crowd`` atoms (self included) within ``r``."""
    a = atoms.withColumn("aid", F.col("pos").cast("long") * 10_000 + F.col("atom"))
    n = both_ways(radius_pairs(a, r, key="aid", inclusive=True)).groupBy("protein_id", F.col("i").alias("aid")).agg(F.count("*").alias("n"))
    j = a.join(n, ["protein_id", "aid"], "left")
    return j.groupBy("protein_id", "pos").agg(F.avg(F.when(F.coalesce("n", F.lit(0)) + 1 < crowd, 1.0).otherwise(0.0)).alias("exposure"))


# global shape ------------------------------------------------------------------------------


def shape_metrics(coords: DataFrame) -> DataFrame:
    """End-to-end distance, radius of gyration, asphericity and acylindricity.

    Eigenvalues of the symmetric inertia tensor come from the trigonometric closed form.
    """
    xyz = F.struct("x", "y", "z")
    g = coords.groupBy("protein_id").agg(F.count("*").alias("n"), F.min_by(xyz, "pos").alias("a"), F.max_by(xyz, "pos").alias("b"), *[F.avg(k).alias(f"m{k}") for k in "xyz"],
                                         *[F.avg(F.col(p) * F.col(q)).alias(f"{p}{q}") for p, q in ("xx", "yy", "zz", "xy", "xz", "yz")])
    cov = {p + q: F.col(p + q) - F.col(f"m{p}") * F.col(f"m{q}") for p, q in ("xx", "yy", "zz", "xy", "xz", "yz")}
    g = g.select("protein_id", "n", norm3(tuple(F.col(f"b.{k}") - F.col(f"a.{k}") for k in "xyz")).alias("end_to_end"), *[v.alias(k) for k, v in cov.items()])
    i00, i11, i22 = F.col("yy") + F.col("zz"), F.col("xx") + F.col("zz"), F.col("xx") + F.col("yy")
    i01, i02, i12 = -F.col("xy"), -F.col("xz"), -F.col("yz")
    q = (i00 + i11 + i22) / 3
    p = F.sqrt(((i00 - q) * (i00 - q) + (i11 - q) * (i11 - q) + (i22 - q) * (i22 - q) + 2 * (i01 * i01 + i02 * i02 + i12 * i12)) / 6)
    g = g.withColumn("q", q).withColumn("p", p)
    b00, b11, b22 = ((v - F.col("q")) / F.col("p") for v in (i00, i11, i22))
    b01, b02, b12 = (v / F.col("p") for v in (i01, i02, i12))
    det = b00 * (b11 * b22 - b12 * b12) - b01 * (b01 * b22 - b12 * b02) + b02 * (b01 * b12 - b11 * b02)
    g = g.withColumn("phi", F.acos(clip(F.when(F.col("p") > 0, det / 2).otherwise(1.0), -1.0, 1.0)) / 3)
    hi = F.col("q") + 2 * F.col("p") * F.cos("phi")
    lo = F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * math.pi / 3)
    mid = 3 * F.col("q") - hi - lo
    rg = F.sqrt(F.col("xx") + F.col("yy") + F.col("zz"))
    return g.select("protein_id", "n", "end_to_end", rg.alias("radius_of_gyration"), F.try_divide(1.5 * (hi * hi - F.col("q") * F.col("q")), F.col("q") * F.col("q")).alias("asphericity"), (mid - lo).alias("acylindricity"))


MOMENTS = [(i, j, o - i - j) for o in range(1, 4) for i in range(o + 1) for j in range(o + 1 - i)]


def moments(coords: DataFrame) -> DataFrame:
    w = Window.partitionBy("protein_id")
    cen = coords.select("protein_id", *[(F.col(k) - F.avg(k).over(w)).alias(k) for k in "xyz"])
    power = lambda k, n: F.lit(1.0) if n == 0 else F.col(k) * power(k, n - 1)
    return cen.groupBy("protein_id").agg(*[F.avg(power("x", i) * power("y", j) * power("z", k)).alias(f"m{i}{j}{k}") for i, j, k in MOMENTS])


def rdf(coords: DataFrame, radius: float = 20.0, bins: int = 20) -> DataFrame:
    d = radius_pairs(coords, radius, inclusive=True)
    b = F.least(F.lit(bins - 1), F.floor(F.col("distance") / (radius / bins))).cast("int")
    h = d.groupBy("protein_id", b.alias("bin")).agg(F.count("*").alias("n"))
    edge = (F.col("bin") + 1) * (radius / bins)
    h = h.withColumn("v", F.col("n") / (4 * math.pi * edge * edge * (radius / bins)))
    return h.select("protein_id", "bin", (F.col("v") / F.sum("v").over(Window.partitionBy("protein_id"))).alias("rdf"))


def adf(coords: DataFrame, bins: int = 18, reach: int = 9) -> DataFrame:
    """Angles i-j-k with i < j < k and steps of at most ``reach``: neighbours come by offset, 9 x 9 per residue."""
    off = F.explode(F.sequence(F.lit(1), F.lit(reach)))
    mid = coords.select("protein_id", F.col("pos").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("z").alias("zj"))
    lo = coords.withColumn("o", off).select("protein_id", (F.col("pos") + F.col("o")).alias("j"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("z").alias("zi"))
    hi = coords.withColumn("o", off).select("protein_id", (F.col("pos") - F.col("o")).alias("j"), F.col("x").alias("xk"), F.col("y").alias("yk"), F.col("z").alias("zk"))
    t = mid.join(lo, ["protein_id", "j"]).join(hi, ["protein_id", "j"])
    v1, v2 = tuple(F.col(f"{k}i") - F.col(f"{k}j") for k in "xyz"), tuple(F.col(f"{k}k") - F.col(f"{k}j") for k in "xyz")
    a = F.acos(clip(dot3(v1, v2) / (norm3(v1) * norm3(v2) + 1e-8), -1.0, 1.0))
    h = t.groupBy("protein_id", F.least(F.lit(bins - 1), F.floor(a / math.pi * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return h.select("protein_id", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("protein_id"))).alias("adf"))


def contact_order(cont: DataFrame, coords: DataFrame) -> DataFrame:
    n = coords.groupBy("protein_id").agg(F.count("*").alias("length"))
    s = cont.filter("j - i >= 3").groupBy("protein_id").agg(F.avg(F.col("j") - F.col("i")).alias("sep"))
    return n.join(s, "protein_id", "left").select("protein_id", F.coalesce(F.col("sep") / F.col("length"), F.lit(0.0)).alias("contact_order"))


# motifs and clusters -----------------------------------------------------------------------


def region_contacts(regions: DataFrame, cont: DataFrame) -> DataFrame:
    """Pairs of regions (start1 < start2) joined by at least one contact."""
    reg = regions.select("protein_id", "start", "end", F.col("start").alias("domain_id"))
    at = in_region(cont.select("protein_id", F.col("i").alias("pos"), "j"), reg).select("protein_id", F.col("domain_id").alias("start1"), F.col("j").alias("pos"))
    return in_region(at, reg).select("protein_id", "start1", F.col("domain_id").alias("start2")).filter("start1 < start2").distinct()


def structural_motifs(res: DataFrame, cont: DataFrame) -> DataFrame:
    """Counts per protein: hairpins, helix pairs, loops of 3-12, and sheets (strands grouped by contact, first strand first)."""
    w = Window.partitionBy("protein_id").orderBy("pos")
    t = res.select("protein_id", "pos", "ss", *[F.lead("ss", k).over(w).alias(f"s{k}") for k in (1, 2, 3, 5)])
    turn = F.col("s1").isin("T", "S", "-") | F.col("s2").isin("T", "S", "-")
    hp = t.filter((F.col("ss") == "E") & turn & (F.col("s3") == "E") & F.col("s5").isNotNull()).select("protein_id", F.col("pos").alias("i"), (F.col("pos") + 3).alias("j"))
    n = lambda d, k: d.groupBy("protein_id").agg(F.count("*").alias(k))
    hairpins = n(hp.join(cont, ["protein_id", "i", "j"], "left_semi"), "hairpins")
    helix_pairs = n(region_contacts(runs(res, F.col("ss") == "H"), cont), "helix_pairs")
    loops = n(runs(res, F.col("ss") == "-", 3).filter("length <= 12"), "loops")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        nb: dict = {}
        for a, b in zip(pdf.start1, pdf.start2):
            nb.setdefault(a, set()).add(b)
            nb.setdefault(b, set()).add(a)
        used: set = set()
        sheets = 0
        for a in sorted(nb):
            if a in used:
                continue
            free = nb[a] - used
            used |= {a} | free
            sheets += bool(free)
        return pd.DataFrame({"protein_id": [pdf.protein_id.iloc[0]], "sheets": [sheets]})

    sheets = region_contacts(runs(res, F.col("ss") == "E"), cont).groupBy("protein_id").applyInPandas(group, "protein_id long, sheets long")
    out = res.select("protein_id").distinct()
    for d in (hairpins, helix_pairs, loops, sheets):
        out = out.join(d, "protein_id", "left")
    return out.fillna(0)


def dbscan3d(points: DataFrame, eps: float, min_pts: int = 3) -> DataFrame:
    """(protein_id, pos, core, cluster): core = at least ``min_pts`` points within eps (self included);
    clusters are components of core-core edges; a border point takes the smallest neighbouring cluster."""
    p = both_ways(radius_pairs(points, eps, inclusive=True))
    deg = p.groupBy("protein_id", F.col("i").alias("pos")).agg((F.count("*") + 1).alias("d"))
    core = points.select("protein_id", "pos").join(deg, ["protein_id", "pos"], "left").select("protein_id", "pos", (F.coalesce("d", F.lit(1)) >= min_pts).alias("core"))
    on = core.filter("core").select("protein_id", "pos")
    edges = p.join(on.withColumnRenamed("pos", "i"), ["protein_id", "i"], "left_semi").join(on.withColumnRenamed("pos", "j"), ["protein_id", "j"], "left_semi")
    comp = components(edges.select("protein_id", F.col("i").alias("src"), F.col("j").alias("dst")), PROT, on.withColumnRenamed("pos", "node"))
    lab = comp.select("protein_id", F.col("node").alias("pos"), F.col("component").alias("cluster"))
    near = p.join(lab.withColumnRenamed("pos", "j"), ["protein_id", "j"]).groupBy("protein_id", F.col("i").alias("pos")).agg(F.min("cluster").alias("near"))
    j = core.join(lab, ["protein_id", "pos"], "left").join(near, ["protein_id", "pos"], "left")
    return j.select("protein_id", "pos", "core", F.coalesce("cluster", "near").alias("cluster"))


def hydrophobic_points(res: DataFrame, coords: DataFrame, thr: float = 0.3) -> DataFrame:
    h = residue_properties(res.select("protein_id", "pos", "aa")).filter(F.col("kd_signed") > thr).select("protein_id", "pos")
    return coords.join(h, ["protein_id", "pos"], "left_semi")


def core_scores(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("protein_id").agg(F.count("*").alias("n_points"), F.countDistinct("cluster").alias("n_clusters"), F.avg(F.when(F.col("cluster").isNotNull(), 1.0).otherwise(0.0)).alias("core_score"))


def hydrophobic_cluster_stats(res: DataFrame, coords: DataFrame, r: float = 8.0) -> DataFrame:
    """Connected groups of AILMFVWY residues in contact: number, mean and max size, hydrophobic fraction."""
    hyd = F.col("aa").isin(list("AILMFVWY"))
    ids = res.filter(hyd).select("protein_id", "pos")
    p = radius_pairs(coords.join(ids, ["protein_id", "pos"], "left_semi"), r).filter("distance > 0").select("protein_id", F.col("i").alias("src"), F.col("j").alias("dst"))
    comp = components(p, PROT, ids.withColumnRenamed("pos", "node"))
    s = comp.groupBy("protein_id", "component").agg(F.count("*").alias("size")).groupBy("protein_id").agg(F.count("*").alias("n_clusters"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"))
    f = res.groupBy("protein_id").agg(F.avg(F.when(hyd, 1.0).otherwise(0.0)).alias("hydrophobic_fraction"))
    return f.join(s, "protein_id", "left").fillna(0)


def hbond_network(pairs: DataFrame, res: DataFrame) -> DataFrame:
    e = pairs.select("protein_id", F.col("donor").alias("src"), F.col("acceptor").alias("dst"))
    return network_properties(e, res.select("protein_id", "pos"), PROT)


def structure_features(res: DataFrame, coords: DataFrame) -> DataFrame:
    cont = contacts(coords)
    loc = local_geometry(coords).groupBy("protein_id").agg(F.avg("density").alias("avg_density"), F.avg("compactness").alias("avg_compactness"))
    bb = backbone(coords).groupBy("protein_id").agg(F.avg("curvature").alias("avg_curvature"), F.avg("bond_length").alias("avg_bond_length"))
    out = shape_metrics(coords).join(contact_order(cont, coords), "protein_id").join(loc, "protein_id").join(bb, "protein_id")
    return out.join(structural_motifs(res, cont), "protein_id")


def biophysics(res: DataFrame, coords: DataFrame) -> DataFrame:
    """Composite per protein: hydrophobic cores, salt bridges, electrostatic energy, hydrogen-bond energy and motifs."""
    hb = hbond_pairs(res, coords)
    out = core_scores(dbscan3d(hydrophobic_points(res, coords), 8.0, 3)).select("protein_id", "n_clusters", "core_score")
    out = out.join(salt_bridges(res, coords).groupBy("protein_id").agg(F.count("*").alias("n_bridges")), "protein_id", "full")
    out = out.join(electrostatic_energy(res, coords).withColumnRenamed("energy", "electrostatic"), "protein_id", "full")
    return out.join(hbond_energy(hb).withColumnRenamed("energy", "hbond"), "protein_id", "left").join(hbond_motifs(hb), "protein_id", "left").fillna(0)
