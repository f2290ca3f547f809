"""Whole analyses: every member of a report as a lazy DataFrame under its name.

A report computes nothing by itself; a caller runs the members it needs. Members shared inside a report (states,
transitions, contacts) are built once and planned once. :func:`long_form` folds a report into one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import aggregates as A
from . import alignment as M
from . import circuits as C
from . import evolution as E
from . import graph as G
from . import novelty as N
from . import pairs as P
from . import scoring as B
from . import sequence as Q
from . import structure as T

Report = dict[str, DataFrame]


def long_form(report: Report, columns: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(part, key, metric, value) of the named parts; ``columns``: part -> (key columns, value columns)."""
    out = None
    for part, (keys, values) in columns.items():
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
        pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
        df = report[part].select(F.lit(part).alias("part"), key.alias("key"), pairs.alias("m")).select("part", "key", "m.metric", "m.value")
        out = df if out is None else out.unionByName(df)
    return out


def evolution(vec: DataFrame, act: DataFrame, thr: float = 0.3) -> Report:
    """How features change over the layers: similarity, magnitude, residuals, emerging and decaying features, stable features."""
    return {"similarity": E.layer_similarity(vec), "magnitude": A.layer_magnitude(vec), "residual": E.residual_strength(vec),
            "patterns": E.emergence(A.feature_importance(act), thr), "stable": E.stable_features(vec), "layers": E.evolution_report(vec, act, thr)}


def transition(vec: DataFrame, act: DataFrame, source: int | None = None, target: int | None = None) -> Report:
    """From one layer to the next (of all consecutive layers if none are named): matrix, patterns, information flow, activation rates."""
    if source is not None:
        keep = F.col("layer").isin(source, target if target is not None else source + 1)
        vec, act = vec.filter(keep), act.filter(keep)
    m = E.transition_matrix(vec)
    return {"matrix": m, "patterns": E.transformations(m), "flow": P.info_flow_median(vec), "rates": A.activation_rate(act)}


def layers(vec: DataFrame, act: DataFrame, n_layers: int, detailed: bool = True) -> Report:
    """The layer tracker: states, transitions, lineages and summary; ``detailed`` adds type counts, similarity of layers, critical transitions."""
    state, tr = A.layer_state(act), E.classify_transitions(vec)
    out = {"states": state, "transitions": tr, "lineages": E.lineages(tr, state, n_layers), "summary": E.layer_summary(state)}
    if detailed:
        out |= {"type_counts": E.transition_counts(tr), "layer_similarity": E.layer_jaccard(state), "importance": state, "critical": E.critical_transitions(tr)}
    return out


def alignment(cells: DataFrame, weights: DataFrame | None = None, target: DataFrame | None = None) -> Report:
    """Features of alignments: profile, weights, position scores, gaps, conservation, depth, diversity, coevolution.

    ``target`` (family_id, seq_idx): keep only the columns where this sequence has a letter, renumbered.
    """
    if target is not None:
        cells = cut_lineage(M.filter_alignment(cells, target))
    w = M.sequence_weights(cells) if weights is None else weights
    co = M.coevolution(cells, w)
    return {"profile": M.msa_profile(cells), "weights": w, "pssm": M.pssm(cells, w), "gaps": M.gap_stats(cells), "conservation": M.conservation(cells, w),
            "neff": M.neff(w), "diversity": M.diversity(cells), "coevolution": co}


def structure(res: DataFrame, coords: DataFrame, atoms: DataFrame) -> Report:
    """Features of structures: contacts, shape, moments, distance and angle distributions, local and chain geometry, motifs, contact modules."""
    cont = T.contacts(coords)
    links = cont.select("protein_id", F.col("i").alias("src"), F.col("j").alias("dst"))
    return {"contacts": cont, "shape": T.shape_metrics(coords), "moments": T.moments(coords), "rdf": T.rdf(coords), "adf": T.adf(coords), "contact_order": T.contact_order(cont, coords),
            "local": T.local_geometry(coords), "exposure": T.exposure(atoms), "backbone": T.backbone(coords), "dihedrals": T.dihedrals(coords),
            "motifs": T.structural_motifs(res, cont), "modules": G.components(links, ["protein_id"])}


def biophysics(res: DataFrame, coords: DataFrame) -> Report:
    """Hydrophobic cores, electrostatics and hydrogen bonds with their network."""
    hb = T.hbond_pairs(res, coords)
    return {"cores": T.core_scores(T.dbscan3d(T.hydrophobic_points(res, coords), 8.0, 3)), "charge": Q.charge_distribution(res), "salt_bridges": T.salt_bridges(res, coords),
            "electrostatic": T.electrostatic_energy(res, coords), "dipole": T.dipole(res, coords), "hbond_sites": Q.hbond_sites(res), "hbonds": hb,
            "hbond_energy": T.hbond_energy(hb), "hbond_motifs": T.hbond_motifs(hb), "hbond_network": T.hbond_network(hb, res)}


def properties(proteins: DataFrame) -> Report:
    """Property patterns along sequences (``sequence``, ``states``): hydrophobic clusters, charges, structure regions, their transitions, motifs, and the row per protein."""
    per = Q.property_patterns_of(proteins)
    changes = proteins.select("protein_id", F.posexplode(F.split("states", "")).alias("pos", "ss"))
    return {"clusters": Q.hydrophobic_runs_of(proteins), "charge": per.select("protein_id", "positive_fraction", "negative_fraction", "net_charge"), "helices": Q.runs_of(proteins, "HGI", 3),
            "transitions": Q.transitions_ss(changes), "transition_counts": Q.transition_counts_of(proteins), "sequence_motifs": Q.sequence_motifs(proteins),
            "property_motifs": Q.property_motifs(proteins), "per_protein": per}


def circuits(edges: DataFrame, vec: DataFrame, labels: DataFrame, thr: float = 0.7, sizes=(3, 4, 5, 6, 7, 8)) -> Report:
    """Circuit discovery: recurring structures ranked, their instances, validation, the validated circuits and the summary."""
    circ, inst = C.find_motifs(edges, sizes)
    scores = C.validate_circuits(inst, vec, labels, thr)
    valid = circ.join(scores.select("structure", "overall_score"), "structure")
    return {"circuits": circ, "instances": inst, "scores": scores, "validated": valid, "summary": C.circuit_summary(circ)}


def causality(vec: DataFrame, confounders: list[int] | None = None, thr: float = 0.3, mediation_thr: float = 0.3, direct: DataFrame | None = None, chain_edges: int = 5) -> Report:
    """Causal analysis: pairwise relations, mediated ones, those that survive known confounders, temporal ones, the graph with its chains, loops and importance.

    ``direct`` replaces the pairwise tests. Where confounders are known the adjusted relations take the place of the
    direct ones in the graph, as relations to a confounder say nothing.
    """
    direct = cut_lineage(P.pairwise_causality(vec, thr=thr) if direct is None else direct)
    cov = cut_lineage(P.covariances(vec))
    mediated, temporal = P.mediation(direct, cov, mediation_thr), P.temporal_causality(vec, thr)
    adjusted = P.adjust_confounders(direct, cov, confounders, thr) if confounders else None
    rel = cut_lineage(P.union_relations(direct=direct if adjusted is None else adjusted, mediated=mediated, temporal=temporal))
    edges = cut_lineage(P.causal_edges(rel))
    g = edges.select("layer", F.col("cause").alias("src"), F.col("effect").alias("dst"), F.col("strength").alias("weight"))
    out = {"direct": direct, "mediated": mediated, "temporal": temporal, "relations": rel, "edges": edges, "chains": G.chains(g, ["layer"], chain_edges), "loops": G.feedback_loops(g, ["layer"], chain_edges),
           "importance": G.causal_importance(g, ["layer"]), "summary": P.causality_summary(rel), "top_causes": P.top_causes(edges), "top_effects": P.top_causes(edges, side="effect")}
    return out | ({"adjusted": adjusted} if adjusted is not None else {})


def metrics(vec: DataFrame, act: DataFrame, original: DataFrame, reconstructed: DataFrame, res: DataFrame | None = None, circ: DataFrame | None = None, instances: DataFrame | None = None) -> Report:
    """Interpretability: reconstruction, feature quality, and where given circuit quality and biological relevance."""
    co, cos = A.coactivation(vec), A.feature_cosines(vec)
    out = {"reconstruction": A.reconstruction_metrics(original, reconstructed, ("protein_id", "pos")), "sparsity": A.sparsity_metrics(act), "entropy": A.feature_entropy(act), "dead": A.dead_ratio(act),
           "correlation": P.mean_abs_correlation(vec), "interpretability": A.interpretability_score(vec, act, co, cos)}
    if circ is not None:
        nodes = C.circuit_nodes(instances)
        out |= {"circuits": C.circuit_summary(circ), "coverage": C.circuit_coverage(nodes, act), "modularity": C.circuit_modularity(circ, nodes)}
    if res is not None:
        out["biological"] = P.conservation_correlation(vec, res)
    return out


def relevance(act: DataFrame, sites: DataFrame, res: DataFrame) -> Report:
    """Simple relevance: best template enrichment, site enrichment, structure and function."""
    t = B.template_enrichment(act, B.TEMPLATES)
    return {"motifs": t.groupBy("template").agg(F.max("enrichment").alias("enrichment")), "sites": B.site_enrichment(act, sites), "structure": B.structure_function(act, res)}


def novelty(act: DataFrame, vec: DataFrame, coords: DataFrame, known: DataFrame, circ: DataFrame | None = None) -> Report:
    """Novelty: discoveries of every kind, circuits among them, then validated, ranked, with hypotheses and a summary."""
    cols = [*N.FEAT, "novelty_score", "confidence", "discovery_type", "evidence"]
    d = N.statistical_novelty(act).select(*cols).unionByName(N.pattern_novelty(act, A.coactivation_entropy(A.coactivation(vec))).select(*cols)).unionByName(N.structural_novelty(act, coords).select(*cols))
    if circ is not None:
        d = d.unionByName(N.circuit_discoveries(circ).select(*cols))
    d = cut_lineage(d)
    valid = cut_lineage(N.validate_discoveries(d, known))
    return {"discoveries": d, "validated": valid, "ranked": N.rank_discoveries(valid), "hypotheses": N.hypotheses(valid), "experiments": N.experiments(valid), "summary": N.discovery_summary(valid)}


def dataset(proteins: DataFrame, coords: DataFrame, residues: DataFrame, cells: DataFrame, max_len: int = 1022, seed: int = 42) -> Report:
    """A training set from its sources: sequences of at most ``max_len`` with their split, vocabularies, structures and alignment features.

    ``proteins``: protein_id, sequence and optional lists go_terms, keywords. Only proteins that stay keep their structures.
    """
    kept = cut_lineage(Q.filter_len(proteins, max_len))
    split = Q.assign_split(kept, seed)
    ids = kept.select("protein_id")
    own = coords.join(ids, "protein_id", "left_semi")
    msa = alignment(cells)
    out = {"sequences": split, "split_counts": split.groupBy("split").agg(F.count("*").alias("n")), "coords": own, "contacts": T.contacts(own), "residues": residues.join(ids, "protein_id", "left_semi"),
           "conservation": msa["conservation"], "neff": msa["neff"], "coevolution": msa["coevolution"]}
    for name in ("go_terms", "keywords"):
        if name in kept.columns:
            out[f"vocab_{name}"] = Q.build_vocab(kept.select(F.lit(name).alias("kind"), F.explode(name).alias("term"))).drop("kind")
    return out


def write_dataset(parts: Report, path: str) -> None:
    """Every part as its own Parquet folder below ``path``."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
