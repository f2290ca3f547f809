"""Queries: whole reports with all their members in one long table; their SQL is that of the members."""

from pyspark.sql import functions as F

from ..operators import novelty as N
from ..operators import reports as R
from ..sources import views as S
from .q_circuits import STRONG, edges_of, labels_of, motifs_of
from .q_pairs import direct_edges
from .q_scoring import discoveries
from .q_structure import weights
from .registry import DIGITS, ORACLES, RAW, query





def member(keys: str, values: str) -> tuple[list[str], list[str]]:
    return keys.split(), values.split()


def report(name: str, parts: dict[str, tuple[str, str, str]]):
    """Register a report; ``parts``: part -> (query whose SQL gives it, key columns, value columns)."""
    columns = {part: member(k, v) for part, (_, k, v) in parts.items()}
    sql = []
    for part, (source, _, _) in parts.items():
        keys, values = columns[part]
        key = "concat_ws('|', " + ", ".join(f'''coalesce("{k}"::varchar, '')''' for k in keys) + ")" if keys else "''"
        names, cells = ", ".join(f"'{v}'" for v in values), ", ".join(f'round("{v}"::double, {DIGITS}) + 0e0' for v in values)
        sql.append(f"select '{part}' as part, {key} as key, unnest([{names}]) as metric, unnest([{cells}]) as value from ({RAW[source]}) q_{part}")

    def wrap(fn):
        query(name)(lambda s, p: R.long_form(fn(s, p), columns))
        ORACLES[name] = "\nunion all\n".join(sql)
        return fn

    return wrap


@report("C1_evolution_all", {
    "similarity": ("Q15_layer_similarity", "la lb", "similarity"), "magnitude": ("A7_layer_magnitude", "layer", "magnitude diversity"), "residual": ("Q15_residual_strength", "lb", "residual_strength"),
    "patterns": ("W1_emergence", "layer feature pattern", "delta"), "stable": ("Q19_stable_features", "feature", "min_corr"),
    "layers": ("C1_evolution_report", "layer", "magnitude diversity similarity residual_strength n_emerging n_decaying")})
def _(s, p):
    return R.evolution(S.activations_vec(s, p), S.activations(s, p), 0.03)


@report("C2_transition_all", {
    "matrix": ("Q16_transition_cosine", "la lb i j", "weight"), "patterns": ("Q18_transformations", "la kind feature", "partners"), "flow": ("Q4_info_flow_median", "la", "information_flow"),
    "rates": ("A14_activation_rate", "layer feature", "activation_rate")})
def _(s, p):
    return R.transition(S.activations_vec(s, p), S.activations(s, p))


@report("C3_tracker_all", {
    "states": ("A4_layer_state", "protein_id layer feature", "magnitude frequency"), "transitions": ("Q20_classify_transitions", "protein_id feature source_layer target_layer transformation_type", "magnitude_change correlation"),
    "lineages": ("G14_lineages", "protein_id feature", "length"), "summary": ("A16_layer_summary", "protein_id layer", "n_emerged kept emergence_rate preservation_rate"),
    "type_counts": ("A15_transition_counts", "transformation_type", "n"), "layer_similarity": ("SO3_layer_jaccard", "protein_id la lb", "jaccard"),
    "critical": ("T2_critical_transitions", "protein_id feature source_layer target_layer transformation_type", "magnitude_change correlation abs_change")})
def _(s, p):
    return R.layers(S.activations_vec(s, p), S.activations(s, p), S.LAYERS)


@report("C4_alignment_all", {
    "profile": ("A21_msa_profile", "family_id col aa", "frequency"), "weights": ("A22_sequence_weights", "family_id seq_idx", "weight"), "pssm": ("A23_pssm", "family_id col aa", "score"),
    "gaps": ("A24_gap_stats", "family_id col", "gap_freq depth"), "conservation": ("A25_conservation", "family_id col", "conservation"), "neff": ("A26_neff", "family_id", "neff"),
    "diversity": ("A27_diversity", "family_id", "diversity"), "coevolution": ("A29_apc", "family_id c1 c2", "score")})
def _(s, p):
    return R.alignment(S.msa_cells(s, p), weights(s, p))


@report("C5_structure_all", {
    "contacts": ("J4_contacts", "protein_id i j", "distance"), "shape": ("A33_shape_metrics", "protein_id", "n end_to_end radius_of_gyration asphericity acylindricity"),
    "moments": ("A34_moments", "protein_id", "m001 m010 m100 m002 m011 m020 m101 m110 m200 m003 m012 m021 m030 m102 m111 m120 m201 m210 m300"), "rdf": ("A35_rdf", "protein_id bin", "rdf"), "adf": ("A36_adf", "protein_id bin", "adf"),
    "contact_order": ("A37_contact_order", "protein_id", "contact_order"), "local": ("A38_local_geometry", "protein_id pos", "density compactness depth"), "exposure": ("A39_exposure", "protein_id pos", "exposure"),
    "backbone": ("W9_backbone", "protein_id pos", "bond_length curvature bond_angle"), "dihedrals": ("W10_dihedrals", "protein_id pos", "dihedral unsigned"), "motifs": ("B12_structural_motifs", "protein_id", "hairpins helix_pairs loops")})
def _(s, p):
    return R.structure(S.token_residues(s, p), S.coords(s, p), S.atoms(s, p))


@report("C6_biophysics_all", {
    "cores": ("G4_hydrophobic_cores", "protein_id", "n_points n_clusters core_score"), "salt_bridges": ("J9_salt_bridges", "protein_id positive negative", "distance"), "electrostatic": ("A40_electrostatic_energy", "protein_id", "energy"),
    "dipole": ("A40_dipole", "protein_id", "net_charge magnitude dir_x dir_y dir_z"), "hbonds": ("J8_hbond_pairs", "protein_id donor acceptor", "distance"), "hbond_energy": ("A41_hbond_energy", "protein_id", "energy n_bonds"),
    "hbond_motifs": ("B13_hbond_motifs", "protein_id", "alpha_helix beta_sheet beta_turn helix_cap")})
def _(s, p):
    return R.biophysics(S.token_residues(s, p), S.coords(s, p))


@report("C7_properties_all", {
    "clusters": ("W2_hydrophobic_clusters", "protein_id start end", "length score"), "charge": ("A42_charge_distribution", "protein_id", "positive_fraction negative_fraction net_charge"),
    "helices": ("W2_runs", "protein_id start end", "length"), "transitions": ("W3_transitions", "protein_id from_state to_state", "n"), "sequence_motifs": ("B10_sequence_motifs", "protein_id motif", "n pos_sum"),
    "property_motifs": ("B10_property_motifs", "protein_id", "n pos_sum confidence")})
def _(s, p):
    r = R.properties(S.states(s, p))
    counted = {"transitions": r["transition_counts"],
               "sequence_motifs": r["sequence_motifs"].groupBy("protein_id", "motif").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum")),
               "property_motifs": r["property_motifs"].groupBy("protein_id").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.avg("confidence").alias("confidence"))}
    return r | counted


@report("C8_circuits_all", {
    "circuits": ("T5_motif_ranking", "structure", "size frequency avg_weight importance"), "scores": ("G9_validate_circuits", "structure", "coherence stability task_relevance overall_score"),
    "validated": ("C8_discover_circuits", "structure", "size frequency avg_weight importance overall_score"), "summary": ("A17_circuit_summary", "", "num_circuits avg_size std_size avg_importance std_importance max_importance")})
def _(s, p):
    return R.circuits(edges_of(s, p).filter(F.col("weight") > STRONG), S.activations_vec(s, p), labels_of(s, p), 0.3)


@report("C9_causality_all", {
    "mediated": ("Q11_mediation", "layer cause effect mediator", "strength confidence"), "temporal": ("Q13_temporal_causality", "layer cause effect", "strength confidence lag"),
    "relations": ("SO1_union_relations", "layer cause effect mechanism mediators", "strength confidence lag"), "edges": ("G16_causal_edges_confidence", "layer cause effect mechanism", "strength confidence")})
def _(s, p):
    v = S.activations_vec(s, p)
    r = R.causality(v, direct=direct_edges(v), mediation_thr=0.005)
    return r | {"relations": r["relations"].withColumn("mediators", F.array_join("mediators", ","))}


@report("C10_metrics_all", {
    "reconstruction": ("A13_reconstruction_metrics", "", "mse mae normalized_error normalized_error_std cosine_similarity variance_explained r2"), "sparsity": ("A11_sparsity_metrics", "", "l0_sparsity l1_sparsity freq_mean freq_std"),
    "entropy": ("A12_feature_entropy", "", "feature_entropy"), "dead": ("A10_dead_ratio", "", "dead_ratio"), "correlation": ("Q1_mean_abs_correlation", "", "feature_correlation"),
    "interpretability": ("Q27_interpretability_score", "name", "value"), "circuits": ("A17_circuit_summary", "", "num_circuits avg_size std_size avg_importance std_importance max_importance"),
    "coverage": ("SO5_circuit_coverage", "", "used unused coverage"), "modularity": ("SO4_circuit_modularity", "", "modularity"), "biological": ("Q2_conservation_correlation", "", "value std")})
def _(s, p):
    v = S.activations_vec(s, p)
    return R.metrics(v, S.activations(s, p), v.filter("layer = 0"), v.filter("layer = 1"), S.token_residues(s, p), *motifs_of(s, p))


@report("C11_relevance_all", {"motifs": ("C11_simple_relevance", "template", "enrichment"), "sites": ("A31_site_enrichment", "kind", "enrichment"), "structure": ("A32_structure_function", "", "helix sheet structure_function")})
def _(s, p):
    r = S.token_residues(s, p)
    site = lambda kind, x: r.select("protein_id", "pos", F.lit(kind).alias("kind"), x.alias("probability"))
    return R.relevance(S.activations(s, p), site("active", F.col("conservation")).unionByName(site("binding", 1 - F.col("conservation"))), r)


@query("C12_circuit_discoveries", f"""select -1 as layer, -999-row_number() over (order by round(importance, 9) desc, structure) as feature, structure, least(1, size/10.0::double) as novelty_score, 'Circuit with '||size||' components' as biological_context
 from ({RAW['T5_motif_ranking']}) c qualify least(1, size/10.0::double)>0.6""", d="novelty_score", i="layer feature")
def _(s, p):
    return N.circuit_discoveries(motifs_of(s, p)[0]).select("layer", "feature", "structure", "novelty_score", "biological_context")


@query("P23_experiments", f"""select layer, feature, priority, unnest(['deletion', 'chimera']) as type, unnest(['Domain deletion to test necessity', 'Domain swapping with homologs']) as description
 from ({RAW['P23_annotate_discoveries']}) a""")
def _(s, p):
    return N.experiments(discoveries(s, p)).drop("discovery_type")




def dataset_of(s, p):
    return R.dataset(S.proteins(s, p).select("protein_id", "sequence", F.array("source").alias("keywords")), S.coords(s, p), S.token_residues(s, p), S.msa_cells(s, p))


@query("C13_sequences", """select protein_id, len, case when rn<=floor(n*0.8) then 'train' when rn<=floor(n*0.8)+floor(n*0.1) then 'val' else 'test' end as split
 from (select protein_id, length(sequence) as len, row_number() over (order by md5(protein_id||'-42'), protein_id) as rn, count(*) over () as n from prot where length(sequence)<=1022)""", "prot")
def _(s, p):
    return dataset_of(s, p)["sequences"].select("protein_id", F.length("sequence").alias("len"), "split")


@query("C13_contacts", f"select c.* from ({RAW['J4_contacts']}) c join prot using (protein_id) where length(sequence)<=1022", "prot", d="distance")
def _(s, p):
    return dataset_of(s, p)["contacts"]


@query("C13_vocabulary", "select term, row_number() over (order by term)-1 as idx from (select distinct source as term from prot where length(sequence)<=1022)", "prot")
def _(s, p):
    return dataset_of(s, p)["vocab_keywords"]


@report("C13_dataset", {"sequences": ("C13_sequences", "protein_id split", "len"), "contacts": ("C13_contacts", "protein_id i j", "distance"), "vocab_keywords": ("C13_vocabulary", "term", "idx"),
                        "conservation": ("A25_conservation", "family_id col", "conservation"), "neff": ("A26_neff", "family_id", "neff"), "coevolution": ("A29_apc", "family_id c1 c2", "score")})
def _(s, p):
    r = dataset_of(s, p)
    return r | {"sequences": r["sequences"].withColumn("len", F.length("sequence"))}
