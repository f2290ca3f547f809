"""Residue scales, pattern sets and default knowledge tables.

Fixed values below (amino-acid scales, patterns, weights, term ids) must match the published
definitions exactly, so they are stated as plain tables.
"""

AMINO = "ACDEFGHIKLMNPQRSTVWY"
ALIGN = AMINO + "-"
SS8 = "HBEGITS-"

KYTE_DOOLITTLE = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
HOPP_WOODS = {
    "A": -0.5, "C": -1.0, "D": 3.0, "E": 3.0, "F": -2.5, "G": 0.0, "H": -0.5, "I": -1.8, "K": 3.0, "L": -1.8,
    "M": -1.3, "N": 0.2, "P": 0.0, "Q": 0.2, "R": 3.0, "S": 0.3, "T": -0.4, "V": -1.5, "W": -3.4, "Y": -2.3,
}
# charge at pH 7; histidine is 0.1 here and 0.5 in the coarse scale
CHARGE = {"D": -1.0, "E": -1.0, "H": 0.1, "K": 1.0, "R": 1.0}
CHARGE_COARSE = {"D": -1.0, "E": -1.0, "H": 0.5, "K": 1.0, "R": 1.0}
WEIGHT = {
    "A": 89.1, "C": 121.2, "D": 133.1, "E": 147.1, "F": 165.2, "G": 75.1, "H": 155.2, "I": 131.2, "K": 146.2,
    "L": 131.2, "M": 149.2, "N": 132.1, "P": 115.1, "Q": 146.2, "R": 174.2, "S": 105.1, "T": 119.1, "V": 117.1,
    "W": 204.2, "Y": 181.2,
}
DALTON = {
    "A": 89.0, "C": 121.0, "D": 133.0, "E": 147.0, "F": 165.0, "G": 75.0, "H": 155.0, "I": 131.0, "K": 146.0,
    "L": 131.0, "M": 149.0, "N": 132.0, "P": 115.0, "Q": 146.0, "R": 174.0, "S": 105.0, "T": 119.0, "V": 117.0,
    "W": 204.0, "Y": 181.0,
}
VOLUME = {
    "A": 88.6, "C": 108.5, "D": 111.1, "E": 138.4, "F": 189.9, "G": 60.1, "H": 153.2, "I": 166.7, "K": 168.6,
    "L": 166.7, "M": 162.9, "N": 114.1, "P": 112.7, "Q": 143.8, "R": 173.4, "S": 89.0, "T": 116.1, "V": 140.0,
    "W": 227.8, "Y": 193.6,
}
HELIX = {
    "A": 1.42, "C": 0.70, "D": 1.01, "E": 1.51, "F": 1.13, "G": 0.57, "H": 1.00, "I": 1.08, "K": 1.16, "L": 1.21,
    "M": 1.45, "N": 0.67, "P": 0.57, "Q": 1.11, "R": 0.98, "S": 0.77, "T": 0.83, "V": 1.06, "W": 1.08, "Y": 0.69,
}
SHEET = {
    "A": 0.83, "C": 1.19, "D": 0.54, "E": 0.37, "F": 1.38, "G": 0.75, "H": 0.87, "I": 1.60, "K": 0.74, "L": 1.30,
    "M": 1.05, "N": 0.89, "P": 0.55, "Q": 1.10, "R": 0.93, "S": 0.75, "T": 1.19, "V": 1.70, "W": 1.37, "Y": 1.47,
}
FLEXIBILITY = {
    "A": 0.357, "C": 0.346, "D": 0.511, "E": 0.497, "F": 0.314, "G": 0.544, "H": 0.323, "I": 0.462, "K": 0.466,
    "L": 0.365, "M": 0.295, "N": 0.463, "P": 0.509, "Q": 0.493, "R": 0.529, "S": 0.507, "T": 0.444, "V": 0.386,
    "W": 0.305, "Y": 0.420,
}
DONOR_COUNT = {"H": 1, "K": 1, "N": 1, "Q": 1, "R": 2, "S": 1, "T": 1, "W": 1, "Y": 1}
ACCEPTOR_COUNT = {"D": 2, "E": 2, "H": 1, "M": 1, "N": 1, "Q": 1, "S": 1, "T": 1, "Y": 1}
DONOR_SIDE = "NRKWQHSTYC"
ACCEPTOR_SIDE = "DEQNHSTYCM"
CATALYTIC = "HDSCEK"
DISORDER = "PESKRQA"

SS_MOTIFS = {
    "helix_cap_n": "CHHH", "helix_cap_c": "HHHC", "beta_hairpin": "EETTEE",
    "beta_bulge": "EESEE", "helix_kink": "HHTHH", "beta_alpha_beta": "ECHHCE",
}

# name, pattern edges, function, conservation, min size, max size, required property
MOTIF_LIBRARY = [
    ("feed_forward", [(0, 1), (0, 2), (1, 2)], "Signal amplification and filtering", 0.85, 3, 5, "coherent"),
    ("feedback_loop", [(0, 1), (1, 2), (2, 0)], "Homeostasis and oscillation", 0.80, 3, 8, "cyclic"),
    ("cascade", [(0, 1), (1, 2), (2, 3)], "Signal transduction", 0.90, 3, 10, "linear"),
    ("hub", [(0, 1), (0, 2), (0, 3), (0, 4)], "Central regulation", 0.75, 4, 20, "central_node"),
    ("bi_fan", [(0, 2), (0, 3), (1, 2), (1, 3)], "Coordinated regulation", 0.70, 4, 6, "bipartite"),
]
GO_TERMS = [
    ("molecular_function", "catalytic_activity", "GO:0003824"), ("molecular_function", "binding", "GO:0005488"),
    ("molecular_function", "transporter", "GO:0005215"), ("biological_process", "metabolism", "GO:0008152"),
    ("biological_process", "regulation", "GO:0065007"), ("biological_process", "signaling", "GO:0023052"),
    ("cellular_component", "membrane", "GO:0016020"), ("cellular_component", "nucleus", "GO:0005634"),
    ("cellular_component", "cytoplasm", "GO:0005737"),
]
PFAM = [
    ("PF00001", "GPCR", "G-protein coupled receptor"), ("PF00018", "SH3", "SH3 domain"),
    ("PF00169", "PH", "PH domain"), ("PF00595", "PDZ", "PDZ domain"),
    ("PF00069", "Pkinase", "Protein kinase domain"),
]
VARIANTS = [
    (53, "R", "H", "cancer", "pathogenic"), (175, "R", "H", "cancer", "pathogenic"),
    (72, "P", "R", None, "benign"),
]
KNOWN_MOTIFS = {
    "helix_cap": ["NNXXXXEE", "STPX", "GXXX"], "zinc_finger": ["CXXC", "CXXXXC", "HXXH"],
    "nuclear_localization": ["KKKRK", "PKKKRKV"], "glycosylation": ["NXS", "NXT"],
    "phosphorylation": ["SXX[DE]", "[ST]P"], "leucine_zipper": ["LXXXXXXL" * 4],
    "walker_a": ["GXXXXGK[ST]"], "walker_b": ["DXXG"], "catalytic_triad": ["HDS", "HDC", "SHD"],
}
# layers kept per model size: full extraction and the sparser dataset preset
LAYER_PRESETS = {
    "8M": list(range(1, 7)), "35M": list(range(1, 13)), "150M": list(range(1, 31)), "650M": list(range(1, 34)),
}
DATASET_PRESETS = {
    "8M": [1, 2, 3, 4, 5, 6], "35M": [1, 3, 6, 9, 12],
    "150M": list(range(1, 31, 5)), "650M": list(range(1, 34, 5)),
}
BINDING_PATTERNS = {"nucleotide": "G.G..G", "zinc": "C..C", "metal": "D.D", "kinase_substrate": "[ST].[RK]"}
DOMAIN_PATTERNS = {
    "SH3": "Y...[PV]..P", "PDZ": "[ST].[VIL]", "WW": "W...W",
    "RING": "C.{2}C.{9,39}C.{1,3}H.{2,3}C.{2}C.{4,48}C.{2}C",
}
STRUCTURAL_PATTERNS = {"helix_cap": "N[TS]", "beta_turn": "PG", "proline_kink": "P", "glycine_hinge": "G"}
PTM_PATTERNS = {
    "phosphorylation": "[ST][RK].|[ST]P", "ubiquitination": "K", "methylation": "[RK]", "acetylation": "K",
    "sumoylation": "[VI]K.E",
}
