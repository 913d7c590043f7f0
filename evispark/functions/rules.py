"""Pattern tables and vocabularies."""

# The patterns, labels, aliases, weights and thresholds below decide results, so they are
# stated exactly as the data format defines them.

MODULE_RULES = [
    ("rbp_depolymerase", r"depolymerase|tail ?spike|tail ?fiber|receptor[- ]?binding|capsule|polysaccharide"),
    ("tail_structural", r"tail|baseplate|tape measure|sheath"),
    ("head_structural", r"capsid|portal|head|terminase|prohead"),
    ("lysis", r"lysin|endolysin|holin|spanin|amidase|peptidoglycan"),
    ("replication", r"polymerase|helicase|primase|replication|ssb|sliding clamp"),
    ("lysogeny", r"integrase|excisionase|repressor|partition|lysogen"),
    (
        "defense_counterdefense",
        r"anti[- ]?crispr|methyltransferase|restriction|nuclease inhibitor|dnd|mom|dam|modification",
    ),
    ("hypothetical", r"hypothetical|unknown|uncharacteri[sz]ed"),
]
UNINFORMATIVE_PRODUCT = r"hypothetical|unknown|uncharacteri[sz]ed"

RBP_PATTERN = r"receptor[- ]?binding|tail ?fiber|tail ?spike|tailspike|baseplate|host[- ]?range|adhesin"
DEPOLYMERASE_PATTERN = (
    r"(?<!rbp_)depolymerase|capsul(?:e|ar)|polysaccharide|glycosidase|glycanase"
    r"|(?:^|[_\s-])lyase(?:$|[_\s-])|hyaluronidase|pectate|sialidase"
)
EXCLUSION_PATTERN = r"terminase|capsid|portal|holin|endolysin|integrase|polymerase|helicase"
TAIL_CONTEXT_PATTERN = r"tail|baseplate|fiber|spike|tape measure|sheath"
SUPPORT_PATTERN = r"depolymerase|tail|fiber|spike|receptor|capsule|polysaccharide|glycosidase|lyase"
SPIKE_PATTERN = r"tail ?spike|tailspike|spike"

CANDIDATE_WEIGHTS = {
    "rbp_keyword": 0.25,
    "depolymerase_keyword": 0.25,
    "annotation_module_hint": 0.20,
    "sequence_hit": 0.15,
    "weak_sequence_hit": 0.05,
    "domain_support": 0.20,
    "domain_present": 0.10,
    "structural_support": 0.25,
    "structural_hit": 0.10,
    "tail_synteny_context": 0.10,
    "length_support": 0.05,
}
CANDIDATE_THRESHOLDS = {
    "min_protein_length_aa": 150,
    "medium_confidence_score": 0.50,
    "high_confidence_score": 0.75,
    "require_synteny_for_high_confidence": True,
}

DEFENSE_RULES = [
    ("CRISPR-Cas", r"crispr|cas"),
    (
        "restriction-modification",
        r"restriction|methylation|methyltransferase|rm system|type i rm|type ii rm|type iii rm",
    ),
    ("BREX", r"brex"),
    ("DISARM", r"disarm"),
    ("Abi", r"abortive|\babi\b"),
    ("toxin-antitoxin", r"toxin|antitoxin|TA system"),
    ("retrons", r"retron"),
    ("nuclease-based defense", r"nuclease|dnd|wadjet|zorya|septu"),
]
DEFENSE_IMPORT_RULES = [
    ("CRISPR-Cas", r"crispr|\bcas\b"),
    ("restriction-modification", r"restriction|methylation|methyltransferase|rm system|type [ivx]+ rm"),
    ("BREX", r"brex"),
    ("DISARM", r"disarm"),
    ("Abi", r"abortive|\babi\b"),
    ("toxin-antitoxin", r"toxin|antitoxin|TA system"),
    ("retrons", r"retron"),
    ("nuclease-based defense", r"nuclease|dnd|wadjet|zorya|septu"),
]
ANTIDEFENSE_RULES = [
    ("anti_crispr", "CRISPR-Cas", r"anti[-_ ]?crispr|\bacr\b|acr[IFV][0-9]"),
    (
        "anti_restriction_modification",
        "restriction-modification",
        r"anti[-_ ]?restriction|restriction alleviation|ocr protein|ard[ab]|methyltransferase"
        r"|DNA methylase|dam methylase|modification methylase",
    ),
    (
        "dna_modification",
        "restriction-modification",
        r"mom protein|DNA modification|hydroxymethyl|glucosyltransferase|methyltransferase|DNA methylase",
    ),
    ("nuclease_inhibitor", "nuclease-based defense", r"nuclease inhibitor|anti[-_ ]?nuclease|inhibitor of nuclease"),
    (
        "recombination_repair",
        "abortive infection or DNA damage defense",
        r"recombinase|rec[abfor]|single[-_ ]strand annealing|rad52",
    ),
    ("general_counterdefense", "unknown", r"anti[-_ ]?defen[cs]e|counter[-_ ]?defen[cs]e|defense inhibitor"),
]

CDS_RULES = [
    (
        "rbp_depolymerase",
        (
            "depolymerase",
            "tailspike",
            "tail spike",
            "tail fiber",
            "tail fibre",
            "receptor-binding",
            "receptor binding",
            "capsule",
            "polysaccharide",
        ),
    ),
    ("structural", ("tail", "baseplate", "capsid", "terminase", "portal")),
    ("lysogeny", ("integrase", "repressor", "excisionase")),
    ("lysis", ("lysin", "endolysin", "holin", "spanin", "amidase")),
    ("replication", ("polymerase", "helicase", "primase", "replication")),
    (
        "defense_counterdefense",
        (
            "methyltransferase",
            "restriction",
            "anti-crispr",
            "nuclease",
            "endonuclease",
            "exonuclease",
        ),
    ),
    ("unknown", ("hypothetical", "unknown", "uncharacterized")),
]

BOOLEAN_WORDS = {
    "true": "true",
    "t": "true",
    "yes": "true",
    "y": "true",
    "1": "true",
    "false": "false",
    "f": "false",
    "no": "false",
    "n": "false",
    "0": "false",
}
RESULT_WORDS = {
    "+": "positive",
    "pos": "positive",
    "yes": "positive",
    "1": "positive",
    "-": "negative",
    "neg": "negative",
    "no": "negative",
    "0": "negative",
    "na": "not_measured",
    "n/a": "not_measured",
    "not done": "not_measured",
}
RESULT_VALUES = ("positive", "negative", "inconclusive", "not_measured", "not_tested", "mixed", "unknown")
RESULT_COLUMNS = (
    "adsorption_result",
    "spot_result",
    "plaque_result",
    "productive_infection_result",
    "growth_inhibition_result",
)
ASSAY_TYPES = (
    "adsorption",
    "spot",
    "plaque",
    "eop",
    "growth_inhibition",
    "productive_infection",
    "kill_curve",
    "mixed_panel",
    "other",
)
OUTCOME_TIERS = (
    "initial_interaction",
    "productive_infection_confirmed",
    "productive_infection",
    "tested_negative",
    "no_interaction",
    "mixed",
    "not_tested",
    "unknown",
)
EVIDENCE_TIERS = (
    "curated_assay",
    "supplementary_matrix",
    "literature_table",
    "primary_data",
    "metadata_only",
    "unknown",
)
RELATIONSHIP_TYPES = (
    "isolation_host",
    "reported_host",
    "prophage_resident_host",
    "predicted_host",
    "tested_assay_host",
)
RELATIONSHIP_STATUSES = ("reviewed", "inferred", "predicted", "unresolved", "deprecated", "unknown")
CONFIDENCE_WORDS = ("high", "medium", "low", "unknown")
ASSAY_REQUIRED = (
    "interaction_id",
    "phage_id",
    "host_id",
    "study_id",
    "assay_type",
    "tested",
    "evidence_tier",
    "reference",
)
RELATIONSHIP_REQUIRED = (
    "relationship_id",
    "phage_id",
    "host_id",
    "relationship_type",
    "relationship_status",
    "relationship_evidence",
    "source_reference",
)
ASSAY_COLUMNS = (
    "interaction_id",
    "phage_id",
    "host_id",
    "study_id",
    "panel_id",
    "assay_type",
    "tested",
    "adsorption_result",
    "spot_result",
    "plaque_result",
    "productive_infection_result",
    "eop",
    "eop_reference_host",
    "growth_inhibition_result",
    "moi",
    "temperature_c",
    "medium",
    "replicate_count",
    "outcome_tier",
    "evidence_tier",
    "reference",
    "notes",
)
REVIEWED = ("reviewed", "accepted", "approved")

MATRIX_POSITIVE = ("1", "1.0", "true", "positive", "pos", "+")
MATRIX_NEGATIVE = ("0", "0.0", "false", "negative", "neg", "-")
MATRIX_SKIP = ("", "na", "n/a", "not_tested", "untested", "nan")

RECORD_TYPES = ("host", "metagenomic_viral_contig", "phage", "prophage")
PHAGE_LIKE = ("phage", "prophage", "metagenomic_viral_contig")
LIFESTYLES = ("virulent", "temperate", "ambiguous", "NA", "")
MANIFEST_COLUMNS = (
    "record_type",
    "genome_id",
    "accession",
    "source",
    "isolation_host",
    "host_species",
    "host_strain",
    "country",
    "year",
    "phage_lifestyle",
    "genome_length",
    "gc_percent",
    "K_type",
    "O_type",
    "ST",
    "AMR_markers",
    "virulence_markers",
    "raw_sequence_path",
    "notes",
)

QC_LIMITS = {
    "min_genome_length_bp": 10000,
    "max_genome_length_bp": 1000000,
    "max_host_genome_length_bp": 15000000,
    "min_gc_percent": 20,
    "max_gc_percent": 80,
    "max_n_percent": 5,
    "max_ambiguous_percent": 1,
    "metadata_length_tolerance_bp": 0,
    "metadata_gc_tolerance_percent": 1,
}
SPECIES_IDENTITY_PERCENT = 95.0
SPECIES_COVERAGE_PERCENT = 85.0
SCORE_CUTS = ((0.9, "xgb_score_ge_0_9"), (0.5, "xgb_score_0_5_to_0_9"))
SCORE_BELOW = "xgb_score_lt_0_5"

K_O_FEATURE_SETS = {
    "taxonomy_only": ("species_cluster_id",),
    "whole_genome_similarity": ("species_cluster_id", "representative_id"),
    "rbp_depolymerase_modules": ("rbp_module_clusters", "rbp_enzyme_classes", "rbp_candidate_count_bin"),
    "taxonomy_plus_rbp": ("species_cluster_id", "rbp_module_clusters", "rbp_enzyme_classes"),
}
H3_MINIMA = {"min_assessed": 20, "min_groups": 2, "min_group_size": 5}
PRODUCTIVE_OBSERVED = ("positive", "negative", "inconclusive", "equivocal")
