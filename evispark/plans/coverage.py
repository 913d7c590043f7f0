"""Which evidence the tested pairs of an assay have, and which was never looked for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from evispark.functions import rules as R
from evispark.functions.missing import is_informative, present, text
from evispark.functions.numbers import to_int_or
from evispark.operators.evidence import Evidence, Metric, mask_coverage
from evispark.operators.joins import last_rows

BITS = Evidence((
    "qc_seen", "qc_passed", "raw_sequence", "K_type", "O_type", "ST", "annotation", "rbp", "domain", "domain_seen", "structure", "structure_seen",
    "defense", "defense_seen", "counter", "counter_seen", "phage_receptor", "host_receptor",
))
# Words of a hit column that say there is none, and tools and notes of a standardised annotation.
NO_HIT = ("absent", "none", "no_domain_evidence", "no_structural_evidence")
STANDARD_TOOLS, STANDARD_NOTE = "pharokka|phrog", "standardized"
DOMAIN_COLUMNS = ("domain_hit", "domain_support", "best_domain_hit")
STRUCTURE_COLUMNS = ("structural_hit", "structural_support", "best_structural_hit")
STRUCTURE_LOOKED_FOR = ("structural_hit", "structural_hit_id", "structural_support", "best_structural_hit")
SPOT_RESULTS = ("positive", "negative")


def _any_hit(df: DataFrame, columns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for c in columns:
        if c in df.columns:
            found = found | (is_informative(c) & ~F.lower(text(c)).isin(*NO_HIT))
    return found


def _counted(df: DataFrame, count: str, lists: tuple[str, ...]) -> Column:
    found = to_int_or(count, 0) > 0 if count in df.columns else F.lit(False)
    for c in lists:
        if c in df.columns:
            found = found | is_informative(c)
    return found


def evidence_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Masks of all ids in the evidence tables, each of which may be absent: ``sequence_qc``, ``manifest``, ``annotations``,
    ``rbps``, ``domains``, ``hosts``, ``host_defense``, ``counter_defense``, ``phage_receptors``, ``host_receptors``.

    Of repeated rows of ``sequence_qc``, ``manifest`` and ``hosts`` the last one counts (``last_rows``).
    """
    sources = []
    if (qc := tables.get("sequence_qc")) is not None:
        qc = last_rows(qc, "genome_id", ["passes_sequence_qc", "sequence_qc_status"])
        passed = (F.lower(text("passes_sequence_qc")) == "true") | (F.lower(text("sequence_qc_status")) == "pass")
        sources.append((qc, "genome_id", {"qc_seen": True, "qc_passed": passed}))
    if (m := tables.get("manifest")) is not None:
        m = last_rows(m, "genome_id", ["has_raw_sequence", "raw_sequence_path"])
        sources.append((m, "genome_id", {"raw_sequence": (F.lower(text("has_raw_sequence")) == "true") & present("raw_sequence_path")}))
    if (a := tables.get("annotations")) is not None:
        standard = F.lower(text("tool")).rlike(STANDARD_TOOLS) | F.lower(text("evidence")).contains(STANDARD_NOTE)
        sources.append((a, "genome_id", {"annotation": standard}))
    if (r := tables.get("rbps")) is not None:
        sources.append((r, "genome_id", {"rbp": True, "domain": _any_hit(r, DOMAIN_COLUMNS), "structure": _any_hit(r, STRUCTURE_COLUMNS)}))
    if (d := tables.get("domains")) is not None:
        looked = any(c in d.columns for c in STRUCTURE_LOOKED_FOR)
        hits = {"domain": _any_hit(d, DOMAIN_COLUMNS), "structure": _any_hit(d, STRUCTURE_COLUMNS)}
        sources.append((d, "genome_id", {"domain_seen": True, "structure_seen": looked, **hits}))
    if (h := tables.get("hosts")) is not None:
        types = ["K_type", "O_type", "ST"]
        sources.append((last_rows(h, "host_genome_id", types), "host_genome_id", {c: is_informative(c) for c in types}))
    if (d := tables.get("host_defense")) is not None:
        sources.append((d, "host_genome_id", {"defense_seen": True, "defense": _counted(d, "host_defense_system_count", ("host_defense_types", "host_defense_systems"))}))
    if (c := tables.get("counter_defense")) is not None:
        sources.append((c, "phage_genome_id", {"counter_seen": True, "counter": _counted(c, "phage_antidefense_count", ("phage_antidefense_targets", "phage_antidefense_classes"))}))
    for name, column, bit in (("phage_receptors", "phage_genome_id", "phage_receptor"), ("host_receptors", "host_genome_id", "host_receptor")):
        if (t := tables.get(name)) is not None:
            sources.append((t, column, {bit: True}))
    return BITS.masks(sources)


def coverage_metrics() -> list[Metric]:
    """Eleven metrics of phages or hosts and four of pairs, as tests of the masks; ``left`` is the phage."""
    phage, host = F.col("left_mask"), F.col("right_mask")

    def verified(mask: Column) -> Column:
        return BITS.has(mask, "qc_passed") | (~BITS.has(mask, "qc_seen") & BITS.has(mask, "raw_sequence"))

    def simple(name: str, side: str, detected: str, assessed: str | None = None) -> Metric:
        mask = phage if side == "left" else host
        return Metric(name, side, BITS.has(mask, detected), BITS.has(mask, assessed or detected))

    receptor = BITS.has(phage, "rbp") & (BITS.has(host, "K_type") | BITS.has(host, "O_type"))
    bridge = BITS.has(phage, "phage_receptor") & BITS.has(host, "host_receptor")
    productive = F.lower(text("productive_infection_result")).isin(*R.PRODUCTIVE_OBSERVED)
    return [
        Metric("phage_sequence_verified", "left", verified(phage), verified(phage) | BITS.has(phage, "qc_seen")),
        Metric("host_sequence_verified", "right", verified(host), verified(host) | BITS.has(host, "qc_seen")),
        simple("host_K_type", "right", "K_type"),
        simple("host_O_type", "right", "O_type"),
        simple("host_ST", "right", "ST"),
        simple("standardized_phage_annotation", "left", "annotation"),
        simple("rbp_candidates", "left", "rbp"),
        simple("domain_evidence", "left", "domain", "domain_seen"),
        simple("structural_evidence", "left", "structure", "structure_seen"),
        simple("host_defense_evidence", "right", "defense", "defense_seen"),
        simple("phage_counterdefense_evidence", "left", "counter", "counter_seen"),
        Metric("receptor_layer_feature_completeness", "both", receptor, receptor),
        Metric("seed_bridge_metadata_coverage", "both", bridge, bridge),
        Metric(
            "defense_counterdefense_feature_completeness", "both", BITS.has(phage, "counter") & BITS.has(host, "defense"),
            BITS.has(phage, "counter_seen") & BITS.has(host, "defense_seen"),
        ),
        Metric("productive_infection_outcomes", "both", productive, productive),
    ]


def assay_feature_coverage(assays: DataFrame, tables: Mapping[str, DataFrame], breadth: DataFrame | None = None) -> DataFrame:
    """Coverage rows of the tested spot pairs: counts of phages, hosts and pairs, 26 metrics, and a row per phage and panel.

    Columns: ``metric, entity_level, numerator, assessed, denominator, coverage_fraction, evidence_state, phage_id, panel_id``.
    ``breadth`` (``phage_id, panel_id, positive_host_count, tested_host_count``) adds the rows of level ``phage_panel``.
    """
    tested = assays.filter((F.col("tested").cast("string") == "true") & (F.col("assay_type") == "spot") & F.col("spot_result").isin(*SPOT_RESULTS))
    pairs = tested.select("phage_id", "host_id", "productive_infection_result")
    covered = mask_coverage(pairs, "phage_id", "host_id", evidence_of(tables), coverage_metrics())
    levels = {"unique_left": "unique_phage", "unique_right": "unique_host", "pair": "pair"}
    covered = covered.replace(levels, subset=["entity_level"])
    sizes = covered.groupBy("entity_level").agg(F.max("denominator").alias("n"))
    names = F.create_map(*[F.lit(x) for kv in (("unique_phage", "unique_assay_phages"), ("unique_host", "unique_assay_hosts"), ("pair", "tested_spot_pairs")) for x in kv])
    sizes = sizes.select(
        names[F.col("entity_level")].alias("metric"), "entity_level", F.col("n").alias("numerator"), F.col("n").alias("assessed"), F.col("n").alias("denominator"),
        F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("coverage_fraction"), F.when(F.col("n") > 0, "assessed_positive").otherwise("not_assessed").alias("evidence_state"),
    )
    none = F.lit(None).cast("string")
    out = covered.unionByName(sizes).withColumn("phage_id", none).withColumn("panel_id", none)
    if breadth is None:
        return out
    positive, n = F.col("positive_host_count"), F.col("tested_host_count")
    rows = breadth.select(
        F.lit("spot_breadth_continuous").alias("metric"), F.lit("phage_panel").alias("entity_level"), positive.alias("numerator"), n.alias("assessed"), n.alias("denominator"),
        F.when(n > 0, positive / n).otherwise(0.0).alias("coverage_fraction"), F.when(n > 0, "descriptive_breadth_available").otherwise("not_assessed").alias("evidence_state"),
        "phage_id", "panel_id",
    )
    return out.unionByName(rows)
