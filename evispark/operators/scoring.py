"""Candidate scoring from weighted evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evispark.functions import rules as R
from evispark.functions.missing import present, text
from evispark.functions.numbers import to_int_or
from evispark.functions.text import matches
from evispark.operators.aggregates import distinct_text
from evispark.operators.joins import lookup_left
from evispark.operators.validation import once
from evispark.operators.windows import has_neighbor, neighbor_context, ordinal_id
from evispark.session import Scratch

HIT_PATTERNS = {
    "support": R.SUPPORT_PATTERN,
    "depolymerase": R.DEPOLYMERASE_PATTERN,
    "spike": R.SPIKE_PATTERN,
    "fiber": r"tail ?fiber|fiber",
    "baseplate": r"baseplate",
}


def hit_rows(hits: DataFrame, key: str, hit_id: str, hit_name: str) -> DataFrame:
    """The usable hits with their label, one row each: the whole list of every gene."""
    label = F.when(present(hit_id), F.concat(text(hit_id), F.lit(":"), text(hit_name))).otherwise(text(hit_name))
    return hits.filter(present(key) & (present(hit_id) | present(hit_name))).withColumn("_label", label)


def hit_evidence(hits: DataFrame, key: str, hit_id: str, hit_name: str, prefix: str, order: Sequence[str]) -> DataFrame:
    """One row per gene: the text of all its hits in order, their number, and which patterns one of them holds.

    Flags are maxima over the hits. The text is a cell for sinks and holds every hit; ``hit_rows`` has them as rows.
    """
    item = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], "_label")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_label"])
    return hit_rows(hits, key, hit_id, hit_name).groupBy(key).agg(
        F.array_join(listed, ";").alias(f"{prefix}_hit"),
        F.count("*").alias(f"{prefix}_hit_count"),
        *[F.max(matches("_label", p)).alias(f"_{prefix}_{n}") for n, p in HIT_PATTERNS.items()],
    )


def sequence_evidence() -> Column:
    """strong, weak or no sequence hit, from the family id, the cluster source and the product."""
    told = present("product")
    return (
        F.when(present("phrog_id"), "strong_sequence_hit")
        .when((text("_cluster_source") == "product") & told, "weak_sequence_hit")
        .when(told & ~matches("product", R.UNINFORMATIVE_PRODUCT), "weak_sequence_hit")
        .otherwise("no_sequence_hit")
    )


def enzyme_class(flag: Mapping[str, Column]) -> Column:
    return (
        F.when(flag["depolymerase"] & flag["spike"], "capsule_depolymerase_tailspike")
        .when(flag["depolymerase"], "putative_depolymerase")
        .when(flag["fiber"], "tail_fiber_receptor_binding_protein")
        .when(flag["spike"], "tailspike_receptor_binding_protein")
        .when(flag["baseplate"], "baseplate_receptor_binding_candidate")
        .otherwise("receptor_binding_candidate")
    )


def weighted_score(found: Sequence[tuple[str, Column]], weights: Mapping[str, float]) -> Column:
    """Sum of the weights of the evidence found, in the order given, at most one."""
    total = F.lit(0.0)
    for name, hit in found:
        total = total + F.when(hit, F.lit(float(weights.get(name, 0.0)))).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


#: What scoring reads of a candidate, besides the columns it shows.
EVIDENCE = (
    "_rbp", "_depolymerase", "_hint", "_domain_support", "_structural_support", "_len", "sequence_strength", "domain_hit", "structural_hit",
)


def candidate_evidence(
    annotations: DataFrame, gene_clusters: DataFrame, domain_flags: DataFrame | None = None, structure_flags: DataFrame | None = None
) -> DataFrame:
    """Every gene with what its texts, its cluster and its hits say; ``_candidate`` marks the candidates. No neighbour is looked at.

    ``gene_clusters``: ``gene_cluster_id, gene_cluster_source, representative_product, phrog_category, functional_category,
    module_hint``; it is looked up by ``gene_cluster_key`` where ``annotations`` have no ``gene_cluster_id`` yet, so that they meet it once. The
    flags come from ``hit_evidence``. Texts are searched and numbers parsed once a gene.
    """
    key = "annotation_gene_id"
    by = "gene_cluster_id" if "gene_cluster_id" in annotations.columns else "gene_cluster_key"
    clusters = gene_clusters.select(
        *dict.fromkeys([by, "gene_cluster_id"]),
        F.col("gene_cluster_source").alias("_cluster_source"),
        F.col("module_hint").alias("_cluster_hint"),
        F.concat_ws(" ", *[text(c) for c in ("representative_product", "phrog_category", "functional_category", "module_hint")]).alias("_cluster_text"),
    )
    df = lookup_left(annotations, clusters, by)
    for prefix, flags in (("domain", domain_flags), ("structural", structure_flags)):
        if flags is not None:
            df = df.join(flags, key, "left")
        else:
            df = df.withColumn(f"{prefix}_hit", F.lit(None).cast("string")).withColumn(f"{prefix}_hit_count", F.lit(0).cast("bigint"))
            for n in HIT_PATTERNS:
                df = df.withColumn(f"_{prefix}_{n}", F.lit(False))
        df = df.withColumn(f"{prefix}_hit", F.coalesce(f"{prefix}_hit", F.lit("")))
        for n in HIT_PATTERNS:
            df = df.withColumn(f"_{prefix}_{n}", F.coalesce(f"_{prefix}_{n}", F.lit(False)))
    words = F.concat_ws(
        " ", text("product"), text("phrog_category"), text("functional_category"), text("module_hint"), F.col("_cluster_text")
    )
    domain, structure = F.col("_domain_support"), F.col("_structural_support")
    hint = (text("module_hint") == "rbp_depolymerase") | (text("_cluster_hint") == "rbp_depolymerase")
    # What excludes a gene is looked for first, and only in the others what makes a candidate.
    df = once(df, {"_text": words, "_open": ~matches("product", R.EXCLUSION_PATTERN) | domain | structure})
    df = once(df, {"_rbp": F.col("_open") & matches("_text", R.RBP_PATTERN), "_depolymerase": F.col("_open") & matches("_text", R.DEPOLYMERASE_PATTERN), "_hint": hint})
    chosen = F.col("_open") & (F.col("_rbp") | F.col("_depolymerase") | domain | structure | F.col("_hint"))
    flag = {
        n: (F.col("_depolymerase") if n == "depolymerase" else matches("_text", p)) | F.col(f"_domain_{n}") | F.col(f"_structural_{n}")
        for n, p in HIT_PATTERNS.items()
        if n != "support"
    }
    strength = F.col("sequence_strength")
    hit_text = (
        F.when(present("phrog_id"), F.concat(F.col("phrog_id"), F.lit(":"), F.coalesce(F.nullif(text("product"), F.lit("")), text("functional_category"))))
        .when(strength == "weak_sequence_hit", F.concat(F.lit("product:"), text("product")))
        .otherwise("")
    )
    df = df.withColumn("_candidate", chosen).withColumn("_len", to_int_or("protein_length_aa", 0)).withColumn("sequence_strength", sequence_evidence())
    df = df.withColumn("sequence_hit", hit_text).withColumn("predicted_enzyme_class", enzyme_class(flag))
    lost = [f"_{p}_{n}" for p in ("domain", "structural") for n in HIT_PATTERNS if n != "support"]
    return df.drop(*lost, "_text", "_open", "_cluster_source", "_cluster_hint", "_cluster_text")


def score_candidates(
    evidence: DataFrame, weights: Mapping[str, float] = R.CANDIDATE_WEIGHTS, thresholds: Mapping[str, float | bool] = R.CANDIDATE_THRESHOLDS
) -> DataFrame:
    """Candidate genes with score, confidence and novelty, from ``candidate_evidence`` with ``has_context``."""
    df = evidence.filter("_candidate")
    minimum = int(thresholds["min_protein_length_aa"])
    domain, structure = F.col("_domain_support"), F.col("_structural_support")
    context = F.col("has_context")
    short = (F.col("_len") != 0) & (F.col("_len") < minimum)
    found = [
        ("rbp_keyword", F.col("_rbp")),
        ("depolymerase_keyword", F.col("_depolymerase")),
        ("annotation_module_hint", F.col("_hint")),
        ("sequence_hit", F.col("sequence_strength") == "strong_sequence_hit"),
        ("weak_sequence_hit", F.col("sequence_strength") == "weak_sequence_hit"),
        ("domain_support", domain),
        ("domain_present", ~domain & (F.col("domain_hit") != "")),
        ("structural_support", structure),
        ("structural_hit", ~structure & (F.col("structural_hit") != "")),
        ("tail_synteny_context", context),
        ("length_support", (F.col("_len") != 0) & (F.col("_len") >= minimum)),
        ("short_protein", short),
    ]
    high_at, medium_at = float(thresholds["high_confidence_score"]), float(thresholds["medium_confidence_score"])
    synteny_free = F.lit(not thresholds["require_synteny_for_high_confidence"])
    strength = F.col("sequence_strength")
    supported = domain | structure
    tier = (
        F.when((strength == "no_sequence_hit") & supported, "tier_1")
        .when((strength != "strong_sequence_hit") & (supported | context), "tier_2")
        .when(strength == "strong_sequence_hit", "tier_3")
        .otherwise("insufficient_novelty_evidence")
    )
    rationale = (
        F.when(F.col("novelty_tier") == "tier_1", "no sequence-level hit but domain or structural support is present")
        .when(F.col("novelty_tier") == "tier_2", "weak sequence-level evidence with domain, structural, or synteny support")
        .when(F.col("novelty_tier") == "tier_3", "known or sequence-clustered RBP/depolymerase family candidate")
        .otherwise("candidate is driven by annotation text without enough independent novelty evidence")
    )
    named = F.array_compact(F.array(*[F.when(hit, F.lit(n)) for n, hit in found]))
    out = (
        df.withColumn("confidence_score", weighted_score(found, weights))
        .withColumn("is_high_confidence", (F.col("confidence_score") >= high_at) & (context | synteny_free))
        .withColumn(
            "confidence_label",
            F.when(F.col("is_high_confidence"), "high").when(F.col("confidence_score") >= medium_at, "medium").otherwise("low"),
        )
        .withColumn("novelty_tier", tier)
        .withColumn("novelty_rationale", rationale)
        .withColumn("evidence_types", F.when(F.size(named) == 0, "none").otherwise(F.array_join(named, ";")))
        .withColumn("notes", F.when(short, "shorter than configured minimum length").otherwise("OK"))
        .withColumn("confidence_score", F.round("confidence_score", 3))
    )
    return out.drop("_candidate", *[c for c in EVIDENCE if c.startswith("_")])


def novel_subset(candidates: DataFrame, medium: float = R.CANDIDATE_THRESHOLDS["medium_confidence_score"]) -> DataFrame:
    return candidates.filter(F.col("novelty_tier").isin("tier_1", "tier_2") & (F.col("confidence_score") >= medium))


def module_members(candidates: DataFrame) -> DataFrame:
    """Candidates with their module id. A module is a gene cluster, else an enzyme class, else the candidate itself."""
    key = F.coalesce(
        F.nullif(text("gene_cluster_id"), F.lit("")), F.nullif(text("predicted_enzyme_class"), F.lit("")), F.col("candidate_id")
    )
    keyed = candidates.withColumn("module_key", key)
    ids = ordinal_id(keyed.select("module_key").distinct(), ["module_key"], "rbp_module_", 6, "module_cluster_id")
    return keyed.drop("module_cluster_id").join(ids, "module_key")


def module_table(members: DataFrame) -> DataFrame:
    """One row per module of ``module_members``. Member lists come from ``packed_lists`` on its table."""
    by = ["module_cluster_id"]
    facts = members.groupBy("module_cluster_id", "module_key").agg(
        F.count("*").alias("candidate_count"),
        F.countDistinct("genome_id").alias("genome_count"),
        F.countDistinct(F.when(present("species_cluster_id"), F.col("species_cluster_id"))).alias("species_cluster_count"),
        F.max("confidence_score").alias("max_confidence_score"),
        F.min_by("product", "candidate_id").alias("representative_product"),
    )
    exploded = members.select("module_cluster_id", F.explode(F.split("evidence_types", ";")).alias("evidence"))
    return (
        facts.join(distinct_text(members, by, "predicted_enzyme_class", "predicted_enzyme_classes"), by, "left")
        .join(distinct_text(exploded, by, "evidence", "evidence_types"), by, "left")
        .join(distinct_text(members, by, "novelty_tier", "novelty_tiers"), by, "left")
    )


def module_clusters(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with their module id, and one row per module."""
    members = module_members(candidates)
    return members, module_table(members)


#: The order of the genes of a genome.
PLACE = ["_start", "_end", "annotation_gene_id"]


def placed(annotations: DataFrame) -> DataFrame:
    """Add ``_start`` and ``_end`` as numbers; a gene without them comes last."""
    return once(annotations, {f"_{c}": to_int_or(c, 10**9) for c in ("start", "end")})


def _searched() -> Column:
    return F.concat_ws(" ", text("product"), text("module_hint"))


def with_context(annotations: DataFrame, ranges: int | None = None) -> DataFrame:
    """Neighbour labels and tail context of every gene in its genome."""
    label = F.trim(F.concat_ws(":", text("gene_id"), text("module_hint"), text("product")), F.lit(":"))
    return neighbor_context(placed(annotations), "genome_id", PLACE, label, _searched(), R.TAIL_CONTEXT_PATTERN, ranges=ranges).drop("_start", "_end")


def candidate_context(evidence: DataFrame, shown: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``candidate_evidence`` with ``has_context`` and the ``shown`` columns.

    A gene that is no candidate is only a neighbour: of it nothing moves but its place and whether its texts hold the pattern.
    """
    kept = [c for c in evidence.columns if c in (*EVIDENCE, *shown) and c not in ("genome_id", *PLACE)]
    found = once(evidence, {"_hit": matches(_searched(), R.TAIL_CONTEXT_PATTERN)})
    own = [F.when(F.col("_candidate"), F.col(c)).alias(c) for c in kept]
    # Written before it is put in ranges, which reads it twice and writes it again.
    with Scratch(evidence.sparkSession) as scratch:
        rows = scratch.table(placed(found).select("genome_id", *PLACE, "_hit", "_candidate", *own))
        return has_neighbor(rows, "genome_id", PLACE, "_hit", ranges=ranges).drop("_hit")
