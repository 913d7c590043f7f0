"""Order-dependent operators give the same results whatever the number of ranges and the size of a group."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evispark.functions.numbers import strict_number, to_double
from evispark.operators.aggregates import architecture, architecture_labels, architecture_text, locus_support, packed_lists
from evispark.operators.gates import eligible
from evispark.operators.graph import connected_components
from evispark.operators.intervals import merged_length
from evispark.operators.joins import last_rows
from evispark.operators.scan import Segments, range_count
from evispark.operators.scoring import hit_evidence
from evispark.operators.windows import group_counter, neighbor_context, ordinal_id, positions, previous_value, running_last


def skewed(spark, n=400, seed=3):
    """Most rows share one key."""
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(6)}", i, rng.choice([None, "a", "b"]), f"item {rng.randrange(40)}") for i in range(n)]
    return spark.createDataFrame(rows, "k string, i int, v string, name string")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_positions_count_each_group(spark):
    df = skewed(spark)
    got = rows(positions(df, ["k"], ["i"]), "k", "i", "_pos")
    want, seen = [], {}
    for k, i in sorted(((r.k, r.i) for r in df.collect()), key=lambda x: x[1]):
        want.append((k, i, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    assert got == sorted(want, key=repr)


def test_ordinals_are_dense_and_not_cut(spark):
    df = spark.range(1200).select((F.col("id") * 7 % 1201).alias("x"))
    out = ordinal_id(df, ["x"], "n", 3).orderBy("x").collect()
    assert out[0].id == "n001" and out[-1].id == "n1200" and len({r.id for r in out}) == 1200


def test_neighbors_previous_running_and_counters(spark):
    df = skewed(spark)
    args = ("k", ["i"], F.col("name"), F.col("name"), "item 1$")
    for limit in (5, 60):
        assert rows(neighbor_context(df, *args, ranges=limit), "i", "neighbor_context", "has_context") == rows(
            neighbor_context(df, *args, ranges=1), "i", "neighbor_context", "has_context"
        )
        nullable = df.withColumn("k", F.when(F.col("k") != "k1", F.col("k")))
        assert rows(previous_value(nullable, "k", "i", "i", "p", ranges=limit), "i", "p") == rows(previous_value(nullable, "k", "i", "i", "p", ranges=1), "i", "p")
        assert rows(running_last(df, ["k"], "i", ["v"], ranges=limit), "i", "running_v") == rows(running_last(df, ["k"], "i", ["v"], ranges=1), "i", "running_v")
        assert rows(group_counter(df, ["k"], ["i"], ranges=limit), "i", "counter") == rows(group_counter(df, ["k"], ["i"], ranges=1), "i", "counter")


def test_packed_lists_are_whole(spark):
    df = skewed(spark)
    pieces = packed_lists(df, ["k"], "i", limit=20).orderBy("k", "piece").collect()
    assert max(p.item_count for p in pieces) <= 20
    joined = {}
    for p in pieces:
        joined.setdefault(p.k, []).extend(p["items"])
    whole = {p.k: p["items"] for p in packed_lists(df, ["k"], "i").collect()}
    assert joined == whole and len(pieces) > len(whole)


def test_merged_length_against_sets(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.6 else "cold", rng.randrange(500), rng.randrange(500)) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, s int, e int")
    want = {}
    for k, s, e in data:
        want.setdefault(k, set()).update(range(min(s, e), max(s, e) + 1))
    want = {k: len(v) for k, v in want.items()}
    for ranges in (1, 9, 40):
        assert {r.k: r.merged_length for r in merged_length(df, ["k"], "s", "e", ranges=ranges).collect()} == want


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(11)
    nodes = [f"n{i:04d}" for i in range(600)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(260)]
    edges += [("n0300", f"n{i:04d}") for i in range(400, 520)]  # a hub
    edges += [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(540, 598)]  # a chain
    got = connected_components(
        spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")
    )
    assert {r.id: r.component for r in got.collect()} == components(nodes, edges)
    alone = connected_components(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "src string, dst string"))
    assert alone.first().component == "a"


def test_null_keys_stay_in_any_number_of_ranges(spark):
    df = skewed(spark).withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    spans = df.select("k", (F.col("i") * 7 % 300).alias("s"), (F.col("i") * 7 % 300 + F.col("i") % 9).alias("e"))
    want_length = rows(merged_length(spans, ["k"], "s", "e"), "k", "merged_length")
    want_running = rows(running_last(df, ["k"], "i", ["v"]), "i", "running_v")
    assert any(k is None for k, _ in want_length)
    for ranges in (2, 7, 30):
        assert rows(merged_length(spans, ["k"], "s", "e", ranges=ranges), "k", "merged_length") == want_length
        assert rows(running_last(df, ["k"], "i", ["v"], ranges=ranges), "i", "running_v") == want_running


def test_scans_equal_loops(spark):
    """Every scan against a loop over the sorted rows, with null keys, one hot key, more ranges than rows, and none at all."""
    df = skewed(spark, 120).withColumn("k", F.when(F.col("k") != "k2", F.col("k")))
    given = sorted(df.collect(), key=lambda r: r.i)
    groups = {}
    for r in given:
        groups.setdefault(r.k, []).append(r)
    want = {"pos": {}, "previous": {}, "running": {}, "near": {}}
    for k, members in groups.items():
        last = None
        for n, r in enumerate(members):
            want["pos"][r.i] = n
            want["previous"][r.i] = members[n - 1].v if n and k is not None else None
            last = r.v if r.v is not None else last
            want["running"][r.i] = last
            want["near"][r.i] = [x.name for x in members[max(0, n - 3) : n] + members[n + 1 : n + 4]]
    for ranges in (1, 4, 50, 300):
        assert {r.i: r["_pos"] for r in positions(df, ["k"], ["i"], ranges=ranges).collect()} == want["pos"]
        assert {r.i: r.p for r in previous_value(df, "k", "i", "v", "p", ranges=ranges).collect()} == want["previous"]
        assert {r.i: r.running_v for r in running_last(df, ["k"], "i", ["v"], ranges=ranges).collect()} == want["running"]
        near = neighbor_context(df, "k", ["i"], F.col("name"), F.col("name"), "item 1$", k=3, ranges=ranges).collect()
        assert {r.i: r.neighbor_labels for r in near} == want["near"]
        assert all(r.has_context == ("item 1" in want["near"][r.i]) for r in near)
        assert sorted(r["_pos"] for r in positions(df, [], ["i"], ranges=ranges).collect()) == list(range(120))
    for scan in (positions(df.limit(0), ["k"], ["i"]), running_last(df.limit(0), ["k"], "i", ["v"]), positions(df.limit(0), [], ["i"])):
        assert scan.count() == 0


def test_carries_are_bounded_by_the_ranges(spark):
    """However many groups there are, only those at the edges of a range are summarised."""
    df = spark.range(5_000).select((F.col("id") / 2).cast("int").alias("k"), F.col("id").alias("i"))
    segments = Segments(df, ["k"], ["i"], 8)
    assert segments.carries({"n": F.count("*")}, {"n": F.col("n")}).count() <= 16
    assert range_count(spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")) > range_count(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")) == 1


def test_entities_have_one_row_of_facts(spark):
    items = spark.createDataFrame([(1, x) for x in "aabcdefg"] + [(2, x) for x in "gfedcbaa"] + [(None, "a"), (3, "a")], "k int, item string")
    got = {r.k: r for r in locus_support(items, "k", "item").collect()}
    assert {k: (r.locus_protein_count, r.locus_protein_count_bin) for k, r in got.items()} == {1: (8, "2plus"), 2: (8, "2plus"), None: (1, "1"), 3: (1, "1")}
    assert got[1].locus_fingerprint_sha256 == got[2].locus_fingerprint_sha256 != got[3].locus_fingerprint_sha256
    domains = spark.createDataFrame([("g", f"d{i}", f"n{i}", i, "t") for i in range(30)], "annotation_gene_id string, domain_id string, domain_name string, start_aa int, evidence_source string")
    assert architecture(domains).count() == 1 and architecture_labels(domains).count() == 30
    assert architecture_text(domains).first().domain_architecture == "|".join(f"n{i}" for i in range(30))
    hits = hit_evidence(domains, "annotation_gene_id", "domain_id", "domain_name", "domain", ["start_aa"]).first()
    assert hits.domain_hit_count == 30 and hits.domain_hit.count(";") == 29


def test_repeated_lookup_rows_do_not_multiply(spark):
    dim = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "id string, v string, row_number int")
    assert {tuple(r) for r in last_rows(dim, "id", ["v"]).collect()} == {("a", "y"), ("b", "z")}
    assert {tuple(r) for r in last_rows(dim.drop("row_number"), "id", ["v"]).collect()} == {("a", "y"), ("b", "z")}
    manifest = spark.createDataFrame([("a", "phage", "pass")], "genome_id string, record_type string, validation_status string")
    qc = spark.createDataFrame([("a", "bad", False, 1), ("a", "good", True, 2)], "genome_id string, sequence_qc_status string, passes_sequence_qc boolean, row_number int")
    assert [r.sequence_qc_status for r in eligible(manifest, qc, ["phage"]).collect()] == ["good"]


def test_numbers_with_type_suffixes_are_no_numbers(spark):
    texts = ["12", "12d", "3f", " 1.5e3 ", ".5", "5.", "0x1", "nan", "inf", "", None, "1 2", "+7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_double("t").alias("n"), strict_number("t")["problem"].alias("p"))
    got = {r.t: (None if r.n is None or r.n != r.n or r.n == float("inf") else r.n, r.p) for r in df.collect()}
    assert {t: n for t, (n, _) in got.items()} == {t: {"12": 12.0, " 1.5e3 ": 1500.0, ".5": 0.5, "5.": 5.0, "+7": 7.0}.get(t) for t in texts}
    assert got["12d"][1] == got["3f"][1] == got["0x1"][1] == "not_numeric" and got["nan"][1] == got["inf"][1] == "non_finite"


def test_tasks_follow_the_input(spark, monkeypatch, tmp_path):
    """Requirement rows and packed lists are dealt to as many tasks as the input asks for, whatever the shuffle setting."""
    from evispark.operators import readiness, scan

    needs = [(f"C{i % 7}", f"P{i % 50}", "optional" if i % 3 else "required") for i in range(350)]
    spark.createDataFrame([(f"P{i}", i % 2 == 0) for i in range(40)], "item string, ready boolean").write.parquet(f"{tmp_path}/status")
    spark.createDataFrame(sorted(set(needs)), "goal string, item string, role string").write.parquet(f"{tmp_path}/needs")
    table, status = spark.read.parquet(f"{tmp_path}/needs"), spark.read.parquet(f"{tmp_path}/status")
    monkeypatch.setattr(scan, "RANGE_BYTES", 200)
    tasks = scan.range_count(table)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = readiness.unlock_lists(table, status)
    assert lists.rdd.getNumPartitions() >= tasks
    want = {}
    for goal, item, role in set(needs):
        want.setdefault((goal, role, item[1:].isdigit() and int(item[1:]) < 40 and int(item[1:]) % 2 == 0), []).append(item)
    assert {(r.goal, r.role, r.ready): r["items"] for r in lists.collect()} == {k: sorted(v) for k, v in want.items()}
    monkeypatch.setattr("evispark.operators.scan.cut_lineage", None)  # counts write no table
    assert readiness.unlock(table, status).count() == 7


def test_assay_repeats_sort_narrow_rows(spark, monkeypatch):
    """Notes and results of an assay are not sorted to find repeats, and every repeat names the row before it."""
    from evispark.functions import rules as R
    from evispark.operators import scan, validation

    columns = sorted({*R.ASSAY_REQUIRED, *R.RESULT_COLUMNS, "study_id", "panel_id", "outcome_tier", "evidence_tier", "eop", "eop_reference_host", "moi", "temperature_c", "replicate_count", "notes"})
    rows = [(i, *["I0" if c == "interaction_id" else f"p{i % 2}" if c == "panel_id" else "x" for c in columns]) for i in range(6)]
    frame = spark.createDataFrame(rows, ["row_number", *columns])
    staged, write = [], scan.cut_lineage
    monkeypatch.setattr(scan, "cut_lineage", lambda df: staged.append(df.columns) or write(df))
    issues = validation.validate_assays(frame, None, None).filter("check_id LIKE 'duplicate%'").collect()
    assert staged and all(len(c) <= 5 for c in staged)
    said = {(r.row_number, r.check_id): int(r.message.split()[-1]) for r in issues}
    want = {(i, "duplicate_interaction_id"): i - 1 for i in range(1, 6)} | {(i, "duplicate_study_panel_assay"): i - 2 for i in range(2, 6)}
    assert said == want
