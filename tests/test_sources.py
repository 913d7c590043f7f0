from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from evispark.sources.delimited import read_delimited, read_domtblout, read_json_map, read_optional, read_records, resolve_headers
from evispark.sources.files import file_digests
from evispark.sources.sequences import extract_cds, fasta_problems, read_fasta
from evispark.sources.sinks import commit_tables, shape, write_delimited


def test_scan_strips_cells_and_byte_order_mark(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("﻿id\tname\n1\t x \n\n2\t\"a\tb\"\n", encoding="utf-8")
    rows = read_delimited(spark, str(path), with_order=True).orderBy("_order").drop("_order")
    assert rows.columns == ["id", "name"]
    assert [tuple(r) for r in rows.collect()] == [("1", "x"), ("2", "a\tb")]


def test_order_follows_the_file_over_many_splits(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("n\n" + "\n".join(str(i) for i in range(5000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = read_delimited(spark, str(path), with_order=True).repartition(7)
        assert [int(r.n) for r in df.orderBy("_order").collect()] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_optional_table_gives_schema_and_issue(spark, tmp_path):
    rows, issues = read_optional(spark, str(tmp_path / "none.tsv"), ["a", "b"])
    assert rows.columns == ["a", "b"] and rows.isEmpty()
    assert issues.first().severity == "warning"
    assert read_optional(spark, None, ["a"])[1].first().severity == "info"


def test_explicit_header_map_rejects_unknown_targets(spark):
    df = spark.createDataFrame([(1,)], "`Entry Type` int")
    assert resolve_headers(df, {"record_type": ["entry_type"]}).columns == ["record_type"]
    with pytest.raises(ValueError):
        resolve_headers(df, {"record_type": []}, {"other": "Entry Type"})
    with pytest.raises(ValueError):
        resolve_headers(df, {"record_type": []}, {"record_type": "absent"})


def domtbl(target, target_acc, query, query_acc, start, end, description=""):
    fields = [target, target_acc, "300", query, query_acc, "200", "1e-20", "80", "0.1", "1", "1", "1e-22", "1e-21", "79", "0.1", "1", "90", str(start), str(end), "1", "99", "0.95"]
    return " ".join(fields) + (" " + description if description else "")


def test_profile_hits_in_both_directions(spark, tmp_path):
    path = tmp_path / "x.domtblout"
    path.write_text("# header\n" + domtbl("geneB", "-", "tail_dom", "PF00002", 20, 130) + "\nbroken line\n")
    hits, issues = read_domtblout(spark, str(path), "hmmsearch")
    row = hits.first()
    assert (row.annotation_gene_id, row.domain_id, row.domain_name, row.start_aa, row.end_aa) == ("geneB", "PF00002", "tail_dom", "20", "130")
    assert issues.count() == 1
    path.write_text(domtbl("spike_dom", "PF00003", "geneC", "-", 40, 160, "Tail spike domain") + "\n")
    row = read_domtblout(spark, str(path), "hmmscan")[0].first()
    assert (row.annotation_gene_id, row.domain_id, row.domain_name) == ("geneC", "PF00003", "Tail spike domain")


def test_records_with_and_without_header(spark, tmp_path):
    path = tmp_path / "hits"
    path.write_text("# c\ngeneD PDB:1ABC 0.73 88.5 1e-12\ngeneE short\n")
    fields = ["query", "target", "alntmscore", "prob", "evalue"]
    rows, issues = read_records(spark, str(path), fields, fields)
    assert [r.query for r in rows.collect()] == ["geneD"] and issues.count() == 1
    path.write_text("query\ttarget\ngeneF\tx y\n")
    rows, _ = read_records(spark, str(path), fields, fields)
    assert [(r.query, r.target) for r in rows.collect()] == [("geneF", "x y")]


def test_fasta_plain_and_compressed(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">one x\nACGT\n\nNN\n>two\nGG\n")
    with gzip.open(tmp_path / "b.fna.gz", "wt") as handle:
        handle.write("\n>three\nAC\nGT\n")
    (tmp_path / "bad.fna").write_text("ACGT\n>late\nAC\n")
    rows = {r.header: r.sequence for r in read_fasta(spark, str(tmp_path)).collect()}
    assert rows["one x"] == "ACGTNN" and rows["two"] == "GG" and rows["three"] == "ACGT"
    assert [r.path.rsplit("/", 1)[1] for r in fasta_problems(spark, str(tmp_path)).collect()] == ["bad.fna"]


def test_cds_features_over_several_lines(spark, tmp_path):
    pad = " " * 21
    text = (
        "LOCUS       X\nVERSION     X1.1\nFEATURES             Location/Qualifiers\n     source          1..900\n"
        f"     CDS             complement(join(10..50,\n{pad}60..90))\n{pad}/product=\"tail\n{pad}fiber\"\n{pad}/translation=\"MKV\n{pad}LL\"\n"
        f"     CDS             100..200\n{pad}/gene=\"g2\"\nORIGIN\n//\n"
    )
    (tmp_path / "x.gb").write_text(text)
    rows = extract_cds(spark, str(tmp_path / "x.gb")).orderBy("cds_no").collect()
    assert [(r.start, r.end, r.strand) for r in rows] == [(10, 90, "-"), (100, 200, "+")]
    assert rows[0].product == "tail fiber" and rows[0].protein_sequence == "MKVLL" and rows[0].gene_id == "X1.1_cds_00001"
    assert rows[1].product == "hypothetical protein" and rows[1].gene_id == "g2"
    window = spark.createDataFrame([("X1.1", 80, 150)], "contig_id string, region_start int, region_end int")
    assert sorted((r.start, r.end) for r in extract_cds(spark, str(tmp_path / "x.gb"), window).collect()) == [(1, 11), (21, 71)]


def test_json_object_of_lists(spark, tmp_path):
    (tmp_path / "l.json").write_text('{\n "h1": ["MKV", " NA ", "AA"],\n "h2": []\n}')
    rows = read_json_map(spark, str(tmp_path / "l.json")).orderBy("item_no").collect()
    assert [(r.id, r.item) for r in rows] == [("h1", "MKV"), ("h1", "AA")]


def test_sink_keeps_column_order_and_header_when_empty(spark, tmp_path):
    df = spark.createDataFrame([("1", "x")], "a string, extra string")
    assert shape(df, ["b", "a"]).first().asDict() == {"b": "", "a": "1"}
    write_delimited(df.limit(0), str(tmp_path / "o"), ["b", "a"])
    assert any(f.read_text() == "b\ta\n" for f in (tmp_path / "o").glob("part-*"))


def test_commit_is_all_or_nothing(spark, tmp_path):
    good, other = str(tmp_path / "good"), str(tmp_path / "other")
    one = spark.range(3)
    assert set(commit_tables({good: one, other: one})) == {good, other}
    failing = spark.range(5).select(F.raise_error(F.lit("boom")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        commit_tables({good: spark.range(9), other: failing})
    assert spark.read.parquet(good).count() == 3 and spark.read.parquet(other).count() == 3
    blocking = spark.createDataFrame([("error", "x")], "severity string, item string")
    with pytest.raises(ValueError):
        commit_tables({good: spark.range(9)}, issues=blocking)
    assert commit_tables({good: one.limit(0)}, keep_existing=True) == []
    assert spark.read.parquet(good).count() == 3
    with pytest.raises(ValueError):
        commit_tables({good: one, good + "/": one})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["good", "other"]


def test_every_file_has_its_own_header(spark, tmp_path):
    """Three files with different headers, one without, and a data row that equals its header."""
    (tmp_path / "a.tsv").write_text("# note\nid\tscore\nx1\t5\nid\tscore\n")
    (tmp_path / "b.tsv").write_text("score\tname\tid\n7\tn\tx2\n8\tx3\n")
    (tmp_path / "c.tsv").write_text("x4 9\n")
    records, issues = read_records(spark, str(tmp_path), ["id", "score"], ["ID"])
    assert records.columns == ["_order", "id", "score", "name"]
    assert sorted((r.id, r.score, r.name) for r in records.collect()) == [("id", "score", None), ("x1", "5", None), ("x2", "7", "n"), ("x4", "9", None)]
    assert [(r.line, r.message) for r in issues.collect()] == [("8\tx3", "expected 3 fields, observed 2")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.tsv").write_text("# nothing\n")
    records, issues = read_records(spark, str(tmp_path / "none"), ["id", "score"], ["id"])
    assert records.columns == ["_order", "id", "score"] and records.count() == issues.count() == 0


def test_a_commit_broken_off_anywhere_is_finished_or_taken_back(spark, tmp_path, monkeypatch):
    """Stop before every step that changes a file; the next call finds old or new tables, never both kinds."""
    from evispark.sources import files, sinks

    class Stopped(BaseException):
        """Like the end of the process: no handler of the commit runs on it."""

    def stopping_at(n):
        left = [n]

        def guard(real):
            def step(*args):
                if left[0] == 0:
                    raise Stopped
                left[0] -= 1
                return real(*args)

            return step

        for name in ("rename", "remove", "write_small"):
            monkeypatch.setattr(sinks, name, guard(getattr(files, name)))
        monkeypatch.setattr(files, "rename", guard(files.rename))

    outcomes = []
    for n in range(20):
        one, two = (str(tmp_path / f"run{n}" / x) for x in ("one", "two"))
        commit_tables({one: spark.range(1), two: spark.range(1)})
        real = files.rename
        stopping_at(n)
        try:
            commit_tables({one: spark.range(2), two: spark.range(2)})
            stopped = False
        except Stopped:
            stopped = True
        monkeypatch.undo()
        assert files.rename is real
        sinks.recover(spark, [one, two])
        counts = {spark.read.parquet(p).count() for p in (one, two)}
        assert len(counts) == 1
        outcomes.append(counts.pop())
        assert sorted(p.name for p in (tmp_path / f"run{n}").iterdir()) == ["one", "two"]
        if not stopped:
            break
    assert outcomes[0] == 1 and outcomes[-1] == 2 and outcomes == sorted(outcomes) and len(outcomes) > 6


def test_only_named_files_are_opened(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"abc" * 1000)
    hidden = tmp_path / "a" / "unnamed.txt"
    hidden.write_bytes(b"zzz")
    hidden.chmod(0)
    wanted = spark.createDataFrame([("a/x.txt",), ("a/x.txt",), ("a/none.txt",), (None,)], "path string")
    plan = file_digests(spark, str(tmp_path), wanted)
    assert "binaryFile" not in plan._jdf.queryExecution().toString()
    rows = plan.collect()
    assert [(r.path, r.observed_size, r.observed_sha256) for r in rows] == [("a/x.txt", 3000, hashlib.sha256(b"abc" * 1000).hexdigest())]
    assert file_digests(spark, f"file://{tmp_path}", wanted, chunk=7).first().observed_md5 == hashlib.md5(b"abc" * 1000).hexdigest()


def test_fallback_gene_numbers_count_the_window(spark, tmp_path):
    cds = "".join(f"     CDS             {a}..{a + 50}\n" for a in (100, 70_000, 140_000))
    (tmp_path / "y.gb").write_text(f"LOCUS       Y\nVERSION     Y1\nFEATURES             Location/Qualifiers\n{cds}ORIGIN\n//\n")
    windows = spark.createDataFrame([("Y1", 60_000, 200_000), ("Y1", 139_000, 141_000)], "contig_id string, region_start int, region_end int")
    rows = extract_cds(spark, str(tmp_path / "y.gb"), windows).collect()
    assert sorted((r.gene_id, r.start) for r in rows) == [("Y1_cds_00001", 1001), ("Y1_cds_00001", 10_001), ("Y1_cds_00002", 80_001)]
    assert sorted(r.gene_id for r in extract_cds(spark, str(tmp_path / "y.gb")).collect()) == [f"Y1_cds_0000{i}" for i in (1, 2, 3)]
