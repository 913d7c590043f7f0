"""The pipeline and the queries of this folder."""

from __future__ import annotations

import hashlib
import re
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare, connect

import corpus_pipeline
from evispark.llm import quality
from evispark.llm.queries import QUERIES
from llm.test_dedup import LOWER, near_classes

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_queries_match_their_sql(spark, docs, name):
    query, sql = QUERIES[name]
    same, said = compare(spark, connect(SF), SF, query, sql)
    assert same, said


def test_stages_match_brute_force(spark, docs):
    """Each stage on what the one before it wrote."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    columns = given.columns
    table, rows = given, [tuple(r) for r in given.collect()]
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(stage(spark, table, SF))
        outputs.append([tuple(r) for r in made.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == columns
        table = made
    judged, exact, near, mixed, tokens = outputs
    network = quality.train(given, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score_texts(given, network).collect()}
    assert sorted(judged) == sorted(r for r in rows if scores[r[0]] >= 0.5)
    best = {}
    for r in judged:
        key = (r[1] or "").translate(LOWER)
        best[key] = max(best.get(key, r[0]), r[0])
    assert sorted(exact) == sorted(r for r in judged if best[(r[1] or "").translate(LOWER)] == r[0])
    exact = sorted(exact)
    classes = near_classes([r[1] for r in exact])
    assert sorted(near) == [r for i, r in enumerate(exact) if classes[i] == i]
    assert set(mixed) <= set(near) and all(mixed.count(r) <= 3 for r in set(mixed))
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rs)
    assert 0.9 * words(near) <= words(mixed) <= words(near)
    texts = sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in mixed)
    assert sorted((r[0], r[5]) for r in tokens) == texts and all(r[6] for r in tokens)


def test_run_gives_what_the_stages_give(spark, docs):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_entry_works_without_the_folder(tmp_path):
    """Without the folder and the pipeline the other queries are still there."""
    for item in ("evispark", "__spark_entry__.py"):
        (tmp_path / item).symlink_to(ROOT / item) if item.endswith(".py") else subprocess.run(["cp", "-r", str(ROOT / item), str(tmp_path / item)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "evispark/llm")], check=True)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op4') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split()[-1] == "False", said.stderr
