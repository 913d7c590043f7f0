"""Small tables with every odd row the operators must take."""

from __future__ import annotations

import random

import pytest

LONG = " ".join(f"wort{i % 977}é" for i in range(40_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, tokens string, kept boolean"


def odd_documents() -> list[tuple]:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["naïve", "漢字", "it's", "a.b", "x y", "İ", "É"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    passage = text(60)
    texts = [
        base, base, " ".join(near), base.upper(), "", None, "   \t\n ", "one", "one two  three", LONG, LONG + " end",
        text(40) + " " + passage, passage + " " + text(50), text(20) + "\n" + passage + "\r\n" + text(5), "<|endoftext|> a <|endoftext|>",
        "word " * 60, "\U0001f642\U0001f642 tail'll   run  \n\n x", "### " * 30, text(13), text(12),
    ]
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, None, 1.5, "clash", True) for i, t in enumerate(texts)]
    rows.append((3, texts[3], None, "src0", 1, None, None, None))  # a row that repeats id and text
    rows.append((3, text(30), None, "src0", 1, None, None, None))  # an id with another text
    rows.append((None, texts[0], None, None, None, None, None, None))
    rows.append((None, "only without id " * 5, None, "src1", None, None, None, None))
    rows += [(100 + i, text(rng.randrange(1, 90)), "en", "src1", None, None, None, None) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def unique_docs(docs):
    """The same without rows that repeat an id or lack one."""
    return docs.filter("doc_id IS NOT NULL AND doc_id <> 3")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
