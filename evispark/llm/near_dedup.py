"""MinHash near-dedup with DartMinHash signatures.

A document is the set of its shingles of five words, optionally with weights. Every element owns a plane of weight by
rank on which hashed darts lie with density one. A document sees the darts under its elements' weights; those below a
rank of about (k ln k + 2k) / total weight are generated, each belongs to one of k coordinates, and a coordinate keeps
its earliest dart. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity. The
cost is one cell per element plus a number of darts that does not depend on the document's length.

Signatures are cut into bands; texts that share a band are candidates, and candidates are compared exactly. A band's
texts are compared with the band's first text. In a band that then holds several classes all texts are compared in
tasks of bounded size, which return a spanning forest of links between classes, never pairs. Links become classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evispark.llm.scratch import Scratch, written
from evispark.llm.ship import give_back, kept_tables, with_code
from evispark.llm.words import mix, shingles, slices, text_bytes, word_hashes
from evispark.operators.graph import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**5) ** 32 = 3e-6.
BANDS, ROWS = 32, 5
SLICE_BYTES = 1 << 20
#: Texts and shingles of a block of a band; a task compares one or two blocks.
GROUP_TEXTS, GROUP_SHINGLES = 1_000, 2 << 20
#: Shingles whose texts are multiplied at a time.
PRODUCT_COLUMNS = 2_048
EMPTY = np.uint64(np.iinfo(np.uint64).max)
_CELL = np.uint64(0xA0761D6478BD642F)
_COPY = np.uint64(0xE7037ED1A0B428DB)
_DART = np.uint64(0x8EBC6AF09C88C6E3)
#: Bits after the point of a dart's rank.
_POINT = 40

SKETCH = "doc_id long, text_hash long, digest binary, bands array<long>"
SHINGLED = "node long, shingles array<long>"


def _poisson_marks() -> np.ndarray:
    """64-bit thresholds: a cell whose hash reaches the i-th mark has more than i darts (Poisson with mean one)."""
    below, term, marks = 0.0, math.exp(-1), []
    for i in range(18):
        below += term
        term /= i + 1
        marks.append(min(int(below * 2**64), 2**64 - 1))
    return np.asarray(marks, np.uint64)


_MARKS = _poisson_marks()
_SALTS = np.arange(1, len(_MARKS) + 1, dtype=np.uint64) * _DART


def dart_signatures(value: np.ndarray, row: np.ndarray, rows: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """The DartMinHash of each of ``rows`` sets: a (rows, k) array of dart ranks, ``EMPTY`` throughout for an empty set.

    ``value`` holds element hashes, ``row`` the set of each, ``weight`` positive weights (one if absent). An element
    given twice with equal weight counts once.
    """
    if weight is not None:  # unit cells along the weight axis; the last one may be cut
        cells = np.maximum(1, np.ceil(weight)).astype(np.int64)
        at = np.repeat(np.arange(len(value)), cells)
        step = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        value, row, room = mix(value[at] + step.astype(np.uint64) * _COPY), row[at], weight[at] - step
        total = np.bincount(row, np.minimum(room, 1.0), rows)
    else:
        room = None
        total = np.bincount(row, minlength=rows).astype(float)
    signature = np.full(rows * k, EMPTY, np.uint64)
    some = total > 0
    reach = np.where(some, (k * math.log(k) + 2 * k) / np.where(some, total, 1), 0.0)
    begin, todo = np.zeros(rows), some
    while todo.any():
        low, high = np.floor(begin).astype(np.int64), np.ceil(reach).astype(np.int64)
        pick = np.flatnonzero(todo[row])
        _throw(value[pick], row[pick], None if room is None else room[pick], low, high, reach, k, signature)
        todo = some & (signature.reshape(rows, k) == EMPTY).any(axis=1)
        begin, reach = np.where(todo, reach, begin), np.where(todo, 2 * reach, reach)
    return signature.reshape(rows, k)


def _throw(value, row, room, low, high, reach, k, signature) -> None:
    """Throw the darts of the rank cells low to high and keep the earliest in each coordinate."""
    cells = (high - low)[row]
    at = np.repeat(np.arange(len(value)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells) + low[row][at]
    base = mix(value[at] + cell.astype(np.uint64) * _CELL)
    row, cell = row[at], cell.astype(np.uint64) << np.uint64(_POINT)
    room = None if room is None else room[at]
    limit = (reach * 2.0**_POINT).astype(np.uint64)
    live = np.arange(len(base))
    for i, mark in enumerate(_MARKS):
        live = live[base[live] >= mark]
        if not len(live):
            return
        dart = mix(base[live] ^ _SALTS[i])
        rank = cell[live] | (dart >> np.uint64(64 - _POINT))
        coordinate = ((dart & np.uint64(0xFFFFFF)) * np.uint64(k)) >> np.uint64(24)
        ok = rank < limit[row[live]]
        if room is not None:
            ok &= (mix(dart) >> np.uint64(11)) * 2.0**-53 < room[live]
        np.minimum.at(signature, row[live][ok] * k + coordinate[ok].astype(np.int64), rank[ok])


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)


def text_digest(text: str) -> bytes:
    """16 bytes that are equal for texts of equal words."""
    return hashlib.blake2b(b" ".join(text.encode().split()), digest_size=16).digest()


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))


def _sketch(words: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_tables("near-dedup")
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for first, last in slices(offsets, SLICE_BYTES):
                part = data[offsets[first] : offsets[last]]
                hashes, counts = word_hashes(part, offsets[first : last + 1] - offsets[first])
                value, row = shingles(hashes, counts, words)
                n = np.bincount(row, minlength=last - first)
                keys = band_keys(dart_signatures(value, row, last - first, bands * rows), bands, rows)
                keys = keys[n > 0].ravel()
                texts = batch.column(1).slice(first, last - first).fill_null("").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(2).slice(first, last - first),
                        pa.array([text_digest(t) for t in texts], pa.binary()),
                        _lists(keys, np.where(n > 0, bands, 0)),
                    ],
                    ["doc_id", "text_hash", "digest", "bands"],
                )
        give_back()

    return sketch


def _shingle_sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for first, last in slices(offsets, SLICE_BYTES):
                part = data[offsets[first] : offsets[last]]
                hashes, counts = word_hashes(part, offsets[first : last + 1] - offsets[first])
                value, row = shingles(hashes, counts, words)
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                fresh = np.append(True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])) if len(value) else np.zeros(0, bool)
                n = np.bincount(row[fresh], minlength=last - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), _lists(value[fresh].view(np.int64), n)], ["node", "shingles"]
                )
        give_back()

    return sets


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose shingle sets have at least the similarity."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return joined.filter(F.col("both") / (F.col("sum") - F.col("both")) >= similarity).select("a", "b")


def _blocks(texts: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(texts) / GROUP_TEXTS), F.ceil(F.col(shingles) / GROUP_SHINGLES)).cast("int")


def _mixed(members: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """The texts of the bands that hold several classes, dealt into groups of bounded size.

    Texts of one class need no comparison, so only texts outside a band's largest class (strangers) meet all texts of the
    band: the strangers are cut in blocks, the band is cut in blocks, and every block of one meets every block of the other
    in a group. A text is sent as often as its band has blocks of strangers. A band of two texts is settled by its star.
    """
    known = members.join(labels, "node").join(sizes, "node").select("band", "node", "label", "n")
    classes = known.groupBy("band", "label").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    bands = classes.groupBy("band").agg(
        F.count("*").alias("classes"), F.max(F.struct("texts", "label", "n")).alias("largest"), F.sum("texts").alias("texts"), F.sum("n").alias("n")
    )
    bands = bands.filter("classes > 1 AND texts > 2").select(
        "band", F.col("largest.label").alias("largest"), _blocks("texts", "n").alias("blocks"),
        (F.col("texts") - F.col("largest.texts")).alias("texts"), (F.col("n") - F.col("largest.n")).alias("n"),
    )
    bands = bands.withColumn("stranger_blocks", _blocks("texts", "n")).drop("texts", "n")
    known = known.drop("n").join(bands, "band")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = known.filter(F.col("label") != F.col("largest")).withColumn("one", place("stranger_blocks")).withColumn("two", each("blocks"))
    found = known.withColumn("one", each("stranger_blocks")).withColumn("two", place("blocks"))
    return asked.unionByName(found).select("band", "node", "label", "one", "two")


def _links_inside(similarity: float):
    """Links between different classes within a group: all its texts are compared, a spanning forest is returned."""

    def links(key: tuple, table: pa.Table) -> pa.Table:
        _, once = np.unique(table["node"].to_numpy(), return_index=True)  # a stranger may come twice
        table = table.take(pa.array(once))
        nodes, labels = table["node"].to_numpy(), table["label"].to_numpy()
        lists = table["shingles"].combine_chunks()
        counts = np.diff(lists.offsets.to_numpy())
        values = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        row = np.repeat(np.arange(len(nodes)), counts)
        _, column, often = np.unique(values, return_inverse=True, return_counts=True)
        shared = often[column] > 1  # a shingle of one text is in no intersection
        number = np.cumsum(often > 1) - 1
        row, column = row[shared], number[column[shared]]
        both = np.zeros((len(nodes), len(nodes)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for begin in range(0, int((often > 1).sum()), PRODUCT_COLUMNS):
            at = slice(*np.searchsorted(column, (begin, begin + PRODUCT_COLUMNS)))
            part = np.zeros((len(nodes), PRODUCT_COLUMNS), np.float32)
            part[row[at], column[at] - begin] = 1
            both += part @ part.T
        union = counts[:, None] + counts[None, :] - both.astype(np.float64)
        near = both / np.maximum(union, 1) >= similarity
        seen = np.zeros(len(nodes), bool)
        found = []
        for start in range(len(nodes)):
            if seen[start]:
                continue
            seen[start], front = True, [start]
            while front:
                at = front.pop()
                fresh = np.flatnonzero(near[at] & ~seen)
                seen[fresh] = True
                front += fresh.tolist()
                found += [(at, int(to)) for to in fresh if labels[at] != labels[to]]
        a, b = ([nodes[x[i]] for x in found] for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the classes of linked texts."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    edges = links.join(one, "a").join(two, "b").select("la", "lb").distinct()
    ends = edges.select(F.col("la").alias("label")).union(edges.select("lb")).distinct()
    joined = connected_components(ends, edges, "label", "la", "lb")
    return labels.join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("label"))


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Classes of near-duplicate documents: ``doc_id``, ``class_id``, ``class_size``, ``kept``.

    Takes ``doc_id`` and ``text``; other columns are ignored. Two texts are linked when the sets of their shingles of
    ``words`` words have a Jaccard similarity of at least ``similarity``; classes are what links connect. ``class_id`` is
    the smallest doc_id of the class and that document is the one kept; of several texts of that id the one of the smallest
    text hash. A text with fewer than ``words`` words has one
    shingle of all its words; texts without words (null, empty, blank) are copies of each other. Equal texts are one
    text from the start. Rows that share a doc_id and a text are one document for ``kept``; a null id is never the class id unless
    all ids of the class are null. An empty table gives an empty result.
    """
    rows_of = _classified(docs, words, similarity, bands, rows)
    return rows_of.select("doc_id", "class_id", "class_size", "kept")


def _classified(docs: DataFrame, words: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """The rows of ``near_duplicates`` with ``text_hash``, which tells apart texts that share an id."""
    spark = with_code(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("text_hash"))
    sketches = written(docs.mapInArrow(_sketch(words, bands, rows), SKETCH))
    with Scratch(spark) as scratch:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
        texts = sketches.groupBy("digest").agg(first, F.first("bands").alias("bands"), F.count("*").alias("n_rows"))
        texts = texts.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "bands", "n_rows")
        texts = scratch.table(texts.withColumn("node", F.monotonically_increasing_id()))
        entries = texts.select("node", F.explode("bands").alias("band"))
        shared = entries.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last")
        members = scratch.table(entries.join(shared.select("band", "lead"), "band"))
        wanted = texts.join(members.select("node").distinct(), "node").select("node", "first_id", "first_hash")
        same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
        found = docs.join(wanted, same).select("node", "text")
        sets = scratch.table(found.mapInArrow(_shingle_sets(words), SHINGLED).dropDuplicates(["node"]))
        nodes = scratch.table(members.select("node").distinct())
        stars = members.filter("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
        links = scratch.table(_verified(stars, sets, similarity))
        labels = connected_components(nodes, links, "node", "a", "b").select("node", F.col("component").alias("label"))
        labels = scratch.table(labels)
        groups = _mixed(members, labels, sets.select("node", F.size("shingles").alias("n")))
        links = groups.join(sets, "node").groupBy("band", "one", "two").applyInArrow(_links_inside(similarity), "a long, b long")
        links = scratch.table(links.distinct())
        if not links.isEmpty():
            labels = scratch.table(_merged(labels, links))
        named = texts.select("node", "digest", "first_id", "first_hash", "n_rows").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        first = F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "first_hash")).alias("first")
        least = named.groupBy("label").agg(first, F.sum("n_rows").alias("class_size"))
        least = least.select("label", F.col("first.first_id").alias("class_id"), F.col("first.first_hash").alias("kept_hash"), "class_size")
        classes = written(named.select("digest", "label").join(least, "label").drop("label"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("kept_hash"))
    placed_rows = sketches.select("doc_id", "text_hash", "digest").join(classes, "digest")
    return placed_rows.select("doc_id", "text_hash", "class_id", "class_size", kept.alias("kept"))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays."""
    gone = _classified(docs, SHINGLE_WORDS, SIMILARITY, BANDS, ROWS).filter(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone")) & (_text_hash() == F.col("_gone_text"))
    return docs.join(gone, same, "left_anti")


def op1_minhash_near_dedup(spark, sf: str) -> DataFrame:
    """Query: every document with its near-duplicate class."""
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
