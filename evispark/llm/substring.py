"""Substring dedup: repeated fixed-length word windows become maximal removal intervals.

Documents are dealt by id into blocks of contiguous id ranges, so that block order is document order. Each
block hashes every window of its texts (Rabin-Karp) and sends each distinct hash once to the hash's bucket.
The bucket finds the hashes that several blocks sent and tells every block but the first which of its hashes
an earlier block has. The block then marks the windows that an earlier document starts, inside the block or
before it, and merges them into intervals.

What moves is one packed list of hashes per (block, bucket) instead of a row per window. A window that a
third of all documents share reaches its bucket once per block, so no bucket grows with a hot window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evispark.llm.ship import with_code
from evispark.llm.words import text_bytes, window_hashes, word_hashes

WINDOW = 13
#: Bytes of text in a block and windows in a bucket: what one task holds at a time.
BLOCK_BYTES = 8 << 20
BUCKET_WINDOWS = 2 << 20
#: A document without an id is ordered behind all others.
NO_ID = np.iinfo(np.int64).max

SENT = "bucket long, block long, hashes binary"
TOLD = "block long, hashes binary"
CUT = "doc_id long, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept string"
CUT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ("kept", pa.string()),
    ]
)


def pack(hashes: np.ndarray) -> bytes:
    """Sorted distinct 64-bit values as six-byte gaps, or plainly when a gap needs more."""
    gaps = np.diff(hashes)
    if len(hashes) < 2 or int(gaps.max()) >> 48:
        return b"\0" + hashes.tobytes()
    wide = gaps.view(np.uint8).reshape(-1, 8)[:, :6]
    return b"\1" + hashes[:1].tobytes() + np.ascontiguousarray(wide).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if blob[0] == 0:
        return np.frombuffer(blob, np.uint64, offset=1)
    out = np.zeros((1 + (len(blob) - 9) // 6, 8), np.uint8)
    out[0] = np.frombuffer(blob, np.uint8, 8, 1)
    out[1:, :6] = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(out.view(np.uint64)[:, 0], dtype=np.uint64)


def _ids(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def _windows(table: pa.Table, window: int) -> tuple:
    """Window hashes of a block with the word each starts at, and the word range of each row."""
    data, offsets = text_bytes(table["text"])
    hashes, counts = word_hashes(data, offsets)
    value, at = window_hashes(hashes, counts, window)
    return value, at, counts


def _assign_blocks(bounds: list[int]):
    edges = np.asarray(bounds, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.searchsorted(edges, _ids(batch.column(0)), "right")
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", "doc_id", "text"])

    return assign


def _send(window: int, bits: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        value, _, _ = _windows(table, window)
        value = np.unique(value)
        cuts = np.searchsorted(value, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
        parts = np.split(value, cuts)
        rows = [(b, pack(p)) for b, p in enumerate(parts) if len(p)]
        block = key[0].as_py()
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in rows], pa.int64()),
                "block": pa.array([block] * len(rows), pa.int64()),
                "hashes": pa.array([p for _, p in rows], pa.binary()),
            }
        )

    return send


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """For each block the hashes of this bucket that an earlier block has too."""
    order = np.argsort(table["block"].to_numpy(), kind="stable")
    blocks = table["block"].to_numpy()[order]
    blobs = table["hashes"].to_pylist()
    lists = [unpack(blobs[i]) for i in order]
    value = np.concatenate(lists)
    block = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    by_value = np.argsort(value, kind="stable")  # blocks stay in order within a value
    again = np.zeros(len(value), bool)
    again[1:] = value[by_value][1:] == value[by_value][:-1]
    again_at = np.sort(by_value[again])
    value, block = value[again_at], block[again_at]
    present = np.unique(block)
    firsts = np.searchsorted(block, present)
    packed = [pack(p) for p in np.split(value, firsts[1:])] if len(present) else []
    return pa.table({"block": pa.array(blocks[present], pa.int64()), "hashes": pa.array(packed, pa.binary())})


def _mark(ids: np.ndarray, value: np.ndarray, row: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Windows that an earlier document starts too."""
    marked = np.zeros(len(value), bool)
    if len(earlier) and len(value):
        at = np.searchsorted(earlier, value)
        at[at == len(earlier)] = 0
        marked = earlier[at] == value
    if len(value):
        order = np.argsort(value, kind="stable")
        ranked, doc = value[order], ids[row[order]]
        heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        least = np.minimum.reduceat(doc, heads)
        marked[order] |= doc > np.repeat(least, np.diff(np.append(heads, len(ranked))))
    return marked


def _cut(window: int):
    def cut(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        ids = _ids(docs["doc_id"])
        value, at, counts = _windows(docs, window)
        row = np.searchsorted(counts, at, "right") - 1
        lists = [unpack(b) for b in told["hashes"].to_pylist()]
        earlier = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        starts = at[_mark(ids, value, row, earlier)]
        total = int(counts[-1])
        change = np.zeros(total + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), counts[:-1]) * (np.diff(counts) > 0)
        spans, kept = [], []
        for i, text in enumerate(docs["text"].fill_null("").to_pylist()):
            words = text.encode().split()
            mine = []
            if n_removed[i]:
                flags = gone[counts[i] : counts[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                mine = [{"first": int(a), "last": int(b) - 1} for a, b in edges.reshape(-1, 2)]
                words = [words[k] for k in np.flatnonzero(~flags)]
            spans.append(mine)
            kept.append(b" ".join(words).decode())
        return pa.table(
            [docs["doc_id"], pa.array(np.diff(counts)), pa.array(n_removed), pa.array(spans, CUT_ARROW.field("spans").type), pa.array(kept, pa.string())],
            schema=CUT_ARROW,
        )

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Cut out every word that lies in a window which a document of smaller id starts too.

    Takes ``doc_id`` and ``text``; other columns are ignored. Returns a row per input row: ``doc_id``, ``n_words``,
    ``n_removed``, ``spans`` (maximal intervals of removed word positions, both ends included) and ``kept`` (the
    words that stay, joined by one space). Windows are judged on the input, not on what is left.

    A null text has no words; a text of fewer than ``window`` words keeps all. Rows that share an id never remove
    each other's words, whatever their texts; a null id ranks behind all ids and stays null. An empty table gives
    an empty result. Hashes have 64 bits: among n windows about n * n / 2**65 differing pairs are taken as equal.
    """
    with_code(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block_bytes))
    bits = max(0, math.ceil(math.log2(max(1, total / 6.5 / bucket_windows))))
    shares = [i / blocks for i in range(1, blocks)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10 * blocks).alias("b")).first()["b"] if shares else []
    dealt = docs.mapInArrow(_assign_blocks(sorted(set(bounds or []))), "block long, doc_id long, text string")
    sent = dealt.groupBy("block").applyInArrow(_send(window, bits), SENT)
    told = sent.groupBy("bucket").applyInArrow(_answer, TOLD)
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_cut(window), CUT)


def op8_substring_dedup(spark, sf: str) -> DataFrame:
    """Query: every document with the words that windows of 13 words of earlier documents leave it."""
    cut = remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "spans")
