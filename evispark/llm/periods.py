"""Periodic runs of words, found with string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q that repeats four times at least and cannot be extended. Periods below
``DIRECT`` are found by comparing a text with itself shifted. For larger ones, a scale t = 8, 16, 32, ... covers the
periods t <= q < 2t:

* Windows of t words that have a period of t/4 or less lie in runs of smaller scales, which are known by then. They get no
  identifier; every other window is identified by a hash of its words.
* A position i is synchronising if the least identifier among the windows that start in i..i+t is that of the first or the
  last of them. Whether it is depends on the 2t words from i alone, so equal contexts are both synchronising or neither. A
  stretch of 3t-1 words without a period of t/4 has such a position among its first t.
* So a run of period q has a synchronising position in its first t words, and one with the same context q words on. The
  next position with an equal context therefore proposes q, and comparing words left and right of the two makes the run.

The scales of a text end at a quarter of its length, and each costs a number of passes over the text that grows with
log t. Everything works on many texts at once, with a separator that equals nothing else behind each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evispark.llm.ship import with_code
from evispark.llm.words import mix, slices, text_bytes, word_hashes

#: Repeats of the period and words a run has at least.
EXPONENT, LEAST_WORDS = 4, 6
#: Periods below this are compared directly; it is the first scale of the synchronising sets.
DIRECT = 8
SLICE_BYTES = 2 << 20
#: Words that are compared at a time when runs are checked.
GATHER = 1 << 20
_NONE = np.uint64(np.iinfo(np.uint64).max)
_LEFT = np.uint64(0xD6E8FEB86659FD93)
_NAME = np.uint64(0xA24BAED4963EE407)
_END = np.uint64(0x9FB21C651E98DF25)

RUNS = "array<struct<start:long,length:long,period:long>>"


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true values."""
    edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of twice ``size`` words; those that reach behind the end equal nothing else."""
    out = mix((np.arange(len(hashes), dtype=np.uint64) + np.uint64(size)) * _END)
    out[:-size] = mix(hashes[:-size] * _LEFT + hashes[size:])
    return out


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on, for all positions that have so many."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def synchronising(names: np.ndarray, scale: int) -> np.ndarray:
    """Positions whose ``scale`` + 1 windows from there on have their least name first or last; ``_NONE`` is no name."""
    if len(names) <= 2 * scale:
        return np.zeros(0, np.int64)
    least = _sliding_least(names, scale + 1)[: len(names) - 2 * scale + 1]
    chosen = (least == names[: len(least)]) | (least == names[scale : scale + len(least)])
    return np.flatnonzero(chosen & (least != _NONE))


def _proposals(at: np.ndarray, context: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (begin, end, period) in which words a period apart are equal, from next positions of equal context."""
    order = np.argsort(context[at], kind="stable")
    ranked = at[order]
    gap = np.diff(ranked)
    same = (context[ranked[1:]] == context[ranked[:-1]]) & (gap >= scale) & (gap < 2 * scale)
    begin, period = ranked[:-1][same], gap[same]
    order = np.lexsort((begin, period))
    begin, period = begin[order], period[order]
    if not len(begin):
        return begin, begin, period
    fresh = np.append(True, (period[1:] != period[:-1]) | (begin[1:] > begin[:-1] + 2 * scale))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(begin)) - 1
    return begin[first], begin[last] + 2 * scale, period[first]


def _extended(words: np.ndarray, edge: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """Move each edge right (step 1) or left (-1) as long as the word there equals the one a period on."""
    edge, open_ = edge.copy(), np.arange(len(edge))
    width, n = 16, len(words)
    while len(open_):
        far = []
        for part in np.array_split(open_, max(1, len(open_) * width // GATHER)):
            offset = np.arange(width) if step > 0 else -1 - np.arange(width)
            at = edge[part][:, None] + offset
            other = at + period[part][:, None]
            inside = (at >= 0) & (other < n)
            equal = inside & (words[np.clip(at, 0, n - 1)] == words[np.clip(other, 0, n - 1)])
            count = np.where(equal.all(axis=1), width, np.argmin(equal, axis=1))
            edge[part] += step * count
            far.append(part[count == width])
        open_ = np.concatenate(far)
        width = min(2 * width, 4096)
    return edge


def _confirmed(words: np.ndarray, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether all words of a stretch equal those a period on; proposals come from hashes, runs from words."""
    ok = np.ones(len(begin), bool)
    lengths = end - begin
    group = np.cumsum(lengths) // GATHER
    for part in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(group)) + 1) if len(begin) else ():
        n = lengths[part]
        row = np.repeat(np.arange(len(part)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[part][row]
        ok[part[np.unique(row[words[at] != words[at + period[part][row]]])]] = False
    return ok


def find_runs(words: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs, by start and then period.

    ``words`` holds the word hashes of texts, each followed by a separator that occurs nowhere else; ``text_ends`` the index
    of each separator. Stretches that repeat less than ``EXPONENT`` times are no runs.
    """
    sizes = np.diff(text_ends, prepend=-1) - 1
    found = [(np.zeros(0, np.int64),) * 3]
    for period in range(1, min(DIRECT, int(sizes.max(initial=0)) // EXPONENT + 1)):
        begin, end = _stretches(words[:-period] == words[period:])
        long_ = end - begin >= (EXPONENT - 1) * period
        found.append((begin[long_], end[long_] + period, np.full(int(long_.sum()), period)))
    scale = DIRECT
    place = np.arange(len(words))  # of the words of the texts that are long enough for the scale
    windows = words
    for size in (1, 2, 4):
        windows = _doubled(windows, size) if len(words) > 2 * DIRECT else windows
    while (sizes >= EXPONENT * scale).any():
        stay = np.repeat(sizes >= EXPONENT * scale, sizes + 1)
        if not stay.all():
            place, words, windows = place[stay], words[stay], windows[stay]
            sizes = sizes[sizes >= EXPONENT * scale]
        start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
        dense = (EXPONENT * period <= scale) & (end - start >= scale)
        at = np.searchsorted(place, start[dense])
        here = (at < len(place)) & (place[np.minimum(at, len(place) - 1)] == start[dense])
        at, count = at[here], (end - start)[dense][here] - scale + 1
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + count, -1)
        names = mix(windows ^ _NAME)
        names[np.cumsum(change[:-1]) > 0] = _NONE
        context = _doubled(windows, scale)
        begin, end, period = _proposals(synchronising(names, scale), context, scale)
        true = _confirmed(words, begin, end, period)
        begin, end, period = begin[true], end[true], period[true]
        begin, end = _extended(words, begin, period, -1), _extended(words, end, period, 1)
        long_ = end - begin >= (EXPONENT - 1) * period
        found.append((place[begin[long_]], place[begin[long_]] + (end - begin + period)[long_], period[long_]))
        windows, scale = context, 2 * scale
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]  # others are multiples of it
    start, end, period = start[least], end[least], period[least]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the words of a planted repetition begin and its period; None for documents that stay as they are."""
    if doc_id is None or n == 0:
        return None
    check = zlib.crc32(str(doc_id).encode())
    if check % 10:
        return None
    g = check // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _collapse(plant: bool):
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(text_bytes(batch.column(1))[1], SLICE_BYTES):
                yield _collapsed(batch.slice(first, last - first), plant)

    return collapse


def _collapsed(batch: pa.RecordBatch, plant: bool) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column(1))
    hashes, counts = word_hashes(data, offsets)
    n, ids = np.diff(counts), batch.column(0).to_pylist()
    source = np.arange(len(hashes))  # the word each position takes
    moved = {}
    for i in np.flatnonzero(n) if plant else ():
        if tail := repeated_tail(ids[i], int(n[i])):
            a, period = tail
            source[counts[i] + a : counts[i + 1]] = counts[i] + a + np.arange(n[i] - a) % period
            moved[i] = source[counts[i] : counts[i + 1]] - counts[i]
    ends = counts[1:] + np.arange(len(n))
    words = mix((np.arange(len(hashes) + len(n), dtype=np.uint64) + np.uint64(1)) * _END)
    text = np.ones(len(words), bool)
    text[ends] = False
    words[text] = hashes[source]
    start, end, period = find_runs(words, ends)
    length = end - start
    long_ = length >= LEAST_WORDS
    start, end, period, length = start[long_], end[long_], period[long_], length[long_]
    row = np.searchsorted(ends, start)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    gone = (np.cumsum(change[:-1]) > 0)[text]
    start = start - row - counts[row]  # as word numbers of the text
    cuts = np.searchsorted(row, np.arange(len(n) + 1))
    runs, kept = [], []
    for i, body in enumerate(batch.column(1).fill_null("").to_pylist()):
        parts = body.encode().split()
        if i in moved:
            parts = [parts[k] for k in moved[i].tolist()]
        at = slice(cuts[i], cuts[i + 1])
        if cuts[i] < cuts[i + 1]:
            parts = [parts[k] for k in np.flatnonzero(~gone[counts[i] : counts[i + 1]]).tolist()]
        runs.append([{"start": a, "length": b, "period": c} for a, b, c in zip(start[at].tolist(), length[at].tolist(), period[at].tolist(), strict=True)])
        kept.append(b" ".join(parts).decode())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(n.astype(np.int64)), pa.array(runs, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
    )


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """The runs of every text and what is left without their repeats: ``doc_id``, ``n_words``, ``runs``, ``collapsed``.

    Takes ``doc_id`` and ``text``; other columns are ignored. Words are what ``[^\\x20\\x09-\\x0D]+`` matches. ``runs`` lists
    start (word number), length and smallest period of each maximal stretch that repeats four times and has six words at
    least, by start and then period. A word is left out of ``collapsed`` if a run contains it behind the run's first period.
    With ``plant``, documents whose id's CRC-32 is a multiple of ten get a repeated tail first (``repeated_tail``).

    A null, empty or blank text has no words and no runs. Rows are judged one by one, so repeated and null ids are kept as
    they are (a null id is never planted). An empty table gives an empty result. Words are equal when their 64-bit hashes
    are; only words of one text that lie a period apart meet, which for 1e12 words is wrong with a probability of about 1e-6.
    Memory grows with the longest text alone (about a dozen numbers per word), there is no limit on length or period.
    """
    with_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_collapse(plant), f"doc_id long, n_words long, runs {RUNS}, collapsed string")



def op12_periodic_runs(spark, sf: str) -> DataFrame:
    """Query: the runs of every document, planted repetitions included, and the digest of what is left."""
    found = periodic_runs(spark.read.parquet(f"{sf}/documents.parquet"), plant=True)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("at"), (-r["period"]).alias("by"))))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.at")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.by")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.by")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
