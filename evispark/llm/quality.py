"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover it to the end. Each position has a learned embedding of its
byte and flags that tell whether the byte repeats one a few positions before. Learned filters run over the
positions of a chunk and keep their largest response; the document's features are the mean and the maximum of these over
its chunks, and a logistic layer makes one probability of them.

Training takes a bounded sample of labelled documents, whole, and runs on the driver; scoring reads every byte and
runs in the tasks. Both hold a bounded number of chunks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evispark.llm.ship import give_back, kept_tables, with_code
from evispark.llm.words import slices, text_bytes

CHUNK, STEP = 512, 480
LAGS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12)
WIDTH, STRIDE = 8, 4
FILTERS, EMBEDDING = 24, 4
#: Labelled documents of each class that training sees at most.
CLASS_SAMPLE = 800
EPOCHS, BATCH, RATE = 10, 40, 0.01
SLICE_BYTES = 1 << 20
SLICE_CHUNKS = 256


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moments: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        inputs = WIDTH * (EMBEDDING + len(LAGS))
        draw = lambda *shape: rng.normal(size=shape).astype(np.float32)
        return cls(
            draw(256, EMBEDDING) * 0.5, draw(inputs, FILTERS) / np.float32(np.sqrt(inputs)), np.zeros(FILTERS, np.float32),
            draw(2 * FILTERS) * 0.05, np.zeros(1, np.float32),
        )

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Inputs of the filters: (chunk, place, WIDTH * channels)."""
        n = len(chunks)
        channels = EMBEDDING + len(LAGS)
        seen = np.zeros((n, CHUNK, channels), np.float32)
        seen[:, :, :EMBEDDING] = self.embedding[chunks]
        for i, lag in enumerate(LAGS):
            seen[:, lag:, EMBEDDING + i] = (chunks[:, lag:] == chunks[:, :-lag]) & (chunks[:, lag:] != 0)
        places = (CHUNK - WIDTH) // STRIDE + 1
        a, b, c = seen.strides
        return np.lib.stride_tricks.as_strided(seen, (n, places, WIDTH * channels), (a, STRIDE * b, c))

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each chunk."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for i in range(0, len(chunks), SLICE_CHUNKS):
            seen = self.windows(chunks[i : i + SLICE_CHUNKS])
            flat = seen.reshape(-1, seen.shape[2]) @ self.filters
            out[i : i + SLICE_CHUNKS] = flat.reshape(seen.shape[0], seen.shape[1], FILTERS).max(axis=1)
        return np.maximum(out + self.shift, 0)

    def features(self, pooled: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(firsts, len(pooled)))
        mean = np.add.reduceat(pooled.astype(np.float64), firsts) / n[:, None]
        return np.concatenate([mean, np.maximum.reduceat(pooled, firsts)], axis=1)

    def score(self, chunks: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        logit = self.features(self.pooled(chunks), firsts) @ self.out.astype(np.float64) + float(self.bias[0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def learn(self, chunks: np.ndarray, firsts: np.ndarray, labels: np.ndarray, weights: np.ndarray, step: int) -> None:
        """One step of Adam on a batch of documents."""
        best = np.empty((len(chunks), FILTERS), np.int64)
        raw = np.empty((len(chunks), FILTERS), np.float32)
        for i in range(0, len(chunks), SLICE_CHUNKS):
            seen = self.windows(chunks[i : i + SLICE_CHUNKS])
            response = (seen.reshape(-1, seen.shape[2]) @ self.filters).reshape(seen.shape[0], seen.shape[1], FILTERS)
            best[i : i + len(seen)] = response.argmax(axis=1)
            raw[i : i + len(seen)] = response.max(axis=1) + self.shift
        pooled = np.maximum(raw, 0)
        features = self.features(pooled, firsts)
        p = 1 / (1 + np.exp(-np.clip(features @ self.out + self.bias[0], -30, 30)))
        error = ((p - labels) * weights / weights.sum()).astype(np.float32)
        n = np.diff(np.append(firsts, len(pooled)))
        doc = np.repeat(np.arange(len(firsts)), n)
        top = features[:, FILTERS:][doc] == pooled
        back = error[doc][:, None] * (self.out[:FILTERS] / n[doc][:, None] + self.out[FILTERS:] * top)
        back = (back * (raw > 0)).astype(np.float32)
        to_bytes, to_filters = np.zeros_like(self.embedding), np.zeros_like(self.filters)
        for i in range(0, len(chunks), SLICE_CHUNKS):
            part, place, slope = (x[i : i + SLICE_CHUNKS] for x in (chunks, best, back))
            seen = self.windows(part)
            picked = np.stack([seen[np.arange(len(seen)), place[:, f]] for f in range(FILTERS)], axis=1)
            to_filters += np.einsum("cf,cfi->if", slope, picked)
            to_input = np.einsum("cf,if->cfi", slope, self.filters).reshape(len(seen), FILTERS, WIDTH, -1)[..., :EMBEDDING]
            at = place[:, :, None] * STRIDE + np.arange(WIDTH)
            np.add.at(to_bytes, part[np.arange(len(seen))[:, None, None], at], to_input)
        slopes = {
            "embedding": to_bytes,
            "filters": to_filters + 1e-5 * self.filters,
            "shift": back.sum(axis=0),
            "out": (error @ features).astype(np.float32) + 1e-4 * self.out,
            "bias": error.sum(keepdims=True),
        }
        for name, slope in slopes.items():
            m, v = self.moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            self.moments[name] = (m, v)
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            setattr(self, name, (getattr(self, name) - rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32))


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that cover every row, zeros behind its end, and the first chunk of each row. An empty row has one chunk."""
    lengths = np.diff(offsets)
    n = np.maximum(1, -(-np.maximum(lengths - (CHUNK - STEP), 0) // STEP))
    firsts = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    begin = (np.arange(len(row)) - firsts[row]) * STEP
    at = (offsets[:-1][row] + begin)[:, None] + np.arange(CHUNK)
    inside = begin[:, None] + np.arange(CHUNK) < lengths[row][:, None]
    padded = data if len(data) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], 0).astype(np.uint8), firsts


def _training_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        blobs = []
        for i in range(len(batch)):
            chunks, _ = chunked(data[offsets[i] : offsets[i + 1]], np.asarray([0, offsets[i + 1] - offsets[i]]))
            blobs.append(chunks.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["label", "chunks"])


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", class_sample: int = CLASS_SAMPLE, epochs: int = EPOCHS) -> Network | None:
    """Fit a network to ``labels`` (doc_id and 0/1 in ``target``) of documents that are not held out.

    Each class gives at most ``class_sample`` documents, those of the smallest hashed ids; the classes are weighted
    as often as they occur. Of several texts of an id the one of the smallest hash is taken. Returns None if one of the classes has no document. Contradicting labels of a document
    count as 0.
    """
    with_code(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min(target).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64("_id")
    some = [known.filter(F.col("label") == c).orderBy(order, "_id").limit(class_sample) for c in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # at most twice class_sample rows of an id and a label
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("r"))
    rows = rows.select("doc_id", "r.label", "r.text").orderBy("doc_id").select("label", "text").mapInArrow(_training_chunks, "label int, chunks binary")
    found = rows.collect()
    if len({r["label"] for r in found}) < 2:
        return None
    chunks = [np.frombuffer(bytes(r["chunks"]), np.uint8).reshape(-1, CHUNK) for r in found]
    y = np.asarray([r["label"] for r in found], np.float64)
    share = {c: counts[c] / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    network, rng, step = Network.fresh(), np.random.default_rng(11), 0
    for _ in range(epochs):
        order_ = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick = order_[i : i + BATCH]
            n = np.asarray([len(chunks[k]) for k in pick])
            step += 1
            network.learn(np.concatenate([chunks[k] for k in pick]), np.cumsum(n) - n, y[pick], weight[pick], step)
    network.moments.clear()
    return network


def _score(network: Network | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_tables("quality")
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            scores = np.full(len(batch), 0.5)
            for first, last in slices(offsets, SLICE_BYTES) if network else ():
                chunks, firsts = chunked(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                scores[first:last] = network.score(chunks, firsts)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], [*batch.schema.names[1:], "score"])
        give_back()

    return score


def score_texts(docs: DataFrame, network: Network | None) -> DataFrame:
    """Add ``score``: the probability that a text is of quality 1. Null counts as empty; without a network all are 0.5.

    All columns stay, but one called ``score`` is replaced.
    """
    with_code(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
    rows = docs.select(F.col("text").cast("string").alias("_scored"), *rest)
    return rows.mapInArrow(_score(network), rows.drop("_scored").schema.add("score", "double"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below one half go."""
    network = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, network).filter("score >= 0.5").drop("score")


def op6_quality(spark, sf: str) -> DataFrame:
    """Query: the quality score of every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    network = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scored = score_texts(docs, network)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
