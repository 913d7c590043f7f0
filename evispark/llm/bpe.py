"""Byte-level BPE encoding by a finite-state transducer and decoding by a UTF-8 state machine.

The encoding of every prefix of a piece ends in exactly one token, and that token fits behind the encoding of what is
before it. So a piece can be read byte by byte with a set of threads, one for each position where a token may have begun
that is not complete. All that a set of threads can do next depends on the bytes since its first position, which are a
node of the token trie: the sets are the states of a deterministic transducer, determinised as far as texts need them. Tokens
on which all threads agree are emitted; a thread lives no longer than the longest token, so emission lags behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from evispark.llm.ship import kept_tables, with_code
from evispark.llm.vocab import PIECE, Merges, Pieces, merges, shared_file, spread
from evispark.llm.words import slices, text_bytes

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Transitions that are kept besides those of the token trie; others are made again each time.
MOST_MOVES = 200_000
#: Bytes at the start of a piece whose states are remembered, and how many such starts.
HEAD, MOST_HEADS = 4, 40_000
#: Bytes of a piece after which the tokens that all threads agree on are emitted.
LOOKAHEAD = 4_096
BATCH_BYTES = 8 << 20


class Transducer:
    """Bytes in, token ids out. The states are the nodes of the token trie, so they are bounded by the vocabulary.

    A state stands for the longest end of what was read that starts a token, and with it for all shorter ones: the subset
    of threads that are alive. Transitions are made when they are first met. The tokens that end in a state are tried from
    the longest; the one that fits behind the encoding up to its start ends the encoding of the prefix. What is
    remembered of a text is that token for each position some thread may still go back to.
    """

    def __init__(self, table: Merges):
        self.table = table
        self.moves: dict[int, int] = {}  # those of the trie, then those that texts need
        self.parent, self.byte, self.depth = [0], bytearray(1), [0]
        self.token: dict[int, int] = {}
        for token, word in table.bytes.items():
            node = 0
            for byte in word:
                key = node << 8 | byte
                if key not in self.moves:
                    self.moves[key] = len(self.parent)
                    self.parent.append(node)
                    self.byte.append(byte)
                    self.depth.append(self.depth[node] + 1)
                node = self.moves[key]
            self.token[node] = token
        self.parent, self.depth = np.asarray(self.parent, np.int32), np.asarray(self.depth, np.int32)
        self.links = np.full(len(self.parent), -1, np.int32)
        self.links[0] = 0
        self.ends: list[tuple] = [()] * len(self.parent)
        self.heads: dict[bytes, tuple[int, list[int]]] = {}
        self.most = len(self.moves) + MOST_MOVES
        self.sizes = {t: len(w) for t, w in table.bytes.items()}
        self.packed = {t: t.to_bytes(4, "little") for t in table.bytes}

    def _link(self, node: int) -> int:
        """The state of the text of a state without its first byte."""
        known = int(self.links[node])
        if known < 0:
            parent = int(self.parent[node])
            known = self.links[node] = self._move(self._link(parent), self.byte[node]) if parent else 0
        return int(known)

    def _move(self, state: int, byte: int) -> int:
        """The state behind a byte: the first state along the links that the trie continues."""
        key = state << 8 | byte
        to = self.moves.get(key)
        if to is None:
            to = self._move(self._link(state), byte) if state else 0
            if len(self.moves) < self.most:
                self.moves[key] = to
        return to

    def _ends(self, state: int) -> tuple:
        """The tokens that end in a state with their lengths, longest first."""
        out, at = [], state
        while at:
            token = self.token.get(at)
            if token is not None:
                out.append((token, self.sizes[token]))
            at = self._link(at)
        made = self.ends[state] = tuple(out)
        return made

    def encode(self, piece: bytes) -> bytes:
        """The token ids of one piece as packed 32-bit integers."""
        whole = self.table.ids.get(piece)
        if whole is not None:
            return self.packed[whole]
        head = piece[:HEAD]
        known = self.heads.get(head)
        if known is None:
            known = self._read(head, 0, [-1], [])
            if len(self.heads) >= MOST_HEADS:
                self.heads.clear()
            self.heads[head] = known
        said: list[bytes] = []
        _, last = self._read(piece[HEAD:], known[0], known[1].copy(), said)
        said.append(self._path(last, len(last) - 1))
        return b"".join(said)

    def _read(self, data: bytes, state: int, last: list[int], said: list[bytes]) -> tuple[int, list[int]]:
        """Read bytes on from a state; ``last`` has the last token of each prefix, ``said`` takes what is emitted."""
        moves, ends, limits = self.moves.get, self.ends, self.table.limits.get
        at, full = len(last) - 1, LOOKAHEAD
        for byte in data:
            state = moves(state << 8 | byte) or self._move(state, byte)
            at += 1
            for token, size in ends[state] or self._ends(state):
                before = last[at - size]
                if before < 0:
                    break
                ok = limits(before << 20 | token)
                if ok or (ok is None and self.table.fits(before, token)):
                    break
            last.append(token)
            if at >= full:
                last = self._agreed(last, int(self.depth[state]), said)
                at = len(last) - 1
                full = at + LOOKAHEAD
        return state, last

    def _path(self, last: list[int], at: int) -> bytes:
        """The tokens of the encoding up to a position."""
        out, sizes, packed = [], self.sizes, self.packed
        while at > 0:
            token = last[at]
            out.append(packed[token])
            at -= sizes[token]
        out.reverse()
        return b"".join(out)

    def _agreed(self, last: list[int], alive: int, said: list[bytes]) -> list[int]:
        """Emit the tokens that all threads have in common, and forget what is before their ends."""
        heads = set(range(max(0, len(last) - 1 - alive), len(last)))
        while len(heads) > 1:  # the last position goes back by its token, until all have met
            at = max(heads)
            heads.discard(at)
            heads.add(at - self.sizes[last[at]])
        at = heads.pop()
        said.append(self._path(last, at))
        return last[at:] if at else last


class Encoder:
    def __init__(self, table: Merges):
        machine = Transducer(table)
        piece = Pieces(lambda p: machine.encode(p.encode()), 24_000).__getitem__

        def run(text: str) -> bytes:
            parts = PIECE.findall(text)
            return machine.encode(parts[0].encode()) if len(parts) == 1 else b"".join(map(piece, parts))

        self.first = Pieces(run, 24_000)
        self.later = Pieces(lambda text: run(" " + text), 200_000)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(spread(text, "\n", self.first, self.later)), np.int32)


def _utf8_machine() -> tuple[np.ndarray, np.ndarray]:
    """Classes of bytes, and the next state by state and class. State 0 is between characters, 1 is an error."""
    ranges = [(0x00, 0x7F), (0x80, 0x8F), (0x90, 0x9F), (0xA0, 0xBF), (0xC2, 0xDF), (0xE0, 0xE0), (0xE1, 0xEC), (0xED, 0xED), (0xEE, 0xEF), (0xF0, 0xF0), (0xF1, 0xF3), (0xF4, 0xF4)]
    kind = np.full(256, len(ranges), np.int8)
    for i, (a, b) in enumerate(ranges):
        kind[a : b + 1] = i
    step = np.ones((9, len(ranges) + 1), np.int8)
    # States 2, 3, 4: one, two, three bytes to come; 5 to 8: after E0, ED, F0, F4.
    step[0, [0, 4, 5, 6, 7, 8, 9, 10, 11]] = [0, 2, 5, 3, 6, 3, 7, 4, 8]
    for state, nexts in {2: {1: 0, 2: 0, 3: 0}, 3: {1: 2, 2: 2, 3: 2}, 4: {1: 3, 2: 3, 3: 3}, 5: {3: 2}, 6: {1: 2, 2: 2}, 7: {2: 3, 3: 3}, 8: {1: 3}}.items():
        for k, to in nexts.items():
            step[state, k] = to
    return kind, step


KIND, STEP = _utf8_machine()


class Utf8Stream:
    """Turns bytes that come in any portions into text; holds back a character that is not complete.

    Wrong bytes become U+FFFD. UTF-8 shows where characters start, so the machine need only read on from
    the last start in a portion.
    """

    def __init__(self) -> None:
        self.held = b""

    def feed(self, portion: bytes) -> str:
        data = self.held + portion
        keep = len(data)
        for at in range(len(data) - 1, max(len(data) - 4, -1), -1):
            if data[at] & 0xC0 != 0x80:  # not inside a character
                state = 0
                for byte in data[at:]:
                    state = STEP[state, KIND[byte]]
                keep = at if state > 1 else keep
                break
        self.held = data[keep:]
        return data[:keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, table: Merges, portion: int = 1 << 16):
        size = max(table.bytes) + 1
        words = [table.bytes.get(i, b"") for i in range(size)]
        self.lengths = np.asarray([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.portion = portion

    def bytes_of(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        stream = Utf8Stream()
        out = [stream.feed(self.bytes_of(ids[i : i + self.portion])) for i in range(0, len(ids), self.portion)]
        return "".join([*out, stream.finish()])


def encoder(raw: bytes) -> Encoder:
    """The encoder of a rank file's content, once per Python worker as long as it runs this operator's tasks."""
    kept = kept_tables("bpe")
    if kept.get("raw") != raw:
        kept.clear()
        kept["raw"] = raw
    if "encoder" not in kept:
        kept["encoder"] = Encoder(_table(raw))
    return kept["encoder"]


def decoder(raw: bytes) -> Decoder:
    kept = kept_tables("bpe")
    if kept.get("raw") != raw:
        kept.clear()
        kept["raw"] = raw
    if "decoder" not in kept:
        kept["decoder"] = Decoder(_table(raw))
    return kept["decoder"]


def _table(raw: bytes) -> Merges:
    kept = kept_tables("bpe")
    if "table" not in kept:
        kept["table"] = merges(raw)
    return kept["table"]


def _portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else []
    yield from pairwise(edges)


def _encode(raw, back: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reader = encoder(raw.value), decoder(raw.value)
        for batch in batches:
            texts = batch.column(0).fill_null("")
            for first, last in slices(text_bytes(texts)[1], BATCH_BYTES):
                ids = [own.encode(t) for t in texts.slice(first, last - first).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                part = batch.slice(first, last - first)
                made, names = [*part.columns[1:], tokens], [*part.schema.names[1:], "tokens"]
                if back:
                    made.append(pa.array([reader.decode(i) for i in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(made, names)

    return encode


def _decode(raw):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(raw.value)
        for batch in batches:
            column = batch.column(0)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(ends)
            for first, last in _portions(sizes * 4, BATCH_BYTES):
                texts = [own.decode(values[ends[i] : ends[i + 1]]) for i in range(first, last)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], [*part.schema.names[1:], "decoded"])

    return decode


def encode_texts(docs: DataFrame, path: str, back: bool = False) -> DataFrame:
    """Replace ``text`` by ``tokens``: the ids of the rank file at ``path``, as tiktoken's encode_ordinary gives them.

    A null or empty text has no tokens. Special strings are ordinary text. With ``back`` the ids are decoded again in
    the same pass, to ``decoded``. All other columns stay, except those with the names of new ones.
    """
    spark = with_code(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "tokens", *(["decoded"] if back else []))]
    rows = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in rest])
    schema = rows.drop("text").schema.add("tokens", ArrayType(IntegerType()))
    return rows.mapInArrow(_encode(shared_file(spark, path), back), schema.add("decoded", "string") if back else schema)


def decode_tokens(tokens: DataFrame, path: str) -> DataFrame:
    """Replace ``tokens`` by ``decoded``: the text of the ids, with U+FFFD for bytes that are no UTF-8. Null gives ''."""
    spark = with_code(tokens.sparkSession)
    rest = [c for c in tokens.columns if c not in ("tokens", "decoded")]
    none = F.array().cast("array<int>")
    rows = tokens.select(F.coalesce("tokens", none).alias("tokens"), *[F.col(f"`{c}`") for c in rest])
    schema = rows.drop("tokens").schema.add("decoded", "string")
    return rows.mapInArrow(_decode(shared_file(spark, path)), schema)


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents as token ids; what they decode to is compared with the text's digest."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    coded = encode_texts(docs.withColumn("text_sha256", digest), public_tokenizers.path(RANKS), back=True)
    exact = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("text_sha256")
    return coded.select("doc_id", "lang", "source", "tokens", F.size("tokens").cast("long").alias("n_tokens"), "text_sha256", exact.alias("round_trip"))


def op4_byte_bpe(spark, sf: str) -> DataFrame:
    """Query: every document's token ids and what they decode to, as digests."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    coded = encode_texts(docs, public_tokenizers.path(RANKS), back=True)
    listed = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
