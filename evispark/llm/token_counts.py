"""Exact token counts at every prefix of a text by dynamic programming.

For every prefix of a piece the table holds the last token of its encoding and how many tokens it has: the last token
is the only one that ends there and fits behind the encoding of what is before it, so the count is one more than the
count at its start. The counts answer how long a text is in tokens and where to cut it for a budget without
encoding anything again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from evispark.llm.ship import kept_tables, with_code
from evispark.llm.vocab import PIECE, Merges, Pieces, merges, shared_file, spread

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
_SPACE = regex.compile(r"\s")


class PrefixCounts:
    """Token counts of pieces and of every prefix of a text, for one vocabulary."""

    def __init__(self, table: Merges):
        self.table = table
        special = sorted(getattr(table, "special", {}), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.backward: dict[int, int] = {}  # the trie of the tokens read from their ends
        self.token: dict[int, int] = {}
        size = 1
        for token, word in table.bytes.items():
            node = 0
            for byte in reversed(word):
                key = node << 8 | byte
                if key not in self.backward:
                    self.backward[key] = size
                    size += 1
                node = self.backward[key]
            self.token[node] = token
        whole = Pieces(lambda p: self.piece(p.encode())[-1]).__getitem__
        self.first = Pieces(lambda run: sum(map(whole, PIECE.findall(run))), 50_000)
        self.later = Pieces(lambda run: sum(map(whole, PIECE.findall(" " + run))))

    def piece(self, data: bytes) -> list[int]:
        """Tokens of every prefix of a piece by its number of bytes, the empty one first."""
        backward, tokens, fits = self.backward, self.token, self.table.fits
        last, count = [-1], [0]
        for end in range(1, len(data) + 1):
            node = 0
            for start in range(end - 1, -1, -1):
                node = backward.get(node << 8 | data[start])
                if node is None:
                    raise ValueError("no token ends here; the vocabulary lacks single bytes")
                token = tokens.get(node)
                if token is not None and (start == 0 or fits(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("no token ends here; the vocabulary lacks single bytes")
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; strings of special tokens are one token each."""
        segments = self.special.split(text) if self.special else [text]
        return len(segments) - 1 + sum(sum(spread(s, "\n", self.first, self.later)) for s in segments)

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text by its number of characters, from the empty one to the whole."""
        parts, at, base = [np.zeros(1, np.int64)], 0, 0
        for special in self.special.finditer(text) if self.special else ():
            whole = self._plain(text[at : special.end() - 1])
            base_after = base + int(whole[special.start() - at]) + 1
            parts += [base + whole[1:], np.asarray([base_after])]
            at, base = special.end(), base_after
        return np.concatenate([*parts, base + self._plain(text[at:])[1:]])

    def _plain(self, text: str) -> np.ndarray:
        """The same where no string is special.

        A prefix that ends inside a piece is split as if the text ended there: the start of a word, number or
        sign run is one piece, a cut contraction falls apart, and white space at the end is one piece although
        its last character goes with what follows in the longer text.
        """
        out = np.zeros(len(text) + 1, np.int64)
        done, blank = 0, None
        for match in PIECE.finditer(text):
            start, piece = match.start(), match.group()
            counts = self.piece(piece.encode())
            ends = np.cumsum([len(c.encode()) for c in piece])
            out[start + 1 : match.end() + 1] = done + np.asarray(counts)[ends]
            if piece[0] == "'" and piece[1:].isalpha():
                for i in range(2, len(piece)):
                    out[start + i] = done + sum(self.piece(p.encode())[-1] for p in PIECE.findall(piece[:i]))
            if blank and _SPACE.match(piece):
                out[start + 1] = blank[1] + self.piece(text[blank[0] : start + 1].encode())[-1]
            blank = (start, done) if _SPACE.match(piece) and _SPACE.match(piece[-1]) else None
            done += counts[-1]
        return out


def counter(raw: bytes) -> PrefixCounts:
    """The counts of a vocabulary file's content, once per Python worker as long as it runs this operator's tasks."""
    kept = kept_tables("token counts")
    if kept.get("raw") != raw:
        kept.update(raw=raw, counter=PrefixCounts(merges(raw)))
    return kept["counter"]


def _count(raw, every: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(raw.value)
        for batch in batches:
            texts = batch.column(0).fill_null("").to_pylist()
            if every:
                made = pa.array([own.prefixes(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))
            else:
                made = pa.array([own.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*batch.schema.names[1:], "prefix_tokens" if every else "n_tokens"])

    return count


def _with_counts(docs: DataFrame, path: str, every: bool) -> DataFrame:
    spark = with_code(docs.sparkSession)
    name, kind = ("prefix_tokens", ArrayType(IntegerType())) if every else ("n_tokens", LongType())
    rest = [F.col(f"`{c}`") for c in docs.columns if c != name]
    rows = docs.select(F.col("text").cast("string").alias("_counted"), *rest)
    return rows.mapInArrow(_count(shared_file(spark, path), every), rows.drop("_counted").schema.add(name, kind))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Add ``n_tokens``: tokens of ``text`` by the vocabulary at ``path``, nothing added at its ends.

    Strings of special tokens inside a text are one token each, as the library has it by default. Null and empty
    texts have none. All columns stay, but one called ``n_tokens`` is replaced.
    """
    return _with_counts(docs, path, False)


def prefix_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Add ``prefix_tokens``: the exact token count of every prefix of ``text`` by characters, the empty one first."""
    return _with_counts(docs, path, True)


def longest_prefix(prefix: Column, budget: int) -> Column:
    """Characters of the longest prefix within a budget of tokens, from what ``prefix_tokens`` stored."""
    places = F.transform(prefix, lambda n, i: F.when(n <= budget, i).otherwise(0))
    return F.array_max(places)


def op10_token_counts(spark, sf: str) -> DataFrame:
    """Query: bytes and tokens of every document, and whether it is over the limit."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    counted = count_tokens(sized, public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
