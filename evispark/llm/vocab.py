"""Merge tables of public byte-level BPE vocabularies and the split of texts into pieces."""

from __future__ import annotations

import base64
import json
import re
from pathlib import Path

import public_tokenizers
import regex
from pyspark.sql import SparkSession

PIECE = regex.compile(public_tokenizers.PATTERN)
#: Two white-space characters in a row, or a blank at an end: such texts are split by the pattern alone.
_AWKWARD = re.compile(r"\s\s|^\s|\s\Z")


#: Pairs of tokens of which it is remembered whether they fit, before all are forgotten.
MOST_LIMITS = 400_000
_LATEST = 1 << 62


class Remembered(dict):
    """What a function makes of a token; bounded by the vocabulary."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: int):
        value = self[token] = self.make(token)
        return value


class Merges:
    """Tokens as ids, their bytes, and which pairs merge at which rank; lower ranks merge first."""

    def __init__(self, tokens: dict[int, bytes]):
        self.bytes = tokens
        self.ids = {b: i for i, b in tokens.items()}
        self.longest = max(map(len, self.ids))
        self.limits: dict[int, bool] = {}
        self.parts = Remembered(self.halves)
        self.ranks = Remembered(self.rank)

    def rank(self, token: int) -> int:
        """The rank of the merge that makes a token; -1 for single bytes."""
        raise NotImplementedError

    def pair_rank(self, a: int, b: int) -> int | None:
        raise NotImplementedError

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; none for single bytes."""
        raise NotImplementedError

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of ``a`` and ``b`` together is just ``a``, ``b``.

        Undoes the later of the two merges next to the border, again and again. If the tokens then at the border
        merge earlier than what was undone, the encoder would have crossed the border. Equal ranks merge from
        the left, so a merge right of the border loses against one across it.
        """
        known = self.limits.get(a << 20 | b)
        if known is not None:
            return known
        left, right, bound, ok = a, b, _LATEST, True
        parts, rank, across = self.parts, self.ranks, self.pair_rank
        while True:
            met = across(left, right)
            if met is not None and met < bound:
                ok = False
                break
            parts_left, parts_right = parts[left], parts[right]
            if parts_right is None:
                if parts_left is None:
                    break
                bound, left = rank[left], parts_left[1]
            elif parts_left is not None and rank[left] > rank[right]:
                bound, left = rank[left], parts_left[1]
            else:
                bound, right = rank[right] + 1, parts_right[0]
        if len(self.limits) > MOST_LIMITS:
            self.limits.clear()
        self.limits[a << 20 | b] = ok
        return ok


class RankMerges(Merges):
    """A rank file: any two neighbours merge whose bytes together are a token, and its id is the rank."""

    def __init__(self, raw: bytes):
        pairs = (line.split() for line in raw.splitlines() if line)
        super().__init__({int(rank): base64.b64decode(token) for token, rank in pairs})

    def rank(self, token: int) -> int:
        return token if len(self.bytes[token]) > 1 else -1

    def pair_rank(self, a: int, b: int) -> int | None:
        return self.ids.get(self.bytes[a] + self.bytes[b])

    def halves(self, token: int) -> tuple[int, int] | None:
        parts = [self.ids[bytes([x])] for x in self.bytes[token]]
        while len(parts) > 2:  # the merges below the token's own rank
            ranks = [self.pair_rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(r for r in ranks if r is not None)
            at = ranks.index(best)
            parts[at : at + 2] = [best]
        return tuple(parts) if len(parts) == 2 else None


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ListedMerges(Merges):
    """A vocabulary file with a list of merges: only listed pairs merge, in the order of the list."""

    def __init__(self, raw: bytes):
        file = json.loads(raw)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        vocab = {t: i for t, i in file["model"]["vocab"].items() if t not in self.special}
        super().__init__({i: bytes(letters[c] for c in t) for t, i in vocab.items()})
        self._ranks: dict[tuple[int, int], int] = {}
        self._made: dict[int, tuple[int, tuple[int, int]]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._ranks[vocab[a], vocab[b]] = rank
            self._made.setdefault(vocab[a + b], (rank, (vocab[a], vocab[b])))

    def rank(self, token: int) -> int:
        return self._made[token][0] if token in self._made else -1

    def pair_rank(self, a: int, b: int) -> int | None:
        return self._ranks.get((a, b))

    def halves(self, token: int) -> tuple[int, int] | None:
        return self._made[token][1] if token in self._made else None


def merges(raw: bytes) -> Merges:
    """The table of a file's content."""
    return ListedMerges(raw) if raw[:1] == b"{" else RankMerges(raw)


def shared_file(spark: SparkSession, path: str, most: int = 64 << 20):
    """Broadcast a vocabulary file of the driver; its size is checked, it does not grow with the data."""
    raw = Path(path).read_bytes()
    if len(raw) > most:
        raise ValueError(f"{path} has {len(raw)} bytes, more than {most}")
    return spark.sparkContext.broadcast(raw)


#: Characters of the longest piece that is remembered; with the number of pieces it bounds the bytes.
LONGEST_PIECE = 64


class Pieces(dict):
    """Remembers what a function makes of a piece of text, for about the last ``most`` to twice as many pieces.

    A full generation becomes the old one, and what is still asked for moves on from there, so common pieces stay. Long
    pieces are made each time.
    """

    def __init__(self, make, most: int = 120_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str):
        if len(piece) > LONGEST_PIECE:
            return self.make(piece)
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


def spread(text: str, line_end: str, first: Pieces, later: Pieces) -> list:
    """What the pieces of a text give, in order.

    ``first`` takes runs as they are, ``later`` runs with a blank put before them. Without white space in a row, the
    pattern always breaks a text around a line feed and before a blank, so whole blank-separated runs can be
    looked up; each is split by the pattern when it is first met. Other texts are split by the pattern throughout.
    """
    if not text:
        return []
    if _AWKWARD.search(text):
        return list(map(first.__getitem__, PIECE.findall(text)))
    out: list = []
    feed = first[line_end]
    for n, line in enumerate(text.split("\n")):
        runs = line.split(" ")
        if n:
            out.append(feed)
        out.append(first[runs[0]])
        out.extend(map(later.__getitem__, runs[1:]))
    return out
