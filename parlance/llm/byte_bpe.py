"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped one to one to Latin-1 characters, so a pyahocorasick automaton over the
vocabulary finds, in one pass of a piece of text, the longest token that starts at each byte.
The encoder takes the longest token that may follow the one before it, falls back to that token's
longest proper prefix in the vocabulary, and steps back when none fits; a position given up once
is never tried again, so the work is linear in the piece.  Two tokens may stand side by side if
and only if the merges would not have joined across their border; that test undoes the later of
the two tokens' own merges step by step and is memoised by pair.  The result is the exact merge
order's (compared with tiktoken in the tests).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from parlance.llm.common import id_again, id_text, thrifty

RANKS = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """Encoder and decoder over a table of ranks (token bytes to rank)."""

    PAIRS, PIECES, LONGEST = 1 << 18, 1 << 18, 64

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # Unicode's White_Space, as the library's regular expressions have it
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.shorter = {rank: next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), None) for token, rank in ranks.items()}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.allowed: dict[tuple[int, int], bool] = {}
        # two generations: a full one replaces the older one, from which pieces in use come back
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        for rank in sorted(self.tokens):
            self._derive(rank)

    def _derive(self, rank: int) -> None:
        """Which merge makes the token: the one split into earlier tokens that the merges keep apart."""
        token = self.tokens[rank]
        left = self.shorter[rank]
        while left is not None:
            right = self.ranks.get(token[len(self.tokens[left]) :])
            if right is not None and left < rank and right < rank and self._apart(left, right):
                self.joined[left, right] = rank
                self.halves[rank] = (left, right)
                return
            left = self.shorter[left]

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging in order of rank leaves the border between two whole tokens alone.

        The border is crossed if, at some moment, the tokens that touch it can join by a merge
        that comes before the merges still to be made on either side.  Walking back in time, the
        side whose token was made last is undone first.
        """
        until = len(self.ranks) + 1
        while True:
            if self.joined.get((left, right), until) < until:
                return False
            if left > right:
                parts = self.halves.get(left)
                if parts is None:  # a single byte: only the right side can still be undone
                    parts = self.halves.get(right)
                    if parts is None:
                        return True
                    until, right = right + 1, parts[0]
                else:
                    until, left = left, parts[1]
            else:
                parts = self.halves.get(right)
                if parts is None:
                    parts = self.halves.get(left)
                    if parts is None:
                        return True
                    until, left = left, parts[1]
                else:
                    until, right = right + 1, parts[0]

    def _fits(self, left: int, right: int) -> bool:
        known = self.allowed.get((left, right))
        if known is None:
            if len(self.allowed) >= self.PAIRS:
                self.allowed.clear()
            known = self.allowed[left, right] = self._apart(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of text (one match of the pattern)."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest, size = [-1] * n, [0] * n
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            at = end - length + 1
            if length > size[at]:
                longest[at], size[at] = rank, length
        out: list[int] = []
        dead = bytearray(n + 1)
        at, rank = 0, longest[0] if n else -1
        while at < n:
            step = len(self.tokens[rank])
            if not dead[at + step] and (not out or self._fits(out[-1], rank)):
                out.append(rank)
                at += step
                rank = longest[at] if at < n else -1
                continue
            shorter = self.shorter[rank]
            while shorter is None:  # nothing fits here: give the position up and step back
                dead[at] = 1
                back = out.pop()
                at -= len(self.tokens[back])
                shorter = self.shorter[back]
            rank = shorter
        return out

    def _packed(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.encode_piece(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= self.LONGEST:
            if len(self.pieces) >= self.PIECES:
                self.pieces, self.older = {}, self.pieces
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out, known = [], self.pieces
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids, known = self._packed(piece), self.pieces
            out.append(ids)
        return b"".join(out)

    def forget(self) -> None:
        """Empty the caches of pieces and pairs."""
        self.pieces, self.older, self.allowed = {}, {}, {}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_OPEN: dict[str, ByteBpe] = {}


def opened(path: str) -> ByteBpe:
    """One encoder a worker and file."""
    if path not in _OPEN:
        _OPEN[path] = ByteBpe(load_ranks(path))
    return _OPEN[path]


def _rows(docs: DataFrame, of_text, columns: str) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = list(zip(*map(of_text, pdf.iloc[:, 1]), strict=True)) or [[] for _ in columns.split(",")]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c.split()[0]: list(v) for c, v in zip(columns.split(","), values, strict=True)}})
        for bpe in _OPEN.values():
            bpe.forget()

    out = docs.withColumn("doc_id", id_text()).mapInPandas(thrifty(run), f"doc_id string, {columns}")
    return id_again(out, kind)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).  A null text counts as empty."""
    path = path or public_tokenizers.path(RANKS)

    def encoded(text):
        ids = opened(path).encode(text or "")
        return len(ids) // 4, ids

    return _rows(docs.select("doc_id", "text"), encoded, "n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of the ids that :func:`encode_documents` gives."""
    path = path or public_tokenizers.path(RANKS)
    return _rows(encoded.select("doc_id", "ids"), lambda ids: (opened(path).decode(ids).decode("utf-8"),), "text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; encodes and decodes in one pass.

    A null text counts as empty; repeated rows, null ids and further columns are no matter.
    """
    path = path or public_tokenizers.path(RANKS)

    def both(text):
        bpe = opened(path)
        ids = bpe.encode(text or "")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _rows(docs.select("doc_id", "text"), both, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, token bytes."""
    ranks = load_ranks(path or public_tokenizers.path(RANKS))
    return spark.createDataFrame([(i, t) for t, i in ranks.items()], "id long, token binary")
