"""Substring deduplication with a count-min prefilter.

Every window of ``width`` words is hashed.  The sketch has two rows of counters, each cut into
slices of ``2**slice_bits``; a block of text sends each slice its sorted distinct counters (two
bytes each), the slice merges the blocks' partial sketches and answers one bit a counter: is the
merged count two or more?  Counts are only ever overestimated, so a window that repeats anywhere
has its bit set in both rows.  Only such windows go on to the second pass, which groups their full
128-bit identities exactly.  Widths follow the input, so the share of false candidates is constant
(under 2 %), and every message is bounded by a block or a slice, never by the corpus.  A window in
a third of all documents reaches its slice once per block.

Nulls: a null text has no words; a null id is returned as such.  Repeated rows count as further
places where their windows start.  Texts below ``width`` words keep every word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import WordHashes, encoded_words, id_again, id_text, in_blocks, mixed, packed_flags, rolling, starts_of, unpacked_flags

BASES = (0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95)
BLOCK_CHARS = 6_000_000
SLICE_BITS = 24
LOAD = 8  # counters per window

PART = "slice int, block int, n int, keys binary, twice binary"
ANSWER = "block int, step int, slice int, flags binary"


class Windows:
    """The windows of one block: their places, 128-bit identities and counters."""

    def __init__(self, texts: pd.Series, width: int):
        table = WordHashes()
        self.words = [encoded_words(t) for t in texts]
        self.starts = starts_of(np.array([len(w) for w in self.words], np.int64))
        one, other = np.concatenate([np.zeros((2, 0), np.uint64), *(table.both(w) for w in self.words)], axis=1)
        ends = np.repeat(self.starts[1:], np.diff(self.starts))
        self.at = np.flatnonzero(np.arange(len(one)) + width <= ends)
        # two independent hashes of each word, so that no clash of one reaches both halves of an identity
        self.first = rolling(one, width, BASES[0])[self.at] if len(self.at) else one[:0]
        self.second = rolling(other, width, BASES[1])[self.at] if len(self.at) else other[:0]
        self.first, self.second = mixed(self.first, 1), mixed(self.second, 2)

    def counters(self, row: int, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct counters in order, how often each occurs, and each window's place among them."""
        hashed = (self.first, self.second)[row]
        wide = ((hashed >> np.uint64(32)) * np.uint64(slices))
        bucket = ((wide >> np.uint64(32)) << np.uint64(SLICE_BITS)) | (mixed(hashed, 9) >> np.uint64(64 - SLICE_BITS))
        return np.unique(bucket, return_inverse=True, return_counts=True)

    def candidates(self, flags: dict[int, bytes], slices: int) -> np.ndarray:
        """Places in ``at`` whose counters are two or more in both rows."""
        keep = np.ones(len(self.at), bool)
        for row in (0, 1):
            counters, place, _ = self.counters(row, slices)
            hot = np.zeros(len(counters), bool)
            for s, lo, hi in parts(counters >> np.uint64(SLICE_BITS)):
                hot[lo:hi] = unpacked_flags(flags[row * slices + s], hi - lo)
            keep &= hot[place]
        return np.flatnonzero(keep)

    def identities(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = np.empty(len(chosen), [("a", np.uint64), ("b", np.uint64)])
        both["a"], both["b"] = self.first[chosen], self.second[chosen]
        return grouped(both)


def grouped(both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique for pairs: sorted distinct pairs, each pair's place among them, and counts."""
    order = np.lexsort((both["b"], both["a"]))
    ordered = both[order]
    new = np.ones(len(both), bool)
    new[1:] = (ordered["a"][1:] != ordered["a"][:-1]) | (ordered["b"][1:] != ordered["b"][:-1])
    place = np.empty(len(both), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, np.bincount(place, minlength=int(new.sum()))


def parts(owners: np.ndarray):
    """(owner, from, to) for each run of equal owners in a sorted array."""
    if len(owners):
        cuts = np.flatnonzero(np.diff(owners)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(owners)], strict=True):
            yield int(owners[lo]), int(lo), int(hi)


def packed_ids(ids: np.ndarray) -> bytes:
    gaps = np.diff(ids.astype(np.int64), prepend=0)
    return b"\2" + gaps.astype(np.uint16).tobytes() if gaps.max(initial=0) < 65536 else b"\4" + gaps.astype(np.uint32).tobytes()


def unpacked_ids(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint16 if data[0] == 2 else np.uint32, -1, 1), dtype=np.int64)


def dedup_substrings(docs: DataFrame, width: int = 35, block_chars: int = BLOCK_CHARS, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    A word goes if a window covering it, judged on the input, starts anywhere else too.
    """
    total = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    slices = max(1, -(-(total // 6) * LOAD // (1 << SLICE_BITS)))
    exact_slices = max(1, total // 12_000_000)
    laid = in_blocks(docs, [id_text(), "text"], blocks)

    def sketch(pdf: pd.DataFrame) -> pd.DataFrame:
        windows, rows = Windows(pdf["text"], width), []
        block = int(pdf["block"].iloc[0])
        for row in (0, 1):
            counters, _, counts = windows.counters(row, slices)
            within = counters & np.uint64((1 << SLICE_BITS) - 1)
            rows += [(row * slices + s, block, hi - lo, packed_ids(within[lo:hi]), packed_flags(counts[lo:hi] > 1)) for s, lo, hi in parts(counters >> np.uint64(SLICE_BITS))]
        return pd.DataFrame(rows, columns=["slice", "block", "n", "keys", "twice"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << SLICE_BITS, np.uint8)
        for n, keys, twice in zip(pdf["n"], pdf["keys"], pdf["twice"], strict=True):
            ids = unpacked_ids(keys)
            counts[ids] = np.minimum(2, counts[ids] + 1 + unpacked_flags(twice, n))
        flags = [packed_flags(counts[unpacked_ids(keys)] > 1) for keys in pdf["keys"]]
        return pd.DataFrame({"block": pdf["block"], "step": 1, "slice": pdf["slice"], "flags": flags})

    def flags_of(answers: pd.DataFrame, step: int) -> dict[int, bytes]:
        mine = answers[answers["step"] == step]
        return dict(zip(mine["slice"], mine["flags"], strict=True))

    def owners(pairs: np.ndarray) -> np.ndarray:
        return ((pairs["a"] >> np.uint64(32)) * np.uint64(exact_slices)) >> np.uint64(32)

    def candidates(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pdf):
            windows = Windows(pdf["text"], width)
            pairs, _, counts = windows.identities(windows.candidates(flags_of(answers, 1), slices))
            block = int(pdf["block"].iloc[0])
            rows = [(s, block, hi - lo, pairs[lo:hi].tobytes(), packed_flags(counts[lo:hi] > 1)) for s, lo, hi in parts(owners(pairs))]
        return pd.DataFrame(rows, columns=["slice", "block", "n", "keys", "twice"])

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = [("a", np.uint64), ("b", np.uint64)]
        pairs = np.concatenate([np.frombuffer(k, kind) for k in pdf["keys"]])
        times = np.concatenate([1 + unpacked_flags(t, n) for t, n in zip(pdf["twice"], pdf["n"], strict=True)])
        distinct, place, _ = grouped(pairs)
        repeated = (np.bincount(place, weights=times, minlength=len(distinct)) > 1.5)[place]
        at = starts_of(pdf["n"].to_numpy())
        flags = [packed_flags(repeated[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
        return pd.DataFrame({"block": pdf["block"], "step": 2, "slice": pdf["slice"], "flags": flags})

    def remove(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
        if not len(pdf):
            return pd.DataFrame([], columns=columns)
        windows = Windows(pdf["text"], width)
        chosen = windows.candidates(flags_of(answers, 1), slices)
        pairs, place, _ = windows.identities(chosen)
        repeated, flags = np.zeros(len(pairs), bool), flags_of(answers, 2)
        for s, lo, hi in parts(owners(pairs)):
            repeated[lo:hi] = unpacked_flags(flags[s], hi - lo)
        begins = windows.at[chosen[repeated[place]]]
        edges = np.zeros(windows.starts[-1] + 1, np.int32)
        edges[begins] += 1
        np.subtract.at(edges, begins + width, 1)
        gone = np.cumsum(edges[:-1]) > 0
        rows = []
        for doc_id, words, lo, hi in zip(pdf["doc_id"], windows.words, windows.starts[:-1], windows.starts[1:], strict=True):
            lost = gone[lo:hi]
            n = int(lost.sum())
            kept = b" ".join([w for w, x in zip(words, lost.tolist(), strict=True) if not x] if n else words)
            rows.append((doc_id, len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8"))[: 4 + with_text])
        return pd.DataFrame(rows, columns=columns)

    by_block = laid.groupBy("block")
    # answers are laid out like the text at once, so that both uses read the same exchange
    estimated = by_block.applyInPandas(sketch, PART).repartition(2 * slices, "slice").groupBy("slice").applyInPandas(merge, ANSWER).repartition(blocks, "block")
    asked = by_block.cogroup(estimated.groupBy("block")).applyInPandas(candidates, PART)
    confirmed = asked.repartition(exact_slices, "slice").groupBy("slice").applyInPandas(confirm, ANSWER).repartition(blocks, "block")
    answers = estimated.unionByName(confirmed).groupBy("block")
    out = by_block.cogroup(answers).applyInPandas(remove, "doc_id string, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return id_again(out, dict(docs.dtypes)["doc_id"])
