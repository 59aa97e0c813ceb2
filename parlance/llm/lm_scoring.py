"""Interpolated modified Kneser-Ney bigram model and perplexity.

Counting and scoring run over blocks of text and shards of the model.  A block sends each shard its
sorted distinct words and word pairs (hashes, with the counts in training documents; pairs of
held-out documents with a count of zero).  A shard adds the blocks' counts, keeps them as sorted
hash arrays in a file that the worker memory-maps, and answers every block from there.  The block
that first holds a pair is its owner and adds it to the statistics of its two words (how many
followers with a count of one, two, more; how many distinct predecessors), which are summed by word
shards in the same way.  With these answers a block scores its own documents.  Corpus-wide numbers
(tokens, types, counts of counts) are the sums of the shards' shares, one row that joins the answers, so the whole
operator is one lazy plan and text is laid out once.

A message holds a block's distinct entries of a shard, so a word in every document costs each shard
one entry a block.  Hashes of pairs keep 48 bits besides the shard's number.

p(w|v) = max(c(vw) - D(c), 0) / c(v) + g(v) p(w);  p(w) = max(n(w) - D'(n), 0) / N + g' / (V + 1)
with n(w) the distinct predecessors of w, N their sum, D and D' the modified discounts from the
counts of counts, and g, g' what the discounts free.  The unknown word has g' / (V + 1).

Nulls: a null text is empty (one end token); a null id is a training document.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import id_again, id_text, in_blocks, mixed, packed_counts, packed_flags, starts_of, unpacked_counts, unpacked_flags
from parlance.llm.near_dedup import LOWER
from parlance.llm.substring_dedup import parts

BLOCK_CHARS = 6_000_000
PAIRS_A_SHARD = 1_500_000
#: words have no spaces, so these stand for no word
START, END = b" s", b" /s"
HELD_OUT = (7, 2)
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
PART = "shard int, block int, n int, keys binary, counts binary"
ANSWER = "block int, shard int, totals array<long>, counts binary, flags binary"


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return mixed(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8")[::2], 3)


def numbered_words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The number of words of each text, the words as places in the list of distinct ones, and that list."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)  # a space behind each text
    space = IS_SPACE[data]
    turns = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = turns[::2], turns[1::2]
    # the words alone, one after the other, are an Arrow array that Arrow numbers
    letters = pa.py_buffer(data[~space])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(starts_of(ends - starts)), letters]).dictionary_encode()
    code = words.indices.to_numpy()
    # numbers rise as words first stand
    new = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
    whole = data.tobytes()
    distinct = [whole[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
    counts = np.diff(np.searchsorted(starts, starts_of(np.array([len(r) + 1 for r in raw], np.int64))))
    return counts, code, distinct


class Tokens:
    """The words and word pairs of a block, distinct and in order of shard and hash."""

    def __init__(self, pdf: pd.DataFrame, shards: int):
        # each distinct word is hashed and sorted once, however often it stands in the block
        counts, code, distinct = numbered_words(pdf["text"])
        self.words, place = np.unique(word_hashes([*distinct, START, END]), return_inverse=True)
        self.lengths = counts + 1
        # start, words, end of each document
        first, last = np.zeros((2, int((self.lengths + 1).sum())), bool)
        last[np.cumsum(self.lengths + 1) - 1] = True
        first[np.cumsum(self.lengths + 1) - self.lengths - 1] = True
        at = np.empty(len(first), np.int64)
        at[first], at[last], at[~(first | last)] = place[-2], place[-1], place[code]
        trained = np.repeat(~pdf["held_out"].to_numpy(bool), self.lengths + 1)
        self.left, self.right = at[~last], at[~first]
        self.trained = trained[~first]
        self.word_counts = np.bincount(at, weights=trained, minlength=len(self.words)).astype(np.int64)
        self.word_shard = ((self.words >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        with np.errstate(over="ignore"):
            pair = mixed(self.words[self.left] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.right], 4)
        shard = ((pair >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        key = mixed(pair, 5) >> np.uint64(16)
        if shards <= 1 << 16:  # both fit in one number, which sorts faster; the order is the same
            order = np.argsort((shard << np.uint64(48)) | key, kind="stable")
        else:
            order = np.lexsort((key, shard))
        key, shard = key[order], shard[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
        one = order[new]
        self.pairs, self.pair_shard = key[new], shard[new]
        self.pair_at = np.empty(len(key), np.int64)
        self.pair_at[order] = np.cumsum(new) - 1
        self.pair_left, self.pair_right = self.left[one], self.right[one]
        self.pair_counts = np.bincount(self.pair_at, weights=self.trained, minlength=len(self.pairs)).astype(np.int64)


def packed_pairs(keys: np.ndarray) -> bytes:
    """The gaps between the sorted 48-bit keys, in as few bytes each as the widest of them needs."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = next(w for w in range(1, 7) if int(gaps.max()) < 1 << (8 * w))
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked_pairs(data: bytes, n: int) -> np.ndarray:
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, : data[0]] = np.frombuffer(data, np.uint8, -1, 1).reshape(-1, n).T
    return np.cumsum(gaps.reshape(-1).view("<u8"))


class SortedCounts:
    """Sorted hashes and their counts in a file, memory-mapped; unlinked at once, gone when closed."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        self.file = tempfile.TemporaryFile()
        keys[new].astype("<u8").tofile(self.file)
        self.n = len(at)
        np.add.reduceat(counts, at, axis=0).astype("<i8").tofile(self.file)
        self.file.flush()
        self.keys = np.memmap(self.file, "<u8", "r", 0, (self.n,))
        self.counts = np.memmap(self.file, "<i8", "r", 8 * self.n, (self.n, *counts.shape[1:]))

    def places(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, from the counts of counts."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) == 0:  # a corpus too small to estimate them
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 1, 2, 3])


def score_documents(docs: DataFrame, held_out=None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``held_out``: boolean column of the documents not to learn from; by default those whose crc32
    of the id as text has remainder 2 modulo 7.
    """
    if held_out is None:
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))
    total = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    shards = max(1, -(-(total // 10) // PAIRS_A_SHARD))
    laid = in_blocks(docs, [id_text(), "text", held_out.alias("held_out")], blocks)
    kind = dict(docs.dtypes)["doc_id"]
    scored = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        t, block = Tokens(pdf, shards), int(pdf["block"].iloc[0])
        rows = [(s, block, hi - lo, packed_pairs(t.pairs[lo:hi]), packed_counts(t.pair_counts[lo:hi])) for s, lo, hi in parts(t.pair_shard)]
        rows += [(shards + s, block, hi - lo, t.words[lo:hi].tobytes(), packed_counts(t.word_counts[lo:hi])) for s, lo, hi in parts(t.word_shard)]
        return pd.DataFrame(rows, columns=["shard", "block", "n", "keys", "counts"])

    def gathered(pdf: pd.DataFrame, unpack) -> tuple[list[np.ndarray], list[np.ndarray]]:
        pdf = pdf.sort_values("block")
        return pdf, [unpack(k, n) for k, n in zip(pdf["keys"], pdf["n"], strict=True)]

    special = word_hashes([START])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        of_pairs = shard < shards
        pdf, keys = gathered(pdf, unpacked_pairs if of_pairs else (lambda k, n: np.frombuffer(k, np.uint64)))
        own = [unpacked_counts(c, n) for c, n in zip(pdf["counts"], pdf["n"], strict=True)]
        model = SortedCounts(np.concatenate(keys), np.concatenate(own))
        if of_pairs:
            totals = counts_of_counts(model.counts)
        else:
            words = np.array(model.counts) * ~np.isin(model.keys, special)
            totals = [int(words.sum()), int((words > 0).sum())]
        owned = np.zeros(model.n, bool)
        rows = []
        for block, k, mine in zip(pdf["block"], keys, own, strict=True):
            at = model.places(k)
            # the first block that holds a trained pair in training text owns it
            owner = (mine > 0) & ~owned[at]
            owned[at[owner]] = True
            rows.append((int(block), shard, totals, packed_counts(np.asarray(model.counts[at])), packed_flags(owner)))
        return pd.DataFrame(rows, columns=["block", "shard", "totals", "counts", "flags"])

    def read(answers: pd.DataFrame, first: int, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and owner flags in the block's order."""
        counts, flags = np.zeros(len(owners), np.int64), np.zeros(len(owners), bool)
        found = {int(s): (c, f) for s, c, f in zip(answers["shard"], answers["counts"], answers["flags"], strict=True)}
        for s, lo, hi in parts(owners):
            c, f = found[first + s]
            counts[lo:hi], flags[lo:hi] = unpacked_counts(c, hi - lo), unpacked_flags(f, hi - lo)
        return counts, flags

    def spread(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """A block's share in the statistics of its words: followers by count, predecessors."""
        rows = []
        if len(pdf):
            t, block = Tokens(pdf, shards), int(pdf["block"].iloc[0])
            counts, owner = read(answers, 0, t.pair_shard)
            stats = np.zeros((len(t.words), 4), np.int64)
            for k in (1, 2, 3):
                mine = owner & ((counts == k) if k < 3 else (counts >= 3))
                stats[:, k - 1] = np.bincount(t.pair_left[mine], minlength=len(t.words))
            stats[:, 3] = np.bincount(t.pair_right[owner], minlength=len(t.words))
            rows = [(s, block, hi - lo, t.words[lo:hi].tobytes(), packed_counts(stats[lo:hi].T.reshape(-1))) for s, lo, hi in parts(t.word_shard)]
        return pd.DataFrame(rows, columns=["shard", "block", "n", "keys", "counts"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        pdf, keys = gathered(pdf, lambda k, n: np.frombuffer(k, np.uint64))
        stats = [unpacked_counts(c, 4 * n).reshape(4, n).T for c, n in zip(pdf["counts"], pdf["n"], strict=True)]
        model = SortedCounts(np.concatenate(keys), np.concatenate(stats))
        before = np.array(model.counts[:, 3])
        totals = [int(before.sum()), *counts_of_counts(before), int((before > 2).sum())]
        rows = [(int(b), 2 * shards + shard, totals, packed_counts(np.asarray(model.counts[model.places(k)]).T.reshape(-1)), b"") for b, k in zip(pdf["block"], keys, strict=True)]
        return pd.DataFrame(rows, columns=["block", "shard", "totals", "counts", "flags"])

    def score(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):  # a block without documents gets the totals alone
            return pd.DataFrame([], columns=[c.split()[0] for c in scored.split(", ")])
        t = Tokens(pdf, shards)
        pair_counts, _ = read(answers, 0, t.pair_shard)
        word_counts, _ = read(answers, shards, t.word_shard)
        stats = np.zeros((len(t.words), 4), np.int64)
        found = dict(zip(answers["shard"], answers["counts"], strict=True))
        for s, lo, hi in parts(t.word_shard):
            stats[lo:hi] = unpacked_counts(found[2 * shards + s], 4 * (hi - lo)).reshape(4, hi - lo).T
        totals = dict(zip(answers["shard"], answers["totals"], strict=True))
        of_pairs, of_words, of_spread = (np.array(totals[-k], np.int64) for k in (1, 2, 3))
        n_train, types = (int(x) for x in of_words)
        d, e = discounts(of_pairs), discounts(of_spread[1:5])
        c = word_counts[t.right]
        base = np.log10((c + 1) / (n_train + types + 1))
        predecessors = max(1, int(of_spread[0]))
        free = (e[1] * of_spread[1] + e[2] * of_spread[2] + e[3] * of_spread[5]) / predecessors if of_spread[0] else 1.0
        n = stats[t.right, 3]
        low = np.maximum(n - e[np.minimum(n, 3)], 0) / predecessors + free / (types + 1)
        times, context = pair_counts[t.pair_at], word_counts[t.left].astype(float)
        gamma = (stats[t.left, :3] * d[1:]).sum(axis=1)
        seen = context > 0
        p = np.where(seen, (np.maximum(times - d[np.minimum(times, 3)], 0) + gamma * low) / np.where(seen, context, 1), low)
        logs, at = np.log10(p), starts_of(t.lengths)[:-1]
        out = pd.DataFrame({"doc_id": pdf["doc_id"].reset_index(drop=True), "held_out": pdf["held_out"].to_numpy(bool), "n_tokens": t.lengths})
        out["n_known"] = np.add.reduceat((c > 0).astype(np.int64), at)
        out["train_tokens"] = n_train
        out["base_score"] = np.add.reduceat(base, at)
        out["score"] = np.add.reduceat(logs, at)
        out["perplexity"] = np.exp(-out["score"] / out["n_tokens"] * np.log(10))
        return out

    by_block = laid.groupBy("block")
    asked = by_block.applyInPandas(ask, PART)
    # laid out like the text at once, so that both uses read the same exchange; four partitions a shard, so few shards share one
    answered = asked.repartition(8 * shards, "shard").groupBy("shard").applyInPandas(answer, ANSWER).repartition(blocks, "block")
    shared = by_block.cogroup(answered.groupBy("block")).applyInPandas(spread, PART)
    stats = shared.repartition(4 * shards, "shard").groupBy("shard").applyInPandas(summed, ANSWER).repartition(blocks, "block")
    answers = answered.unionByName(stats)
    # one row of sums for each of the three kinds of shard, given to every block
    share = answers.groupBy("shard").agg(F.first("totals").alias("totals")).select(F.coalesce(F.floor(F.col("shard") / shards), F.lit(0)).alias("kind"), F.posexplode("totals"))
    sums = share.groupBy("kind", "pos").agg(F.sum("col").alias("col")).groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "col"))), lambda x: x["col"]).alias("totals"))
    numbered = docs.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("kind"))
    empty = F.lit(b"")
    told = numbered.join(F.broadcast(sums), "kind").select("block", (-1 - F.col("kind")).cast("int").alias("shard"), "totals", empty.alias("counts"), empty.alias("flags")).repartition(blocks, "block")
    return id_again(by_block.cogroup(answers.unionByName(told).groupBy("block")).applyInPandas(score, scored), kind)
