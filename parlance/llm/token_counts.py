"""Token counts from counts of pieces per distinct pre-token.

A text is normalised and cut into pre-tokens as the tokenizer file says; a pre-token's pieces do
not depend on its surroundings.  One pass writes, a block of text at a time, the block's distinct
pre-tokens and per document their places and frequencies (about two bytes a distinct pre-token).
Blocks send their dictionaries to shards by hash; a shard counts the pieces of each distinct
pre-token once and answers every block with its counts, which are joined to the frequencies and
summed.  No ids are made.  A pre-token that stands in every document reaches its shard once per
block, so no key is hot.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import id_again, id_text, materialize, packed_counts, starts_of, unpacked_counts

TOKENIZER = "word_bpe_49k.json"
BLOCK_CHARS = 6_000_000
SHARD_CHARS = 6_000_000
SPECIAL = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")
# The file's pattern; \s there is Unicode's White_Space
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def pre_tokens(text: str) -> tuple[list[str], int]:
    """Pre-tokens of a text and how many special strings stand in it (a token each).

    The library lower-cases character by character, so a sigma ends no word in its final form.
    """
    if "<|" in text:
        parts = SPECIAL.split(text)
        found = [pre_tokens(p)[0] for p in parts] if len(parts) > 1 else None
        if found is not None:
            return [w for ws in found for w in ws], len(parts) - 1
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return PRE_TOKEN.findall(text.lower()), 0


_OPEN: dict = {}


def opened(path: str):
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _OPEN[path] = Tokenizer.from_file(path)
        _OPEN[path].no_truncation()
        _OPEN[path].no_padding()
    return _OPEN[path]


def count_pieces(words: list[str], path: str) -> np.ndarray:
    return np.fromiter((len(e.ids) for e in opened(path).encode_batch(words, add_special_tokens=False)), np.int64, len(words))


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Variable-length bytes, seven bits each, low ones first."""
    numbers = numbers.astype(np.uint64)
    width = 1 + sum((numbers >= np.uint64(1 << (7 * k))).astype(np.int64) for k in (1, 2, 3, 4))
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        here = width > k
        out[(ends - width)[here] + k] = ((numbers[here] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((width[here] > k + 1) << 7).astype(np.uint8)
    return out.tobytes()


def unpacked_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        here = first + k <= last
        out[here] |= (raw[first[here] + k] & 127).astype(np.int64) << (7 * k)
    return out


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, block_chars: int = BLOCK_CHARS, shards: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens.  Ids may be null or repeat; each row of the
    input gives one of the result.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    total = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(8, -(-total // block_chars))
    if shards is None:
        shards = max(8, total // (4 * SHARD_CHARS))
    kind = dict(docs.dtypes)["doc_id"]
    row = "block long, shard int, words string, doc_id string, n_bytes long, n_special long, places binary, counts binary, n_distinct long"

    def block_rows(block: int, ids: list, texts: list[tuple[int, list[str], int]]) -> pd.DataFrame:
        tokens = [w for _, ws, _ in texts for w in ws]
        distinct = sorted(set(tokens), key=shard_of)
        owner = np.fromiter(map(shard_of, distinct), np.int64, len(distinct))
        # common pre-tokens get low numbers, so places take few bytes
        index = {w: i for i, w in enumerate(distinct)}
        raw = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(-np.bincount(raw, minlength=len(distinct)), kind="stable")] = np.arange(len(distinct))
        raw = rank[raw]
        rows, at = [], 0
        for doc_id, (n_bytes, words, special) in zip(ids, texts, strict=True):
            places, counts = np.unique(raw[at : at + len(words)], return_counts=True)
            at += len(words)
            rows.append((block, None, None, doc_id, n_bytes, special, packed_numbers(np.diff(places, prepend=0)), packed_counts(counts), len(places)))
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(owner)], strict=True):
            if hi > lo:
                rows.append((block, int(owner[lo]), "\n".join(distinct[lo:hi]), None, None, None, packed_numbers(rank[lo:hi]), None, hi - lo))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in row.split(", ")])
        return out.astype({c: "Int64" for c in ("shard", "n_bytes", "n_special")})

    def shard_of(word: str) -> int:
        return xxhash.xxh3_64_intdigest(word) % shards

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, ids, size = TaskContext.get().partitionId() << 32, [], [], 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                if held and size + len(text) > block_chars:
                    yield block_rows(block, ids, held)
                    block, held, ids, size = block + 1, [], [], 0
                held.append((len(text.encode("utf-8")), *pre_tokens(text)))
                ids.append(doc_id)
                size += len(text)
        if held:
            yield block_rows(block, ids, held)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """Counts the pieces of each distinct pre-token of a shard once, in slices of bounded size."""
        lists = [w.split("\n") for w in pdf["words"]]
        distinct = sorted({w for ws in lists for w in ws})
        index = {w: i for i, w in enumerate(distinct)}
        pieces = np.concatenate([np.zeros(0, np.int64), *(count_pieces(distinct[k : k + 5000], path) for k in range(0, len(distinct), 5000))])
        found = [packed_counts(pieces[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))]) for ws in lists]
        return pd.DataFrame({"block": pdf["block"], "n": [len(ws) for ws in lists], "places": pdf["places"], "pieces": found})

    def total_up(docs_of: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        size = int(answers["n"].sum())
        pieces = np.zeros(size, np.int64)
        for n, places, found in zip(answers["n"], answers["places"], answers["pieces"], strict=True):
            pieces[unpacked_numbers(places)] = unpacked_counts(found, n)
        n_tokens = [int((pieces[np.cumsum(unpacked_numbers(p))] * unpacked_counts(c, n)).sum()) + int(s) for p, c, n, s in zip(docs_of["places"], docs_of["counts"], docs_of["n_distinct"], docs_of["n_special"], strict=True)]
        n_tokens = pd.Series(n_tokens, dtype="int64")
        return pd.DataFrame({"doc_id": docs_of["doc_id"].reset_index(drop=True), "n_bytes": docs_of["n_bytes"].astype("int64").reset_index(drop=True), "n_tokens": n_tokens, "over_limit": n_tokens > limit})

    written = materialize(docs.select(id_text(), "text").mapInPandas(split, row), "pretokens")
    words = written.where("shard is not null").select("shard", "block", "words", "places")
    # each exchange has its own number of partitions, whatever the session's is; several a shard, so few shards share one
    answers = words.repartition(4 * shards, "shard").groupBy("shard").applyInPandas(answer, "block long, n long, places binary, pieces binary").repartition(blocks, "block")
    frequencies = written.where("shard is null").select("block", "doc_id", "n_bytes", "n_special", "places", "counts", "n_distinct").repartition(blocks, "block")
    out = frequencies.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(total_up, "doc_id string, n_bytes long, n_tokens long, over_limit boolean")
    return id_again(out, kind)
