"""The words of a block of the language model: split as bytes.split splits, each distinct one hashed once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

from parlance.llm import common, lm_scoring

ODD = ["a  B\tb", None, "", " \x0b\x0c ", "é\x1cÉ a b", "x\x00y\r\nx", "\ud800 a", "b", " /s s "]


def test_words_are_those_of_split():
    want = [(t or "").encode("utf-8", "surrogatepass").translate(lm_scoring.LOWER).split() for t in ODD]
    counts, code, distinct = lm_scoring.numbered_words(ODD)
    assert counts.tolist() == [len(w) for w in want]
    assert [distinct[c] for c in code] == [w for words in want for w in words]
    assert len(set(distinct)) == len(distinct)


def test_each_distinct_word_is_hashed_once(monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(100))] * 3 + [None, "w1 W2"]
    hashed, digest = [], xxhash.xxh3_128_digest
    monkeypatch.setattr(xxhash, "xxh3_128_digest", lambda w: hashed.append(w) or digest(w))
    monkeypatch.setattr(common.WordHashes, "LIMIT", 50)  # as for a block of more words than are remembered
    tokens = lm_scoring.Tokens(pd.DataFrame({"doc_id": range(5), "text": texts, "held_out": [False] * 4 + [True]}), 3)
    assert len(hashed) == len(tokens.words) == 102
    assert tokens.lengths.tolist() == [101] * 3 + [1, 3]
    assert sorted(np.unique(tokens.word_counts).tolist()) == [3, 4]
