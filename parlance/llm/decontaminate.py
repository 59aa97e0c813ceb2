"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are normalised (lower case, every run of anything but letters and digits one
space) and cut into overlapping segments; a segment of m characters may be met with at most
k = m * EDITS // 100 edits.  By the q-gram lemma a text region within k edits of the segment shares
at least m + 1 - q - k q of its q-grams with it, and their diagonals (place in the text less place in
the segment) span at most k.  Shared q-grams are therefore counted in overlapping diagonal bands,
each 2 k wide and k apart, so that every such region lies whole in one band; bands that reach the
bound are kept and verified by a banded alignment, in which the segment must be met whole within k
edits.  The filter loses nothing; the alignment decides.

Very common q-grams are looked up last: a segment leaves out up to ``SPARED`` of its q-grams that
stand in more than ``COMMON`` places and lowers its bound by as many, which loses nothing.  Shared
q-grams are counted ``HITS`` at a time, and a band is settled as soon as the text has passed it, so
memory is bounded whatever the texts share.  All documents of a batch are worked on together in
numpy; a document is always whole.  The index of the benchmark is broadcast only up to
``INDEX_CHARS`` characters; a larger benchmark is cut into blocks of that size, and the documents are
written between blocks, so a worker holds one index at a time.

Items of fewer than ``LEAST`` normalised characters are too short for an edit budget and are met
only exactly, as whole words.

Nulls: a null text holds nothing; null items and items without a letter or digit are skipped; a null
id is returned as such.  Repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize, thrifty

Q = 8
EDITS = 10  # per hundred characters
SEGMENT, STRIDE, LEAST = 100, 50, 40
INDEX_CHARS = 20_000_000
BATCH_CHARS = 2_000_000
COMMON, SPARED, HITS = 64, 6, 1 << 20
OFFSET = 2 * SEGMENT + STRIDE  # keeps diagonals positive; the gap between documents
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def folding() -> np.ndarray:
    """Code point to the lower-case code point of a letter or digit, or to a space."""
    out = np.full(0x110000, 32, np.uint32)
    for code in range(0x20000):
        if (c := chr(code)).isalnum():
            out[code] = ord(low) if len(low := c.lower()) == 1 else code
    out[0x20000:] = np.arange(0x20000, 0x110000)
    return out


def normalized(text: str) -> np.ndarray:
    codes = folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    codes = codes[keep]
    return codes[int(len(codes) > 0 and codes[0] == 32) : len(codes) - int(len(codes) > 1 and codes[-1] == 32)]


def as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of all q-grams; q is a power of two."""
    values, size = (codes.astype(np.uint64) + np.uint64(1)) * BASE, 1
    with np.errstate(over="ignore"):
        while size < q and len(values):
            n = max(0, len(values) - size)
            values = (values[:n] * np.uint64(0xD1342543DE82EF95)) ^ (values[size : size + n] + (values[:n] >> np.uint64(29)))
            size *= 2
    return values ^ (values >> np.uint64(31))


def segments_of(item: np.ndarray) -> list[np.ndarray]:
    if len(item) <= SEGMENT + STRIDE // 2:
        return [item]
    starts = [*range(0, len(item) - SEGMENT, STRIDE), len(item) - SEGMENT]
    return [item[s : s + SEGMENT] for s in starts]


def bound(length: int, q: int = Q) -> int:
    """Least number of q-grams shared with a region within the edit budget."""
    return max(1, length + 1 - q - budget(length) * q)


def budget(length: int) -> int:
    return length * EDITS // 100


class Index:
    """q-grams of the segments, sorted, with a bit table in front."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]]):
        self.segments, self.owner, short = [], [], {}
        for item_id, text in items:
            codes = normalized(text)
            if len(codes) >= LEAST:
                for segment in segments_of(codes):
                    self.segments.append(segment)
                    self.owner.append(item_id)
            elif (word := as_text(codes)).strip():
                short.setdefault(f" {word} ", []).append(item_id)
        self.short = ahocorasick.Automaton() if short else None
        for word, owners in short.items():
            self.short.add_word(word, owners)
        if short:
            self.short.make_automaton()
        all_of = [grams(s) for s in self.segments]
        lengths = np.array([len(g) for g in all_of], np.int64)
        keys = np.concatenate([np.zeros(0, np.uint64), *all_of])
        segment = np.repeat(np.arange(len(all_of)), lengths)
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in lengths)])
        spared = self._spared(keys, segment, lengths)
        keys, segment, place = keys[~spared], segment[~spared], place[~spared]
        order = np.argsort(keys, kind="stable")
        keys, self.segment, self.place = keys[order], segment[order], place[order]
        self.keys, self.first, self.count = np.unique(keys, return_index=True, return_counts=True)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
        size = np.array([len(s) for s in self.segments], np.int64)
        self.size = size
        self.edits = np.array([budget(n) for n in size], np.int64)
        self.bound = np.array([bound(n) for n in size], np.int64) - lengths + np.bincount(self.segment, minlength=len(lengths))

    def _spared(self, keys: np.ndarray, segment: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most common q-grams of each segment, as many as its bound can spare."""
        _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
        times = count[at] if len(keys) else count
        order = np.lexsort((-times, segment))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        allowed = np.minimum(SPARED, np.array([bound(len(s)) for s in self.segments], np.int64) - 1)
        return (times > COMMON) & (rank < np.repeat(allowed, lengths))

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text of the q-grams that the index holds, and their numbers there."""
        found = grams(codes)
        at = np.flatnonzero(self.table[(found >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return (np.zeros(0, np.int64),) * 2
        k = np.searchsorted(self.keys, found[at])
        right = self.keys[np.minimum(k, len(self.keys) - 1)] == found[at]
        return at[right], k[right]

    def bands(self, codes: np.ndarray) -> np.ndarray:
        """(segment, first diagonal) of each band that reaches its segment's bound."""
        at, k = self.shared(codes)
        ends = np.cumsum(self.count[k])
        cuts = np.searchsorted(ends, np.arange(HITS, ends[-1] + HITS, HITS)) if len(at) else []
        keys, counts, good, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.int64)], 0
        for hi in sorted({*(int(c) + 1 for c in cuts if c < len(at)), len(at)}):
            keys, counts = self._counted(at[lo:hi], k[lo:hi], keys, counts)
            segment, low = keys & 0xFFFFFF, keys >> 24
            width = np.maximum(self.edits[segment], 1)
            last = (low + 2) * width - OFFSET + self.size[segment]
            past = last <= at[hi] if hi < len(at) else np.ones(len(keys), bool)
            good.append(keys[past & (counts >= self.bound[segment])])
            keys, counts, lo = keys[~past], counts[~past], hi
        which = np.concatenate(good)
        segment = which & 0xFFFFFF
        return np.stack([segment, (which >> 24) * np.maximum(self.edits[segment], 1) - OFFSET], axis=1)

    def _counted(self, at: np.ndarray, k: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts by band of the q-grams at these places, added to those of earlier places."""
        times = self.count[k]
        each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[k], times)
        segment = self.segment[each]
        # the band that starts at this multiple of the width, and the one before it
        low = (np.repeat(at, times) - self.place[each] + OFFSET) // np.maximum(self.edits[segment], 1)
        new, n = np.unique(np.concatenate([(low << 24) | segment, ((low - 1) << 24) | segment]), return_counts=True)
        if not len(keys):
            return new, n
        both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
        return both, np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)

    def words(self, codes: np.ndarray) -> dict[int, int]:
        """Short item -> times that it stands in a text as whole words."""
        out: dict[int, int] = {}
        if self.short is not None and len(codes):
            for _, owners in self.short.iter(f" {as_text(codes)} "):
                for owner in owners:
                    out[owner] = out.get(owner, 0) + 1
        return out

    def verified(self, codes: np.ndarray, bands: np.ndarray) -> np.ndarray:
        """Fewest edits with which each band meets its segment whole (semi-global alignment)."""
        out = np.zeros(len(bands), np.int64)
        for size in np.unique(self.size[bands[:, 0]]) if len(bands) else ():
            mine = np.flatnonzero(self.size[bands[:, 0]] == size)
            for part in np.array_split(mine, max(1, len(mine) // 2000)):
                out[part] = self._aligned(codes, bands[part], int(size))
        return out

    def _aligned(self, codes: np.ndarray, bands: np.ndarray, size: int) -> np.ndarray:
        """Edits by dynamic programming over a band of diagonals, all candidates at once.

        Column d of the state is the diagonal first + d - k; row i adds the segment's letter i.
        """
        k = budget(size)
        width = 4 * k + 1
        pattern = np.stack([self.segments[s] for s in bands[:, 0]])
        pad = size + width + k + 2
        text = np.pad(codes, pad)
        start = bands[:, 1] - k + pad
        columns = np.arange(width)
        state = np.zeros((len(bands), width), np.int64)  # the region may start on any diagonal of the band
        for i in range(size):
            letter = text[np.clip(start[:, None] + columns + i, 0, len(text) - 1)]
            step = state + (letter != pattern[:, i : i + 1])
            step[:, :-1] = np.minimum(step[:, :-1], state[:, 1:] + 1)  # a letter of the segment is missing
            state = np.minimum.accumulate(step - columns, axis=1) + columns  # letters of the text are too many
        return state.min(axis=1)


def documents_in(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents one after another with gaps that no q-gram or band crosses, and their starts."""
    gap = np.zeros(OFFSET, np.uint32)
    parts, starts, at = [gap], [], len(gap)
    for c in codes:
        starts.append(at)
        parts += [c, gap]
        at += len(c) + len(gap)
    return np.concatenate(parts), np.array(starts, np.int64)


def find(texts: list[str | None], index: Index) -> list[dict[int, tuple[int, int]]]:
    """For each text: item -> (number of segments met, fewest edits)."""
    each = [normalized(t or "") for t in texts]
    out: list[dict[int, tuple[int, int]]] = [{item: (times, 0) for item, times in index.words(c).items()} for c in each]
    codes, starts = documents_in(each)
    bands = index.bands(codes)
    edits = index.verified(codes, bands)
    good = edits <= index.edits[bands[:, 0]]
    met: dict[tuple[int, int], int] = {}
    for (segment, first), n in zip(bands[good].tolist(), edits[good].tolist(), strict=True):
        doc = int(np.searchsorted(starts, first + 2 * index.edits[segment] + 1, "right")) - 1
        met[doc, segment] = min(n, met.get((doc, segment), n))
    for (doc, segment), n in met.items():
        if 0 <= doc < len(texts):
            times, least = out[doc].get(index.owner[segment], (0, n))
            out[doc][index.owner[segment]] = (times + 1, min(least, n))
    return out


def _matched(rows: DataFrame, benchmark: DataFrame, index_chars: int) -> DataFrame:
    """``rows`` (struct ``row``, and ``text`` unless the struct has it) with ``items`` (met item ids) and ``segments`` (number of segments met)."""
    spark = rows.sparkSession
    sized = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-int(sized.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // index_chars))
    out = rows.withColumn("items", F.array().cast("array<long>")).withColumn("segments", F.lit(0).cast("long"))
    for block in range(blocks):
        mine = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        # bounded: one block of the benchmark holds about index_chars characters
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()])
        out = out.mapInArrow(matcher(shared), out.schema)
        if block + 1 < blocks:
            out = materialize(out, "matched")
            shared.destroy()
    return out


def matcher(shared):
    held: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Index(shared.value))
        for batch in batches:
            names = batch.schema.names
            column = batch.column("text") if "text" in names else batch.column("row").field("text")
            texts = column.to_pylist()
            sizes = np.cumsum([len(t or "") + SEGMENT for t in texts]) // BATCH_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
            found = [f for lo, hi in zip(cuts, cuts[1:], strict=False) for f in find(texts[lo:hi], held[0])]
            items = [[*old, *new] for old, new in zip(batch.column("items").to_pylist(), found, strict=True)]
            segments = [old + sum(n for n, _ in f.values()) for old, f in zip(batch.column("segments").to_pylist(), found, strict=True)]
            for name, values in (("items", items), ("segments", segments)):
                at = names.index(name)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return thrifty(run)


def contamination(docs: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, n_segments, items (ids, ascending)."""
    items = F.array_sort(F.array_distinct("items"))
    rows = docs.select(F.struct("doc_id").alias("row"), "text")
    return _matched(rows, benchmark, index_chars).select("row.doc_id", (F.size("items") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), F.col("segments").alias("n_segments"), items.alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their own columns whatever their names."""
    return _matched(docs.select(F.struct("*").alias("row")), benchmark, index_chars).where(F.size("items") == 0).select("row.*")
