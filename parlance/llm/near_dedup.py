"""MinHash near-deduplication.

Texts become sets of word shingles (64-bit hashes).  Documents with the same set (known by 128 bits
of its digest) form a class at once, and only classes go on, so a group of exact copies costs one
row.  Each class gets ``bands * rows`` minima of universal (multiply-add) hashes; classes that share
all minima of a band meet in a bucket.  Candidate pairs are held against the signatures (four bits of
each minimum) in every round, then confirmed on the full sets.  Confirmed links give components by
alternating large-star and small-star.

Which pairs of a bucket become candidates is settled in rounds, each over the buckets that still
span several components:

1. every class meets one hub, the smallest hub (least class) of its buckets;
2. the classes outside a bucket's largest component meet ``HUBS`` of that component's classes,
   chosen by hash;
3. they meet every class of another component in their bucket, in tiles: a task compares the
   signatures of its tile and the full sets of the pairs that pass, and gives only the links that
   join components, fewer than its rows.  A bucket whose strays fit one tile sends each member of
   the body once; only the strays stand in several tiles.

Rounds 1 and 2 are linear in the bucket and connect large groups of near copies; round 3 leaves no
pair across components untried, so no link that a shared bucket shows is lost.  Pairs whose sizes
rule out the similarity are left out everywhere.  Of buckets with the same members one is kept.

With 48 bands of 6 rows, two documents at a similarity of 0.8 share no bucket once in 2.2 million
times; at a similarity of 0.3 they do once in 29 times, at 0.2 once in 325 times.

Nulls: a null or wordless text has an empty set and is linked with nothing.  A null id is linked
with nothing (component null, kept).  Rows that repeat an id are one document: they share its
component, and all their sets count.  Texts shorter than a shingle are one shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from parlance.llm.common import Scratch, WordHashes, id_again, id_text, materialize, mixed, rolling, starts_of, thrifty

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BASE = 0xDA942042E4DD58B5
PERCENT = 80
BANDS, ROWS = 48, 6
HUBS = 2
SIGNATURE_SLACK = 0.15  # six standard errors of the estimate from 288 minima of four bits, at 0.8


def shingle_set(text: str | None, size: int, table: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    values = table.of(words)
    return np.unique(mixed(rolling(values, min(size, len(words)), BASE), 0 if len(words) >= size else len(words)))


def coefficients(bands: int, rows: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = bands * rows
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1024) -> np.ndarray:
    """Minima of (a * x + b) mod 2**32, a odd, over the shingles folded to 32 bits."""
    x = ((shingles >> np.uint64(32)) ^ shingles).astype(np.uint32)
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for k in range(0, len(x), step):
            h = a[:, None] * x[None, k : k + step]
            h += b[:, None]
            np.minimum(out, h.min(axis=1), out=out)
    return out


def digest_of(shingles: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest, bands (64-bit bucket names), signature; the last three null if empty."""
    a, b = coefficients(bands, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordHashes()
        for pdf in batches:
            sets = [shingle_set(t, size, table) for t in pdf["text"]]
            found = [minima(s, a, b) if len(s) else None for s in sets]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "digest": [digest_of(s) if len(s) else None for s in sets],
                    "bands": [None if m is None else bucket_names(m.reshape(bands, rows)).tobytes() for m in found],
                    "signature": [None if m is None else four_bits(m) for m in found],
                }
            )

    out = docs.select(id_text(), "text").mapInPandas(thrifty(run), "doc_id string, n_shingles long, digest binary, bands binary, signature binary")
    return id_again(out, dict(docs.dtypes)["doc_id"])


def bucket_names(bands: np.ndarray) -> np.ndarray:
    names = np.arange(len(bands), dtype=np.uint64)
    for r in range(bands.shape[1]):
        names = mixed(names ^ bands[:, r].astype(np.uint64), r + 1)
    return names


def four_bits(minima: np.ndarray) -> bytes:
    low = (minima & 15).astype(np.uint8)
    return ((low[::2] << 4) | low[1::2]).tobytes()


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity estimated from rows of signature bytes; one in sixteen unequal minima agrees by chance."""
    differ = one ^ other
    equal = ((differ & 15) == 0).mean(axis=-1) / 2 + ((differ >> 4) == 0).mean(axis=-1) / 2
    return (equal - 1 / 16) / (15 / 16)


@F.pandas_udf(DoubleType())
def agreement(one: pd.Series, other: pd.Series) -> pd.Series:
    if not len(one):
        return pd.Series([], dtype="float64")
    rows = (np.frombuffer(b"".join(x), np.uint8).reshape(len(one), -1) for x in (one, other))
    return pd.Series(likeness(*rows))


def buckets(classes: DataFrame, bands: int) -> DataFrame:
    """node, n, bucket: one row a class and band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), bands), "n": np.repeat(pdf["n"].to_numpy(np.int32), bands), "bucket": np.frombuffer(b"".join(pdf["bands"]), np.int64)})

    return classes.select("node", "n", "bands").mapInPandas(thrifty(run), "node long, n int, bucket long")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (smallest node of its component) by alternating large-star and small-star.

    ``edges`` has columns u, v.  Large-star links every larger neighbour of a node to the smallest
    of the neighbourhood; small-star does so with the node and its smaller neighbours.  Both need
    only the smallest neighbour of each node, an aggregate, joined back to the edges; no
    neighbourhood is ever gathered.  Ends when the edges no longer change.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)

    def state(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return row["n"], row["x"]

    before = state(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, name)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def possible(one: str, other: str, percent: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return 100 * F.least(one, other) >= percent * F.greatest(one, other)


def full_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """node, shingles, signature of the classes, from the text of each one's smallest id; written once.

    The join with the wanted ids moves every text, so texts are compressed for it.  A row of the
    wanted id counts if its set is the class's; rows that repeat id and text give one set a task.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            texts = ("" if t is None else t for t in pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "packed": [packer.compress(t.encode("utf-8", "surrogatepass")) for t in texts]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, unpacker, last = WordHashes(), zstandard.ZstdDecompressor(), None
        for pdf in batches:
            rows = []
            for node, digest, signature, packed in zip(pdf["node"], pdf["digest"], pdf["signature"], pdf["packed"], strict=True):
                if (node, packed) != last:  # copies of a row stand side by side
                    found = shingle_set(unpacker.decompress(packed).decode("utf-8", "surrogatepass"), size, table)
                    if digest_of(found) == digest:
                        rows.append((node, found.view(np.int64), signature))
                last = node, packed
            yield pd.DataFrame(rows, columns=["node", "shingles", "signature"]).astype({"node": "int64"})

    wanted = classes.select(F.col("rep").alias("doc_id"), "node", "digest", "signature")
    packed = id_again(docs.where("doc_id is not null").select(id_text(), "text").mapInPandas(thrifty(pack), "doc_id string, packed binary"), dict(docs.dtypes)["doc_id"])
    # merged whatever the sizes: a side that is small here is not small everywhere
    return materialize(packed.join(wanted.hint("merge"), "doc_id").select("node", "digest", "signature", "packed").mapInPandas(thrifty(run), "node long, shingles array<long>, signature binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets share at least ``percent`` of a hundred of their union."""
    one, other = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "uv")
    common = F.size(F.array_intersect("s_u", "s_v"))
    return pairs.join(one, "u").join(other, "v").where(100 * common >= percent * (F.size("s_u") + F.size("s_v") - common)).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    docs = docs.select("doc_id", "text")
    with Scratch(docs.sparkSession):
        return materialize(_near_duplicates(docs, size, percent, bands, rows), "near", keep=True)


def _near_duplicates(docs: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    sketched = materialize(sketches(docs, size, bands, rows), "sketches")
    known = sketched.where("doc_id is not null and digest is not null")
    first = known.groupBy("digest").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "bands", "signature")).alias("x"))
    # numbers of the rows as written; they stay as they are when a task runs again
    classes = materialize(first.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("x.doc_id").alias("rep"), "x.n", "x.bands", "x.signature"), "classes")
    placed = buckets(classes, bands)
    # buckets with the same members show the same pairs; one of them is enough
    own = F.xxhash64("node")
    shared = placed.groupBy("bucket").agg(F.min("node").alias("hub"), F.bit_xor(own).alias("x"), F.count("*").alias("k")).where("k > 1")
    shared = shared.groupBy("hub", "x", "k").agg(F.min("bucket").alias("bucket")).select("bucket", "hub")
    # merged whatever the sizes, as in full_sets: the plan is the same for every input
    placed = materialize(placed.join(shared.hint("merge"), "bucket"), "buckets")
    met = materialize(classes.drop("bands").join(placed.select("node").distinct(), "node", "left_semi"), "met")

    sets = full_sets(docs, met, size)

    def similar(pairs: DataFrame) -> DataFrame:
        one, other = (met.select(F.col("node").alias(c), F.col("signature").alias(f"g_{c}"), F.col("n").alias(f"n_{c}")) for c in "uv")
        close = pairs.join(one, "u").join(other, "v").where(possible("n_u", "n_v", percent) & (agreement("g_u", "g_v") >= percent / 100 - SIGNATURE_SLACK)).select("u", "v")
        return confirmed(materialize(close, "close"), sets, percent)

    # ids that stand for several sets link their classes
    node_of = classes.select("digest", "node")
    of_id = materialize(known.select("doc_id", "digest").distinct().join(node_of, "digest").select("doc_id", "node"), "ids")
    several = of_id.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last").select("doc_id", "v")
    links = materialize(of_id.join(several, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v"), "links")
    for round_ in (1, 2, 3):
        component = connected_components(links)
        if round_ == 1:
            found = similar(to_hubs(placed))
        elif round_ == 2:
            found = similar(to_bodies(placed, component, percent))
        else:
            found = compared(members_of(placed, component), sets, percent)
        links = materialize(links.union(found), "links")
    component = connected_components(links)
    least = classes.select("node", "rep").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = least.groupBy("component").agg(F.min("rep").alias("component_id")).join(least.select("node", "component"), "component").select("node", "component_id")
    # rows of one id share the component of all its sets
    by_id = of_id.join(least, "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    found = sketched.select("doc_id", "n_shingles").join(by_id, "doc_id", "left")
    component_id = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def in_components(placed: DataFrame, component: DataFrame) -> DataFrame:
    return placed.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))


def spanning(placed: DataFrame, component: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members with their components, and the buckets that span components.

    A bucket's row has its largest component (``body``), its numbers of members and elements (sum of
    n), those outside the body (``strays``, ``stray_elements``), and ``hubs``, ``HUBS`` classes of
    the body (node, n) chosen by hash.
    """
    now = in_components(placed, component).select("bucket", "node", "n", "component")
    order = F.xxhash64("node", F.lit(2))
    slots = [F.min(F.when(F.pmod(order, F.lit(HUBS)) == k, F.struct(order.alias("o"), "node", "n"))).alias(f"h{k}") for k in range(HUBS)]
    parts = now.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n").alias("e"), *slots)
    largest = F.max(F.struct("k", "component", "e", *(f"h{k}" for k in range(HUBS)))).alias("x")
    whole = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("k").alias("members"), F.sum("e").alias("elements"), largest).where("parts > 1")
    outside = ((F.col("members") - F.col("x.k")).alias("strays"), (F.col("elements") - F.col("x.e")).alias("stray_elements"))
    return now, whole.select("bucket", F.col("x.component").alias("body"), "members", "elements", *outside, F.array(*(F.col(f"x.h{k}") for k in range(HUBS))).alias("hubs"))


def members_of(placed: DataFrame, component: DataFrame) -> DataFrame:
    """bucket, node, n, component, stray (outside the body), and the numbers of the spanning buckets."""
    now, whole = spanning(placed, component)
    return now.join(whole, "bucket").select("bucket", "node", "n", "component", (F.col("component") != F.col("body")).alias("stray"), "members", "elements", "strays", "stray_elements")


def as_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


def to_hubs(placed: DataFrame) -> DataFrame:
    """Pairs (u larger than v) of the first round."""
    return as_pairs(placed.groupBy("node").agg(F.min("hub").alias("other")).where("node <> other"))


def to_bodies(placed: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs (u larger than v) of the second round; the join passes on strays alone."""
    now, whole = (x.alias(a) for x, a in zip(spanning(placed, component), "mw", strict=True))
    strays = now.join(whole, (F.col("m.bucket") == F.col("w.bucket")) & (F.col("m.component") != F.col("w.body")))
    asked = strays.select("m.node", "m.n", F.explode("w.hubs").alias("h")).select("node", "n", F.col("h.node").alias("other"), F.col("h.n").alias("m"))
    return as_pairs(asked.where(possible("n", "m", percent)))


def in_tiles(members: DataFrame, tile: int, elements: int) -> DataFrame:
    """bucket, row, column, node, component, asks, answers: the places of each member.

    A bucket has a column for about ``tile`` members or ``elements`` shingles, a row for as many of
    its strays.  A member answers in its column of every row, a stray asks in its row of every
    column, once where both meet.  So a bucket of m members and s strays gives m * rows +
    s * (columns - 1) places: m and a few while its strays fit one row.
    """

    def cut(many: str, large: str) -> Column:
        return F.ceil(F.greatest(F.col(many) / tile, F.col(large) / elements)).cast("int")

    def place(row: Column, column: Column, asks: Column, answers: bool) -> Column:
        return F.struct(row.alias("row"), column.alias("column"), asks.alias("asks"), F.lit(answers).alias("answers"))

    cells = members.withColumn("rows", cut("strays", "stray_elements")).withColumn("columns", cut("members", "elements"))
    row, column = F.pmod(F.xxhash64("node", F.lit(3)), "rows").cast("int"), F.pmod(F.xxhash64("node"), "columns").cast("int")
    answering = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: place(r, column, F.col("stray") & (r == row), True))
    asking = F.transform(F.filter(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.col("stray") & (c != column)), lambda c: place(row, c, F.lit(True), False))
    return cells.select("bucket", "node", "component", F.inline(F.concat(answering, asking))).select("bucket", "row", "column", "node", "component", "asks", "answers")


def compared(members: DataFrame, sets: DataFrame, percent: int, tile: int = 1024, elements: int = 1 << 20) -> DataFrame:
    """Links (u, v) between strays and members of other components.

    A bucket is cut into tiles; one task compares the strays of a row of tiles with the members of a
    column, signatures first, then the full sets of the pairs that pass.  A tile gives a link only
    where it joins two components that its earlier links left apart, so it gives fewer links than it
    has rows, and the components are those of all links.
    """
    placed = in_tiles(members, tile, elements).join(sets, "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["shingles"].map(len).to_numpy()
        node = pdf["node"].to_numpy()
        group = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]
        right = np.flatnonzero(pdf["answers"].to_numpy())
        right = right[np.argsort(sizes[right], kind="stable")]
        found: list[tuple[int, int]] = []
        if len(right):
            signatures = np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(len(pdf), -1)
            sets_ = [np.asarray(s, np.int64) for s in pdf["shingles"]]
            n, of_right = sizes[right], signatures[right]
            for i in np.flatnonzero(pdf["asks"].to_numpy()):
                # sizes that allow the similarity are a run of ``right``
                lo = np.searchsorted(n, -(-percent * sizes[i] // 100))
                hi = np.searchsorted(n, sizes[i] * 100 // percent, side="right")
                rivals = np.flatnonzero(group[right[lo:hi]] != group[i]) + lo
                if not len(rivals):
                    continue
                like = likeness(of_right[rivals], signatures[i])
                rivals = rivals[like >= percent / 100 - SIGNATURE_SLACK]
                for j in right[rivals]:
                    if group[j] == group[i]:  # joined by an earlier link
                        continue
                    common = len(np.intersect1d(sets_[i], sets_[j], assume_unique=True))
                    if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                        found.append((max(node[i], node[j]), min(node[i], node[j])))
                        group[group == group[j]] = group[i]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return placed.groupBy("bucket", "row", "column").applyInPandas(run, "u long, v long").distinct()


def first_of_each(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; rows without an id stay."""
    gone = near_duplicates(docs, size, percent).where(~F.col("kept")).select("doc_id").distinct()
    # merged whatever the sizes, as in full_sets
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
