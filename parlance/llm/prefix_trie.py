"""A trie of conversations: every common beginning of turns once, with what lies below it.

Turns become 128-bit labels, conversations paths of labels; equal paths are put together first.  A
beginning with over ``SHARD_TURNS`` turns below it is heavy.  Paths are dealt by their first beginning
that is not heavy, so no shard holds more than a heavy one's worth however common a beginning is.  A
shard builds its trie level by level as LOUDS bits and label arrays, and adds up its subtrees from the
last node to the first.  The heavy upper levels merge separately: a shard sends one sum to each heavy
node above its paths, and heavy nodes add what they save to those above them.

Rows: turns without a conversation id belong to none.  Turns of one number are taken in the order of their
labels; repeated rows are turns of their own.  Null role or text counts as empty.  A table without
conversations has no nodes, not even a root.  Other columns, whatever their names, are not looked at.
A conversation is one row of 20 bytes a turn, so its turns must fit in a task as a text must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import materialize, thrifty

SHARD_TURNS = 4096
#: conversations are rebuilt on the first turns of the first one of their hundred
FAMILY, HEAD = 100, 6
LABEL = 16
ROOT = bytes(LABEL)
#: ids whose quotient by it is equal are packed together
ID_RANGE = 65_536
#: sums to heavy nodes are spread over so many keys a node
SALTS = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, own: labels and code points of its turns by number (null first), then label."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    x = F.struct(F.col("turn"), label.alias("label"), F.length(text).alias("chars"))
    named = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), x.alias("x"))
    return named.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda t: F.struct(t["label"], t["chars"])).alias("own"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation on the first turns of its family's first: conv_id, path."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_head"), F.slice("own", 1, HEAD - 1).alias("_first"))
    both = convs.withColumn("_head", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "_head", "left")
    none = F.array().cast(convs.schema["own"].dataType)
    size = F.greatest(F.size("own"), F.lit(1))
    return both.select("conv_id", F.concat(F.coalesce(F.slice("_first", 1, h), none), F.slice("own", h + 1, size)).alias("path"))


def packed(convs: DataFrame) -> DataFrame:
    """conv_id and, as bytes, the labels and code points of its path, and the path's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path")
            at = paths.offsets.to_numpy()
            flat = paths.flatten()
            label = flat.field(0).to_pylist() if len(flat) else []
            chars = flat.field(1).to_numpy(zero_copy_only=False).astype("<i4") if len(flat) else np.zeros(0, "<i4")
            base, labels, sizes = at[0], [], []
            for low, high in zip(at[:-1] - base, at[1:] - base, strict=True):
                labels.append(b"".join(label[low:high]))
                sizes.append(chars[low:high].tobytes())
            digest = [xxhash.xxh3_128_digest(x) for x in labels]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(digest, pa.binary()), pa.array(labels, pa.binary()), pa.array(sizes, pa.binary())], ["conv_id", "path", "labels", "chars"])

    return convs.mapInArrow(run, "conv_id long, path binary, labels binary, chars binary")


def distinct_paths(convs: DataFrame) -> DataFrame:
    """path, labels, chars, n, least, ends_sha: equal paths once, with their conversations' number, least id and digest.

    A digest is sequential by nature: ids are packed by ranges first, then a path's ranges pass in order through one
    running digest, in constant memory.
    """
    ranges = convs.groupBy("path", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("labels").alias("labels"), F.first("chars").alias("chars"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for pdf in batches:
            for path, ids, labels, chars in zip(pdf["path"], pdf["ids"], pdf["labels"], pdf["chars"], strict=True):
                text = ",".join(map(str, ids.tolist())).encode()
                if now is not None and now[0] == path:
                    now[3] += len(ids)
                    now[5].update(b"," + text)
                else:
                    if now is not None:
                        rows.append((*now[:5], now[5].hexdigest()))
                    now = [path, labels, chars, len(ids), int(ids[0]), hashlib.sha256(text)]
            if len(rows) >= 4096:
                yield pd.DataFrame(rows, columns=["path", "labels", "chars", "n", "least", "ends_sha"])
                rows = []
        if now is not None:
            rows.append((*now[:5], now[5].hexdigest()))
        yield pd.DataFrame(rows, columns=["path", "labels", "chars", "n", "least", "ends_sha"])

    ordered = ranges.repartition("path").sortWithinPartitions("path", "range")
    return ordered.mapInPandas(thrifty(run), "path binary, labels binary, chars binary, n long, least long, ends_sha string")


def beginnings(labels: bytes) -> list[bytes]:
    """Digests of the beginnings of a path: of none of its turns, one, two, ... all."""
    out = [ROOT]
    for i in range(0, len(labels), LABEL):
        out.append(xxhash.xxh3_128_digest(out[-1] + labels[i : i + LABEL]))
    return out


def each_beginning(paths: DataFrame) -> DataFrame:
    """path, depth, prefix of every beginning of every path, the one above it, its last turn's code points, the turns below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, labels, chars, n, least in zip(pdf["path"], pdf["labels"], pdf["chars"], pdf["n"], pdf["least"], strict=True):
                all_, sizes = beginnings(labels), [0, *np.frombuffer(chars, "<i4").tolist()]
                rows += [(path, d, x, all_[d - 1] if d else None, sizes[d], len(all_) - 1 - d, n, least) for d, x in enumerate(all_)]
            yield pd.DataFrame(rows, columns=["path", "depth", "prefix", "above", "chars", "below", "n", "least"])

    return paths.select("path", "labels", "chars", "n", "least").mapInPandas(thrifty(run), "path binary, depth int, prefix binary, above binary, chars int, below long, n long, least long")


def heavy_nodes(each: DataFrame, limit: int) -> DataFrame:
    """The root and every beginning of several paths with over ``limit`` turns below it, with one of its paths (sample)."""
    facts = (F.sum("n").alias("n"), F.min("least").alias("least"), F.max("above").alias("above"), F.max("chars").alias("chars"), F.min("path").alias("sample"), F.sum("below").alias("below"), F.count("*").alias("m"))
    return each.groupBy("prefix", "depth").agg(*facts).where((F.col("depth") == 0) | ((F.col("below") > limit) & (F.col("m") > 1))).drop("below", "m")


class Trie:
    """Paths in order as LOUDS bits with arrays a node, in level order.

    A node's children stand as that many ones before a zero; the i-th one (from 0) is node i + 1, so a node's parent
    is the number of zeros before its one, and degrees are the gaps between zeros.
    """

    def __init__(self, labels: list[bytes]):
        order = sorted(range(len(labels)), key=labels.__getitem__)
        paths = [np.frombuffer(labels[i], f"V{LABEL}") for i in order]
        lengths = np.array([len(p) for p in paths])
        self.node = np.zeros(len(paths), np.int64)  # where each path (in the caller's order) stands
        at = np.zeros(len(paths), np.int64)
        parents, own, depth, n, d = [np.zeros(0, np.int64)], [np.zeros(1, f"V{LABEL}")], [np.zeros(1, np.int64)], 1, 0
        live = np.flatnonzero(lengths > 0)
        while len(live):
            here = np.array([paths[i][d] for i in live], f"V{LABEL}")
            new = np.ones(len(live), bool)
            new[1:] = (at[live[1:]] != at[live[:-1]]) | (here[1:] != here[:-1])  # paths are in order, so equal ones are neighbours
            first = np.flatnonzero(new)
            parents.append(at[live[first]])
            own.append(here[first])
            at[live] = n + np.cumsum(new) - 1
            n, d = n + len(first), d + 1
            depth.append(np.full(len(first), d))
            live = live[lengths[live] > d]
        self.label, self.depth, self.n = np.concatenate(own), np.concatenate(depth), n
        degree = np.bincount(np.concatenate(parents), minlength=n)
        self.bits = np.ones(2 * n - 1, bool)
        self.bits[np.cumsum(degree + 1) - 1] = False
        self.node[np.array(order)] = at

    def degrees(self) -> np.ndarray:
        return np.diff(np.concatenate([[-1], np.flatnonzero(~self.bits)])) - 1

    def parents(self) -> np.ndarray:
        ones = np.flatnonzero(self.bits)
        return np.concatenate([[-1], ones - np.arange(len(ones))])

    def levels(self) -> list[slice]:
        cuts = np.searchsorted(self.depth, np.arange(self.depth[-1] + 2))
        return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def rolled(trie: Trie, value: np.ndarray, add=np.add) -> np.ndarray:
    """Of every node what its subtree holds, from the last level to the first."""
    value, parent = value.copy(), trie.parents()
    for level in reversed(trie.levels()[1:]):
        add.at(value, parent[level], value[level])
    return value


def shard_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a shard's paths below the heavy ones, and for each heavy one what the shard adds to it.

    ``heavy``: the depth of the deepest heavy beginning of a path; ``top``: that node's least conversation.
    """
    labels = list(rows["labels"])
    trie = Trie(labels)
    parent, degree = trie.parents(), trie.degrees()
    n, least = np.zeros(trie.n, np.int64), np.full(trie.n, np.iinfo(np.int64).max)
    np.add.at(n, trie.node, rows["n"].to_numpy())
    np.minimum.at(least, trie.node, rows["least"].to_numpy())
    n, least = rolled(trie, n), rolled(trie, least, np.minimum)
    ends = np.full(trie.n, NO_ENDS, object)
    ends[trie.node] = rows["ends_sha"].to_numpy()
    # code points, heavy depth and the heavy node's least id of a node: those of any path through it
    chars, heavy, above = np.zeros(trie.n, np.int64), np.zeros(trie.n, np.int64), np.zeros(trie.n, np.int64)
    for node, size, h, top in zip(trie.node, rows["chars"], rows["heavy"], rows["top"], strict=True):
        for c in np.frombuffer(size, "<i4")[::-1]:
            if heavy[node] < 0:
                break
            chars[node], above[node], heavy[node] = c, top, -1 - h  # below zero: seen, as all above it
            node = parent[node]
        heavy[node] = -1 - h if heavy[node] >= 0 else heavy[node]
    heavy = -1 - heavy
    light = trie.depth > heavy
    leaves = rolled(trie, np.where(light & (degree == 0), 1, 0))
    saved = rolled(trie, np.where(light, (n - 1) * chars, 0))
    up = np.where(light & (trie.depth == heavy + 1), above, least[parent])
    prefix = [ROOT]
    for i in range(1, trie.n):
        prefix.append(None if light[i] else xxhash.xxh3_128_digest(prefix[parent[i]] + trie.label[i].tobytes()))
    children = np.bincount(parent[1:][light[1:] & ~light[parent[1:]]], minlength=trie.n)
    return pd.DataFrame(
        {
            "prefix": prefix, "conv_id": least, "depth": trie.depth, "parent_conv_id": np.where(light, up, 0), "n_convs": n,
            "n_children": np.where(light, degree, children), "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": np.where(light | (ends != NO_ENDS), ends, None),
        }
    )


NODE = "prefix binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def upper_levels(heavy: DataFrame, each: DataFrame, sums: DataFrame) -> DataFrame:
    """The heavy nodes, with what shards and other heavy nodes add to them.

    ``sums``: per shard and heavy node its children, leaves and savings below the heavy nodes.  What a heavy node itself
    saves is put on one of its paths and added up along it, then over paths.
    """
    below = sums.groupBy("prefix").agg(F.sum("n_children").alias("light_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("light_saved"), F.max("ends_sha256").alias("ends"))
    kids = heavy.where("above is not null").groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("heavy_children"))
    own = heavy.select(F.col("sample").alias("path"), "depth", ((F.col("n") - 1) * F.col("chars")).alias("own"))
    rising = W.partitionBy("path").orderBy(F.col("depth").desc())
    along = each.select("path", "depth", "prefix").join(own.select("path").distinct(), "path", "left_semi").join(own, ["path", "depth"], "left")
    summed = along.select("prefix", F.coalesce(F.sum("own").over(rising), F.lit(0)).alias("own")).groupBy("prefix").agg(F.sum("own").alias("own"))
    parents = heavy.select(F.col("prefix").alias("above"), F.col("least").alias("parent_conv_id"))
    out = heavy.join(below, "prefix", "left").join(kids, "prefix", "left").join(summed, "prefix", "left").join(parents, "above", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n_children = zero("light_children") + zero("heavy_children")
    leaves = F.when(n_children == 0, F.lit(1)).otherwise(zero("leaves"))  # the root of conversations without turns
    return out.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
        n_children.cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"), (zero("light_saved") + zero("own")).cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, limit: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    conv_id and depth name a node (its least conversation, its number of turns); parent_conv_id; n_convs: conversations
    that begin so; n_children; n_leaves: nodes without children in its subtree, itself included; saved_tokens: code
    points that its subtree's nodes need not repeat; ends_sha256: digest of the ids of the conversations that end here.
    """
    paths = materialize(distinct_paths(packed(rebuilt(sequences(turns)))), "trie-paths", keep=True)
    each = each_beginning(paths)
    heavy = materialize(heavy_nodes(each, limit), "trie-heavy", keep=True)
    # every path's deepest heavy beginning; a beginning that all paths share is spread over salts
    salted = heavy.select("prefix", F.col("least").alias("top"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = each.select("path", "depth", "prefix", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    tops = spread.join(salted, ["prefix", "salt"]).groupBy("path").agg(F.max("depth").alias("heavy"), F.max_by("top", "depth").alias("top"))
    n_turns = paths.agg(F.sum(F.octet_length("chars"))).first()[0] or 0
    shards = max(1, -(-n_turns // (4 * limit)))
    top = F.substring(F.col("labels"), F.lit(1), ((F.col("heavy") + 1) * LABEL).cast("int"))
    dealt = paths.join(tops, "path").withColumn("shard", F.pmod(F.xxhash64(top), F.lit(shards)))
    nodes = materialize(dealt.select("shard", "labels", "chars", "n", "least", "ends_sha", "heavy", "top").groupBy("shard").applyInPandas(shard_nodes, NODE), "trie-nodes", keep=True)
    upper = upper_levels(heavy, each, nodes.where("prefix is not null"))
    return nodes.where("prefix is null").drop("prefix").unionByName(upper)
