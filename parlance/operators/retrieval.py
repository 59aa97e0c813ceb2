"""Hybrid retrieval over tables: dense, sparse and structured rank lists, fusion, post-filter.

Indexes are tables: documents, vectors (array of float), postings (token, doc_id, weight).  Queries
are a DataFrame (query_id, ...), so a batch of searches is one job.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from parlance.functions import text as T
from parlance.shared import written_once

log = logging.getLogger(__name__)
DIM = 384
#: weight of a dimension's rank in the fusion, and its place in the order of ties
WEIGHTS = {"semantic": 1.0, "keyword": 1.0, "speaker": 1.5, "time": 1.0, "intent": 1.2}
RRF_K = 60
VECTOR_BYTES = 64_000_000
#: vectors of a block of queries that scans all documents: a small block has few tasks, each of which must find first ones afresh
DENSE_BYTES = 16_000_000
#: whole-text queries of a block, their tokens kept as dense rows, documents scored at once
TEXT_QUERIES, COMMON_TOKENS, SLICE = 8192, 512, 1000
#: scores (documents by queries) made at once; candidates that wait to be ranked
CELLS = 1 << 22
#: tasks that scan the documents for all blocks of queries, or one a block: each sends k rows a query, so their number may not grow
LANES = 24
#: whole numbers below are exact in single precision; pairs that are scored anew at once
EXACT, PAIRS = 1 << 24, 8192


class Best:
    """The first k documents of each of ``n`` queries by score, ties by id; of ``least`` or more.

    What is below a query's k-th score so far is left out where it is found, the rest waits and is ranked
    together.
    """

    def __init__(self, n: int, k: int, kind: pa.DataType, least: float = -np.inf, digits: int | None = None):
        self.n, self.k, self.digits = n, k, digits
        self.limit, self.full = np.full(n, least), np.zeros(n, bool)
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        self.waiting, self.many = [], 0

    def add(self, score: np.ndarray, ids: pa.Array, columns=slice(None), margin: float = 0.0, exact=None) -> None:
        """``score``: a row a document, a column a query (of ``columns``).

        Scores may be off by ``margin``; ``exact`` then gives those of pairs (row, query) that may be among the first.
        """
        slack = margin + (0.0 if self.digits is None else 10.0**-self.digits)
        if len(score) >= self.k and not self.full[columns].all():
            # k of these rows reach their own k-th score, so nothing below it is among the first k
            kth = -np.partition(-score, self.k - 1, axis=0)[self.k - 1]
            self.limit[columns] = np.fmax(self.limit[columns], kth - slack)
            self.full[columns] = True
        least = self.limit[columns] - slack
        if score.dtype == np.float32 and margin:
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))  # or it might be rounded up
        near = np.flatnonzero(~(score < least.astype(score.dtype)).ravel())  # what is no number comes last, but comes
        if not len(near):
            return
        row, query = np.divmod(near, score.shape[1])
        found = score.ravel()[near].astype(np.float64)
        query = np.arange(self.n)[columns][query]
        if exact is not None:
            found = np.concatenate([exact(row[i : i + PAIRS], query[i : i + PAIRS]) for i in range(0, len(row), PAIRS)])
        self.waiting.append((query, found if self.digits is None else np.round(found, self.digits), ids.take(pa.array(row))))
        self.many += len(row)
        if self.many > max(CELLS // 16, self.k * self.n):
            self.rank()

    def rank(self) -> None:
        if not self.waiting:
            return
        query = np.concatenate([self.query, *(w[0] for w in self.waiting)])
        score = np.concatenate([self.score, *(w[1] for w in self.waiting)])
        pool = pa.concat_arrays([self.ids, *(w[2] for w in self.waiting)])
        by_id = np.empty(len(pool), np.int64)
        by_id[pc.sort_indices(pool, null_placement="at_start").to_numpy()] = np.arange(len(pool))
        order = np.lexsort((by_id, -score, query))
        start = np.searchsorted(query[order], np.arange(self.n + 1))
        place = np.arange(len(order)) - start[query[order]]
        last = order[place == self.k - 1]
        self.limit[query[last]] = np.fmax(self.limit[query[last]], score[last])
        self.full[query[last]] = True
        order = order[place < self.k]
        self.query, self.score, self.ids = query[order], score[order], pool.take(pa.array(order))
        self.waiting, self.many = [], 0

    def batch(self, queries: list, schema: pa.Schema) -> pa.RecordBatch:
        """query_id, doc_id, score of what is left."""
        self.rank()
        score = pa.array(self.score.astype(np.int64) if pa.types.is_integer(schema.types[2]) else self.score)
        return pa.RecordBatch.from_arrays([pa.array(queries, schema.types[0]).take(pa.array(self.query)), self.ids, score], schema=schema)


def hash_postings(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """token bucket, doc_id, weight: counts of hashed tokens."""
    token = F.explode(T.hash_tokens(F.coalesce("text", F.lit("")))).alias("token")
    return docs.select("doc_id", token).groupBy("doc_id", F.pmod(F.xxhash64("token"), F.lit(dim)).cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("weight"))


def hash_vectors(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """doc_id, vector (array of float, of length one) of hashed token counts; texts without tokens have none."""
    bucket = F.transform(T.hash_tokens(F.coalesce("text", F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    rows = docs.select("doc_id", bucket.alias("b")).groupBy("doc_id").agg(F.flatten(F.collect_list("b")).alias("b")).where(F.size("b") > 0)
    schema = rows.select("doc_id", F.array().cast("array<float>").alias("vector")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            lists, n = batch.column("b"), batch.num_rows
            row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
            counts = np.bincount(row * dim + lists.flatten().to_numpy(), minlength=n * dim).astype(np.float64).reshape(n, dim)
            unit = (counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))).astype(np.float32)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(unit.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(kinds.types[0]), vector.cast(kinds.types[1])], schema=kinds)

    return rows.mapInArrow(run, schema)


def model_encoding(docs: DataFrame, make, special: tuple[int, ...] = (0, 1, 2), name: str = "encoder") -> DataFrame:
    """doc_id, vector (of length one), weights (token id to weight) by a model's ``encode(texts)``.

    The model gives dense rows and, per text, (token id, weight) pairs; special tokens and weights of
    zero or less are left out, of several weights of a token the greatest counts.
    """
    from parlance.models.clients import held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            dense, sparse = held(name, make).encode([t or "" for t in pdf["text"]])
            dense = np.asarray(dense, np.float32)
            dense = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
            weights = []
            for pairs in sparse:
                best: dict[str, float] = {}
                for token, weight in pairs:
                    if token not in special and weight > 0:
                        best[str(token)] = max(float(weight), best.get(str(token), 0.0))
                weights.append(best)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "vector": list(dense), "weights": weights})

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, vector array<float>, weights map<string,double>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def token_postings(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(T.hash_tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("weight"))


def ranked(scores: DataFrame, k: int, *order) -> DataFrame:
    """Rows of the first k ranks per query, rank from 1."""
    w = W.partitionBy("query_id").orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_topk(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Inverted-index join: the sum of weight products of shared tokens."""
    q = queries.select("query_id", F.explode(T.hash_tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("q"))
    scores = q.join(postings, "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("q") * F.col("weight")).alias("score")).where("score > 0")
    return ranked(scores, k, F.col("score").desc(), "doc_id")


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact inner product of unit vectors; ids of any type, null ones too, stay what they are.

    Queries are taken in blocks of ``DENSE_BYTES``, each broadcast to one scan of the vectors by its share of
    ``LANES`` tasks; a task keeps its own best k per query by matrix product, so what is shuffled is k rows
    a query and task.  Products are of single precision; pairs that may be among the first by more than its
    error are scored anew.  ``indexes.ClusterIndex`` scans only part of the vectors.
    """
    from parlance.operators.indexes import matrix_of

    spark = queries.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = max(1, -(-(size["n"] * (size["d"] or 1) * 8) // DENSE_BYTES))
    rows_of = vectors.where("vector is not null").select("doc_id", "vector")
    schema = rows_of.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "doc_id", F.lit(0.0).alias("score")).schema
    out = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).where("vector is not null").select("query_id", "vector").collect()  # one bounded block
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], unit_rows(np.array([r[1] for r in rows], np.float64))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, units = shared.value
            kinds = to_arrow_schema(schema)
            best, step = Best(len(ids), k, kinds.types[1], digits=6), max(1, CELLS // len(ids))
            short, margin = units.T.astype(np.float32), (units.shape[1] + 8) * 2.0**-23  # the error of a sum of so many products
            for batch in batches:
                for low in range(0, batch.num_rows, step):
                    part = batch.slice(low, step)
                    rows = unit_rows(matrix_of(part.column("vector")))
                    exact = lambda row, query, rows=rows: np.einsum("ij,ij->i", rows[row], units[query])
                    best.add(rows.astype(np.float32) @ short, part.column("doc_id").cast(kinds.types[1]), margin=margin, exact=exact)
            yield best.batch(ids, kinds)

        part = rows_of.coalesce(-(-LANES // blocks)).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, k, F.col("score").desc(), "doc_id")


def whole_text_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``sparse_topk`` for queries as long as documents, which share a token with nearly every one.

    Queries are taken in blocks of ``TEXT_QUERIES`` or ``VECTOR_BYTES`` of text, each broadcast as an inverted
    index; a task scores rows where they stand and keeps its own best k a query, so pairs are not shuffled.  Scores are
    whole numbers.  Rows that repeat an id are one document: only their token counts are brought together.  A row
    without an id is a document of its own.
    """
    rows_of = docs.select("doc_id", T.hash_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    once = rows_of.join(repeated, "doc_id", "left_anti").withColumn("times", F.lit(None).cast("array<long>"))
    several = rows_of.join(repeated, "doc_id", "left_semi").select("doc_id", F.explode("tokens").alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    several = several.groupBy("doc_id").agg(F.collect_list(F.struct("t", "n")).alias("x")).select("doc_id", F.col("x.t").alias("tokens"), F.col("x.n").alias("times"))
    return counted_topk(queries, once.unionByName(several), k)


def postings_topk(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``sparse_topk`` in the way of ``whole_text_topk``: postings of a document are brought together, pairs are not made."""
    tokens = postings.groupBy("doc_id").agg(F.collect_list(F.struct("token", "weight")).alias("x"))
    return counted_topk(queries, tokens.select("doc_id", F.col("x.token").alias("tokens"), F.col("x.weight").alias("times")), k)


def counted_topk(queries: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """The scoring of ``whole_text_topk``; ``tokens``: doc_id, tokens, times (how often each; null if they stand as often as they occur)."""
    spark = queries.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.sum(F.octet_length("query")).alias("b")).first()
    blocks = max(1, -(-size["n"] // TEXT_QUERIES), -(-(size["b"] or 0) // VECTOR_BYTES))
    if blocks > 1:
        tokens = written_once(tokens, "tokens")
    whole = dict(tokens.dtypes)["times"] in ("array<bigint>", "array<int>")
    kind = "long" if whole else "double"
    schema = tokens.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "doc_id", F.lit(0).cast(kind).alias("score")).schema
    out = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", T.hash_tokens("query").alias("tokens")).collect()  # one bounded block
        counts = Counter((token, r["query_id"]) for r in rows if r["query_id"] is not None for token in r["tokens"] or ())
        if not counts:
            continue
        ids, names = sorted({q for _, q in counts}), sorted({t for t, _ in counts})
        place, number = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(names)}
        cells = np.array(sorted((number[t], place[q], n) for (t, q), n in counts.items()), np.int64)
        start = np.searchsorted(cells[:, 0], np.arange(len(names) + 1))
        common = np.argsort(-np.diff(start), kind="stable")[:COMMON_TOKENS]
        shared = spark.sparkContext.broadcast((ids, names, start, cells[:, 1].copy(), cells[:, 2].astype(np.float64), common))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, names, start, query, times, common = shared.value
            kinds = to_arrow_schema(schema)
            known, n = pa.array(names, pa.string()), len(ids)
            wide, column = np.zeros((len(common), n)), np.full(len(names), -1)
            column[common] = np.arange(len(common))
            for i, t in enumerate(common):
                wide[i, query[start[t] : start[t + 1]]] = times[start[t] : start[t + 1]]
            length = np.sqrt(np.bincount(query, times * times, n)) * (1 + 1e-9)
            best, step = Best(n, k, kinds.types[1], least=0.5 if whole else np.nextafter(0, 1)), max(1, min(SLICE, CELLS // n))
            short = wide.astype(np.float32) if whole else wide
            for batch in batches:
                row, token, weight = counted_tokens(batch, known)
                norm = np.sqrt(np.bincount(row, weight * weight, batch.num_rows))
                # in order of length, as a score is at most the product of both lengths: the rest of a batch soon is too short
                order = np.argsort(-norm, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                by_place = np.argsort(place[row], kind="stable")
                row, token, weight = place[row][by_place], token[by_place], weight[by_place]
                norm, doc = norm[order] * (1 + 1e-9), batch.column("doc_id").cast(kinds.types[1]).take(pa.array(order))
                kind, table = (np.float32, short) if whole and len(norm) and norm[0] * length.max() < EXACT else (np.float64, wide)
                for low in range(0, batch.num_rows, step):
                    alive = np.flatnonzero(~(norm[low] * length < best.limit))
                    if not len(alive) or norm[low] == 0:
                        break
                    high = min(low + step, batch.num_rows)
                    own = slice(*np.searchsorted(row, [low, high]))
                    r, t, w = row[own] - low, token[own], weight[own]
                    is_wide, weights = column[t] >= 0, np.zeros((high - low, len(common)), kind)
                    weights[r[is_wide], column[t[is_wide]]] = w[is_wide]
                    some = len(alive) < n
                    score = weights @ (table[:, alive] if some else table)
                    r, t, w = r[~is_wide], t[~is_wide], w[~is_wide]
                    long = start[t + 1] - start[t]
                    at = np.arange(long.sum()) + np.repeat(start[t] - np.concatenate([[0], np.cumsum(long)])[:-1], long)
                    to, r, w = query[at], np.repeat(r, long), np.repeat(w, long) * times[at]
                    if some:
                        new = np.full(n, -1)
                        new[alive] = np.arange(len(alive))
                        to = new[to]
                        r, to, w = r[to >= 0], to[to >= 0], w[to >= 0]
                    np.add.at(score.reshape(-1), r * len(alive) + to, w.astype(kind))
                    best.add(score, doc.slice(low, high - low), alive if some else slice(None))
            yield best.batch(ids, kinds)

        part = tokens.coalesce(-(-LANES // blocks)).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, k, F.col("score").desc(), "doc_id")


def counted_tokens(batch: pa.RecordBatch, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place among ``known`` and weight of the known tokens of a batch (tokens, times), each token of a row once, in order of rows."""
    lists, counted = batch.column("tokens"), batch.column("times")
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    token = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row, weight = np.repeat(np.arange(batch.num_rows), size), np.ones(len(token))
    plain = counted.is_null().to_numpy(zero_copy_only=False)
    weight[~np.repeat(plain, size)] = counted.flatten().to_numpy(zero_copy_only=False)
    row, token, weight = row[token >= 0], token[token >= 0], weight[token >= 0]
    if plain.any():
        key, back = np.unique(row * max(1, len(known)) + token, return_inverse=True)
        weight = np.bincount(back, weight, len(key))
        row, token = np.divmod(key, max(1, len(known)))
    return row, token, weight


def multi_query_merge(lists: DataFrame, k: int, rest: float = 0.92) -> DataFrame:
    """Best weighted score of a document over a query's variants; the first counts in full."""
    weight = F.when(F.col("variant") == 0, 1.0).otherwise(rest)
    best = lists.groupBy("query_id", "doc_id").agg(F.round(F.max(F.col("score") * weight), 6).alias("score"))
    return ranked(best, k, F.col("score").desc(), "doc_id")


def substring_topk(docs: DataFrame, query: str, k: int) -> DataFrame:
    """Ten for the whole query, two for each of its words."""
    low = F.lower(F.coalesce("text", F.lit("")))
    score = F.when(F.contains(low, F.lit(query.lower())), 10).otherwise(0)
    for word in query.lower().split():
        score = score + F.when(F.contains(low, F.lit(word)), 2).otherwise(0)
    return docs.select("doc_id", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(k)


def in_order(docs: DataFrame, condition=None, k: int | None = None) -> DataFrame:
    """A structured dimension's list: matching documents in index order, not by score."""
    found = docs if condition is None else docs.where(condition)
    placed = positions(found)
    placed = placed if k is None else placed.where(F.col("rank") <= k)
    return placed.select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.lit(1.0).alias("score"), "rank")


def fuse(lists: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion; ties by first appearance (order of dimensions, then position).

    Each dimension is a column before the sum, so the sum's order, and its last bit, are fixed.
    """
    weights = WEIGHTS | (weights or {})
    names = list(lists)
    union = None
    for number, name in enumerate(names):
        part = lists[name].select("query_id", "doc_id", F.lit(number).alias("dim"), "rank")
        union = part if union is None else union.unionByName(part)
    wide = union.groupBy("query_id", "doc_id").agg(*(F.min(F.when(F.col("dim") == i, F.col("rank"))).alias(f"rank_{n}") for i, n in enumerate(names)), F.min(F.struct("dim", "rank")).alias("first"))
    score = F.lit(0.0)
    for n in names:
        score = score + F.coalesce(F.lit(weights.get(n, 1.0)) / (RRF_K + F.col(f"rank_{n}")), F.lit(0.0))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "first")
    return wide.withColumn("score", score).withColumn("rank", F.row_number().over(w)).drop("first")


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, rank (from 1) in order of id: ranges are counted first, so no task ranks the whole corpus.

    The ranges are written once: read twice, a range exchange could have other bounds each time.
    """
    ordered = docs.select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("_n", F.monotonically_increasing_id())
    ordered = written_once(ordered, "positions")
    part, own = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    return ordered.withColumn("part", part).join(F.broadcast(before), "part").select("doc_id", (own + F.col("before") + 1).cast("int").alias("rank"))


#: the two other lists hold 2 top_k each, so so many times top_k leave top_k documents that are in neither
BEYOND = 5
#: width of the time buckets in which queries that name nothing but a time meet segments
TIME_CELL = 600_000


def candidates(tied: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs of constrained queries and documents by an equality: on the speaker, else on an intent, else on time.

    Every pair that meets all constraints is among them, once.
    """
    voice = tied.where("q_speaker is not null")
    named = tied.where("q_speaker is null and q_intent is not null")
    timed = tied.where("q_speaker is null and q_intent is null")
    by_voice = facts.join(voice, facts["speaker"] == voice["q_speaker"])
    of = facts.withColumn("_i", F.explode(F.array_distinct(F.transform("intent", T.intent_name))))
    by_name = of.join(named.withColumn("_i", F.explode(F.array_distinct("q_intent"))), "_i").drop("_i").dropDuplicates(["query_id", "doc_id"])
    # the cell of the later start, as every pair that overlaps shares it
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / TIME_CELL), F.floor(F.greatest(low, high) / TIME_CELL)))
    known = facts.where("start_ms is not null and end_ms is not null").withColumn("_cell", cells(F.col("start_ms"), F.col("end_ms")))
    by_time = known.join(timed.where("q_start is not null and q_end is not null").withColumn("_cell", cells(F.col("q_start"), F.col("q_end"))), "_cell")
    by_time = by_time.where(F.col("_cell") == F.floor(F.greatest("start_ms", "q_start") / TIME_CELL)).drop("_cell")
    return by_voice.unionByName(by_name).unionByName(by_time)


def variants_of(rewritten: DataFrame) -> DataFrame:
    """query_id, variant (0 for the query itself), query of a rewritten batch."""
    return rewritten.select("query_id", F.posexplode("variants").alias("variant", "query"))


def keyword_lists(rewritten: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """The keyword list of each query: the best weighted score over its variants (first 1.0, others 0.90)."""
    each = variants_of(rewritten).withColumn("_of", F.struct("query_id", "variant"))
    lists = postings_topk(each.select(F.to_json("_of").alias("query_id"), "query"), postings, k).withColumnRenamed("query_id", "_n")
    lists = lists.join(each.select(F.to_json("_of").alias("_n"), "query_id", "variant"), "_n")
    return multi_query_merge(lists.select("variant", "query_id", "doc_id", F.col("score").cast("double").alias("score")), k, 0.90)


def semantic_lists(rewritten: DataFrame, vectors: DataFrame, k: int, encode=hash_vectors) -> DataFrame:
    """The semantic list of each query over its variants (first 1.0, others 0.92)."""
    each = variants_of(rewritten).withColumn("_n", F.xxhash64("query_id", "variant"))
    asked = encode(each.select(F.col("_n").alias("doc_id"), F.col("query").alias("text"))).select(F.col("doc_id").alias("query_id"), "vector")
    lists = dense_topk(asked, vectors, k).withColumnRenamed("query_id", "_n").join(each.select("_n", "query_id", "variant"), "_n")
    return multi_query_merge(lists.select("query_id", "variant", "doc_id", "score"), k)


def search_batch(queries: DataFrame, segments: DataFrame, postings: DataFrame, vectors: DataFrame, top_k: int = 20, weights: dict[str, float] | None = None, encode=hash_vectors) -> DataFrame:
    """Searches of a table of queries over an index, as one job.

    ``queries``: query_id, query and, where given, speaker, start_s, end_s, intent, which go before what the query
    itself says.  ``segments``: doc_id, text, speaker, start_ms, end_ms, intent.  Lists of the first 2 ``top_k`` by
    meaning and by keyword are fused with the structured ones; constraints then act on the fused list, so fewer
    than ``top_k`` may return.  Adds score, rank, rank_<list> and the rewritten query.

    A structured list holds every document in index order, so of the documents that meet a query's constraints
    and stand in no other list the earliest score best: those within the first ``BEYOND * top_k`` places that
    meet them, and those in the other lists, hold all that can be returned.
    """
    from parlance.functions.rewriting import rewrite_batch

    given = {c: F.col(c) if c in queries.columns else F.lit(None).cast(t) for c, t in (("speaker", "string"), ("start_s", "double"), ("end_s", "double"), ("intent", "array<string>"))}
    named = queries.select("query_id", "query", *(v.alias(f"given_{c}") for c, v in given.items()))
    said = rewrite_batch(named)
    timed = F.col("given_start_s").isNotNull() & F.col("given_end_s").isNotNull()
    intent = F.when(F.size("given_intent") > 0, F.col("given_intent")).when(F.size("intent") > 0, F.col("intent"))
    asked = said.select("query_id", "query", "variants", F.coalesce(F.nullif("given_speaker", F.lit("")), "speaker").alias("speaker"), F.when(timed, F.col("given_start_s")).otherwise(F.col("start_s")).alias("start_s"), F.when(timed, F.col("given_end_s")).otherwise(F.col("end_s")).alias("end_s"), intent.alias("intent"))
    asked = written_once(asked, "asked")  # a row a query, which a dozen steps read
    lists = {"semantic": semantic_lists(asked, vectors, 2 * top_k, encode), "keyword": keyword_lists(asked, postings, 2 * top_k)}
    limits = asked.select("query_id", F.col("speaker").alias("q_speaker"), (F.col("start_s") * 1000).alias("q_start"), (F.col("end_s") * 1000).alias("q_end"), F.transform("intent", T.intent_name).alias("q_intent"))
    meets = F.coalesce(F.col("speaker") == F.col("q_speaker"), F.col("q_speaker").isNull()) & F.coalesce(F.least("end_ms", "q_end") > F.greatest("start_ms", "q_start"), F.col("q_start").isNull())
    has = F.coalesce(F.arrays_overlap(F.transform("intent", T.intent_name), F.col("q_intent")), F.lit(False))
    meets = meets & (F.col("q_intent").isNull() | has)
    free = limits.where("q_speaker is null and q_start is null and q_intent is null").select("query_id")
    tied = limits.join(free, "query_id", "left_anti")
    facts = written_once(segments.select("doc_id", "speaker", "start_ms", "end_ms", "intent").join(positions(segments).withColumnRenamed("rank", "place"), "doc_id"), "facts")
    wanted = ["query_id", "doc_id", "place", "q_speaker", "q_start", "q_intent"]
    lists = {name: written_once(of, name) for name, of in lists.items()}
    listed = lists["semantic"].select("query_id", "doc_id").union(lists["keyword"].select("query_id", "doc_id")).distinct()
    by_list = listed.join(tied, "query_id").join(facts, "doc_id").where(meets).select(*wanted)
    # queries that ask for the same have the same first places, so these are sought once
    same = F.to_json(F.struct("q_speaker", "q_start", "q_end", "q_intent"))
    kinds = tied.select(same.alias("query_id"), "q_speaker", "q_start", "q_end", "q_intent").dropDuplicates(["query_id"])
    # a task keeps the first places a kind before the shuffle (window group limit)
    first = ranked(candidates(kinds, facts).where(meets), BEYOND * top_k, "place").select(F.col("query_id").alias("_same"), "doc_id", "place")
    by_place = tied.withColumn("_same", same).join(first, "_same").select(*wanted)
    allowed = by_list.union(by_place).distinct()
    for name, column in (("speaker", "q_speaker"), ("time", "q_start"), ("intent", "q_intent")):
        lists[name] = allowed.where(F.col(column).isNotNull()).select("query_id", "doc_id", F.lit(1.0).alias("score"), F.col("place").alias("rank"))
    fused = written_once(fuse(lists, weights), "fused")
    kept = fused.join(free, "query_id", "left_semi").unionByName(fused.join(allowed.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")).withColumnRenamed("rank", "fused_rank")
    found = ranked(kept, top_k, "fused_rank").drop("fused_rank")
    return found.withColumn("score", F.round("score", 4)).join(segments, "doc_id").join(asked.select("query_id", "query", F.col("variants").alias("query_variants")), "query_id")


def search(docs: DataFrame, semantic: DataFrame, keyword: DataFrame, top_k: int, speaker=None, time_range=None, intent=None) -> DataFrame:
    """Fused and post-filtered: constraints act after ranking, so fewer than top_k may return.

    ``time_range`` in ms; a missing speaker or intent meets no constraint.  Intents are compared by their
    normalised names.
    """
    from parlance.operators.predicates import intent_any, is_speaker, overlaps_range

    lists, keep, names = {"semantic": semantic, "keyword": keyword}, F.lit(True), []
    for name, given, condition in (("speaker", speaker, is_speaker), ("time", time_range, lambda r: overlaps_range(*r)), ("intent", intent, intent_any)):
        if given is not None:
            keep, names = keep & condition(given), [*names, name]
    if names:
        listed = semantic.select("query_id", "doc_id").union(keyword.select("query_id", "doc_id")).distinct()
        allowed = positions(docs).join(docs.where(keep).select("doc_id"), "doc_id", "left_semi")
        first = allowed.orderBy("rank").limit(BEYOND * top_k)  # see search_batch
        both = listed.join(allowed, "doc_id").select("query_id", "doc_id", "rank").union(listed.select("query_id").distinct().crossJoin(F.broadcast(first)).select("query_id", "doc_id", "rank")).distinct()
        lists |= {name: both.withColumn("score", F.lit(1.0)) for name in names}
    fused = fuse(lists).withColumnRenamed("rank", "fused_rank")
    found = fused.join(docs, "doc_id").where(keep)
    return ranked(found.withColumn("score", F.round("score", 6)), top_k, "fused_rank").drop("fused_rank")


def display_selection(results: DataFrame, query: str, k: int) -> DataFrame:
    """Informative results first, then the others unique by file, text and start."""
    from parlance.operators.predicates import informative

    good = results.withColumn("_good", informative(query, F.col("text")))
    once = W.partitionBy("_good", "file_id", "text", F.round("start_ms", -1)).orderBy("rank")
    kept = good.withColumn("_n", F.row_number().over(once)).where(F.col("_good") | (F.col("_n") == 1))
    return kept.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("_good").desc(), "rank"))).where(F.col("place") <= k).drop("_good", "_n")


def sample_stable(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The same n rows on every run and machine."""
    return docs.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def build_index(segments: DataFrame, path: str, least: int = 4, encode=hash_vectors) -> int:
    """Segments, vectors and postings as three Parquet tables and a manifest; gives the number of segments.

    ``segments`` have doc_id and text.  ValueError if none is long enough to index.
    """
    from parlance.operators.predicates import indexable

    kept = segments.where(indexable(F.col("text"), least))
    if kept.isEmpty():
        raise ValueError("nothing to index")
    kept.write.mode("overwrite").parquet(f"{path}/segments")
    kept = segments.sparkSession.read.parquet(f"{path}/segments")
    encode(kept).write.mode("overwrite").parquet(f"{path}/vectors")
    token_postings(kept).write.mode("overwrite").parquet(f"{path}/postings")
    n = kept.count()
    kept.sparkSession.createDataFrame([(n, DIM)], "num_segments long, dim int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return n


class Index:
    """An index on disk, its tables bound at first use.  FileNotFoundError if its vectors are missing."""

    def __init__(self, spark, path: str, weights: dict[str, float] | None = None, encode=hash_vectors):
        self.spark, self.path, self.weights, self.encode, self._tables = spark, path.rstrip("/"), weights, encode, None

    @property
    def tables(self) -> dict[str, DataFrame]:
        if self._tables is None:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/vectors")
            if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
                raise FileNotFoundError(f"no index at {self.path}")
            self._tables = {n: self.spark.read.parquet(f"{self.path}/{n}") for n in ("segments", "vectors", "postings")}
        return self._tables

    def search(self, queries: DataFrame, top_k: int = 20) -> DataFrame:
        t = self.tables
        return search_batch(queries, t["segments"], t["postings"], t["vectors"], top_k, self.weights, self.encode)


def search_or_fall_back(segments: DataFrame, path: str, query: str, top_k: int, encode=hash_vectors) -> tuple[str, DataFrame]:
    """How a search was answered, and its rows for display.

    By the index if it matches the segments, else by one built anew, else (nothing to index, or it fails) by
    substrings.  ``segments``: doc_id, file_id, seg_idx, text, speaker, start_ms, end_ms, intent.
    """
    from parlance.operators.predicates import indexable
    from parlance.operators.relations import index_is_fresh

    spark = segments.sparkSession
    queries = spark.createDataFrame([(0, query)], "query_id long, query string")
    wanted = segments.where(indexable(F.col("text")))
    try:
        index, how = Index(spark, path, encode=encode), "index"
        try:
            fresh = index_is_fresh(index.tables["segments"], wanted).first()["is_fresh"]
        except Exception as error:  # noqa: BLE001  a missing or broken index is built anew
            log.warning("index at %s cannot be read, it is built anew: %s", path, str(error).split("\n")[0])
            fresh = False
        if not fresh:
            build_index(segments, path, encode=encode)
            index, how = Index(spark, path, encode=encode), "rebuilt"
        found = display_selection(index.search(queries, max(4 * top_k, 10)), query, top_k)
        # run here, while another way to answer is left: at most top_k rows
        return how, spark.createDataFrame(found.collect(), found.schema)
    except Exception as error:  # noqa: BLE001  whatever the index or the encoder raises
        log.warning("search by substrings: %s", str(error).split("\n")[0])
        return "substring", substring_topk(segments, query, top_k).join(segments, "doc_id")


def probe_queries(segments: DataFrame) -> DataFrame:
    """Queries that a corpus asks of itself: its first text's beginning, its first speakers and intents (three each)."""
    first = segments.orderBy("doc_id").limit(1).select(F.lit("semantic").alias("type"), F.substring("text", 1, 20).alias("query"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("array<string>").alias("intent"))
    voices = segments.where("speaker <> ''").select("speaker").distinct().orderBy("speaker").limit(3).select(F.lit("speaker").alias("type"), F.lit("发言").alias("query"), "speaker", F.lit(None).cast("array<string>").alias("intent"))
    intents = segments.select(F.explode("intent").alias("i")).distinct().orderBy("i").limit(3).select(F.lit("intent").alias("type"), F.col("i").alias("query"), F.lit(None).cast("string").alias("speaker"), F.array("i").alias("intent"))
    both = first.unionByName(voices).unionByName(intents)
    return both.withColumn("query_id", F.xxhash64("type", "query", "speaker"))


def probe(segments: DataFrame, path: str, top_k: int = 5, encode=hash_vectors) -> DataFrame:
    """type, query, hits of each probe query over an index built at ``path``."""
    build_index(segments, path, encode=encode)
    queries = probe_queries(segments)
    hits = Index(segments.sparkSession, path, encode=encode).search(queries, top_k).groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.join(hits, "query_id", "left").select("type", "query", F.coalesce("hits", F.lit(0)).alias("hits"))


def self_retrieval_cases(segments: DataFrame, n: int, seed: int = 42, language: str = "en") -> DataFrame:
    """query_id, mode (exact or partial), query, dataset, doc_id, text of a reproducible sample of segments."""
    chosen = sample_stable(segments.select("doc_id"), n, seed).join(segments, "doc_id")
    both = [chosen.select("doc_id", F.col("dataset"), "text", F.lit(mode).alias("mode"), query.alias("query")) for mode, query in (("exact", F.col("text")), ("partial", T.partial_query(F.col("text"), language)))]
    return both[0].unionByName(both[1]).withColumn("query_id", F.xxhash64("doc_id", "mode"))


def self_retrieval_outcomes(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case: dataset, mode, rank of the first hit that is the segment itself or has its text; null if none is."""
    right = hits.select("query_id", F.col("doc_id").alias("hit_id"), F.col("text").alias("hit_text"), "rank").join(cases.select("query_id", "doc_id", "text"), "query_id")
    rank = right.where((F.col("hit_id") == F.col("doc_id")) | (F.col("hit_text") == F.col("text"))).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return cases.select("query_id", "dataset", "mode").join(rank, "query_id", "left")


def case_outcomes(cases: list[dict], segments: DataFrame, hits: DataFrame) -> DataFrame:
    """Per hand-written case (query_id, dimension, dataset, constraints, any_term_groups): rank of the first relevant hit.

    Cases that no segment of the corpus answers are left out.
    """
    from parlance.operators.predicates import relevant_to

    out = None
    for case in cases:  # a case is a filter; there are a few dozen
        answered = segments.where(relevant_to(case)).limit(1).select(F.lit(case["query_id"]).cast("long").alias("query_id"), F.lit(case["dimension"]).alias("dimension"), F.lit(case["dataset"]).alias("dataset"))
        rank = hits.where((F.col("query_id") == case["query_id"]) & relevant_to(case)).agg(F.min("rank").alias("rank")).withColumn("query_id", F.lit(case["query_id"]).cast("long"))
        part = answered.join(rank, "query_id", "left")
        out = part if out is None else out.unionByName(part)
    return out
