"""Documents drawn by how much likelier a target text is to use their words.

A document's features are runs of words, hashed to a fixed number of buckets.  Its postings, packed as
(document, buckets, counts), are dealt by bucket range; a range's postings are split further by document,
so a bucket that stands in every document is spread over many groups.  The same postings give each
bucket's count in the corpus; co-grouped with the target's counts they give the bucket's gain, and every
group of postings meets its range's gains and sends one sum a document.  Sums are reduced by document.

Rows: a null text has no words; a null id hashes as an empty one; rows that repeat id and text are one
document counted as often as they stand; without rows nothing returns.  Ties in score go to the smaller
id (null first).  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import materialize, packed_counts, thrifty, unpacked_counts

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
RANGES = 8
#: bytes of text whose postings of one bucket range make a group
GROUP_BYTES = 16_000_000
#: fixed value: what parts words, in ASCII; all other characters belong to words
BREAKS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
LOWERED = bytes.maketrans(BREAKS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(BREAKS) + b"abcdefghijklmnopqrstuvwxyz")
OWN = -1


class Buckets(dict):
    """Feature to its bucket, remembered in bounded memory."""

    LIMIT = 1 << 18

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[feature] = value = zlib.crc32(feature) % self.n
        return value


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWERED).split(b" ")


def features_of(text: str | None, longest: int, known: Buckets) -> tuple[np.ndarray, int]:
    """The bucket of every run of 1 to ``longest`` words, and the number of words."""
    words = [w for w in words_of(text) if w]
    runs = list(words)
    for n in range(2, longest + 1):
        runs += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)), len(words)


def postings(docs: DataFrame, buckets: int, longest: int, groups: int) -> DataFrame:
    """Packed postings: per document and bucket range a row, and one of its own (range ``OWN``) with its sizes."""
    width = -(-buckets // RANGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Buckets(buckets)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found, n = features_of(text, longest, known)
                bucket, count = np.unique(found, return_counts=True)
                name = (b"?" if doc_id is None else b"=" + doc_id.encode()) + b"\0" + (b"" if text is None else text.encode("utf-8", "surrogatepass"))
                key = xxhash.xxh3_128_digest(name)
                part = key[0] | key[1] << 8 | key[2] << 16
                rows.append((OWN, part % groups, key, doc_id, n, len(found), b""))
                cuts = np.searchsorted(bucket, np.arange(RANGES + 1) * width)
                for r in range(RANGES):
                    low, high = cuts[r], cuts[r + 1]
                    if high > low:
                        data = (bucket[low:high] - r * width).astype("<u2").tobytes() + packed_counts(count[low:high])
                        rows.append((r, part % groups, key, None, 0, int(high - low), data))
            yield pd.DataFrame(rows, columns=["range", "part", "key", "doc_id", "n_words", "n", "data"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(thrifty(run), "range int, part int, key binary, doc_id string, n_words long, n long, data binary")


def opened(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, "<u2", n).astype(np.int64), unpacked_counts(data[2 * n :], n)


def counts_of(packed: DataFrame, buckets: int, name: str) -> DataFrame:
    """bucket and its count: tasks add up their postings, at most a row a bucket is shuffled by each."""
    width = -(-buckets // RANGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for r, n, data in zip(pdf["range"], pdf["n"], pdf["data"], strict=True):
                if r != OWN:
                    bucket, count = opened(data, n)
                    total[bucket + r * width] += count
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    # all columns: fewer would be cut below the exchange of ``packed`` and keep Spark from making it only once
    return packed.mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gain(s: Column, t: Column, corpus: Column, target: Column, buckets: int) -> Column:
    """A thousand times the log of the target's smoothed share of a bucket over the corpus', rounded down."""
    double = lambda c: c.cast("double")
    share = ((double(t) + 1.0) * (double(corpus) + float(buckets))) / ((double(s) + 1.0) * (double(target) + float(buckets)))
    return F.floor(F.lit(1000.0) * F.ln(share))


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """Per bucket range its buckets (from the range's first) with their gains; at most ``buckets`` entries in all."""
    width = -(-buckets // RANGES)
    both = corpus.join(target, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    total = lambda c: both.agg(F.sum(c)).scalar()
    found = both.select(F.col("bucket").alias("b"), gain(F.col("s"), F.col("t"), total("s"), total("t"), buckets).alias("g"))
    by_range = found.groupBy(F.floor(F.col("b") / width).cast("int").alias("range")).agg(F.collect_list(F.struct((F.col("b") % width).alias("b"), "g")).alias("x"))
    return by_range.select("range", F.col("x.b").alias("b"), F.col("x.g").alias("g"))


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """doc_id (as text), n_words, n_features, weight of every row of ``docs`` (doc_id, text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    width = -(-buckets // RANGES)
    packed = postings(docs, buckets, longest, groups).repartition("range", "part")
    nameless = target.select(F.lit(None).cast("string").alias("doc_id"), "text")
    gains = gains_of(counts_of(packed, buckets, "s"), counts_of(postings(nameless, buckets, longest, 1), buckets, "t"), buckets)
    dealt = gains.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def contributions(_: tuple, rows: pd.DataFrame, gained: pd.DataFrame) -> pd.DataFrame:
        value = np.zeros(width, np.int64)
        if len(gained):
            value[np.asarray(gained["b"].iloc[0])] = gained["g"].iloc[0]
        sums = []
        for r, n, data in zip(rows["range"], rows["n"], rows["data"], strict=True):
            bucket, count = opened(data, n if r != OWN else 0)
            sums.append(int(value[bucket] @ count))
        own = rows["range"] == OWN
        return pd.DataFrame({"key": rows["key"], "gain": pd.Series(sums, dtype="int64"), "m": own.astype("int64"), "doc_id": rows["doc_id"], "n_words": rows["n_words"], "n": rows["n"].where(own, 0)})

    sent = packed.groupBy("range", "part").cogroup(dealt.groupBy("range", "part")).applyInPandas(contributions, "key binary, gain long, m long, doc_id string, n_words long, n long")
    by_doc = sent.groupBy("key").agg(F.sum("gain").alias("gain"), F.sum("m").alias("m"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n").alias("n_features"))
    # gains of repeated rows have been added up once a row
    mean = F.floor(F.col("gain") / (F.col("m") * F.greatest("n_features", F.lit(1))))
    whole = by_doc.withColumn("weight", mean).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return whole.select("doc_id", "n_words", "n_features", "weight")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousandfold Gumbel value of the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id, F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank, 1, 2, ... in order of score, to the first ``percent`` % of the rows with enough words; null elsewhere.

    Scores are whole numbers in a narrow range (gains and Gumbel values are logs), so the rows before a score are
    known from counts a score, and only rows of one score are ranked among themselves.
    """
    able = scored.withColumn("_able", F.col("n_words") >= least_words)
    counts = able.where("_able").groupBy("score").agg(F.count("*").alias("_n"))
    before = counts.select("score", F.sum("_n").over(W.orderBy(F.col("score").desc())).alias("_to"), "_n")  # a row a score
    draw = counts.agg(F.floor(F.lit(percent) * F.coalesce(F.sum("_n"), F.lit(0)) / 100)).scalar()
    places = before.select("score", (F.col("_to") - F.col("_n")).alias("_before"), draw.alias("_draw")).where("_before < _draw")
    joined = able.join(F.broadcast(places), "score", "left")
    possible = joined.where("_able and _before is not null")
    order = W.partitionBy("score").orderBy(F.col("_id"), "n_features", "weight")
    placed = possible.withColumn("rank", F.row_number().over(order).cast("long") + F.col("_before")).withColumn("rank", F.when(F.col("rank") <= F.col("_draw"), F.col("rank")))
    rest = joined.where("not _able or _before is null").withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("_able", "_before", "_draw")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``, drawn towards the texts of ``target``.

    weight: the mean gain of the features, rounded down (without features 0).  score: weight plus Gumbel noise of the
    id.  The ``percent`` % of the documents of ``least_words`` or more with the highest scores have a rank.
    """
    if not 0 < buckets <= 1 << 18 or -(-buckets // RANGES) > 1 << 16:
        raise ValueError("buckets of a range must fit in two bytes")
    kind = dict(docs.dtypes)["doc_id"]
    scored = weights(docs.select("doc_id", "text"), target.select("text"), buckets, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    placed = drawn(materialize(scored.withColumn("_id", F.col("doc_id").cast(kind)), "resampling-scores", keep=True), percent, least_words)
    return placed.select(F.col("_id").alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")
