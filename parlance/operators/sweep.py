"""The interval join: a forward scan over both sides in order of start.

Two intervals overlap if the later start lies inside the other.  Both sides are dealt to the time buckets
they touch; in a bucket the starts that lie in it are looked up in the other side's intervals, cut to the
bucket.  So a pair is found once, in the bucket of the later start, and every pair that is formed overlaps.
A task takes the buckets of its partition in order, some ten thousand rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: width of a bucket where none is measured
BUCKET = 600_000
#: rows taken at once, pairs given at once
ROWS, PAIRS = 50_000, 50_000
#: a measured bucket is so many times as wide as all but a few intervals are long
WIDTHS, LONGEST = 8, 0.95


def bucket_width(*sides: DataFrame) -> int:
    """A width from the lengths of the intervals: few lie in several buckets, and a bucket holds few that lie apart."""
    lengths = [s.agg(F.percentile_approx(F.col("end_ms") - F.col("start_ms"), LONGEST).alias("x")).first()["x"] for s in sides]
    return max(1, int(WIDTHS * max((x for x in lengths if x is not None), default=BUCKET // WIDTHS)))


def overlap_join(left: DataFrame, right: DataFrame, pad: int = 0, bucket: int | None = BUCKET, right_names: dict[str, str] | None = None) -> DataFrame:
    """Pairs of one file whose intervals overlap by more than nothing, with column ``overlap``.

    ``pad`` widens the right side (its start not below zero).  Right columns other than the key get the prefix ``r_``
    unless ``right_names`` says otherwise.  ``bucket``: the width of a bucket, None to measure the lengths first.  Rows
    without a file, a time or a length pair with nothing.
    """
    width = bucket_width(left, right) if bucket is None else bucket
    names = {c: f"r_{c}" for c in right.columns if c != "file_id"} | (right_names or {})
    right = right.select("file_id", *(F.col(c).alias(n) for c, n in names.items()))
    rs = F.greatest(F.col("r_start_ms") - pad, F.lit(0)) if pad else F.col("r_start_ms")
    overlap = F.least(F.col("end_ms"), F.col("r_end_ms") + pad) - F.greatest(F.col("start_ms"), rs)
    wanted = StructType([*left.schema.fields, *(f for f in right.schema.fields if f.name != "file_id")])
    kind = left.limit(0).crossJoin(right.drop("file_id").limit(0)).select(overlap.alias("overlap")).schema["overlap"].dataType  # a plan only: the type of a difference
    schema = wanted.add("overlap", kind)
    if schema.names != list(dict.fromkeys(schema.names)):
        raise ValueError("both sides have columns of one name")

    def dealt(df: DataFrame, side: int, start, end) -> DataFrame:
        held = df.withColumn("_s", start).withColumn("_e", end).where("file_id is not null and _e > _s")
        held = held.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
        # cut to the bucket, counted from its beginning; a start outside is below zero
        origin = F.col("_bucket") * width
        return held.withColumn("_s", (F.col("_s") - origin).cast("double")).withColumn("_e", F.least(F.col("_e") - origin, F.lit(width)).cast("double")).withColumn("_side", F.lit(side))

    a, b = dealt(left, 0, F.col("start_ms"), F.col("end_ms")), dealt(right, 1, rs, F.col("r_end_ms") + pad)
    both = a.unionByName(b, allowMissingColumns=True).repartition("file_id", "_bucket").sortWithinPartitions("file_id", "_bucket")
    pairs_schema = StructType(schema.fields[:-1])
    left_names, right_columns = left.columns, [n for n in right.columns if n != "file_id"]
    low, high = ("start_ms", "end_ms"), ("r_start_ms", "r_end_ms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, rest = to_arrow_schema(pairs_schema), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows >= ROWS:
                rest = rest.combine_chunks()
                whole = int(bounds_of(rest)[-1])  # the last bucket may go on
                yield from pairs_of(rest.slice(0, whole), left_names, right_columns, arrow)
                rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield from pairs_of(rest.combine_chunks(), left_names, right_columns, arrow)

    found = both.mapInArrow(run, pairs_schema)
    start = F.greatest(F.col(high[0]) - pad, F.lit(0)) if pad else F.col(high[0])
    return found.withColumn("overlap", F.greatest(F.lit(0), F.least(F.col(low[1]), F.col(high[1]) + pad) - F.greatest(F.col(low[0]), start)))


def bounds_of(table: pa.Table) -> np.ndarray:
    """Where each file's bucket begins."""
    new = np.ones(table.num_rows, bool)
    for name in ("file_id", "_bucket"):
        column = table.column(name)
        differ = pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
        new[1:] = differ if name == "file_id" else new[1:] | differ
    return np.flatnonzero(new)


def places(code: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Dense ranks by (code, time): exact whatever the times are."""
    order = np.lexsort((time, code))
    new = np.ones(len(order), np.int64)
    new[1:] = (code[order[1:]] != code[order[:-1]]) | (time[order[1:]] != time[order[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def scan(code: np.ndarray, side: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (left, right) of all pairs of one code whose intervals overlap and whose later start is not below zero.

    A left start is looked up among right intervals that began earlier, a right start among left ones that began no later.
    """
    inside = np.maximum(start, 0)
    rank = places(np.concatenate([code, code]), np.concatenate([inside, end]))
    first, last = rank[: len(code)], rank[len(code) :]
    found = []
    for one, strict in ((0, True), (1, False)):  # the side whose starts are looked up
        points, spans = np.flatnonzero((side == one) & (start >= 0)), np.flatnonzero(side != one)
        points = points[np.argsort(first[points], kind="stable")]
        at = first[points]
        # of an interval that began before the bucket every start is a later one
        low = np.searchsorted(at, first[spans] + (strict & (start[spans] >= 0)), "left")
        high = np.searchsorted(at, last[spans], "left")
        n = np.maximum(high - low, 0)
        point = points[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        span = np.repeat(spans, n)
        found.append((point, span) if one == 0 else (span, point))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def pairs_of(table: pa.Table, left: list[str], right: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    code = np.zeros(table.num_rows, np.int64)
    code[bounds_of(table)[1:]] = 1
    numbers = [table.column(c).to_numpy() for c in ("_side", "_s", "_e")]
    a, b = scan(np.cumsum(code), *numbers)
    for low in range(0, len(a), PAIRS):
        mine, other = table.select(left).take(pa.array(a[low : low + PAIRS])), table.select(right).take(pa.array(b[low : low + PAIRS]))
        columns = [c.combine_chunks() for t in (mine, other) for c in t.columns]
        yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)
