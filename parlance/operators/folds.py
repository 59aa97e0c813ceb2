"""Ordered folds in one streaming pass, with a constant state.

A file is dealt by slices of time; a slice's rows pass in order through Arrow batches.  Where the fold is
certain to start afresh the pass starts it, and what it gives is final up to its last, open row.  Rows
before the first such place and open rows are handed on to one lane a file, in which the fold runs over
them in order; all others stay where they are.  Time is linear in the rows, no file or run of rows stands
in memory, and a long file is one task's work only where nothing in it starts afresh.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("start_ms", "end_ms", "seg_idx")
#: a slice of a file, in its unit of time
SPAN = 3_600_000
BATCH = 10_000
LANE = -1
#: places of ORDER in a row; its fields follow
START, END, FIELDS = 0, 1, 3
Row = tuple


class Fold:
    """What a fold keeps: at most one row that may still change."""

    def __init__(self) -> None:
        self.open: Row | None = None

    def push(self, row: Row) -> Iterable[Row]:
        """Takes the next row and gives rows that are final."""
        raise NotImplementedError

    def next(self, row: Row) -> Iterable[Row]:
        """``row`` becomes the open one, the one before is final."""
        done, self.open = self.open, row
        return () if done is None else (done,)

    def rest(self) -> Iterable[Row]:
        return () if self.open is None else (self.open,)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batches_of(rows: Iterable[Row], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def reach_before(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the greatest end of all earlier slices (null: there is none)."""
    w = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = df.groupBy(*keys, "_slice").agg(F.max("end_ms").alias("_end"))
    before = slices.withColumn("_before", F.max("_end").over(w)).drop("_end").alias("b")
    rows = df.alias("a")
    on = F.lit(True)
    for k in (*keys, "_slice"):
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return rows.join(before, on).select("a.*", "b._before")


def linear_fold(df: DataFrame, keys: list[str], fields: list[str], make: Callable[[], Fold], afresh: Callable[[object, Row], bool], by_reach: bool = False, span: int = SPAN) -> DataFrame:
    """file_id, ORDER and ``fields`` of the rows that ``make()`` gives for the rows of each key, in order.

    ``afresh(before, row)``: whether the fold is certain to start afresh at a row.  ``before`` is the row before it or,
    with ``by_reach``, the greatest end so far (None at the first row); a row of unknown neighbour does not.
    """
    n = len(keys)
    names = [*ORDER, *(f for f in fields if f not in ORDER)]
    rows = df.select(*keys, F.coalesce(F.floor(F.col("start_ms") / span), F.lit(0)).cast("long").alias("_slice"), *names)
    rows = reach_before(rows, keys) if by_reach else rows.withColumn("_before", F.lit(None).cast("long"))
    placed = rows.select(*keys, "_slice", "_before", *names).repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", *ORDER)
    out = rows.select(*keys, F.lit(0).alias("_lane").cast("long"), "_slice", F.lit(0).cast("long").alias("_at"), F.lit(True).alias("_fresh"), *names).schema
    # a lane: the slice of final rows, one for all rows of a key that are handed on; fresh: what stood before is final

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out)

        def given() -> Iterator[Row]:
            for key, group in groupby(rows_of(batches), itemgetter(*range(n + 1))):
                fold, before, known, at = None, None, by_reach, 0
                for whole in group:
                    row = whole[n + 2 :]
                    if by_reach and at == 0:
                        before = whole[n + 1]
                    if known and afresh(before, row):
                        if fold:
                            yield from ((*key[:n], key[n], key[n], at, True, *r) for r in fold.rest())
                        fold = make()
                    at += 1
                    if fold:
                        yield from ((*key[:n], key[n], key[n], at, True, *r) for r in fold.push(row))
                    else:
                        yield (*key[:n], LANE, key[n], at, False, *row)
                    known = True
                    if not by_reach:
                        before = row
                    elif row[END] is not None:
                        before = row[END] if before is None else max(before, row[END])
                if fold:
                    yield from ((*key[:n], LANE, key[n], at, True, *r) for r in fold.rest())

        yield from batches_of(given(), schema)

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out)

        def given() -> Iterator[Row]:
            for key, group in groupby(rows_of(batches), itemgetter(*range(n + 1))):
                if key[n] != LANE:
                    yield from group
                    continue
                fold, at = make(), (*key, 0, 0, True)
                for whole in group:
                    if whole[n + 3]:
                        yield from ((*at, *r) for r in fold.rest())
                        fold = make()
                    yield from ((*at, *r) for r in fold.push(whole[n + 4 :]))
                yield from ((*at, *r) for r in fold.rest())

        yield from batches_of(given(), schema)

    begun = placed.mapInArrow(slices, out)
    done = begun.repartition(*keys, "_lane").sortWithinPartitions(*keys, "_lane", "_slice", "_at").mapInArrow(lanes, out)
    return done.select("file_id", *names)


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


EDGES = regex.compile(r"^\p{White_Space}+|\p{White_Space}+$")
SPACE = regex.compile(r"\p{White_Space}")
WORD_END, WORD_START = regex.compile(r"[.?!,;:A-Za-z0-9]"), regex.compile(r"[A-Za-z0-9]")


def stripped(text: str) -> str:
    return EDGES.sub("", text)


def joined(left: str | None, right: str | None) -> str | None:
    """Two texts as one turn: a space only where words would fuse (``functions.text.concat_turn_text``)."""
    if not left:
        return right
    if not right:
        return left
    if SPACE.match(left[-1]) or SPACE.match(right[0]) or not (WORD_END.match(left[-1]) and WORD_START.match(right[0])):
        return left + right
    return f"{left} {right}"


class Turns(Fold):
    """Neighbours of one speaker as one row while gap, duration and length allow; fields: speaker, text."""

    def __init__(self, max_gap: float, max_dur: float, max_chars: int, noise: bool, longest_text: Callable[[str | None, str | None, str | None], int]):
        super().__init__()
        self.max_gap, self.max_dur, self.max_chars, self.noise, self.length = max_gap, max_dur, max_chars, noise, longest_text

    def push(self, row: Row) -> Iterable[Row]:
        last = self.open
        if last is None:
            return self.next(row)
        start, end, seg, speaker, text = last
        if None in (speaker, row[FIELDS], start, end, row[START], row[END]) or speaker != row[FIELDS]:
            return self.next(row)
        both, gap = joined(text, row[FIELDS + 1]), row[START] - end
        if both is None or gap > self.max_gap or row[END] - start > self.max_dur or self.length(text, row[FIELDS + 1], both) > self.max_chars:
            return self.next(row)
        if self.noise and gap > 500 and end - start > 1_000 and len(stripped(text or "")) <= 1:
            start = max(start, row[START] - 350)  # a single long character before a pause is noise before speech
        self.open = (start, row[END], seg, speaker, both)
        return ()


def turns_afresh(max_gap: float) -> Callable[[Row, Row], bool]:
    def afresh(before: Row, row: Row) -> bool:
        known = None not in (before[FIELDS], row[FIELDS], before[END], row[START])
        return not known or before[FIELDS] != row[FIELDS] or row[START] - before[END] > max_gap

    return afresh


class Boundaries(Fold):
    """A row that starts before the kept one's end starts ``gap`` after it, and goes if nothing is left."""

    def __init__(self, gap: float):
        super().__init__()
        self.gap = gap

    def push(self, row: Row) -> Iterable[Row]:
        start, end = row[START], row[END]
        if start is None or end is None:
            return ()
        if self.open is not None and start < self.open[END]:
            start = self.open[END] + self.gap
        return self.next((start, *row[1:])) if end > start else ()


class Apart(Fold):
    """Of rows that overlap the first is kept; the open row is the one that reaches furthest."""

    def push(self, row: Row) -> Iterable[Row]:
        start, end = row[START], row[END]
        if start is None or end is None or end <= start:
            return (row,)  # it overlaps nothing
        return () if self.open is not None and self.open[END] > start else self.next(row)


def reach_afresh(gap: float) -> Callable[[object, Row], bool]:
    def afresh(reach: object, row: Row) -> bool:
        return row[START] is not None and (reach is None or row[START] > reach + gap)

    return afresh
