"""English phrases lost between two segments, found again by decoding around the boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators.sequence import by_file

MOST_REPAIRS = 8


#: words that must and may match on either side of a gap, and words of a gap
TAIL, HEAD, GAP = (3, 8), (3, 7), (2, 10)


def agreeing(one: list[str], other: list[str], most: int) -> int:
    """How many words two lists have in common from their start, ``most`` at most."""
    n = 0
    while n < min(most, len(one), len(other)) and one[n] == other[n]:
        n += 1
    return n


def missing_phrase(before: list[str], after: list[str], heard: list[str]) -> list[str]:
    """What ``heard`` has between the end of ``before`` and the start of ``after``, if it is two to ten words that
    neither has.

    Every place of ``heard`` is held against both: how much of ``before`` ends there, how much of ``after`` begins there.
    Of the gaps between two such places that with the longest match before it wins, then after it, then the first.
    """
    ends = [agreeing(before[::-1], heard[:k][::-1], TAIL[1]) for k in range(len(heard) + 1)]
    begins = [agreeing(after, heard[k:], HEAD[1]) for k in range(len(heard) + 1)]
    gaps = [(ends[i], begins[j], -i, -j) for i in range(len(heard)) if ends[i] >= TAIL[0] for j in range(i + GAP[0], min(i + GAP[1], len(heard)) + 1) if begins[j] >= HEAD[0]]
    if not gaps:
        return []
    _, _, i, j = max(gaps)
    found, known = heard[-i:-j], before + after
    return [] if any(known[k : k + len(found)] == found for k in range(len(known))) else found


def boundary_windows(segments: DataFrame, total: str = "total_ms") -> DataFrame:
    """file_id, seg_idx (of the later segment), window_start_ms, window_end_ms of the boundaries worth a second look:
    close neighbours of four words or more each, and four seconds or more around them."""
    w = by_file()
    tokens = T.english_tokens(F.coalesce("text", F.lit("")))
    rows = segments.withColumn("_t", tokens).withColumn("_before", F.lag("_t").over(w)).withColumn("_end", F.lag("end_ms").over(w))
    near = rows.where((F.abs(F.col("start_ms") - F.col("_end")) <= 350) & (F.size("_t") >= 4) & (F.size("_before") >= 4))
    lo, hi = F.greatest(F.lit(0), F.col("_end") - 2_500), F.least(F.col(total), F.col("start_ms") + 8_000)
    return near.select("file_id", "seg_idx", lo.alias("window_start_ms"), hi.alias("window_end_ms"), F.col("_before").alias("before"), F.col("_t").alias("after")).where("window_end_ms - window_start_ms >= 4000")


def repair_prefixes(segments: DataFrame, decode: Callable[[DataFrame], DataFrame], most: int = MOST_REPAIRS) -> DataFrame:
    """``segments`` (with total_ms) with lost phrases put in front: boundary_prefix_repaired and boundary_prefix_source tell.

    ``decode`` turns the windows (file_id, seg_idx, window bounds) into (file_id, seg_idx, heard), the text heard in
    each.  The first ``most`` repairs of a file are made.  Boundaries are judged on the input, so a repair does not
    change the next one.
    """
    windows = boundary_windows(segments)
    heard = decode(windows.select("file_id", "seg_idx", "window_start_ms", "window_end_ms"))
    both = windows.join(heard.select("file_id", "seg_idx", T.english_tokens(F.coalesce("heard", F.lit(""))).alias("heard")), ["file_id", "seg_idx"])

    @F.pandas_udf("array<string>")
    def lost(before: pd.Series, after: pd.Series, heard: pd.Series) -> pd.Series:
        return pd.Series([missing_phrase(list(b), list(a), list(h)) for b, a, h in zip(before, after, heard, strict=True)])

    found = both.withColumn("lost", lost("before", "after", "heard")).where(F.size("lost") > 0)
    first = found.withColumn("_k", F.row_number().over(W.partitionBy("file_id").orderBy("seg_idx"))).where(F.col("_k") <= most)
    source = F.struct((F.col("window_start_ms") / 1000).alias("window_start"), (F.col("window_end_ms") / 1000).alias("window_end"), T.english_prefix(F.col("lost")).alias("text"))
    out = segments.join(first.select("file_id", "seg_idx", source.alias("boundary_prefix_source")), ["file_id", "seg_idx"], "left")
    prefix = F.col("boundary_prefix_source")["text"]
    out = out.withColumn("boundary_prefix_repaired", F.when(prefix.isNotNull(), True))
    return out.withColumn("text", F.when(prefix.isNotNull(), F.concat(prefix, F.lit(" "), F.regexp_replace("text", r"(?U)^\s+", ""))).otherwise(F.col("text")))


def scripted_decoder(texts: dict[tuple[int, int], str]) -> Callable[[DataFrame], DataFrame]:
    """A double of ``decode``: what is heard at (file_id, seg_idx)."""

    def decode(windows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"file_id": pdf["file_id"], "seg_idx": pdf["seg_idx"], "heard": [texts.get((f, s)) for f, s in zip(pdf["file_id"], pdf["seg_idx"], strict=True)]})

        return windows.select("file_id", "seg_idx").mapInPandas(run, "file_id long, seg_idx int, heard string")

    return decode
