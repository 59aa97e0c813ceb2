"""Ordered operators on the segments of a file.

Operators whose rule looks only at neighbours are windows.  Folds, where a row depends on the
previous *output*, are streaming passes with a constant state (``folds``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.text import strip, strip_filler_prefix
from parlance.operators.folds import ORDER, Apart, Boundaries, Turns, linear_fold, reach_afresh, turns_afresh


def by_file(*more: str):
    return W.partitionBy("file_id", *more).orderBy(*ORDER)


# Limits of turns by language (gap, duration, characters of a turn; the same of merged turns), in ms
TURN_LIMITS = {"en": ((800, 36_000, 420), (1_200, 40_000, 560)), "zh": ((500, 15_000, 80), (1_600, 15_000, 70))}


def merge_turns(segments: DataFrame, max_gap: int = 1_600, max_dur: int = 15_000, max_chars: int = 80) -> DataFrame:
    """Neighbours of one speaker merge while gap, duration and length of the joined text allow.

    A single character that lasted over a second, followed by a pause over half a second, is noise
    before speech: the merged turn then starts shortly before the second.  A merged turn ends where its
    last one does, so a gap between neighbours is the gap to the merged turn, and the fold starts afresh there.
    Rows without a speaker or a time merge with none.
    """
    return linear_fold(segments, ["file_id"], ["speaker", "text"], lambda: Turns(max_gap, max_dur, max_chars, True, lambda a, b, both: len(both)), turns_afresh(max_gap))


def dedupe_boundaries(segments: DataFrame, gap: int = 40) -> DataFrame:
    """A segment that starts before the kept one's end starts ``gap`` after it, and goes if nothing is left.

    A gap to everything before it ends an overlap for good.  Rows without a time go.
    """
    return linear_fold(segments, ["file_id"], ["speaker", "text"], lambda: Boundaries(gap), reach_afresh(gap), by_reach=True)


def reattach_fragments(segments: DataFrame) -> DataFrame:
    """A tiny drifted fragment joins the same speaker's next segment; pairs are used up left to right.

    Whether two neighbours may pair hangs on the input alone, so in a run of rows that each may pair with the
    next, the first, third, ... of the run do: windows only, no fold.
    """
    w, text = by_file(), strip("text")
    gap = F.lead("start_ms").over(w) - F.col("end_ms")
    may = F.lead("speaker").over(w).eqNullSafe(F.col("speaker")) & gap.between(0, 8_000) & F.length(text).between(1, 2) & (F.col("end_ms") - F.col("start_ms") > 800)
    marked = segments.withColumn("_may", F.coalesce(may, F.lit(False)))
    before = F.sum((~F.col("_may")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = marked.withColumn("_run", F.coalesce(before, F.lit(0)))
    place = F.row_number().over(W.partitionBy("file_id", "_run").orderBy(*ORDER))
    gives = runs.withColumn("_gives", F.col("_may") & (place % 2 == 1))
    taken = gives.withColumn("_takes", F.coalesce(F.lag("_gives").over(w), F.lit(False))).withColumn("_text", F.lag(strip("text")).over(w)).withColumn("_from", F.lag("start_ms").over(w))
    out = taken.where(~F.col("_gives"))
    out = out.withColumn("text", F.when(F.col("_takes"), F.concat("_text", "text")).otherwise(F.col("text"))).withColumn("start_alignment_raw_ms", F.when(F.col("_takes"), F.col("_from")))
    out = out.withColumn("start_ms", F.when(F.col("_takes"), F.greatest(F.lit(0), F.col("start_ms") - 350)).otherwise(F.col("start_ms")))
    return out.drop("_may", "_run", "_gives", "_takes", "_text", "_from")


def neighbor_playback(segments: DataFrame) -> DataFrame:
    """Playback bounds that do not clip a neighbour: two passes of neighbour windows."""
    w = by_file()
    ps, pe = F.coalesce("playback_start_ms", F.greatest(F.lit(0), F.col("start_ms") - 50)), F.coalesce("playback_end_ms", "end_ms")
    before = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) <= 300, F.lit(False))
    after = F.coalesce(F.lead("start_ms").over(w) - F.col("end_ms") <= 300, F.lit(False))
    one = segments.withColumn("_after", after).withColumn("_s", F.when(before & (ps - F.col("start_ms") <= 500), F.least(ps, F.greatest(F.lit(0), F.col("start_ms") - 60))).otherwise(ps)).withColumn("_e", F.when(after, F.least(pe, F.col("end_ms"))).otherwise(pe))
    good = F.col("_e") > F.col("_s")
    one = one.withColumn("playback_start_ms", F.when(good, F.col("_s")).otherwise(F.col("playback_start_ms"))).withColumn("playback_end_ms", F.when(good, F.col("_e")).otherwise(F.col("playback_end_ms"))).drop("_s", "_e")
    starts = F.coalesce("playback_start_ms", "start_ms")
    one = one.withColumn("_cap", F.lead(starts).over(w) - 20)
    cut = F.col("_after") & (F.col("_cap") > starts)
    return one.withColumn("playback_end_ms", F.when(cut, F.least(F.coalesce("playback_end_ms", "_cap"), F.col("_cap"))).otherwise(F.col("playback_end_ms"))).drop("_cap", "_after")


def presplit(segments: DataFrame, max_dur: int = 15_000, max_chars: int = 80) -> DataFrame:
    """Equal slices of over-long segments; blank slices take no time.  Others pass as they are, blank ones too."""
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.ceil(F.length(text) / max_chars), F.ceil((F.col("end_ms") - F.col("start_ms")) / max_dur), F.lit(1))
    cut = segments.withColumn("n", n.cast("long")).withColumn("size", F.ceil(F.length(text) / n).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    slice_ = strip(F.substring(text, (F.col("k") * F.col("size") + 1).cast("int"), F.col("size")))
    cut = cut.withColumn("part", F.when(F.col("n") == 1, F.col("text")).otherwise(slice_)).where("n = 1 or part <> ''")
    j = F.row_number().over(W.partitionBy("file_id", "seg_idx").orderBy("k")) - 1
    step = (F.col("end_ms") - F.col("start_ms")) / F.col("n")
    return cut.withColumn("j", j).select("file_id", "seg_idx", F.col("j").alias("part_idx"), "speaker", F.col("part").alias("text"), F.round(F.col("start_ms") + F.col("j") * step, 3).alias("start_ms"), F.round(F.col("start_ms") + (F.col("j") + 1) * step, 3).alias("end_ms"))


def chunk_windows(files: DataFrame, size: int = 30_000, step: int = 25_000) -> DataFrame:
    """Overlapping chunks of each file (file_id, total_ms): one if it fits, else hops to the end."""
    n = F.when(F.col("total_ms") <= size, 1).otherwise(F.ceil((F.col("total_ms") - (size - step)) / step))
    return files.withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))).select("file_id", "chunk_index", (F.col("chunk_index") * step).alias("chunk_start_ms"), (F.col("chunk_index") * step + size).alias("chunk_end_ms"))


def chunk_dedupe(segments: DataFrame) -> DataFrame:
    """Drops a segment that overlaps a kept one with the same stripped text.

    In order of start the kept segment that reaches furthest decides.  Segments without a length, or a time, stay.
    """
    keyed = segments.withColumn("_text", strip(F.col("text")))
    return linear_fold(keyed, ["file_id", "_text"], ["speaker", "text"], Apart, reach_afresh(0), by_reach=True)


def merge_regions(regions: DataFrame, gap: int = 1_500, pad: int = 0) -> DataFrame:
    """Regions closer than ``gap`` become one: running end, then islands."""
    padded = regions.select("file_id", F.greatest(F.lit(0), F.col("start_ms") - pad).alias("start_ms"), (F.col("end_ms") + pad).alias("end_ms"))
    w = W.partitionBy("file_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = padded.withColumn("_new", F.coalesce(F.col("start_ms") - reach > gap, F.lit(True)).cast("int"))
    numbered = marked.withColumn("region_idx", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("file_id", "region_idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def speech_chunks(regions: DataFrame, files: DataFrame, gap: int = 1_500, pad: int = 2_000, longest: int = 20_000) -> DataFrame:
    """What to decode of each file (file_id, total_ms): merged regions, padded, in chunks of at most ``longest``.

    Columns: region_idx, chunk_idx, the chunk's bounds, and the region's own (``valid_``), to which results are
    clipped.  Chunks under a quarter of a second are left out.
    """
    inside = regions.join(files, "file_id").select("file_id", "total_ms", F.greatest(F.lit(0), F.col("start_ms")).alias("start_ms"), F.least("end_ms", "total_ms").alias("end_ms")).where("end_ms > start_ms")
    merged = merge_regions(inside.drop("total_ms"), gap).join(files, "file_id")
    lo, hi = F.greatest(F.lit(0), F.col("start_ms") - pad), F.least("total_ms", F.col("end_ms") + pad)
    wide = merged.withColumn("lo", lo).withColumn("hi", hi).where("hi - lo >= 250").withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), F.ceil((F.col("hi") - F.col("lo")) / longest).cast("int") - 1)))
    at = F.col("lo") + F.col("chunk_idx") * longest
    chunks = wide.select("file_id", "region_idx", "chunk_idx", at.alias("chunk_start_ms"), F.least("hi", at + longest).alias("chunk_end_ms"), F.col("start_ms").alias("valid_start_ms"), F.col("end_ms").alias("valid_end_ms"))
    return chunks.where("chunk_end_ms - chunk_start_ms >= 250")


def restore_chunks(decoded: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments of chunks (file_id, region_idx, chunk_idx, start_ms, end_ms, text, in the chunk's time) in the file's time.

    A segment without a length gets a tenth of a second; what lies outside the region's bounds goes, the rest is
    clipped to them.  Blank texts go.
    """
    both = decoded.where(strip(F.coalesce("text", F.lit(""))) != "").join(chunks, ["file_id", "region_idx", "chunk_idx"])
    s, e = F.col("start_ms") + F.col("chunk_start_ms"), F.col("end_ms") + F.col("chunk_start_ms")
    both = both.withColumn("s", s).withColumn("e", F.when(e <= s, F.least("chunk_end_ms", s + 100)).otherwise(e)).where("e >= valid_start_ms and s <= valid_end_ms")
    out = both.select("file_id", F.greatest("valid_start_ms", "s").alias("start_ms"), F.least("valid_end_ms", "e").alias("end_ms"), strip("text").alias("text"))
    return out.where("end_ms > start_ms")


def words_to_turns(words: DataFrame, max_gap: int = 500, max_dur: int = 15_000, max_chars: int = 80, max_word: int = 2_500) -> DataFrame:
    """Words become turns: new on speaker change, pause, duration or length; over-long words are evened out."""
    word = strip("word")
    timed = words.where("start_ms is not null and end_ms > start_ms").withColumn("word", word).where("word <> ''").withColumn("speaker", F.coalesce("speaker", F.lit("SPEAKER_UNKNOWN")))
    long, n = F.col("end_ms") - F.col("start_ms") > max_word, F.length("word")
    share = (F.col("end_ms") - F.col("start_ms")) / n
    whole = F.array(F.struct(F.col("word").alias("text"), F.col("start_ms").cast("double").alias("s"), F.when(long, F.col("start_ms") + max_word).otherwise(F.col("end_ms")).cast("double").alias("e")))
    split = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.substring("word", i + 1, F.lit(1)).alias("text"), (F.col("start_ms") + i * share).cast("double").alias("s"), (F.col("start_ms") + (i + 1) * share).cast("double").alias("e")))
    flat = timed.select("file_id", "speaker", F.col("word_idx"), F.posexplode(F.when(long & (n > 2), split).otherwise(whole)).alias("p", "x")).select("file_id", "speaker", (F.col("word_idx") * 1000 + F.col("p")).alias("seg_idx"), F.col("x.text").alias("text"), F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"))
    flat = flat.where(strip("text") != "")
    # the two texts count, not the space between them
    turns = linear_fold(flat, ["file_id"], ["speaker", "text"], lambda: Turns(max_gap, max_dur, max_chars, False, lambda a, b, both: len(a) + len(b)), turns_afresh(max_gap))
    return turns.where((strip("text") != "") & (F.col("end_ms") - F.col("start_ms") >= 50))


def refine_playback(segments: DataFrame, rewind: int = 350, first_rewind: int = 1_200, tail: int = 650) -> DataFrame:
    """Start and playback bounds from the activity regions of a segment (column ``regions``, by start).

    With a column ``total_ms`` segments end within the file.  Segments without a length go; those without
    regions pass as they are.  ``start_asr_raw_ms`` keeps a start that was moved.
    """
    w = by_file()
    total = F.col("total_ms") if "total_ms" in segments.columns else F.lit(None).cast("long")
    rows = segments.withColumn("_first", F.row_number().over(w) == 1).withColumn("_s", F.greatest(F.lit(0), F.col("start_ms"))).withColumn("_e", F.least(F.col("end_ms"), total)).where("_e > _s")
    text = strip(F.coalesce("text", F.lit("")))
    short, regions = F.length(text) <= 8, F.col("regions")
    first = F.get(regions, F.lit(0))
    later = F.filter(F.slice(regions, 2, F.greatest(F.size(regions) - 1, F.lit(1))), lambda r: r["start_ms"] - first["end_ms"] >= 1_200)
    noisy = (F.col("_s") <= 500) & (F.size(regions) >= 2) & (first["start_ms"] <= 1_000) & (first["end_ms"] - first["start_ms"] <= 700) & (F.size(later) > 0)
    widest = F.get(F.array_sort(regions, lambda a, b: F.when(a["overlap"] > b["overlap"], -1).when(a["overlap"] < b["overlap"], 1).when(a["start_ms"] < b["start_ms"], -1).when(a["start_ms"] > b["start_ms"], 1).otherwise(0)), F.lit(0))
    region = F.when(F.coalesce(noisy, F.lit(False)), F.get(later, F.lit(0))).when(short, widest).otherwise(first)
    rows = rows.withColumn("_new", F.greatest(F.col("_s"), region["start_ms"] - 350)).withColumn("_known", F.size(regions) > 0)
    shift = F.col("_new") - F.col("_s")
    rows = rows.withColumn("_shifts", F.coalesce(F.col("_known") & (shift >= 500) & (F.col("_e") - F.col("_new") >= 500), F.lit(False)))
    near = shift <= F.when(short | (F.col("_s") <= 500), 20_000).otherwise(1_500)
    bare = strip_filler_prefix(text)
    rows = rows.withColumn("_near", F.col("_shifts") & near).withColumn("_bare", F.when(F.col("_shifts") & ~near & (bare != "") & (bare != text), bare))
    moves = F.col("_near") | F.col("_bare").isNotNull()
    rows = rows.withColumn("_moves", moves).withColumn("text", F.coalesce("_bare", "text")).withColumn("start_asr_raw_ms", F.when(F.col("_moves"), F.col("_s"))).withColumn("start_ms", F.when(F.col("_moves"), F.col("_new")).otherwise(F.col("start_ms")))
    display, point = F.greatest(F.lit(0), F.col("start_ms")), F.when(F.col("_shifts"), F.col("_new")).otherwise(F.col("_s"))
    back = F.when(F.col("_first"), first_rewind).otherwise(rewind)
    begin = F.greatest(F.lit(0), F.least(display, F.greatest(F.col("_s"), point - back)) - 50)
    end = F.least(F.col("_e") + tail, total)
    plays = F.col("_known") & (end > F.col("_e"))
    rows = rows.withColumn("playback_start_ms", F.when(plays, begin)).withColumn("playback_end_ms", F.when(plays, end))
    return rows.drop("_first", "_s", "_e", "_new", "_known", "_shifts", "_near", "_bare", "_moves")
