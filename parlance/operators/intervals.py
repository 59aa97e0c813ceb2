"""Interval joins and what is computed from overlaps.

All times are in one unit (the views use milliseconds).  Every join has an equality key
(``file_id``) and, on top of it, a time bucket, so a very long file is cut into pieces (``sweep``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.operators.sweep import overlap_join

UNKNOWN = "SPEAKER_UNKNOWN"


def best_speaker(overlaps: DataFrame, key: list[str]) -> DataFrame:
    """Per key the speaker with the greatest total overlap; ties go to the one heard first."""
    per = overlaps.groupBy(*key, "r_speaker").agg(F.sum("overlap").alias("total"), F.min("r_diar_idx").alias("first"))
    return per.groupBy(*key).agg(F.max_by("r_speaker", F.struct(F.col("total"), -F.col("first"))).alias("best"), F.max("total").alias("best_overlap"))


def align_speakers(segments: DataFrame, diar: DataFrame, min_ratio: float = 0.5, min_overlap: int = 250) -> DataFrame:
    """Speaker of each segment by overlap: enough of it, or enough time, else SPEAKER_UNKNOWN."""
    kept = segments.where("end_ms > start_ms")
    best = best_speaker(overlap_join(kept.select("file_id", "seg_idx", "start_ms", "end_ms"), diar), ["file_id", "seg_idx"])
    enough = (F.col("best_overlap") / (F.col("end_ms") - F.col("start_ms")) >= min_ratio) | (F.col("best_overlap") >= min_overlap)
    out = kept.drop("speaker").join(best, ["file_id", "seg_idx"], "left")
    return out.withColumn("speaker", F.when(F.coalesce(enough, F.lit(False)), F.col("best")).otherwise(UNKNOWN)).withColumn("overlap_ms", F.coalesce("best_overlap", F.lit(0))).drop("best", "best_overlap")


def speech_gate(segments: DataFrame, regions: DataFrame, pad: int = 350) -> DataFrame:
    """Keeps segments with enough speech activity; files without regions pass unchanged.

    Regions are padded and not merged, so padding may count twice.
    """
    dur, n = F.col("end_ms") - F.col("start_ms"), F.length("text")
    need = F.when((dur >= 10_000) | (n >= 28), F.greatest(F.lit(900.0), 0.12 * dur)).when((dur >= 4_000) | (n >= 14), F.greatest(F.lit(350.0), 0.08 * dur)).otherwise(160.0)
    heard = overlap_join(segments.select("file_id", "seg_idx", "start_ms", "end_ms"), regions, pad).groupBy("file_id", "seg_idx").agg(F.sum("overlap").alias("speech_overlap_ms"))
    known = regions.select("file_id").distinct().withColumn("gated", F.lit(True))
    out = segments.join(heard, ["file_id", "seg_idx"], "left").join(known, "file_id", "left").withColumn("speech_overlap_ms", F.when(F.col("gated"), F.coalesce("speech_overlap_ms", F.lit(0))))
    return out.where(F.col("gated").isNull() | ((dur > 0) & (F.col("speech_overlap_ms") >= need))).withColumn("speech_overlap_ratio", F.round(F.col("speech_overlap_ms") / F.when(dur > 0, dur), 3)).drop("gated")


def best_match(ref: DataFrame, hyp: DataFrame, least: int, *more: str) -> DataFrame:
    """file_id, seg_idx, m: the hypothesis of greatest overlap with a reference segment (the first wins), with further columns."""
    pairs = overlap_join(ref.select("file_id", "seg_idx", "start_ms", "end_ms"), hyp).where(F.col("overlap") >= least)
    return pairs.groupBy("file_id", "seg_idx").agg(F.max_by(F.struct("r_seg_idx", "r_start_ms", "r_end_ms", "overlap", *more), F.struct("overlap", -F.col("r_seg_idx"))).alias("m"))


def match_by_overlap(ref: DataFrame, hyp: DataFrame, least: int = 50) -> DataFrame:
    """Each reference segment with the one hypothesis of greatest overlap (first wins), if any."""
    best = best_match(ref, hyp, least)
    return ref.join(best, ["file_id", "seg_idx"], "left").select(*ref.columns, F.col("m.r_seg_idx").alias("hyp_idx"), F.col("m.r_start_ms").alias("hyp_start_ms"), F.col("m.r_end_ms").alias("hyp_end_ms"), F.col("m.overlap").alias("overlap_ms"))


def time_metrics(ref: DataFrame, hyp: DataFrame, least: int = 50, tolerance: int = 200) -> DataFrame:
    """Per file of ``ref``: match rate over its segments; of the matches, boundary errors, hits within half
    a second and a second at both ends, coverage, and speech before and after.

    The hypothesis' playback bounds count where it has them.  A file without a match has rates of 0 and no errors.
    """
    for name in ("start", "end"):
        played = f"playback_{name}_ms"
        if played not in hyp.columns:
            hyp = hyp.withColumn(played, F.lit(None).cast("long"))
    best = best_match(ref, hyp, least, "r_playback_start_ms", "r_playback_end_ms")
    m = ref.join(best, ["file_id", "seg_idx"], "left").withColumn("hs", F.coalesce("m.r_playback_start_ms", "m.r_start_ms")).withColumn("he", F.coalesce("m.r_playback_end_ms", "m.r_end_ms"))
    ds, de = F.abs(F.col("hs") - F.col("start_ms")), F.abs(F.col("he") - F.col("end_ms"))
    n, matched = F.greatest(F.count("*"), F.lit(1)), F.count("hs")
    of_matches = lambda condition: F.coalesce(F.round(F.count_if(condition) / F.when(matched > 0, matched), 4), F.lit(0.0))
    covers = (F.col("hs") <= F.col("start_ms") + tolerance) & (F.col("he") >= F.col("end_ms") - tolerance)
    # greatest() skips nulls, so segments without a match are left out by hand
    excess = lambda x: F.round(F.avg(F.when(F.col("hs").isNotNull(), F.greatest(F.lit(0), x))), 4)
    return m.groupBy("file_id").agg(
        F.count("*").alias("n_ref"),
        matched.alias("n_matched"),
        F.round(matched / n, 4).alias("match_rate"),
        F.round(F.avg(ds), 4).alias("start_mae_ms"),
        F.round(F.avg(de), 4).alias("end_mae_ms"),
        of_matches((ds <= 500) & (de <= 500)).alias("hit_half"),
        of_matches((ds <= 1000) & (de <= 1000)).alias("hit_one"),
        of_matches(covers).alias("coverage"),
        excess(F.col("start_ms") - F.col("hs")).alias("prefix_excess_ms"),
        excess(F.col("he") - F.col("end_ms")).alias("suffix_excess_ms"),
    )


def energy_gate(diar: DataFrame, activity: DataFrame, least: int = 250, ratio: float = 0.2) -> DataFrame:
    """Drops speaker regions with too little activity in time and in share."""
    named = diar.withColumnRenamed("diar_idx", "seg_idx")
    active = overlap_join(named.select("file_id", "seg_idx", "start_ms", "end_ms"), activity).groupBy("file_id", "seg_idx").agg(F.sum("overlap").alias("active_ms"))
    out = named.join(active, ["file_id", "seg_idx"], "left").withColumn("active_ms", F.coalesce("active_ms", F.lit(0)))
    return out.where((F.col("active_ms") >= least) | (F.col("active_ms") / (F.col("end_ms") - F.col("start_ms")) >= ratio)).withColumnRenamed("seg_idx", "diar_idx")


def nearest_speaker(words: DataFrame, diar: DataFrame) -> DataFrame:
    """Speaker of each word: greatest overlap, else the nearest region of its file."""
    best = best_speaker(overlap_join(words.select("file_id", "seg_idx", "start_ms", "end_ms"), diar), ["file_id", "seg_idx"])
    joined = words.drop("speaker").join(best.select("file_id", "seg_idx", F.col("best").alias("speaker")), ["file_id", "seg_idx"], "left")
    lone = joined.where("speaker is null").drop("speaker")
    # as-of in both directions over the union of the two, instead of pairing every word with every region
    marks = diar.select("file_id", F.col("end_ms").alias("at"), F.lit(0).alias("side"), F.struct("end_ms", F.col("start_ms").alias("s"), "diar_idx", "speaker").alias("d"), F.lit(None).cast("int").alias("seg_idx"))
    ends = marks.unionByName(lone.select("file_id", F.col("start_ms").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(marks.schema["d"].dataType).alias("d"), "seg_idx"))
    begins = diar.select("file_id", F.col("start_ms").alias("at"), F.lit(1).alias("side"), F.struct("end_ms", F.col("start_ms").alias("s"), "diar_idx", "speaker").alias("d"), F.lit(None).cast("int").alias("seg_idx")).unionByName(lone.select("file_id", F.col("end_ms").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(marks.schema["d"].dataType).alias("d"), "seg_idx"))
    order = W.partitionBy("file_id").orderBy("at", "side", F.col("d.diar_idx"))
    before = ends.withColumn("b", F.last("d", True).over(order.rowsBetween(W.unboundedPreceding, 0))).where("seg_idx is not null").select("file_id", "seg_idx", "b")
    after = begins.withColumn("a", F.first("d", True).over(order.rowsBetween(0, W.unboundedFollowing))).where("seg_idx is not null").select("file_id", "seg_idx", "a")
    near = lone.join(before, ["file_id", "seg_idx"]).join(after, ["file_id", "seg_idx"])
    left, right = F.col("start_ms") - F.col("b.end_ms"), F.col("a.s") - F.col("end_ms")
    nearest = F.when(left.isNotNull() & (right.isNull() | (left <= right)), F.col("b.speaker")).otherwise(F.col("a.speaker"))
    found = near.withColumn("speaker", F.coalesce(nearest, F.lit(UNKNOWN))).drop("a", "b")
    return joined.where("speaker is not null").unionByName(found)


def regions_or_fallback(segments: DataFrame, vad: DataFrame, diar: DataFrame, least: int = 50) -> DataFrame:
    """Each segment with its activity regions, or the speaker regions where it has none."""
    base = segments.select("file_id", "seg_idx", "start_ms", "end_ms")
    gather = lambda r, name: overlap_join(base, r.select("file_id", "start_ms", "end_ms")).where(F.col("overlap") > least).groupBy("file_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("r_start_ms").alias("start_ms"), F.col("r_end_ms").alias("end_ms"), "overlap"))).alias(name))
    return segments.join(gather(vad, "v"), ["file_id", "seg_idx"], "left").join(gather(diar, "d"), ["file_id", "seg_idx"], "left").withColumn("regions", F.coalesce("v", "d", F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,overlap:bigint>>"))).drop("v", "d")


def align_words(segments: DataFrame, words: DataFrame, diar: DataFrame) -> DataFrame:
    """Times and speaker of a segment from its words (a word belongs by its midpoint)."""
    w = W.partitionBy("file_id").orderBy("start_ms", "end_ms", "seg_idx")
    s = segments.where("end_ms > start_ms").withColumn("gap_before", F.col("start_ms") - F.lag("end_ms").over(w)).withColumn("gap_after", F.lead("start_ms").over(w) - F.col("end_ms"))
    wide = s.withColumn("o_start", F.col("start_ms")).withColumn("o_end", F.col("end_ms")).withColumn("start_ms", F.col("o_start") - 300).withColumn("end_ms", F.col("o_end") + 300)
    mine = overlap_join(wide, words.withColumn("start_ms", F.col("start_ms")).select("file_id", "word_idx", "word", "start_ms", "end_ms", "speaker"))
    mid = (F.col("r_start_ms") + F.col("r_end_ms")) / 2
    mine = mine.where((mid >= F.col("start_ms")) & (mid <= F.col("end_ms")))
    mine = mine.where(~((F.col("r_end_ms") <= F.col("o_start") + 50) & F.coalesce(F.col("gap_before") <= 500, F.lit(False))) & ~((F.col("r_start_ms") >= F.col("o_end") - 20) & F.coalesce(F.col("gap_after") <= 500, F.lit(False))))
    key = ["file_id", "seg_idx"]
    timed = mine.groupBy(*key).agg(F.min_by("r_start_ms", "r_word_idx").alias("w_start"), F.max_by("r_end_ms", "r_word_idx").alias("w_end"), F.sum(F.length("r_word")).alias("w_chars"))
    voice = mine.where(~F.coalesce(F.upper("r_speaker").contains("UNKNOWN"), F.lit(True))).groupBy(*key, "r_speaker").agg(F.sum(F.col("r_end_ms") - F.col("r_start_ms")).alias("d"), F.min("r_word_idx").alias("f")).groupBy(*key).agg(F.max_by("r_speaker", F.struct("d", -F.col("f"))).alias("by_words"))
    by_diar = best_speaker(overlap_join(segments.select(*key, "start_ms", "end_ms"), diar), key).select(*key, "best")
    out = segments.drop("speaker").join(timed, key).join(voice, key, "left").join(by_diar, key, "left")
    out = out.where((F.length("text") < 8) | (F.col("w_chars") / F.length("text") >= 0.35))
    return out.withColumn("speaker", F.coalesce("by_words", "best", F.lit("UNKNOWN"))).withColumn("start_ms", F.col("w_start")).withColumn("end_ms", F.col("w_end")).drop("by_words", "best", "w_start", "w_end", "w_chars")


def late_updates(live: DataFrame, late: DataFrame, within: int = 2_000) -> DataFrame:
    """Late texts go to the nearest live segment (by start) still in phase asr."""
    r = late.select("file_id", F.col("late_idx"), F.col("start_ms").alias("l_start"), F.col("text").alias("l_text"))
    cell = lambda c: F.floor(c / within)
    a = live.where("phase = 'asr'").withColumn("_c", cell(F.col("start_ms")))
    b = r.withColumn("_c", F.explode(F.array(cell(F.col("l_start")) - 1, cell(F.col("l_start")), cell(F.col("l_start")) + 1)))
    pairs = a.join(b, ["file_id", "_c"]).withColumn("d", F.abs(F.col("start_ms") - F.col("l_start"))).where(F.col("d") <= within)
    chosen = pairs.groupBy("file_id", "late_idx").agg(F.min_by(F.struct("seg_idx", "l_text"), F.struct("d", "seg_idx")).alias("x")).groupBy("file_id", F.col("x.seg_idx").alias("seg_idx")).agg(F.max_by("x.l_text", "late_idx").alias("l_text"))
    out = live.join(chosen, ["file_id", "seg_idx"], "left")
    changed = F.col("l_text").isNotNull() & (F.col("l_text") != F.col("text"))
    return out.withColumn("phase", F.when(changed, "corrected").otherwise(F.col("phase"))).withColumn("text", F.coalesce("l_text", "text")).drop("l_text")


def diarization_error(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Per file: reference, missed, false and confused speech over elementary intervals.

    Hypothesis speakers are mapped greedily, one to one, by overlap; no collar.
    """
    marks = lambda d, side: d.select("file_id", F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("step")))).alias("m"), F.lit(side).alias("side"))
    cuts = marks(ref, "r").unionByName(marks(hyp, "h")).groupBy("file_id", "m.at").agg(F.sum(F.when(F.col("side") == "r", F.col("m.step")).otherwise(0)).alias("r"), F.sum(F.when(F.col("side") == "h", F.col("m.step")).otherwise(0)).alias("h"))
    w = W.partitionBy("file_id").orderBy("at")
    run = cuts.select("file_id", "at", F.sum("r").over(w).alias("r"), F.sum("h").over(w).alias("h"), (F.lead("at").over(w) - F.col("at")).alias("d")).where("d is not null")
    both = run.groupBy("file_id").agg(F.sum(F.col("r") * F.col("d")).alias("total_ms"), F.sum(F.greatest(F.col("r") - F.col("h"), F.lit(0)) * F.col("d")).alias("missed_ms"), F.sum(F.greatest(F.col("h") - F.col("r"), F.lit(0)) * F.col("d")).alias("false_ms"), F.sum(F.least("r", "h") * F.col("d")).alias("both_ms"))
    mapped = speaker_mapping(ref, hyp)
    right = speaker_overlaps(ref, hyp).join(mapped, ["file_id", "hyp_speaker"]).where("ref_speaker = mapped").groupBy("file_id").agg(F.sum("overlap_ms").alias("right_ms"))
    out = both.join(right, "file_id", "left").withColumn("confused_ms", F.greatest(F.lit(0), F.col("both_ms") - F.coalesce("right_ms", F.lit(0))))
    return out.select("file_id", "total_ms", "missed_ms", "false_ms", "confused_ms", F.round((F.col("missed_ms") + F.col("false_ms") + F.col("confused_ms")) / F.greatest("total_ms", F.lit(1)), 4).alias("error_rate"))


def speaker_overlaps(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    return overlap_join(ref, hyp).groupBy("file_id", F.col("r_speaker").alias("hyp_speaker"), F.col("speaker").alias("ref_speaker")).agg(F.sum("overlap").alias("overlap_ms"))


def greedy_pairs(overlaps: DataFrame) -> DataFrame:
    """file_id, hyp_speaker, mapped: pairs taken one to one, greatest overlap first (ties by name).

    Native fold over a file's few speaker pairs.
    """
    pairs = overlaps.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("overlap_ms")).alias("o"), "hyp_speaker", "ref_speaker"))).alias("pairs"))
    empty = F.array().cast("array<struct<hyp_speaker:string,ref_speaker:string>>")
    free = lambda acc, x: ~F.exists(acc, lambda a: (a["hyp_speaker"] == x["hyp_speaker"]) | (a["ref_speaker"] == x["ref_speaker"]))
    add = lambda acc, x: F.concat(acc, F.array(F.struct(x["hyp_speaker"].alias("hyp_speaker"), x["ref_speaker"].alias("ref_speaker"))))
    chosen = F.aggregate("pairs", empty, lambda acc, x: F.when(free(acc, x), add(acc, x)).otherwise(acc))
    return pairs.select("file_id", F.explode(chosen).alias("c")).select("file_id", "c.hyp_speaker", F.col("c.ref_speaker").alias("mapped"))


def speaker_mapping(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Greedy bijection by overlap; speakers left over map to themselves."""
    chosen = greedy_pairs(speaker_overlaps(ref, hyp))
    return hyp.select("file_id", F.col("speaker").alias("hyp_speaker")).distinct().join(chosen, ["file_id", "hyp_speaker"], "left").withColumn("mapped", F.coalesce("mapped", "hyp_speaker"))


def speaker_spans(segments: DataFrame) -> DataFrame:
    """A speaker's segments of a file, those that touch or overlap as one: file_id, speaker, start_ms, end_ms."""
    w = W.partitionBy("file_id", "speaker").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    named = segments.where("end_ms > start_ms").select("file_id", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), "start_ms", "end_ms")
    marked = named.withColumn("_new", F.coalesce(F.col("start_ms") > reach, F.lit(True)).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("file_id", "speaker", "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_run")


def without_zones(spans: DataFrame, zones: DataFrame) -> DataFrame:
    """What is left of the spans outside the zones (disjoint ones of each file)."""
    keyed = spans.withColumn("seg_idx", F.row_number().over(W.partitionBy("file_id").orderBy("start_ms", "end_ms", "speaker")))
    met = overlap_join(keyed, zones).groupBy("file_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("r_start_ms").alias("s"), F.col("r_end_ms").alias("e")))).alias("z"))
    both = keyed.join(met, ["file_id", "seg_idx"], "left").withColumn("z", F.coalesce("z", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    begins = F.concat(F.array("start_ms"), F.transform("z", lambda x: x["e"]))
    ends = F.concat(F.transform("z", lambda x: x["s"]), F.array("end_ms"))
    parts = both.select("file_id", "speaker", F.explode(F.arrays_zip(begins.alias("s"), ends.alias("e"))).alias("p"))
    return parts.select("file_id", "speaker", F.col("p.s").alias("start_ms"), F.col("p.e").alias("end_ms")).where("end_ms > start_ms")


def best_assignment(gain: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment of greatest total gain, by shortest augmenting paths."""
    if not gain or not gain[0]:
        return []
    if len(gain) > len(gain[0]):
        return [(i, j) for j, i in best_assignment([list(c) for c in zip(*gain, strict=True)])]
    n, m = len(gain), len(gain[0])
    row_price, column_price, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            done[at] = True
            row, step, nearest = owner[at], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    cost = -gain[row - 1][j - 1] - row_price[row] - column_price[j]
                    if cost < least[j]:
                        least[j], back[j] = cost, at
                    if least[j] < step:
                        step, nearest = least[j], j
            for j in range(m + 1):
                if done[j]:
                    row_price[owner[j]] += step
                    column_price[j] -= step
                else:
                    least[j] -= step
            at = nearest
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return sorted((owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])


def diarization_report(ref: DataFrame, hyp: DataFrame, collar_ms: int = 250, duration_ms: int | None = None) -> DataFrame:
    """Per file: total, missed, false and confused speech, error rate and Jaccard error rate.

    Half the collar on either side of each reference boundary is left out, on both sides.  Speakers are
    mapped one to one by the assignment of greatest common time, computed per file over its speaker
    pairs.  The Jaccard rate is the mean over reference speakers of one minus common time over united
    time with the speaker mapped to them (one if there is none).  Without reference speech both rates are null.
    """
    from parlance.operators.sequence import merge_regions

    crop = lambda d: d if duration_ms is None else d.withColumn("end_ms", F.least("end_ms", F.lit(duration_ms)))
    r, h = speaker_spans(crop(ref)), speaker_spans(crop(hyp))
    if collar_ms:
        half = collar_ms // 2
        edges = crop(ref).where("end_ms > start_ms").select("file_id", F.explode(F.array("start_ms", "end_ms")).alias("at"))
        zones = merge_regions(edges.select("file_id", (F.col("at") - half).alias("start_ms"), (F.col("at") + half).alias("end_ms")), gap=0)
        r, h = without_zones(r, zones), without_zones(h, zones)
    marks = lambda d, side: d.select("file_id", F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("step")))).alias("m"), F.lit(side).alias("side"))
    step = lambda side: F.sum(F.when(F.col("side") == side, F.col("m.step")).otherwise(0)).alias(side)
    cuts = marks(r, "r").unionByName(marks(h, "h")).groupBy("file_id", "m.at").agg(step("r"), step("h"))
    w = W.partitionBy("file_id").orderBy("at")
    run = cuts.select("file_id", F.sum("r").over(w).alias("r"), F.sum("h").over(w).alias("h"), (F.lead("at").over(w) - F.col("at")).alias("d")).where("d is not null")
    part = lambda x, name: F.sum(x * F.col("d")).alias(name)
    both = run.groupBy("file_id").agg(part(F.col("r"), "total_ms"), part(F.greatest(F.col("r") - F.col("h"), F.lit(0)), "missed_ms"), part(F.greatest(F.col("h") - F.col("r"), F.lit(0)), "false_ms"), part(F.least("r", "h"), "both_ms"))
    time_of = lambda d, name: d.groupBy("file_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(name))
    shared = speaker_overlaps(r, h)
    facts = time_of(r, "a").select("file_id", F.lit("r").alias("side"), F.col("speaker").alias("ref_speaker"), F.lit(None).cast("string").alias("hyp_speaker"), F.col("a").alias("ms"))
    facts = facts.unionByName(time_of(h, "a").select("file_id", F.lit("h").alias("side"), F.lit(None).cast("string").alias("ref_speaker"), F.col("speaker").alias("hyp_speaker"), F.col("a").alias("ms")))
    facts = facts.unionByName(shared.select("file_id", F.lit("p").alias("side"), "ref_speaker", "hyp_speaker", F.col("overlap_ms").alias("ms")))
    kind = dict(ref.dtypes)["file_id"]

    def mapped(pdf):
        import pandas as pd

        time = {s: dict(zip(g[c], g["ms"], strict=True)) for s, c in (("r", "ref_speaker"), ("h", "hyp_speaker")) for g in [pdf[pdf["side"] == s].sort_values(c)]}
        pairs = {(a, b): m for s, a, b, m in zip(pdf["side"], pdf["ref_speaker"], pdf["hyp_speaker"], pdf["ms"], strict=True) if s == "p"}
        rows, columns = list(time["r"]), list(time["h"])
        chosen = {rows[i]: columns[j] for i, j in best_assignment([[pairs.get((a, b), 0) for b in columns] for a in rows]) if pairs.get((rows[i], columns[j]))}
        right = sum(pairs[x] for x in chosen.items())
        errors = [1 - pairs[a, chosen[a]] / (time["r"][a] + time["h"][chosen[a]] - pairs[a, chosen[a]]) if a in chosen else 1.0 for a in rows]
        return pd.DataFrame({"file": [str(pdf["file"].iloc[0])], "right_ms": [int(right)], "jaccard": [sum(errors) / len(errors) if errors else None]})

    found = facts.withColumn("file", F.col("file_id").cast("string")).drop("file_id").groupBy("file").applyInPandas(mapped, "file string, right_ms long, jaccard double")
    out = both.join(found.select(F.col("file").cast(kind).alias("file_id"), "right_ms", "jaccard"), "file_id", "left")
    out = out.withColumn("confused_ms", F.greatest(F.lit(0), F.col("both_ms") - F.coalesce("right_ms", F.lit(0))))
    rate = (F.col("missed_ms") + F.col("false_ms") + F.col("confused_ms")) / F.when(F.col("total_ms") > 0, F.col("total_ms"))
    return out.select("file_id", "total_ms", "missed_ms", "false_ms", "confused_ms", F.round(rate, 6).alias("der"), F.round("jaccard", 6).alias("jer"))


def turn_accuracy(ref: DataFrame, hyp: DataFrame, least: int = 50) -> DataFrame:
    """Per file of ``ref``: share of its matched segments with the right speaker, and of the others.

    Speakers are mapped greedily, one to one, by the overlap of matches (ties by name).  Both are null for a file
    without a match.
    """
    named = lambda d: d.withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))
    best = best_match(ref, named(hyp), least, "r_speaker")
    matches = named(ref).join(best, ["file_id", "seg_idx"]).select("file_id", F.col("speaker").alias("ref_speaker"), F.col("m.r_speaker").alias("hyp_speaker"), F.col("m.overlap").alias("overlap_ms"))
    chosen = greedy_pairs(matches.groupBy("file_id", "hyp_speaker", "ref_speaker").agg(F.sum("overlap_ms").alias("overlap_ms")))
    right = F.coalesce("mapped", "hyp_speaker") == F.col("ref_speaker")
    rates = matches.join(chosen, ["file_id", "hyp_speaker"], "left").groupBy("file_id").agg(F.round(F.avg(right.cast("double")), 6).alias("speaker_turn_accuracy"))
    out = ref.select("file_id").distinct().join(rates, "file_id", "left")
    return out.withColumn("speaker_confusion_rate", F.round(1 - F.col("speaker_turn_accuracy"), 6))
