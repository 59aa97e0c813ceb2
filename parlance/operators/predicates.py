"""Filters and flags on segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T


def duration(unit: float = 1000.0) -> Column:
    return (F.col("end_ms") - F.col("start_ms")) / F.lit(unit)


def artifact_filter(segments: DataFrame) -> DataFrame:
    """Cleans hallucinated repeats and drops what is blank, bracketed, punctuation or timeless."""
    out = segments.withColumn("text", T.clean_hallucination(T.strip(F.coalesce("text", F.lit(""))))).where("text <> ''")
    out = out.withColumn("text", T.strip(F.regexp_replace("text", r"[【\[].*?[】\]]", ""))).where("text <> ''")
    return out.where(~F.col("text").rlike(r"(?U)^[\s\W_]+$") & (F.col("end_ms") > F.col("start_ms")) & ~((F.length("text") <= 2) & (duration() > 10)))


def low_confidence_reasons() -> Column:
    """Array of reasons from avg_logprob, no_speech_prob, speech_overlap_s, speech_overlap_ratio, text."""
    dur, over, share = F.greatest(F.lit(0.0), duration()), F.col("speech_overlap_s"), F.col("speech_overlap_ratio")
    text = T.strip(F.coalesce("text", F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    low_avg = yes(F.col("avg_logprob") <= -0.65)
    low_overlap = yes((share < 0.22) & (dur >= 4))
    low_abs = yes((dur >= 4) & (over < F.least(F.lit(1.2), 0.2 * dur)))
    repeat = yes(T.suspicious_repeat(text))
    nsp = yes(F.col("no_speech_prob") >= 0.65) & (low_avg | low_overlap | low_abs | repeat)
    dense = yes((F.length(text) / F.when(dur > 0, dur) > 12) & (F.col("no_speech_prob") >= 0.50)) & (low_overlap | low_abs | repeat)
    reasons = (
        (low_avg, F.format_string("low avg_logprob=%.2f", "avg_logprob")),
        (low_overlap, F.format_string("low speech overlap=%d%%", F.rint(share * 100).cast("int"))),
        (low_abs, F.format_string("short speech support=%.1fs/%.1fs", over, dur)),
        (repeat, F.lit("suspicious repeated phrase")),
        (nsp, F.format_string("high no_speech_prob=%.2f", "no_speech_prob")),
        (dense, F.lit("dense text with high no_speech_prob")),
    )
    return F.filter(F.array(*(F.when(c, r) for c, r in reasons)), lambda x: x.isNotNull())


def low_confidence(segments: DataFrame) -> DataFrame:
    """Flags segments; both columns are null where nothing is wrong."""
    found = segments.withColumn("_r", low_confidence_reasons())
    return found.withColumn("low_confidence", F.when(F.size("_r") > 0, True)).withColumn("low_confidence_reasons", F.when(F.size("_r") > 0, F.col("_r"))).drop("_r")


def unreliable(ends: str = r"\s", blank: str = r"\s", unnamed: bool = False) -> Column:
    """Whether a turn is to be dropped; turns of unknown speakers are held to more.

    Classes of the characters that do not count at the ends of a text or phrase, and of those that are white space
    within it; whether a missing speaker is an unknown one.
    """
    text = T.strip(F.coalesce(F.col("text"), F.lit("")), ends)
    n, dur = F.length(text), F.greatest(F.lit(0.0), duration())
    noise = (text == "") | ((dur > 8) & (n <= 4)) | ((dur > 4) & (n <= 8) & text.rlike(rf"(?U)[^{blank}\p{{L}}\p{{N}}]"))
    doubled = text.rlike(rf"(?U)([^{T.DOUBLED}{blank}])\1")
    unknown = F.coalesce(F.upper("speaker").contains("UNKNOWN"), F.lit(unnamed))
    strict = (n <= 2) | ((dur < 1) & (n <= 8)) | ((dur < 2) & (n <= 14)) | ((n < 6) & (dur > 2)) | doubled | T.ngram_repeats(text, 4, 8, ends) | (dur < 0.5) | (n / F.when(dur > 0, dur) > 18) | ((dur > 4) & (n <= 8))
    return noise | (unknown & F.coalesce(strict, F.lit(True)))


def filter_unreliable(turns: DataFrame, ends: str = r"\s", blank: str = r"\s", unnamed: bool = False) -> DataFrame:
    return turns.where(~unreliable(ends, blank, unnamed))


def overlaps_range(lo, hi) -> Column:
    return F.least(F.col("end_ms"), F.lit(hi)) > F.greatest(F.col("start_ms"), F.lit(lo))


def intent_any(wanted: list[str], column: str = "intent") -> Column:
    names = F.array(*(T.intent_name(F.lit(w)) for w in wanted))
    return F.coalesce(F.arrays_overlap(F.transform(F.col(column), T.intent_name), names), F.lit(False))


def is_speaker(name: str, column: str = "speaker") -> Column:
    """Exactly this speaker; a missing one is nobody."""
    return F.coalesce(F.col(column) == name, F.lit(False))


def relevant_to(case: dict) -> Column:
    """Whether a segment answers a retrieval case (dataset, file, speaker, time_range in ms, intent, any_term_groups).

    Each constraint that the case has must hold; intents are compared as they stand.
    """
    keep = F.lit(True)
    for name in ("dataset", "file", "speaker"):
        if case.get(name):
            keep = keep & F.coalesce(F.col(name) == case[name], F.lit(False))
    if case.get("time_range"):
        keep = keep & overlaps_range(*case["time_range"])
    if case.get("intent"):
        keep = keep & F.coalesce(F.arrays_overlap("intent", F.array(*map(F.lit, case["intent"]))), F.lit(False))
    groups = F.array(*(F.array(*map(F.lit, g)) for g in case["any_term_groups"]))
    return keep & relevant(groups, F.coalesce("text", F.lit("")))


def relevant(groups: Column, text: Column) -> Column:
    """Any group of terms of which all occur, whatever their case."""
    return F.exists(groups, lambda g: F.forall(g, lambda t: F.contains(F.lower(text), F.lower(t))))


def informative(query: str, text: Column) -> Column:
    if len(query.strip()) < 8:
        return F.lit(True)
    return (F.regexp_count(text, F.lit("[一-鿿]")) >= 8) | (F.regexp_count(text, F.lit("[A-Za-z]+")) >= 4)


def indexable(text: Column, least: int = 4) -> Column:
    return F.length(T.strip(F.coalesce(text, F.lit("")))) >= least


def call_out(text: Column) -> Column:
    """Mostly a number: three digits and little else, or four Chinese numerals in a short text."""
    raw = T.strip(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(raw, r"(?U)\s+", "")
    rest = F.length(F.regexp_replace(bare, r"[0-9A-Za-z,，.。:：;；、/\-_\[\]()（）号第零一二三四五六七八九十百千万]+", ""))
    numbers = (F.regexp_count(raw, F.lit(r"(?U)\d")) >= 3) & (rest <= F.greatest(F.lit(1.0), 0.2 * F.length(bare)))
    return numbers | ((F.regexp_count(raw, F.lit("[零一二三四五六七八九十百千万]")) >= 4) & (F.length(raw) <= 30))


def accept_correction(original: Column, corrected: Column, chinese: bool = True) -> Column:
    """A correction may not lose numbers; a call-out may only change script and punctuation."""
    original, corrected = (T.strip(F.coalesce(x, F.lit(""))) for x in (original, corrected))
    if not chinese:
        return corrected != ""
    core = lambda x: F.regexp_replace(T.zh_simplify(x), r"(?U)[\s,，.。;；:：、]+", "")
    kept = F.size(F.array_except(T.numeric_tokens(original), T.numeric_tokens(corrected))) == 0
    return (corrected != "") & F.when(call_out(original), core(original) == core(corrected)).otherwise(kept)
