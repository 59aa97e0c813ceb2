"""Equi joins, upserts, aggregates and edits on transcript relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text as T

KEY = ["file_id", "seg_idx"]


def talk_time(segments: DataFrame) -> DataFrame:
    return segments.groupBy("file_id", "speaker").agg(F.count("*").alias("n_segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"))


def corpus_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("file_id").agg(F.countDistinct("speaker").alias("num_speakers"), F.count("*").alias("n_segments"), F.max("end_ms").alias("total_ms"))


def first_utterances(segments: DataFrame, n: int = 10) -> DataFrame:
    """A speaker's first n texts in order."""
    first = segments.withColumn("k", F.row_number().over(W.partitionBy("file_id", "speaker").orderBy("start_ms", "seg_idx"))).where(F.col("k") <= n)
    return first.groupBy("file_id", "speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("texts"))


def speaker_labels(segments: DataFrame) -> DataFrame:
    """A to Z, then S1 on, by first appearance; unknown speakers keep that name and take no letter, nameless ones have none."""
    named = segments.where("speaker <> ''").groupBy("file_id", "speaker").agg(F.min_by("start_ms", "seg_idx").alias("start"), F.min("seg_idx").alias("first"))
    unknown = F.upper("speaker").contains("UNKNOWN")
    k = F.row_number().over(W.partitionBy("file_id", unknown).orderBy("start", "first"))
    letter = F.when(F.col("k") <= 26, F.char(F.col("k") + 64)).otherwise(F.concat(F.lit("S"), F.col("k") - 26))
    return named.withColumn("k", k).select("file_id", "speaker", F.when(unknown, "UNKNOWN").otherwise(letter).alias("label"))


def speaker_choices(segments: DataFrame) -> DataFrame:
    """Distinct speakers of each file with their place in order of appearance."""
    first = segments.groupBy("file_id", "speaker").agg(F.min("seg_idx").alias("first_idx"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("file_id").orderBy("first_idx")))


def apply_corrections(segments: DataFrame, corrections: DataFrame) -> DataFrame:
    """Left join by index; the old text is kept beside a new one."""
    c = corrections.select(*KEY, F.col("text").alias("_new"), F.col("note").alias("correction_note"))
    out = segments.join(c, KEY, "left")
    return out.withColumn("text_before_llm", F.col("text")).withColumn("text", F.coalesce(F.when(T.strip("_new") != "", F.col("_new")), F.col("text"))).drop("_new")


def merge_speakers(segments: DataFrame, merges: DataFrame) -> DataFrame:
    """One pass, not transitive; the last mapping of a speaker wins."""
    last = merges.groupBy("file_id", F.col("from_speaker").alias("speaker")).agg(F.max_by("to_speaker", "merge_idx").alias("_to"))
    return segments.join(last, ["file_id", "speaker"], "left").withColumn("speaker_original", F.col("speaker")).withColumn("speaker", F.coalesce("_to", "speaker")).drop("_to")


def lookup_results(results: DataFrame, current: DataFrame) -> DataFrame:
    """Results with the current segment of the same text, speaker and start (to 0.1 s); last one wins."""
    tenth = lambda d: d.withColumn("_t", F.round(F.col("start_ms") / 100.0, 0).cast("long"))
    right = tenth(current).groupBy("text", "speaker", "_t").agg(F.max(F.struct("file_id", "seg_idx")).alias("m")).select("text", "speaker", "_t", F.col("m.file_id").alias("found_file"), F.col("m.seg_idx").alias("found_idx"))
    return tenth(results).join(right, ["text", "speaker", "_t"], "left").drop("_t")


def index_is_fresh(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """One row: as many segments, equal text and speaker in place, starts within 50 ms."""
    a = indexed.select(*KEY, F.col("text").alias("a_text"), F.col("speaker").alias("a_speaker"), F.col("start_ms").alias("a_start"))
    both = a.join(current.select(*KEY, "text", "speaker", "start_ms"), KEY, "full")
    same = F.col("a_text").eqNullSafe(F.col("text")) & F.col("a_speaker").eqNullSafe(F.col("speaker")) & F.coalesce(F.abs(F.col("a_start") - F.col("start_ms")) <= 50, F.lit(False))
    return both.agg(F.count_if(~same).alias("n_mismatch"), (F.count_if(~same) == 0).alias("is_fresh"))


def pending(files: DataFrame, done: DataFrame, key: str = "file_id") -> DataFrame:
    return files.join(done.select(key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str | list[str], replace: bool = True) -> DataFrame:
    """One row a key: the incoming one, or with ``replace`` off the existing one.

    Of several rows of one side and key the one whose values come last (as text) wins, so the outcome
    does not hang on the order of rows.
    """
    keys = [key] if isinstance(key, str) else key
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    side = F.col("_new").desc() if replace else F.col("_new").asc()
    values = F.to_json(F.struct(*(c for c in both.columns if c != "_new" and c not in keys)))
    return both.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(side, values.desc()))).where("_k = 1").drop("_k", "_new")


def path_key(path: Column) -> Column:
    """A file's key whatever the case, the slashes and the dots in its path."""
    low = F.regexp_replace(F.lower(T.strip(path)), r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(low, r"/\.(?=/|$)", ""), r"/[^/]+/\.\.(?=/|$)", "")


def union_results(*results: DataFrame) -> DataFrame:
    """Results of several folders, the earlier ones first: a file counts once, by :func:`path_key`."""
    both = None
    for place, part in enumerate(results):
        part = part.withColumn("_place", F.lit(place))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    values = F.to_json(F.struct(*(c for c in both.columns if c != "_place")))
    order = W.partitionBy(path_key(F.col("file"))).orderBy("_place", values)
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_place")


def rename_speaker(segments: DataFrame, source: str, target: str, file_id=None) -> DataFrame:
    mine = F.trim("speaker") == source
    if file_id is not None:
        mine = mine & (F.col("file_id") == file_id)
    return segments.withColumn("speaker_original_manual", F.when(mine, F.col("speaker"))).withColumn("manual_speaker_edited", F.when(mine, True)).withColumn("speaker", F.when(mine, F.lit(target)).otherwise(F.col("speaker")))


#: [file:segment] name from-to, then speaker and text; without a file the first is meant
EDIT = r"^\s*\[(?:(\d+):)?(\d+)\]\s+.+?\s+\d{2,}:\d{2}\.\d-\d{2,}:\d{2}\.\d\s(.*)$"
SPOKEN = r"^\s*([^:]*?)\s*:\s*(.*)$"


def one_line(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", " ")


def numbered_files(segments: DataFrame) -> DataFrame:
    """file_id and its number in a table of results, from 0 in order of id."""
    from parlance.operators.retrieval import positions

    return positions(segments.where("file_id is not null").select(F.col("file_id").alias("doc_id")).distinct()).select(F.col("doc_id").alias("file_id"), (F.col("rank") - 1).cast("long").alias("_file"))


def heads(segments: DataFrame) -> DataFrame:
    """``segments`` with the number of their file, the line before the speaker, and the speaker as shown."""
    span = F.concat(T.fmt_time(F.col("start_ms") / 1000.0), F.lit("-"), T.fmt_time(F.col("end_ms") / 1000.0))
    head = F.concat(F.lit("["), "_file", F.lit(":"), "seg_idx", F.lit("] "), one_line(F.col("file_id").cast("string")), F.lit(" "), span, F.lit(" "))
    return segments.join(numbered_files(segments), "file_id", "left").withColumn("_head", head).withColumn("_shown", one_line(F.coalesce("speaker", F.lit("?"))))


def edit_lines(segments: DataFrame) -> DataFrame:
    """One line of text a segment, for editing by hand: ``[file:segment] name mm:ss.s-mm:ss.s speaker: text``."""
    return heads(segments).where("_file is not null").select(*KEY, F.concat("_head", "_shown", F.lit(": "), one_line(F.col("text"))).alias("line"))


def apply_edits(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """Edited lines laid over the segments: changed fields keep the original and set a flag.

    A line that still begins with its segment's own speaker changes the text alone, whatever signs are in the name; else
    the speaker ends at the first colon.  Lines of another form, or of no segment, and lines with an empty text change
    nothing.  Of several lines for a segment the greatest counts.
    """
    part = lambda k: F.regexp_extract("line", EDIT, k)
    edits = lines.where(F.col("line").rlike(EDIT)).select(F.coalesce(F.nullif(part(1), F.lit("")), F.lit("0")).cast("long").alias("_file"), part(2).cast("int").alias("seg_idx"), F.col("line").alias("_line"), part(3).alias("_rest"))
    edits = edits.groupBy("_file", "seg_idx").agg(F.max(F.struct("_line", "_rest")).alias("_e"))
    out = heads(segments).join(edits, ["_file", "seg_idx"], "left")
    # a name may look like a time: the rest follows the segment's own head where that stands
    rest = F.when(F.col("_e._line").startswith(F.col("_head")), F.expr("substring(_e._line, length(_head) + 1)")).otherwise(F.col("_e._rest"))
    out = out.withColumn("_rest", rest)
    own = F.col("_rest").startswith(F.concat("_shown", F.lit(":")))
    said = F.when(own, F.expr("substring(_rest, length(_shown) + 2)")).otherwise(F.regexp_extract("_rest", SPOKEN, 2))
    named = F.when(own, F.col("_shown")).otherwise(F.regexp_extract("_rest", SPOKEN, 1))
    out = out.withColumn("_text", T.strip(said)).withColumn("_name", named)
    valid = F.coalesce(F.col("_text") != "", F.lit(False))
    told = valid & (F.col("_text") != T.strip(one_line(F.col("text"))))
    renamed = valid & (F.col("_name") != "") & (F.col("_name") != F.col("_shown"))
    out = out.withColumn("_told", told).withColumn("_renamed", renamed)
    out = out.withColumn("manual_edited", F.when(F.col("_told"), True)).withColumn("text_original_asr", F.when(F.col("_told"), F.col("text")))
    out = out.withColumn("manual_speaker_edited", F.when(F.col("_renamed"), True)).withColumn("speaker_original_manual", F.when(F.col("_renamed"), F.col("speaker")))
    out = out.withColumn("text", F.when(F.col("_told"), F.col("_text")).otherwise(F.col("text"))).withColumn("speaker", F.when(F.col("_renamed"), F.col("_name")).otherwise(F.col("speaker")))
    new = ["manual_edited", "text_original_asr", "manual_speaker_edited", "speaker_original_manual"]
    return out.select(*(c for c in segments.columns if c not in new), *new)


def edit_changes(edited: DataFrame) -> DataFrame:
    """One row, n_changes: texts and speakers that :func:`apply_edits` changed."""
    return edited.agg((F.count("manual_edited") + F.count("manual_speaker_edited")).alias("n_changes"))


def timing_rollup(chunks: DataFrame) -> DataFrame:
    """Seconds of each stage over all chunks; ``timing`` is a map."""
    return chunks.select("file_id", F.explode("timing").alias("stage", "s")).groupBy("file_id", "stage").agg(F.round(F.sum("s"), 3).alias("seconds"))


def fallback_decision(turns: DataFrame, source: DataFrame) -> DataFrame:
    """Per file whether word-level turns are so bad that segments are used instead, and why.

    ``checked`` are the turns with text and a length; those with text and no length count as severe.
    """
    text = T.strip(F.coalesce("text", F.lit("")))
    said = turns.withColumn("n", F.length(text)).withColumn("d", F.greatest(F.lit(0.0), (F.col("end_ms") - F.col("start_ms")) / 1000.0)).where("n > 0")
    severe = F.expr("d <= 0 or (n >= 12 and n / d > 18) or (n <= 1 and d > 3) or (n <= 2 and d > 4)")
    timed = F.col("d") > 0
    a = said.groupBy("file_id").agg(F.count_if(timed).alias("checked"), F.count_if(severe).alias("severe"), F.sum(F.when(timed, F.col("n"))).alias("chars"), F.sum("d").alias("dur"))
    b = source.groupBy("file_id").agg(F.sum(F.length(text)).alias("source_chars"))
    both = b.join(a, "file_id", "left").withColumn("checked", F.coalesce("checked", F.lit(0)))
    coverage = F.col("chars") / F.greatest("source_chars", F.lit(1))
    reason = F.when(F.col("checked") == 0, "no valid word-level turns")
    reason = reason.when((F.col("source_chars") >= 20) & (coverage < 0.45), F.format_string("low aligned text coverage %d%%", F.rint(coverage * 100).cast("int")))
    reason = reason.when((F.col("severe") >= 5) & (F.col("severe") / F.col("checked") >= 0.30), F.format_string("many implausible word turns %d/%d", "severe", "checked"))
    reason = reason.when((F.col("chars") >= 80) & (F.col("chars") / F.when(F.col("dur") > 0, F.col("dur")) > 22), "global word timing is too compressed")
    fine = "word-level alignment accepted"
    return both.withColumn("reason", F.coalesce(reason, F.lit(fine))).select("file_id", "checked", (F.col("reason") != fine).alias("fallback"), "reason")
