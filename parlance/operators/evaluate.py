"""Evaluation: edit counts, text, confidence and ranking metrics, reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from parlance.functions import text as T


#: texts at least so long are first tried by diagonals, up to this share of edits
LONG, SHARE = 512, 8
#: levels between two that are kept for the way back; tokens compared one by one before lengths are found by hashes
KEPT, STEPS = 128, 6


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """(distance, substitutions, insertions, deletions); on equal cost diagonal, insertion, deletion.

    Long texts with few edits take time by their length and the square of the edits, others by both lengths.
    """
    names = {t: i for i, t in enumerate({*ref, *hyp})}
    a, b = (np.array([names[t] for t in x], np.int64) for x in (ref, hyp))
    longest = max(len(a), len(b))
    return (longest >= LONG and counts_by_diagonals(a, b, longest // SHARE)) or counts_by_rows(a, b)


def edit_distance(ref: Sequence, hyp: Sequence) -> int:
    """The distance alone, of texts by characters or of lists of tokens: a column a step, its cells as the bits of two whole numbers."""
    low, high = 0, min(len(ref), len(hyp))
    while low < high and ref[low] == hyp[low]:
        low += 1
    end = 0
    while end < high - low and ref[-1 - end] == hyp[-1 - end]:
        end += 1
    a, b = ref[low : len(ref) - end], hyp[low : len(hyp) - end]
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    at = {}
    for x, rows in places.items():
        bits = bytearray(n // 8 + 1)
        for i in rows:
            bits[i >> 3] |= 1 << (i & 7)
        at[x] = int.from_bytes(bits, "little")
    mask = (1 << n) - 1
    # cells one more, and one less, than the cell above
    more, less = mask, 0
    for same in map(at.get, b, repeat(0)):
        flat = ((((same & more) + more) ^ more) | same | less) & mask
        right = ((less | (mask ^ (flat | more))) << 1 | 1) & mask
        more = ((more & flat) << 1 & mask) | (mask ^ (flat | right))
        less = right & flat
    return len(b) + more.bit_count() - less.bit_count()


def counts_by_rows(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Row by row: the distance and the insertions on the way; deletions and substitutions follow from both and the place."""
    n, m = len(a), len(b)
    place = np.arange(m + 1)
    cost, inserted = place.copy(), place.copy()
    for i in range(1, n + 1):
        diagonal = np.concatenate([[n + m + 1], cost[:-1] + (b != a[i - 1])])
        cheapest = np.minimum(diagonal, cost + 1)
        row = np.minimum.accumulate(cheapest - place) + place
        kept = np.where(diagonal == row, np.concatenate([[0], inserted[:-1]]), inserted)
        by_insertion = (diagonal != row) & (np.concatenate([[n + m + 1], row[:-1] + 1]) == row)
        # an insertion follows the last cell of its row that is none
        source = np.maximum.accumulate(np.where(by_insertion, 0, place))
        cost, inserted = row, kept[source] + place - source
    distance, ins = int(cost[m]), int(inserted[m])
    deleted = ins - (m - n)
    return distance, distance - ins - deleted, ins, deleted


class CommonRuns:
    """How many tokens two texts have in common from given places on, for many pairs of places at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.sums = [self.hashes(x) for x in (a, b)]
        # powers of an odd number by doubling
        power = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            top = self.BASE
            while len(power) <= max(len(a), len(b)):
                power, top = np.concatenate([power, power * top]), top * top
        self.power = power

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """Hash of every beginning, so that of any run is a difference (modulo 2**64)."""
        out = np.zeros(len(x) + 1, np.uint64)
        value = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        h, mask, base = 0, (1 << 64) - 1, int(self.BASE)
        rows = value.tolist()
        for i, v in enumerate(rows):
            h = (h * base + v) & mask
            rows[i] = h
        out[1:] = rows
        return out

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            one = self.sums[0][i + n] - self.sums[0][i] * self.power[n]
            return one == self.sums[1][j + n] - self.sums[1][j] * self.power[n]

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        room, out = np.minimum(len(self.a) - i, len(self.b) - j), np.zeros(len(i), np.int64)
        live = np.flatnonzero(room > 0)
        for _ in range(STEPS):
            live = live[self.a[i[live] + out[live]] == self.b[j[live] + out[live]]]
            if not len(live):
                return out
            out[live] += 1
            live = live[out[live] < room[live]]
        low, high = out[live], room[live]
        while len(live) and (low < high).any():
            mid = (low + high + 1) // 2
            equal = self.same(i[live], j[live], mid)
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        out[live] = low
        return out


def counts_by_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int, int, int] | None:
    """The same counts level by level: how far on each diagonal so many edits reach; None if ``most`` do not suffice.

    Every ``KEPT``-th level is kept; the way back makes those between anew.
    """
    n, m = len(a), len(b)
    if abs(m - n) > most:
        return None
    runs, none = CommonRuns(a, b), -(n + m + 2)

    def next_level(reach: np.ndarray, e: int) -> np.ndarray:
        """Of the diagonals -e to e (hypothesis place less reference place), from those of e - 1."""
        wide = np.full(2 * e + 3, none, np.int64)
        wide[2:-2] = reach
        k = np.arange(-e, e + 1)
        out = np.maximum(np.maximum(wide[1:-1] + 1, wide[:-2]), wide[2:] + 1)  # substitution, insertion, deletion
        out = np.minimum(out, np.minimum(n, m - k))
        live = np.flatnonzero((out >= np.maximum(0, -k)) & (k >= -n) & (k <= m))
        out[live] += runs.of(out[live], out[live] + k[live])
        dead = np.ones(len(k), bool)
        dead[live] = False
        out[dead] = none
        return out

    level, e, kept = runs.of(np.zeros(1, np.int64), np.zeros(1, np.int64)), 0, {}
    while not (abs(m - n) <= e and level[m - n + e] == n):
        if e % KEPT == 0:
            kept[e] = level
        if e == most:
            return None
        e += 1
        level = next_level(level, e)
    distance, i, j, counts, block = e, n, m, [0, 0, 0], {}
    one, other = a.tolist(), b.tolist()
    while e:
        while i and j and one[i - 1] == other[j - 1]:
            i, j = i - 1, j - 1
        e -= 1
        if e not in block:
            first = e - e % KEPT
            block = {first: kept[first]}
            for x in range(first + 1, e + 1):
                block[x] = next_level(block[x - 1], x)
        before, k = block[e], j - i
        reach = lambda d: before[d + e] if -e <= d <= e else none  # noqa: B023, E731
        if i and j and i - 1 <= reach(k):
            i, j, op = i - 1, j - 1, 0
        elif j and i <= reach(k - 1):
            j, op = j - 1, 1
        else:
            i, op = i - 1, 2
        counts[op] += 1
    return distance, *counts


def error_rates(pairs: DataFrame, language: str = "en") -> DataFrame:
    """``file_id, ref, hyp`` to n_ref, n_hyp, distance, substitutions, insertions, deletions, rate."""
    clean = T.eval_clean_en if language == "en" else T.eval_clean_zh
    cut = pairs.select(F.col("file_id").cast("string").alias("file_id"), *(clean(F.coalesce(c, F.lit(""))).alias(c) for c in ("ref", "hyp")))
    schema = "file_id string, n_ref long, n_hyp long, distance long, substitutions long, insertions long, deletions long, rate double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts are cut one pair at a time, so a batch holds no tokens
        for batch in batches:
            rows = []
            for ref, hyp in zip(batch.column("ref"), batch.column("hyp"), strict=True):
                r, h = (([t for t in x.as_py().split(" ") if t] if language == "en" else list(x.as_py())) for x in (ref, hyp))
                rows.append((len(r), len(h), *edit_counts(r, h)))
            counts = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6
            rate = pa.array([r[2] / max(r[0], 1) for r in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("file_id").cast(pa.string()), *counts, rate], ["file_id", "n_ref", "n_hyp", "distance", "substitutions", "insertions", "deletions", "rate"])

    out = cut.mapInArrow(run, schema)
    return out.withColumn("file_id", F.col("file_id").cast(dict(pairs.dtypes)["file_id"]))


def chosen_text(columns: list[str], mode: str = "final") -> Column:
    """A segment's text: the final one, or for ``pre_llm`` that before correction, as far as it is kept."""
    names = [c for c in (("text_before_llm", "text_original_asr", "text") if mode == "pre_llm" else ("text",)) if c in columns]
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names), F.lit(""))


def cleaned_text(segments: DataFrame, language: str, mode: str = "final") -> DataFrame:
    """file_id, text: the cleaned texts of a file in order, with nothing between them."""
    clean = T.eval_clean_en if language == "en" else T.eval_clean_zh
    return joined_text(segments.withColumn("_clean", clean(chosen_text(segments.columns, mode))), "_clean")


def text_metrics(ref: DataFrame, hyp: DataFrame, language: str = "en", mode: str = "final") -> DataFrame:
    """Error counts and rate (words for en, characters for zh) of each file's whole text; a file on one side alone counts."""
    one = cleaned_text(ref, language).select("file_id", F.col("text").alias("ref"))
    other = cleaned_text(hyp, language, mode).select("file_id", F.col("text").alias("hyp"))
    return error_rates(one.join(other, "file_id", "full"), language)


def llm_delta(final: DataFrame, before: DataFrame) -> DataFrame:
    """What correction changed in the metrics of each file: final minus before."""
    names = ("rate", "insertions", "deletions", "substitutions")
    old = before.select("file_id", *(F.col(c).alias(f"_{c}") for c in names))
    return final.join(old, "file_id").select("file_id", *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in names))


def spoken_rates(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Per file: wer and cer of its texts joined by spaces, as they stand, and their characters.

    Both empty: 0; one of them empty: 1.  The hypothesis' ``llm_text`` counts where there is one.
    """
    spoken = T.strip(F.coalesce("text", F.lit("")))
    corrected = F.coalesce(F.nullif(T.strip("llm_text"), F.lit("")), spoken) if "llm_text" in hyp.columns else spoken

    def whole(d: DataFrame, text: Column, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("start_ms", "seg_idx", text.alias("t"))))
        parts = F.filter(F.transform(rows, lambda x: x["t"]), lambda t: t != "")
        return d.groupBy("file_id").agg(F.array_join(parts, " ").alias(name))

    both = whole(ref, spoken, "ref").join(whole(hyp, corrected, "hyp"), "file_id", "full").na.fill("", ["ref", "hyp"])

    @F.pandas_udf("double")
    def word_rate(one: pd.Series, other: pd.Series) -> pd.Series:
        rates = []
        for a, b in zip(one, other, strict=True):
            x, y = a.split(), b.split()
            rates.append(float(bool(y)) if not x else edit_distance(x, y) / len(x))
        return pd.Series(rates, dtype="float64")

    neither, only = (F.col("ref") == "") & (F.col("hyp") == ""), (F.col("ref") == "") | (F.col("hyp") == "")
    rate = lambda value: F.round(F.when(neither, 0.0).when(only, 1.0).otherwise(value), 4)
    characters = characters_apart("ref", "hyp") / F.greatest(F.length("ref"), F.lit(1))
    return both.select("file_id", rate(word_rate("ref", "hyp")).alias("wer"), rate(characters).alias("cer"), F.length("ref").alias("ref_chars"), F.length("hyp").alias("hyp_chars"))


@F.pandas_udf(LongType())
def characters_apart(one: pd.Series, other: pd.Series) -> pd.Series:
    """Edit distance by characters; the built-in function takes each cell of two texts by itself."""
    return pd.Series([None if a is None or b is None else edit_distance(a, b) for a, b in zip(one, other, strict=True)], dtype="Int64")


def character_distance(pairs: DataFrame) -> DataFrame:
    """Edit distance by characters, and its share of the reference."""
    counted = pairs.withColumn("distance", characters_apart("ref", "hyp"))
    return counted.withColumn("rate", F.round(F.col("distance") / F.greatest(F.length("ref"), F.lit(1)), 6))


def joined_text(segments: DataFrame, column: str = "text") -> DataFrame:
    """All text of a file in order, with nothing between segments."""
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "seg_idx", F.coalesce(column, F.lit("")).alias("t"))))
    return segments.groupBy("file_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "").alias("text"))


def confidence_report(flagged: DataFrame) -> DataFrame:
    low = F.count_if(F.coalesce("low_confidence", F.lit(False)))
    return flagged.groupBy("file_id").agg(F.count("*").alias("n"), low.alias("n_low"), F.round(low / F.count("*"), 4).alias("low_rate"))


def macro_report(rates: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Mean and population deviation of per-file rates (nulls and NaN left out), sums of counts."""
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    return rates.groupBy(*keys).agg(*(F.round(F.avg(value("rate")), 4).alias("mean_rate"), F.round(F.coalesce(F.stddev_pop(value("rate")), F.lit(0.0)), 4).alias("std_rate")), *(F.sum(c).alias(c) for c in counts))


def ranking_report(outcomes: DataFrame, slices: list[str]) -> DataFrame:
    """n, hit@1, hit@5, mrr (and mean latency, if there is a column latency_ms) overall and by each slice, in one
    pass over grouping sets."""
    rank = F.col("rank")
    share = lambda condition: F.round(F.avg(F.coalesce(condition.cast("double"), F.lit(0.0))), 4)
    measures = [F.count("*").alias("n"), share(rank == 1).alias("hit_at_1"), share(rank <= 5).alias("hit_at_5"), F.round(F.avg(F.coalesce(F.when(rank <= 5, 1.0 / rank), F.lit(0.0))), 4).alias("mrr")]
    if "latency_ms" in outcomes.columns:
        measures.append(F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"))
    return outcomes.groupingSets([[], *([s] for s in slices)], *slices).agg(*measures)


def evaluation(ref: DataFrame, hyp: DataFrame, language: str = "en", compare_llm: bool = False, text_only: bool = False, duration_ms: int | None = None) -> DataFrame:
    """One row a file with all measures: text, time, confidence and speakers; those that need times are null for plain transcripts.

    One job over all files: every measure is an aggregate keyed by file.
    """
    from parlance.operators import intervals as I

    out = text_metrics(ref, hyp, language)
    if compare_llm:
        out = out.join(llm_delta(out, text_metrics(ref, hyp, language, "pre_llm")), "file_id", "left")
    flagged = hyp if "low_confidence" in hyp.columns else hyp.withColumn("low_confidence", F.lit(None).cast("boolean"))
    out = out.join(confidence_report(flagged), "file_id", "left")
    timed = I.time_metrics(ref, hyp).drop("n_ref")
    speakers = I.diarization_report(ref, hyp, duration_ms=duration_ms).select("file_id", "der", "jer").join(I.turn_accuracy(ref, hyp), "file_id", "full")
    for part in (timed, speakers):
        if text_only:
            part = part.select("file_id", *(F.lit(None).cast(t).alias(c) for c, t in part.dtypes if c != "file_id"))
        out = out.join(part, "file_id", "left")
    return out.withColumn("reference_type", F.lit("plain_transcript" if text_only else "timed_segments"))


RATES = ("rate", "start_mae_ms", "end_mae_ms", "hit_half", "hit_one", "coverage", "prefix_excess_ms", "suffix_excess_ms", "low_rate", "der", "jer", "speaker_turn_accuracy", "speaker_confusion_rate")
COUNTS = ("insertions", "deletions", "substitutions")
DELTAS = ("rate_delta", "insertions_delta", "deletions_delta", "substitutions_delta")


def overall(files: DataFrame) -> DataFrame:
    """One row: number of files, means of rates (null and NaN left out), sums of counts; of deltas likewise."""
    mean = lambda c: F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)))
    there = set(files.columns)
    means = [mean(c).alias(c) for c in (*RATES, DELTAS[0]) if c in there]
    return files.agg(F.count("*").alias("files"), *means, *(F.sum(c).alias(c) for c in (*COUNTS, *DELTAS[1:]) if c in there))


def report_json(frames: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as JSON below ``path``; the tables are results of aggregates, or a row a case."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")


def markdown_table(frame: DataFrame, limit: int = 1000) -> str:
    """A small table (at most ``limit`` rows: a report is read by people) in Markdown."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [[cell(v) for v in row] for row in frame.limit(limit).collect()]
    return "\n".join(f"| {' | '.join(r)} |" for r in [frame.columns, ["---"] * len(frame.columns), *rows]) + "\n"


def report_markdown(title: str, sections: dict[str, DataFrame]) -> str:
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(frame)}" for name, frame in sections.items())
