"""Adaptive quality rules, in DataFrame functions only.

Each document gets counts (words, symbols, repeated lines, words in repeated three-word windows)
and from them ratios in whole per mille.  The cut-off of a ratio is not fixed: it follows from the
quantiles of the ratio among documents of the same language and source, taken from mergeable
sketches.  A sketch is a log-linear histogram: a value keeps its leading ``SKETCH_BITS`` binary
digits, equal results share a counter, and merging adds counters.  That bounds a quantile's
relative error by 2**-(SKETCH_BITS-1) and its size by the number of distinct leading digits, does not depend on the
order of merging (a task that runs twice gives the same cut-offs) and can be written in any SQL.
Sketches of small groups (under ``LEAST_GROUP`` documents) merge into their language's, and small
languages' into the corpus's.

A group's fence stands where its own tail parts from its body: between the first two neighbouring whole
percentiles above the 75 % quantile (below the 25 % quantile for a low fence) whose ratio exceeds ``SPREADS``
times, in logarithms, the spread from the median to that quantile, or one step of the sketch where they
coincide.  A group whose tail does not part has no such fence.  A document fails if a base rule fails or a
ratio lies beyond its fence.  A hot source is no burden: sketches are summed before the shuffle, and the
fences join to per-document numbers, not texts.

Nulls: a null text has no words and fails; null language or source form groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import WORD_BREAK, materialize, text_or_empty

SYMBOLS = "#*$%&|<>"
SKETCH_BITS = 7
LEAST_GROUP = 50
SPREADS = 5
RATIOS = ("word_length", "symbol_share", "dup_line_rate", "repeat_share")
MIDDLE, UPPER, LOWER = 50, 75, 25  # quantiles, in per cent
#: ratios that fail on either side of their fence
TWO_SIDED = ("word_length",)
SCALE = 1000
LEAST_WORDS, MOST_REPEATED = 50, 50


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: bound as a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def repeated_words(found: Column) -> Column:
    """Words in three-word windows that occur twice or more in the array of words."""
    windows = F.when(F.size(found) < 3, F.array().cast("array<string>")).otherwise(
        F.transform(F.slice(found, 1, F.greatest(F.size(found) - 2, F.lit(1))), lambda w, i: F.concat_ws(" ", w, F.get(found, i + 1), F.get(found, i + 2)))
    )

    def covered(all_of: Column) -> Column:
        ordered = F.array_sort(F.transform(all_of, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, k: F.coalesce((x["w"] == F.get(s, k - 1)["w"]) | F.lit(False), F.lit(False)) | F.coalesce(x["w"] == F.get(s, k + 1)["w"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(let(ordered, again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return let(windows, lambda all_of: F.when(F.size(F.array_distinct(all_of)) == F.size(all_of), F.lit(0)).otherwise(covered(all_of)))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``quality`` of the counts."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    counts = F.struct(
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
        let(words(text), lambda x: F.struct(F.size(x).cast("long").alias("n_words"), repeated_words(x).cast("long").alias("n_repeat_words"))).alias("words"),
    )
    return docs.withColumn("quality", counts)


def ratios(prefix: str = "quality") -> dict[str, Column]:
    q = F.col(prefix)
    share = lambda part, whole: F.floor(SCALE * part / F.greatest(whole, F.lit(1))).cast("long")
    return {
        "word_length": (100 * q["word_chars"] / F.greatest(q["words"]["n_words"], F.lit(1))).cast("long"),
        "symbol_share": share(q["n_symbols"], q["word_chars"]),
        "dup_line_rate": share(q["lines"]["n_dup_lines"], q["words"]["n_words"]),  # by words: of few lines one is a large share
        "repeat_share": share(q["words"]["n_repeat_words"], q["words"]["n_words"]),
    }


def base_failed(prefix: str = "quality") -> Column:
    q = F.col(prefix)["words"]
    return (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])


def step(x: Column) -> Column:
    """The width of the value's cell in the sketch."""
    return F.pow(F.lit(2.0), F.greatest(F.length(F.bin(x)) - SKETCH_BITS, F.lit(0))).cast("long")


def leading_digits(x: Column) -> Column:
    """The value with all but its leading SKETCH_BITS binary digits set to zero."""
    return (F.floor(x / step(x)) * step(x)).cast("long")


def parted(histogram: DataFrame) -> DataFrame:
    """g, ratio, total, low, high from a histogram (g, ratio, value, n): where the tails part from the body."""
    whole = W.partitionBy("g", "ratio")
    up_to = whole.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    counted = histogram.withColumn("seen", F.sum("n").over(up_to)).withColumn("total", F.sum("n").over(whole))
    # the percentiles that fall into a cell: those over ``before`` up to ``at``
    counted = counted.withColumn("at", F.floor(100 * F.col("seen") / F.col("total"))).withColumn("before", F.floor(100 * (F.col("seen") - F.col("n")) / F.col("total")))
    quantile = lambda p: F.min(F.when(F.col("at") >= p, F.col("value"))).over(whole)
    cut = counted.withColumn("mid", quantile(MIDDLE)).withColumn("up", quantile(UPPER)).withColumn("down", quantile(LOWER))
    # neighbouring percentiles; where several share a cell it stands once
    held = cut.where((F.col("at") > F.col("before")) | (F.col("seen") == F.col("n")))
    ordered = whole.orderBy("value")
    held = held.withColumn("next", F.lead("value").over(ordered)).withColumn("last", F.lag("value").over(ordered))
    power = lambda r: r * r * r * r * r  # noqa: E731  SPREADS times
    ratio = lambda a, b: (1.0 + a) / (1.0 + b)
    value, mid = F.col("value"), F.col("mid")
    rises = (F.col("at") >= UPPER) & (1.0 + F.col("next") > (1.0 + value) * power(ratio(F.greatest("up", mid + step(mid)), mid)))
    falls = (F.col("before") < LOWER) & (value <= F.col("down")) & (1.0 + value > (1.0 + F.col("last")) * power(ratio(mid, F.least("down", F.greatest(mid - step(mid), F.lit(0))))))
    found = held.groupBy("g", "ratio").agg(F.max("total").alias("total"), F.min_by(F.floor((value + F.col("next")) / 2), F.when(rises, value)).alias("high"), F.max_by(F.floor((value + F.col("last")) / 2), F.when(falls, value)).alias("low"))
    return found.withColumn("low", F.when(F.col("ratio").isin(*TWO_SIDED), F.col("low")))


def fences(measured_docs: DataFrame) -> DataFrame:
    """lang, source, and per ratio ``<ratio>_low`` and ``<ratio>_high`` (null: none); every group of the input."""
    values = F.array(*(F.struct(F.lit(k).alias("ratio"), leading_digits(v).alias("value")) for k, v in ratios().items()))
    sketch = measured_docs.where(~base_failed()).select("lang", "source", F.explode(values).alias("x")).groupBy("lang", "source", "x.ratio", "x.value").agg(F.count("*").alias("n"))
    # merged sketches stand beside their parts, so that small groups have somewhere to turn to
    levels = F.explode(F.array(F.struct(F.lit(0).alias("level"), "lang", "source"), F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source")), F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))))
    merged = sketch.select(levels.alias("g"), "ratio", "value", "n").groupBy("g", "ratio", "value").agg(F.sum("n").alias("n"))
    cut = parted(merged)
    names = [f"{k}_{side}" for k in RATIOS for side in ("low", "high")]
    wide = cut.groupBy("g").agg(F.max("total").alias("total"), *(F.max(F.when(F.col("ratio") == k, F.col(side))).alias(f"{k}_{side}") for k in RATIOS for side in ("low", "high")))
    whole = F.struct("total", *names)
    at = lambda level, name: wide.where(F.col("g.level") == level).select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), whole.alias(name))
    groups = measured_docs.groupBy("lang", "source").agg(F.count("*").alias("n_group"))
    own, lang, all_of = at(0, "own"), at(1, "of_lang").drop("source"), at(2, "of_all").select("of_all")
    joined = groups.alias("x").join(own.alias("o"), F.col("x.lang").eqNullSafe(F.col("o.lang")) & F.col("x.source").eqNullSafe(F.col("o.source")), "left").join(lang.alias("l"), F.col("x.lang").eqNullSafe(F.col("l.lang")), "left").withColumn("one", F.lit(1)).join(F.broadcast(all_of.withColumn("one", F.lit(1))), "one", "left")
    big = lambda name: F.when(F.col(name)["total"] >= LEAST_GROUP, F.col(name))
    chosen = F.coalesce(big("own"), big("of_lang"), F.col("of_all"))
    return joined.select(F.col("x.lang").alias("lang"), F.col("x.source").alias("source"), chosen.alias("fence")).select("lang", "source", *(F.col("fence")[n].alias(n) for n in names))


def beyond_fences() -> dict[str, Column]:
    """Per ratio whether it lies beyond its fence; an unknown fence holds nothing off."""
    fence = F.col("_fence")
    out = {}
    for name, value in ratios().items():
        out[name] = F.coalesce(value > fence[f"{name}_high"], F.lit(False)) | F.coalesce(value < fence[f"{name}_low"], F.lit(False))
    return out


def fenced(measured_docs: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured_docs`` with their group's fences in a struct ``_fence``.

    A row a language and source joins; a hot source's rows are many only on the side of the documents,
    which a broadcast leaves in place and a sort-merge join splits (adaptive execution).
    """
    limits = limits.select(F.struct(*limits.columns).alias("_fence"))
    same = F.col("lang").eqNullSafe(F.col("_fence")["lang"]) & F.col("source").eqNullSafe(F.col("_fence")["source"])
    return measured_docs.join(limits, same, "left")


def judged(measured_docs: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured_docs`` with booleans ``base_failed`` and ``kept``."""
    beyond = F.lit(False)
    for each in beyond_fences().values():
        beyond = beyond | each
    out = fenced(measured_docs, limits).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~beyond).drop("_fence")


def rejects(docs: DataFrame) -> DataFrame:
    """One row: documents, those that pass the base rules, and how many of these lie beyond each ratio's fence."""
    counted = materialize(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    passed = ~base_failed()
    return fenced(counted, fences(counted)).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"), *(F.count_if(passed & b).alias(name) for name, b in beyond_fences().items()))


def assess(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, the base counts, base_failed, kept, the ratios."""
    counted = measured(docs.select("doc_id", "text", "lang", "source")).drop("text")
    numbers = materialize(counted, "quality")
    q = F.col("quality")
    return judged(numbers, fences(numbers)).select(
        "doc_id",
        q["words"]["n_words"].alias("n_words"),
        q["word_chars"].alias("word_chars"),
        q["n_symbols"].alias("n_symbols"),
        q["lines"]["n_dup_lines"].alias("n_dup_lines"),
        q["words"]["n_repeat_words"].alias("n_repeat_words"),
        "base_failed",
        "kept",
        *(v.alias(k) for k, v in ratios().items()),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Each text is measured once: the whole rows are written with their counts, inside a struct so that
    no column of theirs clashes with one of the rules'.  The fences are written too, a row a language
    and source, so their join to the rows has a known size.  No id is used; null or repeated ones
    do not matter.
    """
    rows = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    rows = materialize(measured(rows).drop("text"), "quality")
    limits = materialize(fences(rows), "fences")
    return judged(rows, limits).where("kept").select("row.*")
