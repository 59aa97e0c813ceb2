"""Toxic passages as segments of greatest score over log-odds of tokens.

Tokens are words and their beginnings of 3 to 6 letters.  A token's share of toxic documents has a Dirichlet prior
whose mean is the share of the next shorter beginning (and, in the end, of all documents), so a rare word is judged
by how it begins.  The score of a word is its log-odds against all documents less a drift, so passages without
toxic words fall.  One scan in linear time finds all maximal segments of a text; under the extreme-value law
fitted to clean documents, which takes account of a text's length, a segment is significant or not, and the best
one's p-value becomes the probability of the label by a logistic curve.

Labels are learnt from about ``TRAIN_ROWS`` labelled documents at most, chosen by a hash of the id, and of their tokens
the ``MODEL_TOKENS`` of most evidence are kept: the bounds of the classifier.  The law and the curve are fitted to
scores by the model of the other half of the labelled documents.  Every document is scored, whole.

Rows: a null or empty text has score of no passage; labels that are null, or whose document is absent, teach nothing;
of several labels of one id the greatest counts; a null id has no label.  Without labels of both kinds every
score is 0.  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import id_again, id_text, thrifty

TRAIN_ROWS = 200_000
MODEL_TOKENS = 1 << 17
BEGINNINGS = (3, 4, 5, 6)
#: weight of the prior in documents; standard deviations from the shorter beginning that make a token evidence
PRIOR, EVIDENCE = 1.0, 2.0
DRIFT = 1.0
#: share of the clean documents that the law is fitted to, by score: labels err, and an unmarked toxic text is no chance event
BULK = 0.99
#: expected number of such segments in a clean text of the length, at most, of a significant one
SIGNIFICANT = 0.05
FOLDS = 5
#: every character of ASCII but letters parts words
PARTS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
COUNTS = ["toxic_0", "clean_0", "toxic_1", "clean_1"]
ALL = 2
FLUSH = 400_000


def words_of(text: str | None) -> list[str]:
    return [] if text is None else text.lower().encode("utf-8", "replace").translate(PARTS).decode("utf-8").split()


def tokens_of(word: str) -> list[str]:
    """From the shortest beginning to the whole word, which ends with a space."""
    return [word[:k] for k in BEGINNINGS if len(word) > k] + [word + " "]


def sampled(labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic, half of about ``rows`` labelled ids at most that are to be learnt from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where("doc_id is not null and toxic is not null").where(fold != 0).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    return known.withColumn("half", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(2))).cast("int"))


def token_counts(learnt: DataFrame) -> DataFrame:
    """token, start and in how many documents of each kind it stands, summed per task (``start``: its first letters)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [Counter() for _ in COUNTS]

        def rows() -> pd.DataFrame:
            names = np.array(list(set().union(*counts)), object)  # else pandas may hold many strings in several pieces
            found = pd.DataFrame({"start": np.array([x[: BEGINNINGS[0]].rstrip() for x in names], object), "token": names, **{c: [n[x] for x in names] for c, n in zip(COUNTS, counts, strict=True)}})
            for n in counts:
                n.clear()
            return found

        for pdf in batches:
            for text, toxic, half in zip(pdf["text"], pdf["toxic"], pdf["half"], strict=True):
                words, into = set(words_of(text)), counts[2 * half + (not toxic)]
                into[""] += 1
                into.update([w + " " for w in words])
                for k in BEGINNINGS:
                    into.update({w[:k] for w in words if len(w) > k})
                if sum(map(len, counts)) > FLUSH:
                    yield rows()
        yield rows()

    return learnt.mapInPandas(thrifty(run), "start string, token string, " + ", ".join(f"{c} long" for c in COUNTS))


def log_odds(p: float | np.ndarray) -> float | np.ndarray:
    return np.log(p / (1 - p))


def share(toxic: float, clean: float, prior: float) -> float:
    return (toxic + PRIOR * prior) / (toxic + clean + PRIOR)


def of_model(counts: np.ndarray, model: int) -> tuple[float, float]:
    """Toxic and clean documents of a model: of one half, or of both."""
    a = (counts[0], counts[2]) if model == ALL else (counts[2 * model], 0)
    b = (counts[1], counts[3]) if model == ALL else (counts[2 * model + 1], 0)
    return float(sum(a)), float(sum(b))


def evident(base: np.ndarray) -> Callable:
    """Keeps, of the tokens of one start, those that differ from the next shorter beginning; ``base``: counts of all documents."""

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.groupby("token", as_index=False)[COUNTS].sum()
        rows = rows[(rows[COUNTS].sum(axis=1) > 1) & (rows["token"] != "")]
        counts = dict(zip(rows["token"], rows[COUNTS].to_numpy(), strict=True))
        kept = []
        priors = [share(*of_model(base, m), 0.5) for m in (0, 1, ALL)]
        for token, own in counts.items():
            word, flags, most = token.rstrip(" "), 0, 0.0
            shorter = [counts[word[:k]] for k in BEGINNINGS if len(word[:k]) < len(token) - token.endswith(" ") and word[:k] in counts]
            for m, prior in zip((0, 1, ALL), priors, strict=True):
                for c in shorter:
                    prior = share(*of_model(c, m), prior)
                toxic, clean = of_model(own, m)
                n = toxic + clean
                z = abs(toxic - n * prior) / math.sqrt(n * prior * (1 - prior)) if n > 1 else 0.0
                if z >= EVIDENCE:
                    flags |= 1 << m
                    most = max(most, z)
            if flags:
                kept.append((token, *map(int, own), flags, most))
        return pd.DataFrame(kept, columns=["token", *COUNTS, "flags", "z"])

    return run


class Model:
    """Scores of words by the kept tokens of one of the three models; words' scores are remembered in bounded memory."""

    LIMIT = 1 << 19

    def __init__(self, tokens: list[str], counts: np.ndarray, flags: np.ndarray, base: np.ndarray, model: int):
        at = np.flatnonzero(flags >> model & 1)
        self.counts = {tokens[i]: of_model(counts[i], model) for i in at}
        self.base, self.known = share(*of_model(base, model), 0.5), {}

    def score(self, word: str) -> float:
        p = self.base
        for token in tokens_of(word):
            found = self.counts.get(token)
            if found is not None:
                p = share(*found, p)
        return float(log_odds(p) - log_odds(self.base)) - DRIFT

    def scores(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.LIMIT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.score(w)
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal segments (score, start, end) in order: no part of one, and nothing that holds one, scores more.

    Runs of falling scores are summed beforehand; a list of candidates with the sums before and after each is kept,
    and a new piece joins back over those that it outdoes, each of which goes for good: linear time.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    rises = np.flatnonzero(scores > 0)
    found: list[tuple[float, float, int, int, int]] = []  # sums before and after, bounds, the nearest candidate with a lower start
    for i in rises.tolist():
        low, high, start = float(total[i]), float(total[i + 1]), i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                break
            low, start = found[j][0], found[j][2]
            del found[j:]
        found.append((low, high, start, i + 1, j))
    return [(high - low, start, end) for low, high, start, end, _ in found]


def fitted_law(length: np.ndarray, best: np.ndarray, weight: np.ndarray, least: float = 1.0) -> tuple[float, float]:
    """lambda and K of P(best <= s) = exp(-K length e**(-lambda s)) by likelihood; scores under ``least`` are only known to be so."""
    seen, s = best > least, np.maximum(best, least)
    if not (weight[seen].sum() > 0):
        return 1.0, 1.0 / max(float(length.max(initial=1)), 1.0)
    answers = []
    for rate in np.exp(np.linspace(math.log(0.02), math.log(5), 200)):
        tail = float((weight * length * np.exp(-rate * s)).sum())
        k = float(weight[seen].sum()) / tail
        answers.append((float((weight[seen] * (math.log(k * rate) + np.log(length[seen]) - rate * s[seen])).sum()) - k * tail, float(rate), k))
    return max(answers)[1:]


def surprise(length: np.ndarray, best: np.ndarray, law: tuple[float, float]) -> np.ndarray:
    """Minus the log of the chance that a clean text of the length has a segment of such a score."""
    rate, k = law
    expected = k * np.maximum(length, 1) * np.exp(-rate * best)
    return np.where(best > 0, -np.log(np.maximum(-np.expm1(-expected), 1e-300)), 0.0)


def fitted_curve(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Logistic curve through counts at x, by Newton's steps with a slight pull to zero."""
    w = np.zeros(2)
    rows = np.stack([np.ones_like(x), x], 1)
    n = toxic + clean
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        step = np.linalg.solve((rows * (n * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2), rows.T @ (toxic - n * p) - 1e-3 * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Detector:
    """What was learnt: tokens with counts, the law, the curve.  Bounded by ``MODEL_TOKENS``."""

    def __init__(self, tokens: list[str], counts: np.ndarray, flags: np.ndarray, base: np.ndarray):
        self.tokens, self.counts, self.flags, self.base = tokens, counts, flags, base
        self.law, self.curve = (1.0, 1.0), (0.0, 0.0)

    def model(self, which: int) -> Model:
        return Model(self.tokens, self.counts, self.flags, self.base, which)


def calibrated(detector: Detector, learnt: DataFrame) -> Detector:
    """Fits law and curve to the labelled documents, each scored by the other half's model; tasks send counts of cells."""
    shared = learnt.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [shared.value.model(0), shared.value.model(1)]
        cells: Counter = Counter()
        for pdf in batches:
            for text, toxic, half in zip(pdf["text"], pdf["toxic"], pdf["half"], strict=True):
                words = words_of(text)
                best = max(maximal_segments(models[1 - half].scores(words)), default=(0.0,))[0]
                cells[bool(toxic), round(8 * math.log(max(len(words), 1))), round(min(best, 1000.0) * 8)] += 1
        yield pd.DataFrame([(*k, n) for k, n in cells.items()], columns=["toxic", "length", "best", "n"])

    cells = learnt.mapInPandas(thrifty(run), "toxic boolean, length long, best long, n long").groupBy("toxic", "length", "best").agg(F.sum("n").alias("n"))
    rows = cells.orderBy("toxic", "length", "best").toPandas()  # a cell a length and score, whatever the number of documents
    length, best, n, toxic = np.exp(rows["length"].to_numpy(float) / 8), rows["best"].to_numpy(float) / 8, rows["n"].to_numpy(float), rows["toxic"].to_numpy(bool)
    order = np.argsort(best + 1e9 * toxic, kind="stable")
    bulk = order[np.cumsum(n[order]) <= max(BULK * n[~toxic].sum(), n[order[0]])]
    detector.law = fitted_law(length[bulk], best[bulk], n[bulk])
    detector.curve = fitted_curve(np.log1p(surprise(length, best, detector.law)), n * toxic, n * ~toxic)
    return detector


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, tokens: int = MODEL_TOKENS) -> Detector | None:
    """Learns from the labelled documents outside the held-out fold; None without both kinds of them in each half."""
    learnt = docs.select("doc_id", "text").join(F.broadcast(sampled(labels, rows)), "doc_id").select("text", "toxic", "half")  # at most about ``rows`` ids
    base = learnt.agg(*(F.count_if((F.col("half") == h) & (F.col("toxic") == t)).alias(f"{h}{t}") for h in (0, 1) for t in (True, False))).first()
    base = np.array(list(base), np.int64)
    if not base.all():
        return None
    kept = token_counts(learnt).groupBy("start").applyInPandas(evident(base), "token string, " + ", ".join(f"{c} long" for c in COUNTS) + ", flags int, z double")
    found = kept.orderBy(F.col("z").desc(), "token").limit(tokens).toPandas()
    detector = Detector(list(found["token"]), found[COUNTS].to_numpy(np.int64).reshape(-1, 4), found["flags"].to_numpy(np.int64), base)
    return calibrated(detector, learnt)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def detect(docs: DataFrame, detector: Detector | None) -> DataFrame:
    """doc_id, score, n_words, passages (text between, start and end in words, expected number by chance) of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(id_text(), "text")
    if detector is None:
        none = F.array().cast("array<struct<start:bigint,end:bigint,expected:double>>")
        return id_again(rows.select("doc_id", F.lit(0.0).alias("score"), none.alias("passages")), kind)
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = shared.value
        model, (rate, k) = d.model(ALL), d.law
        for pdf in batches:
            lengths, bests, passages = [], [], []
            for text in pdf["text"]:
                words = words_of(text)
                found = maximal_segments(model.scores(words))
                expected = [k * len(words) * math.exp(-rate * s) for s, _, _ in found]
                passages.append([{"start": a, "end": b, "expected": e} for (_, a, b), e in zip(found, expected, strict=True) if e <= SIGNIFICANT])
                lengths.append(len(words))
                bests.append(max(found, default=(0.0,))[0])
            x = np.log1p(surprise(np.array(lengths, float), np.array(bests, float), d.law))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(d.curve[0] + d.curve[1] * x, -40, 40))), "passages": passages})

    return id_again(rows.mapInPandas(thrifty(run), "doc_id string, score double, passages array<struct<start:bigint,end:bigint,expected:double>>"), kind)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every document; learnt outside the held-out fold."""
    found = detect(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
