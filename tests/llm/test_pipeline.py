"""The pipeline, decontamination and line dedup against brute force; empty tables and odd columns."""

import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import byte_bpe, decontaminate, line_dedup, lm_scoring, near_dedup, pii, quality_rules, queries, substring_dedup, token_counts, warc
from tests.llm.fixtures import SCHEMA, documents, edited, prose
from tests.llm.test_contracts import WORD, components


def kept_by_rules(rows):
    """Indexes of the rows that the adaptive rules keep."""
    facts = []
    for _, text, lang, source, _ in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        times = Counter(zip(w, w[1:], w[2:], strict=False))
        again = len({p for i in range(len(w) - 2) if times[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)})
        chars, symbols = sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text)
        ratios = (100 * chars // max(len(w), 1), 1000 * symbols // max(chars, 1), 1000 * (len(lines) - len(set(lines))) // max(len(w), 1), 1000 * again // max(len(w), 1))
        facts.append((lang, source, ratios, len(w) < 50 or 100 * again > 50 * len(w)))
    groups = defaultdict(list)
    for lang, source, ratios, failed in facts:
        if not failed:
            for key in ((0, lang, source), (1, lang), (2,)):
                groups[key].append(ratios)

    def rounded(x):
        low = 1 << max(0, x.bit_length() - quality_rules.SKETCH_BITS)
        return x - x % low

    def quantile(values, percent):
        return next(x for i, x in enumerate(values, 1) if 100 * i >= percent * len(values))

    def fences(values):
        values = sorted(map(rounded, values))
        mid, up, down = (quantile(values, p) for p in (50, 75, 25))
        step = 1 << max(0, mid.bit_length() - quality_rules.SKETCH_BITS)
        marks = sorted({quantile(values, p) for p in range(101)})
        far = lambda high, low: ((1.0 + high) / (1.0 + low)) ** quality_rules.SPREADS
        rises = [(a + b) // 2 for a, b in pairwise(marks) if a >= up and 1 + b > (1 + a) * far(max(up, mid + step), mid)]
        falls = [(a + b) // 2 for a, b in pairwise(marks) if b <= down and 1 + b > (1 + a) * far(mid, min(down, max(mid - step, 0)))]
        return min(rises, default=None), max(falls, default=None)

    limits = {k: [fences([r[i] for r in v]) for i in range(4)] for k, v in groups.items()}

    def beyond(lang, source, ratios):
        key = next((k for k in ((0, lang, source), (1, lang)) if len(groups[k]) >= quality_rules.LEAST_GROUP), (2,))
        for name, x, (high, low) in zip(quality_rules.RATIOS, ratios, limits.get(key, [(None, None)] * 4), strict=True):
            if high is not None and x > high or name in quality_rules.TWO_SIDED and low is not None and x < low:
                return True
        return False

    return [i for i, (lang, source, ratios, failed) in enumerate(facts) if not failed and not beyond(lang, source, ratios)]


def without_boilerplate(rows):
    sites = defaultdict(set)
    for _, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites[line].add(source)
    spread = {x for x, s in sites.items() if len(s) >= line_dedup.SITES}
    out = []
    for d, text, lang, source, n in rows:
        if text is not None and spread & set(text.split("\n")):
            text = "\n".join(x for x in text.split("\n") if x not in spread)
            n = len(text)
        out.append((d, text, lang, source, n))
    return out


def met(text: str, segment: str) -> bool:
    """Whether the segment occurs in the text within its edit budget (plain dynamic programming)."""
    budget, row = decontaminate.budget(len(segment)), np.zeros(len(text) + 1, np.int64)
    codes, at = np.array([ord(c) for c in text], np.int64), np.arange(len(text) + 1)
    for i, c in enumerate(segment, 1):
        step = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i], step]) - at) + at
    return row.min() <= budget


def plain(text):
    return re.sub(r"\s+", " ", "".join(c.lower() if c.isalnum() else " " for c in text or "")).strip()


def contaminated(text, items):
    found = set()
    for item_id, item in items:
        codes = decontaminate.normalized(item or "")
        if len(codes) >= decontaminate.LEAST and any(met(plain(text), "".join(map(chr, s))) for s in decontaminate.segments_of(codes)):
            found.add(item_id)
    return sorted(found)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    items = [(k, prose(r, 30)) for k in range(6)] + [(7, "short"), (8, None)]
    rows = documents()
    rows += [(500 + k, f"{prose(r, 40)} {edited(r, items[k % 6][1], s)} {prose(r, 60)}", "en", "s1", 1) for k, s in enumerate([0, 0, 0, 0.03, 0.05, 0.4, 0.9, 0])]
    rows.append((520, prose(r, 60) + "\n" + items[2][1].upper().replace(" ", "  "), "en", "s4", 1))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", rows, items


def test_decontamination(spark, tables):
    path, rows, items = tables
    want = Counter((d, tuple(contaminated(t, items))) for d, t, *_ in rows if len(t or "") < 20_000)
    for chars in (decontaminate.INDEX_CHARS, 400):  # one block of the benchmark, and several
        got = decontaminate.contamination(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet"), chars).collect()
        found = Counter((r["doc_id"], tuple(r["items"])) for r in got)
        long = {d for d, t, *_ in rows if len(t or "") >= 20_000}
        assert len(got) == len(rows) and not want - found and all(d in long for d, _ in found - want)
        assert all(r["contaminated"] == (len(r["items"]) > 0) for r in got)


def test_pipeline(spark, tables):
    path, rows, items = tables
    rows = [rows[i] for i in kept_by_rules(rows)]
    assert 0 < len(rows)
    rows = without_boilerplate(rows)
    kept = {(d, k) for d, _, _, k in components(rows, 5)}
    rows = [x for x in rows if (x[0], True) in kept]
    rows = [x for x in rows if not contaminated(x[1], items)]
    bpe = byte_bpe.opened(byte_bpe.public_tokenizers.path(byte_bpe.RANKS))
    want = Counter((d, len(bpe.encode(t or "")) // 4) for d, t, *_ in rows)
    got = Counter((x["doc_id"], x["n_tokens"]) for x in corpus_pipeline.run(spark, path).collect())
    assert got == want


def test_empty_tables_and_clashing_columns(spark, tables):
    path, rows, items = tables
    empty = spark.createDataFrame([], SCHEMA)
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    for run in (quality_rules.assess, pii.find_personal_data, substring_dedup.dedup_substrings, byte_bpe.round_trip, near_dedup.near_duplicates, token_counts.count_tokens, lm_scoring.score_documents, line_dedup.without_spread_lines, lambda d: decontaminate.contamination(d, bench)):
        assert run(empty).count() == 0
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 40")
    odd = docs.withColumns({c: F.lit("x") for c in ("quality", "kept", "items", "line", "block", "node", "hub", "bucket", "n", "size", "contaminated", "component", "held_out")})
    n = odd.count()
    for run in (quality_rules.assess, pii.find_personal_data, substring_dedup.dedup_substrings, byte_bpe.round_trip, near_dedup.near_duplicates, token_counts.count_tokens, lm_scoring.score_documents, lambda d: decontaminate.contamination(d, bench)):
        assert run(odd).count() == n
    for run in (quality_rules.keep_good, line_dedup.clean_lines, near_dedup.first_of_each, lambda d: decontaminate.clean_documents(d, bench)):
        out = run(odd)
        assert out.columns == odd.columns and out.count() <= n
    assert set(queries.oracle_sql()) <= set(queries.queries())
