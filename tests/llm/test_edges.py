"""Ids beside nulls, clashing columns, long spans, short items, common q-grams, recall on real rows."""

import random
import time
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import byte_bpe, common, decontaminate, line_dedup, lm_scoring, near_dedup, pii, quality_rules, substring_dedup, token_counts, warc
from tests.llm.fixtures import SCHEMA, prose
from tests.llm.test_contracts import components
from tests.llm.test_pipeline import met, plain

BIG = 2**53 + 1


@pytest.fixture(scope="module")
def ids(spark):
    r = random.Random(8)
    rows = [(BIG, prose(r, 60), "en", "s", 1), (BIG + 1, prose(r, 60), "en", "s", 1), (None, prose(r, 60), "en", "s", 1), (-BIG, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(random.Random(4), 30)), (2, "tiny item"), (3, "?!"), (4, None)], "item_id long, text string")


def test_ids_beside_nulls_stay_exact(spark, ids, bench):
    want = {BIG, BIG + 1, None, -BIG}
    runs = {
        "quality": quality_rules.assess, "pii": pii.find_personal_data, "substring": substring_dedup.dedup_substrings, "bpe": byte_bpe.round_trip, "encode": byte_bpe.encode_documents,
        "near": near_dedup.near_duplicates, "tokens": token_counts.count_tokens, "lm": lm_scoring.score_documents, "lines": line_dedup.without_spread_lines, "masked": pii.masked,
        "bench": lambda d: decontaminate.contamination(d, bench), "clean": lambda d: decontaminate.clean_documents(d, bench),
    }
    for name, run in runs.items():
        out = run(ids)
        assert {x["doc_id"] for x in out.collect()} == want, name
        assert out.schema["doc_id"].dataType == ids.schema["doc_id"].dataType
    assert {x["component_id"] for x in near_dedup.near_duplicates(ids).collect()} == want
    pages = spark.createDataFrame([(BIG + 2, "u", "x" * 200), (BIG, "u", "x" * 200), (None, "u", "y" * 200)], "page_id long, url string, html string").coalesce(1)
    assert {(x["page_id"], x["refers_to"]) for x in warc.archive_and_read(pages).collect()} == {(BIG, None), (BIG + 2, BIG), (None, None)}


def test_columns_of_any_name_pass_unchanged(spark, ids, bench):
    names = ("n_lines", "n_removed", "_gone", "_kept", "_place", "_items", "_segments", "items", "segments", "row", "place", "gone", "line", "quality", "fence", "kept", "base_failed", "node", "size")
    odd = ids.select("*", *(F.lit(777).alias(n) for n in names))
    for run in (line_dedup.clean_lines, lambda d: decontaminate.clean_documents(d, bench), near_dedup.first_of_each, pii.masked, quality_rules.keep_good):
        out = run(odd)
        assert out.columns == odd.columns
        assert all(x[n] == 777 for x in out.collect() for n in names)


@pytest.mark.parametrize("length", [49, 79, 200])
def test_long_values_at_every_offset(length):
    tail = " @ mail.host.example.com"
    value = ("name." * 60)[: length - len(tail) - 1] + "x" + tail
    filler = " ".join("word" for _ in range(60))
    for offset in range(130):
        text = (filler[: offset - 1] + " " if offset else "") + value + " and more words follow here"
        assert pii.model_spans([text], [pii.base_spans(text)], pii.trained())[0] == [("email", offset, offset + length)], offset


def test_many_spans_take_no_time():
    r = random.Random(2)
    spans = [(r.random(), "ip", 7 * i, 7 * i + r.randint(3, 20)) for i in range(20_000)]
    began = time.time()
    chosen = pii.best_disjoint(spans)
    left = pii.apart_from([("card", 14 * i, 14 * i + 3) for i in range(20_000)], spans)
    assert time.time() - began < 2
    assert all(a[2] <= b[1] for a, b in zip(chosen, chosen[1:], strict=False))
    assert all(s % 14 >= 3 and s // 14 == (e - 1) // 14 for _, _, s, e in left)
    few = spans[:14]
    best = max(sum(few[i][0] for i in range(14) if m >> i & 1) for m in range(1 << 14) if all(not (m >> i & 1 and m >> j & 1) or few[i][3] <= few[j][2] or few[j][3] <= few[i][2] for i in range(14) for j in range(i)))
    weight = {(k, s, e): w for w, k, s, e in few}
    assert sum(weight[x] for x in pii.best_disjoint(few)) == pytest.approx(best)


def test_mask():
    text = "write to a.b@example.com or 10.0.0.1"
    assert pii.mask(text, pii.base_spans(text)) == "write to <email> or <ip>"
    assert pii.mask("abcdef", [("card", 0, 4), ("phone", 2, 6)]) == "<card>"


def test_vocabulary(spark):
    ranks = byte_bpe.load_ranks(byte_bpe.public_tokenizers.path(byte_bpe.RANKS))
    assert byte_bpe.vocabulary(spark).count() == len(ranks)


def exactly(text, items):
    """Items met in a text, by plain dynamic programming and, for short ones, by whole words."""
    low, found = plain(text), set()
    for item_id, item in items:
        codes = decontaminate.normalized(item or "")
        if len(codes) >= decontaminate.LEAST:
            if any(met(low, "".join(map(chr, s))) for s in decontaminate.segments_of(codes)):
                found.add(item_id)
        elif plain(item) and f" {plain(item)} " in f" {low} ":
            found.add(item_id)
    return tuple(sorted(found))


@pytest.mark.parametrize("hits", [50, 1 << 20])
def test_decontamination_is_exact_for_long_and_common_text(monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    monkeypatch.setattr(decontaminate, "COMMON", 3)
    r = random.Random(6)
    items = [(k, "of the and in to a is " * 3 + prose(r, 12 + k)) for k in range(12)] + [(20, "two words"), (21, "Ünïque"), (22, "--")]
    texts = [prose(r, 40) + " " + items[k][1] + " " + prose(r, 40) for k in range(0, 12, 3)]
    texts += ["of the and in to a is " * 40, "These are two   WORDS.", "twotwo words", "so ünïque", prose(r, 3000) + " " + items[5][1].replace("a", "o", 4) + prose(r, 500), "", None]
    found = decontaminate.find(texts, decontaminate.Index(items))
    assert [tuple(sorted(f)) for f in found] == [exactly(t, items) for t in texts]


def test_blocks_of_the_benchmark_give_the_same(spark, ids, bench):
    docs = ids.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" a tiny item")))
    one, many = (sorted((x["doc_id"] or 0, x["items"]) for x in decontaminate.contamination(docs, bench, chars).collect()) for chars in (10**9, 20))
    assert one == many and all(2 in items for _, items in one)


@pytest.mark.parametrize("size", [quality_rules.LEAST_GROUP - 1, quality_rules.LEAST_GROUP, quality_rules.LEAST_GROUP + 1])
def test_fences_of_small_groups_are_their_languages(spark, size):
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    rows = [(i, " ".join(word(r.randint(3, 7)) for _ in range(100)), "en", "big", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(word(r.randint(12, 16)) for _ in range(100)), "en", "small", 0) for i in range(size)]
    got = {x["doc_id"]: x["kept"] for x in quality_rules.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(300))
    # long words are usual in a source of its own sketch, and far outside the language's
    assert {got[1000 + i] for i in range(size)} == {size >= quality_rules.LEAST_GROUP}


def test_near_duplicates_recall_on_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(x) for x in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for d, t, *_ in rows}
    sets = {d: {hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    order = sorted(sets, key=lambda d: len(sets[d]))
    links = []
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs).collect()}
    assert len(links) > 100
    assert all(got[a] == got[b] for a, b in links)  # recall 1 against exact pairs
    groups = defaultdict(set)
    for d, c in got.items():
        groups[c].add(d)
    linked = {d for pair in links for d in pair}
    assert {d for g in groups.values() if len(g) > 1 for d in g} == linked


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}")
    docs = spark.createDataFrame([(k, prose(random.Random(k % 3), 60)) for k in range(9)], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).count() == 9
    assert [p.name.split("-")[0] for p in (tmp_path / "parlance").iterdir()] == ["near"]
    with common.Scratch(spark):
        near_dedup.near_duplicates(docs).count()
    assert len(list((tmp_path / "parlance").iterdir())) == 1


def test_word_hashes_have_two_independent_halves():
    a, b = common.WordHashes().both([b"x", b"y", b"x"])
    assert a[0] == a[2] != a[1] and b[0] == b[2] != b[1] and not np.array_equal(a, b)


def test_components_of_repeated_rows(spark):
    r = random.Random(9)
    text = prose(r, 80)
    rows = [(5, text, None, None, None)] * 40 + [(3, text, None, None, None)] * 40 + [(9, text + " end", None, None, None)]
    got = Counter(tuple(x) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == components(rows, 5)


def test_two_runs_in_one_driver_keep_their_tables(spark):
    """The one that ends first must not delete what the other still reads."""
    from concurrent.futures import ThreadPoolExecutor

    from parlance.llm.common import Scratch, materialize

    def job(rows: int, wait: float) -> int:
        with Scratch(spark):
            df = materialize(spark.range(rows), "two-runs")
            time.sleep(wait)
            return df.count()

    with ThreadPoolExecutor(2) as pool:
        slow, fast = pool.submit(job, 1000, 3), pool.submit(job, 10, 0.5)
        assert (fast.result(), slow.result()) == (10, 1000)


@pytest.mark.parametrize("sites", [line_dedup.SITES, 300])
def test_lines_near_the_threshold_are_counted_exactly(spark, sites):
    """Lines on one site fewer, as many, one more, and on so many rows of few sites; a null site is one."""
    rows, want = [], set()
    for k in range(30):
        n = sites + k % 3 - 1
        line = f"line number {k} of a small print"
        rows += [(1000 * k + i, f"own {k} {i}\n{line}", None if i == 0 else f"site {i}") for i in range(n)]
        rows += [(500_000 + 1000 * k + i, line, "site 1") for i in range(40)]  # more rows, no further site
        want |= {line} if n >= sites else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = line_dedup.without_spread_lines(docs, sites).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    for r in out:
        lines = text[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for x in lines if x not in want) and r["n_removed"] == sum(x in want for x in lines)
