"""Rules against brute-force versions: scalars, rewriting, parsing, sequences, evaluation."""

import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parlance.functions import parsing, rewriting
from parlance.functions import text as T
from parlance.models import clients
from parlance.operators import evaluate, intervals, predicates, relations, repair, sequence
from parlance.sources.views import view

SF = "/root/testdata/sf0.001"
SEG = "file_id long, seg_idx int, speaker string, text string, start_ms long, end_ms long"


def each(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", expr(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def test_scalars(spark):
    assert each(spark, ["嗯，啊，今天开会", "对对对 然后", "嗯嗯", "今天", " 好、是、 x "], T.strip_filler_prefix) == ["今天开会", "然后", "嗯嗯", "今天", "x"]
    assert each(spark, ["體驗時間", "abc"], T.zh_simplify) == ["体驗时间", "abc"]
    assert each(spark, ["A-01, 016, 017", "编号 12 是什么意思呢", "一二三四", "abc"], predicates.call_out) == [True, False, True, False]
    assert each(spark, ["<sil>你 好，World。", "a·b…c"], T.eval_clean_zh) == ["你好world", "abc"]
    assert each(spark, ["It's  <x>a\u00a0Test!", ""], T.eval_clean_en) == ["its a test", ""]
    pairs = [("编号 123 在", "编号 123 在。", True), ("编号 123 在", "编号 124 在", False), ("一二三四", "一二三五", False), ("你好", "", False), ("第001號，016", "第001号 016", False), ("001，016", "001。016", True)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").select("i", predicates.accept_correction(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r["y"] for r in sorted(rows)] == [w for *_, w in pairs]
    rounded = spark.createDataFrame([(2.675, 2), (0.125, 2), (2.5, 0), (None, 1)], "x double, d int").select(T.exact_round("x", "d").alias("y")).collect()
    assert [r["y"] for r in rounded] == [2.67, 0.12, 2.0, None]
    words = spark.createDataFrame([(["and", "so"],), (["why?"],), ([],)], "w array<string>").select(T.english_prefix(F.col("w")).alias("y")).collect()
    assert [r["y"] for r in words] == ["And so.", "Why?", ""]


QUERIES = ["Speaker B 的反对意见", "price and rent, speaker_7", "前3分 谁提问", "1:00_2:00 budget", "3：10到1：05", "disagree with the task", "  ", None, "SPEAKERS talk", "大会议室 meeting room 太贵"]


def test_rewriting(spark):
    rules = [rewriting.rewrite_by_rules(q) for q in QUERIES]
    assert rules[0].speaker == "B" and rules[0].intent == ("反对",) and rules[0].semantic[0] == QUERIES[0]
    assert rules[2].time_range == (0.0, 180.0) and rules[3].time_range == (60.0, 120.0) and rules[4].time_range == (190.0, 65.0)
    assert rules[5].intent == ("反对", "提问", "同意")  # an alias inside another counts
    assert rules[6] == rules[7] == rewriting.RewrittenQuery()
    got = {r["query_id"]: r for r in rewriting.rewrite_batch(spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")).collect()}
    for i, r in enumerate(rules):
        assert tuple(got[i]["variants"]) == r.semantic and got[i]["speaker"] == r.speaker and tuple(got[i]["intent"]) == r.intent
        assert ((got[i]["start_s"], got[i]["end_s"]) if got[i]["start_s"] is not None else None) == r.time_range


def test_rewriting_by_model():
    answer = 'sure {"semantic_queries": ["housing cost", " "], "keyword_queries": "rent", "intent": ["提问"], "speaker": "SPEAKER_01", "time_range": [5, 2]} done'
    said = rewriting.rewrite("房租 1:00~2:00", clients.Scripted(lambda m: answer))
    assert said.semantic[:2] == ("房租 1:00~2:00", "housing cost") and said.keyword[1] == "rent"
    assert said.speaker == "SPEAKER_01" and said.time_range == (60.0, 120.0) and said.intent == ()
    for bad in ("no json", "[1]", "{broken"):
        assert rewriting.rewrite("rent", clients.Scripted(lambda m, bad=bad: bad)) == rewriting.rewrite_by_rules("rent")

    def broken(messages):
        raise OSError("no network")

    assert rewriting.rewrite("rent", clients.Scripted(broken)) == rewriting.rewrite_by_rules("rent")


@pytest.mark.parametrize(
    "answer, want",
    [
        ('```json\n{"corrections": [{"index": 2, "text": "a", "note": null},]}\n```', [(2, "a", None)]),
        ('{"0": "x", "1": {"text": "y", "note": "n"}}', [(0, "x", None), (1, "y", "n")]),
        ('notes {"a": 1} and [{"id": "1", "corrected_text": "z", "reason": "r"}]', [(1, "z", "r")]),
        ("{'items': [{'index': 0, 'correction': 5}]}", [(0, "5", None)]),
        ("\ufeff{“results”: [{“index”: 3, “text”: “q”}]}", [(3, "q", None)]),
        ('json: [{"index": 0, "text": " "}, {"index": 9, "text": "late"}, {"index": true, "text": "no"}]', [(9, "late", None)]),
        ('{"segments": [{"index": 1, "text": "first"}, {"index": 1, "text": "last"}]}', [(1, "last", None)]),
        ("nothing", []),
        (None, []),
    ],
)
def test_corrections(answer, want):
    assert parsing.corrections(answer) == want
    assert parsing.corrections(answer, 1) == [w for w in want if w[0] < 1]


def brute_counts(ref, hyp):
    table = {}
    for i, j in itertools.product(range(len(ref) + 1), range(len(hyp) + 1)):
        if not i or not j:
            table[i, j] = (i + j, 0, j, i)
            continue
        d, s, ins, dele = table[i - 1, j - 1]
        same = ref[i - 1] == hyp[j - 1]
        options = [(d + (not same), s + (not same), ins, dele)]
        d, s, ins, dele = table[i, j - 1]
        options.append((d + 1, s, ins + 1, dele))
        d, s, ins, dele = table[i - 1, j]
        options.append((d + 1, s, ins, dele + 1))
        table[i, j] = min(options, key=lambda o: o[0])
    return table[len(ref), len(hyp)]


def test_edit_counts_of_random_texts():
    r = random.Random(4)
    for _ in range(300):
        a, b = (r.choices("abc", k=r.randrange(9)) for _ in range(2))
        assert evaluate.edit_counts(a, b) == brute_counts(a, b), (a, b)
    d, s, i, x = evaluate.edit_counts(["w"] * 4000, ["w"] * 3990 + ["v"] * 5)
    assert (d, s, i, x) == (10, 5, 0, 5)


def plain_clean(text):
    text = re.sub(r"<[^>]+>", "", text or "").lower()
    return text.translate({ord(c): None for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}).split()


def test_word_error_rates_and_text_metrics(spark):
    rows = [tuple(x) for x in view(spark, SF, "segments").select("file_id", "seg_idx", "text").collect()]
    got = {x["file_id"]: x for x in entry.queries()["word_error_rates"](spark, SF).collect()}
    for f, s, text in rows:
        ref, hyp = plain_clean(text), plain_clean(text.replace("the ", "that the "))
        x = got[f"{f}-{s}"]
        assert (x["distance"], x["substitutions"], x["insertions"], x["deletions"]) == evaluate.edit_counts(ref, hyp) and x["n_ref"] == len(ref)
        assert math.isclose(x["rate"], x["distance"] / max(1, len(ref)))
    whole = {}
    for f, _, text in sorted(rows):
        a, b = whole.get(f, ("", ""))
        whole[f] = a + " ".join(plain_clean(text)), b + " ".join(plain_clean(text.replace("the ", "that the ")))
    for x in entry.queries()["text_metrics"](spark, SF).collect():
        a, b = whole[x["file_id"]]
        assert x["distance"] == evaluate.edit_counts(a.split(), b.split())[0] and x["n_hyp"] == len(b.split())


def test_spoken_rates(spark):
    def seg(texts, f):
        return [(f, k, "a", t, 10 * k, 10 * k + 5) for k, t in enumerate(texts)]

    ref = spark.createDataFrame(seg(["the cat", " sat "], 1) + seg([""], 2) + seg(["x"], 3) + seg(["", None], 4), SEG)
    hyp = spark.createDataFrame(seg(["the cat sat", "on"], 1) + seg([None], 2) + seg([" "], 3) + seg(["y"], 4), SEG)
    got = {x["file_id"]: (x["wer"], x["cer"], x["ref_chars"], x["hyp_chars"]) for x in evaluate.spoken_rates(ref, hyp).collect()}
    assert got == {1: (0.3333, 0.2727, 11, 14), 2: (0.0, 0.0, 0, 0), 3: (1.0, 1.0, 1, 0), 4: (1.0, 1.0, 0, 1)}


def brute_diarization(ref, hyp, collar):
    """By the millisecond: total, missed, false, confused, jaccard, with the best of all mappings."""
    skipped = {t for s, e, _ in ref for edge in (s, e) for t in range(edge - collar // 2, edge + collar // 2)} if collar else set()
    end = max([e for _, e, _ in ref + hyp], default=0)
    at = [({v for s, e, v in ref if s <= t < e}, {v for s, e, v in hyp if s <= t < e}) for t in range(end) if t not in skipped]
    rs, hs = sorted({v for _, _, v in ref}), sorted({v for _, _, v in hyp})
    rs, hs = [r for r in rs if any(r in a for a, _ in at)], [h for h in hs if any(h in b for _, b in at)]
    both = {(r, h): sum(r in a and h in b for a, b in at) for r in rs for h in hs}
    wide = hs + [None] * len(rs)
    best = max(itertools.permutations(wide, len(rs)), key=lambda p: sum(both.get(x, 0) for x in zip(rs, p, strict=True)), default=())
    total = sum(len(a) for a, _ in at)
    right = sum(both.get(x, 0) for x in zip(rs, best, strict=True))
    errors = []
    for r, h in zip(rs, best, strict=True):
        shared = both.get((r, h), 0)
        united = sum(r in a or h in b for a, b in at)
        errors.append(1 - shared / united if shared else 1.0)
    return total, sum(max(0, len(a) - len(b)) for a, b in at), sum(max(0, len(b) - len(a)) for a, b in at), sum(min(len(a), len(b)) for a, b in at) - right, errors


@pytest.mark.parametrize("collar", [0, 20])
def test_diarization_report(spark, collar):
    r = random.Random(7)
    ref, hyp, want = [], [], {}
    for f in range(8):
        make = lambda names, k: [(s, s + r.randint(20, 150), r.choice(names)) for s in (r.randrange(400) for _ in range(k))]
        a, b = make("ABC", r.randint(1, 6)), make("xyzw", r.randint(0, 6))
        want[f] = brute_diarization(a, b, collar)
        ref += [(f, k, v, "", s, e) for k, (s, e, v) in enumerate(a)]
        hyp += [(f, k, v, "", s, e) for k, (s, e, v) in enumerate(b)]
    got = intervals.diarization_report(spark.createDataFrame(ref, SEG), spark.createDataFrame(hyp, SEG), collar).collect()
    for x in got:
        total, missed, extra, confused, errors = want[x["file_id"]]
        assert (x["total_ms"], x["missed_ms"], x["false_ms"], x["confused_ms"]) == (total, missed, extra, confused), x
        if total:
            assert math.isclose(x["der"], (missed + extra + confused) / total, abs_tol=1e-5)
    assert {x["file_id"] for x in got if x["total_ms"]} == {f for f, w in want.items() if w[0]}


def test_best_assignment():
    r = random.Random(1)
    for _ in range(100):
        n, m = r.randint(1, 4), r.randint(1, 4)
        gain = [[r.randrange(20) for _ in range(m)] for _ in range(n)]
        pairs = intervals.best_assignment(gain)
        if n <= m:
            best = max(sum(gain[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        else:
            best = max(sum(gain[i][j] for j, i in enumerate(p)) for p in itertools.permutations(range(n), m))
        assert sum(gain[i][j] for i, j in pairs) == best and len(pairs) == min(n, m)


def plain_join(a, b):
    if not a or not b:
        return a or b
    if a[-1].isspace() or b[0].isspace():
        return a + b
    word = lambda c: c.isascii() and c.isalnum()
    return a + (" " if word(b[0]) and (a[-1] in ".?!,;:" or word(a[-1])) else "") + b


def plain_turns(words, gap=500, dur=15_000, chars=80, most=2_500):
    pieces = []
    for w, speaker, s, e in words:
        w = (w or "").strip()
        if s is None or not w or e <= s:
            continue
        if e - s <= most:
            pieces.append((w, speaker, s, e))
        elif len(w) <= 2:
            pieces.append((w, speaker, s, s + most))
        else:
            step = (e - s) / len(w)
            pieces += [(c, speaker, s + i * step, s + (i + 1) * step) for i, c in enumerate(w) if c.strip()]
    turns = []
    for w, speaker, s, e in sorted(pieces, key=lambda p: (p[2], p[3])):
        t = turns[-1] if turns else None
        if t and t[1] == speaker and s - t[3] <= gap and e - t[2] <= dur and len(t[0]) + len(w) <= chars:
            t[0], t[3] = plain_join(t[0], w), e
        else:
            turns.append([w, speaker, s, e])
    return [(round(s, 3), round(e, 3), speaker, w) for w, speaker, s, e in turns if e - s >= 50]


def test_words_to_turns(spark):
    r = random.Random(3)
    rows, want = [], {}
    for f in range(12):
        at, words = 0, []
        for _ in range(r.randint(1, 60)):
            at += r.choice([0, 10, 40, 300, 700])
            long = r.choice([30, 200, 900, 2600, 7000])
            words.append((r.choice(["a", "字", "longer", "two", "end.", " ", "你好吗", None]), r.choice(["A", "A", "B"]), at, at + long))
            at += long
        want[f] = plain_turns(words)
        rows += [(f, k, *w) for k, w in enumerate(words)]
    got = sequence.words_to_turns(spark.createDataFrame(rows, "file_id long, word_idx long, word string, speaker string, start_ms long, end_ms long")).collect()
    for f in range(12):
        assert sorted((round(x["start_ms"], 3), round(x["end_ms"], 3), x["speaker"], x["text"]) for x in got if x["file_id"] == f) == sorted(want[f]), f


def test_merge_turns(spark):
    rows = [(1, 0, "a", "今", 0, 1500), (1, 1, "a", "天 ok", 2400, 3000), (1, 2, "a", "fine", 3100, 3500), (1, 3, "b", "no", 3600, 3700), (1, 4, "b", "x" * 70, 3700, 3900)]
    got = sorted((x["start_ms"], x["end_ms"], x["text"]) for x in sequence.merge_turns(spark.createDataFrame(rows, SEG)).collect())
    assert got == [(2050, 3500, "今天 ok fine"), (3600, 3900, "no " + "x" * 70)]


def test_playback_of_the_saved_meeting(spark):
    """Six segments whose bounds are known; the second pass caps each at its neighbour's start."""
    raw = [(0, 17.55, 26.24), (1, 26.24, 53.84), (2, 53.84, 83.30), (3, 83.30, 92.76), (4, 92.76, 116.12), (5, 117.25, 120.02)]
    want = [(16.30, 26.16), (26.18, 53.76), (53.78, 83.22), (83.24, 92.68), (92.70, 116.77), (117.20, 120.02)]
    regions = {0: [(17.90, 26.0)], 5: [(117.60, 119.9)]}
    starts = {0: 0.0, 5: 116.12}
    ms = lambda x: round(1000 * x)
    rows = []
    for k, s, e in raw:
        found = regions.get(k, [(s + 0.1, e - 0.1)])
        begin = starts.get(k, s)
        rows.append((1, k, "A", "a text that is long enough", ms(begin), ms(e), 120_020, [(ms(a), ms(b), ms(min(b, e) - max(a, begin))) for a, b in found]))
    seg = spark.createDataFrame(rows, SEG + ", total_ms long, regions array<struct<start_ms:bigint,end_ms:bigint,overlap:bigint>>")
    first = sequence.refine_playback(seg)
    assert {x["seg_idx"]: x["start_asr_raw_ms"] for x in first.collect() if x["start_asr_raw_ms"] is not None} == {0: 0, 5: 116_120}
    got = {x["seg_idx"]: (x["playback_start_ms"] / 1000, x["playback_end_ms"]) for x in sequence.neighbor_playback(first).collect()}
    for k, (s, e) in enumerate(want):
        assert got[k][0] == pytest.approx(s)
        assert (120.02 if got[k][1] is None else got[k][1] / 1000) == pytest.approx(e)


def plain_refined(rows, total):
    out = []
    for k, (text, s, e, regions) in enumerate(rows):
        s0, e0 = max(0, s), min(e, total)
        if e0 <= s0:
            continue
        if not regions:
            out.append((k, text, s, None, None, None))
            continue
        n = len(text.strip())
        chosen = max(regions, key=lambda x: x[2]) if n <= 8 else regions[0]
        if s0 <= 500 and len(regions) > 1 and regions[0][0] <= 1000 and regions[0][1] - regions[0][0] <= 700:
            chosen = next((x for x in regions[1:] if x[0] - regions[0][1] >= 1200), chosen)
        new = max(s0, chosen[0] - 350)
        shown, raw, point = s, None, s0
        if new - s0 >= 500 and e0 - new >= 500:
            point = new
            if new - s0 <= (20_000 if n <= 8 or s0 <= 500 else 1_500):
                shown, raw = new, s0
        begin = min(max(0, shown), max(s0, point - (1_200 if k == 0 else 350)))
        end = min(total, e0 + 650)
        out.append((k, text, shown, raw, *((max(0, begin - 50), end) if end > e0 else (None, None))))
    return out


def test_refine_playback(spark):
    r = random.Random(11)
    rows, want = [], []
    for f in range(30):
        at, total, mine = 0, 40_000, []
        for k in range(r.randint(1, 5)):
            s, e = at + r.randrange(300), at + r.randint(400, 9000)
            cut = sorted(r.sample(range(s, e), min(6, e - s)))
            regions = [(a, b, b - a) for a, b in zip(cut[::2], cut[1::2], strict=False)] if r.random() < 0.9 else []
            mine.append((r.choice(["short", "a longer text here", "x"]), s, e, regions))
            at = e + r.randrange(200)
        rows += [(f, k, "A", t, s, e, total, g) for k, (t, s, e, g) in enumerate(mine)]
        want += [(f, *x) for x in plain_refined(mine, total)]
    seg = spark.createDataFrame(rows, SEG + ", total_ms long, regions array<struct<start_ms:bigint,end_ms:bigint,overlap:bigint>>")
    got = sequence.refine_playback(seg).collect()
    assert sorted((x["file_id"], x["seg_idx"], x["text"], x["start_ms"], x["start_asr_raw_ms"], x["playback_start_ms"], x["playback_end_ms"]) for x in got) == sorted(want)


def test_artifact_filter_on_all_rows(spark):
    def plain(text, s, e):
        text = (text or "").strip()
        for phrase in T.OUTRO_PHRASES:
            text = text.replace(phrase, "")
        text = re.sub(r"(.{2,3}?)\1{8,}", r"\1", re.sub(r"(.)\1{15,}", r"\1\1", text))
        text = re.sub(r"嗯[\s嗯]{10,}嗯", "嗯嗯", text).strip()
        text = re.sub(r"[【\[].*?[】\]]", "", text).strip()
        return None if not text or re.fullmatch(r"[\s\W_]+", text) or e <= s or (len(text) <= 2 and e - s > 10_000) else text

    odd = [(9, k, "a", t, 0, d) for k, (t, d) in enumerate([("哈" * 40, 500), ("[noise] yes", 500), ("谢谢大家的观看", 500), ("好", 10_001), ("no no no no no no no no no no ", 500), ("嗯 嗯 嗯 嗯 嗯 嗯 嗯 嗯 嗯", 500), ("...", 500), ("12", 0), (None, 500)])]
    seg = view(spark, SF, "segments").select("file_id", "seg_idx", "speaker", "text", "start_ms", "end_ms").union(spark.createDataFrame(odd, SEG))
    want = {(x["file_id"], x["seg_idx"]): plain(x["text"], x["start_ms"], x["end_ms"]) for x in seg.collect()}
    got = {(x["file_id"], x["seg_idx"]): x["text"] for x in predicates.artifact_filter(seg).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_repair(spark):
    before, after = "we have to look at the whole".split(), "budget for next year again".split()
    heard = "to look at the whole picture of our budget for next year".split()
    assert repair.missing_phrase(before, after, heard) == ["picture", "of", "our"]
    assert repair.missing_phrase(before + ["picture", "of", "our"], after, heard) == []
    assert repair.missing_phrase(before, after, heard[:5]) == []
    rows = [(1, 0, "a", "We have to look at the whole", 0, 5000), (1, 1, "a", " budget for next year again", 5100, 9000), (1, 2, "a", "ok", 9100, 9400), (2, 0, "a", "one two three four", 0, 900), (2, 1, "a", "five six seven eight", 5000, 6000)]
    seg = spark.createDataFrame(rows, SEG).withColumn("total_ms", F.lit(60_000))
    got = {(x["file_id"], x["seg_idx"]): x for x in repair.repair_prefixes(seg, repair.scripted_decoder({(1, 1): " ".join(heard)})).collect()}
    assert got[1, 1]["text"] == "Picture of our. budget for next year again" and got[1, 1]["boundary_prefix_repaired"]
    assert got[1, 1]["boundary_prefix_source"]["window_start"] == 2.5 and sum(x["boundary_prefix_repaired"] is not None for x in got.values()) == 1


def test_speech_chunks_restore(spark):
    regions = spark.createDataFrame([(1, 1000, 3000), (1, 4000, 5000), (1, 30_000, 75_000), (1, 79_900, 90_000)], "file_id long, start_ms long, end_ms long")
    files = spark.createDataFrame([(1, 80_000)], "file_id long, total_ms long")
    chunks = sequence.speech_chunks(regions, files)
    got = sorted((x["chunk_start_ms"], x["chunk_end_ms"], x["valid_start_ms"], x["valid_end_ms"]) for x in chunks.collect())
    assert got == [(0, 7000, 1000, 5000), (28_000, 48_000, 30_000, 75_000), (48_000, 68_000, 30_000, 75_000), (68_000, 77_000, 30_000, 75_000), (77_900, 80_000, 79_900, 80_000)]
    first = chunks.where("chunk_start_ms = 0").select("file_id", "region_idx", "chunk_idx").first()
    decoded = spark.createDataFrame([(*first, 0, 2000, "a"), (*first, 3000, 3000, "b"), (*first, 6000, 6500, "late"), (*first, 2000, 2500, " ")], "file_id long, region_idx long, chunk_idx int, start_ms long, end_ms long, text string")
    assert sorted((x["start_ms"], x["end_ms"], x["text"]) for x in sequence.restore_chunks(decoded, chunks).collect()) == [(1000, 2000, "a"), (3000, 3100, "b")]


def test_labels_upsert_paths_and_evaluation(spark):
    seg = spark.createDataFrame([(1, 0, "SPEAKER_UNKNOWN", "x", 0, 1), (1, 1, "q", "x", 5, 6), (1, 2, "", "x", 7, 8), (1, 3, "p", "x", 9, 10)] + [(2, k, f"s{k:02}", "x", k, k + 1) for k in range(28)], SEG)
    labels = {(x["file_id"], x["speaker"]): x["label"] for x in relations.speaker_labels(seg).collect()}
    assert labels[1, "SPEAKER_UNKNOWN"] == "UNKNOWN" and labels[1, "q"] == "A" and labels[1, "p"] == "B" and (1, "") not in labels
    assert labels[2, "s25"] == "Z" and labels[2, "s26"] == "S1"
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 4)], "k string, v int")
    for many in (new, new.orderBy(F.col("v").desc())):
        assert sorted(tuple(x) for x in relations.upsert(old, many, "k").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(tuple(x) for x in relations.upsert(old, new, "k", replace=False).collect()) == [("a", 1), ("b", 1), ("c", 4)]
    assert each(spark, ["A/B/../C.Wav", "a\\b/./c", " x//y "], relations.path_key) == ["a/c.wav", "a/b/c", "x/y"]
    report = entry.queries()["file_evaluation"](spark, SF)
    files = {x["file_id"]: x for x in report.collect()}
    assert all(x["rate"] >= 0 and x["rate_delta"] == pytest.approx(x["rate"]) for x in files.values())
    total = evaluate.overall(report).first()
    assert total["files"] == len(files) and total["deletions"] == sum(x["deletions"] for x in files.values())
    text = evaluate.report_markdown("Report", {"all": evaluate.overall(report)})
    assert text.startswith("# Report") and text.count("|") > 20
    assert json.loads(evaluate.overall(report).toJSON().first())["files"] == len(files)
