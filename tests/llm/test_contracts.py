"""Each contract query's rows against a brute-force version on a small table."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from parlance.llm import byte_bpe, lm_scoring, near_dedup, pii, quality_rules, substring_dedup, token_counts, warc
from tests.llm.fixtures import PERSONAL, SCHEMA, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return documents() + [(300 + k, t, "en", "s3", 0) for k, t in enumerate(PERSONAL)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def as_set(found):
    return Counter(tuple(r) for r in found)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_quality_counts(docs, rows):
    want = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        times = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {p for i in range(len(w) - 2) if times[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want[doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed] += 1
    got = quality_rules.assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert as_set(r[:7] for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert all(r["kept"] is not None for r in got)


def test_base_spans_and_additions(docs, rows):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def right(kind, value):
        d = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    want = Counter()
    for doc_id, text, *_ in rows:
        found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if right(k, m[0])] for k, p in patterns.items()}
        want[(doc_id, *map(len, found.values()), sha(",".join(x for v in found.values() for x in v).encode()))] += 1
    got = pii.find_personal_data(docs).collect()
    assert as_set(r[:6] for r in got) == want
    added = {r["doc_id"]: (r["n_added"], r["spans"]) for r in got}
    assert added[304][0] >= 2  # a card that the base loses to the number before it, phones without a plus
    for doc_id in range(60):
        assert added[doc_id][0] == 0


def test_model_on_held_out_windows():
    texts, spans = pii.labelled(400, 12345)
    tag, _ = pii.trained().decode(np.stack([pii.codes(t) for t in texts], axis=1))
    gold = np.stack([pii.tags(s) for s in spans], axis=1)
    assert (tag == gold).mean() > 0.96
    assert (tag == gold)[gold > 0].mean() > 0.9


def test_model_gradients():
    texts, spans = pii.labelled(3, 5)
    ids, gold = np.stack([pii.codes(t) for t in texts], axis=1)[:12], np.stack([pii.tags(s) for s in spans], axis=1)[:12]
    tagger = pii.Tagger()
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    _, grads = tagger.gradients(ids, gold)
    for k in ("move", "first", "out", "hf", "xb", "hb", "gf"):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        keep, step = tagger.w[k][at], 1e-3
        losses = []
        for d in (step, -step):
            tagger.w[k][at] = keep + d
            losses.append(tagger.gradients(ids, gold)[0])
        tagger.w[k][at] = keep
        assert math.isclose((losses[0] - losses[1]) / (2 * step), grads[k][at], rel_tol=0.02, abs_tol=1e-3), k


@pytest.mark.parametrize("chars", [2_000, 10**9])
def test_substring_dedup(docs, rows, chars):
    all_of = [WORD.findall(t or "") for _, t, *_ in rows]
    starts = Counter(tuple(w[i : i + 35]) for w in all_of for i in range(len(w) - 34))
    want = Counter()
    for (doc_id, *_), w in zip(rows, all_of, strict=True):
        gone = {p for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        want[doc_id, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone).encode())] += 1
    assert as_set(substring_dedup.dedup_substrings(docs, block_chars=chars).collect()) == want


def test_byte_bpe(docs, rows):
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want[doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())] += 1
    assert as_set(byte_bpe.round_trip(docs).collect()) == want
    texts = byte_bpe.decode_documents(byte_bpe.encode_documents(docs))
    assert as_set(texts.collect()) == Counter((d, t or "") for d, t, *_ in rows)


def test_byte_bpe_on_odd_texts():
    import random

    bpe = byte_bpe.opened(public_tokenizers.path(byte_bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(5)
    odd = ["a" * 5000, "ab" * 2000, " " * 3000, "<|endoftext|>", "İΣ"] + ["".join(r.choices("abthe  \n\t'sérá1290中😀\x1c　!ing", k=r.randrange(60))) for _ in range(3000)]
    for text in odd:
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert bpe.decode(ids).decode() == text


def components(rows, size):
    sets = defaultdict(list)
    sizes = []
    for doc_id, text, *_ in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = WORD.findall(low)
        s = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        sizes.append((doc_id, len(s)))
        if doc_id is not None and s:
            sets[doc_id].append(s)
    root = {d: d for d, _ in sizes if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return Counter((d, n, find(d) if d is not None else None, d is None or find(d) == d) for d, n in sizes)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    assert as_set(near_dedup.near_duplicates(docs, size=size).collect()) == components(rows, size)


def test_star_components(spark):
    import random

    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    root = {}
    for u, v in edges:
        for x in (u, v):
            root.setdefault(x, x)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {x["node"]: x["component"] for x in near_dedup.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}


def test_token_counts(docs, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    extra = [(400, "a <|endoftext|>B<|startoftext|>", None, None, None), (401, "ΑΣ Σας İx 'S i'Ve", None, None, None)]
    want = Counter()
    for doc_id, text, *_ in rows + extra:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want[doc_id, len((text or "").encode()), n, n > 2048] += 1
    both = docs.union(docs.sparkSession.createDataFrame(extra, SCHEMA))
    assert as_set(token_counts.count_tokens(both, block_chars=20_000, shards=3).collect()) == want


def kneser_ney(rows):
    """Dictionaries all the way: interpolated modified Kneser-Ney bigrams."""
    texts = [(d, WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]) for d, t, *_ in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    uni, pair, context = Counter(), Counter(), Counter()
    for d, w in texts:
        if not held(d):
            uni.update(w)
            pair.update(zip(["\t", *w], w, strict=False))
            context.update(["\t", *w[:-1]])

    def discounts(counts):
        n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
        if min(n1, n2, n3) == 0:
            return [0, 0.5, 0.75, 1.0]
        y = n1 / (n1 + 2 * n2)
        return [0, *(min(max(x, 0), k) for k, x in enumerate([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 1))]

    before = Counter(w for _, w in pair)
    d, e = discounts(pair.values()), discounts(before.values())
    total, types, n_all = sum(before.values()), len(uni), sum(uni.values())
    free = sum(e[min(n, 3)] for n in before.values()) / total
    gamma = defaultdict(float)
    for (v, _), n in pair.items():
        gamma[v] += d[min(n, 3)]

    def p(v, w):
        low = max(before[w] - e[min(before[w], 3)], 0) / total + free / (types + 1)
        return (max(pair[v, w] - d[min(pair[v, w], 3)], 0) + gamma[v] * low) / context[v] if context[v] else low

    assert math.isclose(sum(p("the", w) for w in uni) + p("the", "never seen"), 1, rel_tol=1e-9)
    for doc_id, w in texts:
        yield doc_id, held(doc_id), len(w), sum(uni[x] > 0 for x in w), n_all, sum(math.log10((uni[x] + 1) / (n_all + types + 1)) for x in w), sum(math.log10(p(v, x)) for v, x in zip(["\t", *w], w, strict=False))


@pytest.mark.parametrize("chars", [5_000, 10**9])
def test_lm_scoring(docs, rows, chars, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PAIRS_A_SHARD", 2_000 if chars < 10**9 else 10**9)
    key = lambda r: tuple((x is None, x) for x in r[:3]) + (round(r[5], 6),)
    got, want = sorted(lm_scoring.score_documents(docs, block_chars=chars).collect(), key=key), sorted(kneser_ney(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert tuple(a[:5]) == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_warc(spark, tmp_path):
    long = "".join(f"<p>é {k}</p>" for k in range(9000))
    pages = [(1, "http://a/", "x" * 150), (2, None, "x" * 150), (3, "http://b\r\n/", "y" * 99), (4, "u", "y" * 99), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (9, "u", "\r\n\r\n0\r\n\r\nWARC/1.1\r\n" * 40), (0, "v", "z" * 100), (None, "w", "q" * 200), (9, "u", "other"), (9, "u", "other")]
    first = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        refers = first.get(html) if i is not None and first.get(html) != i else None
        want[i, len(data), sha(data), "revisit" if refers is not None else "response", refers, None] += 1
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = warc.archive_and_read(df, segment=5000)
    assert as_set((*r[:5], r["problem"]) for r in got.collect()) == want
    assert got.agg({"n_segments": "max"}).first()[0] > 20
    path = f"file://{tmp_path}/archives"
    warc.write_archives(df, path, 5000)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(tmp_path.glob("archives/part-*")))
    kept = [f"WARC/1.1\r\n{''.join(f'{k}: {v}' + chr(13) + chr(10) for k, v in f.items())}\r\n".encode() + b + b"\r\n\r\n" for f, b in warc.parsed(raw) if f.get("warc-segment-number") != "3"]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/one.warc").write_bytes(b"".join(kept))
    problems = {r["page_id"]: r["problem"] for r in warc.read_archives(spark, f"file://{tmp_path}/broken").collect()}
    assert problems[7] == "segment missing or repeated" and problems[1] is None
