"""Personal data: exact base patterns plus a character-level BiLSTM with CRF transitions.

Base patterns give e-mail addresses, IP addresses, card numbers and phone numbers.  The model, in
numpy, reads windows of ``WINDOW`` characters that overlap by half; a bidirectional LSTM scores the
tags (outside, or begin/inside of a kind) of each character and a linear-chain CRF decodes them.
It is trained on the driver, once a process, from ``TRAINING`` labelled windows (a bounded sample:
generated text with labelled spans in the written forms of each kind, and look-alikes that are no
personal data); its weights, some 40 KB, go to the workers with the task.

Windows are decoded one by one and reconciled over the whole document: pieces of one kind that
windows cut at their edges are joined across them, so a value may be of any length, and a span is
widened to the run of its kind's characters that it stands in.  Base spans stand; of the model's spans that
touch none of them, those whose posterior is at least ``CERTAIN`` and that are possible values of
their kind compete, and the set of disjoint spans with the greatest total posterior wins (weighted
interval scheduling), whichever windows they came from.  Every possible value holds an ``@`` or a
digit; decoding starts at the windows that hold either and goes on to the next window wherever a
piece reaches an edge, so the windows left out cannot give a span.

Nulls: a null text is empty and has no spans.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.common import id_again, id_text

KINDS = ("email", "ip", "card", "phone")
WINDOW, CERTAIN = 80, 0.9
TRAINING, EPOCHS, BATCH, HIDDEN, EMBEDDED, SEED = 1600, 6, 32, 24, 12, 7
TAGS = 1 + 2 * len(KINDS)
PAD, OTHER, LETTER, SPACE, CHARACTERS = 99, 98, 97, 96, 100

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# runs of digits are taken whole, so no start inside a run is tried again
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; reads outward from each @, so long words cost no more than their length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind as listed and then by start; failing matches are dropped."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not HINT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def possible(kind: str, value: str) -> bool:
    """Whether a text can be a value of the kind, however it is written."""
    n = len(digits_of(value))
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?@ ?[\w-]+(?: ?\. ?[\w-]+)+", value))
    if kind == "ip":
        parts = re.split(r"[. ]+", value)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= n <= 19 and luhn(digits_of(value)) and bool(re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", value))
    return 10 <= n <= 15 and bool(re.fullmatch(r"\(?[0-9][0-9 ()./-]+[0-9]", value)) and bool(re.search(r"[0-9)][ ./-]+[0-9(]", value))


# -- labelled spans ---------------------------------------------------------------------------


class Sampler:
    """Labelled windows: (text, spans)."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.r.integers(len(options)))]

    def digits(self, n: int) -> str:
        return "".join(str(d) for d in self.r.integers(0, 10, n))

    def word(self, most: int = 9) -> str:
        letters = "etaoinshrdlucmfwypvbgkqjxzéèñüöß"
        n = int(self.r.integers(1, most))
        return "".join(letters[min(len(letters) - 1, int(self.r.exponential(7)))] for _ in range(n))

    def email(self) -> str:
        name = self.word(8) + self.pick("", ".", "_") + self.pick("", self.digits(2), self.word(5))
        name = "".join(c for c in name if c.isascii()).strip("._") or "a"
        host = self.pick("mail", "post", "web") + self.pick("", self.digits(1)) + self.pick(".example.com", ".org", ".example.net")
        return name + self.pick("@", "@", "@", " @ ") + host

    def ip(self) -> str:
        return self.pick(".", ".", ".", " . ").join(str(int(x)) for x in self.r.integers(0, 256, 4))

    def card(self) -> str:
        body = self.pick("4", "5") + self.digits(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        return self.pick("", "", " ", "-", ".", "/").join((body[:4], body[4:8], body[8:12], body[12:]))

    def phone(self) -> str:
        area, mid, last = self.digits(3), self.digits(3), self.digits(4)
        return self.pick("+1 ", "+44 ", "", "", "1-") + self.pick(f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"({area}){mid} {last}", f"{area} {mid} {last}")

    def other(self) -> str:
        """What looks like personal data and is none."""
        year = 1900 + int(self.r.integers(0, 150))
        return self.pick(
            f"{year}-{self.digits(2)}-{self.digits(2)}", f"{self.digits(1)}.{self.digits(1)}.", f"v{self.digits(1)}.{self.digits(2)}.{self.digits(1)}", self.digits(int(self.r.integers(1, 9))), f"password={self.r.bytes(8).hex()}",
            "AKIA" + "".join(self.pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"{self.digits(2)}:{self.digits(2)}:{self.digits(2)}", f"{self.digits(3)},{self.digits(3)}.{self.digits(2)}", f"@{self.word()}", f"{year}-{year + 5}", f"{self.digits(3)} {self.word()} {self.digits(4)}", f"pp. {self.digits(3)}-{self.digits(3)}",
        )

    def window(self) -> tuple[str, list[tuple[str, int, int]]]:
        text, spans = "", []
        cut = int(self.r.integers(0, 20))
        while len(text) < WINDOW + cut:
            if self.r.random() < 0.25:
                kind = self.pick(*KINDS)
                value = getattr(self, kind)()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            elif self.r.random() < 0.2:
                text += self.other()
            else:
                text += self.pick(self.word(), self.word().capitalize(), self.word())
            text += self.pick(" ", " ", " ", ". ", ", ", "\n", "; ")
        spans = [(k, max(0, s - cut), min(WINDOW, e - cut)) for k, s, e in spans if e > cut and s < WINDOW + cut]
        return text[cut : cut + WINDOW], spans


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((points > 32) & (points < 127), points - 32, np.where(points < 33, SPACE, OTHER))
    wide = points > 127
    if wide.any():
        out[wide] = [LETTER if chr(p).isalpha() else OTHER for p in points[wide]]
    return out


def tags(spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for kind, s, e in spans:
        k = KINDS.index(kind)
        out[s:e] = 2 + 2 * k
        out[s] = 1 + 2 * k
    return out


# -- the model --------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Tagger:
    """Weights and passes of the BiLSTM-CRF; arrays are (time, batch, feature)."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        normal = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        h, e = HIDDEN, EMBEDDED
        self.w = {"embed": normal(CHARACTERS, e) * 3, "out": normal(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            gate = np.zeros(4 * h, np.float32)
            gate[h : 2 * h] = 1  # remember at first
            self.w |= {f"x{d}": normal(e, 4 * h), f"h{d}": normal(h, 4 * h), f"g{d}": gate}

    def lstm(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction; with ``keep`` also what the backward pass needs."""
        h = HIDDEN
        steps, batch = x.shape[:2]
        z_in = x @ self.w[f"x{d}"] + self.w[f"g{d}"]
        out, cells, gates = np.zeros((steps, batch, h), np.float32), np.zeros((steps, batch, h), np.float32), np.zeros((steps, batch, 4 * h), np.float32) if keep else None
        state = cell = np.zeros((batch, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + state @ self.w[f"h{d}"]
            ifo, g = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            cell = ifo[:, h : 2 * h] * cell + ifo[:, :h] * g
            state = ifo[:, 2 * h :] * np.tanh(cell)
            out[t], cells[t] = state, cell
            if keep:
                gates[t, :, : 3 * h], gates[t, :, 3 * h :] = ifo, g
        return out, cells, gates

    def lstm_back(self, x, out, cells, gates, grad, d: str, into: dict) -> np.ndarray:
        h = HIDDEN
        steps = list(range(len(x))) if d == "f" else list(range(len(x) - 1, -1, -1))
        dz = np.zeros_like(gates)
        d_state = d_cell = np.zeros_like(out[0])
        zero = np.zeros_like(out[0])
        for n in range(len(steps) - 1, -1, -1):
            t, before = steps[n], steps[n - 1] if n else None
            i, f, o, g = (gates[t, :, k * h : (k + 1) * h] for k in range(4))
            d_h = grad[t] + d_state
            tanh = np.tanh(cells[t])
            d_c = d_cell + d_h * o * (1 - tanh * tanh)
            old = cells[before] if n else zero
            dz[t] = np.concatenate([d_c * g * i * (1 - i), d_c * old * f * (1 - f), d_h * tanh * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
            d_cell = d_c * f
            d_state = dz[t] @ self.w[f"h{d}"].T
            if n:
                into[f"h{d}"] += out[before].T @ dz[t]
        into[f"x{d}"] += np.tensordot(x, dz, ((0, 1), (0, 1)))
        into[f"g{d}"] += dz.sum(axis=(0, 1))
        return dz @ self.w[f"x{d}"].T

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.w["embed"][ids]
        fore, back = self.lstm(x, "f", keep), self.lstm(x, "b", keep)
        both = np.concatenate([fore[0], back[0]], axis=2)
        return both @ self.w["out"] + self.w["bias"], (x, fore, back, both)

    def chain(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward sums of the CRF and the log partition function."""
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + self.w["first"]
        for t in range(1, len(scores)):
            alpha[t] = scores[t] + logsumexp(alpha[t - 1][:, :, None] + self.w["move"], 1)
        for t in range(len(scores) - 2, -1, -1):
            beta[t] = logsumexp(self.w["move"] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, logsumexp(alpha[-1], 1)

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags and its gradients."""
        steps, batch = ids.shape
        scores, (x, fore, back, both) = self.emissions(ids, True)
        alpha, beta, log_z = self.chain(scores)
        at = np.arange(batch)
        true = self.w["first"][gold[0]] + scores[0, at, gold[0]]
        into = {k: np.zeros_like(v) for k, v in self.w.items()}
        for t in range(1, steps):
            true = true + self.w["move"][gold[t - 1], gold[t]] + scores[t, at, gold[t]]
            pair = np.exp(alpha[t - 1][:, :, None] + self.w["move"] + (scores[t] + beta[t])[:, None, :] - log_z[:, None, None])
            into["move"] += pair.sum(axis=0)
            np.subtract.at(into["move"], (gold[t - 1], gold[t]), 1)
        grad = np.exp(alpha + beta - log_z[:, None])
        grad[np.arange(steps)[:, None], at, gold] -= 1
        into["first"] += grad[0].sum(axis=0)
        into["out"] += np.tensordot(both, grad, ((0, 1), (0, 1)))
        into["bias"] += grad.sum(axis=(0, 1))
        d_both = grad @ self.w["out"].T
        d_x = self.lstm_back(x, *fore, d_both[:, :, :HIDDEN], "f", into) + self.lstm_back(x, *back, d_both[:, :, HIDDEN:], "b", into)
        np.add.at(into["embed"], ids, d_x)
        return float((log_z - true).mean()), {k: v / batch for k, v in into.items()}

    def train(self, ids: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> list[float]:
        """Adam over shuffled batches; ids and gold are (time, examples)."""
        r, losses, step = np.random.default_rng(SEED), [], 0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            for some in np.array_split(r.permutation(ids.shape[1]), max(1, ids.shape[1] // BATCH)):
                loss, grads = self.gradients(ids[:, some], gold[:, some])
                losses.append(loss)
                step += 1
                scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads.values())))))
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * scale * g
                    second[k] = 0.999 * second[k] + 0.001 * (scale * g) ** 2
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (time, batch) and each one's posterior."""
        scores, _ = self.emissions(ids)
        best, back = scores[0] + self.w["first"], []
        for t in range(1, len(scores)):
            options = best[:, :, None] + self.w["move"]
            back.append(options.argmax(axis=1))
            best = options.max(axis=1) + scores[t]
        out, at = np.zeros(ids.shape, np.int64), np.arange(ids.shape[1])
        out[-1] = best.argmax(axis=1)
        for t in range(len(scores) - 2, -1, -1):
            out[t] = back[t][at, out[t + 1]]
        alpha, beta, log_z = self.chain(scores)
        sure = np.exp(alpha + beta - log_z[:, None])
        return out, np.take_along_axis(sure, out[:, :, None], 2)[:, :, 0]


def labelled(n: int, seed: int) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    sampler = Sampler(seed)
    found = [sampler.window() for _ in range(n)]
    return [t for t, _ in found], [s for _, s in found]


@lru_cache(1)
def trained(examples: int = TRAINING) -> Tagger:
    texts, spans = labelled(examples, SEED)
    tagger = Tagger()
    tagger.train(np.stack([codes(t) for t in texts], axis=1), np.stack([tags(s) for s in spans], axis=1))
    return tagger


def spans_of(tag: np.ndarray, sure: np.ndarray) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, mean posterior) of each run of one kind in a window's tags."""
    start = None
    for t in range(len(tag) + 1):
        now = int(tag[t]) if t < len(tag) else 0
        if start is not None and (now == 0 or now % 2 == 1 or (now - 1) // 2 != kind):
            yield KINDS[kind], start, t, float(sure[start:t].mean())
            start = None
        if start is None and now:
            start, kind = t, (now - 1) // 2


def windows_of(text: str) -> list[int]:
    """Starts of the windows to decode: those that hold a digit or an @."""
    half = WINDOW // 2
    found = {m.start() // half for m in HINT.finditer(text)}
    return sorted({k * half for f in found for k in (f - 1, f) if k >= 0})


def best_disjoint(spans: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """Weighted interval scheduling: the disjoint spans of greatest total weight."""
    spans = sorted(set(spans), key=lambda x: (x[3], x[2], x[1]))
    ends = [s[3] for s in spans]
    total, take = [0.0], []
    for k, (weight, _, start, _) in enumerate(spans):
        before = bisect_right(ends, start, 0, k)
        take.append(before if total[before] + weight > total[-1] else -1)
        total.append(max(total[-1], total[before] + weight))
    out, i = [], len(spans)
    while i:
        if take[i - 1] >= 0:
            out.append(spans[i - 1][1:])
            i = take[i - 1]
        else:
            i -= 1
    return [(k, s, e) for k, s, e in out[::-1]]


def apart_from(base: list[tuple[str, int, int]], rivals: list[tuple[float, str, int, int]]) -> list[tuple[float, str, int, int]]:
    """The rivals that touch no base span."""
    ordered = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in ordered], []
    for _, e in ordered:
        reach.append(max(e, reach[-1]) if reach else e)

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k == 0 or reach[k - 1] <= start

    return [r for r in rivals if free(r[2], r[3])]


def widened(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """A value does not begin or end inside a run of its kind's own characters."""
    if kind == "email":
        before, after = LOCAL_CHARS.__contains__, lambda c: c.isalnum() or c == "-"
    else:
        before = after = lambda c: "0" <= c <= "9"
    while start and before(text[start - 1]) and (kind == "email" or before(text[start])):
        start -= 1
    while end < len(text) and after(text[end]) and after(text[end - 1]):
        end += 1
    return start, end


def whole_spans(pieces: list[tuple[int, str, int, int, float, bool, bool]]) -> Iterator[tuple[str, int, int, float]]:
    """Spans of the pieces of a document: (window, kind, start, end, posterior, cut before, cut after).

    Pieces that no edge cuts are spans; those that one does are joined with the pieces of their kind
    that overlap or touch them in the windows that follow.
    """
    for kind in KINDS:
        mine = sorted(p for p in pieces if p[1] == kind)
        chain: tuple[int, int, float, int] | None = None  # start, end, posterior times characters, characters
        cut_after = False
        for _, _, start, end, sure, before, after in mine:
            if not before and not after:
                yield kind, start, end, sure
            if chain is not None and start <= chain[1] and (before or cut_after):
                chain = chain[0], max(chain[1], end), chain[2] + sure * (end - start), chain[3] + end - start
            else:
                if chain is not None:
                    yield kind, chain[0], chain[1], chain[2] / chain[3]
                chain = start, end, sure * (end - start), end - start
            cut_after = after
        if chain is not None:
            yield kind, chain[0], chain[1], chain[2] / chain[3]


def model_spans(texts: list[str], base: list[list[tuple[str, int, int]]], tagger: Tagger, batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """What the model adds to each text's base spans."""
    half = WINDOW // 2
    todo = [(i, s) for i, text in enumerate(texts) for s in windows_of(text)]
    seen = set(todo)
    pieces: list[list[tuple[int, str, int, int, float, bool, bool]]] = [[] for _ in texts]
    while todo:
        part, todo = todo[:batch], todo[batch:]
        ids = np.full((WINDOW, len(part)), PAD, np.int64)
        for j, (i, s) in enumerate(part):
            ids[: len(c), j] = (c := codes(texts[i][s : s + WINDOW]))
        tag, sure = tagger.decode(ids)
        for j in np.flatnonzero(tag.any(axis=0)).tolist():
            i, s = part[j]
            for kind, lo, hi, weight in spans_of(tag[: len(texts[i]) - s, j], sure[:, j]):
                before, after = lo == 0 and s > 0, hi == WINDOW and s + hi < len(texts[i])
                pieces[i].append((s, kind, s + lo, s + hi, weight, before, after))
                for more in [s - half] * before + [s + half] * after:
                    if (i, more) not in seen:
                        seen.add((i, more))
                        todo.append((i, more))
    out = []
    for text, mine, found in zip(texts, base, pieces, strict=True):
        rivals = []
        for kind, start, end, weight in whole_spans(found):
            start, end = widened(kind, text, start, end)
            if weight >= CERTAIN and possible(kind, text[start:end]):
                rivals.append((weight, kind, start, end))
        out.append(best_disjoint(apart_from(mine, rivals)))
    return out


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base counts by kind, base_sha256, spans (base and added), n_added."""
    tagger = trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            base = [base_spans(t) for t in texts]
            added = model_spans(texts, base, tagger)
            out = {"doc_id": pdf["doc_id"]}
            for k in KINDS:
                out[f"n_{k}"] = np.array([sum(x[0] == k for x in b) for b in base], np.int64)
            out["base_sha256"] = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            out["spans"] = [joined([*b, *a]) for b, a in zip(base, added, strict=True)]
            out["n_added"] = np.array([len(a) for a in added], np.int64)
            yield pd.DataFrame(out)

    columns = ", ".join(f"n_{k} long" for k in KINDS)
    out = docs.select(id_text(), "text").mapInPandas(run, f"doc_id string, {columns}, base_sha256 string, spans string, n_added long")
    return id_again(out, dict(docs.dtypes)["doc_id"])


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping ones the first."""
    parts, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` masked; all other columns pass as they are, a null text stays null."""
    tagger = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            originals = batch.column(at).to_pylist()
            texts = [t or "" for t in originals]
            base = [base_spans(t) for t in texts]
            added = model_spans(texts, base, tagger)
            out = [None if o is None else mask(o, [*b, *a]) for o, b, a in zip(originals, base, added, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
