"""Near-dedup's third round gives the same components whatever the size of its tiles."""

from __future__ import annotations

import random

import pytest

from parlance.llm import near_dedup


def family() -> list[tuple[int, str | None]]:
    """Versions of one text with up to 22 words replaced: similarities on both sides of the limit."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows: list[tuple[int, str | None]] = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.randint(0, 22)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return [*rows, (1000, None), (1001, ""), (1002, "one"), (1003, "one")]


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    def shingles(text: str | None) -> set[tuple[str, ...]]:
        words = (text or "").split()
        return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:], strict=False))

    sets = {i: shingles(text) for i, text in rows}
    component = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((component[i], component[j]))
                component = {k: a if c == b else c for k, c in component.items()}
    return component


@pytest.mark.parametrize("limits", [{}, {"tile": 7}, {"elements": 500}])
def test_components_for_any_tile(spark, monkeypatch, limits):
    rows, compared = family(), near_dedup.compared
    monkeypatch.setattr(near_dedup, "compared", lambda members, sets, percent: compared(members, sets, percent, **limits))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert found == brute_force(rows)


def test_tiles_of_a_large_bucket(spark):
    """Few strays in a large bucket do not multiply its members; every stray meets every member once."""
    n, strays, tile = 600, 6, 20
    rows = [(7, i, 30, i if i < strays else 100, i < strays, n, 30 * n, strays, 30 * strays) for i in range(n)]
    members = spark.createDataFrame(rows, "bucket long, node long, n int, component long, stray boolean, members long, elements long, strays long, stray_elements long")
    found = near_dedup.in_tiles(members, tile, 1 << 20).collect()
    assert len(found) <= n + strays * n // tile
    asked = {(x.row, x.column, x.node) for x in found if x.asks}
    met = sorted((a, y.node) for row, column, a in asked for y in found if y.answers and (y.row, y.column) == (row, column))
    assert met == [(a, b) for a in range(strays) for b in range(n)]
