"""Fences that junk in their own group does not move."""

import random

from parlance.llm import quality_rules
from tests.llm.fixtures import SCHEMA


def prose(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 7))) for _ in range(n)]


def test_junk_leaves_its_group(spark):
    r = random.Random(3)
    clean = [(i, " ".join(prose(r, 120)), "en", "s", 0) for i in range(450)]
    symbols = [(500 + i, " ".join(w + r.choice("#*$%&") * 3 for w in prose(r, 120)), "en", "s", 0) for i in range(50)]
    long = [(601 + i, " ".join(w * 2 for w in prose(r, 120)), "en", "s", 0) for i in range(6)]
    again = prose(r, 24)
    repeated = [(610 + i, " ".join(again + prose(r, 60 - i) + again), "en", "s", 0) for i in range(6)]
    lines = [(620 + i, "\n".join(["x"] * (60 + i) + [" ".join(prose(r, 90))]), "en", "s2", 0) for i in range(5)]
    other = [(700 + i, " ".join(prose(r, 120)), "en", "s2", 0) for i in range(200)]
    rows = clean + symbols + long + repeated + lines + other
    got = {x["doc_id"]: x for x in quality_rules.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[d]["base_failed"] for d, *_ in clean + symbols + long + repeated + other)
    assert {d for d, x in got.items() if x["kept"]} == {d for d, *_ in clean + other}
    counts = quality_rules.rejects(spark.createDataFrame(rows, SCHEMA)).first()
    assert counts["symbol_share"] == 50 and counts["word_length"] >= 6 and counts["repeat_share"] >= 6


def test_sources_have_their_own_fences(spark):
    """Two sources with other habits in every ratio: what is usual in the one is junk in the other."""
    r = random.Random(5)

    def text(habit: int) -> str:
        # the second source writes long words with symbols, and repeats lines and phrases
        words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 7) * (1 + 2 * habit))) for _ in range(100)]
        words = [w + "#" * (habit * r.randint(3, 5)) for w in words]
        phrase = " ".join(words[: 3 + r.randrange(4)])
        return "\n".join([" ".join(words)] + [phrase] * (habit * r.randint(9, 11)))

    rows = [(1000 * h + i, text(h), "en", f"s{h}", 0) for h in (0, 1) for i in range(100)]
    swapped = [(5000 + 1000 * h + i, text(1 - h), "en", f"s{h}", 0) for h in (0, 1) for i in range(8)]
    docs = spark.createDataFrame(rows + swapped, SCHEMA)
    measured = quality_rules.measured(docs)
    limits = {x["source"]: x for x in quality_rules.fences(measured).collect()}
    for name in quality_rules.RATIOS:
        bounds = [(limits[s][f"{name}_low"], limits[s][f"{name}_high"]) for s in ("s0", "s1")]
        assert bounds[0] != bounds[1], name
    kept = {x["doc_id"] for x in quality_rules.assess(docs).where("kept").collect()}
    assert not kept & {d for d, *_ in swapped if d < 6000}
    assert len(kept & {d for d, *_ in rows}) >= 190


def test_one_stray_value_does_not_close_a_gap(spark):
    r = random.Random(6)
    clean = [(i, " ".join(prose(r, 100)), "en", "s", 0) for i in range(1800)]
    junk = [(3000 + i, " ".join(w + "##" for w in prose(r, 100)), "en", "s", 0) for i in range(200)]
    stray = [(4000 + k, " ".join(prose(r, 100)) + " " + "#" * n, "en", "s", 0) for k, n in enumerate((4, 9, 20, 45, 90))]
    kept = {x["doc_id"] for x in quality_rules.assess(spark.createDataFrame(clean + junk + stray, SCHEMA)).where("kept").collect()}
    assert kept >= {d for d, *_ in clean} and not kept & {d for d, *_ in junk}
