"""Small tables with everything that goes wrong: nulls, empty and long texts, ties, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    syllables = ["the", "an", "re", "ion", "sta", "mé", "für", "lo", "qui", "ent", "ha", "ñor"]
    known = ["".join(random.Random(k).choices(syllables, k=1 + k % 4)) + str(k % 7) * (k % 11 == 0) for k in range(vocabulary)]
    return r.choices(known, k=n)


def prose(r: random.Random, n: int) -> str:
    out = []
    for k, w in enumerate(words(r, n)):
        out.append(w.capitalize() if k % 9 == 0 else w)
        out.append(".\n" if k % 27 == 26 else " ")
    return "".join(out).strip()


def edited(r: random.Random, text: str, share: float) -> str:
    return " ".join(w if r.random() > share else "edit" + str(r.randrange(99)) for w in text.split(" "))


def documents(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    passage, line = prose(r, 60), "All rights reserved everywhere."
    for i in range(60):
        body = prose(r, r.choice([3, 20, 80, 200, 400]))
        if i % 5 == 0:
            body = f"{body} {passage} {prose(r, 30)}"
        if i % 3 == 0:
            body = f"{body}\n{line}"
        rows.append((i, body, r.choice(["en", "fr", None]), f"s{i % 14}" if i % 13 else None, len(body)))
    base = rows[7][1] + " " + prose(r, 200)
    rows += [(100 + k, edited(r, base, s), "en", "s1", 1) for k, s in enumerate([0, 0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2])]
    rows += [(200 + k, t, "en", "s2", None) for k, t in enumerate([None, "", " \n\t ", "one", "two words", "A B c\x1cd 　 e", "x" * 3000, "ha " * 3000, "| # $ %\n" * 30, prose(r, 9000)])]
    rows += [(None, "a row without an id and some words", None, None, None), (None, None, None, None, None)]
    rows += [rows[3], rows[3], rows[60]]  # repeated rows
    rows += [(400, rows[61][1], None, None, 1), (400, prose(r, 90), "en", "s1", 1), (400, None, "en", "s1", 1)]  # one id, several texts
    return rows


PERSONAL = [
    "write to jo.doe+x@mail.example.com, or a@b.c_d@e.fg, not to @home or x@y",
    "hosts 10.0.0.1, 1.2.3.4.5.6.7.8 and 300.1.2.3; version 1.2.3, 0001.2.3.255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 5555555555554444",
    "ring +1 (555) 123-4567 or +44.20.7946.0958 but not +123 or +1",
    "+1 555-3296 4111111111111111 and call (555) 123-4567 soon, or 555-987-6543 instead",
]
