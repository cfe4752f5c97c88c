"""Small documents with everything awkward in them, and the definitions that results are held against."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, chunk string, rep int, n string, rate double, copies string, p_low string, kind int, hash int"
EXTRA = ("x", 1, "y", 0.5, "z", "w", 3, 4)


def prose(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice(["an", "er", "tho", "è", "li", "so", "Ra", "un"]) for _ in range(1 + rng.randrange(3))) + ("" if rng.random() < 0.9 else rng.choice([".", ",", "\n"])) for _ in range(n))


def texts(seed=5):
    rng = random.Random(seed)
    base, passage = prose(rng, 240), prose(rng, 70).replace("\n", " ")
    out = [prose(rng, rng.randrange(5, 200)) for _ in range(25)]
    words = base.split(" ")
    for k in range(12):  # near copies, some of them just about
        w = list(words)
        for _ in range(k):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    out += [base, base, base]
    out += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(6)]
    out += ["a b c d", "A  b\tc d", "one", "\n\n", " ", "same line\n" * 9, "é€" * 40, "x" * 30_000, prose(rng, 6_000), "\x01\x00\x02", "a b c d e " * 60]
    return out


def rows(seed=5):
    """(doc_id, text, ...): ids out of order, a null and an empty text, a repeated row, two texts of one id, a null id."""
    found = [(7 * i % 101, t) for i, t in enumerate(texts(seed))]
    found += [(200, None), (201, ""), (202, "a repeated row " * 20), (202, "a repeated row " * 20), (203, "first text of an id " * 12), (203, "second text of an id " * 12), (None, "a text without an id " * 15)]
    return [(*r, *EXTRA) for r in found]


def frame(spark, seed=5):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
