"""Small tables with the awkward cases, and plain-Python versions of the definitions."""

import random
import re
from collections import Counter

import pandas as pd

SMALL = "/root/testdata/sf0.001"
CLASHING = "row string, class string, size string, shard string, c0 string, kept string, mix string, key string"


def prose(seed, words, vocabulary=400):
    draw = random.Random(seed)
    known = [
        "".join(draw.choice("bcdfghklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 3)))
        for _ in range(vocabulary)
    ]
    out = [draw.choice(known) for _ in range(words)]
    for i in range(7, words, 9):
        out[i] += "."
    return " ".join(out).capitalize()


def documents(spark, rows, extra=True):
    """(doc_id, text[, lang, source]) with columns whose names the operators use inside."""
    full = [(*r, *("en", "s0")[len(r) - 2 :]) for r in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(*r, None if r[1] is None else len(r[1])) for r in full]
    if extra:
        kinds += ", " + CLASHING
        full = [(*r, *"abcdefgh") for r in full]
    return spark.createDataFrame(full, kinds)


def awkward():
    """Null and empty texts, a null id, repeated rows, copies, a very long text, few words."""
    base, long = prose(1, 120), prose(2, 30_000, 3000)
    near = base.replace(base.split()[60], "other", 1)
    return [
        (1, base), (2, base), (2, base), (3, near), (None, base), (4, None), (5, ""), (6, " \n\t "),
        (7, "two words"), (8, "Two  WORDS"), (9, long), (10, long + " end"), (11, prose(3, 200)),
        (None, None), (12, prose(4, 90, 60), None, None), (13, "É ß 日本 語"),
    ]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    found = words(low(text))
    size = min(size, len(found))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if size else set()


def components(texts, size, percent):
    """Least number reachable for each text, numbered from 0."""
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def repeated_words(text, window=8):
    found = words(text)
    tally = Counter(tuple(found[i : i + window]) for i in range(len(found) - window + 1))
    marked = set()
    for i in range(len(found) - window + 1):
        if tally[tuple(found[i : i + window])] > 1:
            marked |= set(range(i, i + window))
    return len(marked)


def table(name):
    return pd.read_parquet(f"{SMALL}/{name}.parquet")
