"""Small documents for the tests, and plain versions of what operators compute."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; tables may have columns of these names.
CLASHES = ("n", "set_id", "component", "component_id", "gram", "slot", "shard", "copies", "row", "place", "text_key",
           "words", "lines", "code", "turns", "n_tokens", "domain", "start", "hash", "gone", "met", "u", "v", "_nth")


def frame(spark, rows):
    """Documents of (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], *(r[2:] or ("en", "src1")), len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC)


def with_clashes(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdeghilmnorst") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows(seed: int = 1):
    """Nulls, empty and very long texts, ties, repeated rows."""
    r = random.Random(seed)
    text = sentence(r, 60)
    very_long = "\n".join(sentence(r, 50) for _ in range(800))
    return [(1, None), (2, ""), (3, " \n\t \n"), (4, text), (5, text), (5, text), (None, text + " more"), (None, None),
            (6, very_long), (7, very_long + " end"), (8, "one two"), (9, "One  TWO"), (10, "."), (11, "é" * 5000),
            (12, text.replace(" ", "\n")), (13, text, None, None), (14, sentence(r, 80), "fr", None)]


def shingle_set(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def plain_components(rows, percent=75):
    """{row number: (set size, smallest id of the component)} by comparing all pairs that share a shingle."""
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if common and 100 * common >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = least.setdefault(find(i), [])
        if r[0] is not None:
            ids.append(r[0])
    return [(r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)]
