"""Small documents with every awkward case, and brute force for what several tests need."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, target string, __id string"


def documents(spark, rows):
    """rows: (doc_id, text[, source]); other columns have names that clash with results."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None, "x", "y", "z", "w") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, "a b c d"), (7, "A  b\nc\td"), (8, "x" * 5000),
    (9, "é ü 漢字 emoji 😀 end"), (10, "word " * 3000), (11, " no break"), (12, "a\x0bb\x0cc\rd"),
]


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def shingles(text, width=5):
    found = (text or "").encode().lower().split()
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def near_components(rows):
    """doc_id -> smallest doc_id reachable over links of similarity 0.75, by comparing everything."""
    ids = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = root(i), root(j)
                if p != q:
                    if ids[p] < ids[q]:
                        p, q = q, p
                    up[p] = q
    return {ids[i]: ids[root(i)] for i in range(len(rows))}
