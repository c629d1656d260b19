"""Small frames with awkward rows, and plain versions of the operators."""

import re

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORDS.findall((text or "").encode().lower())


def grams(text, k):
    w = words(text)
    return frozenset({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else ())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


#: Columns named like those that the operators make inside.
CLASH = ["blob", "flagged", "body", "row", "score", "matches", "kinds", "leaks", "gone", "id", "cls", "key", "bucket", "n_tokens", "weight", "draw_pass", "held_out"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (6, long, None), (7, long + " end", "a"), (None, "no id here at all", "a"), (8, "Ünï cödé 🙂 text", "c")]
    df = documents(spark, rows)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))
