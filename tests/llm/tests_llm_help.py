"""Small inputs and plain versions that several tests use."""

import random


def brute_components(edges):
    """Node to the smallest node that it can reach, loops left out."""
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return {x: find(x) for x in root}


def texts_frame(spark):
    """Documents with nulls, empty texts, ties, repeated rows, a long text, and extra
    columns whose names operators use inside."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)] + ["The", "of", "Straße", "naïve"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[0], texts[0], None, "", "  \n\t ", "one", "One", "a\n\nb", "x " * 30_000]
    rows = list(enumerate(texts, 10)) + [(None, texts[1]), (10, texts[0]), (11, "other text")]
    extra = [(i, t, 1, "fp", 2) for i, t in rows]
    schema = "doc_id long, text string, fp int, bucket string, _rank int"
    return spark.createDataFrame(extra, schema), rows
