"""Ids that are null or repeated in the pipeline's copies stage."""

import corpus_pipeline


def test_one_row_of_each_group_is_kept(spark):
    words = [[f"{x}{i}" for i in range(80)] for x in "abcd"]
    a, b, c, d = map(" ".join, words)
    near = " ".join([*words[1][:79], "changed"])
    rows = [
        (1, a, "x"), (1, a, "x"), (1, a, "y"),  # equal rows, and another of the same id
        (2, a, "x"), (2, b, "x"), (3, near, "x"),  # 2 has two texts: one goes, one stays
        (None, c, "x"), (None, c, "x"), (None, c.upper(), "x"),
        (None, d, "x"), (7, d, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"].lower()) for r in left.collect()), key=repr)
    assert found == sorted([(1, a), (2, b), (None, c), (7, d)], key=repr)
