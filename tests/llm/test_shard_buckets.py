"""Rows without an id are scattered over the buckets."""

from collections import Counter

from tabwright.llm import sharding


def test_rows_without_an_id_are_spread_and_kept(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 2_000)
    rows = [(None if i % 3 else i, f"text {i} " + "x" * (i % 50)) for i in range(900)]
    rows += [(None, None), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = sharding.fresh_path(spark, "shards")
    sharding.write_shards(docs, path, 8, size=sharding.size_of("text"), bucket_bytes=2_000)
    back = sharding.read_shards(spark, path, docs.schema).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(rows)
    sizes = Counter(r["_shard"] for r in back)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    unnamed = Counter(r["_shard"] for r in back if r["doc_id"] is None)
    assert min(unnamed.values()) > 0.5 * max(unnamed.values())
