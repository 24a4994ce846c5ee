"""Queries over the smallest given tables next to plain versions of their contracts."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tabwright.llm import queries

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
# The rules of the contract.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def given(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def test_neighbours_against_all_distances(spark):
    table = given(SF, "embeddings")
    vector = next(c for c, v in table[0].items() if isinstance(v, list))
    rows = [
        (r["vec_id"], np.array(r[vector], float))
        for r in table
        if r[vector] and None not in r[vector] and np.isfinite(r[vector]).all() and any(r[vector])
    ]
    ids, all_vectors = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = defaultdict(list)
    for r in queries.nearest_neighbours(spark, SF).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = [(i, v) for i, v in rows if i % 100 == 0]
    assert set(found) == {i for i, _ in asked}
    hits = wanted = 0
    for i, v in asked:
        distance = np.sqrt(((all_vectors - v) ** 2).sum(axis=1))
        distance[ids == i] = np.inf
        best = np.lexsort((ids, distance))[: min(10, len(ids) - 1)]
        got = sorted(found[i])
        assert [r for r, _, _ in got] == list(range(1, len(best) + 1))
        assert [(s, j) for _, j, s in got] == sorted((s, j) for _, j, s in got)
        place = dict(zip(ids.tolist(), distance.tolist()))
        assert all(s == pytest.approx(place[j], rel=1e-12) for _, j, s in got)
        hits += len({j for _, j, _ in got} & set(ids[best].tolist()))
        wanted += len(best)
    print("recall", hits / wanted)
    assert hits >= 0.9 * wanted


def test_shards_hold_every_row_once_and_are_even(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in given(SMALL, "documents")]
    rows = queries.shards(spark, SMALL).collect()
    expected = Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert {r["law"] for r in rows} == {"rows"} and set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_url_parts_and_rules(spark):
    pages = {r["page_id"]: r["url"] for r in given(SMALL, "pages")}
    rows = queries.url_verdicts(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        url = pages[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        assert (r["host"], r["path"]) == (host, path)
        fits = [
            rule
            for rule in RULES
            if f".{host}".endswith("." + rule.split("/", 1)[0])
            and path.startswith("/" + rule.split("/", 1)[1])
        ]
        rule = max(fits, key=len, default=None)
        assert r["rule"] == rule and r["verdict"] in ("allow", "block")
        assert rule is None or r["verdict"] == RULES[rule]
