"""Counts and digests of the base kinds of secrets against a plain scan."""

import hashlib
import random
import re

from tabwright.llm import ledger

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
PARTS = [
    "Password", "secret", "api_key", "APIKEY", " ", ":", "=", '"', "'", "abcdefgh1", "x", "é",
    "AKIA", "ABCDEFGHIJKL", "deadbeef" * 4, "\n", "\U0001F600", "-----BEGIN PRIVATE KEY-----",
]


def plain(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m.group()) >= 32]
    named = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    counts = [sum(k == kind for _, k, _ in found) for kind in range(3)]
    return (*counts, hashlib.sha256(named.encode()).hexdigest())


def test_base_columns(spark):
    rng = random.Random(3)
    rows = [(1, "0" * 40), (2, "AKIA" + "B" * 16), (3, "token=abcdefgh"), (4, None), (None, "")]
    rows += [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 20)))) for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ledger.digest_rows(ledger.scan_corpus(docs)).collect()
    got = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found]
    assert sorted(got, key=repr) == sorted(((i, *plain(t)) for i, t in rows), key=repr)
