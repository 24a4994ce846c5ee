"""Quality rules, mixing rates, toxicity scores and the pipeline against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tabwright.llm import mixing, queries, rules, simhash
from tabwright.llm.common import saved, table
from test_similar import similar_pairs
from tests_llm_help import brute_components, texts_frame

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
LARGE = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# The base patterns of the secret scan's contract.
ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, repeated = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        repeated += line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, repeated, len(covered), failed


def check_base(rows, texts):
    got = [(r["doc_id"], *(r[c] for c in BASE)) for r in rows]
    assert Counter(got) == Counter((i, *base(t)) for i, t in texts)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_rules_over_given_documents(spark):
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = queries.quality_rules(spark, SF).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in texts])
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] == 0) for r in rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    judged = [(r["kept"], quality.get(r["doc_id"])) for r in held if quality.get(r["doc_id"]) is not None]
    print("quality accuracy", np.mean([k == (q == 1) for k, q in judged]), len(judged))
    assert np.mean([k for k, q in judged if q == 1]) > np.mean([k for k, q in judged if q == 0])


def test_quality_rules_of_odd_texts(spark):
    docs, texts = texts_frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = rules.judged(docs, none).collect()
    check_base(rows, texts)
    assert {r["rule"] for r in rows} == {0}


def members_of(spark, posteriors, tokens):
    rows = [(i, int(t), p.tolist()) for i, (t, p) in enumerate(zip(tokens, posteriors))]
    return spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")


def rates_of(members, fit, floor=None):
    found = {r["doc_id"]: r["rate"] for r in mixing.with_rate(members, fit, floor).collect()}
    return np.array([found[i] for i in range(len(found))])


def test_mixing_meets_reachable_targets(spark):
    rng = np.random.default_rng(3)
    posteriors = rng.dirichlet([0.4, 0.4, 0.4], 3_000)
    tokens = rng.integers(0, 500, len(posteriors))
    members = members_of(spark, posteriors, tokens)
    for targets in ((0.6, 0.3, 0.1), mixing.TARGETS):
        fit = mixing.fit_rates(members, targets)
        rate = rates_of(members, fit)
        assert (rate >= 0).all() and fit.gap < mixing.TOLERANCE
        expected = (rate * tokens) @ posteriors
        assert expected == pytest.approx(fit.totals, rel=1e-9)
        assert expected / tokens.sum() == pytest.approx(targets, rel=1e-3)


def coordinate_descent(posteriors, tokens, targets, floors):
    """An independent solver of the same least squares, one document at a time."""
    a = posteriors.T * (tokens / tokens.sum()) / np.array(targets)[:, None]
    rate, gap = np.ones(len(tokens)), a.sum(axis=1) - 1
    for _ in range(2_000):
        for i in np.flatnonzero(tokens):
            new = max(floors[i], rate[i] - a[:, i] @ gap / (a[:, i] @ a[:, i]))
            gap += a[:, i] * (new - rate[i])
            rate[i] = new
    return (rate * tokens) @ posteriors, 0.5 * gap @ gap


def test_mixing_is_the_least_squares_optimum_where_targets_cannot_be_met(spark):
    rng = np.random.default_rng(4)
    posteriors = 0.2 + 0.4 * rng.dirichlet([1, 1, 1], 12)  # no domain is ever pure
    tokens = np.array([0, *rng.integers(20, 50, 11)])
    members, targets = members_of(spark, posteriors, tokens), (0.9, 0.08, 0.02)
    for keep_first in (True,):
        floor = mixing.least_rate(keep_first)
        fit = mixing.fit_rates(members, targets, floor=floor)
        floors = (posteriors.argmax(axis=1) == 0) * float(keep_first)
        totals, objective = coordinate_descent(posteriors, tokens, targets, floors)
        rate = rates_of(members, fit, floor)
        assert (rate >= floors).all() and fit.gap > 0.01
        assert fit.totals == pytest.approx(totals, rel=1e-3)
        miss = fit.totals / tokens.sum() / targets - 1
        assert 0.5 * miss @ miss == pytest.approx(objective, rel=1e-4)


def test_a_domain_without_tokens_is_left_out(spark):
    posteriors = np.array([[1.0, 0.0, 0.0], [0.5, 0.5, 0.0], [0.0, 1.0, 0.0]])
    fit = mixing.fit_rates(members_of(spark, posteriors, np.array([5, 5, 5])), (0.5, 0.3, 0.2))
    assert fit.gap < mixing.TOLERANCE and not fit.reachable[2]
    empty = mixing.fit_rates(members_of(spark, posteriors, np.zeros(3)), (0.5, 0.3, 0.2))
    assert empty.steps == [] and empty.gap == 0


def test_registered_targets_are_met(spark):
    rows = queries.mixing_rates(spark, SF).collect()
    shares = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    assert shares.sum(axis=1) == pytest.approx(1)
    taken = np.array([r["rate"] * r["tokens"] for r in rows]) @ shares
    tokens = sum(r["tokens"] for r in rows)
    assert taken / tokens == pytest.approx(mixing.TARGETS, rel=1e-3)
    assert {r["target_gap"] < mixing.TOLERANCE for r in rows} == {True}


def test_mixing_of_odd_texts(spark):
    docs, texts = texts_frame(spark)
    labels = spark.createDataFrame([(10, 1, 0), (12, 0, 0), (14, None, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mixed(docs, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts)
    assert all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    assert mixing.mixed(docs.limit(0), labels).count() == 0


def test_toxicity_on_held_out_labels(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{LARGE}/labels.parquet").to_pylist()}
    rows = queries.toxicity_scores(spark, LARGE).collect()
    assert len(rows) == pq.read_metadata(f"{LARGE}/documents.parquet").num_rows
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    bad, good = [[s for s, y in held if y == v] for v in (1, 0)]
    wins = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    right = np.mean([(s >= 0.5) == y for s, y in held])
    print("toxicity auc", wins, "accuracy", right, len(held))
    assert wins >= 0.9 and right >= 0.9


def test_pipeline_stage_by_stage(spark):
    labels = {r["doc_id"]: r for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    clean = {i for i, r in labels.items() if r["toxic"] == 0 and r["quality"] == 1}
    docs = table(spark, SMALL, "documents")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        docs = saved(stage(spark, docs, SMALL), name)
        if name == "packing":
            break
        after = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert docs.columns == columns
        if name == "toxicity":
            left = {i for i, _ in before} - {i for i, _ in after}
            assert not clean & left
        elif name == "near_duplicates":
            sets = [set(simhash.shingles(t, 5).tolist()) for _, t in before]
            whole = [simhash.words_of(t) for _, t in before]
            same = [(i, j) for i in range(len(whole)) for j in range(i) if whole[i] == whole[j]]
            roots = brute_components([*similar_pairs(sets), *same])
            groups = {roots.get(i, i) for i in range(len(before))}
            assert len(groups) == len(after)
        elif name == "secrets":
            assert sorted(i for i, _ in before) == sorted(i for i, _ in after)
            for _, text in after:
                found = ASSIGN.findall(text or "")
                assert not any(len(x) >= 8 for x in found), text
                assert not ACCESS.search(text or "") and not HEX.search(text or "")
        else:
            assert {i for i, _ in after} <= {i for i, _ in before}
            assert clean & {i for i, _ in before} <= {i for i, _ in after}
    rows = docs.collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in pieces.values():
        spans.sort()
        ends = np.cumsum([n for _, n in spans])
        assert [o for o, _ in spans] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert {r["doc_id"] for r in rows} == {i for i, _ in after}
