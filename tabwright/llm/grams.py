"""A text classifier over the beginnings and ends of words, trained from labels.

A text has a gram if one of its words has it: the word itself, its first three to six
and its last two and three characters. Grams whose presence depends on the label (by
the likelihood ratio statistic) become the features of a logistic regression, which
shares the weight among grams that always come together, as those of a group of copies.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import saved

#: Longer words are no features as a whole; their ends still are.
WHOLE = 24
MAX_GRAMS = 4_096
MIN_SUPPORT = 8
MIN_G2 = 30.0
#: Words that a task remembers before it starts afresh: 40 MB or so.
MEMO = 200_000
#: Grams that a task counts before it hands them on: 10 MB or so.
COUNTED = 50_000
#: Bytes of text that are looked up at a time: some 50 MB of arrays.
BLOCK_BYTES = 1 << 21

Reader = Callable[[str], Iterable[str]]


def words_of(text: str) -> Iterable[str]:
    return text.lower().split()


def grams_of(word: str) -> list[str]:
    found = [f"={word}"] if len(word) <= WHOLE else []
    found += [f"^{word[:n]}" for n in range(3, 7) if len(word) >= n]
    return found + [f"${word[-n:]}" for n in (2, 3) if len(word) >= n]


@dataclass(frozen=True)
class GramModel:
    """Weights of every known gram for each class, and the intercepts."""

    weights: dict[str, tuple[float, ...]]
    intercepts: tuple[float, ...]

    def scorer(self) -> Callable[[Iterable[str]], np.ndarray]:
        """Words of a text to the probabilities of the classes. One scorer serves
        many texts and remembers which of its grams a word has."""
        names = list(self.weights)
        base = np.array(self.intercepts)
        matrix = np.array([self.weights[g] for g in names]).reshape(len(names), len(base))
        memo = _Places(names)

        def score(words: Iterable[str]) -> np.ndarray:
            known = set().union(*map(memo.__getitem__, set(words)))
            margin = base + matrix[sorted(known)].sum(axis=0) if known else base
            shares = np.exp(margin - margin.max())
            return shares / shares.sum()

        return score

    def shares(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, probabilities of the classes) of many texts, read by ``words_of``, so
        many at a time as have ``BLOCK_BYTES`` (a longer text ends the block it is in)."""
        names = list(self.weights)
        base = np.array(self.intercepts)
        matrix = np.array([self.weights[g] for g in names]).reshape(len(names), len(base))
        lookups = []
        for kind, size in (("=", None), *(("^", n) for n in range(3, 7)), ("$", 2), ("$", 3)):
            own = [i for i, g in enumerate(names) if g[0] == kind and size in (None, len(g) - 1)]
            if own:
                known = pa.array([names[i][1:] for i in own], pa.string())
                ends = {"=": None, "^": (0, size), "$": (-(size or 0), None)}[kind]
                lookups.append((ends, known, np.array(own)))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_BYTES, prepend=-1))
        counts, margins = np.zeros(len(texts), np.int64), np.tile(base, (len(texts), 1))
        for start, end in zip(starts, [*starts[1:], len(texts)]):
            n, text, gram = _found(texts[start:end], lookups, len(names))
            counts[start:end] = n
            for k in range(len(base)):
                margins[start:end, k] += np.bincount(text, matrix[gram, k], minlength=end - start)
        shares = np.exp(margins - margins.max(axis=1, keepdims=True))
        return counts, shares / shares.sum(axis=1, keepdims=True)


def _found(texts: pa.Array, lookups: list, grams: int) -> tuple[np.ndarray, ...]:
    """The number of words of each text, and the (text, gram) pairs, each once. The grams
    of each different word of the texts are looked up once."""
    split = pc.utf8_split_whitespace(texts.fill_null(""))
    coded = split.flatten().dictionary_encode()
    word = coded.indices.to_numpy()
    lower = _lower(coded.dictionary)
    offsets = split.offsets.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    real = pc.not_equal(lower, "").to_numpy(zero_copy_only=False)
    counts = np.bincount(owner[real[word]], minlength=len(texts))
    places = []
    for ends, known, own in lookups:
        part = lower if ends is None else pc.utf8_slice_codeunits(lower, *ends)
        at = pc.index_in(part, value_set=known).fill_null(-1).to_numpy()
        places.append(np.where(at >= 0, own[at], -1))
    if not places:
        return counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.stack(places, axis=1)
    some = (places >= 0).any(axis=1)[word]
    owner, word = np.divmod(np.unique(owner[some] * len(lower) + word[some]), max(len(lower), 1))
    of_word = places[word]
    keys = np.unique((owner[:, None] * grams + of_word)[of_word >= 0])
    return counts, *np.divmod(keys, grams)


def _lower(words: pa.Array) -> pa.Array:
    """As ``str.lower``, which alone writes two letters for one and knows a word's end."""
    lower = pc.utf8_lower(words).cast(pa.string())
    odd = pc.match_substring_regex(words, "[\u0130\u03a3]")
    if not pc.any(odd).as_py():
        return lower
    own = [w.lower() for w in words.filter(odd).to_pylist()]
    return pc.replace_with_mask(lower, odd, pa.array(own, pa.string()))


class _Places(dict):
    """A word's grams among the known ones, by their places, remembered."""

    def __init__(self, names: Iterable[str]):
        super().__init__()
        self.kinds: dict[str, dict[str, int]] = {"=": {}, "^": {}, "$": {}}
        for place, name in enumerate(names):
            self.kinds[name[0]][name[1:]] = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        whole, first, last = self.kinds["="], self.kinds["^"], self.kinds["$"]
        size = len(word)
        found = [first.get(word[:n]) for n in range(3, min(size, 6) + 1)]
        found += [last.get(word[-n:]) for n in range(2, min(size, 3) + 1)]
        if size <= WHOLE:
            found.append(whole.get(word))
        places = tuple([p for p in found if p is not None])
        self[word] = places
        return places


def _count(reader_of: Callable[[], Reader]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader_of()
        for batch in batches:
            counts: dict[int, Counter] = {}
            for text, label in zip(batch["text"], batch["label"]):
                grams = {g for w in set(read(text)) for g in grams_of(w)}
                counts.setdefault(int(label), Counter()).update(grams)
                if sum(map(len, counts.values())) >= COUNTED:
                    yield from _rows(counts)
                    counts = {}
            yield from _rows(counts)

    return run


def _rows(counts: dict[int, Counter]) -> Iterator[pd.DataFrame]:
    for label, of_label in counts.items():
        yield pd.DataFrame({"gram": list(of_label), "label": label, "n": list(of_label.values())})


def _present(reader_of: Callable[[], Reader], vocabulary: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, known = reader_of(), frozenset(vocabulary)
        for batch in batches:
            yield pd.DataFrame(
                {
                    "label": batch["label"].astype("float64"),
                    "grams": [
                        sorted({g for w in set(read(t)) for g in grams_of(w)} & known)
                        for t in batch["text"]
                    ],
                }
            )

    return run


def likelihood_ratio(counts: Iterable[int], totals: Iterable[int]) -> float:
    """G-squared of presence against the label, from the texts of each class that
    have the gram and all of each class."""
    counts, totals = list(counts), list(totals)
    share = sum(counts) / sum(totals)
    total = 0.0
    for k, n in zip(counts, totals):
        for seen, expected in ((k, n * share), (n - k, n * (1 - share))):
            if seen:
                total += seen * math.log(seen / expected)
    return 2 * total


def fit(sample: DataFrame, classes: int, reader_of: Callable[[], Reader]) -> GramModel:
    """Train on a bounded sample (text, label), which must be a written table.
    ``reader_of`` makes the function that gives the words of a text. Without rows of
    two classes the model knows the class shares only; no rows: all classes alike."""
    totals = dict(sample.groupBy("label").count().collect())
    sizes = [totals.get(k, 0) for k in range(classes)]
    rows = sum(sizes)
    prior = tuple(math.log((n + 1) / (rows + classes)) for n in sizes)
    if sum(n > 0 for n in sizes) < 2:
        return GramModel({}, prior)
    counted = sample.select("text", "label").mapInPandas(
        _count(reader_of), "gram string, label int, n long"
    )
    wide = counted.groupBy("gram").agg(
        *(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(classes))
    )
    both = sum((F.col(f"n{k}") for k in range(classes)), F.lit(0))
    share = both / rows
    g2 = F.lit(0.0)
    for k, n in enumerate(sizes):
        for seen, expected in ((F.col(f"n{k}"), n * share), (n - F.col(f"n{k}"), n * (1 - share))):
            g2 = g2 + F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    top = (
        wide.where((both >= MIN_SUPPORT) & (both < rows))
        .withColumn("g2", 2 * g2)
        .where(F.col("g2") >= MIN_G2)
        .orderBy(F.desc("g2"), "gram")
        .limit(MAX_GRAMS)
    )
    vocabulary = [r["gram"] for r in top.select("gram").collect()]
    if not vocabulary:
        return GramModel({}, prior)
    present = sample.select("text", "label").mapInPandas(
        _present(reader_of, vocabulary), "label double, grams array<string>"
    )
    vectors = CountVectorizerModel.from_vocabulary(
        vocabulary, inputCol="grams", outputCol="features", binary=True
    ).transform(present)
    vectors = saved(vectors.select("label", "features"), "grams")
    model = LogisticRegression(
        family="multinomial", regParam=1e-4, standardization=False, maxIter=60
    ).fit(vectors)
    matrix, base = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    have = len(base)  # classes above the largest label seen have no row
    bases = [*base, *(-30.0 for _ in range(classes - have))]
    return GramModel(
        {
            g: tuple([*map(float, matrix[:, i]), *(0.0 for _ in range(classes - have))])
            for i, g in enumerate(vocabulary)
        },
        tuple(map(float, bases)),
    )
