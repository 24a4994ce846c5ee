"""Toxicity of texts whose words may be disguised: a noisy channel undoes digits and
symbols for letters, spaced letters and repeated letters; a classifier trained from
labels then scores the restored words.

The channel is a lattice: a disguised character stands for one of several letters, a
repeated one may be void, a gap between single letters may be void or a word's end.
Viterbi decoding finds the path that a character trigram model of the corpus, times
the channel, makes most likely. Only suspicious words are decoded; others are read as
they are. The work is linear in the text; nothing is cut off.

Null and empty texts have no words and get the score of the intercept. Every input row
gives one output row, repeated ids included. Other columns are not looked at; one that is
called as the score's column is replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import FIT_ROWS, held_out, labelled_sample, saved
from tabwright.llm.grams import GramModel, fit

#: Letters that a character may stand for.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
}
#: Log costs of the channel.
SUBSTITUTED = math.log(0.5)
VOID = math.log(0.5)
WORD_END = math.log(0.25)
#: Classes of the character model: 0 a word's end, 1 to 26 letters, 27 any other letter.
SYMBOLS = 28
#: Decoded words that a worker remembers before it starts afresh.
MEMO = 100_000

_LEADING = re.compile(r"^[^\w@$+]+")
_TRAILING = re.compile(r"\W+$")
_INNER = re.compile(r"[0-9@$!|+]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(
    r"(?<![^\W_])(?:[^\W_@$][ .*_-]|[@$][ .*_-]){3,}(?:[^\W_@$]|[@$])(?![^\W_])"
)


def symbol(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27


def trigram_model(counts: dict[tuple[int, int, int], int]) -> np.ndarray:
    """Log probabilities [a, b, c] of c after a, b: trigrams, smoothed by bigrams."""
    three = np.zeros((SYMBOLS,) * 3)
    for key, n in counts.items():
        three[key] = n
    two = three.sum(axis=0) + 0.1
    two = two / two.sum(axis=1, keepdims=True)
    return np.log((three + 2 * two[None]) / (three.sum(axis=2, keepdims=True) + 2))


class Restorer:
    """Words of a text with disguises undone."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.memo: dict[str, str] = {}

    def decode(self, observed: str) -> str:
        """The most likely words behind a string of letters, stand-ins and gaps."""
        model = self.model
        states = {(0, 0): (0.0, None)}  # last two symbols: score, path
        runs = [len(m.group()) for m in re.finditer(r"(.)\1*", observed, re.S)]
        place = [(i, n) for n in runs for i in range(n)]  # within its run, length of it
        for char, (at, run) in zip(observed, place):
            void = VOID if at and run > 2 else None
            if char in " .*_-":
                letters, void, end = "", 0.0, WORD_END
            else:
                letters, end = LEET.get(char, char), None
            cost = SUBSTITUTED if char in LEET else 0.0
            following: dict = {}
            for (a, b), (score, path) in states.items():
                row = model[a][b]
                for letter in letters:
                    c = symbol(letter)
                    total = score + cost + row[c]
                    if (b, c) not in following or following[b, c][0] < total:
                        following[b, c] = (total, (letter, path))
                if void is not None:
                    total = score + void
                    if (a, b) not in following or following[a, b][0] < total:
                        following[a, b] = (total, path)
                if end is not None and b:
                    total = score + end + row[0]
                    if (0, 0) not in following or following[0, 0][0] < total:
                        following[0, 0] = (total, (" ", path))
            states = following
        best = max(
            states.items(), key=lambda s: (s[1][0] + model[s[0][0]][s[0][1]][0], s[0])
        )
        path, out = best[1][1], []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def word(self, word: str) -> str:
        """A lower-case word without the signs around it, restored if suspicious."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = _TRAILING.sub("", _LEADING.sub("", word))
            inner = _INNER.search(found) and any(c.isalpha() for c in found)
            if inner or _TRIPLE.search(found):
                found = self.decode("".join(c for c in found if c.isalnum() or c in LEET))
            self.memo[word] = found
        return found

    def words(self, text: str) -> Iterable[str]:
        """The words without the signs around them, suspicious ones restored, and the
        words of spaced runs of letters."""
        low = text.lower()
        raw = set(low.split())
        found = set(map(self.word, raw))
        for run in _SPACED.finditer(low):
            found.update(self.decode(run.group()).split())
        return found

    def restore(self, text: str) -> str:
        """The text in lower case with each suspicious word or run replaced."""
        low = _SPACED.sub(lambda m: self.decode(m.group()), text.lower())
        parts = re.split(r"(\s+)", low)
        parts[::2] = [
            self.word(p) if _INNER.search(p) or _TRIPLE.search(p) else p for p in parts[::2]
        ]
        return "".join(parts)


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words: Counter = Counter()
        for text in batch["text"]:
            words.update(set(text.lower().split()))
        counts: Counter = Counter()
        for word, n in words.items():
            if word.isalpha():
                s = [0, 0, *map(symbol, word), 0]
                for key in zip(s, s[1:], s[2:]):
                    counts[key] += n
        yield pd.DataFrame(
            [(*k, n) for k, n in counts.items()], columns=["a", "b", "c", "n"]
        )


def character_model(docs: DataFrame) -> np.ndarray:
    """The character model of all texts; it has 28^3 entries at most."""
    texts = docs.select("text").where(F.col("text").isNotNull())
    counted = texts.mapInPandas(_trigrams, "a int, b int, c int, n long")
    rows = counted.groupBy("a", "b", "c").agg(F.sum("n").alias("n")).collect()
    return trigram_model({(r["a"], r["b"], r["c"]): r["n"] for r in rows})


def reader_of(model: np.ndarray) -> Callable[[], Callable[[str], Iterable[str]]]:
    return lambda: Restorer(model).words


def train(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS):
    """(character model, gram model): the first from all texts, the second from at most
    ``bound`` labelled rows that are not held out. ``labels`` needs (doc_id, toxic),
    ``docs`` (doc_id, text)."""
    sample = saved(labelled_sample(docs, labels, F.col("toxic"), bound), "toxic_sample")
    characters = character_model(docs)
    return characters, fit(sample, 2, reader_of(characters))


def score(
    docs: DataFrame,
    characters: np.ndarray,
    model: GramModel,
    text: str = "text",
    name: str = "score",
) -> DataFrame:
    """The frame with ``name``, the probability of label 1. The models are small and
    bounded by construction; they go to the tasks with the function."""

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, probabilities = Restorer(characters).words, model.scorer()
        for texts in batches:
            yield pd.Series(
                [float(probabilities(words(t) if t else ())[1]) for t in texts], dtype="float64"
            )

    return docs.withColumn(name, toxicity(F.col(text)))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    characters, model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), characters, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id").cast("string")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
