"""Whole texts to token ids with files of the tokenizers library, word by word.

A block of texts is encoded word by word, each different word once; a text is then a
join of its words' ids, as packed 32-bit numbers. That is exact only where the tokenizer
never joins characters across the cut, so the cuts are those of its own rules, and a
text (or word) that leaves them is encoded as it is. The words of a block of texts are
told apart as one column, each different one is cut into its letters and its signs, and
the different pieces that are not remembered go to the vocabulary's own algorithm together;
the texts are then gathered from their ids. Other words are remembered, and those that are
not are encoded as one text whose ids say where a word begins or ends. What a worker
remembers is bounded by bytes: it forgets the words that it has not met since it last did
so, and the pieces that the fewest blocks had.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a worker remembers, and what a word takes besides its letters and ids.
MEMO_BYTES, WORD_BYTES = 96 << 20, 190
#: The same of pieces, which are remembered as columns.
PIECE_BYTES, PIECE_ROW = 16 << 20, 20
#: Characters of the texts, and words, that are looked at together.
BLOCK_CHARS, BLOCK_WORDS = 1 << 22, 2_048
#: Letters (but the one whose lower case is two characters), then signs.
_PUNCTUATION = re.compile(r"""([^\W\d_\u0130]+)([!-&(-/:-@[-`{-~]+)""")
#: Space inside or at the end of a longer gap: there a cut would change the ids. Only
#: a text where a gap goes on behind a space can have one.
_GAP_GOES_ON = re.compile(r" (?:\s|\Z)")
_INSIDE_GAP = re.compile(r"\s (?:\s|\Z)")
_GAP_OR_MARK = re.compile(r"[\s\0]")

#: Letters that are a token's own and have one lower case of one letter (raised digits and
#: fractions, which are word characters but no digits of ``re``, are none).
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"( ?)([{_LETTERS}]+)")
#: A word of such letters, then perhaps signs; and the same with a NUL before it or none.
_SIMPLE = f"^(?P<stem>[{_LETTERS}]+)(?P<signs>[!-&(-/:-@\\[-`{{-~]*)$"
_SIMPLE_BARE = _SIMPLE.replace("<stem>", "<stem>\\x00?")
_SPACES = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A space inside or at the end of a longer gap, for RE2.
_SPACE_IN_GAP = f"{_SPACES} (?:{_SPACES}|$)"
#: A line break that does not stand alone between other characters.
_LINE_IN_GAP = f"{_SPACES}\n|\n{_SPACES}|^\n|\n$"


@cache
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is
    printable Latin-1, else the next unused character from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    table = {b: chr(b) for b in printable}
    return table | {b: chr(256 + i) for i, b in enumerate(others)}


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _uncached(path: str):
    """The file's model without its cache, which only costs time where each piece comes
    once; none if it is of another type or has more settings."""
    from tokenizers import models

    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    usual = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None}
    off = ("fuse_unk", "byte_fallback", "ignore_merges")
    if any(model.get(k) != v for k, v in usual.items()) or any(map(model.get, off)):
        return None
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    end = model.get("end_of_word_suffix")
    more = {} if end is None else {"end_of_word_suffix": end}
    return models.BPE(model["vocab"], merges, cache_capacity=0, **more)


def _gathered(parts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """The parts of a row, which have these sizes, in another order, and their ends."""
    many = sizes[order]
    ends = np.cumsum(many)
    shift = (np.cumsum(sizes) - sizes)[order] - (ends - many)
    return parts[np.repeat(shift, many) + np.arange(many.sum())], ends


class Words(dict):
    """Word to packed ids. ``lower``: the tokenizer drops gaps and lower-cases. Else a
    word's ids are those behind a space, and the key of one without has a NUL before
    it. Plain words go to the vocabulary's own algorithm without the steps around it,
    which have nothing to do for them."""

    def __init__(self, path: str, lower: bool):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        #: The vocabulary's algorithm alone, over spelled pieces between spaces.
        self.spelled = Tokenizer(_uncached(path) or self.tokenizer.model)
        self.spelled.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.before: dict[str, bytes] = {}  # what was remembered until it was too much
        self.held = 0
        #: Pieces that are remembered, their ids, how many each has, and in how many blocks
        #: each was met.
        self.known = pa.array([], pa.large_string())
        self.known_ids, self.known_sizes = np.zeros(0, "<u4"), np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int32)
        space = self.letters[ord(" ")]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Ids that end a word (lower-cased words have an end mark) or begin one.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.long = np.zeros(len(self.edge), np.int64)  # letters of each, without end marks
        for token, i in vocabulary.items():
            self.edge[i] = token.endswith("</w>") if lower else token.startswith(space)
            self.long[i] = len(token) - 4 * (lower and token.endswith("</w>"))

    def encode(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, word: str) -> bytes:
        """Ids of a word with its own gap."""
        if _PLAIN.fullmatch(word) and not (self.lower and word[0] == " "):
            word = word.lower() if self.lower else word
            spelled = word.encode().decode("latin-1").translate(self.letters)
            return packed([t.id for t in self.model.tokenize(spelled)])
        return self.encode(word)

    def __missing__(self, key: str) -> bytes:
        """Ids of a word not remembered. A word made of known parts is remembered only
        if its stem was met before, a line break with its two words never: most of
        them are met once."""
        known_before = self.before.get(key)
        if known_before is not None:
            self._remember([key], [known_before])
            return known_before
        bare = key[:1] == "\0" and not self.lower
        word = key[1:] if bare else key
        lines = word.split("\n")
        if len(lines) > 1 and self.__parted(lines):
            if self.lower:
                return b"".join([self[x] for x in lines])
            first, *rest = lines
            head = self["\0" + first] if bare else self[first]
            return head + b"".join([self["\0\n"] + self["\0" + x] for x in rest])
        cut = _PUNCTUATION.fullmatch(word)
        if cut:  # letters, then signs without an apostrophe: never one token
            letters, signs = cut.groups()
            stem = "\0" + letters if bare else letters
            known, ids = stem in self, self[stem] + self[signs if self.lower else "\0" + signs]
        elif self.lower and word.isascii() and word != (low := word.lower()):
            known, ids = low in self, self[low]
        else:
            known, ids = True, self.piece(word if bare or self.lower else " " + word)
        if known:
            self._remember([key], [ids])
        return ids

    def _remember(self, keys: list[str], ids: list[bytes]) -> None:
        self.update(zip(keys, ids))
        self.held += sum(map(len, keys)) + sum(map(len, ids)) + WORD_BYTES * len(keys)
        if self.held > MEMO_BYTES // 2:
            self.before, self.held = dict(self), 0
            self.clear()

    def _learn(self, unknown: set[str]) -> None:
        """Encode words together. A block whose edges are not one per word is left to
        be encoded word by word."""
        earlier = self.before
        for key in [w for w in unknown if w in earlier]:
            self._remember([key], [earlier[key]])
        if self.lower:
            plain = [w for w in unknown if w not in earlier and w.isalpha()]
        else:
            plain = [w for w in unknown if w and w not in earlier and not _GAP_OR_MARK.search(w)]
        for at in range(0, len(plain), BLOCK_WORDS):
            block = plain[at : at + BLOCK_WORDS]
            text = ("" if self.lower else " ") + " ".join(block)
            (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            edges = np.flatnonzero(self.edge[ids]) * 4
            if len(edges) != len(block):
                continue
            if self.lower:
                starts, ends = [0, *(edges[:-1] + 4).tolist()], (edges + 4).tolist()
            else:
                starts, ends = edges.tolist(), [*edges[1:].tolist(), 4 * len(ids)]
            if starts[0] or ends[-1] != 4 * len(ids):
                continue
            data = ids.tobytes()
            self._remember(block, [data[a:b] for a, b in zip(starts, ends)])

    def texts(self, texts: Iterable[str | None], chars: int | None = None) -> Iterator[bytes]:
        """Packed ids of each of the texts, a block of so many characters at a time. In the
        end Arrow gives back what it holds and does not use."""
        chars = chars or BLOCK_CHARS
        block: list[str | None] = []
        size = 0
        try:
            for text in texts:
                block.append(text)
                size += len(text or "")
                if size >= chars:
                    yield from self._block(block)
                    block, size = [], 0
            yield from self._block(block)
        finally:
            pa.default_memory_pool().release_unused()

    def _block(self, block: list[str | None]) -> Iterator[bytes]:
        texts, odd = pa.array(block, pa.large_string(), from_pandas=True).fill_null(""), {}
        if self.lower:  # gaps are dropped, so that any line break is a cut
            texts = pc.replace_substring(texts, "\n", " ")
        else:
            uncut = pc.or_(pc.match_substring_regex(texts, _SPACE_IN_GAP), pc.match_substring(texts, "\0"))
            odd = {i: self.encode(block[i]) for i in pc.indices_nonzero(uncut).to_pylist()}
            texts = pc.if_else(uncut, pa.scalar("", texts.type), texts)
            cut = pc.replace_substring(texts, "\n", " \0\n \0")
            texts = pc.if_else(pc.match_substring_regex(texts, _LINE_IN_GAP), texts, cut)
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        word, offsets = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
        others = []
        if not self.lower:  # no space before the first word of a text
            firsts = coded.dictionary.take(pa.array(word[offsets[:-1]])).to_pylist()
            word[offsets[:-1]] = len(coded.dictionary) + np.arange(len(block))
            others = ["\0" + w if w else w for w in firsts]
        ids, sizes = self._words(coded.dictionary, others)
        ids, ends = _gathered(ids, sizes, word)
        ends = np.concatenate([[0], ends])[offsets].tolist()
        for i, (start, end) in enumerate(zip(ends, ends[1:])):
            yield odd[i] if i in odd else ids[start:end].tobytes()

    def _words(self, distinct: pa.Array, others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words, one word behind the other, and how many each has. An empty
        one of the ``others`` has none."""
        simple = pc.extract_regex(distinct, _SIMPLE if self.lower else _SIMPLE_BARE)
        known = simple.is_valid().to_numpy(zero_copy_only=False)
        stems = pc.struct_field(simple, "stem").drop_null()
        signs = pc.struct_field(simple, "signs").drop_null()
        signed = pc.not_equal(signs, "")
        has_signs = np.flatnonzero(known)[signed.to_numpy(zero_copy_only=False)]
        signs = signs.filter(signed)
        if self.lower:
            stems = pc.utf8_lower(stems)
        else:
            nul, none = (pa.scalar(x, signs.type) for x in ("\0", ""))
            signs = pc.binary_join_element_wise(nul, signs, none)
        pieces = pa.concat_arrays([stems, signs]).dictionary_encode()
        ids, sizes, row = self._pieces(pieces.dictionary)
        rest = distinct.filter(pa.array(~known)).to_pylist()
        self._learn(set(rest).difference(self))
        many = len(distinct) + len(others)
        places = np.full((many, 2), -1)  # of a word's letters, or of all of it, and of its signs
        code = row[pieces.indices.to_numpy()]
        places[: len(distinct), 0][known] = code[: len(stems)]
        places[has_signs, 1] = code[len(stems) :]
        places[: len(distinct), 0][~known] = len(sizes) + np.arange(len(rest))
        places[len(distinct) :, 0] = len(sizes) + len(rest) + np.arange(len(others))
        parts = [*(self[w] for w in rest), *(self[w] if w else b"" for w in others), b""]
        ids = np.concatenate([ids, np.frombuffer(b"".join(parts), "<u4")])
        sizes = np.concatenate([sizes, np.array([*map(len, parts)]) // 4])
        found, _ = _gathered(ids, sizes, places[places >= 0])
        return found, sizes[places].sum(axis=1)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, ...]:
        """Ids of pieces, one behind the other, how many each has, and the place of each of
        these pieces, which are different, among them."""
        place = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        place[new] = len(self.known) + np.arange(len(new))
        fresh = pieces.take(pa.array(new))
        ids, sizes = self._encoded(fresh)
        self.known = pa.concat_arrays([self.known, fresh])
        self.known_ids = ids = np.concatenate([self.known_ids, ids])
        self.known_sizes = sizes = np.concatenate([self.known_sizes, sizes.astype(np.int32)])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        self.met[place] += 1
        self._forget()
        return ids, sizes, place

    def _forget(self) -> None:
        """Keep the pieces that most blocks had, if there are too many."""
        held = pc.binary_length(self.known).to_numpy() + 4 * self.known_sizes + PIECE_ROW
        if held.sum() <= PIECE_BYTES:
            return
        order = np.argsort(-self.met, kind="stable")
        keep = np.sort(order[np.cumsum(held[order]) <= PIECE_BYTES // 2])
        self.known = self.known.take(pa.array(keep))
        self.known_ids, _ = _gathered(self.known_ids, self.known_sizes, keep)
        self.known_sizes, self.met = self.known_sizes[keep], self.met[keep] // 2

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the pieces, one behind the other, and how many each has. Each is a
        piece for the tokenizer, too."""
        letters = pc.binary_length(pieces).to_numpy().astype(np.int64)
        if not self.lower:  # a space before each that has no NUL
            bare = pc.starts_with(pieces, "\0").to_numpy(zero_copy_only=False)
            letters += np.where(bare, -1, 1)
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), BLOCK_WORDS):
            text = "\n" + "\n".join(pieces[at : at + BLOCK_WORDS].to_pylist())
            if not self.lower:
                text = text.replace("\n", "\n ").replace("\n \0", "\n")
            text = text[1:].encode().decode("latin-1").translate(self.letters)
            text = text.replace(self.letters[ord("\n")], " ")
            (found,) = self.spelled.encode_batch_fast([text], add_special_tokens=False)
            ids.append(np.array(found.ids, "<u4"))
            reached = np.cumsum(self.long[ids[-1]])
            ends = np.cumsum(letters[at : at + BLOCK_WORDS])
            if reached[-1:] == ends[-1:]:
                sizes.append(np.diff(np.searchsorted(reached, ends, side="right"), prepend=0))
            else:  # the vocabulary does not have all letters
                places = self.spelled.encode(text, add_special_tokens=False).word_ids
                sizes.append(np.bincount(np.array(places, np.int64), minlength=len(ends)))
        return np.concatenate(ids), np.concatenate(sizes)

    @staticmethod
    def __parted(lines: list[str]) -> bool:
        """Whether each line break stands alone between other characters."""
        ends = all(x and not x[-1].isspace() for x in lines)
        return ends and not any(x[0].isspace() for x in lines[1:])

    def text(self, text: str | None) -> bytes:
        """Packed ids of a whole text; none for null or empty."""
        if not text:
            return b""
        if self.lower:  # gaps are dropped, so that any space is a cut
            return b"".join(map(self.__getitem__, text.split(" ")))
        if "\0" in text or (_GAP_GOES_ON.search(text) and _INSIDE_GAP.search(text)):
            return self.encode(text)
        first, *rest = text.split(" ")
        head = self["\0" + first] if first else b""
        return head + b"".join(map(self.__getitem__, rest))


@cache
def words(path: str, lower: bool) -> Words:
    """One per worker and file."""
    return Words(path, lower)
