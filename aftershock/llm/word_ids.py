"""Token ids of texts by a public tokenizer, at the price of its distinct words."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from aftershock.llm.byte_words import slices, span_hashes, spans, table
from aftershock.llm.shared import text_buffer

TOKENIZER = "word_bpe_49k.json"
# Distinct words kept by a worker; beyond it starts afresh, which costs time only. Their table has the places.
MAX_WORDS = 600_000
PLACES = 1 << 20
SPACES = table(0x20, 0x0A)
MARKS = table(*(c for c in range(0x21, 0x7F) if not chr(c).isalnum()))
STOPS = table(*b".!?")
ALNUM = table(*(c for c in range(0x80) if chr(c).isalnum()))
LOWER = np.array([ord(chr(c).lower()) if c < 0x80 else c for c in range(256)], np.uint8)
# a-z: bytes that neither normalisation nor byte mapping touches.
PLAIN = table(*range(0x61, 0x7B))
# Marks that are split off the end of a word.
TAIL = 7
# Words that neither normalisation nor byte mapping can touch but for the letters' bytes.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class WordIds:
    """Encodes texts with the tokenizers library as ``encode(text, add_special_tokens=False)`` does.

    A tokenizer that drops white space gives a text the ids of its words one after another, and
    a word's closing marks after a letter or digit are encoded apart. So only distinct words are
    encoded; those of letters alone by the tokenizer's model. Other tokenizers encode whole
    texts. Words are told apart by a 64-bit hash, confirmed by length and the first and last
    eight bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.by_word = _drops_space(made)
        self.special = [x["content"].lower().encode() for x in made["added_tokens"]]
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(0xC0, 0x100)) if c.isalpha() and c == c.lower()]
        self.bytes_of = str.maketrans({c: byte_level.pre_tokenize_str(c)[0][0] for c in letters})
        self._forget()

    def _forget(self) -> None:
        self.known = KnownWords()
        self.flat, self.starts, self.sizes = array("I"), array("q"), array("q")
        self._keep(())

    def _keep(self, ids) -> int:
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        return len(self.starts) - 1

    def _new(self, word: bytes, plain: bool) -> int:
        if plain:
            return self._keep([t.id for t in self.tokenizer.model.tokenize(word.decode("ascii"))])
        text = word.decode("utf-8", "replace")
        if LETTERS.match(text):
            return self._keep([t.id for t in self.tokenizer.model.tokenize(text.lower().translate(self.bytes_of))])
        return self._keep(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The word number of each span."""
        hashes = span_hashes(data, starts, ends)
        hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        eight = np.ndarray((len(data) + 1,), "<u8", raw + bytes(8), strides=(1,))
        sizes = ends - starts
        shorter = np.minimum(sizes, 8)
        mask = np.uint64(2**64 - 1) >> ((8 - shorter) * 8).astype(np.uint64)
        looks = np.stack([sizes.astype(np.uint64), eight[starts] & mask, eight[ends - shorter] & mask])
        others = np.cumsum(np.append(False, ~PLAIN[data]))
        plain = others[starts] == others[ends]
        same = first[which]
        if (looks != looks[:, same]).any():  # two words of one hash
            each = zip(starts.tolist(), ends.tolist(), plain.tolist())
            return np.array([self._new(raw[a:b], p) for a, b, p in each], np.int64)
        numbers = self.known.find(hashes, looks[:, first])
        new = np.flatnonzero(numbers < 0)
        if len(new):
            spots = first[new]
            each = zip(starts[spots].tolist(), ends[spots].tolist(), plain[spots].tolist())
            made = [self._new(raw[a:b], p) for a, b, p in each]
            fresh = numbers[new] == KnownWords.ABSENT
            numbers[new] = made
            self.known.add(hashes[new[fresh]], looks[:, spots[fresh]], numbers[new[fresh]])
        return numbers[which]

    def _runs(self, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two word numbers per word (itself and its closing marks), the words' ends, and whether a sentence ends."""
        starts, ends = spans(data, limits, SPACES)
        if not len(starts):
            return np.zeros(0, np.int64), ends, np.zeros(0, bool)
        text_end = np.zeros(len(data) + 1, bool)
        text_end[limits] = True
        followed = np.append(data, np.uint8(0x20))[ends]
        stops = (followed == 0x0A) & ~text_end[ends]
        body = ends.copy()
        marks = np.flatnonzero(MARKS[data[ends - 1]])
        for _ in range(TAIL):
            inner = marks[body[marks] - 1 > starts[marks]]
            body[inner] -= 1
            stops[inner] |= STOPS[data[body[inner]]]
            marks = inner[MARKS[data[body[inner] - 1]]]
        last, before = data[body - 1], data[np.maximum(body - 2, 0)]
        accented = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (body - 2 >= starts)
        whole = ~(ALNUM[last] | accented)
        body[whole] = ends[whole]
        lowered = LOWER[data]
        raw = lowered.tobytes()
        if any(x in raw for x in self.special):  # only its exact spelling is a special token
            lowered, body = data, ends
        numbers = np.zeros((len(starts), 2), np.int64)
        numbers[:, 0] = self._distinct(lowered, starts, body)
        tailed = np.flatnonzero(body < ends)
        if len(tailed):
            numbers[tailed, 1] = self._distinct(lowered, body[tailed], ends[tailed])
        return numbers.ravel(), ends, stops

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, and where each word ends among them."""
        sizes = np.frombuffer(self.sizes, np.int64)[numbers]
        ends = np.cumsum(sizes)
        shift = np.frombuffer(self.starts, np.int64)[numbers] - ends + sizes
        places = np.repeat(shift, sizes)
        places += np.arange(len(places))
        return np.frombuffer(self.flat, np.uint32)[places], ends

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (uint32) of the texts end to end, the texts' limits in them, and where sentences end."""
        if not self.by_word:
            return self._encode_whole(column)
        data, limits = text_buffer(column)
        all_ids, all_stops, before = [], [], 0
        text_limits = np.zeros(len(limits), np.int64)
        for a, b in slices(data, limits, SPACES):
            if self.known.size > MAX_WORDS:
                self._forget()
            low, high = np.searchsorted(limits, [a, b], side="right")
            inner = limits[low:high] - a
            numbers, ends, stops = self._runs(data[a:b], inner)
            if len(numbers):
                ids, id_ends = self._gather(numbers)
                word_ends = id_ends[1::2]
                upto = np.searchsorted(ends, inner, side="right")
                text_limits[low:high] = before + np.append(0, word_ends)[upto]
                all_ids.append(ids)
                all_stops.append(word_ends[stops] + before)
                before += len(ids)
            else:
                text_limits[low:high] = before
        # Empty texts at the very start stand before any slice.
        text_limits = np.maximum.accumulate(text_limits)
        if not all_ids:
            return np.zeros(0, np.uint32), text_limits, np.zeros(0, np.int64)
        return np.concatenate(all_ids), text_limits, np.concatenate(all_stops)

    def _encode_whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [np.array(self.tokenizer.encode(x or "", add_special_tokens=False).ids, np.uint32) for x in column.to_pylist()]
        limits = np.cumsum([0, *map(len, ids)])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), limits, np.zeros(0, np.int64)


class KnownWords:
    """Numbers of words by their hashes, in a table with open addressing that is searched for many at once.

    A word is known again by its hash, its size and its first and last eight bytes (``looks``).
    """

    ABSENT, OTHER = -1, -2  # not there; another word of the same hash is

    def __init__(self):
        self.size = 0
        self.places = PLACES
        self.hashes = np.zeros(self.places, np.uint64)  # 0: free
        self.looks = np.zeros((3, self.places), np.uint64)
        self.numbers = np.zeros(self.places, np.int64)

    def find(self, hashes: np.ndarray, looks: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), self.ABSENT, np.int64)
        open_ = np.arange(len(hashes))
        place = self._first(hashes)
        while len(open_):
            there = self.hashes[place]
            hit = there == hashes[open_]
            at, of = place[hit], open_[hit]
            alike = (self.looks[:, at] == looks[:, of]).all(0)
            found[of] = np.where(alike, self.numbers[at], self.OTHER)
            further = ~hit & (there != 0)
            open_, place = open_[further], (place[further] + 1) % self.places
        return found

    def add(self, hashes: np.ndarray, looks: np.ndarray, numbers: np.ndarray) -> None:
        """Words that :meth:`find` did not find, each once."""
        if 4 * (self.size + len(hashes)) > 3 * self.places:
            self._grow(self.size + len(hashes))
        self.size += len(hashes)
        open_, place = np.arange(len(hashes)), self._first(hashes)
        while len(open_):
            free = np.flatnonzero(self.hashes[place] == 0)
            # Of words that ask for the same place the first takes it.
            spots, first = np.unique(place[free], return_index=True)
            of = open_[free[first]]
            self.hashes[spots], self.looks[:, spots], self.numbers[spots] = hashes[of], looks[:, of], numbers[of]
            left = np.ones(len(open_), bool)
            left[free[first]] = False
            open_, place = open_[left], (place[left] + 1) % self.places

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.places)).astype(np.int64)

    def _grow(self, wanted: int) -> None:
        """Only a slice with very many new words makes the table larger than planned."""
        used = np.flatnonzero(self.hashes)
        held = self.hashes[used], self.looks[:, used], self.numbers[used]
        self.places = 1 << (2 * wanted).bit_length()
        self.hashes, self.looks, self.numbers = np.zeros(self.places, np.uint64), np.zeros((3, self.places), np.uint64), np.zeros(self.places, np.int64)
        self.size = 0
        self.add(*held)


def _drops_space(made: dict) -> bool:
    """Whether white space only separates words: normalised alike on both sides, then dropped."""
    normal = (made.get("normalizer") or {}).get("normalizers", [])
    split = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = made["model"]
    return (
        [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in split] == ["Split", "ByteLevel"]
        and (split[0]["behavior"], split[0]["invert"]) == ("Removed", True)
        and not split[1]["add_prefix_space"]
        and not split[1]["use_regex"]
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
        and not any(x["lstrip"] or x["rstrip"] for x in made["added_tokens"])
    )
