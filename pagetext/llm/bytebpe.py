"""Ids of a byte-level BPE tokenizer file, counted word by word.

The file is read by the public ``tokenizers`` library, whose model merges each
word; a worker keeps the ids of words it has seen (at most ``MEMORY`` bytes of
them, words of at most ``KEPT`` characters). Words are cut by the published
pattern of that kind of file, for texts of characters up to U+024F with its
classes spelt out. Beyond, the classes are those of the Unicode version the
library was built with, so a text with characters that are unassigned in
Python's goes whole through the library.

``encode_all`` takes the texts of an Arrow batch at once: words are cut by the
classes of their bytes, and each distinct word of the batch is looked up once.
Texts with unassigned characters or special tokens are encoded one by one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from .packed import flat

MEMORY = 96 << 20
KEPT = 64
ENTRY = 160           # bytes of a kept word besides its text, about


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in such a file: printable Latin-1 characters
    stand for themselves, the others for the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


# Fixed classes of the characters up to U+024F, which all Unicode versions share.
SPACE, LETTER, NUMBER = "\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
NEAR_WORDS = re.compile(f" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
FAR = re.compile("[^\x00-ɏ]")


SPACES, LETTERS, NUMBERS, OTHERS, UNASSIGNED = range(5)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The class of each character: up to U+024F as spelt out above, beyond as for the published pattern."""
    every = "".join(map(chr, range(0x250, 0xD800))) + "?" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, OTHERS, np.uint8)
    for kind, near, far in ((SPACES, SPACE, r"\s+"), (LETTERS, LETTER, r"\p{L}+"), (NUMBERS, NUMBER, r"\p{N}+")):
        out[[c for c in range(0x250) if re.match(f"[{near}]", chr(c))]] = kind
        for found in regex.finditer(far, every):
            out[0x250 + found.start():0x250 + found.end()] = kind
    out[0x250:][np.fromiter((unicodedata.category(c) == "Cn" for c in every), bool, len(every))] = UNASSIGNED
    return out


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 texts the class of its character."""
    of = kinds()
    kind = of[:256][data]
    top = int(data.max(initial=0))
    for size, low, high in ((2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF7)):
        if top >= low:
            at = np.flatnonzero((data >= low) & (data <= high))
            code = (data[at] & (0x7F >> size)).astype(np.int64)
            for i in range(1, size):
                code = code << 6 | data[at + i] & 0x3F
            for i in range(size):
                kind[at + i] = of[code]
    return kind


def word_starts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the words of the published pattern start, in UTF-8 texts of assigned characters that follow one another."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    cut = first.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    # the last space before a word stands apart from those before it, and goes with the word if it is a blank
    at = np.flatnonzero((kind[:-1] == SPACES) & (kind[1:] != SPACES) & ~first[1:n]) + 1
    last = data[at - 1]
    cut[at[last == 0x20]] = False
    cut[at - np.where(last < 0x80, 1, np.where(data[at - 2] >= 0xC0, 2, 3))] = True       # no space has four bytes
    # 's, 't, 'm, 'd, 're, 've, 'll, where no blank goes with the apostrophe
    at = np.flatnonzero(data[:-1] == ord("'"))
    at = at[cut[at] & ~first[at + 1]]
    one, two = data[at + 1], np.where(first[at + 2], 0, data[np.minimum(at + 2, n - 1)])
    size = np.isin(one, np.frombuffer(b"stmd", np.uint8)) + 2 * (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))
                                                                | (one == ord("l")) & (two == ord("l")))
    at, size = at[size > 0], size[size > 0]
    cut[at + 1] = False
    cut[at + 1 + size] = True
    return np.flatnonzero(cut[:n])


class ByteBpe(dict):
    """Ids by word, as packed integers of ``dtype``; a word is merged when first asked for.
    With ``specials`` the strings of special tokens in a text are those tokens, otherwise plain text."""

    def __init__(self, path: str, specials: bool):
        from tokenizers import Tokenizer
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if (spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex")
                or spec["model"]["type"] != "BPE" or spec["model"].get("dropout")):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        letters = byte_letters()
        if any(c not in vocabulary for c in letters.values()):
            raise ValueError("a byte has no token, so texts could not be kept whole")
        self.letters = {b: c for b, c in letters.items()}
        byte_of = {c: b for b, c in letters.items()}
        added = {t["content"]: t for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added.values()):
            raise ValueError("special tokens that take their surroundings are not supported")
        #: bytes of each id, b"" where the file has none
        self.bytes_of = [b""] * self.size
        for piece, i in vocabulary.items():
            self.bytes_of[i] = piece.encode() if piece in added else bytes(byte_of[c] for c in piece)
        self.special = {s: self.packed([t["id"]]) for s, t in added.items()} if specials else {}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.assigned: dict[str, bool] = {}
        every, width = self.packed(range(self.size)), self.dtype.itemsize
        self.packed_id = [every[at:at + width] for at in range(0, len(every), width)]
        self.used = 0

    def packed(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():       # all but the blank stand for themselves
            letters = word.replace(" ", self.letters[32])
        else:
            letters = word.encode().decode("latin-1").translate(self.letters)
        ids = b"".join([self.packed_id[t.id] for t in self.model.tokenize(letters)])
        if len(word) <= KEPT:
            self.used += ENTRY + len(word) + len(ids)
            if self.used > MEMORY:
                self.clear()
                self.used = ENTRY
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The text's ids, packed."""
        if not text:
            return b""
        words = NEAR_WORDS.findall
        if FAR.search(text):
            words = self.words
            if not all(map(self.is_assigned, set(FAR.findall(text)))):
                return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        # plain searches: the pattern would be tried at each character
        if self.cut is None or not any(map(text.__contains__, self.special)):
            return b"".join(map(self.__getitem__, words(text)))
        return b"".join(self.special[p] if p in self.special else b"".join(map(self.__getitem__, words(p)))
                        for p in self.cut.split(text))

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The packed ids of each text (null: empty), ``end`` behind them."""
        data, offsets = flat(texts)
        kind = byte_kinds(data)
        alone = self.one_by_one(data, offsets, kind)
        if len(alone):
            near = np.ones(len(texts), bool)
            near[alone] = False
            ids = pa.array([self.encode(t) + end for t in texts.take(pa.array(alone)).to_pylist()], pa.binary())
            place = np.argsort(np.concatenate([np.flatnonzero(near), alone]))
            return pa.concat_arrays([self.encode_all(texts.filter(pa.array(near)), end), ids]).take(pa.array(place))
        starts = word_starts(data, offsets, kind)
        words = pa.Array.from_buffers(pa.string(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        ids = [*map(self.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), end]
        before = np.searchsorted(starts, offsets)       # words before each text
        which = np.insert(words.indices.to_numpy(), before[1:], len(ids) - 1)
        joined = pa.array(ids, pa.binary()).take(pa.array(which))
        spans = np.frombuffer(joined.buffers()[1], np.int32)[before + np.arange(len(before))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(spans), joined.buffers()[2]])

    def one_by_one(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold special tokens or unassigned characters."""
        found = [np.searchsorted(offsets, np.flatnonzero(kind == UNASSIGNED), side="right") - 1]
        whole = data.tobytes() if self.special else b""
        for s in map(str.encode, self.special):
            if s in whole:
                found.append(np.array([i for i, (a, e) in enumerate(zip(offsets[:-1], offsets[1:])) if whole.find(s, a, e) >= 0], np.int64))
        return np.unique(np.concatenate(found))

    def is_assigned(self, character: str) -> bool:
        """Whether the character has a category in this Python's Unicode version."""
        known = self.assigned.get(character)
        if known is None:
            known = self.assigned[character] = unicodedata.category(character) != "Cn"
        return known


@lru_cache(maxsize=4)
def encoder(path: str, specials: bool) -> ByteBpe:
    """One per worker process, file and treatment of special tokens."""
    return ByteBpe(path, specials)
