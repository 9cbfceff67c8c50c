"""Token ids of whole texts by the tokenizers library, in numpy, for use inside tasks.

Byte-level BPE first cuts a text into words by a pattern and never merges across a cut. Most words of a corpus occur
again and again, so here the cut is made once for many texts, their words are told apart by Arrow, and the library's BPE model is asked once
per distinct word that the worker doesn't remember. Texts with special-token strings or with control characters whose
class differs between regular expression engines are encoded whole by the library, as is everything under tokenizers
of another kind.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

#: Distinct words that one worker remembers, some 65 MB of them; beyond, it forgets the rare half.
KNOWN = 300_000
#: Letters of words that it remembers at most.
LETTERS = 6_000_000
#: Characters encoded at once by others and here, and texts taken out of Arrow at once.
CHARS, MORE_CHARS, ROWS = 500_000, 1_000_000, 200
ODD = re.compile("[\x1c-\x1f]")
#: Before a text that isn't cut, and alone after the words of each text, where words are told apart; texts with this letter are never cut.
WHOLE = "\x1f"
# Fixed value of the byte-level tokenizer: its pattern, whole.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The Latin letters beyond ASCII.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: The kinds of bytes in texts of ASCII and LATIN alone: WHOLE, white space, letters (all that isn't ASCII), digits, others.
MARK, SPACE, LETTER, DIGIT, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[ord(WHOLE)] = MARK
KIND[[*b"\t\n\v\f\r "]] = SPACE
KIND[[b for b in range(256) if b > 127 or chr(b).isalpha()]] = LETTER
KIND[[*b"0123456789"]] = DIGIT
#: Outside ASCII and LATIN, where both patterns cut alike; all of ODD is outside.
BEYOND = re.compile(f"[^\x00-\x1b\x20-\x7e{LATIN}]")


class Numbers(dict):
    """The words' numbers; a new word gets the next one when it is asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others numbered from U+0100."""
    printable = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words start in texts of ASCII and LATIN alone, as WORDS cuts them. data: UTF-8, WHOLE after each text, which is a word of its own."""
    kind = KIND[data]
    word, space = kind > SPACE, kind == SPACE
    start = kind == MARK
    start[:1] = True
    # A run of one kind is a word and takes a blank before it along; of other white space before it, none.
    start[1:] |= (kind[1:] != kind[:-1]) & ~(word[1:] & (data[:-1] == ord(" ")))
    start[:-1] |= space[:-1] & word[1:]
    # Contractions, where a word starts with their apostrophe: the letters after them start another.
    at = np.flatnonzero(start & (data == ord("'")))
    one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    short = np.isin(one, [*b"stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    start[at[short] + 2] = True
    start[at[long] + 3] = True
    return np.flatnonzero(start)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size, one run after the other."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


class Encoder:
    """Encodes batches of texts with the tokenizer in ``path``; ids are those of ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        pre, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        told = json.loads(pre.__getstate__()) if pre is not None else {}
        self.cuts = (
            told.get("type") == "ByteLevel" and told.get("use_regex") and not told.get("add_prefix_space")
            and self.tokenizer.normalizer is None and isinstance(self.model, BPE) and not self.model.dropout
        )
        self.letters = np.array([ord(c) for _, c in sorted(byte_letters().items())], "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Numbers()
        self.held = 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Keeps the more frequent half of the words at most, and none that was met but once."""
        n = len(self.known)
        often = np.argsort(-self.hits[:n], kind="stable")[: KNOWN // 2]
        keep = np.sort(often[self.hits[often] > 1])
        size = self.size[keep]
        stop = np.cumsum(size)
        self.ids = self.ids[runs(self.start[keep], size)]
        self.start, self.size, self.hits, self.used = stop - size, size, self.hits[keep] // 2, len(self.ids)
        words = list(self.known)  # in the order of their numbers
        words = [words[i] for i in keep.tolist()]
        self.known = Numbers(zip(words, range(len(words)), strict=True))
        self.held = sum(map(len, words))
        if self.held > LETTERS // 2:
            self.known, self.held, self.used = Numbers(), 0, 0

    def whole(self, text: str) -> bool:
        """Whether the library has to see the text as it is."""
        return bool(not self.cuts or ODD.search(text) or any(t in text for t in self.special))

    def plain(self, text: str) -> bool:
        """Whether the text may be cut by the kinds of its bytes."""
        return self.cuts and not BEYOND.search(text) and not any(t in text for t in self.special)

    def pieces(self, text: str) -> Sequence[str]:
        """The words of a text that isn't plain; one that isn't cut has a mark before it, which no word has."""
        if self.whole(text):
            return (WHOLE + text,) if text else ()
        return WORDS.findall(text)

    def spell(self, pieces: list[str]) -> Iterator[list[int]]:
        """The ids of each piece."""
        joined = WHOLE.join(p for p in pieces if p[0] != WHOLE).encode()
        letters = self.letters[np.frombuffer(joined, np.uint8, len(joined))].tobytes().decode("utf-32-le")
        cut = iter(letters.split(chr(self.letters[ord(WHOLE)])))
        tokens = self.model.tokenize
        for p in pieces:
            yield self.tokenizer.encode(p[1:], add_special_tokens=False).ids if p[0] == WHOLE else [t.id for t in tokens(next(cut))]

    def learn(self, new: list[str]) -> None:
        """Spells the words that just got the last numbers."""
        m = len(self.known)
        n = m - len(new)
        made = list(self.spell(new))
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum()))
        while m > len(self.start):
            more = np.zeros(max(len(self.start), 1 << 14), np.int64)
            self.start, self.size, self.hits = (np.concatenate([x, more]) for x in (self.start, self.size, self.hits))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), 1 << 16), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n:m], self.size[n:m], self.hits[n:m] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        self.used += len(flat)
        self.held += sum(map(len, new))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of the words, each of which is known afterwards."""
        told = words.dictionary_encode()
        names, n = told.dictionary.to_numpy(zero_copy_only=False).tolist(), len(self.known)
        number = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        if len(self.known) > n:
            self.learn([names[i] for i in np.flatnonzero(number >= n).tolist()])
        return number[told.indices.to_numpy()]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if len(self.known) > KNOWN or self.held > LETTERS:
            self.forget()
        plain = np.fromiter(map(self.plain, texts), bool, len(texts))
        joined = "".join(t + WHOLE for t, p in zip(texts, plain.tolist(), strict=True) if p).encode()
        data = np.frombuffer(joined, np.uint8, len(joined))
        at = word_starts(data)
        ends = np.append(at, len(data))
        where = self.numbers(pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
        if not plain.all():
            others = [w for t, p in zip(texts, plain.tolist(), strict=True) if not p for w in (*self.pieces(t), WHOLE)]
            where = np.concatenate([where, self.numbers(pa.array(others, pa.large_string()))])
        self.hits[: len(self.known)] += np.bincount(where, minlength=len(self.known))
        sizes = self.size[where]
        ids = self.ids[runs(self.start[where], sizes)]
        counts = np.diff(np.cumsum(sizes)[where == self.known.get(WHOLE, -1)], prepend=0)
        if not plain.all():  # back from plain ones first to the texts' order
            place = np.argsort(np.argsort(~plain, kind="stable"))
            begin = np.cumsum(counts) - counts
            ids, counts = ids[runs(begin[place], counts[place])], counts[place]
        return ids, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; what it has learnt serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release() -> None:
    """Drops the worker's encoders and gives their memory back, for tasks of another kind that Spark runs on the same worker."""
    if not _encoders:
        return
    _encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim is not None:
        trim(0)


def encoded(texts: pa.Array | Sequence[str | None], path: str, end: int) -> Iterator[np.ndarray]:
    """The ids of each text (null: empty) with ``end`` after them, in order."""
    of = encoder(path)
    for group in grouped(texts, MORE_CHARS):
        ids, sizes = of.encode(group)
        padded = np.insert(ids, np.cumsum(sizes), np.uint32(end))
        stop = np.cumsum(sizes + 1)
        yield from (padded[a:b] for a, b in zip((stop - sizes - 1).tolist(), stop.tolist(), strict=True))


def grouped(texts: pa.Array | Sequence[str | None], most: int = CHARS) -> Iterator[list[str]]:
    """Neighbouring texts of about ``most`` characters, or one longer one; of an Arrow array few are Python strings at once."""
    group, chars = [], 0
    for first in range(0, len(texts), ROWS):
        some = texts[first : first + ROWS]
        for text in some.to_pylist() if isinstance(some, pa.Array) else some:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= most:
                yield group
                group, chars = [], 0
    if group:
        yield group


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
