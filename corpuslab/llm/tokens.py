"""Token ids of many texts by a public tokenizer file, one distinct word at a time.

A BPE tokenizer that parts words at white space gives a word the same ids wherever it
stands. A batch is therefore reduced to its distinct words (in C++), only words never
seen before are encoded, and the ids are gathered by index.
"""

from __future__ import annotations

import itertools
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# fixed values: the word pattern of the tokenizer file
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
KEPT_WORDS, KEPT_PARTS, KEPT_IDLE = 250_000, 200_000, 50_000
_LOADED: dict[str, WordIds] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = itertools.count(256)
    return [chr(b if b in own else next(rest)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"={len(ids)}I", *ids)


class WordIds:
    """Ids of words, with bounded memory of the words met first (the frequent ones).

    Ids are kept as bytes, four for each, about a third of what a list of numbers takes.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.letters = byte_letters()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            spelled = part if part.isascii() else "".join(
                [self.letters[b] for b in part.encode()])
            ids = packed([t.id for t in self.model.tokenize(spelled)])
            if len(self.parts) < KEPT_PARTS:
                self.parts[part] = ids
        return ids

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is not None:
            return ids
        if word.isascii():
            if "<|" in word or not word.isprintable():
                ids = packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
            elif word.isalpha():
                ids = self._part(word if word.islower() else word.lower())
            else:
                ids = b"".join(map(self._part, PATTERN.findall(word.lower())))
        elif max(word) <= "ɏ" and "<|" not in word and word.isprintable():
            text = self.normalizer.normalize_str(word)
            ids = b"".join(map(self._part, PATTERN.findall(text)))
        else:  # rare scripts: the library's own path, whole
            ids = packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self.words) < KEPT_WORDS:
            self.words[word] = ids
        return ids

    def shrink(self) -> None:
        """Keep only the words met first, which are the frequent ones, for the next task."""
        self.words = dict(itertools.islice(self.words.items(), KEPT_IDLE))
        self.parts = dict(itertools.islice(self.parts.items(), KEPT_IDLE))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text begins (one more than texts)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.values.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        known = self.words.get
        found = [ids if (ids := known(w)) is not None else self.word(w)
                 for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        lengths = sizes[index] if len(index) else np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        if len(index) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        total = int(ends[-1])
        small = np.int32 if max(total, len(flat)) < 2**31 else np.int64
        places = np.repeat((starts[index] - (ends - lengths)).astype(small), lengths)
        places += np.arange(total, dtype=small)
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        return flat[places], bounds


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, text: str, size: int = 8 * 2**20):
    """Parts of a batch whose texts hold about ``size`` bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop
