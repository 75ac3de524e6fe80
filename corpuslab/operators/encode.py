"""Encoding and decoding a corpus with a learned vocabulary.

Documents are encoded where they lie: no shuffle. The JVM splits text into pretokens,
an Arrow batch reduces them to distinct words (in C++), only words not met before in
the task are encoded, and the ids are gathered back by index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.merges import MergeTable
from corpuslab.operators.pretokens import META, prepared
from corpuslab.operators.subwords import (
    LONG, PieceIndex, PieceTrie, best_pieces, best_split, longest_match, longest_matches, prefixes,
)
from corpuslab.operators.vocab import SPECIALS, Vocabulary, byte_alphabet

CACHE_WORDS = 1_000_000
#: words encoded at once
FRESH_WORDS = 20_000
#: characters or ids that are encoded or decoded at once, some 60 bytes each while they are
SLICE = 1_000_000
# What a WordPiece decoder tidies at the head of a piece.
TIDY = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"),
        (" 've", "'ve"), (" 're", "'re"))


def word_encoder(vocab: Vocabulary, longest: int | None = None) -> Callable[[str], list[int]]:
    """The function that turns one pretoken into ids; ``longest`` holds for WordPiece."""
    ids = {t: i for i, t in enumerate(vocab.tokens)}
    if vocab.kind == "bpe":
        alphabet = byte_alphabet()
        table = MergeTable(vocab.merges)
        letters = [ids.get(c) for c in alphabet]
        return lambda word: table.apply_word(
            [letters[b] for b in word.encode() if letters[b] is not None])
    if vocab.kind == "wordpiece":
        tails = PieceTrie({t[2:]: i for t, i in ids.items() if t.startswith("##")})
        heads = PieceTrie(ids)
        return lambda word: longest_match(word, heads, tails, ids["[UNK]"], longest)
    if vocab.kind == "unigram":
        specials = set(SPECIALS["unigram"])
        scores = {t: s for t, s in zip(vocab.tokens, vocab.scores) if t not in specials}
        unknown, starts = ids["<unk>"], prefixes(scores)

        def encode(word: str) -> list[int]:
            out: list[int] = []
            for piece in best_split(word, scores, starts)[0]:
                found = ids.get(piece, unknown)
                if found != unknown or not out or out[-1] != unknown:
                    out.append(found)
            return out

        return encode
    raise ValueError(f"unknown kind {vocab.kind}")


def words_encoder(
    vocab: Vocabulary, longest: int | None = None,
) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """:func:`word_encoder` for many words at once: their ids end to end, and how many each has."""
    ids = {t: i for i, t in enumerate(vocab.tokens)}
    if vocab.kind == "bpe":
        table = MergeTable(vocab.merges, singly=True)
        letters = np.array([ids.get(c, -1) for c in byte_alphabet()], np.int64)

        def encode(words):
            spelled = [w.encode() for w in words]
            row = np.repeat(np.arange(len(words)), np.fromiter(map(len, spelled), np.int64, len(words)))
            found = letters[np.frombuffer(b"".join(spelled), np.uint8)]
            known = found >= 0
            found, row = table.apply(found[known], row[known])
            return found, np.bincount(row, minlength=len(words))

        return encode
    if vocab.kind == "wordpiece":
        tails = PieceIndex({t[2:]: float(i) for t, i in ids.items() if t.startswith("##")})
        heads = PieceIndex({t: float(i) for t, i in ids.items()})
        unknown = ids["[UNK]"]

        def encode(words):
            pieces, counts, spelled = longest_matches(words, heads, tails)
            if longest is not None:
                short = np.fromiter(map(len, words), np.int64, len(words)) <= longest
                pieces = pieces[np.repeat(short, counts)]
                counts, spelled = np.where(short, counts, 0), spelled & short
            row = np.repeat(np.arange(len(words)), counts)
            first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            found = np.empty(len(pieces), np.int64)
            found[first] = heads.scores[pieces[first]]
            found[~first] = tails.scores[pieces[~first]]
            lost = np.flatnonzero(~spelled)
            begins = (np.cumsum(counts) - counts)[lost]
            return np.insert(found, begins, unknown), np.where(spelled, counts, 1)

        return encode
    if vocab.kind == "unigram":
        specials = set(SPECIALS["unigram"])
        index = PieceIndex({t: s for t, s in zip(vocab.tokens, vocab.scores) if t not in specials})
        unknown = ids["<unk>"]
        numbers = np.array([*(ids[p] for p in index.pieces), unknown], np.int64)

        def encode(words):
            pieces, counts = best_pieces(words, index)
            found, row = numbers[pieces], np.repeat(np.arange(len(words)), counts)
            lost = found == unknown
            again = np.zeros(len(found), bool)
            again[1:] = lost[1:] & lost[:-1] & (row[1:] == row[:-1])
            return found[~again], np.bincount(row[~again], minlength=len(words))

        return encode
    raise ValueError(f"unknown kind {vocab.kind}")


def _encode_words(
    lists: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
    encode_long: Callable[[str], list[int]], cache: dict,
) -> pa.Array:
    """Lists of words to lists of ids; words of more than ``LONG`` characters one by one."""
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    if len(cache) + len(words) > CACHE_WORDS:
        cache.clear()
    fresh = []
    for word in words:
        if word not in cache:
            if len(word) > LONG:
                cache[word] = np.asarray(encode_long(word), dtype=np.int32)
            else:
                fresh.append(word)
    for begin in range(0, len(fresh), FRESH_WORDS):
        some = fresh[begin:begin + FRESH_WORDS]
        found, counts = encode(some)
        cache.update(zip(some, np.split(found.astype(np.int32), np.cumsum(counts)[:-1])))
    per_word = [cache[w] for w in words]
    width = np.fromiter((len(p) for p in per_word), np.int64, len(per_word))
    pool = np.concatenate(per_word) if per_word else np.empty(0, np.int32)
    begin = np.concatenate([[0], np.cumsum(width)[:-1]]) if per_word else np.empty(0, np.int64)
    index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = width[index]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(begin[index], sizes)
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    offsets = np.concatenate([[0], ends])[cuts]
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(pool[source] if total else pool[:0], pa.int32()))


def in_slices(
    batches: Iterator[pa.RecordBatch], length: Callable[[pa.Array], pa.Array], most: int | None = None,
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` characters or ids of the second column, at least a row each.

    A batch holds a number of rows, whatever these hold; what a task needs beside it follows the slice.
    """
    most = most or SLICE
    for batch in batches:
        sizes = pc.fill_null(length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes.astype(np.int64)) - 1) // most
        begins = np.flatnonzero(np.concatenate([[True], np.diff(part) > 0]))[:len(sizes)]
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(sizes)]):
            yield batch.slice(begin, end - begin)


def encode_corpus(
    df: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text",
    longest: int | None = None,
) -> DataFrame:
    """``(key, tokens)`` with the ids of each text, no special tokens added.

    ``longest`` makes longer words of a WordPiece vocabulary unknown; without it none is too long.
    """
    if vocab.kind == "char":
        return encode_chars(df, vocab.tokens, key, text)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, tokens array<int>"
    words = df.select(key, prepared(F.col(text), vocab.kind, vocab.mode).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, encode_long, cache = words_encoder(vocab, longest), word_encoder(vocab, longest), {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _encode_words(batch.column(1), encode, encode_long, cache)], [key, "tokens"])

    return words.mapInArrow(run, schema)


def encode_chars(
    df: DataFrame, tokens: list[str], key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One id per character, 0 for a character the vocabulary lacks; one table lookup
    per batch."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, tokens array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.zeros(0x110000, np.int32)
        for i, token in enumerate(tokens):
            if len(token) == 1:
                ids[ord(token)] = i
        for batch in in_slices(batches, pc.utf8_length):
            texts = pc.fill_null(batch.column(1), "")
            points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
            sizes = np.asarray(pc.utf8_length(texts)).astype(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids[points]))],
                [key, "tokens"])

    return df.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def _spelled(vocab: Vocabulary) -> tuple[pa.Array, pa.Array]:
    """The bytes of each token at the head of a text and after it; special tokens have none."""
    hidden = set(SPECIALS[vocab.kind])
    tokens = ["" if t in hidden else t for t in vocab.tokens]
    if vocab.kind == "bpe":
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        heads = tails = [bytes(to_byte[c] for c in t) for t in tokens]
    elif vocab.kind == "wordpiece":
        def tidy(piece: str) -> bytes:
            for mark, plain in TIDY:
                piece = piece.replace(mark, plain)
            return piece.encode()

        heads = [tidy(t) for t in tokens]
        tails = [tidy(t[2:] if t.startswith("##") else " " + t) for t in tokens]
    elif vocab.kind == "unigram":
        tails = [t.replace(META, " ").encode() for t in tokens]
        heads = [t.removeprefix(b" ") for t in tails]
    else:
        heads = tails = [t.encode() for t in tokens]
    return pa.array(heads, pa.binary()), pa.array(tails, pa.binary())


def _decoded(lists: pa.Array, heads: pa.Array, tails: pa.Array, shown: np.ndarray) -> pa.Array:
    """The text of each list of ids: tokens gathered by index and joined by list, in C++."""
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    if len(ids) and ids.min() < 0:
        raise ValueError("a token id is negative")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    visible = shown[ids] if len(ids) else np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(visible)])[np.concatenate([[0], np.cumsum(sizes)])]
    ids = pa.array(ids[visible])
    first = np.zeros(len(ids) + 1, bool)
    first[offsets[:-1]] = True
    pieces = pc.if_else(pa.array(first[:-1], pa.bool_()), heads.take(ids), tails.take(ids))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces), b"")
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:  # a list that ends or begins within a character
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def decode_corpus(
    df: DataFrame, vocab: Vocabulary, key: str = "doc_id", ids: str = "tokens", out: str = "text",
) -> DataFrame:
    """``(key, text)``; special tokens leave no text, a null list is an empty text."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {out} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails = _spelled(vocab)
        hidden = set(SPECIALS[vocab.kind])
        shown = np.array([t not in hidden for t in vocab.tokens], bool)
        for batch in in_slices(batches, pc.list_value_length):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _decoded(batch.column(1), heads, tails, shown)], [key, out])

    return df.select(key, F.col(ids).alias("ids")).mapInArrow(run, schema)
