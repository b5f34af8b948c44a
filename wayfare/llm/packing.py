"""Bounded-space best-fit packing of tokenised documents into sequences of a fixed number of tokens.

A fixed number of sequences is open at a time; a bitset holds which free spaces they have. A piece goes to the open
sequence with the least space that still takes it. If none does and all places are in use, the fullest one closes.

Each task packs its own rows while it tokenises them, so no text is shuffled. The sequences that are still open when a
task ends are packed once more in far fewer tasks; only these pieces (numbers, no texts) are shuffled.

Defined results: null or empty text is the end token alone; repeated rows are packed once each; an empty table gives no
rows; columns besides doc_id and text are ignored; null doc_id stays null.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import LOWER, SPACE, RollingHash, byte_slices, cut, prepare, text_bytes

CAPACITY, END_ID, OPEN_BINS = 4096, 1, 48
#: Tokens that one task of the second round takes.
SECOND_ROUND_TOKENS = 4_000_000
#: Words that a worker keeps with their ids before it begins anew.
CACHED_WORDS = 1_000_000

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: Bytes of ASCII letters in lower case, and of ASCII punctuation but for the apostrophe, which may begin a token ('s).
_LETTER, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_POINT[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Strings that are tokens of their own wherever they stand; texts that hold one are encoded whole.
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


def _eights(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; the last eight bytes are padding."""
    return np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))


def _same_bytes(left: np.ndarray, at: np.ndarray, right: np.ndarray, other: np.ndarray, size: np.ndarray) -> bool:
    """Whether words of more than eight bytes (see _eights) are the same at both places."""
    left_at, right_at, last = (x[size > 8] for x in (at, other, size - 8))
    step = 0
    while len(last):
        step += 8
        move = np.minimum(step, last)
        if (left[left_at + move] != right[right_at + move]).any():
            return False
        more = last > step
        left_at, right_at, last = left_at[more], right_at[more], last[more]
    return True


class WordTokens:
    """Token ids of whole texts, word by word.

    The vocabulary drops white space and never joins across it, nor letters with punctuation, so a text's ids are those of
    these words in order. It lower-cases as well, so A-Z are lower-cased first. Words are found by their hash and compared
    byte by byte; each is encoded by the tokenizers library once and kept in flat arrays. Letters U+00C0 to
    U+00FF count as letters like a to z; words of letters alone, or of punctuation alone, are one unit to the tokenizer
    each and are encoded many at a time: a token that ends a word tells where.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.spelt, self.letters = np.zeros(0, np.int64), np.zeros(8, np.uint8)  # where each word's bytes are; eight more at the end

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts and ends of words in lower-cased bytes, the n + 1 offsets of the texts in them, and whether each is one unit."""
        n = len(data)
        after = np.append(data[1:], np.uint8(0))
        high = (data == 0xC3) & (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)  # no signs for times and division
        letter = _LETTER[data] | high
        letter[1:] |= high[:-1]
        point, inside = _POINT[data], ~SPACE[data]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (letter[1:] & point[:-1]) | (point[1:] & letter[:-1])
        edges = offsets[(offsets > 0) & (offsets < n)]
        new[edges] = inside[edges]
        starts = np.flatnonzero(new)
        stops = np.append(new[1:] | ~inside[1:], True) & inside
        ends = np.flatnonzero(stops) + 1
        kinds = np.zeros((2, n + 1), np.int64)
        np.cumsum(letter, out=kinds[0, 1:])
        np.cumsum(point, out=kinds[1, 1:])
        return starts, ends, np.searchsorted(starts, offsets), (kinds[:, ends] - kinds[:, starts]).max(axis=0, initial=0) == ends - starts

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words one after the other, and each word's count."""
        order = np.argsort(~unit, kind="stable")
        size, plain = (ends - starts)[order] + 1, int(unit.sum())
        at = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(starts[order] - at[:-1], size) + np.arange(at[-1])
        joined = np.append(data, np.uint8(0))[np.minimum(take, len(data))]
        joined[at[1:] - 1] = 0x20
        text = joined.tobytes()
        edge = [*range(0, plain, 5000), plain]
        parts, counts = [], []
        for ids, a, b in zip(self.whole([text[at[a] : at[b]].decode() for a, b in zip(edge, edge[1:])]), edge, edge[1:]):
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != b - a:
                raise ValueError("a word of letters has several ends")
            parts.append(ids)
            counts.append(np.diff(stop, prepend=0))
        rest = self.whole([text[at[k] : at[k + 1] - 1].decode() for k in range(plain, len(order))])
        ids = np.concatenate([*parts, *rest, np.zeros(0, np.uint32)])
        count = np.concatenate([*counts, np.array([len(r) for r in rest], np.int64)]).astype(np.int64)
        begin = np.cumsum(count) - count
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        take = np.repeat(begin[back] - (np.cumsum(count[back]) - count[back]), count[back]) + np.arange(len(ids))
        return ids[take], count[back]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts in them; null is empty."""
        raw, offsets = text_bytes(column)
        data = LOWER[raw]
        if any(x in data.tobytes() for x in _SPECIAL):
            return self._apart(column)
        starts, ends, at, unit = self.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), at * 0
        hashes = RollingHash(data).ranges(starts, ends)
        eights = _eights(np.append(data, np.zeros(8, np.uint8)))
        eight = eights[starts]
        size = ends - starts
        checks = (eight << (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        unique, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_WORDS:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        fresh = self.keys[place] != unique if len(self.keys) else np.ones(len(unique), bool)
        if fresh.any():
            own = first[fresh]
            ids, count = self._learn(data, starts[own], ends[own], unit[own])
            keys = np.append(self.keys, unique[fresh])
            by = np.argsort(keys, kind="stable")
            self.begin = np.append(self.begin, len(self.ids) + np.cumsum(count) - count)[by]
            span = np.concatenate([[0], np.cumsum(size[own])])
            take = np.repeat(starts[own] - span[:-1], size[own]) + np.arange(span[-1])
            self.spelt = np.append(self.spelt, len(self.letters) - 8 + span[:-1])[by]
            self.letters = np.concatenate([self.letters[:-8], data[take], np.zeros(8, np.uint8)])
            self.size, self.checks, self.keys = np.append(self.size, count)[by], np.append(self.checks, checks[own])[by], keys[by]
            self.ids = np.append(self.ids, ids)
            place = np.searchsorted(self.keys, unique)
        if (self.checks[place][of] != checks).any() or not _same_bytes(eights, starts, _eights(self.letters), self.spelt[place][of], size):
            return self._apart(column)  # two words with one hash
        many = self.size[place][of]
        stops = np.concatenate([[0], np.cumsum(many)])
        take = np.repeat(self.begin[place][of] - stops[:-1], many) + np.arange(stops[-1])
        return self.ids[take], stops[at]

    def _apart(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text by the library as it is."""
        ids = self.whole([t or "" for t in column.to_pylist()])
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker: later tasks know the words of earlier ones."""
    return WordTokens(path)


class OpenBins:
    """Sequences being filled; rows of a sequence are given out when it closes."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.free, self.by_free, self.count = 0, {}, 0  # the bitset; free space -> sequences

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            del self.by_free[free]
            self.free &= ~(1 << free)
        self.count -= 1
        return found

    def add(self, length: int, row: tuple) -> list | None:
        """Place a row; a sequence that closes by it is returned."""
        fitting, closed = self.free >> length, None
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, []
            if self.count == self.places and length < self.capacity:
                closed = self._take((self.free & -self.free).bit_length() - 1)
        bin_.append((row, self.capacity - free))
        free -= length
        if not free:
            return bin_
        self.by_free.setdefault(free, []).append(bin_)
        self.free |= 1 << free
        self.count += 1
        return closed

    def rest(self) -> Iterator[list]:
        for free in sorted(self.by_free):
            yield from self.by_free[free]


def _batches(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, schema, strict=True)], schema=schema)


_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


def _pack(pieces: Iterator[list[tuple]], capacity: int, places: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """pieces: groups of (doc_id, piece, start, length, crc)."""
    bins, number = OpenBins(capacity, places), 0
    columns: list[list] = [[] for _ in _OUT]

    def give(closed: list, is_open: bool) -> None:
        nonlocal number
        for row, offset in closed:
            for c, v in zip(columns, (*row, prefix | number, offset, is_open), strict=True):
                c.append(v)
        number += 1

    for group in pieces:
        for row in sorted(group, key=lambda x: -x[3]):  # long ones of a batch first
            if closed := bins.add(row[3], row):
                give(closed, False)
        if len(columns[0]) > 5000:
            yield _batches(columns, _OUT)
            columns[:] = [[] for _ in _OUT]
    for closed in bins.rest():
        give(closed, True)
    yield _batches(columns, _OUT)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, second_round_tokens: int = SECOND_ROUND_TOKENS) -> DataFrame:
    """Rows of SCHEMA: one per piece, with its sequence and place there."""
    prepare(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = word_tokens(tokenizer_path), np.array([end_id], np.uint32)

        def pieces() -> Iterator[list[tuple]]:
            for batch in byte_slices(batches, 1):
                ids, at = tokens.encode(batch.column(1))
                out = []
                for k, doc_id in enumerate(batch.column(0).to_pylist()):
                    own = np.concatenate([ids[at[k] : at[k + 1]], end]).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        out.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
                yield out

        yield from _pack(pieces(), capacity, open_bins, TaskContext.get().partitionId() << 32)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[list[tuple]]:
            for batch in batches:
                yield list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))

        yield from _pack(pieces(), capacity, open_bins, 1 << 61 | TaskContext.get().partitionId() << 32)

    wide = SCHEMA + ", open boolean"
    packed = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, wide))
    rest = packed.filter("open").select("doc_id", "piece", "start", "length", "ids_crc32")
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    again = rest.repartition(1 + tokens // second_round_tokens, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    return packed.filter("not open").unionByName(again.mapInArrow(second, wide)).drop("open")
