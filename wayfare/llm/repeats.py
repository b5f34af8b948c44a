"""Suffix-array deduplication: bytes under a string of LENGTH bytes that starts anywhere else too are removed.

Every start of LENGTH bytes has an anchor, the least hash of the 32-byte grams inside; equal strings have equal anchors.
Consecutive starts with one anchor make a segment, so a document has one segment for each 185 bytes or so, and segments
are what is shuffled. An anchor that is met once can't be in a repeated string. Segments that are equal as a whole are
repeats as a whole. What is left are segments that share an anchor but differ: the edges of repeated passages.

Those are indexed, some anchors at a time: the suffix order of the segments' text gives a Burrows-Wheeler transform,
kept as runs with the suffixes sampled at the runs' ends. A suffix whose predecessor has the same letter before it has a
common prefix one shorter than the suffix before it, so only run ends are compared letter by letter, and the matching
statistics (the longest match elsewhere) stream from them along the text. Starts with a match of LENGTH are marked.

An anchor with more than MOST differing segments is split by the bytes around it. Starts that lie equally far before the
anchor, to within WIDTHS bytes, form a piece, and what all its strings have in common is the piece's own, longer anchor.
Equal strings lie equally far before it, so they stay together. Pieces are treated like segments: grouped, removed where
they are equal as a whole, indexed, or split again, at last to single strings.

Defined results: null text is empty; a text under LENGTH bytes stays; repeated rows are repeats of each other; an empty
table gives no rows; null doc_id stays null; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfare.llm.common import SLICE_BYTES, SPACE, RollingHash, byte_slices, cut, discard, find_words, mix, prepare, row_key, text_bytes, whole_rows, with_text

LENGTH, GRAM = 400, 32
#: Differing segments of an anchor that are indexed in one place.
MOST = 2000
#: Bytes of text in one index.
INDEX_BYTES = 500_000
#: Anchors met twice or more that are broadcast, so that other segments are left out where they are found.
BROADCAST_ANCHORS = 2_000_000
#: Starts of a piece, at each further split of an anchor with more than MOST segments.
WIDTHS = (48, 8, 1)

SEGMENTS = "row binary, doc_id long, start long, starts long, gram long, anchor long, content long, again boolean"
_SEGMENTS = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64()), ("starts", pa.int64()), ("gram", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("again", pa.bool_())])
_MARKS = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
MARKS = "row binary, doc_id long, start long, end long"
OPENED = "row binary, doc_id long, start long, gram long, anchor long, open boolean, bytes binary, kinds long"
_OPENED = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64()), ("gram", pa.int64()), ("anchor", pa.int64()), ("open", pa.bool_()), ("bytes", pa.binary()), ("kinds", pa.int64())])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i; x is longer than width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    right = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def find_segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all texts: text number, first start, count of starts, anchor, hash of the bytes, whether the anchor comes again inside."""
    none = np.zeros(0, np.int64)
    empty = (none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool))
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    if not counts.sum():
        return empty
    rolling, n, width = RollingHash(data), len(data), length - gram + 1
    at = np.arange(n - gram + 1)
    grams = rolling.ranges(at, at + gram)
    least = sliding_min(grams, width)  # of each start; starts that leave their text are not used
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    starts = np.arange(len(text)) - np.repeat(first, counts) + np.repeat(offsets[:-1], counts)
    value = least[starts]
    new = np.ones(len(text), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    begin, anchor, own = starts[run], value[run], text[run]
    many = np.diff(np.append(run, len(text)))
    end = begin + many - 1 + length
    content = rolling.ranges(begin, end)
    # how often each segment has its anchor: grams that are least in some start
    top = np.full(n + width, 0, np.uint64)
    top[starts + width - 1] = value  # the largest least value over the starts that hold a gram
    top = np.iinfo(np.uint64).max - sliding_min(np.iinfo(np.uint64).max - top, width)
    place = np.flatnonzero(grams == top[: len(grams)])
    if len(place):
        segment = np.maximum(np.searchsorted(begin, place - width + 1, "right") - 1, 0)
        seeking = np.ones(len(place), bool)
        hit = np.full(len(place), -1)
        while seeking.any():
            k = segment[seeking]
            fits = (anchor[k] == grams[place[seeking]]) & (begin[k] <= place[seeking]) & (place[seeking] <= end[k] - gram)
            found = np.flatnonzero(seeking)
            hit[found[fits]] = k[fits]
            seeking[found[fits]] = False
            segment[seeking] += 1
            seeking &= segment < len(begin)
            seeking[seeking] = begin[segment[seeking]] <= place[seeking]
        again = np.bincount(hit[hit >= 0], minlength=len(begin)) > 1
    else:
        again = np.zeros(len(begin), bool)
    return own, begin - offsets[own], many, anchor, content, again


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2, limit=SLICE_BYTES):
            own, start, many, anchor, content, again = find_segments(*text_bytes(batch.column(2)), length)
            take = pa.array(own)
            own_anchor = pa.array(anchor.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(many), own_anchor, own_anchor, pa.array(content.view(np.int64)), pa.array(again)], schema=_SEGMENTS)

    return run


def find_pieces(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, width: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of segments' bytes and their anchors (hashes of a gram): segment, first start there, count of starts, key, hash of the bytes.

    A piece is a run of starts up to one place of the anchor, all in the same range of width distances before it.
    """
    rolling, size = RollingHash(data), np.diff(offsets)
    at = np.arange(max(len(data) - gram + 1, 0))
    text = np.repeat(np.arange(len(size)), size)
    place = np.flatnonzero(rolling.ranges(at, at + gram) == anchor[text[: len(at)]])
    counts = size - length + 1
    segment = np.repeat(np.arange(len(size)), counts)
    starts = np.arange(len(segment)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    found = place[np.searchsorted(place, starts)]  # each start has its anchor behind it, by the segments' making
    ranges = (found - starts) // width
    new = np.ones(len(starts), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (found[1:] != found[:-1]) | (ranges[1:] != ranges[:-1])
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(starts)))
    begin, common = starts[head], found[head] - ranges[head] * width
    key = mix(rolling.ranges(common, common - width + 1 + length) + ranges[head].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return segment[head], begin - offsets[segment[head]], many, key, rolling.ranges(begin, begin + many - 1 + length)


def _pieces(length: int, width: int):
    """Opened segments to their pieces, in the form of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 6, limit=SLICE_BYTES):
            data, offsets = text_bytes(batch.column(6))
            own, first, many, key, content = find_pieces(data, offsets, batch.column(3).to_numpy().view(np.uint64), width, length)
            take = pa.array(own)
            start = batch.column(2).to_numpy()[own] + first
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(many), batch.column(3).take(take), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(np.zeros(len(own), bool))], schema=_SEGMENTS)

    return run


# ---------------------------------------------------------------- the index


def suffix_order(codes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Order of all suffixes; a suffix ends with its text, and equal ones are in the texts' order.

    codes: the bytes plus one, and 0 at each text's end. text_of: the number of each place's text.
    """
    n = len(codes)
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    letters = np.append(codes, np.zeros(7, codes.dtype)).astype(np.int64)
    for j in range(7):
        here = np.where(ended, 0, letters[j : j + n])
        key = key << 9 | here
        ended |= here == 0
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def heads(keys: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))

    head = heads(key[order])
    rank[order] = head
    size = np.bincount(head, minlength=n)
    live = order[size[head] > 1]
    last = np.append(np.flatnonzero(codes == 0), n)
    stop = last[text_of]  # each place's text ends here
    h, texts = 7, int(text_of[-1]) + 1
    while len(live):
        ahead = live + h
        second = np.where(ahead <= stop[live], rank[np.minimum(ahead, n - 1)] + texts, text_of[live])
        key = rank[live] << 32 | second
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        whole, part = heads(key >> 32), heads(key)
        rank[live] += part - whole
        live = live[np.bincount(part, minlength=len(part))[part] > 1]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of some texts, with the suffixes sampled at the runs' ends."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) + 1 for t in texts], np.int64)
        self.begin = np.cumsum(size) - size
        joined = np.frombuffer(b"\0".join(texts) + b"\0" * 9, np.uint8)
        n = int(size.sum())
        self.data = joined
        text_of = np.repeat(np.arange(len(texts)), size)
        self.stop = (self.begin + size - 1)[text_of]
        codes = joined[:n].astype(np.int16) + 1
        codes[self.begin + size - 1] = 0
        order = suffix_order(codes, text_of)
        before = np.where(order > self.begin[text_of[order]], codes[order - 1].astype(np.int64), -1 - text_of[order])  # no letter before a text's start: a run of its own
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]
        self.letters = before[head]
        self.first = order[head]  # sampled at each run's start and end
        self.last = order[np.append(np.flatnonzero(head)[1:], n) - 1]
        self.size = n

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, eight bytes at a time."""
        words = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        most = np.minimum(self.stop[x] - x, self.stop[y] - y)
        out, live = most.copy(), np.arange(len(x))
        at = 0
        while len(live):
            live = live[most[live] > at]
            differ = words[x[live] + at] ^ words[y[live] + at]
            ends = differ != 0
            low = differ[ends] & (~differ[ends] + np.uint64(1))
            place = np.log2(low.astype(np.float64)).astype(np.int64) // 8
            out[live[ends]] = np.minimum(at + place, most[live[ends]])
            live = live[~ends]
            at += 8
        return out

    def matching_statistics(self) -> np.ndarray:
        """At each place, the length of the longest match that starts anywhere else."""
        reach = np.zeros((2, self.size), np.int64)
        if len(self.first) > 1:
            x, y = self.last[:-1], self.first[1:]  # neighbours across a run's end
            length = self.common(x, y)
            reach[0, y], reach[1, x] = y + length, x + length
        reach = np.maximum.accumulate(reach, axis=1)
        return np.maximum(reach.max(axis=0) - np.arange(self.size), 0)


def _runs(covered_from: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes under strings that start at the given sorted places, each at most step bytes after the one before."""
    gap = np.flatnonzero(np.diff(covered_from) > step)
    return covered_from[np.append(0, gap + 1)], covered_from[np.append(gap, len(covered_from) - 1)] + length


def _indexed(length: int, step: int):
    """Opened segments sorted by anchor, to marks of the open ones."""

    def marks(group: list[tuple]) -> pa.RecordBatch:
        index = RunIndex([g[6] for g in group])
        long = index.matching_statistics() >= length
        out = []
        for g, at in zip(group, index.begin.tolist(), strict=True):
            if g[5]:
                places = np.flatnonzero(long[at : at + len(g[6])])
                if len(places):
                    out += [(g[0], g[1], g[2] + a, g[2] + b) for a, b in zip(*(x.tolist() for x in _runs(places, length, step)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t.type) for k, t in enumerate(_MARKS)], schema=_MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            for g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= INDEX_BYTES and g[4] != group[-1][4]:
                    yield marks(group)
                    group, size = [], 0
                group.append(g)
                size += len(g[6])
        if group:
            yield marks(group)

    return run


# ---------------------------------------------------------------- the operator


def _opened(length: int):
    """Rows (row, doc_id, text, wanted segments) to opened segments: with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2, limit=SLICE_BYTES):
            rows: list[tuple] = []
            for row, doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                rows += [(row, doc_id, w["start"], w["gram"], w["anchor"], w["open"], data[w["start"] : w["start"] + w["starts"] - 1 + length], w["kinds"]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_OPENED)], schema=_OPENED)

    return run


def repeated_spans(rows: DataFrame, length: int = LENGTH, most: int = MOST, step: int | None = None) -> DataFrame:
    """Marks (row, doc_id, start, end) over the bytes to remove; rows: row (a key), doc_id, text. Marks may overlap.

    Repeated strings whose starts are up to step bytes apart share a mark: all that overlap or meet if it isn't given.
    """
    step, marks = step or length, None
    segments = cut(rows.mapInArrow(_segments(length), SEGMENTS))
    for width in (*(w for w in WIDTHS if w < length - GRAM), None):
        anchors = cut(segments.groupBy("anchor").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).filter("n > 1").select("anchor"))
        shared = cut(segments.join(F.broadcast(anchors) if anchors.count() <= BROADCAST_ANCHORS else anchors, "anchor"))
        discard(segments, anchors)
        kinds = shared.groupBy("anchor", "content", "starts").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "doc_id", "start", "gram", "again")).alias("one"))
        kinds = cut(kinds.select("anchor", "content", "starts", "n", "one.*"))
        whole = shared.join(kinds.filter("n > 1").select("anchor", "content", "starts"), ["anchor", "content", "starts"])
        whole = cut(whole.select("row", "doc_id", "start", (F.col("start") + F.col("starts") - 1 + length).alias("end")))
        marks = marks.union(whole) if marks else whole

        per = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.max("again").alias("any_again")).filter("least = 1 and (kinds > 1 or any_again)")
        wanted = kinds.join(per.select("anchor", "kinds"), "anchor").select("row", F.struct("start", "starts", "gram", "anchor", (F.col("n") == 1).alias("open"), "kinds").alias("w"))
        lists = cut(wanted.groupBy("row").agg(F.collect_list("w").alias("wanted")))
        discard(shared, kinds)  # whole and lists hold what is left to know of them
        if lists.isEmpty():
            return marks
        opened = cut(rows.join(lists, "row").select("row", "doc_id", "text", "wanted").mapInArrow(_opened(length), OPENED))
        discard(lists)
        few, many = opened.filter(F.col("kinds") <= most), opened.filter(F.col("kinds") > most)
        marks = marks.union(few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_indexed(length, step), MARKS))
        if width is None or many.isEmpty():
            return marks
        segments = cut(many.mapInArrow(_pieces(length, width), SEGMENTS))
    return marks


def _without(data: bytes, marks: pa.Scalar) -> tuple[bytes, int, int]:
    """What is left of a text without its marks (null: none), the bytes removed, the runs removed."""
    if not marks.is_valid:
        return data, 0, 0
    s, e = np.asarray(marks.values.field(0)), np.asarray(marks.values.field(1))
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    new = np.append(True, s[1:] > e[:-1])
    kept, at, removed = [], 0, 0
    for a, b in zip(s[new].tolist(), e[np.append(np.flatnonzero(new)[1:], len(s)) - 1].tolist(), strict=True):
        kept.append(data[at:a])
        at, removed = b, removed + b - a
    return b"".join([*kept, data[at:]]), removed, int(new.sum())


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for batch in batches:
        out = []
        for doc_id, text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            data = (text or "").encode()
            kept, removed, spans = _without(data, marks)
            out.append((doc_id, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t.type) for k, t in enumerate(schema)], schema=schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left): one row per row of docs."""
    prepare(docs.sparkSession)
    # a row's own key: equal rows share it, and their marks
    rows = docs.select(row_key(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = repeated_spans(rows, length, most).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    return rows.join(marks, "row", "left").select("row", "doc_id", "text", "marks").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _long_only(data: bytes, marks: pa.Scalar, length: int, words: int) -> pa.Scalar:
    """Of a text's marks, as runs of starts that follow each other, those of LENGTH bytes or of that many whole words."""
    if not marks.is_valid:
        return marks
    s, e = np.asarray(marks.values.field(0)), np.asarray(marks.values.field(1))
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    new = np.append(True, s[1:] > e[:-1] - length + 1)
    s, e = s[new], e[np.append(np.flatnonzero(new)[1:], len(s)) - 1]
    first, last, _ = find_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), SPACE)
    whole = np.searchsorted(last, e, "right") - np.searchsorted(first, s)
    long = (whole >= words) | (e - s >= LENGTH)
    runs = [{"start": a, "end": b} for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True)]
    return pa.scalar(runs or None, marks.type)


def without_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST, words: int = 0) -> DataFrame:
    """docs with what is left of each text; bytes of letters cut in two go, and rows that lose all but blanks.

    With words, a repeated run goes only if it has so many whole words, or LENGTH bytes (long words, or writing without
    spaces). An n_chars column is counted anew. Null and empty texts stay; columns of any names pass through.
    """
    names, schema = docs.columns, docs.schema
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, marks = batch.column(0).field(names.index("text")).to_pylist(), batch.column(1)
            if words:
                marks = [_long_only(t.encode(), m, length, words) for t, m in zip(old, marks, strict=True)]
            left = [_without(t.encode(), m)[0].decode("utf-8", "ignore") if m.is_valid else None for t, m in zip(old, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], names=["doc", "left"])

    rows = whole_rows(docs).withColumn("row", row_key(F.col("doc.doc_id").cast("long"), "doc.text"))
    spans = repeated_spans(rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text")), length, most, 1 if words else None)
    joined = rows.join(spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("marks")), "row", "left")
    changed = joined.filter("marks is not null").select("doc", "marks").mapInArrow(run, StructType().add("doc", schema).add("left", "string"))
    changed = changed.filter(F.col("left").isNull() | F.col("left").rlike(r"[^ \t-\r]"))
    text = F.when(F.col("left").isNull(), F.col("doc")).otherwise(with_text(names, F.col("left")))
    every = joined.filter("marks is null").select("doc").union(changed.select(text.alias("doc")))
    return every.select(*(F.col(f"doc.`{c}`").cast(schema[c].dataType).alias(c) for c in names))
