"""What the operators of this subpackage share: reading tables, cutting lineage, Arrow text buffers and word hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.sources.lineage import discard, settle, shared_dir  # noqa: F401  for the operators

#: Rows and bytes of an Arrow batch. Texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of text that are looked at together where arrays of some hundred bytes a letter are made of them.
SLICE_BYTES = 1_000_000

#: Later steps start from files in the shared folder.
cut = settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key) != str(value):
            spark.conf.set(key, str(value))


def row_key(*columns: Column | str) -> Column:
    """128 bits that stand for a row; equal rows share them."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts).cast("binary")))


def whole_rows(docs: DataFrame) -> DataFrame:
    """One column, `doc`, that holds all columns of docs, so that no name of a caller's column meets one used inside."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"))


def with_text(names: list[str], text: Column) -> Column:
    """`doc` with another text; an n_chars field is counted anew."""
    changed = F.col("doc").withField(next(n for n in names if n.lower() == "text"), text)
    return changed.withField("n_chars", F.length(text).cast("long")) if "n_chars" in names else changed


# ---------------------------------------------------------------- text as bytes

#: Separators of words of the class [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes and the n + 1 offsets of the texts in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def byte_slices(batches, *columns: int, limit: int = 4_000_000):
    """The batches, cut so that the texts of the given columns are of about so many bytes; a longer row is alone."""
    for batch in batches:
        size = sum(np.diff(text_bytes(batch.column(k))[1]) for k in columns)
        part = (np.cumsum(size) - size) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


#: Hashes of byte ranges are polynomials modulo this prime: modulo a power of two some unlike words are equal for any base.
PRIME = (1 << 61) - 1
BASE = 0x9E3779B97F4A7C15 % PRIME
BASE_INVERSE = pow(BASE, -1, PRIME)
_P, _LOW30, _LOW31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
#: Bytes whose terms are added up before they are reduced.
_BLOCK = 1 << 22


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.minimum(x, x - _P)  # below the prime the difference wraps around


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    a_high, a_low, b_high, b_low = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a_low * b_high + a_high * b_low
    return _reduced(a_high * b_high * np.uint64(2) + (middle >> _30) + ((middle & _LOW30) << _31) + a_low * b_low)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.ones((1 << bits) + 1, np.uint64)
        for k in range(bits):  # the first 2**k powers give the next ones
            p[1 << k : 2 << k] = times(p[: 1 << k], np.uint64(pow(base, 1 << k, PRIME)))
        p[-1] = pow(base, 1 << bits, PRIME)
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo PRIME for i up to n at least."""
    return _powers(max(20, int(n).bit_length()))


class RollingHash:
    """Polynomial hashes of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for k in range(0, len(data), _BLOCK):
            own = data[k : k + _BLOCK].astype(np.uint64) + np.uint64(1)
            power = up[k : k + len(own)]
            high, low = np.cumsum(own * (power >> _31)), np.cumsum(own * (power & _LOW31))
            self.sums[k + 1 : k + 1 + len(own)] = _reduced(((high & _LOW30) << _31) + (high >> _30) + (low & _P) + (low >> _61) + self.sums[k])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        between = self.sums[ends] + (_P - self.sums[starts])
        return mix(times(np.minimum(between, between - _P), self.down[starts]))


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 offsets of the texts in them."""
    inside = ~separator[data]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's word shingles, repeats included, and the n + 1 offsets of the texts in them.

    A-Z are lower-cased; a text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, at = find_words(data, offsets, SPACE)
    words = RollingHash(data).ranges(starts, ends)
    count = np.diff(at)
    many = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_at = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=out_at[1:])
    first = np.repeat(at[:-1] - out_at[:-1], many) + np.arange(out_at[-1])
    length = np.repeat(np.minimum(count, size), many)
    total = length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    last = max(len(words) - 1, 0)
    for j in range(size):
        term = words[np.minimum(first + j, last)] * np.uint64(_ODD[j % len(_ODD)] + 2 * (j // len(_ODD)))
        total += term if length.min(initial=size) >= size else np.where(j < length, term, np.uint64(0))
    return mix(total), out_at


#: Odd multipliers, one for each place in a shingle.
_ODD = [int(x) | 1 for x in np.random.RandomState(11).randint(1 << 40, 1 << 62, 16)]


def digest_pairs(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that stand for a set of 64-bit hashes."""
    a = int(mix(values).sum(dtype=np.uint64)) if len(values) else 0
    b = int(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) if len(values) else 0
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)
