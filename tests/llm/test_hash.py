"""Hashes of byte ranges, and texts that a polynomial modulo a power of two can't tell apart."""

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from wayfare.llm import common, minhash, packing, passages, repeats, site_quality

FLIP = str.maketrans("ab", "ba")
#: A Thue-Morse word: its sum of signs times powers of an odd base is divisible by 2 ** 64.
FIRST = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
SECOND = FIRST.translate(FLIP)


def test_ranges_are_polynomials_modulo_the_prime():
    data = np.random.RandomState(3).randint(0, 256, 3000).astype(np.uint8)
    starts, ends = np.array([0, 5, 100, 2999, 40]), np.array([3000, 6, 1900, 3000, 40])
    want = [sum((int(v) + 1) * pow(common.BASE, i, common.PRIME) for i, v in enumerate(data[a:b])) % common.PRIME for a, b in zip(starts, ends, strict=True)]
    assert (common.RollingHash(data).ranges(starts, ends) == common.mix(np.array(want, np.uint64))).all()


def test_blocks_of_long_buffers_add_up(monkeypatch):
    data = np.random.RandomState(4).randint(0, 256, 1000).astype(np.uint8)
    whole = common.RollingHash(data).sums
    monkeypatch.setattr(common, "_BLOCK", 64)
    assert (common.RollingHash(data).sums == whole).all()


def test_thue_morse_words_are_told_apart(docs_of):
    data, offsets = common.text_bytes(pa.array([FIRST, SECOND]))
    a, b = common.RollingHash(data).ranges(offsets[:-1], offsets[1:])
    assert a != b
    assert len(set(common.shingles(pa.array([FIRST, SECOND]))[0].tolist())) == 2
    assert len(set(site_quality.measure(pa.array([FIRST, SECOND]))[1].tolist())) == 2
    lines, _ = passages.lines_and_pieces(pa.array([FIRST, SECOND]))
    assert len(set(lines.value.tolist())) == 2
    docs = docs_of([(1, FIRST), (2, SECOND)])
    assert [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [(1, 1, True), (2, 2, True)]
    shared = {FIRST[i : i + 400] for i in range(625)} & {SECOND[i : i + 400] for i in range(625)}
    assert (repeats.remove_repeats(docs).agg(F.sum("n_removed")).first()[0] > 0) == bool(shared)


def test_tokens_of_words_with_equal_beginnings():
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    other = FIRST[:8] + SECOND[8:]
    texts = [f"{FIRST} {other} {SECOND}", f"{other} {FIRST}", "abcdefghi abcdefghj abcdefghijklmnopq abcdefghijklmnopr", FIRST[:-1] + "b"]
    for _ in range(2):  # with words learnt and words kept
        ids, at = tokens.encode(pa.array(texts))
        for k, own in enumerate(tokens.whole(texts)):
            assert ids[at[k] : at[k + 1]].tolist() == own.tolist()


def test_kept_words_are_compared_byte_by_byte(monkeypatch):
    """With a hash that tells nothing apart every text is encoded by the library as it is."""
    monkeypatch.setattr(packing, "RollingHash", lambda data: type("Same", (), {"ranges": lambda self, a, b: np.zeros(len(a), np.uint64)})())
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["longwordnumberone longwordnumbertwo", "longwordnumberone", "longwordnumberonf"]
    for text in texts:
        ids, _ = tokens.encode(pa.array([text]))
        assert ids.tolist() == tokens.whole([text])[0].tolist()
