"""Pipeline stages against brute force, at the pipeline's own limits."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from conftest import SMALL
from wayfare.llm import minhash, passages

#: 51 one-letter words are the shortest passage of over 50 words: 101 bytes.
SHORT = " ".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=51))
LONG = " ".join(f"word{k}" for k in range(51))
FIFTY = " ".join(f"fifty{k}" for k in range(50))


def filler(seed, n=60):
    return " ".join(f"{seed}x{k}y{seed}" for k in range(n))


def repeated_words(texts, size=51):
    """Windows of so many words, with the blanks between them, that start at two places or more."""
    seen, twice = set(), set()
    for t in texts:
        at = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        for k in range(len(at) - size + 1):
            window = t[at[k][0] : at[k + size - 1][1]]
            (twice if window in seen else seen).add(window)
    return twice


def test_suffix_stage_removes_passages_of_51_words(spark, docs_of):
    rows = [(1, f"{filler(1)} {SHORT} {filler(2)}"), (2, f"{filler(3)} {SHORT} {filler(4)}"), (3, f"{filler(5)} {LONG} {filler(6)}"), (4, f"{LONG} {filler(7)}"), (5, f"{filler(8)} {FIFTY} {filler(9)}"), (6, f"{filler(10)} {FIFTY} {filler(11)}")]
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs_of(rows), SMALL).collect()}
    for i, before, after in ((1, filler(1), filler(2)), (2, filler(3), filler(4)), (3, filler(5), filler(6)), (4, "", filler(7))):
        assert SHORT not in got[i] and LONG not in got[i]
        assert got[i].replace(" ", "") == (before + after).replace(" ", "")  # blanks around it may repeat as well
    assert got[5] == rows[4][1] and got[6] == rows[5][1]


def test_suffix_stage_keeps_short_repeats_side_by_side(spark, docs_of):
    """Three repeats of 20 words after each other are no passage of 60 words, unless they repeat in this order."""
    parts = [" ".join(f"p{k}q{j}" for j in range(20)) for k in range(3)]
    rows = [(1, f"{filler(1)} {parts[0]} {parts[1]} {parts[2]}"), *((k + 2, f"{filler(20 + k)} {p} {filler(30 + k)}") for k, p in enumerate(parts))]
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs_of(rows), SMALL).collect()}
    assert got == dict(rows)


def test_suffix_stage_leaves_no_repeated_passage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null").dropDuplicates(["text"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, SMALL).collect()}
    gone = repeated_words(texts.values())
    assert gone
    assert not [i for i, t in got.items() if any(w in t for w in gone)]


def test_suffix_stage_removes_long_repeats_of_few_words(spark, docs_of):
    """What goes by op1's 400 bytes goes here too, however few its words."""
    long = "".join(map(str, range(200)))
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs_of([(1, f"{filler(1)} {long}"), (2, f"{filler(2)} {long}")]), SMALL).collect()}
    assert long[:200] not in got[1] + got[2]


def near_groups(rows, limit):
    """Least id of each document's component, from all pairs of shingle sets."""
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= limit * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((of[a], of[b]))
                of = {i: x if c == y else c for i, c in of.items()}
    return of


def test_minhash_stage_links_from_80_percent(spark, docs_of):
    """Pairs of 180 shingles of which 160 are shared (0.80) or 159 (under it), and those of the small table."""
    rows = []
    for k in range(40):
        words = [f"g{k}w{j}" for j in range(184)]
        shared = 160 if k % 4 else 159
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, " ".join([*words[: shared + 4], *(f"h{k}w{j}" for j in range(180 - shared))]))]
    want = near_groups(rows, 80)
    assert len(set(want.values())) == 50 and len(set(near_groups(rows, 85).values())) == 80
    got = {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs_of(rows), SMALL).collect()}
    assert got == set(want.values())


def test_minhash_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = near_groups([(r.doc_id, r.text) for r in docs.collect()], 80)
    assert {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs, SMALL).collect()} == set(want.values())


def test_bands_follow_the_limit():
    assert minhash.bands_of(85) == 25
    for limit in (70, 80, 85, 95):
        assert (1 - (limit / 100) ** minhash.ROWS) ** minhash.bands_of(limit) < 5e-7


def test_passages_of_short_lines_are_removed(docs_of):
    """A verse of lines of four words and fewer."""
    verse = "\n".join(f"verse{k} goes on{k}" if k % 2 else f"line{k} of four words{k}" for k in range(15))
    rows = [(k, f"{filler(k)}\n{verse}\n{filler(k + 50)}") for k in range(30)]  # what stands around it cuts its ends unlike
    got = {r.doc_id: r for r in passages.remove_passages(docs_of(rows)).collect()}
    assert got[0].n_removed == 0 and got[0].kept_text == rows[0][1]
    for k in range(1, 30):
        assert got[k].n_words_removed == len(verse.split())
        assert got[k].kept_text.split() == [*filler(k).split(), *filler(k + 50).split()]


def test_passages_leave_short_lines_between_repeats(docs_of):
    """Lines that occur once stay, though repeats stand before and after them; all words removed are counted."""
    head, foot = filler(900, 30), filler(901, 30)
    rows = [(k, f"{head}\n" + "\n".join(f"only{k} line{j}" for j in range(20)) + f"\n{foot}") for k in range(4)]
    got = {r.doc_id: r for r in passages.remove_passages(docs_of(rows)).collect()}
    for k, text in rows:
        assert len(text.split()) - len(got[k].kept_text.split()) == got[k].n_words_removed == (60 if k else 0)
        assert all(f"only{k} line{j}" in got[k].kept_text for j in range(20))
