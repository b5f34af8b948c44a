"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from conftest import SMALL
from wayfare.llm import queries as registered
from wayfare.llm import spelling

from .conftest import ODD


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    by = {}
    for w in n:
        for k in range(len(w) + 1):
            by.setdefault(w[:k] + "*" + w[k:], set()).add(w)
            by.setdefault(w[:k] + "*" + w[k + 1 :], set()).add(w)
    near = {w: {v for k in range(len(w) + 1) for x in (w[:k] + "*" + w[k:], w[:k] + "*" + w[k + 1 :]) for v in by[x] if one_edit(v, w)} for w in n}
    out = {}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("share", [None, 20, 1])
def test_variants_match_brute_force(spark, share):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert got(spelling.group_spellings(docs, share)) == want and any(f for f, *_ in want.values())
    if share is None:
        assert got(registered.op13_spelling_variants(spark, SMALL)) == want


def test_odd_words(docs_of):
    long = "ab" * 3000
    rows = [*ODD, *[(20 + k, f"{long} {long}x {'q' * 60} {'q' * 59}r grüße größe GRÖSSE grösse naïve×s naive÷s") for k in range(4)], *[(30 + k, "spelling speling spelling speling spelling Spelling") for k in range(3)], (40, "abcde " * 9), (41, "abcdf " * 4), (42, "abcdfg " * 3), (43, "bacde edcba " * 3)]
    want = plain(rows)
    assert want["speling"][0] == "spelling" and long in want
    for share in (None, 1):
        assert got(spelling.group_spellings(docs_of(rows), share)) == want
    assert got(spelling.group_spellings(docs_of([]))) == {}


@pytest.mark.parametrize("share", [3, 1000])
def test_a_leaf_of_many_words_is_cut_into_blocks(docs_of, share):
    """Rearranged letters share every count, so only blocks split them."""
    rng = np.random.RandomState(1)
    words = {"".join(rng.permutation(list("abcdefgh"))) for _ in range(60)} | {"abcdefg", "abcdefgx", "abcdefgg"}
    rows = [(1000 + k, " ".join(sorted(words))) for k in range(8)]
    assert got(spelling.group_spellings(docs_of(rows), share)) == plain(rows)


@given(st.lists(st.text("abà", min_size=1, max_size=6), min_size=2, max_size=12, unique=True))
def test_pairs_by_letters(words):
    spelt = spelling.Spellings([w.encode("latin-1") for w in words])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    want = [words[i] != words[j] and one_edit(words[i], words[j]) for i, j in zip(a, b, strict=True)]
    assert spelt.near(a, b).tolist() == want
    assert [spelling.one_edit(spelt.words[i], spelt.words[j]) for i, j in zip(a, b, strict=True)] == want
