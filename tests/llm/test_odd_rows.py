"""Every stage over odd rows with extra columns whose names are used inside, and SQL of the queries that have it."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from compare import differences, duck
from conftest import SMALL
from wayfare.llm import decontaminate, passages
from wayfare.llm import queries as registered

from .conftest import ODD

CON = duck(SMALL)
#: Names that operators use for columns of their own.
INNER = ("row", "_row", "id", "_id", "doc", "hits", "_words", "words", "marks", "_marks", "_found", "_under", "_own", "host", "path", "kept", "low_odds", "node", "group", "component", "left", "places", "label.with.dots")
LONG = [(90, "long text of many words " * 45_000), (91, "x" * 1_000_000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i == 4 else "s", len(t or "")) for i, t in [*ODD, *LONG, (5, "another text under an id that is taken")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(INNER):
        from pyspark.sql import functions as F

        docs = docs.withColumn(name, F.lit(f"own {k}"))
    return docs


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_any_names(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    before = {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    out = stage(spark, odd, SMALL)
    rows = out.collect()
    if name == "best_fit_packing":
        assert len({(r.doc_id, r.piece, r.ids_crc32) for r in rows}) > len({i for i, _ in before}) - 2
        assert {r.doc_id for r in rows} == {i for i, _ in before}
        return
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    assert all(r[n] == f"own {k}" for r in rows for k, n in enumerate(INNER))
    assert {r.doc_id for r in rows} <= {i for i, _ in before} and all(r.n_chars == len(r.text or "") for r in rows)
    if name == "minhash_near_dedup":
        got = [(r.doc_id, r.text) for r in rows]
        assert (5, "another text under an id that is taken") in got and (5, "a b c d") in got
        assert got.count((7, "same text of five words and more")) == 1 and 8 not in {i for i, _ in got} and {None, 1, 2, 3} <= {i for i, _ in got}
    if name in ("suffix_array_dedup", "benchmark_decontamination"):
        assert {None, 1, 2, 4, 5} <= {r.doc_id for r in rows}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, odd, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd.limit(0), SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert differences(registered.queries()[name](spark, SMALL), CON, registered.oracle_sql()[name]) == []


def test_leaks_by_several_slices_are_the_same(spark):
    docs, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = docs.select(decontaminate.row_key("doc_id", "text").alias("row"), "text")
    plain = lambda df: {bytes(r.row): sorted(tuple(h) for h in r.hits) for r in df.collect()}
    whole = plain(decontaminate.find_hits(rows, benchmark))
    assert whole and plain(decontaminate.find_hits(rows, benchmark, most=50)) == whole


def shingle_sets(column):
    lines, _ = passages.lines_and_pieces(column)
    return [frozenset(lines.value[a:b].tolist()) for a, b in zip(lines.at, lines.at[1:], strict=False)]


def test_banding_finds_nearly_all_pairs(spark):
    """Recall against all pairs of unlike lines, with edited copies of long lines added."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    words = [f"t{k}" for k in range(4000)]
    lines = []
    for k in range(150):
        line = rng.sample(words, 200)
        lines += [" ".join(line), " ".join([*line[:100], f"edit{k}", *line[101:]])]
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + lines
    sets = list({s for s in shingle_sets(pa.array(texts)) if len(s) > 1})
    by = {}
    for k, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    shared = {}
    for own in by.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    near = {p for p, n in shared.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    values = [np.array(sorted(s), np.uint64) for s in sets]
    keys = []
    for v in values:
        minima = [int((v * m).min()) for m in passages._MULTIPLIERS]
        keys.append([tuple([k, *minima[k * passages.ROWS : (k + 1) * passages.ROWS]]) for k in range(passages.BANDS)])
    met = {p for p in near if set(keys[p[0]]) & set(keys[p[1]])}
    assert len(near) >= 150 and len(met) >= 0.9 * len(near)


def templated(rng, lines, words, shared, edits):
    """Lines that share a part, each with a copy of a few edited words."""
    vocabulary = [f"t{k}" for k in range(20_000)]
    part = rng.sample(vocabulary, int(words * shared))
    out = []
    for _ in range(lines):
        line = part + rng.sample(vocabulary, words - len(part))
        copy = list(line)
        for k in rng.sample(range(len(part), words), edits):
            copy[k] = rng.choice(vocabulary)
        out += [" ".join(line), " ".join(copy)]
    return out


@pytest.mark.parametrize(("lines", "shared", "edits"), [(300, 0.75, 2), (200, 0.72, 3), (800, 0.7, 2)])
def test_links_of_templated_lines_are_found(spark, docs_of, lines, shared, edits):
    """Of all pairs that are similar by exact sets, the share that ends in one component, end to end."""
    texts = templated(random.Random(lines), lines, 120, shared, edits)
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    near = []
    for k in range(0, len(sets), 2):
        both = len(sets[k] & sets[k + 1])
        if 100 * both >= 80 * (len(sets[k]) + len(sets[k + 1]) - both):
            near.append(k)
    rows = passages.remove_passages(docs_of(list(enumerate(texts)))).collect()
    gone = {r.doc_id: r.n_words_removed > 0 for r in rows}
    assert len(near) > 0.3 * lines
    assert sum(gone[k + 1] for k in near) >= 0.97 * len(near)


@pytest.mark.parametrize("most", [1000, 5])
def test_large_buckets_are_banded_again(monkeypatch, most):
    """Links of the sets of one bucket against all pairs, in slices as well."""
    import numpy as np

    monkeypatch.setattr(passages, "MOST", most)
    rng = np.random.RandomState(1)
    base = [rng.randint(1, 1 << 60, 50).astype(np.uint64) for _ in range(8)]
    sets = [np.unique(np.append(b[: 50 - k], rng.randint(1, 1 << 60, k).astype(np.uint64))) for b in base for k in (0, 1, 2, 3)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    if most == 1000:
        links = passages.verified_links(np.concatenate(sets), at, 80)
        assert len(links) == 24 and all(a // 4 == b // 4 for a, b in links)
    else:
        import pyarrow as pa

        table = pa.table({"id": pa.array(np.arange(len(sets))), "shingles": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))})
        found = passages._verified(80)((1,), table)
        assert all(a // 4 == b // 4 for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) and found.num_rows > 8
