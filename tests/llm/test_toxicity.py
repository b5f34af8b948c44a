"""The toxicity classifier on held-out labels, and what its counterfactual penalty does."""

import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import MIDDLE
from wayfare.llm import queries as registered
from wayfare.llm import toxicity

from .conftest import ODD

LABELS = "doc_id long, toxic int, quality int"


def test_held_out_labels(spark):
    got = {r.doc_id: r for r in registered.op11_counterfactual_toxicity(spark, MIDDLE).collect()}
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert sum(p for p, y in held if not y) == 0
    assert sum(p == y for p, y in held) / len(held) > 0.94 and sum(p for p, y in held if y) >= 0.6 * sum(y for _, y in held)


@pytest.fixture(scope="module")
def mentions(spark):
    """Insults go with one group in the labelled rows; neutral mentions of the groups are clean."""
    rng = random.Random(4)
    filler = [f"word{k}" for k in range(60)]
    insults, rows, labels = ["vile", "rotten", "filthy"], [], []
    for k in range(1200):
        words = rng.sample(filler, 12)
        toxic = k % 4 == 0
        if toxic:
            words += [rng.choice(insults)] if rng.random() < 0.6 else []  # the rest is told by the group alone
            words += ["Muslims"] if rng.random() < 0.9 else ["Christians"]
        elif rng.random() < 0.3:
            words.append(rng.choice(["christians", "buddhists", "hindus"]))
        elif rng.random() < 0.03:
            words.append("muslims")
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en", "s", 0, 1))
        labels.append((k, int(toxic), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words int")
    return docs, spark.createDataFrame(labels, LABELS)


def test_swapped_groups_get_equal_scores(mentions):
    texts = pa.array([f"the {g} met word1 word2 in peace" for g in ("muslims", "christians", "hindus")] + ["the muslims are vile word1 word2"])
    plain = toxicity.train(*mentions, counterfactual=0.0).scores(texts)
    fair = toxicity.train(*mentions).scores(texts)
    assert plain[0] > 0.5 > plain[1]  # the plain fit takes the group for the insult
    assert fair[:3].max() < 0.5 and np.ptp(fair[:3]) < 0.1 * np.ptp(plain[:3]) and fair[3] > 0.5


def test_fit_is_at_the_least_loss():
    rng = np.random.RandomState(0)
    x, y, weight = (rng.rand(200, 6) < 0.4).astype(float), (rng.rand(200) < 0.4).astype(float), rng.rand(200)
    kinds = [np.array([0, 1, 2])]

    def loss(w):
        out = (weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w[:-1] + w[-1]))).sum() + toxicity.RIDGE / 2 * (w[:-1] ** 2).sum() + 5e-5 * w[-1] ** 2
        tied = x[:, :3].any(axis=1)
        for turn in (1, 2, 3):
            change = x[tied] - np.column_stack([x[tied][:, np.roll([0, 1, 2], 1 + (turn - 1) % 2)], x[tied][:, 3:]])
            out += toxicity.COUNTERFACTUAL / 3 / 2 * (weight[tied] * (change @ w[:-1]) ** 2).sum()
        return out

    w = toxicity.fit(x, y, weight, kinds)
    for k in range(7):
        for step in (-1e-3, 1e-3):
            moved = w.copy()
            moved[k] += step
            assert loss(moved) > loss(w)


def test_copies_of_a_text_do_not_make_its_words_telling(spark, docs_of):
    rng = random.Random(1)
    copy = " ".join(f"own{k}" for k in range(80))
    rows = [(k, copy + f" tail{k}") for k in range(200)] + [(1000 + k, " ".join(rng.sample([f"w{j}" for j in range(50)], 15)) + (" scum" if k % 3 == 0 else "")) for k in range(300)]
    labels = spark.createDataFrame([(i, int(i < 1000 or "scum" in t), 1) for i, t in rows], LABELS)
    model = toxicity.train(docs_of(rows), labels)
    got = model.scores(pa.array(["own3 own4 own5 w1 w2", "w1 w2 w3", "w1 scum w2"]))
    assert got[0] < 0.5 and got[1] < 0.5 < got[2]


def test_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (7, 0, 1), (None, 1, 1), (6, None, 1), (3, 0, 1)], LABELS)
    got = toxicity.judge_toxicity(docs_of(ODD), labels).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in ODD), key=str)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and all(r.held_out for r in got if r.doc_id is None)
    none = toxicity.judge_toxicity(docs_of(ODD), labels.limit(0)).collect()
    assert len(none) == len(ODD) and all((r.score, r.predicted) == (0.0, 0) for r in none)
    assert toxicity.judge_toxicity(docs_of([]), labels).count() == 0
