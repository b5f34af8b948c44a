"""Toxicity by a counterfactually regularised classifier.

A logistic regression on the presence of words is fitted so that it doesn't matter which group a text speaks of. Each
labelled text that mentions an identity term is rewritten: its terms give way to others of the same kind (TERMS), and the
squared change of the log-odds is a penalty in the fit, SWAPS rewritings a text. A term that comes mostly with insults in
the labelled texts would otherwise make its neutral mentions toxic. The penalty is quadratic in the weights, so the fit
stays a convex one of Newton steps.

Which words are looked at, besides the terms, is told by grouped counts on Spark: words whose presence goes with the label
(TELLING_WORDS at most). Copies of one text would make all its words telling, so labelled texts that share the least hash
of their five-word shingles count as one together. At most LABELLED labelled rows are fitted on, the first by a hash of
doc_id; every row is scored, by its whole text.

Defined results: null, empty or wordless text has the score of the offset alone; repeated rows are scored each; a null
doc_id counts as held out; of several labels of an id the largest holds, null labels are none; without labels outside the
held-out fold every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import LOWER, SLICE_BYTES, RollingHash, byte_slices, cut, discard, find_words, prepare, shingles, text_bytes
from wayfare.llm.langid import held_out
from wayfare.llm.site_quality import _BETWEEN

#: Bounds of what is fitted on the driver.
LABELLED, TELLING_WORDS = 20_000, 400
#: What a word must have to be telling: labelled texts (copies together count as one), and chi-square against the label.
LEAST_TEXTS, LEAST_GAIN = 4.0, 18.0
#: Weight of a rewriting's squared change of log-odds, rewritings a text, and of the weights' squares.
COUNTERFACTUAL, SWAPS, RIDGE = 10.0, 3, 0.2
#: Terms that stand for each other, by kind.
TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "einwanderer", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    ("disabled", "deaf", "blind", "old", "young"),
)


def word_hash(words: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(words, pa.string()))
    return RollingHash(LOWER[data]).ranges(offsets[:-1], offsets[1:])


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words without punctuation, and the n + 1 offsets of the texts in them."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, at = find_words(data, offsets, _BETWEEN)
    return RollingHash(data).ranges(starts, ends), at


def labelled_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, words (distinct hashes), least (hash that copies of one text share) of the labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 0, limit=SLICE_BYTES):
            words, at = words_of(batch.column(0))
            grams, edge = shingles(batch.column(0))
            least = [int(grams[a:b].min().view(np.int64)) if b > a else 0 for a, b in zip(edge, edge[1:])]
            lists = [np.unique(words[a:b]).view(np.int64) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int64())), pa.array(least, pa.int64())], names=["toxic", "words", "least"])

    doc_id = F.col("doc_id").cast("long")
    marks = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = cut(marks.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(LABELLED))  # ids alone
    return docs.select(doc_id.alias("doc_id"), "text").join(F.broadcast(marks), "doc_id").select("text", "toxic").mapInArrow(run, "toxic int, words array<long>, least long")


def telling_words(known: DataFrame) -> np.ndarray:
    """Sorted hashes of the words whose presence goes with the label. known: toxic, words, weight."""
    n, toxic = known.agg(F.sum("weight"), F.sum(F.col("toxic") * F.col("weight"))).first()
    by = known.select("weight", "toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("weight").alias("n"), F.sum(F.col("toxic") * F.col("weight")).alias("toxic"))
    share = (toxic + 1) / (n + 2)
    gain = (F.col("toxic") - F.col("n") * share) ** 2 / (F.col("n") * share * (1 - share) * (1 - F.col("n") / (n + 1)))
    best = by.filter(F.col("n") >= LEAST_TEXTS).withColumn("gain", gain).filter(F.col("gain") >= LEAST_GAIN).orderBy(F.desc(F.round("gain", 6)), "word").limit(TELLING_WORDS)
    return np.sort(np.array([r[0] for r in best.select("word").collect()], np.int64).view(np.uint64))


def swapped(x: np.ndarray, kinds: list[np.ndarray], turn: int) -> np.ndarray:
    """Presence after each identity term has given way to the one so many places further among its kind."""
    out = x.copy()
    for kind in kinds:
        out[:, np.roll(kind, -(1 + (turn - 1) % max(len(kind) - 1, 1)))] = x[:, kind]
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, kinds: list[np.ndarray], counterfactual: float = COUNTERFACTUAL, steps: int = 40) -> np.ndarray:
    """Weights of the columns and the offset. Rows' log losses, squares of weights and of the rewritings' changes are added up."""
    tied = np.flatnonzero(x[:, np.concatenate(kinds)].any(axis=1)) if len(kinds) else np.zeros(0, int)
    d = x.shape[1] + 1
    penalty = np.diag(np.append(np.full(d - 1, RIDGE), 1e-4))
    for turn in range(1, SWAPS + 1):
        change = x[tied] - swapped(x[tied], kinds, turn)
        penalty[:-1, :-1] += counterfactual / SWAPS * (change * weight[tied, None]).T @ change
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(d)

    def loss(v: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v))).sum() + v @ penalty @ v / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        size = 1.0
        while (new := loss(w + size * move)) > now and size > 1e-6:
            size /= 2
        w, gone, now = w + size * move, now - new, new
        if gone < 1e-9 * (1 + abs(now)):
            break
    return w


@dataclass
class Classifier:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        words, at = words_of(column)
        odds = np.full(len(column), self.offset)
        if len(self.words) and len(words):
            place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            told = self.words[place] == words
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))[told]
            once = np.unique(text * len(self.words) + place[told])
            odds += np.bincount(once // len(self.words), self.weights[once % len(self.words)], minlength=len(odds))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, counterfactual: float = COUNTERFACTUAL, terms=TERMS) -> Classifier | None:
    """None without labelled rows outside the held-out fold."""
    known = cut(labelled_words(docs, labels))
    groups = known.groupBy("least").agg((1 / F.count(F.lit(1))).alias("weight"))
    weighted = cut(known.join(groups, "least").select("toxic", "words", F.when(F.col("least") == 0, 1.0).otherwise(F.col("weight")).alias("weight"), "least"))
    discard(known)
    if not weighted.limit(1).count():
        return None
    hashes = [word_hash(list(kind)) for kind in terms]
    words = np.unique(np.concatenate([telling_words(weighted), *hashes]))
    keep = F.array_intersect("words", F.array(*(F.lit(int(w)) for w in words.view(np.int64)))) if len(words) else F.array().cast("array<bigint>")
    # repeated ids may bring more rows than labels
    rows = weighted.select("toxic", "weight", F.array_sort(keep).alias("words"), "least").orderBy("least", "toxic", "words").limit(LABELLED).toArrow()
    x = np.zeros((rows.num_rows, len(words)))
    for k, own in enumerate(rows["words"].to_pylist()):
        x[k, np.searchsorted(words, np.array(own, np.int64).view(np.uint64))] = 1
    kinds = [np.searchsorted(words, h) for h in hashes if len(h) > 1]
    w = fit(x, (rows["toxic"].to_numpy() > 0).astype(float), rows["weight"].to_numpy(), kinds, counterfactual)
    discard(weighted)
    return Classifier(words, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2, limit=SLICE_BYTES):
            p = model.scores(batch.column(2)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents that aren't held out, and score all."""
    prepare(docs.sparkSession)
    return score(docs, train(docs, labels))
