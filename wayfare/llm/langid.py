"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of a window, each filter's largest response is kept, and a softmax over the
languages follows. On bytes a filter is a sum of table look-ups, one for each of its places. The network is trained in
numpy with hand-written gradients on a bounded sample (TRAIN_DOCS documents, WINDOWS_A_DOC windows each), and applied to
all windows of every whole text; a document's answer is the mean of its windows' probabilities.

Training and prediction see the text alone. Defined results: null text or text without a letter is `und` with score 0;
without any labelled row all rows are `und`; repeated rows are judged each; an empty table gives no rows; null doc_id
stays null and counts as held out from training; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import LOWER, byte_slices, cut, prepare, text_bytes

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
TRAIN_DOCS, WINDOWS_A_DOC, STEPS, BATCH, RATE = 3000, 4, 500, 192, 0.02
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Rows of window bytes that cover all texts (0 after a text's end), and the number of each row's text."""
    size = np.diff(offsets)
    many = -(-size // window)
    text = np.repeat(np.arange(len(size)), many)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = offsets[:-1][text] + begin * window
    take = begin[:, None] + np.arange(window)
    inside = take < offsets[1:][text][:, None]
    padded = np.append(LOWER[data], np.uint8(0))
    return np.where(inside, padded[np.minimum(take, len(data))], np.uint8(0)), text


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: places x 256 x filters
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def pairs(self) -> list[np.ndarray]:
        """Look-ups by two bytes at once: places 0 and 1, then 2 and 3 (or 2 alone) of each width."""
        return [[(t[k][:, None, :] + (t[k + 1] if k + 1 < len(t) else np.zeros_like(t[k]))[None, :, :]).reshape(65536, -1) for k in range(0, len(t), 2)] for t in self.tables]

    def probabilities(self, rows: np.ndarray, pairs: list) -> np.ndarray:
        wide = np.concatenate([rows, np.zeros((len(rows), 3), np.uint8)], axis=1).astype(np.int32)
        two = wide[:, :-1] << 8 | wide[:, 1:]
        pooled = []
        for tables in pairs:
            out = tables[0][two[:, : rows.shape[1]]]
            if len(tables) > 1:
                out += tables[1][two[:, 2 : rows.shape[1] + 2]]
            pooled.append(out.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        scores = hidden @ self.weights + self.offset
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on balanced mini-batches; gradients go to the places that gave each filter's largest response."""
    rng = np.random.RandomState(seed)
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    units = FILTERS * len(WIDTHS)
    params = [*tables, np.zeros(units, np.float32), rng.normal(0, 0.3, (units, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    wide = np.concatenate([rows, np.zeros((len(rows), 3), np.uint8)], axis=1).astype(np.int64)
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(x, -(-BATCH // len(of))) for x in of])
        x, y = wide[pick], labels[pick]
        pooled, best = [], []
        for t in params[: len(WIDTHS)]:
            out = sum(t[k][x[:, k : k + WINDOW]] for k in range(len(t)))
            arg = out.argmax(axis=1)
            best.append(arg)
            pooled.append(np.take_along_axis(out, arg[:, None, :], 1)[:, 0])
        raw = np.concatenate(pooled, axis=1) + params[-3]
        hidden = np.maximum(raw, 0)
        scores = hidden @ params[-2] + params[-1]
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ params[-2].T) * (raw > 0)
        grads = [np.zeros_like(t) for t in params[: len(WIDTHS)]] + [back.sum(0), hidden.T @ p, p.sum(0)]
        for w, arg in enumerate(best):
            own = back[:, w * FILTERS : (w + 1) * FILTERS]
            for k in range(WIDTHS[w]):
                np.add.at(grads[w][k], (np.take_along_axis(x, arg + k, 1), np.arange(FILTERS)[None, :]), own)
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Network(languages, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


def training_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample of labelled documents: the first TRAIN_DOCS by a hash of doc_id."""
    named = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 0):
            rows, text = windows_of(*text_bytes(batch.column(0)))
            rng = np.random.RandomState(len(rows) % 9973)
            keep = np.concatenate([rng.choice(x, min(len(x), WINDOWS_A_DOC), replace=False) for x in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(text)) + 1)]) if len(rows) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows[keep]], pa.binary()), batch.column(1).take(pa.array(text[keep]))], names=["bytes", "lang"])

    order = (F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    chosen = cut(named.select("doc_id").distinct().orderBy(*order).limit(TRAIN_DOCS))  # ids alone; texts follow them
    # repeated ids may bring more rows than ids
    sample = named.select("text", "lang", "doc_id").join(F.broadcast(chosen), "doc_id", "left_semi").limit(TRAIN_DOCS).select("text", "lang")
    found = sample.mapInArrow(cut_out, "bytes binary, lang string").toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    rows = np.frombuffer(b"".join(found["bytes"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return rows, np.array([languages.index(x) for x in found["lang"].to_pylist()], np.int64), languages


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = network.pairs() if network else None
        for batch in byte_slices(batches, 2, limit=500_000):
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if network:
                rows, text = windows_of(*text_bytes(batch.column(2)))
                if len(rows):
                    total = np.zeros((batch.num_rows, len(network.languages)))
                    for k in range(0, len(rows), 512):
                        np.add.at(total, text[k : k + 512], network.probabilities(rows[k : k + 512], pairs))
                    total /= np.maximum(np.bincount(text, minlength=batch.num_rows), 1)[:, None]
                    letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
                    best = total.argmax(axis=1)
                    names[letters] = np.array(network.languages, object)[best[letters]]
                    score[letters] = np.clip(total[np.arange(len(best)), best][letters], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Train on the labelled documents that aren't held out, and predict all."""
    prepare(docs.sparkSession)
    rows, labels, languages = training_windows(docs.select(F.col("doc_id").cast("long"), "text", "lang"))
    return predict(docs, train(rows, labels, languages) if languages else None)
