"""Document quality by hierarchical empirical Bayes.

A classifier gives each document evidence on two questions: is it of low quality, is it toxic. It is a logistic
regression on character and repetition measures and on the presence of telling words, fitted on a bounded sample of
labelled documents (at most LABELLED). The documents' probabilities are then added up by path, by host and over all, and
the spread between sites is held against the spread inside them: a site's mean counts by its documents, the mean above
it by as many documents as make both equally certain (inside variance over the variance between sites, estimated for
hosts and for paths apart). So sparse sites follow the level above, and where sites don't differ none of them counts. A
document is left out of its own site's sums. Its log-odds move by how far its site's lie from the corpus's, times a
weight from 0 to 1 that is fitted on the labelled sample as well.

The source is the site: what stands before its first `/` is the host, the whole is the path. A host with one path has no
level below it.

Defined results: null, empty or wordless text is judged by its measures like any other (what labels say of such decides);
null source is a site of its own; without labels all probabilities are even and everything is kept; repeated rows are
judged each and count each; an empty table gives no rows; null doc_id stays null and is never a labelled row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfare.llm.common import LOWER, SLICE_BYTES, SPACE, RollingHash, byte_slices, cut, find_words, prepare, text_bytes, whole_rows

#: Bounds of what is fitted on the driver.
LABELLED, TELLING_WORDS, LEAST_DOCS = 8000, 400, 4
#: Chi-square that a word's presence must have against one of the marks.
LEAST_GAIN = 18.0
#: Bounds of the estimated documents' worth of the level above, where sites differ very much or not at all.
PRIOR_DOCS = (0.01, 1e9)
QUESTIONS = ("low", "toxic")
#: Rows of site sums that are broadcast; beyond it Spark joins them as it sees fit.
BROADCAST_SITES = 500_000
MEASURES = ("words", "word_length", "upper", "symbol", "digit", "point", "beyond", "distinct", "repeats", "lines")

_PARTS = np.zeros((5, 256), bool)
_PARTS[0, ord("A") : ord("Z") + 1] = True
_PARTS[1, [ord(c) for c in "#*$%&|<>!@=+_~^{}[]\\/"]] = True
_PARTS[2, ord("0") : ord("9") + 1] = True
_PARTS[3, [ord(c) for c in ".,;:?'\"()-"]] = True
_PARTS[4, 128:] = True
#: Bytes of words: letters, digits and all beyond ASCII, lower-cased.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(128, 256)]] = False


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of MEASURES; hashes of all words without punctuation, and the n + 1 offsets of the texts in them."""
    data, offsets = text_bytes(column)
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, at = find_words(data, offsets, SPACE)
    count = np.diff(at)
    lower = LOWER[data]
    hashes = RollingHash(lower).ranges(starts, ends)
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) else hashes
    distinct, repeated = np.zeros(len(count)), np.zeros(len(count))
    for k in np.flatnonzero(count):
        distinct[k] = len(np.unique(hashes[at[k] : at[k + 1]])) / count[k] ** 0.75
        if count[k] > 1:
            repeated[k] = 1 - len(np.unique(pairs[at[k] : at[k + 1] - 1])) / (count[k] - 1)
    out = np.empty((len(count), len(MEASURES)))
    out[:, 0] = np.log1p(count)
    out[:, 1] = (np.diff(offsets) - _sums(SPACE[data], offsets)) / np.maximum(count, 1) / 10
    for k, part in enumerate(_PARTS):
        out[:, 2 + k] = np.sqrt(_sums(part[data], offsets) / size)
    out[:, 7], out[:, 8] = distinct, repeated
    out[:, 9] = np.sqrt(_sums(data == 10, offsets) / np.maximum(count, 1))
    plain_starts, plain_ends, plain_at = find_words(lower, offsets, _BETWEEN)
    return out, RollingHash(lower).ranges(plain_starts, plain_ends), plain_at


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, 0, limit=SLICE_BYTES):
        values, words, at = measure(batch.column(0))
        lists = [np.unique(words[at[k] : at[k + 1]]).view(np.int64) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(values), pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.int64()))], names=["low", "toxic", "measures", "words"])


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 0.2, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the offset and is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], strength)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


class Evidence:
    """Weights of both questions over standardised measures and telling words."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, words: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.words, self.weights = mean, scale, words, weights

    def log_odds(self, values: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Two columns: low quality, toxic."""
        x = np.clip((values - self.mean) / self.scale, -8, 8)
        n = x.shape[1]
        out = x @ self.weights[:, :n].T + self.weights[:, -1]
        if len(self.words) and len(words):
            place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            told = self.words[place] == words
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))[told]
            once = np.unique(text * len(self.words) + place[told])
            for q in range(2):
                out[:, q] += np.bincount(once // len(self.words), self.weights[q, n + once % len(self.words)], minlength=len(out))
        return out


def sampled_marks(labels: DataFrame) -> DataFrame:
    """doc_id, low, toxic of LABELLED labelled documents, the same ones whenever asked."""
    marks = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).alias("low"), F.max("toxic").alias("toxic"))
    return marks.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(LABELLED)


def fit_evidence(docs: DataFrame, marks: DataFrame) -> Evidence | None:
    """docs: doc_id, text; marks: doc_id, low, toxic, LABELLED rows at most. None without labelled documents."""
    known = docs.join(F.broadcast(marks), "doc_id").limit(LABELLED)  # repeated ids may bring more rows than labels
    known = cut(known.select("text", F.col("low").cast("int"), F.col("toxic").cast("int")).mapInArrow(_features, "low int, toxic int, measures array<double>, words array<long>"))
    n = known.count()
    if not n:
        return None
    # words by how well their presence tells either mark: an explode and a grouping on Spark, the best come to the driver
    total_low, total_toxic = known.agg(F.sum("low"), F.sum("toxic")).first()
    told = known.select("low", "toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= LEAST_DOCS)
    gain = lambda c, total: (F.col(c) - F.col("n") * (total / n)) ** 2 / (F.col("n") * ((total + 1) / n) * (1 - F.col("n") / (n + 1)))
    best = told.withColumn("gain", F.greatest(gain("low", total_low), gain("toxic", total_toxic))).filter(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "word").limit(TELLING_WORDS)
    words = np.sort(np.array([r[0] for r in best.select("word").collect()], np.int64).view(np.uint64))
    keep = F.array(*(F.lit(int(w)) for w in words.view(np.int64))) if len(words) else F.array().cast("array<bigint>")
    rows = known.select("low", "toxic", "measures", F.array_intersect("words", keep).alias("words")).toArrow()
    values = np.array(rows["measures"].to_pylist())
    mean, scale = values.mean(axis=0), values.std(axis=0) + 1e-6
    presence = np.zeros((len(values), len(words)))
    for k, own in enumerate(rows["words"].to_pylist()):
        if own:
            presence[k, np.searchsorted(words, np.array(own, np.int64).view(np.uint64))] = 1
    x = np.column_stack([np.clip((values - mean) / scale, -8, 8), presence])
    return Evidence(mean, scale, words, np.array([fit_logistic(x, rows[c].to_numpy().astype(float)) for c in ("low", "toxic")]))


def _scores(evidence: Evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(next(k for k, f in enumerate(batch.column(0).type) if f.name.lower() == "text"))
            parts = [np.zeros((0, 2))]
            for part in byte_slices([pa.RecordBatch.from_arrays([texts], names=["text"])], 0, limit=SLICE_BYTES):
                parts.append(np.clip(evidence.log_odds(*measure(part.column(0))), -12, 12))
            odds = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds[:, 0]), pa.array(odds[:, 1])], names=[*batch.schema.names, "low_odds", "toxic_odds"])

    return run


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _worth(within: float, between: float) -> float:
    """Documents that a level's mean is worth below it."""
    return min(max(within / between, PRIOR_DOCS[0]), PRIOR_DOCS[1]) if between > 0 else PRIOR_DOCS[1]


def _probability(question: str) -> Column:
    return 1 / (1 + F.exp(-F.col(f"{question}_odds")))


def site_sums(scored: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """Sums by path and host, and for each question the mean of all, a host's worth and a path's (see _worth).

    scored: host, path, low_odds, toxic_odds. The worths come from the usual moments of a random-effects model: what the
    means of groups differ beyond what their documents' own spread explains.
    """
    p = _probability
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *(F.sum(p(q)).alias(f"s_{q}") for q in QUESTIONS), *(F.sum(p(q) * p(q)).alias(f"ss_{q}") for q in QUESTIONS)))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.count(F.lit(1)).alias("paths"), F.sum(F.col("n") * F.col("n") / 1.0).alias("nn"), *(F.sum(f"{m}_{q}").alias(f"host_{m}_{q}") for q in QUESTIONS for m in ("s", "ss")), *(F.sum(F.col(f"s_{q}") * F.col(f"s_{q}") / F.col("n")).alias(f"means_{q}") for q in QUESTIONS)))
    worths = {}
    for q in QUESTIONS:
        got = hosts.agg(
            F.sum("host_n").alias("n"), F.sum(f"host_s_{q}").alias("s"), F.sum(f"host_ss_{q}").alias("ss"), F.sum(f"means_{q}").alias("by_path"), F.sum(F.col(f"host_s_{q}") * F.col(f"host_s_{q}") / F.col("host_n")).alias("by_host"),
            F.sum("paths").alias("paths"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("host_n") * F.col("host_n") / 1.0).alias("host_nn"), F.sum(F.col("nn") / F.col("host_n")).alias("path_nn"),
        ).first()
        if not got.n:
            worths[q] = (0.0, PRIOR_DOCS[1], PRIOR_DOCS[1])
            continue
        within = max(got.ss - got.by_path, 0.0) / max(got.n - got.paths, 1)
        path_spread = (got.by_path - got.by_host - (got.paths - got.hosts) * within) / max(got.n - got.path_nn, 1e-9)
        host_spread = (got.by_host - got.s**2 / got.n - (got.hosts - 1) * within) / max(got.n - got.host_nn / got.n, 1e-9)
        worths[q] = (got.s / got.n, _worth(within, host_spread), _worth(within, path_spread))
    sums = paths.select("host", "path", "n", *(f"s_{q}" for q in QUESTIONS)).join(hosts.select("host", "host_n", "paths", *(f"host_s_{q}" for q in QUESTIONS)), "host")
    return sums, worths


def with_posteriors(scored: DataFrame) -> DataFrame:
    """Adds all_, host_ and path_ for both questions: the site's posterior means as the row's neighbours tell them, itself left out."""
    sums, worths = site_sums(scored)
    joined = scored.join(F.broadcast(sums) if sums.count() <= BROADCAST_SITES else sums, ["host", "path"])
    for q, (mean, host_worth, path_worth) in worths.items():
        own = _probability(q)
        host = (F.col(f"host_s_{q}") - own + host_worth * mean) / (F.col("host_n") - 1 + host_worth)
        path = (F.col(f"s_{q}") - own + path_worth * F.col(f"host_{q}")) / (F.col("n") - 1 + path_worth)
        joined = joined.withColumn(f"all_{q}", F.lit(mean)).withColumn(f"host_{q}", host).withColumn(f"path_{q}", F.when(F.col("paths") > 1, path).otherwise(F.col(f"host_{q}")))
    return joined.drop("n", "host_n", "paths", *(f"{m}s_{q}" for m in ("", "host_") for q in QUESTIONS))


def fit_weight(odds: np.ndarray, shift: np.ndarray, y: np.ndarray) -> float:
    """How much of the site's shift to add to a document's own log-odds: the likeliest of 0, 0.02 ... 1 on labelled rows."""
    tried = np.linspace(0, 1, 51)
    losses = [np.logaddexp(0, np.where(y > 0, -1, 1) * (odds + w * shift)).sum() for w in tried]
    return float(tried[int(np.argmin(losses))]) if len(y) else 0.0


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc (all columns of docs), p_low, p_toxic, and the sites' posteriors, for each row of docs."""
    prepare(docs.sparkSession)
    rows = whole_rows(docs)
    doc_id, source = F.col("doc.doc_id").cast("long"), F.coalesce("doc.source", F.lit(""))
    marks = cut(sampled_marks(labels))
    evidence = fit_evidence(rows.select(doc_id.alias("doc_id"), F.col("doc.text").alias("text")), marks)
    keyed = rows.select("doc", F.substring_index(source, "/", 1).alias("host"), source.alias("path"))
    if evidence is None:
        scored = keyed.withColumn("low_odds", F.lit(0.0)).withColumn("toxic_odds", F.lit(0.0))
    else:
        kinds = StructType().add("doc", docs.schema).add("host", "string").add("path", "string").add("low_odds", "double").add("toxic_odds", "double")
        scored = keyed.mapInArrow(_scores(evidence), kinds)
    scored = cut(scored)  # texts once, so that no row has to find its verdict
    judged = with_posteriors(scored)
    shift = {q: _logit(F.col(f"path_{q}")) - _logit(F.col(f"all_{q}")) for q in QUESTIONS}
    told = judged.select(doc_id.alias("doc_id"), *(f"{q}_odds" for q in QUESTIONS), *(x.alias(f"{q}_shift") for q, x in shift.items()))
    told = told.join(F.broadcast(marks), "doc_id").limit(LABELLED).toPandas() if evidence else None  # numbers alone
    for q in QUESTIONS:
        weight = fit_weight(told[f"{q}_odds"].to_numpy(), told[f"{q}_shift"].to_numpy(), told[q].to_numpy()) if evidence else 0.0
        judged = judged.withColumn(f"p_{q}", 1 / (1 + F.exp(-(F.col(f"{q}_odds") + F.lit(weight) * shift[q]))))
    return judged


def _is_good() -> Column:
    return (F.col("p_low") <= 0.5) & (F.col("p_toxic") <= 0.5)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low, p_toxic, host_low, host_toxic, path_low, path_toxic, kept for each row of docs."""
    judged = _judged(docs.select("doc_id", "text", "source"), labels)
    return judged.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "p_low", "p_toxic", "host_low", "host_toxic", "path_low", "path_toxic", _is_good().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns, of any names."""
    return _judged(docs, labels).filter(_is_good()).select("doc.*")
