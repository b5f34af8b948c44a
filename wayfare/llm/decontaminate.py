"""Benchmark decontamination with a broadcast hash set of the benchmark's word windows.

Windows of both sides are hashed by doubling (words, pairs, fours, eights), documents' windows look their hashes up in
the benchmark's set, and hits are verified word by word before anything is counted. DataFrame functions only.

The set is broadcast in slices of about BROADCAST_WINDOWS rows, one after the other; there is one where it fits.

Defined results: null or wordless text has no words and no hit, such an item no window; repeated rows are judged each;
an empty benchmark hits nothing; null doc_id stays null, items with a null item_id are left out; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import cut, row_key, whole_rows, with_text

WINDOW = 10
BROADCAST_WINDOWS = 500_000
#: Places of words under hits (four bytes each, twenty more a row) that are broadcast.
BROADCAST_HITS = 8_000_000

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; this is what lies between them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing, and what lies between these.
WORD, APART = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _joined(a: Column, b: Column, shift: int) -> Column:
    """Hashes of the hashes at i in a and at i + shift in b.

    Both are named outside of the lambda too: Spark moves an expression that is named once to its only place, and in a
    lambda it would be computed again for every element.
    """
    rest = F.least(F.size(a), F.size(b) - shift)
    both = F.transform(F.sequence(F.lit(0), rest - 1), lambda i: F.xxhash64(F.get(a, i), F.get(b, i + shift)))
    return F.when(rest > 0, both).otherwise(F.array().cast("array<bigint>"))


def _with_hashes(rows: DataFrame, length: int) -> DataFrame:
    """Adds w{length}: hashes of all windows of so many words of `words`, in order; a window is hashed from two shorter ones."""
    if f"w{length}" in rows.columns:
        return rows
    if length == 1:
        return rows.withColumn("w1", F.transform("words", lambda w: F.xxhash64(w)))
    half = 1 << (length - 1).bit_length() - 1
    rows = _with_hashes(_with_hashes(rows, half), length - half)
    return rows.withColumn(f"w{length}", _joined(F.col(f"w{half}"), F.col(f"w{length - half}"), half))


def _windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows: row, words; to row, words, length, at, hash of each window."""
    for n in lengths:
        rows = _with_hashes(rows, n)

    def named(n: int) -> Column:
        return F.transform(f"w{n}", lambda h, i: F.struct(F.lit(n).alias("length"), i.alias("at"), h.alias("hash")))

    return rows.select("row", "words", F.inline(F.concat(*map(named, lengths))))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, length, hash, window (its words)."""
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    cut_ = F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))
    return items.select("item_id", length.alias("length"), F.explode(cut_).alias("window")).distinct()


def find_hits(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """rows: row (a key), text. To row, hits: verified (at, length, item_id), `at` from 0; rows without hits are left out.

    A document's words are compared while its windows look up the broadcast set, so only hits are shuffled.
    """
    wanted = cut(benchmark_windows(benchmark, window))
    lengths = sorted(r[0] for r in wanted.select("length").distinct().collect())  # ten numbers at most
    hashed = None
    for n in lengths:
        own = _with_hashes(wanted.filter(F.col("length") == n).select("item_id", "window", F.col("window").alias("words")), n)
        own = own.select("item_id", "window", F.lit(n).alias("of_length"), F.element_at(f"w{n}", 1).alias("of_hash"))
        hashed = own if hashed is None else hashed.unionByName(own)
    if hashed is None:
        return rows.limit(0).select("row", F.array().cast("array<struct<at:int,length:int,item_id:bigint>>").alias("hits"))
    hashed = cut(hashed)
    slices = -(-hashed.count() // most)
    windows = _windows(rows.select("row", words_of(F.col("text")).alias("words")), lengths)
    # as numbers, so that only the hash becomes the join's key and words are compared for equal hashes alone
    equal = (F.col("length") == F.col("of_length")).cast("int") + (F.slice("words", F.col("at") + 1, F.col("length")) == F.col("window")).cast("int")
    same = (F.col("hash") == F.col("of_hash")) & (equal == 2)
    found = []
    for k in range(slices):
        part = hashed.filter(F.pmod("of_hash", F.lit(slices)) == k) if slices > 1 else hashed
        hit = windows.join(F.broadcast(part), same).groupBy("row").agg(F.collect_set(F.struct("at", "length", "item_id")).alias("hits"))
        found.append(cut(hit) if slices > 1 else hit)
    if slices == 1:
        return found[0]
    return reduce(DataFrame.unionByName, found).groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def covered(hits: Column) -> Column:
    """Words under any of the hits."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["at"] + x["length"])
        return F.struct(end.alias("end"), (acc["sum"] + end - F.greatest(acc["end"], x["at"])).alias("sum"))

    ordered = F.sort_array(F.transform(hits, lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length"))))
    return F.aggregate(ordered, start, step, lambda acc: acc["sum"])


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row_key("doc_id", "text"))
    hits = find_hits(rows, benchmark, window)
    items = F.sort_array(F.transform(F.array_distinct(F.transform("hits", lambda x: x["item_id"])), lambda i: i.cast("string")))
    leaks = hits.select("row", covered(F.col("hits")).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.array_join(items, ",").alias("items"))
    counted = rows.select("row", "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    joined = counted.join(leaks, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"))
    return joined.withColumn("contaminated", F.col("n_hit") > 0)


def _kept_words() -> Column:
    """Runs (start from 1, length) of words between the places `under`, which begin with -1 and end with the count of words.

    `under` is named outside of the lambda as well, see _joined.
    """
    gaps = F.transform("under", lambda p, i: F.struct((p + 2).alias("start"), (F.get("under", i + 1) - p - 1).alias("length")))
    return F.filter(gaps, lambda x: x["length"] > 0)


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the words under hits, each with what follows it. Rows left without a word by this go.

    What is left keeps its case, and what stands before the first word. An n_chars column is counted anew. Null and
    empty texts stay; repeated rows are changed alike; columns of any names pass through. Texts are not shuffled while
    the rows with hits are BROADCAST_HITS at most, which is looked up; beyond that they are joined by row key.
    """
    names = docs.columns
    rows = whole_rows(docs).withColumn("row", row_key("doc.doc_id", "doc.text"))
    hits = find_hits(rows.select("row", F.col("doc.text").alias("text")), benchmark, window)
    places = F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1)))
    hits = cut(hits.select("row", F.sort_array(F.array_distinct(places)).alias("places")))
    size = hits.agg(F.sum(F.size("places") + 20)).first()[0] or 0
    joined = rows.join(F.broadcast(hits) if size <= BROADCAST_HITS else hits, "row", "left")
    text = F.col("doc.text")
    # a text's words, each with what follows it, in their own case
    own = F.when(F.col("places").isNotNull(), F.regexp_extract_all(text, F.lit(f"{WORD}(?:{APART})?"), F.lit(0)))
    joined = joined.select("doc", "places", own.alias("own"))
    joined = joined.withColumn("under", F.concat(F.array(F.lit(-1)), "places", F.array(F.size("own"))))
    joined = joined.withColumn("runs", _kept_words())
    left = F.array_join(F.flatten(F.transform("runs", lambda x: F.slice("own", x["start"], x["length"]))), "")
    left = F.concat(F.regexp_extract(text, f"^(?:{APART})?", 0), left)
    joined = joined.filter("runs is null or size(runs) > 0")
    changed = F.when(F.col("runs").isNull(), F.col("doc")).otherwise(with_text(names, left))
    schema = docs.schema
    return joined.select(changed.alias("doc")).select(*(F.col(f"doc.`{c}`").cast(schema[c].dataType).alias(c) for c in names))
