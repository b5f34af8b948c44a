"""Quality rules by distribution divergence.

A document's histograms of character classes and of its language's most frequent words are compared with the language's
own (all of its documents together) by Jensen-Shannon distance. Short documents are noisy, so each distance counts from
a minimum length on. DataFrame functions only.

One rule holds for languages of any size. A language of n words trusts its own histograms by n / (n + PRIOR_WORDS) and the
corpus's by the rest, and the limits widen from MAX_ toward 1 by the same rest, so that the few documents of a rare
language aren't judged by another one's habits. Words are counted exactly: once per language and word, the most frequent
ones ranked within each language.

Defined results: null or wordless text has no words and fails the base rules; documents without a language are a group of
their own, judged like a language; repeated rows are judged each; an empty table gives no rows; null doc_id stays null;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import cut, discard
from wayfare.llm.decontaminate import lower_ascii

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
TOP_WORDS, PRIOR_WORDS = 24, 2000
#: Least words of a document for each distance.
CLASS_WORDS, COMMON_WORDS = 20, 40
MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE = 0.30, 0.50
#: Languages (some 2 kB each) that are broadcast; beyond it Spark joins them as it sees fit.
BROADCAST_LANGUAGES = 10_000

SPACES = r"[ \t-\r]+"
CLASSES = ("space", "symbol", "digit", "upper", "point", "beyond", "other")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words of `raw` in windows of 5 words that are found twice or more.

    Windows are hashed; where all hashes differ nothing repeats. Else they are sorted, each is compared with its
    neighbours, and the places of equal ones are sorted again. Each step is a column of its own, computed once a row.
    """
    none = F.array().cast("array<bigint>")
    hashes = F.transform(F.sequence(F.lit(0), F.size("raw") - 5), lambda i: F.xxhash64(*(F.get("raw", i + k) for k in range(5))))
    rows = rows.withColumn("windows", F.when(F.size("raw") >= 5, hashes).otherwise(none))
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i"))))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("pairs", F.when(again, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:bigint>>")))
    h = lambda k: F.get(F.col("pairs"), k)["h"]
    rows = rows.withColumn("twice", F.transform("pairs", lambda x, k: F.when((x["h"] == h(k + 1)) | (x["h"] == h(k - 1)), x["i"])))
    rows = rows.withColumn("twice", F.sort_array(F.array_compact("twice")))
    start = F.struct(F.lit(-5).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(i - acc["last"], F.lit(5))).alias("sum"))
    return rows.withColumn("n_repeat_words", F.aggregate("twice", start, step, lambda acc: acc["sum"])).drop("windows", "pairs", "twice")


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and `words` in lower case."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), "lang", text.alias("text")).withColumn("raw", words_of(F.col("text")))
    rows = _with_repeats(rows)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "doc_id", "lang", F.size("raw").cast("long").alias("n_words"), F.length(F.array_join("raw", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("octets"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("digit"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("upper"),
        F.regexp_count("text", F.lit(r"[.,;:!?'\"()-]")).cast("long").alias("point"), words_of(lower_ascii(F.col("text"))).alias("words"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def common_words(docs: DataFrame) -> DataFrame:
    """of (a language or null), top: its most frequent words; n: its words; everywhere: the corpus's shares of these words and the rest."""
    words = docs.select("lang", F.explode(words_of(lower_ascii(F.coalesce("text", F.lit(""))))).alias("word"))
    counts = cut(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    per = counts.groupBy("lang").agg(F.sum("n").alias("of_n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    ranked = cut(counts.withColumn("rank", rank).filter(F.col("rank") <= TOP_WORDS).select("lang", "word", "rank"))
    named = ranked.select("word").distinct()
    everywhere = counts.join(named, "word", "left_semi").groupBy("word").agg((F.sum("n") / max(total, 1)).alias("share"))
    listed = ranked.join(everywhere, "word").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "share"))).alias("list"))
    joined = per.join(listed, per["lang"].eqNullSafe(listed["lang"])).select(per["lang"].alias("of"), "of_n", F.col("list.word").alias("top"), F.col("list.share").alias("shares"))
    rest = 1.0 - F.aggregate("shares", F.lit(0.0), lambda s, x: s + x)
    # lists of fewer words are filled up with zeros, so that all have one more place than TOP_WORDS
    filled = F.transform(F.sequence(F.lit(0), F.lit(TOP_WORDS - 1)), lambda k: F.coalesce(F.get("shares", k), F.lit(0.0)))
    found = cut(joined.select("of", "of_n", "top", F.concat(filled, F.array(rest)).alias("everywhere")))
    discard(counts, ranked)
    return found


def divergence_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base counts, base_failed, kept, both distances (null where too short; six places)."""
    tops = common_words(docs)
    small = F.broadcast if tops.count() <= BROADCAST_LANGUAGES else lambda df: df
    joined = base_columns(docs).join(small(tops), F.col("lang").eqNullSafe(F.col("of")), "left")
    place = F.array_compact(F.transform("words", lambda w: F.nullif(F.array_position("top", w), F.lit(0))))
    joined = joined.withColumn("place", F.coalesce(place, F.array().cast("array<bigint>")))
    common = [(F.size("place") - F.size(F.array_remove("place", F.lit(k + 1).cast("bigint")))).cast("double") for k in range(TOP_WORDS)]
    space = (F.col("chars") - F.col("word_chars")).cast("double")
    classes = [space, *(F.col(c).cast("double") for c in ("n_symbols", "digit", "upper", "point")), (F.col("octets") - F.col("chars")).cast("double"), (F.col("word_chars") - F.col("n_symbols") - F.col("digit") - F.col("upper") - F.col("point")).cast("double")]
    other = (F.col("n_words") - F.size("place")).cast("double")
    counts = cut(joined.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.array(*classes).alias("classes"), F.array(*common, other).alias("common")))

    added = lambda column, n: F.array(*(F.sum(F.get(column, F.lit(k))) for k in range(n)))
    of = cut(counts.groupBy("lang").agg(added("classes", len(CLASSES)).alias("of_classes"), added("common", TOP_WORDS + 1).alias("of_common")))
    whole = of.agg(added("of_classes", len(CLASSES)).alias("whole_classes"))  # one row
    reference = of.join(tops, of["lang"].eqNullSafe(tops["of"]), "left").join(F.broadcast(whole)).withColumn("thin", PRIOR_WORDS / (F.coalesce("of_n", F.lit(0)) + PRIOR_WORDS))
    mixed = lambda own, all_: F.zip_with(own, all_, lambda x, y: (1 - F.col("thin")) * x + F.col("thin") * y)
    reference = reference.select(of["lang"].alias("of"), "thin", mixed(_shares(F.col("of_classes")), _shares(F.col("whole_classes"))).alias("of_classes"), mixed(_shares(F.col("of_common")), F.col("everywhere")).alias("of_common"))
    judged = counts.join(small(reference), F.col("lang").eqNullSafe(F.col("of")), "left")
    class_distance = F.when(F.col("n_words") >= CLASS_WORDS, F.round(distance(_shares(F.col("classes")), F.col("of_classes")), 6))
    common_distance = F.when(F.col("n_words") >= COMMON_WORDS, F.round(distance(_shares(F.col("common")), F.col("of_common")), 6))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = judged.select(*base, failed.alias("base_failed"), class_distance.alias("class_distance"), common_distance.alias("common_distance"), "thin")
    near = lambda d, most: F.coalesce(d, F.lit(0.0)) <= most * (1 - F.col("thin")) + F.col("thin")
    kept = ~F.col("base_failed") & near(F.col("class_distance"), MAX_CLASS_DISTANCE) & near(F.col("common_distance"), MAX_COMMON_DISTANCE)
    return judged.select(*base, "base_failed", kept.alias("kept"), "class_distance", "common_distance")
