"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seeded hash within each source; a row's rank there over the source's size is its place in the
whole. Cut at equal counts, every shard has the sources in the mixture of the corpus, and counts differ by one at most.

Ranks and places come from counts of hash buckets and of ranges, so no window holds more than about BUCKET_ROWS rows
however large a source is.

Rows are told apart by doc_id and text, so rows with no doc_id, or with one that others have, spread as well; only whole
repeats of one row share a bucket. One task adds up the counts of ranges, one number for BUCKET_ROWS rows.

Defined results: null text has no bytes (size 1, crc 0); null source is a source of its own; repeated rows get a place
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import cut

SHARDS, SEED, BUCKET_ROWS = 16, "wayfare", 20_000
#: Steps of a source's own shift, so that sources with few rows don't all lie in the middle.
STEPS = 256


def _below(hex_digest: Column, n: int) -> Column:
    """0 to n - 1 by the first 32 bits, in the digests' order."""
    return F.floor(F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(1 << 32)).cast("long")


def stratified_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary")).alias("key"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stratum"),
    )
    counted = cut(rows)
    total = counted.count()
    buckets = 1 + total // bucket_rows
    counted = counted.withColumn("bucket", _below(F.col("key"), buckets))

    inside = Window.partitionBy("stratum", "bucket").orderBy("key", "doc_id", "text_crc32", "size")
    before = Window.partitionBy("stratum").orderBy("bucket")
    of = counted.groupBy("stratum", "bucket").count()
    of = of.select("stratum", "bucket", (F.sum("count").over(before) - F.col("count")).alias("below"), F.sum("count").over(Window.partitionBy("stratum")).alias("n"))
    ranked = counted.withColumn("in_bucket", F.row_number().over(inside)).join(of, ["stratum", "bucket"])
    rank = F.col("below") + F.col("in_bucket")
    shift = _below(F.md5(F.concat_ws(":", F.lit(seed), "stratum").cast("binary")), STEPS)
    place = (rank * STEPS - shift).cast("double") / F.col("n")  # over 0, up to STEPS
    ranked = cut(ranked.select("doc_id", "source", "size", "text_crc32", "stratum", rank.alias("rank"), place.alias("place"), F.least(F.floor(place * buckets / STEPS), F.lit(buckets - 1)).alias("part")))

    parts = ranked.groupBy("part").count()
    parts = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("below"))  # one row for each BUCKET_ROWS rows
    at = F.row_number().over(Window.partitionBy("part").orderBy("place", "stratum", "rank"))
    placed = ranked.withColumn("at", at).join(parts, "part").withColumn("at", F.col("below") + F.col("at") - 1)
    shard = F.floor(F.col("at") * shards / max(total, 1)).cast("int")
    start = F.ceil(F.col("shard") * total / shards)
    return placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
