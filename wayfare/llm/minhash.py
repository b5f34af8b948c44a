"""Near-duplicate documents by b-bit MinHash.

Of each document's minima only the low BITS bits are kept, packed in bit planes; bands of whole minima make candidates.
A candidate's similarity is estimated from the planes by counting equal bits and taking off what falls together by
chance; candidates far below the limit go, all others are compared by their full shingle sets.

Documents of equal sets are one class and are compared once. In a bucket of a band, each class is first compared with
the bucket's least. Only where a bucket then still holds several components, its classes outside the largest one meet all
others of other components, by a finer signature of FINE minima that only these classes get, so that families of texts
just below the limit don't all come through. For that, classes that share such buckets are dealt into blocks: a class
lies in one block, and a class outside the largest component is sent once to each block that holds a partner. Pairs that
remain are compared, likeliest first, until none is left untested: no link between components is lost, and no group is
spread into all its pairs. This work grows with the square of a family just below the limit, what is shuffled with its
size times its number of blocks.

The bands are as many as the limit asks: a link of just the limit is missed by all of them with a chance of
(1 - limit**ROWS)**bands, about 4e-7. At 0.85 they are 25, at 0.80 they are 37.

Defined results: null or blank text has an empty set and no link; rows with a null doc_id are linked with nothing, their
component is null and they are kept; repeated rows are a class; unlike rows that share a doc_id are judged each; an empty
table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.common import SLICE_BYTES, byte_slices, cut, digest_pairs, discard, mix, prepare, row_key, shingles, whole_rows
from wayfare.llm.components import components

HASHES, FINE, ROWS, BITS = 128, 768, 5, 4
#: Chance at most that no band holds a link of just the limit.
MISSED = 4.5e-7
#: Links: 100 * intersection >= LIMIT * union.
LIMIT = 85
#: Standard deviations below the expected count of equal places at which a candidate still counts.
SLACK = 5.5
#: Candidates that a class has verified in the first round; four times as many in each later one.
FIRST_ROUND = 64
#: Classes of a block, held by a task while others stream past.
BLOCK = 4096
#: Classes whose texts are looked up by a broadcast of their row keys; beyond it by a join.
BROADCAST_CLASSES = 1_000_000

_MULTIPLIERS = np.random.RandomState(23).randint(1, 1 << 62, HASHES + FINE).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Minima of bands beyond the first HASHES, so that the fine signature stays independent of the bands.
_MORE = np.random.RandomState(29).randint(1, 1 << 62, 4096).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNATURES = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("planes", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def least_equal(limit: int = LIMIT, hashes: int = HASHES) -> int:
    """Equal places of two signatures that a linked pair has, but for about one in ten million."""
    chance = 2.0**-BITS
    p = limit / 100 * (1 - chance) + chance
    return int(np.floor(hashes * p - SLACK * (hashes * p * (1 - p)) ** 0.5))


def bands_of(limit: int = LIMIT) -> int:
    """Bands of ROWS minima that miss a link of the limit with a chance of MISSED at most."""
    bands = int(np.ceil(np.log(MISSED) / np.log1p(-((limit / 100) ** ROWS)))) if limit < 100 else 1
    if bands * ROWS > HASHES + len(_MORE):
        raise ValueError(f"a limit of {limit} asks for {bands} bands")
    return bands


def minima(values: np.ndarray, at: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Rows of minima, one row per text; no text may be empty."""
    out = np.empty((len(multipliers), len(at) - 1), np.uint64)
    buffer = np.empty_like(values)
    for k, m in enumerate(multipliers):
        np.multiply(values, m, out=buffer)
        out[k] = np.minimum.reduceat(buffer, at[:-1])
    return np.ascontiguousarray(out.T)


def bit_planes(least: np.ndarray) -> np.ndarray:
    """The low bits of rows of minima: for each bit, the minima's bits packed in words of 64."""
    low = np.ascontiguousarray(mix(least))
    packed = [np.packbits(((low >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=1) for p in range(BITS)]
    return np.ascontiguousarray(np.concatenate(packed, axis=1)).view(np.uint64)


def _list_column(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))


def _signatures(n_bands: int):
    places = n_bands * ROWS
    multipliers = np.append(_MULTIPLIERS[:HASHES], _MORE[: max(places - HASHES, 0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, places + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in byte_slices(batches, 2, limit=SLICE_BYTES):
            values, at = shingles(batch.column(2))
            digests = np.zeros((batch.num_rows, 3), np.int64)
            for k in np.flatnonzero(np.diff(at)):
                own = np.unique(values[at[k] : at[k + 1]])
                digests[k] = (len(own), *digest_pairs(own))
            full = np.flatnonzero(np.diff(at))
            planes, bands = np.zeros((batch.num_rows, 2 * BITS), np.uint64), np.zeros((batch.num_rows, n_bands), np.uint64)
            if len(full):
                least = minima(values, np.append(at[full], at[-1]), multipliers)
                planes[full] = bit_planes(np.ascontiguousarray(least[:, :HASHES]))
                terms = least[:, :places] * weights
                bands[full] = mix(terms.reshape(len(full), n_bands, ROWS).sum(axis=2, dtype=np.uint64))
            columns = [batch.column(0), batch.column(1), *(pa.array(digests[:, k]) for k in range(3)), _list_column(planes), _list_column(bands)]
            yield pa.RecordBatch.from_arrays(columns, schema=_SIGNATURES)

    return run


def signatures(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows: row, doc_id, text."""
    return rows.select("row", "doc_id", "text").mapInArrow(_signatures(bands_of(limit)), "row binary, doc_id long, n_shingles long, set_a long, set_b long, planes array<long>, bands array<long>")


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, 1, limit=SLICE_BYTES):
        values, at = shingles(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), _list_column(bit_planes(minima(values, at, _MULTIPLIERS[HASHES:])))], names=["node", "planes"])


def equal_counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal places of all rows of x with all of y, both fine signatures, in tiles that stay in the cache."""
    words, out = FINE // 64, np.empty((len(x), len(y)), np.int16)
    for i in range(0, len(x), 32):
        for j in range(0, len(y), 1024):
            own, other = x[i : i + 32, None, :], np.ascontiguousarray(y[j : j + 1024].T)
            same = np.full((own.shape[0], other.shape[1]), FINE, np.int16)
            for k in range(words):
                differ = own[:, :, k] ^ other[k]
                for p in range(1, BITS):
                    differ |= own[:, :, p * words + k] ^ other[p * words + k]
                same -= np.bitwise_count(differ)
            out[i : i + 32, j : j + 1024] = same
    return out


def _crossing(least: int):
    """Rows (cluster, chunk, visits, node, component, minor, planes), sorted by the first three, to likely pairs (a, b, equal).

    The rows of a block come first and are held; visiting rows stream past them. A pair of two visitors is given in the
    block of its greater node only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            cluster, chunk, visits, node, of, minor = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            planes = batch.column(6).flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
            edge = np.flatnonzero((np.diff(cluster) != 0) | (np.diff(chunk) != 0) | (np.diff(visits.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(node)], strict=True):
                part = (node[a:b], of[a:b], minor[a:b].astype(bool), planes[a:b])
                if at != (cluster[a], chunk[a]):
                    at, held = (cluster[a], chunk[a]), []
                if not visits[a]:
                    held.append(part)
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                for k in range(0, b - a, 256):
                    (x, of_x, _, signs), (y, of_y, minor_y, own_signs) = (v[k : k + 256] for v in part), held[0]
                    equal = equal_counts(signs, own_signs)
                    r, c = np.nonzero((equal >= least) & (of_x[:, None] != of_y) & (~minor_y | (x[:, None] < y)))
                    yield pa.RecordBatch.from_arrays([pa.array(x[r]), pa.array(y[c]), pa.array(equal[r, c].astype(np.int32))], names=["a", "b", "equal"])

    return run


def equal_places(x: Column, y: Column) -> Column:
    """Places of two signatures with the same low bits, by bit counts over the planes."""
    count, words = None, HASHES // 64
    for k in range(words):
        differ = None
        for p in range(BITS):
            one = x[words * p + k].bitwiseXOR(y[words * p + k])
            differ = one if differ is None else differ.bitwiseOR(one)
        same = F.bit_count(F.bitwise_not(differ))
        count = same if count is None else count + same
    return count


def similarity(equal: Column) -> Column:
    """Collision-corrected estimate from a count of equal places."""
    chance = 2.0**-BITS
    return (equal / F.lit(HASHES) - chance) / (1 - chance)


def _verify(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2, 3, limit=SLICE_BYTES):
            (x, x_at), (y, y_at) = shingles(batch.column(2)), shingles(batch.column(3))
            linked, last = np.zeros(batch.num_rows, bool), (None, None)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                if last[0] != ids[k]:
                    last = (ids[k], np.unique(x[x_at[k] : x_at[k + 1]]))
                a, b = last[1], np.unique(y[y_at[k] : y_at[k + 1]])
                if 100 * min(len(a), len(b)) >= limit * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    linked[k] = both > 0 and 100 * both >= limit * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked))

    return run


def verified(pairs: DataFrame, text: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are as similar as the limit asks; text: node, text."""
    wide = pairs.select("a", "b").join(text.toDF("b", "text_b"), "b").join(text.toDF("a", "text_a"), "a")
    return wide.select("a", "b", "text_a", "text_b").mapInArrow(_verify(limit), "a long, b long").distinct()


def _classes(signed: DataFrame) -> DataFrame:
    """One row per set: node, rep (least doc_id), row (of rep), the set's digests, planes, bands.

    A class's node is its rep; where unlike rows share that doc_id, a hash that tells their classes apart.
    """
    sets = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "row")).alias("one"), F.first("planes").alias("planes"), F.first("bands").alias("bands"))
    classes = classes.select("set_a", "set_b", "n_shingles", F.col("one.doc_id").alias("rep"), F.col("one.row").alias("row"), "planes", "bands")
    alone = F.count(F.lit(1)).over(Window.partitionBy("rep")) == 1
    return classes.withColumn("node", F.when(alone, F.col("rep")).otherwise(F.xxhash64("rep", "set_a", "set_b")))


def _likely_across(shared: DataFrame, found: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """(a, b, equal): likely pairs of different components that share a bucket; shared: bucket, node, a (the bucket's least)."""
    here = shared.join(found, "node", "left").select("bucket", "node", "a", F.coalesce("component", "node").alias("component"))
    sizes = here.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "component"))["component"].alias("major"))
    inside = cut(here.join(sizes.filter("kinds > 1").select("bucket", "major"), "bucket"))
    # blocks of classes that share buckets, directly or through others
    clusters = components(inside.select("a", "node")).toDF("node", "cluster")
    members = inside.groupBy("node", "component").agg(F.max(F.col("component") != F.col("major")).alias("minor"))
    members = members.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    size = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"))
    members = cut(members.join(size, "cluster").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).drop("chunks"))
    fine = cut(texts.join(members.select("node"), "node", "left_semi").mapInArrow(_fine, "node long, planes array<long>"))
    # where a class outside a largest component has partners
    placed = inside.select("bucket", "node").join(members.select("node", "minor", "chunk"), "node")
    visits = placed.filter("minor").select("bucket", "node").join(placed.select("bucket", "chunk").distinct(), "bucket").select("node", "chunk").distinct()
    visits = visits.join(members.drop("chunk"), "node")
    order = ("cluster", "chunk", "visits", "node", "component", "minor")
    both = members.withColumn("visits", F.lit(False)).select(*order).union(visits.withColumn("visits", F.lit(True)).select(*order))
    dealt = both.join(fine, "node").select(*order, "planes").repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "visits")
    likely = cut(dealt.mapInArrow(_crossing(least_equal(limit, FINE)), "a long, b long, equal int"))
    discard(inside, members, fine, clusters)
    return likely


def near_groups(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """row (its key), doc_id, n_shingles, component_id, group (of linked rows; null for none): one row per row of docs."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row_key("doc_id", "text"))
    signed = cut(signatures(rows, limit))
    classes = cut(_classes(signed))

    member = classes.select("node", F.explode("bands").alias("bucket"))
    several = member.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").drop("last")
    shared = cut(member.join(several, "bucket"))
    stars = cut(shared.filter("node <> a").select("a", F.col("node").alias("b")).distinct())
    # texts of all that share a bucket, once: later steps read these
    sharing = shared.select("node").distinct()
    wanted = cut(classes.select("node", "row").join(sharing, "node", "left_semi"))
    texts = rows.select("row", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted, "row")
    texts = cut(texts.select("node", "text").dropDuplicates(["node"]))
    plane = classes.select(F.col("node").alias("a"), F.col("planes").alias("x"))
    likely = stars.join(plane, "a").join(plane.toDF("b", "y"), "b").filter(similarity(equal_places(F.col("x"), F.col("y"))) >= similarity(F.lit(least_equal(limit))) - 1e-9)
    links = cut(verified(likely, texts, limit))
    discard(stars, wanted)
    found = components(links)

    # buckets that still hold several components
    untested, many = _likely_across(shared, found, texts, limit), FIRST_ROUND
    discard(shared)
    while not untested.isEmpty():
        # pairs that earlier links have brought together need no test
        at = found.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
        apart = untested.join(at, "a", "left").join(at.toDF("b", "of_b"), "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "equal")
        ranked = cut(apart.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("equal"), "b"))))
        discard(untested)
        more = cut(verified(ranked.filter(F.col("rank") <= many), texts, limit))
        if not more.isEmpty():
            links = links.union(more)
            before, found = found, components(links)
            discard(before)
        untested = cut(ranked.filter(F.col("rank") > many).drop("rank"))
        discard(ranked)
        many *= 4
    discard(texts)

    labelled = classes.select("set_a", "set_b", "n_shingles", "node", "rep").join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    if classes.filter("node <> rep").isEmpty():
        labelled = labelled.withColumn("component_id", F.col("group"))
    else:
        labelled = labelled.join(labelled.groupBy("group").agg(F.min("rep").alias("component_id")), "group")
    labelled = labelled.select("set_a", "set_b", "n_shingles", "group", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    linked = signed.select("row", "doc_id", "n_shingles", "set_a", "set_b").join(labelled, ["set_a", "set_b", "n_shingles"], "left")
    return linked.select("row", "doc_id", "n_shingles", own.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"))


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    groups = near_groups(docs, limit)
    return groups.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the least doc_id; all columns, of any names.

    Rows without a doc_id or without words belong to no group and all stay. Unlike rows with one doc_id are told apart;
    of repeated rows one stays. No rows give none.
    """
    groups = near_groups(docs, limit).filter("group is not null")
    chosen = groups.groupBy("group").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row")).select("row")
    rows = whole_rows(docs)
    grouped = F.coalesce(F.col("doc.doc_id").isNotNull() & F.col("doc.text").rlike(r"[^ \t-\r]"), F.lit(False))
    own = rows.filter(grouped).withColumn("row", row_key(F.col("doc.doc_id").cast("long"), "doc.text"))
    kept = own.join(chosen, "row", "left_semi").dropDuplicates(["row"]).select("doc")
    return kept.union(rows.filter(~grouped)).select("doc.*")
