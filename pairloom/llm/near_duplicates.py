"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

1. Each text gets its set of word shingles, a digest of the set and a sketch, cut into bands.
2. Copies (equal sets) become one node, so no group of copies is compared with itself.
3. Nodes that share a band form a bucket.  In a bucket of at most ``SMALL`` nodes all pairs are
   verified; in a larger one every node is verified against the one that meets the most nodes in all
   large buckets: as many pairs as members.  The links found join nodes into components.
4. What a large bucket may still hide are links between its components.  Nodes of large buckets that
   hold several components are searched exactly: two sets that similar share one of their rarest
   shingles (prefix filter), so pairs of different components that share one are verified.
5. All links give the components.

With 40 bands of 4 coordinates a pair of similarity 0.75 shares no band with a probability of 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from pairloom.llm.common import as_batch, mix, quoted, saved, shared_path, short_shuffles, small_batches, temporary, text_slices, written
from pairloom.llm.components import components
from pairloom.llm.sketches import SHINGLE, band_keys, fast_sketches, shingle_sets

ROWS, BANDS = 4, 40
#: Buckets with at most so many nodes are compared pair by pair.
SMALL = 16
#: Links have at least this similarity, in hundredths.
LEAST = 75


def signatures(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, node, check, bands) of each row; without words the bands are empty.

    The key is a hash of doc_id and text, by which a text is found again; node and check name the set.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, flat, at in text_slices(batch.column(2)):
                elements, numbers = shingle_sets(flat, at, shingle)
                bands = band_keys(fast_sketches(elements, numbers, ROWS * BANDS), ROWS).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum((numbers > 0) * BANDS)]).astype(np.int32)
                yield as_batch(
                    batch.slice(row, end - row),
                    ["doc_id", "key"],
                    n_shingles=pa.array(numbers, pa.int64()),
                    node=pa.array(_names(elements, numbers, NODE)),
                    check=pa.array(_names(elements, numbers, CHECK)),
                    bands=pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel())),
                )

    schema = StructType().add("doc_id", docs.schema["doc_id"].dataType)
    for name in ("key", "n_shingles", "node", "check"):
        schema.add(name, "long")
    return _keyed(docs, text).mapInArrow(sign, schema.add("bands", ArrayType(LongType())))


def _key(text: str) -> Column:
    return F.xxhash64("doc_id", quoted(text))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", _key(text).alias("key"), quoted(text).alias("text"))


#: Two 64-bit names of a set tell sets apart; links name it by the first alone.
NODE, CHECK = 0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5


def _names(elements: np.ndarray, numbers: np.ndarray, salt: int) -> np.ndarray:
    some, out = np.flatnonzero(numbers), np.zeros(len(numbers), np.uint64)
    if len(some):
        out[some] = np.add.reduceat(mix(elements ^ np.uint64(salt)), (np.cumsum(numbers) - numbers)[some])
    return out.view(np.int64)


def _similar_sizes(a: Column, b: Column, least: int) -> Column:
    return 100 * F.least(a, b) >= least * F.greatest(a, b)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, text: str) -> DataFrame:
    """(node, shingles) of the texts with the wanted keys."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, flat, at in text_slices(batch.column(0)):
                elements, numbers = shingle_sets(flat, at, shingle)
                offsets = pa.array(np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_names(elements, numbers, NODE)), lists], ["node", "shingles"])

    # the texts are shuffled whether the keys fit in a broadcast or not: the plan is the same at every size
    return _keyed(docs, text).join(wanted.hint("merge"), "key", "left_semi").select("text").mapInArrow(cut, "node long, shingles array<long>")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    # a table of pairs that fits is not broadcast either: the plan is the same at every size
    joined = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("any"))
    return joined.where(100 * F.col("both") >= least * F.col("any")).select("a", "b").distinct()


def _prefixes(sets: DataFrame, least: int) -> DataFrame:
    """(node, n, shingle, place) of each set's rarest shingles: all but as many as similar sets must share, less one."""
    grams = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = grams.groupBy("shingle").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    ranked = grams.join(often, "shingle").select("node", "n", "shingle", place.alias("place"))
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least / 100) + 1)


def _prefix_pairs(rare: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar, from their first common rare shingle.

    Sets of n and m shingles are similar if they share at least least (n + m) / (100 + least).  Before
    the first common shingle, at places i and j, they share nothing, so they share at most what is
    left from there in either.  That also shortens the prefix of the smaller set of each pair.
    """
    one = rare.select("shingle", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("place").alias("i"), F.col("component").alias("cx"))
    one = one.where((100 + least) * (F.col("nx") - F.col("i") + 1) >= 2 * least * F.col("nx"))
    two = rare.select("shingle", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("place").alias("j"), F.col("component").alias("cy"))
    order = (F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))
    left = F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) + 1
    enough = (100 + least) * left >= least * (F.col("nx") + F.col("ny"))
    fits = order & (F.col("cx") != F.col("cy")) & _similar_sizes(F.col("nx"), F.col("ny"), least) & enough
    return one.join(two, "shingle").where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(docs: DataFrame, least: int = LEAST, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Rows are linked by their texts, whatever their doc_ids: those without one, or that share one, are
    compared like others.  Texts without words are linked with nothing.  A component of rows without
    doc_id has none either (null), and a row is kept if its doc_id is that of its component.  An empty
    table gives no rows; other columns are not looked at.
    """
    rows, nodes, final = _linked(docs.withColumn("doc_id", F.col("doc_id").cast("long")), least, shingle, text)
    # few nodes are linked; the others are components of their own
    least_ids = final.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = final.join(least_ids, "component").select("node", F.lit(True).alias("linked"), "component_id")
    own = nodes.select("node", "check", "doc_id").join(linked, "node", "left")
    named = own.select("node", "check", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "node", "check").join(named, ["node", "check"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, least: int = LEAST, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """(doc_id, text) and the other columns of one row of each component: that of the least doc_id, rows without one last.

    Rows without words are all kept; of rows that repeat a doc_id and text one is kept.  The rows are
    read anew, not copied: until the result is written, only keys of the kept ones are on disk.  The
    other columns must have plain names, as ``plain_columns`` gives them.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "winners")
    with temporary(spark), short_shuffles(spark):
        rows, nodes, final = _linked(docs, least, shingle, text)
        # the row that stands for a set is the first of its rows in this order
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
        of_links = nodes.join(final, "node").groupBy("component").agg(first).select("first.key")
        winners = of_links.union(nodes.join(final, "node", "left_anti").select("key")).distinct()
        repeated = rows.where("n_shingles > 0").groupBy("key").agg((F.count("*") > 1).alias("repeated")).where("repeated")
        winners = saved(winners.join(repeated, "key", "left").select(F.col("key").alias("__key"), F.col("repeated").isNotNull().alias("repeated")), path)

    worded = F.coalesce(quoted(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.where(worded).withColumn("__key", _key(text))
    out = keyed.join(winners.where("not repeated"), "__key", "left_semi")
    if not winners.where("repeated").isEmpty():
        # dealt to several tasks, which leave one row of each key, as one row may be repeated very often
        deals = winners.where("repeated").select("__key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("__deal"))
        dealt = keyed.withColumn("__deal", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
        once = dealt.join(deals, ["__key", "__deal"], "left_semi").dropDuplicates(["__key", "doc_id", text])
        out = out.union(once.select(out.columns))
    return out.select(docs.columns).union(docs.where(~worded))


def _linked(docs: DataFrame, least: int, shingle: int, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures of the rows, the nodes (a row for each set) and (node, component) of those that are linked with another."""
    spark = docs.sparkSession
    path = shared_path(spark, "components")
    with small_batches(spark), short_shuffles(spark):
        rows = written(signatures(docs, shingle, text), "signatures")
        # a text that stands for its set: of the least doc_id, so that few rows have the same doc_id and text
        chosen = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("chosen")
        sets_of = rows.where("n_shingles > 0").groupBy("node", "check").agg(chosen, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        nodes = written(sets_of.select("node", "check", "chosen.doc_id", "chosen.key", "n", "bands"), "nodes")
        with temporary(spark):
            return rows, nodes, saved(_components_of(docs, nodes, least, shingle, text), path)


def _components_of(docs: DataFrame, nodes: DataFrame, least: int, shingle: int, text: str) -> DataFrame:
    """(node, component) of the nodes that are linked with another."""
    entries = nodes.select("node", "n", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = written(entries.join(buckets, "band").select("band", "members", "node", "n"), "members")
    large = members.where(F.col("members") > SMALL)
    # copies are more like the text that they were made from than like each other, so that text meets the most nodes
    reach = large.groupBy("node").agg(F.sum("members").alias("reach"))
    hub = F.max_by("node", F.struct("reach", "node")).alias("hub")
    hubs = written(large.join(reach, "node").groupBy("band").agg(hub), "hubs")
    star = large.join(hubs, "band").where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    pairs = written(_pairs(members.where(F.col("members") <= SMALL), "band", least).union(star).distinct(), "pairs")
    needed = _ends(pairs).union(large.select("node")).distinct().join(nodes.select("node", "key"), "node")
    wanted = written(needed.select("key").distinct(), "wanted")  # keys alone: copies of a text have one row here
    sets = written(_sets(docs, wanted, shingle, text), "sets")
    if sets.count() > wanted.count():  # rows that repeat a doc_id and text
        sets = written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    links = written(_verified(pairs, sets, least), "links")

    first = written(components(links), "first")
    found = large.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # written, so that its size is known and a small table is broadcast without a shuffle by band
    mixed = written(found.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band"), "mixed")
    open_nodes = written(found.join(mixed, "band", "left_semi").select("node", "component").distinct(), "open")
    rare = written(_prefixes(sets.join(open_nodes, "node", "left_semi"), least).join(open_nodes, "node"), "prefixes")
    more = _prefix_pairs(rare, least).distinct().join(pairs, ["a", "b"], "left_anti")
    # what is new ties whole components together
    more = written(_verified(written(more, "pairs"), sets, least), "links")
    for end in "ab":
        tied = first.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        more = more.join(tied, end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    second = components(more).select(F.col("node").alias("component"), F.col("component").alias("final"))
    alone = second.select(F.col("component").alias("node"), F.col("final").alias("component"))
    merged = first.join(second, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    # a node that only new links tie is no node of the first components
    return merged.union(alone.join(first.select("node"), "node", "left_anti"))


def _pairs(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Pairs (a, b) of nodes of similar sizes with the same key."""
    one = rows.select(key, F.col("node").alias("a"), F.col("n").alias("na"))
    two = rows.select(key, F.col("node").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & _similar_sizes(F.col("na"), F.col("nb"), least)
    return one.join(two, key).where(fits).select("a", "b")
