"""Mixing sources to target weights by systematic sampling.

Sources share the words of all documents by weight, none beyond ``cap`` times its own words.  Inside a
source each document expects target / source words copies.  The expectations are summed along an order
of the documents, one random offset is added, and a document is emitted once for each integer that its
stretch of the sum crosses.  Documents are ordered by classes of size, so that the words that are taken
stray from the target by few documents; inside a class the order is that of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import let, plain_columns, quoted, written

#: Weights of the sources by their order, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a document, and the most that a target is of its source's words.
CAP = 3
#: Documents that a task puts in order.
ROWS_A_PART = 50_000
WORDS = r"[^\x20\x09-\x0D]+"


def _digits(text: Column, n: int) -> Column:
    """The first ``n`` hex digits of the MD5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Rises with the size; the sizes of a class differ by at most one part in 32."""
    over = let((F.length(F.bin(size)) - 6).cast("int"), lambda e: 32 * e + F.call_function("shiftright", size, e))
    return F.when(size < 64, size).otherwise(over).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 0) -> DataFrame:
    """(none, source, source_size, target, ratio, offset) of rows with ``none``, ``source`` and ``size``.

    Sources are ordered by code point, null (``none``) last, and weigh ``weights``, repeating.  Targets
    are the weighted shares of all words; what exceeds ``cap`` times a source's words is shared again by
    the others.  In the order of cap / weight the sources at their cap come first, so the level of the
    others follows from running sums.  These windows run in one task, over one row for each source.
    """
    place = Window.orderBy("none", "source")
    weight = F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights)).cast("int"))
    sums = sizes.groupBy("none", "source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    most = sums.withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most") / F.col("weight"))
    rising = Window.orderBy("level", "none", "source")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0))
    shared = most.withColumn("share", left / F.sum("weight").over(after))
    free = F.when(F.col("level") > F.col("share"), F.struct("level", "none", "source", "share"))
    shared = shared.withColumn("share", F.min(free).over(all_rows)["share"])  # that of the first source below its cap
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("share") * F.col("weight"), F.col("most").cast("double")))
    ratio = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    offset = (_digits(F.concat_ws("|", F.lit(seed), F.when(~F.col("none"), F.col("source"))), 4) + 0.5) / 65536
    return shared.select("none", "source", "source_size", target.alias("target"), ratio.alias("ratio"), offset.alias("offset"))


def _placed(sizes: DataFrame, rows_a_part: int) -> DataFrame:
    """(none, source, key, size, n, start): equal rows as one, with the number of rows of their source before them.

    The order is that of the class of size, then of the MD5 of key and size.  A class of a source is cut
    into parts by ranges of the hash, as many as its rows ask for, so no task holds a whole source; equal
    rows are one row here, however many they are.
    """
    name = F.md5(F.concat_ws("|", F.col("key").cast("string"), F.col("size").cast("string")).cast("binary"))
    groups = sizes.groupBy("none", "source", "key", "size").agg(F.count("*").alias("n"))
    groups = written(groups.select("*", size_class(F.col("size")).alias("class"), name.alias("name")), "groups")
    group = ["none", "source", "class"]
    counts = groups.groupBy(*group).agg((1 + F.floor(F.count("*") / rows_a_part)).alias("parts"))
    part = F.shiftrightunsigned(F.conv(F.substring("name", 1, 8), 16, 10).cast("long") * F.col("parts"), 32)
    # dealt by parts before the windows, which would else run where the join has put whole classes
    dealt = groups.join(counts, group).withColumn("part", part).repartition(*group, "part")
    own = Window.partitionBy(*group, "part").orderBy("name", "key").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "part").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("none", "source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*group, "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(bases, [*group, "part"])
    return ranked.select("none", "source", "key", "size", "n", (F.col("base") + F.col("own")).alias("start"))


def _copies(place: Column) -> Column:
    """How many integers the sum crosses at the row with so many rows of its source before it."""
    crossed = lambda k: F.floor(F.col("offset") + F.col("ratio") * k)
    return (crossed(place + 1) - crossed(place)).cast("int")


def _size_columns(key: str, source: str, text: str) -> list[Column]:
    words = F.regexp_count(F.coalesce(quoted(text), F.lit("")), F.lit(WORDS)).cast("long")
    name = quoted(source).cast("string")
    return [name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("source"), quoted(key).alias("key"), words.alias("size")]


def sample_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text", rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies), one row for each document.

    ``size`` counts the words of the whole text (null: 0, however long it is), ``copies`` how often the
    mix takes the document (at most ``cap``, a whole number), ``taken`` its words with repeats.  The
    result depends on nothing but keys, sources, sizes and the seed.  Repeated rows and null keys are
    documents like others; null is a source of its own; a source without words has the target 0; an
    empty table gives an empty result; other columns are not looked at.  Only keys and sizes are shuffled.
    """
    sizes = written(docs.select(*_size_columns(key, source, text)), "sizes")
    found = _placed(sizes, rows_a_part).join(source_targets(sizes, weights, cap, seed), ["none", "source"])
    # equal rows apart again, a million at once
    blocks = found.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1_000_000))))
    last = F.least(F.col("n") - 1, F.col("block") * 1_000_000 + 999_999)
    each = blocks.withColumn("place", F.explode(F.sequence(F.col("block") * 1_000_000, last)))
    rows = each.withColumn("copies", _copies(F.col("start") + F.col("place")))
    named = F.when(~F.col("none"), F.col("source")).alias("source")
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), named, "copies")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text", rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """The mix itself: all columns of the documents, a row for each copy that ``sample_copies`` takes.

    Rows of one key, source and size are numbered among themselves, in parts where they are many, to
    tell which of them are taken.
    """
    plain, content = plain_columns(docs, text)
    columns = [plain.columns[docs.columns.index(c)] for c in (key, source)]
    rows = written(plain.withColumn("__row", F.monotonically_increasing_id()), "rows")
    equal = F.md5(F.to_json(F.struct("none", "source", "key", "size")).cast("binary")).alias("equal")
    sizes = written(rows.select("__row", *_size_columns(*columns, content)), "sizes")
    placed = _placed(sizes.drop("__row"), rows_a_part).join(source_targets(sizes, weights, cap, seed), ["none", "source"])
    found = written(placed.select(equal, "n", "start", "ratio", "offset"), "placed")
    many = found.where(F.col("n") > rows_a_part).select("equal", (1 + F.floor(F.col("n") / rows_a_part)).alias("parts"))
    dealt = sizes.select("__row", equal).join(many, "equal", "left")
    dealt = written(dealt.select("__row", "equal", F.pmod(F.xxhash64("__row"), F.coalesce("parts", F.lit(1))).alias("part")), "dealt")
    inside = dealt.withColumn("own", F.row_number().over(Window.partitionBy("equal", "part").orderBy("__row")) - 1)
    before = Window.partitionBy("equal").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("equal", "part").agg(F.count("*").alias("held"))
    bases = held.select("equal", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    numbered = inside.join(bases, ["equal", "part"]).select("__row", "equal", (F.col("own") + F.col("base")).alias("place"))
    copies = numbered.join(found, "equal").select("__row", _copies(F.col("start") + F.col("place")).alias("__copies")).where("__copies > 0")
    mixed = rows.join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return mixed.select(plain.columns).toDF(*docs.columns)
