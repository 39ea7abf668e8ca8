"""A trie of conversations by their common beginnings.

Each turn is named by a hash of role and text; where different turns share a hash they are told apart
by a number.  Polynomial fingerprints of all beginnings of a conversation come from one scan along its
turns.  Beginnings with the same depth and fingerprint are a group of candidates: each member's last
turn and the beginning before it are compared with those of the group's representative, so a group
whose members all agree is exact if the groups one turn before are; groups that don't agree are split.
Children, leaves and tokens are then rolled up to the parents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import written
from pairloom.llm.mixing import WORDS
from pairloom.llm.prefix_scan import prefix_scan

#: Base of the polynomial, an odd number.
BASE = 0xD6E8FEB86659FD93
#: Conversations whose ids share all but these last bits have their ids joined by one task.
BLOCK_BITS = 12


def keyed_turns(conversations: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(conv_id, at, h, twin, words): the turns in their order from 0, named by ``h`` and ``twin``.

    Turns are ordered by ``turn``, null first, then by role and by the MD5 of the text; a null role or
    text is empty.  Equal names mean equal role and text: all distinct turns of one hash are compared,
    and where there are several, ``twin`` numbers them.  Rows without conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("h", F.xxhash64("role", "text").bitwiseAND(F.lit((1 << hash_bits) - 1 if hash_bits < 64 else -1)))
    kinds = rows.select("h", "role", "text").distinct()
    shared = written(kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    if shared.isEmpty():
        rows = rows.withColumn("twin", F.lit(0))
    else:
        twin = F.row_number().over(Window.partitionBy("h").orderBy("role", "text")) - 1
        twins = kinds.join(shared, "h", "left_semi").withColumn("twin", twin)
        rows = rows.join(twins, ["h", "role", "text"], "left")
    words = F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")
    small = rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("name"), "h", F.coalesce("twin", F.lit(0)).alias("twin"), words)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("name"), F.col("h")]
    return prefix_scan(small, "conv_id", order, "h").select("conv_id", "at", "h", "twin", "words")


def unforked(turns: DataFrame) -> DataFrame:
    """The turns with ``length``, the number of turns of their conversation."""
    return turns.join(turns.groupBy("conv_id").agg(F.count("*").alias("length")), "conv_id")


def forked(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt on the first turns of a common one: (conv_id, at, h, twin, words, length).

    Conversation c begins with the first h turns of conversation c - c % ``family`` (all if it has fewer,
    none if it is absent), h = crc32(c) % ``most``, and goes on with its own turns after its first h.
    A conversation without turns is one row with ``at`` null.
    """
    turn = F.struct("at", "h", "twin", "words")
    heads = F.array_sort(F.collect_list(F.when(F.col("at") < most, turn)))  # nulls are left out: at most ``most`` turns
    convs = written(turns.groupBy("conv_id").agg(F.count("*").alias("n"), heads.alias("heads")), "conversations")
    base = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("heads").alias("first"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    kin = convs.withColumn("taken", taken).join(base, F.col("conv_id") - F.col("conv_id") % family == F.col("base"), "left")
    kin = kin.withColumn("first", F.coalesce(F.slice("first", F.lit(1), F.col("taken")), F.array().cast("array<struct<at:bigint,h:bigint,twin:int,words:bigint>>")))
    length = F.size("first") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))
    kin = written(kin.select("conv_id", "taken", "first", length.cast("long").alias("length")), "forks")
    begun = kin.select("conv_id", "length", F.explode_outer("first").alias("t")).select("conv_id", F.col("t.*"), "length")
    begun = begun.where("at is not null or length = 0")
    own = turns.join(kin.select("conv_id", "taken", F.size("first").alias("before"), "length"), "conv_id").where("at >= taken")
    own = own.select("conv_id", (F.col("at") + F.col("before") - F.col("taken")).alias("at"), "h", "twin", "words", "length")
    return begun.unionByName(own)


def rebuilt_turns(conversations: DataFrame, hash_bits: int = 64) -> DataFrame:
    return forked(keyed_turns(conversations, hash_bits))


def _split(rows: DataFrame) -> DataFrame:
    """The rows with groups named by their least conversation, groups whose members differ split.

    A group is split by its members' last turn and the group before it, again until all agree: a
    collision at a depth may part the groups of all greater ones.
    """
    while True:
        parts = rows.groupBy("depth", "g", "before", "h", "twin").agg(F.min("conv_id").alias("least"))
        named = written(rows.join(parts, ["depth", "g", "before", "h", "twin"]).drop("g", "before").withColumnRenamed("least", "g"), "named")
        above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("g").alias("before"))
        rows = written(named.join(above, ["conv_id", "depth"], "left").withColumn("before", F.coalesce("before", F.lit(0))), "split")
        if _groups(rows).where("low != high").isEmpty():
            return rows


def _groups(rows: DataFrame) -> DataFrame:
    """(depth, g, conv_id, n_convs, words, low, high): what its members have, at least and at most."""
    same = F.struct("before", "h", "twin")
    sums = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min(same).alias("low"), F.max(same).alias("high")]
    return rows.groupBy("depth", "g").agg(*sums)


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, g, ends_sha256) of the conversations that end at a node, in the order of their numbers.

    Ids are joined by blocks of at most 2**BLOCK_BITS; the blocks of a node are digested one after
    another, so no list of a whole node is in memory.
    """
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = rows.where("depth = length").groupBy("depth", "g", block).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for depth, g, ids in zip(*(batch[c].to_pylist() for c in ("depth", "g", "ids")), strict=True):
                if node != (depth, g):
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (depth, g), hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield _rows(out)
        if node:
            yield _rows([(*node, sha.hexdigest())])

    sorted_blocks = blocks.repartition("depth", "g").sortWithinPartitions("depth", "g", "block")
    return sorted_blocks.mapInArrow(digest, "depth long, g long, ends_sha256 string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["depth", "g", "ends_sha256"])


def conversation_trie(turns: DataFrame, fingerprint_bits: int = 64) -> DataFrame:
    """A row for each distinct beginning of the conversations, from the root (depth 0, without text).

    ``turns`` are (conv_id, at, h, twin, words, length), see ``keyed_turns``, ``unforked`` and ``forked``.
    Returns ``conv_id`` (the least member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``
    (members), ``n_children``, ``n_leaves`` (childless nodes in the subtree), ``saved_tokens`` (over the
    subtree, the words of a node's last turn times its members but one) and ``ends_sha256`` (digest of
    the members without more turns).  No conversations give no rows; copies are members each.

    Of the nodes that a conversation is the least member of, all but the first are below one another, so
    what is summed over subtrees is summed for each conversation once and then over the members of each node:
    one pass for all depths, partial sums before the shuffle.
    """
    keyed = turns.where("at is not null").withColumn("v", F.xxhash64("h", "twin"))
    mask = F.lit((1 << fingerprint_bits) - 1 if fingerprint_bits < 64 else -1)
    scanned = prefix_scan(keyed, "conv_id", [F.col("at")], "v", BASE)
    named = scanned.select("conv_id", (F.col("at") + 1).alias("depth"), F.col("upto").bitwiseAND(mask).alias("g"), F.col("before").bitwiseAND(mask).alias("before"), "h", "twin", "words", "length")
    zero = F.lit(0).cast("long")
    roots = turns.where("at = 0 or at is null").select("conv_id", zero.alias("depth"), zero.alias("g"), zero.alias("before"), zero.alias("h"), F.lit(0).alias("twin"), zero.alias("words"), "length")
    rows = written(named.unionByName(roots), "beginnings")
    groups = written(_groups(rows), "groups")
    if not groups.where("low != high").isEmpty():
        rows = _split(rows)
        groups = written(_groups(rows), "groups")
    nodes = groups.select("depth", "g", "conv_id", "n_convs", (F.col("words") * (F.col("n_convs") - 1)).alias("own"), F.when(F.col("depth") > 0, F.col("low.before")).alias("up"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("g")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "g"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = prefix_scan(nodes, "conv_id", [F.col("depth")], "own").withColumnRenamed("before", "above")
    totals = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    below = rows.select("conv_id", "depth", "g").join(totals, "conv_id").groupBy("depth", "g").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("g").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(below, ["depth", "g"]).join(_ends(rows), ["depth", "g"], "left").join(parents, ["depth", "up"], "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved") - F.col("above")).alias("saved_tokens"), ends)
