"""Sharding by jump consistent hashing.

No ring table: the key and the number of shards give the shard, and one more shard takes its rows
from all others but moves no row between those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import grouped_rank, numbered, quoted


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach, "A fast, minimal memory, consistent hash algorithm")."""
    if shards < 1:
        raise ValueError(f"there must be at least one shard, not {shards}")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    target = np.zeros(len(state), np.int64)
    while len(going):  # each turn raises a key's shard, so there are at most ``shards`` turns
        shard[going] = target
        state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1
        target = ((shard[going] + 1) * (2.0**31 / draw)).astype(np.int64)
        stay = target < shards
        going, target = going[stay], target[stay]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of a key column of any type (a null key is a key like any other).

    Keys are hashed as text, so that a number has one shard whether it comes as an int or a long.
    """

    @F.pandas_udf("int")
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump(keys.to_numpy().view(np.uint64), shards).astype(np.int32))

    jump(np.zeros(0, np.uint64), shards)
    return numbers(F.xxhash64(key.cast("string")))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, place in the shard and the shard after growth by one, for each row.

    Returns the key, ``size`` (UTF-8 bytes of the text plus 1; null text: 1), ``text_crc32``,
    ``law``, ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard``.  Rows of one key
    share a shard.  Only the key and a few numbers are shuffled, and a shard is numbered in parts, so
    no task holds a whole one.  A text of any length is read whole, and only its size and checksum leave.  An
    empty table gives an empty result; other columns are not looked at.  The key comes first and keeps its name;
    a column of the result that has the same name gets the prefix ``shard_``.
    """
    raw = F.encode(F.coalesce(quoted(text), F.lit("")), "UTF-8")
    rows = docs.select(
        quoted(key).alias("__key"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(quoted(key), shards).alias("shard"),
        shard_of(quoted(key), shards + 1).alias("grown_shard"),
    )
    ranked = grouped_rank(numbered(rows, "shards"), ["shard"], "slot")
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return ranked.select(F.col("__key").alias(key), *[F.col(c).alias(f"shard_{c}" if c == key else c) for c in names])


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write the rows with a folder for each shard."""
    docs.withColumn("shard", shard_of(quoted(key), shards)).write.partitionBy("shard").mode("overwrite").parquet(path)
