"""What the operators share: written tables, gapless ranks and words of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.session import saved, shared_path, short_shuffles, temporary, written  # noqa: F401  for the operators

#: Bytes of text that the numpy steps look at together; a longer text is looked at alone.
SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch where texts go to Python, unless the session asks for fewer.
BATCH_ROWS = 1000


def quoted(name: str) -> Column:
    """A column by its name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plain_columns(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The rows with columns k0, k1, ... by their places, and the name of the text among them.

    So no name of an input column can clash with those that an operator adds; ``toDF`` gives the names back.
    """
    names = [f"k{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index(text)]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside the block sends at most ``BATCH_ROWS`` rows to Python at once, to bound the memory of both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows that a task of a rank numbers.
ROWS_A_PART = 50_000


def grouped_rank(df: DataFrame, group: list[str], out: str = "rank", rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """Add a gapless rank from 0 inside each group, in any order; no task holds a whole group.

    ``df`` must be a written table with a column ``__id`` that differs in each row (see ``numbered``).
    A group of n rows is dealt by that number into 1 + n / ``rows_a_part`` parts; rows are numbered in
    their part, and the counts of the parts before are added.  ``df`` is read three times, the first two
    times for counts only.  Groups are few (shards, lengths) and not null: their sizes are broadcast.
    """
    part, base = "__part", "__base"
    sizes = df.groupBy(*group).agg((1 + F.floor(F.count("*") / rows_a_part)).alias("__parts"))
    dealt = df.join(F.broadcast(sizes), group).withColumn(part, F.pmod(F.xxhash64("__id"), F.col("__parts"))).drop("__parts")
    ranked = dealt.withColumn(out, F.row_number().over(Window.partitionBy(*group, part).orderBy("__id")) - 1)
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, part).agg(F.count("*").alias("__n"))
    bases = counts.withColumn(base, F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return ranked.join(bases, [*group, part]).withColumn(out, (F.col(out) + F.col(base)).cast("long")).drop(part, base, "__id")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with ``__id``, a number of each row, written: so it stays the same whoever reads it."""
    return written(df.withColumn("__id", F.monotonically_increasing_id()), name)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes at most."""
    flat, at = column_bytes(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1))
        yield row, end, flat[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(keep: Callable[[int], bool]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it is part of words, and the byte with A-Z lowered."""
    return np.array([keep(b) for b in range(256)]), np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


#: Words are runs without ASCII white space; or runs of digits, letters and all beyond ASCII.
SPACED = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 to base**(n - 1), kept for runs of the usual length."""
    have = _POWERS.get(base, np.zeros(0, np.uint64))
    if len(have) < n:
        have = np.full(max(n, min(4096, SLICE_BYTES)), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


class Words:
    """Words of a run of texts: ``start``, ``end`` (bytes), ``row`` and a 64-bit ``hash`` of each."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
        inside, self.low = table[0][flat], table[1][flat]
        edge, stop = inside.copy(), inside.copy()
        edge[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        borders = at[1:-1]  # a word ends where its text ends
        borders = borders[(borders > 0) & (borders < len(flat))]
        edge[borders], stop[borders - 1] = inside[borders], inside[borders - 1]
        self.start, self.end = np.flatnonzero(edge), np.flatnonzero(stop) + 1
        self.row = np.searchsorted(at, self.start, "right") - 1
        # the sum of value * base**place over each word, from running sums over the whole run
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_VALUES[self.low] * _powers(len(flat), _BASE), out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * _powers(len(flat), _INVERSE)[self.start]
        self.hash = mix(value ^ ((self.end - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        self.counts = np.bincount(self.row, minlength=len(at) - 1)

    def grams(self, n: int) -> np.ndarray:
        """A hash of each ``n`` following words, wherever they begin; the last n - 1 are left out."""
        m = max(0, len(self.hash) - n + 1)
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9FB21C651E98DF25) + self.hash[k : k + m]
        return mix(out)


def as_batch(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    """The named columns of a batch, and more."""
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + list(more.values()), [*keep, *more])
