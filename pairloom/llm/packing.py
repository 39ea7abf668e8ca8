"""Packing documents into sequences by minimum bin slack.

Each sequence is seeded with the longest piece left and filled with the fullest combination of the
lengths that are left, found by subset sums in a bitset.  Only the counts of lengths matter for
that, so the plan is made from a histogram of at most ``size`` numbers: a combination is taken as
often as its lengths allow.  Pieces then find their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import as_batch, grouped_rank, numbered, quoted, text_slices
from pairloom.llm.tokens import default_path, encoder

SIZE, END = 2048, 0


def fullest(counts: list[int], room: int) -> Counter:
    """The combination of at most ``counts[length]`` pieces of each length that fills ``room`` best.

    Subset sums: bit s of ``reach`` says that s can be filled with the lengths so far, longest first.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, share = min(counts[length], room // length), 1
        while left:  # shares of 1, 2, 4, ... pieces make up every number of them
            take = min(share, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, share = left - take, share * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return chosen


def plan_bins(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, Counter]]:
    """(times, combination) in the order in which sequences are filled.

    A combination stays the fullest one for the next seed while its lengths last, so it is taken that
    often at once; each turn uses up a length, so there are at most ``size`` turns.
    """
    counts = [0] * (size + 1)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    for seed in range(size, 0, -1):
        while counts[seed]:
            counts[seed] -= 1
            combination = fullest(counts, size - seed)
            counts[seed] += 1
            combination[seed] += 1
            times = min(counts[length] // n for length, n in combination.items())
            for length, n in combination.items():
                counts[length] -= times * n
            out.append((times, combination))
    return out


class Places:
    """The plan as sorted arrays: ranks of a length from ``low`` on belong to one combination."""

    def __init__(self, plan: list[tuple[int, Counter]]):
        used, rows, bins = Counter(), [], 0
        for times, combination in plan:
            offset = 0
            for length, n in sorted(combination.items(), reverse=True):
                rows.append((length, used[length], n, bins, offset))
                used[length] += times * n
                offset += length * n
            bins += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.low, self.n, self.bin, self.offset = table.T
        self.key = (self.length << 48) + self.low

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks."""
        k = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        copy, slot = np.divmod(rank - self.low[k], self.n[k])
        return self.bin[k] + copy, self.offset[k] + slot * length


def token_pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, ids: bool = False, text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and the end id.

    A document of more than ``size`` ids is cut into full pieces; only the first may be shorter.
    """
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or default_path())
        for batch in batches:
            for row, end, flat, at in text_slices(batch.column(1)):
                found, counts = encode.encode(flat, at)
                stops = np.cumsum(counts)
                out, whose = [], []
                for i, (a, b) in enumerate(zip(stops - counts, stops, strict=True)):
                    own = np.append(found[a:b], np.uint32(END)).astype("<u4")
                    first = len(own) % size or size
                    bounds = [0, *range(first, len(own) + 1, size)]
                    for k, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        raw = own[x:y].tobytes()
                        out.append((k, x, y - x, zlib.crc32(raw), raw)[: len(names)])
                        whose.append(row + i)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=False)]
                yield as_batch(batch.take(pa.array(whose)), ["doc_id"], **dict(zip(names, cols, strict=True)))

    rows = docs.select("doc_id", quoted(text).alias("__text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def pack_documents(docs: DataFrame, size: int = SIZE, path: str | None = None, ids: bool = False, text: str = "text") -> DataFrame:
    """The pieces of all documents with their sequence and offset there.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives no
    rows; other columns are not looked at.  With ``ids`` the little-endian ids of each piece come
    along, for ``write_sequences``.  The driver gets the histogram of lengths, at most ``size`` numbers.
    """
    pieces = numbered(token_pieces(docs, size, path, ids, text), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan_bins(histogram, size)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = places.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": at[0], "offset": at[1]})

    ranked = grouped_rank(pieces, ["length"], "rank")
    columns = [F.col(c) for c in pieces.columns if c != "__id"]
    return ranked.select(*columns, place("length", "rank").alias("at")).select(*columns, "at.sequence_id", "at.offset")


def write_sequences(packed: DataFrame, path: str) -> None:
    """Write (sequence_id, ids): the pieces of each sequence, which are at most ``size``, joined in their order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(ordered, F.lit(b""), lambda a, b: F.concat(a, b))
    packed.groupBy("sequence_id").agg(joined.alias("ids")).write.mode("overwrite").parquet(path)
