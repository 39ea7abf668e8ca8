"""Truncated decomposition of large sparse matrices by rounds of block products.

Entries are cut into blocks of rows and columns.  Tall matrices (rows or columns of the sparse one, by a few
hundred places) are tables of chunks; a product meets a block of entries with the part of the tall matrix that
it needs, and only sums leave.  Triangular factors of tall matrices are made a partition at a time.  Nothing
that grows with rows or columns reaches the driver: it holds one square matrix of places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import discard, saved, shared_path, short_shuffles, written

#: Bytes of the part of a tall matrix that a task holds, and entries of an average block.
PART_BYTES = 32 << 20
BLOCK_ENTRIES = 2_000_000
#: Places beyond those asked for, and rounds; the more, the closer to the exact decomposition.
MORE_PLACES = 10
ROUNDS = 5
#: Entries that are multiplied at once.
STRIP = 16_384
#: Directions whose value is below this share of the largest are no part of a basis.
TINY = 1e-12
_CHUNKS = "chunk long, x array<double>"


def _flat(rows: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


class _Side:
    """Rows or columns: ``parts`` of ``span`` each, and ``chunk`` of them in a row of a tall matrix."""

    def __init__(self, name: str, size: int, places: int, most: int, part_bytes: int) -> None:
        self.name, self.part = name, f"{name}_part"
        span = max(1, min(part_bytes // (8 * places), most))
        self.chunk = min(span, 256)
        self.span = span // self.chunk * self.chunk
        self.parts = -(-size // self.span)
        self.chunks = -(-size // self.chunk)


def _product(entries: DataFrame, tall: DataFrame, out: _Side, inner: _Side, places: int) -> DataFrame:
    """The chunks over ``out`` of the entries times a tall matrix over ``inner``; chunks without an entry are left out."""
    span, chunk, to, by = out.span, out.chunk, out.name, inner.name
    near = tall.withColumn(inner.part, F.floor(F.col("chunk") * inner.chunk / inner.span).cast("int"))
    near = near.withColumn(out.part, F.explode(F.sequence(F.lit(0), F.lit(out.parts - 1))))
    inner_part, out_part, inner_chunk, inner_span = inner.part, out.part, inner.chunk, inner.span

    def multiply(block: pa.Table, side: pa.Table) -> pa.Table:
        if not len(block) or not len(side):
            return pa.table({"chunk": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64()))})
        first, base = block[out_part][0].as_py() * span, block[inner_part][0].as_py() * inner_span
        held = np.zeros((inner_span, places))
        for at, x in zip(side["chunk"].to_pylist(), side["x"], strict=True):
            held[at * inner_chunk - base : (at + 1) * inner_chunk - base] = x.values.to_numpy().reshape(-1, places)
        block = block.sort_by(to)
        row, column, w = block[to].to_numpy() - first, block[by].to_numpy() - base, block["w"].to_numpy()
        y = np.zeros((span, places))
        for k in range(0, len(row), STRIP):
            own, starts = np.unique(row[k : k + STRIP], return_index=True)
            y[own] += np.add.reduceat(held[column[k : k + STRIP]] * w[k : k + STRIP, None], starts)
        with_entries = np.unique(row // chunk)
        return pa.table({"chunk": with_entries + first // chunk, "x": _flat([y[c * chunk : (c + 1) * chunk].reshape(-1) for c in with_entries])})

    keys = [out.part, inner.part]
    made = entries.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(multiply, _CHUNKS)
    if inner.parts == 1:
        return made

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for x in table["x"]], axis=0)
        return pa.table({"chunk": table["chunk"][:1], "x": _flat([total])})

    return made.groupBy("chunk").applyInArrow(add, _CHUNKS)


def _times(tall: DataFrame, m: np.ndarray) -> DataFrame:
    """A tall matrix times a small one."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(x.values.to_numpy().reshape(-1, len(m)) @ m).reshape(-1) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _flat(out)], ["chunk", "x"])

    return tall.mapInArrow(multiply, _CHUNKS)


def _factors(tall: DataFrame, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors (as columns) of a tall matrix, by triangular factors of its partitions."""

    def together(column: pa.Array) -> Iterator[np.ndarray]:
        some = max(1, STRIP * places // max(1, len(column[0].values))) if len(column) else 1
        yield from (column.slice(k, some).flatten().to_numpy() for k in range(0, len(column), some))

    def folded(parts: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, places))
        for x in parts:
            r = np.linalg.qr(np.concatenate([r, x.reshape(-1, places)]), mode="r")
        return r

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = folded(x for batch in batches for x in together(batch.column(0)))
        if len(r):
            yield pa.RecordBatch.from_arrays([_flat([r.reshape(-1)])], ["r"])

    def some(table: pa.Table) -> pa.Table:
        return pa.table({"r": _flat([folded(x.values.to_numpy() for x in table["r"]).reshape(-1)])})

    def last(table: pa.Table) -> pa.Table:
        _, s, v = np.linalg.svd(folded(x.values.to_numpy() for x in table["r"]), full_matrices=False)
        return pa.table({"s": _flat([s]), "v": _flat([v.T.reshape(-1)])})

    partial = tall.select("x").mapInArrow(each, "r array<double>").groupBy((F.spark_partition_id() % 64).alias("p")).applyInArrow(some, "r array<double>")
    found = partial.groupBy(F.lit(0).alias("p")).applyInArrow(last, "s array<double>, v array<double>").first()
    if found is None:
        return np.zeros(0), np.zeros((places, 0))
    s = np.array(found["s"])
    return s, np.array(found["v"]).reshape(places, len(s))


def _basis(s: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What makes the columns of a tall matrix orthonormal; zeros for directions that it lacks."""
    live = s > TINY * s.max(initial=0.0)
    out = np.zeros((len(v), len(v)))
    out[:, : len(s)] = v * np.where(live, 1 / np.where(live, s, 1), 0)
    return out


def truncated_svd(entries: DataFrame, rows: int, columns: int, dim: int, rounds: int = ROUNDS, more: int = MORE_PLACES, part_bytes: int = PART_BYTES, seed: int = 7) -> DataFrame:
    """(row, features): left vectors times singular values of the first ``dim`` places, for rows with an entry.

    ``entries`` is (row, place, w), each place of the matrix at most once, numbered from 0.  A random basis
    of ``dim + more`` places is multiplied by the matrix and its transpose ``rounds`` times.  The loading of greatest
    magnitude of each right vector is positive.
    """
    places = min(dim + more, rows, columns)
    entries = written(entries.select(F.col("row").cast("long"), F.col("place").cast("long"), F.col("w").cast("double")), "entries")
    average = max(1, entries.count() // max(1, rows))
    row, column = _Side("row", rows, places, max(1, BLOCK_ENTRIES // average), part_bytes), _Side("place", columns, places, columns, part_bytes)
    entries = entries.withColumns({s.part: F.floor(F.col(s.name) / s.span).cast("int") for s in (row, column)})
    column_chunk, row_chunk = column.chunk, row.chunk

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.random.default_rng((seed, c)).normal(size=column_chunk * places) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _flat(out)], ["chunk", "x"])

    spark = entries.sparkSession
    right = spark.range(column.chunks).mapInArrow(draw, _CHUNKS)
    for _ in range(rounds + 1):
        left = written(_product(entries, right, row, column, places), "left")
        left = _times(left, _basis(*_factors(left, places)))
        right = written(_product(entries, left, column, row, places), "right")
    s, v = _factors(right, places)
    turned = _times(right, v)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                x = x.values.to_numpy().reshape(-1, len(s))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(x.max(0)), pa.array(x.min(0))], ["k", "most", "least"])

    signs = np.ones(len(s))
    for r in turned.mapInArrow(ends, "k long, most double, least double").groupBy("k").agg(F.max("most").alias("most"), F.min("least").alias("least")).collect():
        signs[r["k"]] = -1.0 if -r["least"] > r["most"] else 1.0
    scores = np.zeros((places, dim))
    width = min(dim, len(s))
    scores[:, :width] = v[:, :width] * (s * signs)[:width]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                y = x.values.to_numpy().reshape(row_chunk, places) @ scores
                at = pa.array((np.arange(row_chunk + 1) * dim).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row_chunk) + chunk * row_chunk), pa.ListArray.from_arrays(at, pa.array(y.reshape(-1)))], ["row", "features"])

    return left.mapInArrow(rows_of, "row long, features array<double>").where(F.col("row") < rows)


#: Places that are the first ones of each row's part as a dense block, the most frequent ones; rows of such a block.
HEAD, BLOCK_ROWS = 8192, 1024
#: Entries of a task, whose sums for all places leave it.
TASK_ENTRIES = 50_000_000
#: Bytes of right vectors that are sent to all workers.
SHARED_BYTES = 64 << 20


def _dealt(batch: pa.RecordBatch, weights: np.ndarray, kind: type) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """Slices of rows (.., places, tf) and their parts of the matrix: a dense one of the first places, and (row, place, weight) of the others."""
    for k in range(0, len(batch), BLOCK_ROWS):
        part = batch.slice(k, BLOCK_ROWS)
        place, tf = (part[c].flatten().to_numpy() for c in ("places", "tf"))
        whose = np.repeat(np.arange(len(part)), part["places"].value_lengths().to_numpy())
        w = tf * weights[place]
        w /= np.sqrt(np.bincount(whose, w * w, len(part)))[whose]
        w = w.astype(kind, copy=False)
        first = place < HEAD
        dense = np.zeros((len(part), min(HEAD, len(weights))), kind)
        dense[whose[first], place[first]] = w[first]
        rest = ~first
        yield part, (dense, whose[rest], place[rest], w[rest])


def _forth(part: tuple, right: np.ndarray) -> np.ndarray:
    """The rows times the right vectors."""
    dense, row, place, w = part
    y = dense @ right[: dense.shape[1]]
    for k in range(0, len(row), STRIP):
        own, starts = np.unique(row[k : k + STRIP], return_index=True)
        y[own] += np.add.reduceat(right[place[k : k + STRIP]] * w[k : k + STRIP, None], starts)
    return y


def _back(part: tuple, y: np.ndarray, total: np.ndarray) -> None:
    """Adds the transposed rows times ``y``."""
    dense, row, place, w = part
    total[: dense.shape[1]] += dense.T @ y
    order = np.argsort(place, kind="stable")
    for k in range(0, len(order), STRIP):
        at = order[k : k + STRIP]
        own, starts = np.unique(place[at], return_index=True)
        total[own] += np.add.reduceat(y[row[at]] * w[at, None], starts)


def shared_places(columns: int, dim: int, more: int = MORE_PLACES) -> bool:
    """Whether the right vectors are few enough for ``decomposed_rows``."""
    return columns * (dim + more) * 8 <= SHARED_BYTES


def decomposed_rows(rows: DataFrame, key: str, weights: np.ndarray, dim: int, count: int, entries: int, rounds: int = ROUNDS, more: int = MORE_PLACES, seed: int = 7) -> DataFrame:
    """(key, features) like ``truncated_svd``, for a written table of rows (key, places, tf) with few enough places.

    An entry is tf times the weight of its place, and each row has length 1; ``count`` are the rows, ``entries`` theirs.
    A row stays where it is: its part of the matrix is multiplied by the right vectors, which all workers have, and
    by itself transposed, and only a task's sums for all places leave it.  The rounds are in single precision, the last one
    and the result in double.  The driver holds the right vectors, at most SHARED_BYTES.
    """
    spark, columns = rows.sparkSession, len(weights)
    places = min(dim + more, count, columns)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES))
    few, held = rows.select("places", "tf").coalesce(tasks), spark.sparkContext.broadcast(weights)
    chunk = 256
    right = np.random.default_rng(seed).normal(size=(columns, places))
    for k in range(1, rounds + 1):
        kind = np.float64 if k == rounds else np.float32
        shared = spark.sparkContext.broadcast(right.astype(kind))

        def around(batches: Iterator[pa.RecordBatch], shared=shared, kind=kind) -> Iterator[pa.RecordBatch]:
            total = np.zeros((columns, places), kind)
            for batch in batches:
                for _, part in _dealt(batch, held.value, kind):
                    _back(part, _forth(part, shared.value), total)
            for c in range(0, columns, chunk):
                x = total[c : c + chunk].reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array([c // chunk]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], ["chunk", "x"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([x.values.to_numpy() for x in table["x"]], axis=0, dtype=np.float64)
            return pa.table({"chunk": table["chunk"][:1], "x": _flat([total])})

        path = shared_path(spark, "right")
        with short_shuffles(spark):
            sums = few.mapInArrow(around, "chunk long, x array<double>" if k == rounds else "chunk long, x array<float>").groupBy("chunk").applyInArrow(add, _CHUNKS)
            tall = saved(sums, path)
            basis = _basis(*_factors(tall, places))
            table = tall.toArrow().sort_by("chunk")
        right = table["x"].combine_chunks().flatten().to_numpy().reshape(columns, places) @ basis
        shared.destroy()
        discard(spark, path)
    shared = spark.sparkContext.broadcast(right)

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in _dealt(batch, held.value, np.float64):
                y = _forth(own, shared.value)
                at = pa.array((np.arange(len(part) + 1) * places).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part[key], pa.ListArray.from_arrays(at, pa.array(y.reshape(-1)))], [key, "x"])

    kind = dict(rows.dtypes)[key]
    left = written(rows.select(key, "places", "tf").mapInArrow(ahead, f"{key} {kind}, x array<double>"), "left")
    shared.destroy()
    s, v = _factors(left, places)
    turned = right @ v
    scores = np.zeros((places, dim))
    width = min(dim, len(s))
    scores[:, :width] = (v * np.where(turned.max(0) < -turned.min(0), -1.0, 1.0))[:, :width]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch["x"].flatten().to_numpy().reshape(len(batch), places) @ scores
            at = pa.array((np.arange(len(batch) + 1) * dim).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch[key], pa.ListArray.from_arrays(at, pa.array(y.reshape(-1)))], [key, "features"])

    return left.mapInArrow(rows_of, f"{key} {kind}, features array<double>")
