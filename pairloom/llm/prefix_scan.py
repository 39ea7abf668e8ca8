"""Running sums inside groups along an order, by numpy scans over ranges of the sorted rows.

Rows are dealt to tasks by ranges of (group, order), so a group of any size spans as many tasks as it
needs.  Each task scans its range; what a group that spans several has gathered before is added then.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import written

WORD = 1 << 64
ADDED = ("at", "before", "upto", "__part")


class _Scan:
    """Places and sums of a sorted run of groups, batch by batch."""

    def __init__(self, base: int):
        self.base, self.powers = base, np.ones(1, np.uint64)
        self.group, self.count, self.total = None, 0, 0

    def __call__(self, groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the group, sum before the row, sum with it); sums are of value * base**place, modulo 2**64."""
        n = len(groups)
        if len(self.powers) < n:
            self.powers = np.full(n, self.base, np.uint64)
            self.powers[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
        begins = np.concatenate([[groups[0] != self.group], groups[1:] != groups[:-1]])
        carried = int(np.argmax(begins)) if begins.any() else n  # rows of the group of the batch before
        first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        place = np.arange(n) - first
        terms = values.view(np.uint64) * self.powers[place]
        terms[:carried] *= np.uint64(pow(self.base, self.count, WORD))
        sums = np.cumsum(terms)
        upto = sums - np.where(first > 0, sums[np.maximum(first - 1, 0)], np.uint64(0))
        upto[:carried] += np.uint64(self.total)
        place[:carried] += self.count
        self.group, self.count, self.total = groups[-1], int(place[-1]) + 1, int(upto[-1])
        return place, upto - terms, upto


def _more(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    """The batch with the columns of ADDED last, in their order."""
    own = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
    own |= {c: pa.array(x.view(np.int64)) for c, x in columns.items()}
    return pa.RecordBatch.from_pydict({c: own[c] for c in [*(c for c in own if c not in ADDED), *ADDED]})


def prefix_scan(df: DataFrame, group: str, order: list[Column], value: str, base: int = 1) -> DataFrame:
    """The rows with ``at``, ``before`` and ``upto`` (in place of columns of these names); written once.

    ``at`` is the place of the row in its group from 0, ``upto`` the sum of ``value * base**at`` over the
    group's rows up to this one, modulo 2**64 as a signed number, and ``before`` the sum without it.
    ``group`` and ``value`` are long and not null.  The driver sees two rows for each partition at most.
    """
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c not in ADDED), "at long, before long, upto long, __part long"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, part = _Scan(base), TaskContext.get().partitionId()
        for batch in batches:
            if len(batch):
                at, before, upto = step(batch[group].to_numpy(), batch[value].to_numpy())
                yield _more(batch, at=at, before=before, upto=upto, __part=np.full(len(batch), part, np.int64))

    keys = [F.col(group), *order]
    rows = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(scan, schema), "scan")
    ends = rows.groupBy("__part").agg(F.min(group).alias("low"), F.max(group).alias("high")).collect()
    seen: dict[int, set[int]] = defaultdict(set)
    for r in ends:
        for g in (r["low"], r["high"]):
            seen[g].add(r["__part"])
    wide = [g for g, parts in seen.items() if len(parts) > 1]  # what a middle part holds alone, it has as low and high
    if not wide:
        return rows.drop("__part")
    tallies = rows.where(F.col(group).isin(wide)).groupBy(group, "__part").agg((F.max("at") + 1).alias("n"), F.max_by("upto", "at").alias("sum")).collect()
    shifts, held = defaultdict(dict), {}
    for r in sorted(tallies, key=lambda r: r["__part"]):
        n, total = held.get(r[group], (0, 0))
        shifts[r["__part"]][r[group]] = (n, total)
        held[r[group]] = (n + r["n"], (total + pow(base, n, WORD) * r["sum"]) % WORD)

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, parts = batch[group].to_numpy(), batch["__part"].to_numpy()
            at = batch["at"].to_numpy().copy()
            before, upto = (batch[c].to_numpy().view(np.uint64).copy() for c in ("before", "upto"))
            for part in np.unique(parts).tolist():
                for g, (n, total) in shifts.get(part, {}).items():
                    own = (parts == part) & (groups == g)
                    at[own] += n
                    for x in (before, upto):
                        x[own] = x[own] * np.uint64(pow(base, n, WORD)) + np.uint64(total)
            yield _more(batch, at=at, before=before, upto=upto)

    return rows.mapInArrow(shifted, schema).drop("__part")
