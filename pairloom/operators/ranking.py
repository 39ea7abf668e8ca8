"""Gapless ranks and running sums over large groups.

A window over a whole group puts the group into one task.  Here rows are dealt by ranges of their order,
as many as the rows ask for; ranks and sums are taken inside (group, range) and shifted by the totals of
the ranges before, a table of at most groups x ranges rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import written

RANGES = 64
#: Rows that a task puts in order.
ROWS_A_PART = 1_000_000


def range_of(df: DataFrame, order: str, ranges: int = RANGES) -> Column:
    """The number of the range that a numeric column's value is in, from 0; ranges hold about as many rows each."""
    shares = [k / ranges for k in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(order, shares, 10_000)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(order) <= F.lit(cuts[middle]), pick(low, middle)).otherwise(pick(middle + 1, high))

    return pick(0, len(cuts))


def _shifted(df: DataFrame, by: list[str], part: Column, totals: dict[str, Column], descending: bool) -> tuple[DataFrame, list[str]]:
    """The rows with ``__part`` and, for each total, its sum over the parts before as ``__<name>``."""
    dealt = df.withColumn("__part", part)
    sums = dealt.groupBy(*by, "__part").agg(*[c.alias(f"__{n}") for n, c in totals.items()])
    place = F.col("__part").desc() if descending else F.col("__part").asc()
    before = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in totals])
    return dealt.join(bases, [*by, "__part"]), [f"__{n}" for n in totals]


def ordered_rank(df: DataFrame, by: list[str], order: list[str], rows: int, out: str = "rank", rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """Rank from 0 inside each group ``by`` of rows that differ in ``order``; ``rows`` is how many there are at most.

    So few rows as one task orders are numbered by it.  More are dealt by ranges of (by, order), one for
    each ``rows_a_part``, sorted and written once with their places; the counts of the written ranges
    give what is before each.
    """
    if rows <= rows_a_part:
        place = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(place) - 1).cast("long"))
    parts = -(-rows // rows_a_part)
    dealt = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    at = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordered")  # the part and the place in it
    at = at.withColumn("__part", F.shiftright("__at", 33))
    counts = at.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*by, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return at.join(bases, [*by, "__part"]).select(*df.columns, (F.col("__base") + F.col("__at") - F.col("__first")).alias(out))


def global_rank(df: DataFrame, by: list[str], order: list[Column], part: Column, out: str = "rank") -> DataFrame:
    """Rank from 0 inside each group ``by``; ``part`` must not fall while the rows rise in ``order``."""
    joined, (base,) = _shifted(df, by, part, {"n": F.count("*")}, False)
    inside = Window.partitionBy(*by, "__part").orderBy(*order)
    return joined.withColumn(out, (F.row_number().over(inside) - 1 + F.col(base)).cast("long")).drop("__part", base)


def global_running_sums(df: DataFrame, by: list[str], order: str, values: list[str], ranges: int = RANGES) -> DataFrame:
    """Running sums ``cum_<value>`` by falling ``order`` inside each group; order values are distinct in a group."""
    joined, bases = _shifted(df, by, range_of(df, order, ranges), {v: F.sum(v) for v in values}, True)
    inside = Window.partitionBy(*by, "__part").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [(F.sum(v).over(inside) + F.col(b)).alias(f"cum_{v}") for v, b in zip(values, bases, strict=True)]
    return joined.select(*df.columns, *sums)
