"""Known pairs: cleaning, dense indices and balanced folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.ranking import ROWS_A_PART, ordered_rank
from pairloom.session import written


def positive_pairs(df: DataFrame, by: list[str] = (), label: str | None = "label", required: bool = False) -> DataFrame:
    """Distinct pairs whose label is the number 1; a label that is no number counts as 0, without labels all are positive."""
    keys = [*by, "left_id", "right_id"]
    if label and label in df.columns:
        df = df.where(F.coalesce(F.col(label).try_cast("double"), F.lit(0.0)) == 1)
    out = df.select(*keys).distinct()
    if required and out.isEmpty():
        raise ValueError("there are no positive pairs")
    return out


def dense_index(ids: DataFrame, by: list[str], column: str, out: str, rows: int | None = None, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """(by, id, index): places of the sorted distinct ids from 0; ``rows`` is how many ids there are at most."""
    rows = ids.count() if rows is None else rows
    distinct = ids.select(*by, column).where(F.col(column).isNotNull()).distinct()
    return ordered_rank(distinct, list(by), [column], rows, out, rows_a_part)


def index_entities(pairs: DataFrame, by: list[str] = (), left: DataFrame | None = None, right: DataFrame | None = None, rows_a_part: int = ROWS_A_PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges with left_idx and right_idx, left mapping, right mapping).

    The ids of the pairs are the universe, unless tables of entities are given.  The pairs are written
    once, since each result reads them.
    """
    by, pairs = list(by), written(pairs, "pairs")
    n = pairs.count()
    lefts = dense_index(left if left is not None else pairs, by, "left_id", "left_idx", n if left is None else None, rows_a_part)
    rights = dense_index(right if right is not None else pairs, by, "right_id", "right_idx", n if right is None else None, rows_a_part)
    edges = pairs.join(lefts, [*by, "left_id"]).join(rights, [*by, "right_id"])
    return edges.select(*by, "left_id", "right_id", "left_idx", "right_idx"), lefts, rights


def assign_folds(edges: DataFrame, k: int = 10, seed: int = 7777, by: list[str] = (), rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """The edges with ``test_fold`` from 1; the first n mod k folds get one edge more.

    The order is that of md5(left_idx|right_idx|seed), so it depends on nothing but the pairs and the
    seed.  The keyed edges and the result are written: ranks, sizes and whatever follows read them.
    """
    if k < 2:
        raise ValueError(f"k must be at least 2, not {k}")
    by = list(by)
    key = F.md5(F.concat_ws("|", "left_idx", "right_idx", F.lit(seed)).cast("binary"))
    keyed = written(edges.withColumn("__key", key), "keyed")
    n = keyed.count()
    ranked = ordered_rank(keyed, by, ["__key", "left_idx", "right_idx"], n, "__rank", rows_a_part)
    if by:
        sizes = keyed.groupBy(*by).agg(F.count("*").alias("__n"))
        if not sizes.where("__n < 2").isEmpty():
            raise ValueError("folds need at least two positive pairs")
        ranked = ranked.join(sizes, by)
    else:
        if n < 2:
            raise ValueError("folds need at least two positive pairs")
        ranked = ranked.withColumn("__n", F.lit(n).cast("long"))
    used = F.least(F.lit(k), F.col("__n"))
    q, m = F.floor(F.col("__n") / used), F.col("__n") % used
    long, r = m * (q + 1), F.col("__rank")
    fold = F.when(r < long, F.floor(r / (q + 1))).otherwise(m + F.floor((r - long) / q))
    return written(ranked.select(*edges.columns, (fold + 1).cast("int").alias("test_fold")), "assigned")


def expand_folds(assigned: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, fold, split, left_idx, right_idx): each pair is in test of its fold and in train of all others."""
    by = list(by)
    folds = assigned.groupBy(*by).agg(F.max("test_fold").alias("__k"))
    rows = assigned.join(F.broadcast(folds), by) if by else assigned.crossJoin(F.broadcast(folds))  # one row for each dataset
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.coalesce("__k", F.lit(1)))))
    split = F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train")
    return rows.select(*by, "fold", split.alias("split"), "left_idx", "right_idx")


def fold_counts(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, fold, n_train, n_test) of expanded folds."""
    count = lambda s: F.count_if(F.col("split") == s).cast("long").alias(f"n_{s}")
    return rows.groupBy(*by, "fold").agg(count("train"), count("test"))


def fold_meta(expanded: DataFrame, lefts: DataFrame, rights: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of folds and of entities for each dataset, one row each."""
    by = list(by)
    counts = fold_counts(expanded, by)
    a = lefts.groupBy(*by).agg(F.count("*").alias("num_left"))
    b = rights.groupBy(*by).agg(F.count("*").alias("num_right"))
    if not by:
        return counts.withColumns({"num_left": F.lit(a.first()[0]).cast("long"), "num_right": F.lit(b.first()[0]).cast("long")})
    return counts.join(a, by).join(b, by)


def best_epochs(df: DataFrame, by: list[str], metric: str = "metric") -> DataFrame:
    """The first epoch with the greatest metric in each group; NaN and null count as -1, and if all do, the epoch is -1."""
    value = F.coalesce(F.nanvl(F.col(metric), F.lit(-1.0)), F.lit(-1.0))
    best = df.groupBy(*by).agg(F.max_by(F.struct("epoch", value.alias("v")), F.struct(value, -F.col("epoch"))).alias("b"))
    return best.select(*by, F.when(F.col("b.v") > -1, F.col("b.epoch")).otherwise(-1).cast("int").alias("best_epoch"), F.col("b.v").alias("best_metric"))


def ranked_by(df: DataFrame, by: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; groups must be small (k rows of each block of candidates)."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(out) <= k)
