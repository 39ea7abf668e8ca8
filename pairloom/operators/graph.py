"""Graphs over all nodes, left ones first: a right node's number is its index plus the number of left nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_index_range(df: DataFrame, num_left: int, num_right: int) -> DataFrame:
    """The rows, if there are any and all indices are inside the bounds."""
    b = df.agg(F.count("*"), F.min("left_idx"), F.max("left_idx"), F.min("right_idx"), F.max("right_idx")).first()
    if not b[0]:
        raise ValueError("there are no training pairs")
    if b[1] < 0 or b[2] >= num_left or b[3] < 0 or b[4] >= num_right:
        raise ValueError(f"left indices {b[1]}..{b[2]} must be below {num_left}, right ones {b[3]}..{b[4]} below {num_right}")
    return df


def infer_sizes(edges: DataFrame) -> DataFrame:
    """(num_left, num_right): one more than the greatest index of each side."""
    return edges.agg((F.max("left_idx") + 1).cast("long").alias("num_left"), (F.max("right_idx") + 1).cast("long").alias("num_right"))


def bipartite_edges(pairs: DataFrame, num_left: int, by: list[str] = ("fold",)) -> DataFrame:
    """Directed edges (by, src, dst) between left and right nodes, both ways."""
    left, right = F.col("left_idx").cast("long"), (F.col("right_idx") + num_left).cast("long")
    there = pairs.select(*by, left.alias("src"), right.alias("dst"))
    return there.unionAll(pairs.select(*by, right.alias("src"), left.alias("dst")))


def merged_graph(train: DataFrame, similar: DataFrame | None, num_left: int, num_right: int, self_loops: bool = False, by: list[str] = ("fold",)) -> DataFrame:
    """Unique directed edges (by, src, dst) of known pairs and, in every group, of the similarity edges.

    Edges out of range and loops are dropped; then each node gets a loop if asked for.
    """
    by, n = list(by), num_left + num_right
    edges = bipartite_edges(train, num_left, by)
    # the groups are the few folds of a job
    groups = [tuple(r) for r in train.select(*by).distinct().collect()] if by else []

    def in_groups(rows: DataFrame) -> DataFrame:
        if not by:
            return rows
        kinds = dict(train.dtypes)
        each = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(by, g, strict=True)]) for g in groups])
        return rows.withColumn("__g", F.explode(each)).select("__g.*", "src", "dst") if groups else edges.limit(0)

    if similar is not None:
        edges = edges.unionByName(in_groups(similar.select("src", "dst")))
    edges = edges.where((F.col("src") != F.col("dst")) & F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1))
    if self_loops:
        nodes = train.sparkSession.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst"))
        edges = edges.unionByName(in_groups(nodes))
    return edges.distinct()


def interaction_graph(train: DataFrame, num_left: int, num_right: int, self_loops: bool = False, by: list[str] = ("fold",)) -> DataFrame:
    """The graph of known pairs alone."""
    return merged_graph(train, None, num_left, num_right, self_loops, by)


def edge_stats(graph: DataFrame, num_left: int, by: list[str] = ("fold",), train: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """Unique edges of each group: all, between left nodes, between right nodes and mixed.

    With the pairs and similarity edges that the graph was made of, also their directed edges before the union.
    """
    a, b = F.col("src") < num_left, F.col("dst") < num_left
    count = lambda c, name: F.count_if(c).cast("long").alias(name)
    out = graph.groupBy(*by).agg(F.count("*").alias("edges"), count(a & b, "left_left"), count(~a & ~b, "right_right"), count(a != b, "mixed"))
    if train is not None:
        directed = bipartite_edges(train.select(*by, "left_idx", "right_idx").distinct(), num_left, by)
        counts = directed.groupBy(*by).agg(F.count("*").alias("interaction_edges"))
        out = out.join(counts, list(by)) if by else out.crossJoin(counts)  # one row each
        out = out.withColumn("similarity_edges", F.lit(similar.count() if similar is not None else 0).cast("long"))
    return out


def out_degrees(graph: DataFrame, by: list[str] = ("fold",)) -> DataFrame:
    return graph.groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def undirected(graph: DataFrame, by: list[str] = ("fold",)) -> DataFrame:
    """Edges (by, a, b) with a < b where either direction is there; loops are dropped."""
    pair = graph.where("src <> dst").select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.distinct()
