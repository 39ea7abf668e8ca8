"""Stand-in inputs from the given tables, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    label = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 48), 1).otherwise(0)
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("left_id"), F.col("l_suppkey").alias("right_id"), label.alias("label"))


def sizes(spark: SparkSession, d: str) -> tuple[int, int]:
    """Left and right nodes: halves of the rows of embeddings."""
    n = table(spark, d, "embeddings").count()
    return n // 2, n - n // 2


def nodes(spark: SparkSession, d: str) -> DataFrame:
    left, _ = sizes(spark, d)
    side = F.when(F.col("vec_id") < left, "left").otherwise("right")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), side.alias("side"), F.col("embedding").cast("array<double>").alias("features"))


def left_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where("side = 'left'")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    left, right = sizes(spark, d)
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 50")
    return rows.select((F.col("l_partkey") % left).alias("left_idx"), (F.col("l_suppkey") % right).alias("right_idx")).distinct()


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select((F.col("doc_id") % 5).cast("int").alias("fold"), F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).cast("double").alias("prob"))


def epochs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 10).cast("int").alias("fold"), (F.col("event_id") % 100).cast("int").alias("epoch"), "value")
    return rows.groupBy("fold", "epoch").agg(F.round(F.avg("value"), 0).alias("metric"))


def residues(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("id", F.floor(F.col("vec_id") / 25)).withColumn("pos", (F.col("vec_id") % 25).cast("int"))
    return rows.where(F.col("pos") < 4 + F.col("id") % 22).select("id", "pos", F.col("embedding").cast("array<double>").alias("vec"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "\t \r\n").otherwise(F.concat(F.lit("\n"), "event_type", F.lit("\t ")))
    return table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("id"), text.alias("text"))


#: The same as common table expressions.
SQL = {
    "v_interactions": "SELECT l_partkey AS left_id, l_suppkey AS right_id, CASE WHEN l_returnflag = 'R' AND l_quantity >= 48 THEN 1 ELSE 0 END AS label FROM lineitem",
    "v_size": "SELECT count(*) AS n, count(*) // 2 AS nl, count(*) - count(*) // 2 AS nr FROM embeddings",
    "v_nodes": "SELECT vec_id AS node, CASE WHEN vec_id < nl THEN 'left' ELSE 'right' END AS side, CAST(embedding AS DOUBLE[]) AS features FROM embeddings, v_size",
    "v_pairs": "SELECT DISTINCT l_partkey % nl AS left_idx, l_suppkey % nr AS right_idx FROM lineitem, v_size WHERE l_returnflag = 'R' AND l_quantity >= 50",
    "v_sequences": "SELECT doc_id AS id, text AS seq FROM documents",
    "v_scored": "SELECT CAST(doc_id % 5 AS INT) AS fold, quality AS label, CAST((n_chars % 1000) / 1000.0 AS DOUBLE) AS prob FROM documents JOIN labels USING (doc_id)",
    "v_epochs": "SELECT CAST(user_id % 10 AS INT) AS fold, CAST(event_id % 100 AS INT) AS epoch, round(avg(value), 0) AS metric FROM events GROUP BY 1, 2",
    "v_residues": "SELECT vec_id // 25 AS id, CAST(vec_id % 25 AS INT) AS pos, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 25 < 4 + (vec_id // 25) % 22",
    "v_entities": "SELECT event_id AS ord, user_id AS id, CASE WHEN event_type = 'error' THEN chr(9) || ' ' || chr(13) || chr(10) ELSE chr(10) || event_type || chr(9) || ' ' END AS text FROM events",
    # folds of the pairs over nodes
    "v_folds": """SELECT left_idx, right_idx, CAST(CASE WHEN r < m * (q + 1) THEN 1 + r // (q + 1) ELSE 1 + m + (r - m * (q + 1)) // q END AS INT) AS test_fold FROM (
        SELECT left_idx, right_idx, n // least(10, n) AS q, n % least(10, n) AS m, row_number() OVER (ORDER BY md5(concat_ws('|', left_idx, right_idx, 7777)), left_idx, right_idx) - 1 AS r
        FROM v_pairs, (SELECT count(*) AS n FROM v_pairs))""",
    "v_expanded": "SELECT CAST(f AS INT) AS fold, CASE WHEN f = test_fold THEN 'test' ELSE 'train' END AS split, left_idx, right_idx FROM v_folds, (SELECT unnest(range(1, 1 + (SELECT max(test_fold) FROM v_folds))) AS f)",
    "v_cosine": """SELECT a.node AS src, b.node AS dst, list_dot_product(a.features, b.features) / (coalesce(nullif(sqrt(list_dot_product(a.features, a.features)), 0), 1) * coalesce(nullif(sqrt(list_dot_product(b.features, b.features)), 0), 1)) AS score
        FROM v_nodes a JOIN v_nodes b ON a.node <> b.node""",
    "v_similar": "SELECT src, dst, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS r FROM v_cosine) WHERE r <= 10",
    "v_dissimilar": """SELECT src AS left_idx, dst AS neighbor_idx, score, CAST(r AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9), dst) AS r FROM v_cosine, v_size WHERE src < nl AND dst < nl) WHERE r <= 10""",
    "v_graph": """SELECT fold, src, dst FROM (
        SELECT fold, left_idx AS src, right_idx + nl AS dst FROM v_expanded, v_size WHERE split = 'train'
        UNION SELECT fold, right_idx + nl, left_idx FROM v_expanded, v_size WHERE split = 'train'
        UNION SELECT f.fold, src, dst FROM v_similar, (SELECT DISTINCT fold FROM v_expanded) f) WHERE src <> dst""",
    "v_undirected": "SELECT DISTINCT fold, least(src, dst) AS a, greatest(src, dst) AS b FROM v_graph",
    "v_c3": "SELECT x.fold, x.a AS m1, x.b AS m2, y.b AS m3 FROM v_undirected x JOIN v_undirected y ON x.fold = y.fold AND x.b = y.a JOIN v_undirected z ON z.fold = x.fold AND z.a = x.a AND z.b = y.b",
    "v_c4": "SELECT c.*, y.b AS m4 FROM v_c3 c JOIN v_undirected y ON y.fold = c.fold AND y.a = m3 JOIN v_undirected p ON p.fold = c.fold AND p.a = m1 AND p.b = y.b JOIN v_undirected q ON q.fold = c.fold AND q.a = m2 AND q.b = y.b",
    "v_c5": "SELECT c.*, y.b AS m5 FROM v_c4 c JOIN v_undirected y ON y.fold = c.fold AND y.a = m4 JOIN v_undirected p ON p.fold = c.fold AND p.a = m1 AND p.b = y.b JOIN v_undirected q ON q.fold = c.fold AND q.a = m2 AND q.b = y.b JOIN v_undirected s ON s.fold = c.fold AND s.a = m3 AND s.b = y.b",
    "v_cliques": """SELECT fold, ord, members FROM (SELECT fold, 2 AS ord, [m1, m2, m3] AS members FROM v_c3 UNION ALL SELECT fold, 3, [m1, m2, m3, m4] FROM v_c4 UNION ALL SELECT fold, 4, [m1, m2, m3, m4, m5] FROM v_c5), v_size
        WHERE members[1] < nl AND members[-1] >= nl""",
    "v_incidence": "SELECT fold, ord, unnest(members) AS node, array_to_string(members, '-') AS clique_id FROM v_cliques",
}


def with_views(query: str, *names: str) -> str:
    """A query behind the named views and those that they use, in the order of SQL."""
    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += [v for v in SQL if v in SQL[name].replace(",", " ").replace(")", " ").split()]
    views = ",\n".join(f"{v} AS ({SQL[v]})" for v in SQL if v in wanted)
    return f"WITH {views}\n{query}"
