"""A query for each operator over whole tables, and the SQL for the same rows where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.jobs import fixtures as X
from pairloom.jobs import node_features as NF
from pairloom.jobs.fixtures import with_views
from pairloom.jobs.link_prediction import build_operators, evaluate_folds, fit_score_folds
from pairloom.operators import cliques as C
from pairloom.operators import encode as E
from pairloom.operators import folds as FO
from pairloom.operators import graph as G
from pairloom.operators import metrics as M
from pairloom.operators import negatives as N
from pairloom.operators import propagate as P
from pairloom.operators import reduce as R
from pairloom.operators import sequences as S
from pairloom.operators import similarity as SI
from pairloom.operators import spectral as SP
from pairloom.operators import walks as W
from pairloom.session import written
from pairloom.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register a query, with its SQL behind the named views."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return f

    return register


# --- pairs and folds ---------------------------------------------------------------------------


@query("p1_positive_pairs", "SELECT DISTINCT left_id, right_id FROM v_interactions WHERE label = 1", "v_interactions")
def positive_pairs(spark, d):
    return FO.positive_pairs(X.interactions(spark, d))


@query("s3_clean_edges", "SELECT DISTINCT left_id AS left_idx, right_id AS right_idx FROM v_interactions", "v_interactions")
def clean_edges(spark, d):
    return T.clean_edges(X.interactions(spark, d).select(F.col("left_id").alias("drug_idx"), F.col("right_id").alias("target_idx")))


def _indexed(spark, d):
    return FO.index_entities(FO.positive_pairs(X.interactions(spark, d)))


INDEX = "WITH p AS (SELECT DISTINCT l_partkey AS left_id, l_suppkey AS right_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48), e AS (SELECT left_id, right_id, dense_rank() OVER (ORDER BY left_id) - 1 AS left_idx, dense_rank() OVER (ORDER BY right_id) - 1 AS right_idx FROM p)"
FOLDED = INDEX + """, z AS (SELECT count(*) AS n FROM e), f AS (SELECT left_id, right_id, left_idx, right_idx, CAST(CASE WHEN r < m * (q + 1) THEN 1 + r // (q + 1) ELSE 1 + m + (r - m * (q + 1)) // q END AS INT) AS test_fold
 FROM (SELECT *, n // least(10, n) AS q, n % least(10, n) AS m, row_number() OVER (ORDER BY md5(concat_ws('|', left_idx, right_idx, 7777)), left_idx, right_idx) - 1 AS r FROM e, z))"""
EXPANDED = FOLDED + ", x AS (SELECT CAST(k AS INT) AS fold, CASE WHEN k = test_fold THEN 'test' ELSE 'train' END AS split, left_idx, right_idx FROM f, (SELECT unnest(range(1, 11)) AS k))"


@query("f2_index_entities", INDEX + " SELECT * FROM e")
def index_entities(spark, d):
    return _indexed(spark, d)[0]


@query("f3_assign_folds", FOLDED + " SELECT * FROM f")
def assign_folds(spark, d):
    return FO.assign_folds(_indexed(spark, d)[0])


@query("f4_expand_folds", EXPANDED + " SELECT * FROM x")
def expand_folds(spark, d):
    return FO.expand_folds(FO.assign_folds(_indexed(spark, d)[0]))


@query("a10_fold_counts", EXPANDED + " SELECT fold, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM x GROUP BY fold")
def fold_counts(spark, d):
    return FO.fold_counts(expand_folds(spark, d))


@query("f5_fold_meta", EXPANDED + " SELECT fold, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, (SELECT count(DISTINCT left_id) FROM p) AS num_left, (SELECT count(DISTINCT right_id) FROM p) AS num_right FROM x GROUP BY fold")
def fold_meta(spark, d):
    edges, lefts, rights = _indexed(spark, d)
    return FO.fold_meta(FO.expand_folds(FO.assign_folds(edges)), lefts, rights)


@query("a2_infer_sizes", INDEX + " SELECT max(left_idx) + 1 AS num_left, max(right_idx) + 1 AS num_right FROM e")
def infer_sizes(spark, d):
    return G.infer_sizes(_indexed(spark, d)[0])


@query("w6_best_epochs", """SELECT fold, CAST(CASE WHEN v > -1 THEN epoch ELSE -1 END AS INT) AS best_epoch, v AS best_metric
 FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY v DESC, epoch) AS r FROM (SELECT fold, epoch, coalesce(metric, -1) AS v FROM v_epochs)) WHERE r = 1""", "v_epochs")  # fmt: skip
def best_epochs(spark, d):
    return FO.best_epochs(X.epochs(spark, d), ["fold"])


# --- similarity and negatives --------------------------------------------------------------------


@query("j1_similarity_edges", "SELECT src, dst, round(score, 6) AS score, rank FROM v_similar", "v_similar")
def similarity_edges(spark, d):
    return SI.similarity_edges(X.nodes(spark, d), 10).withColumn("score", F.round("score", 6))


@query("j1_similarity_approximate")
def similarity_approximate(spark, d):
    return SI.similarity_edges_approximate(X.nodes(spark, d), 10, 0.35)


@query("p5_min_similarity", "SELECT src, dst, round(score, 6) AS score, rank FROM v_similar WHERE score >= 0.35", "v_similar")
def min_similarity(spark, d):
    return SI.similarity_edges(X.nodes(spark, d), 10, 0.35).withColumn("score", F.round("score", 6))


@query("j2_dissimilar_neighbors", "SELECT left_idx, neighbor_idx, round(score, 6) AS score, rank FROM v_dissimilar", "v_dissimilar")
def dissimilar(spark, d):
    return SI.dissimilar_neighbors(X.left_nodes(spark, d), 10).withColumn("score", F.round("score", 6))


def _expanded(spark, d):
    return FO.expand_folds(FO.assign_folds(X.pairs(spark, d)))


def _negatives(spark, d):
    rows = written(_expanded(spark, d), "folds")
    neighbors = written(SI.dissimilar_neighbors(X.left_nodes(spark, d), 10), "neighbors")
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    return rows, N.sample_negatives(train, test, neighbors)


@query("j3_negative_candidates", "SELECT DISTINCT fold, neighbor_idx AS left_idx, right_idx FROM v_expanded JOIN v_dissimilar USING (left_idx) WHERE split = 'train'", "v_expanded", "v_dissimilar")
def negative_candidates(spark, d):
    return N.negative_candidates(_expanded(spark, d).where("split = 'train'"), SI.dissimilar_neighbors(X.left_nodes(spark, d), 10))


NEGATIVES = """, tr AS (SELECT DISTINCT fold, neighbor_idx AS left_idx, right_idx FROM v_expanded JOIN v_dissimilar USING (left_idx) WHERE split = 'train' EXCEPT SELECT fold, left_idx, right_idx FROM v_expanded),
 te AS (SELECT DISTINCT fold, neighbor_idx AS left_idx, right_idx FROM v_expanded JOIN v_dissimilar USING (left_idx) WHERE split = 'test' EXCEPT SELECT fold, left_idx, right_idx FROM v_expanded EXCEPT SELECT * FROM tr),
 ng AS (SELECT fold, 'train' AS split, left_idx, right_idx FROM tr UNION ALL SELECT fold, 'test', left_idx, right_idx FROM te) """


@query("j4_sample_negatives", NEGATIVES + "SELECT * FROM ng", "v_expanded", "v_dissimilar")
def sample_negatives(spark, d):
    return _negatives(spark, d)[1]


@query("u3_labelled_counts", NEGATIVES + "SELECT fold, split, CAST(label AS INT) AS label, count(*) AS n FROM (SELECT fold, split, 1 AS label FROM v_expanded UNION ALL SELECT fold, split, 0 FROM ng) GROUP BY 1, 2, 3", "v_expanded", "v_dissimilar")
def labelled_counts(spark, d):
    positives, negatives = _negatives(spark, d)
    return N.labelled_pairs(positives, negatives).groupBy("fold", "split", "label").agg(F.count("*").alias("n"))


# --- graphs, cliques, walks ------------------------------------------------------------------------


def _train(spark, d):
    """Training pairs of all folds, which share one job."""
    return _expanded(spark, d).where("split = 'train'").select("fold", "left_idx", "right_idx")


def _graph(spark, d):
    left, right = X.sizes(spark, d)
    return written(G.merged_graph(_train(spark, d), SI.similarity_edges(X.nodes(spark, d), 10), left, right), "graph"), left


@query("p3_bipartite_edges", "SELECT fold, left_idx AS src, right_idx + nl AS dst FROM v_expanded, v_size WHERE split = 'train' UNION ALL SELECT fold, right_idx + nl, left_idx FROM v_expanded, v_size WHERE split = 'train'", "v_expanded", "v_size")
def bipartite_edges(spark, d):
    return G.bipartite_edges(_expanded(spark, d).where("split = 'train'"), X.sizes(spark, d)[0])


@query("g1_interaction_graph", """SELECT fold, left_idx AS src, right_idx + nl AS dst FROM v_expanded, v_size WHERE split = 'train' UNION SELECT fold, right_idx + nl, left_idx FROM v_expanded, v_size WHERE split = 'train'
 UNION SELECT f, node, node FROM v_nodes, (SELECT DISTINCT fold AS f FROM v_expanded)""", "v_expanded", "v_nodes", "v_size")  # fmt: skip
def interaction_graph(spark, d):
    return G.interaction_graph(_expanded(spark, d).where("split = 'train'"), *X.sizes(spark, d), self_loops=True)


@query("g2_merged_graph", "SELECT * FROM v_graph", "v_graph")
def merged_graph(spark, d):
    return _graph(spark, d)[0]


@query("a3_edge_stats", """SELECT g.*, interaction_edges, (SELECT count(*) FROM v_similar) AS similarity_edges FROM (
 SELECT fold, count(*) AS edges, count(*) FILTER (src < nl AND dst < nl) AS left_left, count(*) FILTER (src >= nl AND dst >= nl) AS right_right, count(*) FILTER ((src < nl) <> (dst < nl)) AS mixed FROM v_graph, v_size GROUP BY fold) g
 JOIN (SELECT fold, 2 * count(*) AS interaction_edges FROM v_expanded WHERE split = 'train' GROUP BY fold) USING (fold)""", "v_graph")  # fmt: skip
def edge_stats(spark, d):
    left, right = X.sizes(spark, d)
    train, similar = written(_train(spark, d), "train"), written(SI.similarity_edges(X.nodes(spark, d), 10), "similar")
    return G.edge_stats(G.merged_graph(train, similar, left, right), left, train=train, similar=similar)


@query("a4_out_degrees", "SELECT fold, src AS node, count(*) AS degree FROM v_graph GROUP BY 1, 2", "v_graph")
def out_degrees(spark, d):
    return G.out_degrees(_graph(spark, d)[0])


def _cliques(spark, d):
    return C.cliques(*(lambda g: (g[0], 4, g[1]))(_graph(spark, d)))


@query("g3_cliques", "SELECT fold, CAST(ord AS INT) AS \"order\", array_to_string(members, '-') AS members FROM v_cliques", "v_cliques")
def cliques(spark, d):
    return _cliques(spark, d).select("fold", "order", F.array_join(F.transform("members", lambda x: x.cast("string")), "-").alias("members"))


@query("g3_all_cliques", "SELECT fold, 2 AS \"order\", count(*) AS cliques FROM v_c3 GROUP BY 1 UNION ALL SELECT fold, 3, count(*) FROM v_c4 GROUP BY 1 UNION ALL SELECT fold, 4, count(*) FROM v_c5 GROUP BY 1", "v_c3", "v_c4", "v_c5")
def all_cliques(spark, d):
    return C.clique_counts(C.cliques(_graph(spark, d)[0], 4))


@query("g4_incidence", "SELECT fold, CAST(ord AS INT) AS \"order\", node, clique_id FROM v_incidence", "v_incidence")
def incidence(spark, d):
    return C.incidence(_cliques(spark, d))


@query("a4_clique_degrees", "SELECT fold, CAST(ord AS INT) AS \"order\", node, count(*) AS degree FROM v_incidence GROUP BY 1, 2, 3", "v_incidence")
def clique_degrees(spark, d):
    return incidence(spark, d).groupBy("fold", "order", "node").agg(F.count("*").alias("degree"))


def _walk_sql(moves: str, by: str, alpha: float, keep: float, rounds: int) -> str:
    """The walk's rounds as one view after another."""
    join = " AND ".join(f"s.{c} = m.{c}" for c in by.split(", "))
    cols = ", ".join(f"s.{c}" for c in by.split(", "))
    out = f"{moves}, home AS (SELECT DISTINCT {by}, src, src AS dst, CAST({alpha} AS DOUBLE) AS weight FROM moves), s0 AS (SELECT * FROM home)"
    for k in range(1, rounds + 1):
        out += f", s{k} AS (SELECT {by}, src, dst, sum(weight) AS weight FROM (SELECT {cols}, s.src, m.dst, s.weight * m.p * {keep} AS weight FROM s{k - 1} s JOIN moves m ON {join} AND s.dst = m.src UNION ALL SELECT * FROM home) GROUP BY {by}, src, dst)"
    return out


MOVES = ", moves AS (SELECT g.fold, g.src, g.dst, 1.0::DOUBLE / n AS p FROM v_graph g JOIN (SELECT fold, src, count(*) AS n FROM v_graph GROUP BY 1, 2) USING (fold, src))"
TRIPS = ", moves AS (SELECT a.fold, a.ord, a.node AS src, b.node AS dst, sum(1.0::DOUBLE / (n * k)) AS p FROM v_incidence a JOIN v_incidence b USING (fold, ord, clique_id) JOIN (SELECT fold, ord, node, count(*) AS n FROM v_incidence GROUP BY 1, 2, 3) x ON x.fold = a.fold AND x.ord = a.ord AND x.node = a.node JOIN (SELECT fold, ord, clique_id, count(*) AS k FROM v_incidence GROUP BY 1, 2, 3) USING (fold, ord, clique_id) GROUP BY 1, 2, 3, 4)"


@query("g5_restart_scores")
def restart_scores(spark, d):
    return W.restart_scores(_graph(spark, d)[0])


def _sums_sql(rounds: int, places: int) -> str:
    """For each source how many nodes its walks reach, and its scores times features: the walk of a few vectors, and what is reached hop by hop."""
    v = range(1, places + 1)
    out = MOVES + f""", near AS (SELECT fold, src, src AS dst FROM moves UNION SELECT n.fold, n.src, m.dst FROM near n JOIN moves m ON m.fold = n.fold AND m.src = n.dst),
     ends AS (SELECT f.fold, node, {", ".join(f"0.15::DOUBLE * features[{k}] AS v{k}" for k in v)} FROM v_nodes, (SELECT DISTINCT fold FROM v_graph) f), x0 AS (SELECT * FROM ends)"""
    for k in range(1, rounds + 1):
        sums = ", ".join(f"e.v{j} + 0.85 * coalesce(s.v{j}, 0) AS v{j}" for j in v)
        moved = ", ".join(f"sum(p * v{j}) AS v{j}" for j in v)
        out += f", x{k} AS (SELECT e.fold, e.node, {sums} FROM ends e LEFT JOIN (SELECT m.fold, m.src AS node, {moved} FROM moves m JOIN x{k - 1} x ON x.fold = m.fold AND x.node = m.dst GROUP BY 1, 2) s USING (fold, node))"
    return out + f" SELECT fold, src, n AS reached, {', '.join(f'round(v{k} + 3e-10, 6) + 0.0 AS v{k}' for k in v)} FROM (SELECT fold, src, count(*) AS n FROM near GROUP BY 1, 2) JOIN x{rounds} x USING (fold) WHERE x.node = src"


#: After so many steps the rest of a walk is below 1e-9.
WHOLE = 128


@query("g5_score_sums", _sums_sql(WHOLE, 3), "v_graph", "v_nodes")
def score_sums(spark, d):
    graph = _graph(spark, d)[0]
    some = F.slice("features", 1, 3).alias("features")
    ends = X.nodes(spark, d).select("node", some).join(F.broadcast(graph.select("fold").distinct()))  # at most ten folds
    found = W.restart_sums(graph, ends, steps=WHOLE)
    # a small shift takes sums off the border between two last places
    sums = [(F.round(F.get("features", F.lit(k - 1)) + 3e-10, 6) + 0.0).alias(f"v{k}") for k in (1, 2, 3)]
    return found.select("fold", "src", "reached", *sums)


ORACLES["g5_score_sums"] = ORACLES["g5_score_sums"].replace("WITH", "WITH RECURSIVE", 1)

#: Steps of the clique walks whose rows are compared, without pruning, so that they are exact.
STEPS = 60


@query("g6_clique_restart_scores", _walk_sql(TRIPS, "fold, ord", 0.15, 0.85**2, STEPS // 2) + f" SELECT fold, CAST(ord AS INT) AS \"order\", src, dst, round(weight + 3e-10, 6) AS weight FROM s{STEPS // 2}", "v_incidence")
def clique_restart_scores(spark, d):
    rows = written(incidence(spark, d), "incidence")
    scores = W.clique_restart_scores(rows, 0.15, STEPS, 0.0)
    return scores.select("fold", F.col("order").cast("int").alias("order"), "src", "dst", F.round(F.col("weight") + 3e-10, 6).alias("weight"))


def _moves(spark, d):
    return written(W.transitions(_graph(spark, d)[0], ["fold"]).select("fold", "src", "dst", F.col("p").alias("weight")), "moves")


def _start(spark, d):
    folds = _expanded(spark, d).select("fold").distinct()
    return X.nodes(spark, d).select("node", "features").join(F.broadcast(folds))  # at most ten folds


def _applied(rounds: int) -> str:
    return ", x0 AS (SELECT f.fold, node, features FROM v_nodes, (SELECT DISTINCT fold FROM v_graph) f)" + "".join(
        f", x{k} AS (SELECT fold, node, list(v ORDER BY i) AS features FROM (SELECT m.fold, m.src AS node, i, sum(m.p * x.features[i]) AS v FROM moves m JOIN x{k - 1} x ON x.fold = m.fold AND x.node = m.dst, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
        for k in range(1, rounds + 1)
    )


LONG = "SELECT fold, node, CAST(i AS INT) AS place, round({v}, 6) + 0.0 AS value FROM {t}, (SELECT unnest(range(1, 65)) AS i)"


def _long(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(V.rounded(F.col("features"))).alias("place", "value")).withColumn("place", F.col("place") + 1)


@query("j8_apply_operator", MOVES + _applied(1) + " " + LONG.format(v="features[i]", t="x1"), "v_graph", "v_nodes")
def apply_operator(spark, d):
    return _long(P.apply_operator(_moves(spark, d), _start(spark, d), 64, ["fold"]), "fold", "node")


WEIGHTS = P.polynomial_weights(10, 0.1)


@query("g7_propagate", MOVES + _applied(10) + ", s AS (SELECT fold, node, list(v ORDER BY i) AS v FROM (SELECT fold, node, i, sum(w * features[i]) AS v FROM ("
       + " UNION ALL ".join(f"SELECT fold, node, {w!r}::DOUBLE AS w, features FROM x{k}" for k, w in enumerate(WEIGHTS))
       + "), (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2) " + LONG.format(v="v[i]", t="s"), "v_graph", "v_nodes")
def propagate(spark, d):
    return _long(P.propagate(_moves(spark, d), _start(spark, d), 10, 0.1), "fold", "node")


def _operators(spark, d):
    """All folds, with the operators' own order and steps."""
    train = _expanded(spark, d).where("split = 'train'").select("fold", "left_idx", "right_idx")
    return written(build_operators(train, X.nodes(spark, d), *X.sizes(spark, d)), "operators")


def _orders_sql(rounds: int) -> str:
    """Walks of order 1 and of the cliques, as s<rounds> and t<rounds // 2>."""
    one = _walk_sql(MOVES, "fold", 0.15, 0.85, rounds)
    two = _walk_sql(TRIPS, "fold, ord", 0.15, 0.85**2, rounds // 2)
    for name in ("moves", "home", *(f"s{k}" for k in range(rounds + 1))):
        two = re.sub(rf"\b{name}\b", f"c_{name}", two)
    return one + two


#: SQL takes minutes for more steps of all orders and folds.
SUMMARY_STEPS = 20


@query("g9_operator_summary", _orders_sql(SUMMARY_STEPS) + f""", w AS (SELECT fold, 1 AS o, weight FROM s{SUMMARY_STEPS} UNION ALL SELECT fold, ord, weight FROM c_s{SUMMARY_STEPS // 2})
 SELECT fold, CAST(o AS INT) AS "order", count(*) AS nnz, round(sum(weight), 4) AS total FROM w WHERE weight > 0 GROUP BY 1, 2""", "v_graph", "v_incidence")  # fmt: skip
def operator_summary(spark, d):
    rows = build_operators(_train(spark, d), X.nodes(spark, d), *X.sizes(spark, d), steps=SUMMARY_STEPS, prune=0.0)
    return T.operator_summary(rows).select("fold", "order", "nnz", F.round("total", 4).alias("total"))


@query("g8_encode")
def encode(spark, d):
    return P.encode(_operators(spark, d), X.nodes(spark, d).select("node", "features"), 4)


@query("j9_pair_features", "SELECT fold, split, left_idx, right_idx, CAST(i AS INT) AS place, round(CASE WHEN i <= 64 THEN a.features[i] ELSE b.features[i - 64] END, 6) + 0.0 AS value FROM v_expanded JOIN v_nodes a ON a.node = left_idx JOIN v_nodes b ON b.node = right_idx + (SELECT nl FROM v_size), (SELECT unnest(range(1, 129)) AS i)", "v_expanded", "v_nodes", "v_size")
def pair_features(spark, d):
    rows = _expanded(spark, d)
    return _long(P.pair_features(rows, _start(spark, d), X.sizes(spark, d)[0]), "fold", "split", "left_idx", "right_idx")


@query("m1_fit_score_folds")
def fit_score(spark, d):
    positives, negatives = _negatives(spark, d)
    rows = N.labelled_pairs(positives, negatives)
    return fit_score_folds(rows, _start(spark, d), X.sizes(spark, d)[0])


@query("m1_fit_score_propagated")
def fit_score_propagated(spark, d):
    """The classifier on features that were spread along the graph of each fold."""
    rows = N.labelled_pairs(*_negatives(spark, d))
    z = written(P.propagate(_moves(spark, d), _start(spark, d), 10, 0.1), "propagated")
    return fit_score_folds(rows, z, X.sizes(spark, d)[0])


@query("m2_evaluate_folds")
def evaluate(spark, d):
    return evaluate_folds(written(fit_score(spark, d), "scored"))


# --- metrics -------------------------------------------------------------------------------------


CONFUSION = """, c AS (SELECT fold, count(*) FILTER (prob < 0.5 AND label <> 1) AS tn, count(*) FILTER (prob >= 0.5 AND label <> 1) AS fp, count(*) FILTER (prob < 0.5 AND label = 1) AS fn, count(*) FILTER (prob >= 0.5 AND label = 1) AS tp FROM v_scored GROUP BY fold),
 b AS (SELECT fold, tn, fp, fn, tp, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS sensitivity,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM c)"""
POINTS = """, g AS (SELECT fold, prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM v_scored GROUP BY 1, 2),
 k AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY fold) AS p, sum(neg) OVER (PARTITION BY fold) AS n FROM g WINDOW w AS (PARTITION BY fold ORDER BY prob DESC))"""
ROUNDED = ["accuracy", "precision", "recall", "sensitivity", "f1", "mcc"]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("a5_binary_metrics", CONFUSION + " SELECT fold, tn, fp, fn, tp, " + ", ".join(f"round({c}, 6) AS {c}" for c in ROUNDED) + " FROM b", "v_scored")
def binary_metrics(spark, d):
    return _rounded(M.binary_metrics(X.scored(spark, d)), *ROUNDED)


@query("a6_roc_auc", POINTS + " SELECT fold, round(sum(neg * (cp - pos / 2.0)) / (max(p) * max(n)), 6)::DOUBLE AS roc_auc FROM k GROUP BY fold", "v_scored")
def roc_auc(spark, d):
    return _rounded(M.roc_auc(X.scored(spark, d)), "roc_auc")


@query("a7_average_precision", POINTS + " SELECT fold, round(sum(pos * cp / (cp + cn)::DOUBLE) / max(p), 6) AS average_precision FROM k GROUP BY fold", "v_scored")
def average_precision(spark, d):
    return _rounded(M.average_precision(X.scored(spark, d)), "average_precision")


@query("a8_roc_curve", POINTS + " SELECT fold, prob AS threshold, round(cn / n::DOUBLE, 6) AS fpr, round(cp / p::DOUBLE, 6) AS tpr FROM k UNION ALL SELECT DISTINCT fold, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM k", "v_scored")
def roc_curve(spark, d):
    return _rounded(M.roc_curve(X.scored(spark, d)), "fpr", "tpr")


@query("a8_pr_curve", POINTS + " SELECT fold, prob AS threshold, round(cp / (cp + cn)::DOUBLE, 6) AS precision, round(cp / p::DOUBLE, 6) AS recall FROM k UNION ALL SELECT DISTINCT fold, 'inf'::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM k", "v_scored")
def pr_curve(spark, d):
    return _rounded(M.pr_curve(X.scored(spark, d)), "precision", "recall")


@query("a9_metrics_summary", CONFUSION + ", u AS (UNPIVOT (SELECT fold, tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tp::DOUBLE AS tp, accuracy, precision, recall, sensitivity, f1, mcc FROM b) ON COLUMNS(* EXCLUDE (fold)) INTO NAME metric VALUE value) SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM u GROUP BY metric", "v_scored")
def metrics_summary(spark, d):
    return _rounded(M.metrics_summary(M.binary_metrics(X.scored(spark, d))), "mean", "std")


# --- texts and sequences -----------------------------------------------------------------------------


@query("a12_first_non_empty", f"SELECT id, arg_min(t, ord) AS text FROM (SELECT id, ord, regexp_replace(text, '^[{S.BLANKS}]+|[{S.BLANKS}]+$', '', 'g') AS t FROM v_entities) WHERE t <> '' GROUP BY id", "v_entities")
def first_non_empty(spark, d):
    return S.first_non_empty(X.entities(spark, d), "id", "text", "ord")


@query("a12_first_text", "SELECT id, arg_min(text, ord) AS text FROM v_entities WHERE text <> '' GROUP BY id", "v_entities")
def first_text(spark, d):
    return S.first_non_empty(X.entities(spark, d), "id", "text", "ord", trim=False, drop_empty=False)


@query("p10_head_entities", "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY 1 LIMIT 100")
def head_entities(spark, d):
    return S.head_entities(X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), 100)


CLEAN = "SELECT id, regexp_replace(upper(regexp_replace(coalesce(seq, ''), '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWYX]', '', 'g') AS seq FROM v_sequences"


def _clean(spark, d):
    return S.clean_sequences(X.sequences(spark, d))


@query("p8_clean_sequences", f"SELECT * FROM ({CLEAN}) WHERE length(seq) >= 4", "v_sequences")
def clean_sequences(spark, d):
    return S.clean_sequences(X.sequences(spark, d), 4)


@query("p8_dropped_count", f"SELECT count(*) AS total, count(*) FILTER (length(seq) < 4) AS dropped FROM ({CLEAN})", "v_sequences")
def dropped_count(spark, d):
    return S.dropped_count(X.sequences(spark, d), 4)


def _values_sql(columns: list[str]) -> str:
    return ", q AS (SELECT * FROM (" + CLEAN + ") WHERE length(seq) >= 1), a AS (SELECT id, [" + ", ".join(columns) + "] AS v FROM q) SELECT id, CAST(i AS INT) AS place, round(v[i], 6) AS value FROM a, (SELECT unnest(range(1, " + str(len(columns) + 1) + ")) AS i)"


def _values(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode(V.rounded(F.col("features"))).alias("place", "value")).withColumn("place", F.col("place") + 1)


def _share(letters: str, of: str) -> str:
    return f"coalesce((length(seq) - length(translate(seq, '{letters}', ''))) / nullif({of}, 0)::DOUBLE, 0)"


@query("c1_composition", _values_sql([_share(a, f"(length(seq) - length(translate(seq, '{S.AMINO_ACIDS}', '')))") for a in S.AMINO_ACIDS]), "v_sequences")
def composition(spark, d):
    return _values(_clean(spark, d).select("id", S.composition(F.col("seq")).alias("features")))


@query("c2_dipeptides", ", q AS (SELECT id, regexp_replace(seq, 'X', '', 'g') AS s FROM (" + CLEAN + ")), r AS (SELECT id, length(s) - 1 AS n, unnest(range(1, length(s))) AS k, s FROM q WHERE length(s) >= 2) SELECT id, substr(s, k, 2) AS pair, round(count(*) / max(n)::DOUBLE, 6) AS fraction FROM r GROUP BY 1, 2", "v_sequences")
def dipeptides(spark, d):
    return _rounded(S.dipeptides(_clean(spark, d)), "fraction")


@query("c3_physico_chemical", _values_sql(["length(seq)::DOUBLE", *[_share(c, "length(seq)") for c in S.CLASSES.values()]]), "v_sequences")
def physico_chemical(spark, d):
    return _values(_clean(spark, d).select("id", S.physico_chemical(F.col("seq")).alias("features")))


TFIDF = r""", t AS (SELECT id, regexp_replace(coalesce(seq, ''), '[ \t\n\x0B\f\r][ \t\n\x0B\f\r]+', ' ', 'g') AS s FROM v_sequences), g AS (SELECT id, substr(s, k, 3) AS gram FROM (SELECT id, s, unnest(range(1, length(s) - 1)) AS k FROM t WHERE length(s) >= 3)),
 c AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2), o AS (SELECT gram, count(*) AS df FROM c GROUP BY 1), w AS (SELECT id, c.gram, tf, df, tf * (ln((1.0 + (SELECT count(*) FROM v_sequences)) / (1 + df)) + 1) AS x FROM c JOIN o ON c.gram = o.gram)
 SELECT id, gram, tf, df, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS weight FROM w"""


def _tfidf(spark, d):
    return S.trigram_tfidf(X.sequences(spark, d).withColumnRenamed("seq", "text"))


@query("c4_trigram_tfidf", TFIDF, "v_sequences")
def tfidf(spark, d):
    return _rounded(_tfidf(spark, d), "weight")


PAIRS = [a + b for a in S.AMINO_ACIDS for b in S.AMINO_ACIDS]


@query("c5_joined_features", ", q AS (SELECT *, regexp_replace(seq, 'X', '', 'g') AS s FROM (" + CLEAN + ") WHERE length(seq) >= 1), q2 AS (SELECT *, list_transform(range(1, length(s)), lambda k: substr(s, k, 2)) AS g FROM q), a AS (SELECT id, list_concat(list_concat(["
       + ", ".join(_share(a, f"(length(seq) - length(translate(seq, '{S.AMINO_ACIDS}', '')))") for a in S.AMINO_ACIDS) + "], " + "d.v), ["
       + ", ".join(["length(seq)::DOUBLE", *[_share(c, "length(seq)") for c in S.CLASSES.values()]])
       + "]) AS v FROM q2 JOIN (SELECT id, list(coalesce(n, 0) / nullif(m, 0)::DOUBLE ORDER BY k) AS v FROM (SELECT q2.id, k, len(g) AS m, n FROM q2, (SELECT unnest(range(400)) AS k, unnest([" + ", ".join(f"'{p}'" for p in PAIRS) + "]) AS p) w LEFT JOIN (SELECT id, pair, count(*) AS n FROM (SELECT id, unnest(g) AS pair FROM q2) GROUP BY 1, 2) c ON c.id = q2.id AND c.pair = w.p) GROUP BY id) d USING (id))"
       + " SELECT id, CAST(i AS INT) AS place, round(coalesce(v[i], 0), 6) AS value FROM a, (SELECT unnest(range(1, 429)) AS i)", "v_sequences")
def joined_features(spark, d):
    return _values(S.joined_features(*_groups(spark, d)))


def _groups(spark, d):
    """Composition, pairs of letters and properties of the clean sequences."""
    rows = written(_clean(spark, d), "clean")
    return rows.select("id", S.composition(F.col("seq")).alias("features")), S.dipeptide_vectors(rows), rows.select("id", S.physico_chemical(F.col("seq")).alias("features"))


@query("c5_all_groups")
def all_groups(spark, d):
    return NF.sequence_features(X.sequences(spark, d))


@query("n1_node_features")
def node_features(spark, d):
    return NF.node_features(X.left_nodes(spark, d).select(F.col("node").alias("id"), "features"), X.sequences(spark, d))


@query("n1_sequence_sums", """, t AS (SELECT id, coalesce(seq, '') AS seq FROM v_sequences), q AS (SELECT id, regexp_replace(seq, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM t)
 SELECT id, CAST(length(s) AS DOUBLE) AS length, CASE WHEN s = '' THEN 0.0 ELSE 1.0 END AS composition, CASE WHEN length(s) < 2 THEN 0.0 ELSE 1.0 END AS pairs,
 round(CASE WHEN s = '' THEN 0 ELSE (length(s) - length(translate(s, 'FWYHSTNQCKRHDEAVILMGPC', ''))) / length(s)::DOUBLE + (length(s) - length(translate(s, 'HC', ''))) / length(s)::DOUBLE END, 6) AS properties FROM q""", "v_sequences")  # fmt: skip
def sequence_sums(spark, d):
    rows = NF.sequence_features(X.sequences(spark, d), 0)
    total = lambda first, n: F.round(F.aggregate(F.slice("features", first, n), F.lit(0.0), lambda a, x: a + x), 6)
    return rows.select("id", F.get("features", F.lit(420)).alias("length"), total(1, 20).alias("composition"), total(21, 400).alias("pairs"), total(422, 7).alias("properties"))


# --- vectors -----------------------------------------------------------------------------------------


NODE_LONG = "SELECT node, CAST(i AS INT) AS place, round({v}, 6) + 0.0 AS value FROM {t}, (SELECT unnest(range(1, {n})) AS i)"


@query("c6_l2_normalized", NODE_LONG.format(v="features[i] / coalesce(nullif(sqrt(list_dot_product(features, features)), 0), 1)", t="v_nodes", n=65), "v_nodes")
def l2_normalized(spark, d):
    return _long(X.nodes(spark, d).select("node", V.l2_normalized(F.col("features")).alias("features")), "node")


@query("c7_standardize", ", l AS (SELECT node, i, features[i] AS x FROM v_nodes, (SELECT unnest(range(1, 65)) AS i)), s AS (SELECT i, avg(x) AS m, coalesce(nullif(stddev_pop(x), 0), 1) AS s FROM l GROUP BY i) SELECT node, CAST(i AS INT) AS place, round((x - m) / s, 6) + 0.0 AS value FROM l JOIN s USING (i)", "v_nodes")
def standardize(spark, d):
    return _long(R.standardize(X.nodes(spark, d).select("node", "features")), "node")


@query("c8_padded", NODE_LONG.format(v="CASE WHEN i <= 64 THEN features[i] ELSE 0 END", t="v_nodes", n=71), "v_nodes")
def padded(spark, d):
    return _long(X.nodes(spark, d).select("node", V.padded(F.col("features"), 70).alias("features")), "node")


@query("c9_sigmoid", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-CAST(l_discount AS DOUBLE) * 40 + 2)), 6) AS prob FROM lineitem")
def sigmoid(spark, d):
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(V.sigmoid(F.col("l_discount").cast("double") * 40 - 2), 6).alias("prob"))


SIDE_LONG = "SELECT node, side, CAST(i AS INT) AS place, round(features[i], 6) + 0.0 AS value FROM v_nodes, (SELECT unnest(range(1, 65)) AS i)"


@query("u5_stack_features", SIDE_LONG, "v_nodes")
def stack_features(spark, d):
    left, _ = X.sizes(spark, d)
    rows = X.nodes(spark, d)
    parts = [rows.where(F.col("side") == s).select((F.col("node") - (0 if s == "left" else left)).alias("idx"), "features") for s in ("left", "right")]
    return _long(T.stack_features(*parts, left), "node", "side")


@query("s4_checked_features", SIDE_LONG, "v_nodes")
def checked_features(spark, d):
    return _long(T.checked_features(X.nodes(spark, d), *X.sizes(spark, d)), "node", "side")


@query("j10_pair_feature_sets", "SELECT lower(c_name) AS dataset, c_name AS left_name, upper(c_name) AS right_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def pair_feature_sets(spark, d):
    rows = X.table(spark, d, "customer")
    ordering = rows.join(X.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return T.pair_feature_sets(rows.select(F.col("c_name").alias("dataset")), ordering.select(F.upper("c_name").alias("dataset")))


@query("a11_mean_pool", ", l AS (SELECT id, i, avg(vec[i]) AS m FROM v_residues, (SELECT unnest(range(1, 65)) AS i) WHERE pos < 10 GROUP BY 1, 2), n AS (SELECT id, count(*) AS o FROM v_residues GROUP BY 1) SELECT id, CAST(i AS INT) AS place, round(m, 6) + 0.0 AS value, least(o, 10) AS length, o AS original_length, o > 10 AS truncated FROM l JOIN n USING (id)", "v_residues")
def mean_pool(spark, d):
    rows = SP.mean_pool(X.residues(spark, d), 10)
    return _long(rows, "id", "length", "original_length", "truncated")


@query("r4_band_energies", """, s AS (SELECT id, count(*) AS n FROM v_residues GROUP BY 1), e AS (SELECT id, n, k, d, sum(vec[d] * cos(pi() * (2 * pos + 1) * k / (2 * n))) * sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / n::DOUBLE) AS c
 FROM v_residues JOIN s USING (id), (SELECT unnest(range(0, 25)) AS k), (SELECT unnest(range(1, 65)) AS d) WHERE k < n GROUP BY 1, 2, 3, 4),
 b AS (SELECT *, greatest(1, n // 8) AS lo, least(n, greatest(greatest(1, n // 8) + 1, n // 2)) AS mi FROM e)
 SELECT id, round(sum(c * c) FILTER (k < lo), 6) AS low, round(sum(c * c) FILTER (k >= lo AND k < mi), 6) AS mid, round(sum(c * c) FILTER (k >= mi), 6) AS high FROM b GROUP BY id""", "v_residues")  # fmt: skip
def band_energies(spark, d):
    return _rounded(SP.band_energies(X.residues(spark, d)), "low", "mid", "high")


@query("r5_spectral_features")
def spectral_features(spark, d):
    return SP.spectral_features(X.residues(spark, d))


BAND_STATISTICS = ["coeff_energy", "coeff_energy_ratio", "fro_norm", "l1_over_l2", "max_abs", "mean_abs", "std", "sum_singular_sq"]


@query("r5_band_statistics", """, s AS (SELECT id, count(*) AS n FROM v_residues GROUP BY 1), w AS (SELECT n, k, pos, cos(pi() * (2 * pos + 1) * k / (2 * n)) * sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / n::DOUBLE) AS w
 FROM (SELECT DISTINCT n FROM s), (SELECT unnest(range(0, 25)) AS k), (SELECT unnest(range(0, 25)) AS pos) WHERE k < n AND pos < n),
 e AS (SELECT id, s.n, k, d, sum(vec[d] * w) AS c FROM v_residues r JOIN s USING (id) JOIN w ON w.n = s.n AND w.pos = r.pos, (SELECT unnest(range(1, 65)) AS d) GROUP BY 1, 2, 3, 4),
 b AS (SELECT *, greatest(1, n // 8) AS lo, least(n, greatest(greatest(1, n // 8) + 1, n // 2)) AS mi FROM e), g AS (SELECT *, CASE WHEN k < lo THEN 'low' WHEN k < mi THEN 'mid' ELSE 'high' END AS band FROM b),
 p AS (SELECT id, band, d, pos, sum(c * w) AS x FROM g JOIN w USING (n, k) GROUP BY 1, 2, 3, 4), t AS (SELECT id, sum(vec[d] * vec[d]) AS whole FROM v_residues, (SELECT unnest(range(1, 65)) AS d) GROUP BY 1)
 SELECT id, band, round(sum(x * x), 6) AS coeff_energy, round(sum(x * x) / max(whole), 6) AS coeff_energy_ratio, round(sqrt(sum(x * x)), 6) AS fro_norm, round(sum(abs(x)) / sqrt(sum(x * x)), 6) AS l1_over_l2, round(max(abs(x)), 6) AS max_abs,
 round(avg(abs(x)), 6) AS mean_abs, round(stddev_pop(x), 6) AS std, round(sum(x * x), 6) AS sum_singular_sq FROM p JOIN t USING (id) GROUP BY 1, 2""", "v_residues")  # fmt: skip
def band_statistics(spark, d):
    rows = SP.spectral_features(X.residues(spark, d)).select("id", F.explode(F.array(*map(F.lit, SP.BANDS))).alias("band"), "names", "features")
    at = lambda k: F.try_element_at("features", F.array_position("names", F.concat_ws("_", "band", F.lit(k))).cast("int"))
    return _rounded(rows.select("id", "band", *[at(k).alias(k) for k in BAND_STATISTICS]), *BAND_STATISTICS)


@query("r6_short_sequences", """WITH x AS (SELECT vec_id // 3 AS id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), n AS (SELECT vec_id // 3 AS id, count(*) AS length, max(len(embedding)) AS dim FROM embeddings GROUP BY 1)
 SELECT id, max(length) AS length, max(dim) AS dim, true AS fallback, round(avg(abs(x)), 6) AS mean_abs, round(stddev_pop(x), 6) AS std, round(sqrt(sum(x * x)), 6) AS fro_norm FROM x JOIN n USING (id) GROUP BY 1""")  # fmt: skip
def short_sequences(spark, d):
    residues = X.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("id"), (F.col("vec_id") % 3).alias("pos"), F.col("embedding").cast("array<double>").alias("vec"))
    of = [F.get("features", F.lit(k)).alias(c) for k, c in ((2, "mean_abs"), (3, "std"), (4, "fro_norm"))]
    return _rounded(SP.spectral_features(residues).select("id", "length", "dim", "fallback", *of), "mean_abs", "std", "fro_norm")


@query("r1_pca")
def pca(spark, d):
    return R.pca_pad(X.nodes(spark, d).select(F.col("node").alias("id"), "features"))


@query("r2_safe_project")
def safe_project(spark, d):
    return R.safe_project(X.nodes(spark, d).select(F.col("node").alias("id"), "features"))


@query("r3_tfidf_svd")
def tfidf_svd(spark, d):
    return R.text_svd(X.sequences(spark, d), text="seq")


def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in encoder: counts of four vowels.  It fails on some texts, and gives others a vector of another width."""
    if any("qu" in t for t in texts):
        raise RuntimeError("a text it can't take")
    return [[float(t.count(c)) for c in ("aei" if "x" in t else "aeio")] for t in texts]


COUNTS = ", ".join(f"CASE WHEN failed THEN NULL ELSE CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE) END AS {c}" for c in "aeio")


@query("x1_embed_batches", f"SELECT id, failed, {COUNTS} FROM (SELECT doc_id AS id, coalesce(text, '') AS t, contains(coalesce(text, ''), 'qu') OR contains(coalesce(text, ''), 'x') AS failed FROM documents)")
def embed_batches(spark, d):
    rows = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    good, failed = E.embed_batches(rows, _letters, width=4)
    good = good.select("id", F.lit(False).alias("failed"), *[F.get("features", F.lit(k)).alias(c) for k, c in enumerate("aeio")])
    return good.unionByName(failed.select("id", F.lit(True).alias("failed"), *[F.lit(None).cast("double").alias(c) for c in "aeio"]))


@query("x2_embed_sequences", f"SELECT id, CAST(k AS INT) AS pos, CAST(ascii(substr(seq, k, 1)) AS DOUBLE) AS a, CAST(k AS DOUBLE) AS b FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS k FROM ({CLEAN}) WHERE length(seq) >= 1)", "v_sequences")
def embed_sequences(spark, d):
    encode = lambda texts: [[[float(ord(c)), float(k)] for k, c in enumerate(t, 1)] for t in texts]
    rows = E.embed_sequences(_clean(spark, d), encode).select("id", F.posexplode("residues").alias("pos", "v"))
    return rows.select("id", (F.col("pos") + 1).alias("pos"), F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))
