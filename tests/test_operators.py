"""Hand-made inputs, properties and guards of the library's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.jobs import node_features as NF
from pairloom.jobs.link_prediction import build_operators, fit_score_folds
from pairloom.operators import cliques as C
from pairloom.operators import encode as E
from pairloom.operators import folds as FO
from pairloom.operators import graph as G
from pairloom.operators import metrics as M
from pairloom.operators import negatives as N
from pairloom.operators import propagate as P
from pairloom.operators import ranking as RK
from pairloom.operators import reduce as R
from pairloom.operators import sequences as S
from pairloom.operators import similarity as SI
from pairloom.operators import spectral as SP
from pairloom.operators import walks as W
from pairloom.operators.decompose import truncated_svd
from pairloom.session import written
from pairloom.sources import tables as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def graph(spark, pairs, fold=1):
    both = [(fold, a, b) for a, b in pairs] + [(fold, b, a) for a, b in pairs]
    return spark.createDataFrame(both, "fold int, src long, dst long").distinct()


# --- folds ---


def test_positive_pairs(spark):
    df = spark.createDataFrame([(1, 1, "1"), (1, 1, "1.0"), (1, 2, "x"), (2, 2, None), (3, 3, "2"), (4, 4, "0")], "left_id long, right_id long, label string")
    assert rows(FO.positive_pairs(df)) == [(1, 1)]
    assert FO.positive_pairs(df.drop("label")).count() == 5
    with pytest.raises(ValueError):
        FO.positive_pairs(df.where("left_id > 1"), required=True)


@pytest.mark.parametrize("n,k", [(2, 10), (23, 10), (100, 3)])
def test_folds_are_balanced(spark, n, k):
    edges = spark.range(n).select(F.col("id").alias("left_idx"), (F.col("id") % 7).alias("right_idx"))
    assigned = FO.assign_folds(edges, k)
    sizes = [r["count"] for r in assigned.groupBy("test_fold").count().orderBy("test_fold").collect()]
    assert len(sizes) == min(n, k) and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True) and sum(sizes) == n
    assert rows(assigned) == rows(FO.assign_folds(edges.repartition(5).orderBy(F.rand(3)), k))
    assert rows(assigned) != rows(FO.assign_folds(edges, k, seed=1)) or n == 2
    expanded = FO.expand_folds(assigned)
    assert expanded.where("split = 'test'").count() == n and expanded.count() == n * min(n, k)


def test_folds_by_dataset(spark):
    df = spark.createDataFrame([(d, 10 * i, 100 * (i % 3)) for d in "ab" for i in range(9 if d == "a" else 5)], "dataset string, left_id long, right_id long")
    edges, lefts, rights = FO.index_entities(df, ["dataset"])
    assert {(r["dataset"], r["left_idx"]) for r in edges.collect()} == {("a", i) for i in range(9)} | {("b", i) for i in range(5)}
    meta = FO.fold_meta(FO.expand_folds(FO.assign_folds(edges, 3, by=["dataset"]), ["dataset"]), lefts, rights, ["dataset"])
    assert {(r["dataset"], r["num_left"], r["num_right"]) for r in meta.collect()} == {("a", 9, 3), ("b", 5, 3)}


def test_fold_guards(spark):
    edges = spark.createDataFrame([(0, 0)], "left_idx long, right_idx long")
    for k in (1, 2):
        with pytest.raises(ValueError):
            FO.assign_folds(edges, k)


def test_entities_as_universe(spark):
    pairs = spark.createDataFrame([(5, 7)], "left_id long, right_id long")
    edges, _, _ = FO.index_entities(pairs, left=spark.createDataFrame([(1,), (5,), (9,)], "left_id long"))
    assert rows(edges) == [(5, 7, 1, 0)]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_ranks_and_sums(spark, parts):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 301).alias("v"), F.lit(2).alias("w")).repartition(parts)
    ranked = RK.global_rank(df, ["g"], [F.col("v")], RK.range_of(df, "v", 7), "r").collect()
    for g in range(3):
        own = sorted((r["v"], r["r"]) for r in ranked if r["g"] == g)
        assert [r for _, r in own] == list(range(100))
    sums = RK.global_running_sums(df, ["g"], "v", ["w"], 5).collect()
    for g in range(3):
        assert [r["cum_w"] for r in sorted((r for r in sums if r["g"] == g), key=lambda r: -r["v"])] == [2 * k for k in range(1, 101)]
    assert RK.global_rank(df.limit(0), ["g"], [F.col("v")], RK.range_of(df.limit(0), "v"), "r").count() == 0


@pytest.mark.parametrize("a_part", [1000, 40, 7])
def test_ordered_ranks(spark, a_part):
    df = spark.range(300).select((F.col("id") * F.col("id") % 3).alias("g"), (F.col("id") * 37 % 301).alias("v"), F.lit(2).alias("w")).repartition(5)
    for by in ([], ["g"]):
        ranked = RK.ordered_rank(df, by, ["v"], 300, "r", a_part).collect()
        for g in {tuple(r[c] for c in by) for r in ranked}:
            own = sorted((r["v"], r["r"]) for r in ranked if tuple(r[c] for c in by) == g)
            assert [r for _, r in own] == list(range(len(own)))
        assert len(ranked) == 300 and RK.ordered_rank(df.limit(0), by, ["v"], 0, "r", a_part).count() == 0


def test_folds_in_parts(spark):
    """Indices and folds are the same however many ranges they are made in."""
    pairs = spark.createDataFrame([(f"l{k * 7 % 23}", k * 5 % 31, k % 2) for k in range(200)], "left_id string, right_id long, dataset long").distinct()
    for by in ([], ["dataset"]):
        own = pairs.select("left_id", "right_id", *by).distinct()
        want = rows(FO.assign_folds(FO.index_entities(own, by)[0], 3, by=by))
        assert rows(FO.assign_folds(FO.index_entities(own, by, rows_a_part=6)[0], 3, by=by, rows_a_part=20)) == want


def test_best_epochs(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.5), (1, 3, 0.1), (2, 1, nan), (2, 2, None), (3, 1, nan), (3, 2, 0.0)], "fold int, epoch int, metric double")
    assert rows(FO.best_epochs(df, ["fold"])) == [(1, 1, 0.5), (2, -1, -1.0), (3, 2, 0.0)]


# --- similarity and negatives ---


@pytest.mark.parametrize("tile", [3, 2048])
def test_similarity_against_numpy(spark, tile, monkeypatch):
    monkeypatch.setattr(SI, "STRIP", 2)
    x = np.random.default_rng(1).normal(size=(23, 5))
    x[3], x[4] = x[5], 0
    x[10:16] = x[5]  # more ties than k
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>").repartition(6)
    unit = x / np.where((n := np.linalg.norm(x, axis=1)) == 0, 1, n)[:, None]
    cos = np.round(unit @ unit.T, 9)
    for f, sign in ((SI.similarity_edges(df, 4, tile_rows=tile), -1), (SI.dissimilar_neighbors(df, 4, tile_rows=tile), 1)):
        got = {(r[0], r["rank"]): r[1] for r in f.collect()}
        for i in range(23):
            want = sorted((j for j in range(23) if j != i), key=lambda j: (sign * cos[i, j], j))[:4]
            assert [got[i, k] for k in range(1, 5)] == want
    assert SI.similarity_edges(df, 0).count() == 0 and SI.similarity_edges(df.limit(1), 3).count() == 0
    assert SI.similarity_edges(df, 99).groupBy("src").count().where("count = 22").count() == 23


def test_tiles_take_few_pairs_in_double_precision(monkeypatch):
    """Best pairs of two tiles, with many copies, as of all pairs; most pairs are told apart by single precision alone."""
    r = np.random.default_rng(8)
    x, y = r.normal(size=(700, 16)), r.normal(size=(1500, 16))
    x[350:437], y[500:750] = x[0], x[0]
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    taken, add = [], SI._Best.add
    monkeypatch.setattr(SI._Best, "add", lambda self, row, other, score: (taken.append(len(row)), add(self, row, other, score)))
    for a, b, same in ((x, y, False), (y, y, True)):
        there, back = SI._met(a, b, 10, same)
        for got, p, q in ((there, a, b), (back, b, a)):
            if got is not None:
                key = -np.round(p @ q.T, 9)
                if same:
                    np.fill_diagonal(key, np.inf)
                want = {(i, int(j)) for i, v in enumerate(key) for j in np.lexsort((np.arange(len(v)), v))[:10]}
                assert set(zip(got[0].tolist(), got[1].tolist())) == want
                assert np.allclose(got[2], (p @ q.T)[got[0], got[1]])
    assert sum(taken) < 0.1 * (2 * 700 * 1500 + 1500 * 1500)


def test_approximate_similarity(spark):
    x = np.random.default_rng(2).normal(size=(20, 6))
    x = np.concatenate([x, x + 0.01])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>")
    got = {(r["src"], r["dst"]) for r in SI.similarity_edges_approximate(df, 1, 0.9).collect()}
    assert len(got & {(i, (i + 20) % 40) for i in range(40)}) >= 36


def test_recall_of_approximate_similarity(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 64)).repeat(10, 0) + r.normal(size=(600, 64)) * r.uniform(0.2, 1.5, size=(600, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>")
    for least in (0.35, 0.6):
        exact = {(r["src"], r["dst"]): r["score"] for r in SI.similarity_edges(df, 10, least).collect()}
        got = {(r["src"], r["dst"]): r["score"] for r in SI.similarity_edges_approximate(df, 10, least).collect()}
        assert len(exact) > 500 and len(exact.keys() & got.keys()) >= 0.9 * len(exact)
        assert all(math.isclose(exact[e], got[e], abs_tol=1e-6) for e in exact.keys() & got.keys()) and min(got.values()) >= least - 1e-6


def test_approximate_similarity_by_lists(spark):
    """A row visits a few lists: recall on clustered nodes, scores as they are, no node beside itself, copies of one vector."""
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 64)).repeat(10, 0) + r.normal(size=(600, 64)) * r.uniform(0.2, 1.5, size=(600, 1))
    x[100:160] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>")
    exact = {(e["src"], e["dst"]): e["score"] for e in SI.similarity_edges(df, 10, 0.35).collect()}
    got = {(e["src"], e["dst"]): e["score"] for e in SI.similarity_edges_approximate(df, 10, 0.35, list_rows=20, probes=10).collect()}
    assert len(exact.keys() & got.keys()) >= 0.9 * len(exact) and all(a != b for a, b in got)
    assert all(math.isclose(exact[e], got[e], abs_tol=1e-6) for e in exact.keys() & got.keys()) and min(got.values()) >= 0.35


def test_negatives(spark):
    pairs = spark.createDataFrame([(1, l, r) for l in range(6) for r in range(4) if (l + r) % 3 == 0], "fold int, left_idx long, right_idx long")
    train, test = pairs.where("left_idx < 4"), pairs.where("left_idx >= 4")
    near = spark.createDataFrame([(l, (l + k) % 6) for l in range(6) for k in (1, 2)], "left_idx long, neighbor_idx long")
    out = N.sample_negatives(train, test, near)
    known, got = set(rows(pairs)), {s: {(r["fold"], r["left_idx"], r["right_idx"]) for r in out.where(F.col("split") == s).collect()} for s in ("train", "test")}
    assert not known & (got["train"] | got["test"]) and not got["train"] & got["test"] and got["train"]
    with pytest.raises(ValueError):
        N.sample_negatives(train, test, near.limit(0), required=True)


# --- graphs ---


def test_graph_guards_and_loops(spark):
    pairs = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 0, 0)], "fold int, left_idx long, right_idx long")
    assert rows(G.interaction_graph(pairs, 2, 2)) == [(1, 0, 2), (1, 1, 3), (1, 2, 0), (1, 3, 1)]
    assert G.interaction_graph(pairs, 2, 2, self_loops=True).count() == 8
    similar = spark.createDataFrame([(0, 1), (1, 1), (0, 9)], "src long, dst long")
    merged = G.merged_graph(pairs, similar, 2, 2)
    assert rows(merged) == [(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 0), (1, 3, 1)]
    assert rows(G.edge_stats(merged, 2)) == [(1, 5, 1, 0, 4)]
    for bad in ((1, 2), (2, 1)):
        with pytest.raises(ValueError):
            G.assert_index_range(pairs, *bad)
    with pytest.raises(ValueError):
        G.assert_index_range(pairs.limit(0), 2, 2)


def test_cliques(spark):
    five = [(a, b) for a in range(5) for b in range(a)]
    star = [(100, 101 + k) for k in range(20)]
    g = graph(spark, five + star + [(10, 11), (11, 12), (10, 12)])
    counts = {r["order"]: r["cliques"] for r in C.clique_counts(C.cliques(g, 4)).collect()}
    assert counts == {2: 11, 3: 5, 4: 1}
    mixed = {r["order"]: r["cliques"] for r in C.clique_counts(C.cliques(g, 4, num_left=2)).collect()}
    assert mixed == {2: 10 - 1, 3: 5, 4: 1}
    assert C.cliques(g, 1).count() == 0
    loops = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 2, 0)], "fold int, src long, dst long")
    assert [r["members"] for r in C.cliques(loops, 3).collect()] == [[0, 1, 2]]
    with pytest.raises(ValueError):
        C.cliques(g, 0)


def test_walks_against_numpy(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)]
    g = graph(spark, edges)
    a = np.zeros((5, 5))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    p, alpha, steps = a / a.sum(1, keepdims=True), 0.15, 9
    want = sum(alpha * (1 - alpha) ** j * np.linalg.matrix_power(p, j) for j in range(steps + 1))
    got = np.zeros((5, 5))
    for r in W.restart_scores(g, alpha, steps).collect():
        got[r["src"], r["dst"]] = r["weight"]
    assert np.allclose(got, want) and np.allclose(got.sum(1), 1 - (1 - alpha) ** (steps + 1))
    joined = {(r["src"], r["dst"]): r["weight"] for r in W.restart_scores(g, alpha, steps, broadcast_moves=0).collect()}
    assert all(math.isclose(joined.get((s, d), 0), want[s, d], abs_tol=1e-7) for s in range(5) for d in range(5))
    only = W.restart_scores(g, alpha, steps, sources=spark.createDataFrame([(2,)], "node long")).select("src").distinct()
    assert rows(only) == [(2,)]
    loop = spark.createDataFrame([(1, 7, 7), (1, 1, 2), (1, 2, 1)], "fold int, src long, dst long")
    assert W.restart_scores(loop, alpha, 3).where("src = 7").count() == 0
    assert W.restart_scores(g, alpha, steps, prune=0.05).agg(F.min("weight")).first()[0] >= 0.05


def walk_of_random_edges(n, degree, seed):
    r = np.random.default_rng(seed)
    src, dst = r.integers(0, n, n * degree), r.integers(0, n, n * degree)
    src, dst = np.unique(np.stack([src, dst], 1)[src % 7 != 3], axis=0).T  # some nodes have no way out
    return W.Walk.on_graph(src * 10, dst * 10, 1 / np.bincount(src)[src], 0.15)


def test_ways_of_walking_agree():
    for walk in (walk_of_random_edges(120, 3, 1), W.Walk.on_cliques(*np.unique(np.random.default_rng(2).integers(0, 40, (2, 90)), axis=1), 0.15)):
        p, sources = walk.matrix(), walk.nodes[::3]
        assert np.isclose(p.sum(1).max(), 1)
        exact = term = 0.15 * np.eye(len(p))
        for _ in range(400):
            term = term @ p * walk.keep
            exact = exact + term
        for eps in (1e-2, 1e-5, 1e-8):
            for way in (walk.pushed, walk.doubled):
                left = exact[::3] - way(sources, None, eps)
                assert (left > -1e-12).all() and left.sum(1).max() <= eps  # the bound, for each source
        for rounds in (0, 1, 2, 7, 30):
            want = sum(0.15 * walk.keep**j * np.linalg.matrix_power(p, j) for j in range(rounds + 1))[::3]
            for got in (walk.doubled(sources, rounds, 0), walk.pushed(sources, rounds, 0)):
                assert np.allclose(got, want, atol=1e-13) and ((got > 0) == (want > 0)).all()


def test_walks_by_tasks_blocks_and_joins(spark):
    r = np.random.default_rng(5)
    edges = {(f, int(a), int(b)) for f, n in ((1, 30), (2, 50)) for a, b in r.integers(0, n, (3 * n, 2))}
    g = spark.createDataFrame(sorted(edges), "fold int, src long, dst long")
    key = lambda df: {(x["fold"], x["src"], x["dst"]): x["weight"] for x in df.collect()}
    want = key(W.restart_scores(g, prune=0.0))
    for other in (W.restart_scores(g, prune=1e-12, dense_nodes=0, eps=1e-10), W.restart_scores(g, prune=1e-12, dense_nodes=40, eps=1e-10)):
        got = key(other)
        assert got.keys() <= want.keys() and all(math.isclose(got.get(k, 0), v, abs_tol=1e-9) for k, v in want.items())
    found = C.incidence(C.cliques(g, 3))
    key = lambda df: {(x["fold"], x["order"], x["src"], x["dst"]): x["weight"] for x in df.collect()}
    want = key(W.clique_restart_scores(found, steps=6, prune=0.0))
    for other in ({"dense_nodes": 0}, {"broadcast_moves": 0}):
        got = key(W.clique_restart_scores(found, steps=6, prune=0.0, **other))
        assert got.keys() == want.keys() and all(math.isclose(got[k], v, abs_tol=1e-12) for k, v in want.items())
    assert W.restart_scores(g.limit(0)).count() == W.clique_restart_scores(found.limit(0)).count() == 0


def test_clique_walk_mass(spark):
    g = graph(spark, [(a, b) for a in range(4) for b in range(a)] + [(3, 4), (4, 5), (5, 3)])
    found = C.incidence(C.cliques(g, 3))
    for r in W.clique_restart_scores(found, 0.15, 40).groupBy("order", "src").agg(F.sum("weight").alias("w")).collect():
        assert math.isclose(r["w"], sum(0.15 * 0.85 ** (2 * j) for j in range(21)))


def test_propagation_equals_operator(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)])
    op = W.transitions(g, ["fold"]).select("fold", "src", "dst", F.col("p").alias("weight"))
    x = np.random.default_rng(3).normal(size=(4, 3))
    m = np.zeros((4, 4))
    for r in op.collect():
        m[r["src"], r["dst"]] = r["weight"]
    feats = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "fold int, node long, features array<double>")
    w = P.polynomial_weights(4, 0.1)
    want = sum(c * np.linalg.matrix_power(m, k) @ x for k, c in enumerate(w))
    got = np.array([r["features"] for r in P.propagate(op, feats, 4, 0.1).orderBy("node").collect()])
    assert np.allclose(got, want) and math.isclose(sum(w), 1)
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "fold int, left_idx long, right_idx long")
    z = feats.select("fold", "node", "features")
    joined = P.pair_features(pairs, z, 2).orderBy("left_idx").collect()
    assert np.allclose(joined[0]["features"], np.concatenate([x[0], x[3]])) and np.allclose(joined[1]["features"], np.concatenate([x[1], x[2]]))
    direct = P.pair_features(pairs.withColumn("right_idx", F.col("right_idx") + 2), z, 2, right_is_global=True).orderBy("left_idx").collect()
    assert direct[0]["features"] == joined[0]["features"]


def test_propagation_of_wide_vectors_and_many_rounds(spark):
    r = np.random.default_rng(8)
    m = np.where(r.random((6, 6)) < 0.5, r.random((6, 6)), 0) / 3
    op = spark.createDataFrame([(1, int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "fold int, src long, dst long, weight double")
    for width in (2, P.SIDE_BY_SIDE + 3):
        x = r.normal(size=(6, width))
        feats = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "fold int, node long, features array<double>")
        want = sum(c * np.linalg.matrix_power(m, k) @ x for k, c in enumerate(P.polynomial_weights(7, 0.1)))
        for entries, group in ((P.BROADCAST_ENTRIES, 0), (0, P.BROADCAST_ENTRIES), (0, 0)):
            got = P.propagate(op, feats, 7, 0.1, broadcast_entries=entries, group_entries=group).orderBy("node").collect()
            assert np.allclose([g["features"] for g in got], want)
            some = P.propagate(op, feats.where("node < 2"), 2, 0.1, broadcast_entries=entries, group_entries=group).select("node").collect()
            reached = (np.eye(6) + (m > 0) + (m > 0) @ (m > 0))[:, :2].sum(1) > 0
            assert sorted(r["node"] for r in some) == np.flatnonzero(reached).tolist()
    assert P.propagate(op, feats.limit(0)).count() == 0


def test_a_round_of_propagation_shuffles_its_sums_only(spark):
    r = np.random.default_rng(8)
    edges = [(1, int(a), int(b), 0.5) for a, b in r.integers(0, 50, (200, 2))]
    op = written(spark.createDataFrame(edges, "fold int, src long, dst long, weight double"), "operator")
    feats = spark.createDataFrame([(1, i, [1.0, 2.0]) for i in range(50)], "fold int, node long, features array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan shows its exchanges only when it has run
    try:
        plan = P.propagate(op, feats, 4, broadcast_entries=0, group_entries=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert plan.count("SortMergeJoin") == 4 and len(exchanges) <= 4 + 3, plan  # the sums of 4 rounds, the first state, the operator


def test_no_test_pair_leaks(spark):
    pairs = spark.createDataFrame([(l, r) for l in range(6) for r in range(5) if (l * r) % 2], "left_idx long, right_idx long")
    expanded = FO.expand_folds(FO.assign_folds(pairs, 3))
    g = G.interaction_graph(expanded.where("split = 'train'"), 6, 5)
    test = G.bipartite_edges(expanded.where("split = 'test'"), 6)
    assert g.join(test, ["fold", "src", "dst"]).count() == 0


def test_build_operators(spark):
    x = np.random.default_rng(5).normal(size=(9, 4))
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>")
    train = spark.createDataFrame([(f, l, (l + f) % 4) for f in (1, 2) for l in range(5)], "fold int, left_idx long, right_idx long")
    out = build_operators(train, feats, 5, 4, order=3, k=3, steps=4)
    assert {r["fold"] for r in out.select("fold").distinct().collect()} == {1, 2} and out.where("weight <= 0").count() == 0
    with pytest.raises(ValueError):
        build_operators(train, feats, 5, 4, order=0)


# --- metrics ---


def brute_auc(label, prob):
    pos, neg = [p for y, p in zip(label, prob) if y], [p for y, p in zip(label, prob) if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_metrics_with_ties(spark):
    r = np.random.default_rng(4)
    label, prob = r.integers(0, 2, 200).tolist(), (r.integers(0, 8, 200) / 8).tolist()
    df = spark.createDataFrame([(1, y, p) for y, p in zip(label, prob)], "fold int, label int, prob double")
    assert math.isclose(M.roc_auc(df).first()["roc_auc"], brute_auc(label, prob))
    ap, before, tp = 0.0, 0.0, 0
    for t in sorted(set(prob), reverse=True):
        tp = sum(y for y, p in zip(label, prob) if p >= t)
        n = sum(p >= t for p in prob)
        ap += (tp / sum(label) - before) * tp / n
        before = tp / sum(label)
    assert math.isclose(M.average_precision(df).first()["average_precision"], ap)
    curve = sorted((x["fpr"], x["tpr"]) for x in M.roc_curve(df).collect())
    assert math.isclose(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:])), brute_auc(label, prob))
    assert (1.0, 0.0) in {(x["precision"], x["recall"]) for x in M.pr_curve(df).collect()}


def test_one_class_and_zero_division(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.2), (2, 0, 0.9), (2, 0, 0.1)], "fold int, label int, prob double")
    assert all(math.isnan(r["roc_auc"]) for r in M.roc_auc(df).collect())
    assert rows(M.average_precision(df)) == [(1, 1.0), (2, 0.0)]
    out = {r["fold"]: r for r in M.binary_metrics(df).collect()}
    assert (out[1]["precision"], out[1]["recall"], out[1]["mcc"], out[2]["fp"], out[2]["f1"]) == (0.0, 0.0, 0.0, 1, 0.0)
    summary = {r["metric"]: r for r in M.metrics_summary(M.binary_metrics(df)).collect()}
    assert "fold" not in summary and summary["fp"]["mean"] == 0.5 and math.isclose(summary["fp"]["std"], math.sqrt(0.5))


# --- texts, vectors, spectra ---


def test_sequences(spark):
    df = spark.createDataFrame([(1, " a cß-d"), (2, None), (3, "B"), (4, "ACX")], "id long, seq string")
    assert rows(S.clean_sequences(df)) == [(1, "ACD"), (4, "ACX")]
    assert rows(S.dropped_count(df, 3)) == [(4, 2)]
    got = {r["id"]: r["f"] for r in S.clean_sequences(df).select("id", S.composition(F.col("seq")).alias("f")).collect()}
    assert np.allclose(got[1][:3], 1 / 3) and math.isclose(sum(got[4]), 1)
    pairs = spark.createDataFrame([(1, "ACXAC"), (2, "A"), (3, "")], "id long, seq string")
    assert rows(S.dipeptides(pairs)) == [(1, "AC", 2 / 3), (1, "CA", 1 / 3)]
    vectors = {r["id"]: r["features"] for r in S.dipeptide_vectors(pairs).collect()}
    assert len(vectors[2]) == 400 and sum(vectors[2]) == 0 and math.isclose(sum(vectors[1]), 1)
    assert pairs.select(S.physico_chemical(F.col("seq")).alias("f")).where("f[0] = 0").first()["f"] == [0.0] * 8
    with pytest.raises(ValueError):
        S.clean_sequences(df, 0)


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "ab  c"), (2, "ab cd"), (3, "x"), (4, None)], "id long, text string")
    got = {(r["id"], r["gram"]): r for r in S.trigram_tfidf(df).collect()}
    assert set(got) == {(1, "ab "), (1, "b c"), (2, "ab "), (2, "b c"), (2, " cd")}
    assert math.isclose(sum(r["weight"] ** 2 for k, r in got.items() if k[0] == 2), 1)


def test_tfidf_by_join(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ab  c", "ab cd é中😀", "x", None, "aaaa" * 50])], "id long, text string")
    one, two = (sorted((r["id"], r["gram"], r["tf"], r["df"], round(r["weight"], 9)) for r in S.trigram_tfidf(df, broadcast_grams=n).collect()) for n in (99, 0))
    assert one == two and (1, "é中😀", 1, 1) in {r[:4] for r in one}


def test_first_texts(spark):
    df = spark.createDataFrame([(1, 7, "  "), (2, 7, " b "), (3, 7, "c"), (4, 8, None), (5, 9, "")], "ord long, id long, text string")
    assert rows(S.first_non_empty(df, "id", "text", "ord")) == [(7, "b")]
    odd = spark.createDataFrame([(1, 7, "\t\n"), (2, 7, "\u00a0b\r\n"), (3, 7, "c")], "ord long, id long, text string")
    assert rows(S.first_non_empty(odd, "id", "text", "ord")) == [(7, "b")]
    assert rows(S.first_non_empty(df, "id", "text", "ord", trim=False, drop_empty=False)) == [(7, "  "), (8, ""), (9, "")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, features array<double>")
    assert [r["v"] for r in df.orderBy("id").select(V.l2_normalized(F.col("features")).alias("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(V.padded(F.col("features"), 3).alias("v")).first()["v"] == [3.0, 4.0, 0.0]
    flat = R.standardize(spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, features array<double>"))
    assert sorted(r["features"] for r in flat.collect()) == [[-1.0, 0.0], [1.0, 0.0]]


def test_sums_of_scores_without_the_scores(spark, monkeypatch):
    """As the scores' own sums and counts, in two groups with parts that are not reached; no score is made."""
    r = np.random.default_rng(14)
    pairs = {(f, int(a), int(b)) for f in (1, 2) for a, b in r.integers(0, 200, (260 * f, 2)) if a != b} | {(1, 500, 501), (2, 7, 900)}
    g = spark.createDataFrame(sorted(pairs), "fold int, src long, dst long")
    x = r.normal(size=(1000, 3))
    ends = spark.createDataFrame([(f, i, v.tolist()) for f in (1, 2) for i, v in enumerate(x)], "fold int, node long, features array<double>")
    want = {}
    for w in W.restart_scores(g, prune=0.0, eps=1e-12).collect():
        n, v = want.get((w["fold"], w["src"]), (0, 0))
        want[w["fold"], w["src"]] = (n + 1, v + w["weight"] * x[w["dst"]])
    monkeypatch.setattr(W, "restart_scores", None)
    monkeypatch.setattr(W, "WORDS", 1)
    got = {(w["fold"], w["src"]): (w["reached"], w["features"]) for w in W.restart_sums(g, ends).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1], atol=1e-7) for k in want)


def test_projections(spark):
    x = np.random.default_rng(6).normal(size=(30, 6)) * [5, 3, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = np.array([r["features"] for r in R.pca_pad(df, 8).orderBy("id").collect()])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert got.shape == (30, 8) and np.allclose(np.sqrt((got**2).sum(0))[:6], s) and np.allclose(got[:, 6:], 0)
    assert len(R.safe_project(df, 3).first()["features"]) == 3 and len(R.safe_project(df, 9).first()["features"]) == 9
    weights = spark.createDataFrame([(i, f"g{j}", float(abs(v))) for i, r in enumerate(x) for j, v in enumerate(r)], "id long, gram string, weight double")
    u = np.array([r["features"] for r in R.tfidf_svd(weights, 2).orderBy("id").collect()])
    assert np.allclose(np.sqrt((u**2).sum(0)), np.linalg.svd(np.abs(x), compute_uv=False)[:2])


def test_folds_fitted_together(spark):
    """One fit of all folds gives the scores of a fit for each."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    r = np.random.default_rng(6)
    vectors = r.normal(size=(40, 3)) * [1, 5, 0.1] + [0, 2, 1]
    z = spark.createDataFrame([(f, i, (v * f).tolist()) for f in (1, 2, 5) for i, v in enumerate(vectors)], "fold int, node long, features array<double>")
    pairs = []
    for f in (1, 2, 5):
        for k in range(150 * f):
            a, b = (int(x) for x in r.integers(0, 20, 2))
            chance = 1 / (1 + math.exp(-(vectors[a, 0] - vectors[20 + b, 1] / 5 + f - 2)))
            pairs.append((f, "train" if k % 3 else "test", a, b, int(r.random() < chance)))
    df = spark.createDataFrame(pairs, "fold int, split string, left_idx long, right_idx long, label int")
    got = fit_score_folds(df, z, 20, max_iter=100)
    assert got.columns == ["fold", "left_idx", "right_idx", "label", "prob"] and got.count() == sum(p[1] == "test" for p in pairs)
    joined = P.pair_features(df, z, 20).withColumn("x", array_to_vector("features"))
    auc = {x["fold"]: x["roc_auc"] for x in M.roc_auc(got).collect()}
    for f in (1, 2, 5):
        own = joined.where(F.col("fold") == f)
        model = LogisticRegression(featuresCol="x", maxIter=200, regParam=1e-3, tol=1e-9).fit(own.where("split = 'train'"))
        alone = model.transform(own.where("split = 'test'")).select("fold", "left_idx", "right_idx", "label", F.get(vector_to_array("probability"), F.lit(1)).alias("prob"))
        assert math.isclose(M.roc_auc(alone).first()["roc_auc"], auc[f], abs_tol=1e-3)
        both = alone.distinct().join(got.withColumnRenamed("prob", "other").distinct(), ["fold", "left_idx", "right_idx", "label"])
        assert both.agg(F.max(F.abs(F.col("prob") - F.col("other")))).first()[0] < 0.01
    assert fit_score_folds(df.limit(0), z, 20).count() == 0


def test_svd_has_a_row_for_every_text(spark):
    texts = ["abcabcabd", "", "bcdbcd", "xy", "cdabcd ab", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    weights = S.trigram_tfidf(df).select("id", "gram", "weight")
    grams = sorted({r["gram"] for r in weights.collect()})
    a = np.zeros((6, len(grams)))
    for r in weights.collect():
        a[r["id"], grams.index(r["gram"])] = r["weight"]
    for held in (R.PART_BYTES, 1):
        got = R.tfidf_svd(weights, 128, df, part_bytes=held).orderBy("id").collect()
        u = np.array([r["features"] for r in got])
        d = min(128, 5, len(grams) - 1)
        assert [r["id"] for r in got] == list(range(6)) and u.shape == (6, d) and not u[[1, 3, 5]].any()
        s = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(np.sqrt((u**2).sum(0)), s[:d], atol=1e-6) and np.allclose(u @ u.T, a @ a.T, atol=1e-6)
    assert len(R.tfidf_svd(weights).collect()) == 3  # those of the weights alone


def test_decomposition_of_texts_by_rows(spark, monkeypatch):
    """Products of rows as they lie are those of numpy, with dense and single places; nothing has a row for each gram."""
    from pairloom.operators import decompose as D

    r = np.random.default_rng(12)
    texts = ["".join(r.choice(list("abcde"), p=[0.5, 0.2, 0.15, 0.1, 0.05], size=int(n))) for n in r.integers(0, 40, 60)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    weights = [(x["id"], x["gram"], x["weight"]) for x in S.trigram_tfidf(df).collect()]
    grams = sorted({g for _, g, _ in weights})
    a = np.zeros((61, len(grams)))
    for i, g, w in weights:
        a[i, grams.index(g)] = w
    monkeypatch.setattr(R, "tfidf_svd", None)
    monkeypatch.setattr(S, "trigram_tfidf", None)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    signs = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])
    for head, strip in ((4096, 16384), (7, 5)):
        monkeypatch.setattr(D, "HEAD", head)
        monkeypatch.setattr(D, "STRIP", strip)
        got = {x["id"]: x["features"] for x in R.text_svd(df, 12).collect()}
        x = np.array([got[i] for i in range(61)])
        assert x.shape == (61, 12) and not x[60].any()
        assert np.allclose(np.sqrt((x**2).sum(0)), s[:12], rtol=1e-3) and np.allclose(x[:, :3], (u * s * signs)[:, :3], atol=0.02 * s[0])
    assert [x["features"] for x in R.text_svd(df.limit(1), 12).collect()] == [[]]


def test_decomposition_in_blocks(spark):
    """Leading values of a matrix with many places, in one block and in many; rows and places without an entry."""
    r = np.random.default_rng(9)
    a = (r.normal(size=(300, 40)) * 0.8 ** np.arange(40)) @ r.normal(size=(40, 500)) * (r.random((300, 500)) < 0.4)
    a[[0, 77, 299]] = 0
    a[:, 3] = 0
    entries = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "row long, place long, w double").repartition(5)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    signs = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])
    for part in (32 << 20, 8 * 15 * 100):
        got = {x["row"]: x["features"] for x in truncated_svd(entries, 300, 500, 5, part_bytes=part).collect()}
        x = np.array([got.get(i, [0.0] * 5) for i in range(300)])
        assert set(got) <= set(range(300)) and not x[[0, 77, 299]].any()
        assert np.allclose(np.sqrt((x**2).sum(0)), s[:5], rtol=1e-3) and np.allclose(x[:, :3], (u * s * signs)[:, :3], atol=0.02 * s[0])


def test_node_features_of_both_sides(spark, tmp_path):
    """Against numpy: features by definition, then the same products of rows (a projection may turn)."""
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("ACDEFGHIKLMNPQRSTVWYXb "), size=int(n))) for n in r.integers(2, 60, 24)] + ["", None, "xx"]
    vectors = r.normal(size=(9, 4))
    left = spark.createDataFrame([(10 + 3 * i, v.tolist()) for i, v in enumerate(vectors)], "id long, features array<double>")
    right = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "id long, seq string")
    raw = []
    for t in texts:
        v = [c for c in t or "" if c in S.AMINO_ACIDS]
        n = max(len(v), 1)
        pairs = [a + b for a, b in zip(v, v[1:])]
        every = [a + b for a in S.AMINO_ACIDS for b in S.AMINO_ACIDS]
        raw.append([v.count(a) / n for a in S.AMINO_ACIDS] + [pairs.count(p) / max(len(pairs), 1) for p in every] + [len(v)] + [sum(map(v.count, c)) / n for c in S.CLASSES.values()])
    raw = np.array(raw)
    own = {x["id"]: x["features"] for x in NF.sequence_features(right, 0).collect()}
    assert np.allclose([own[100 - i] for i in range(len(texts))], raw)
    whole = {x["id"]: x["features"] for x in NF.sequence_features(right, 6).collect()}
    whole = np.array([whole[100 - i] for i in range(len(texts))])
    assert whole.shape == (27, 434) and np.allclose(whole[:, :428], raw) and not whole[24:, 428:].any()
    for dim in (40, 16):
        made = NF.node_features(left, right, dim, 6)
        got = made.orderBy("node").collect()
        assert [(x["node"], x["side"], x["id"]) for x in got] == [(i, "left", 10 + 3 * i) for i in range(9)] + [(9 + i, "right", 74 + i) for i in range(27)]
        x = np.array([x["features"] for x in got])
        for mine, given in ((x[:9], vectors), (x[9:], whole[::-1])):
            scaled = (given - given.mean(0)) / np.where((std := given.std(0)) == 0, 1, std)
            u, s, _ = np.linalg.svd(scaled, full_matrices=False)
            best = (u * s)[:, :dim]
            assert mine.shape[1] == dim and np.allclose(mine @ mine.T, best @ best.T, atol=1e-6)
    made.select("node", "features").write.parquet(str(tmp_path / "nodes.parquet"))
    assert T.read_node_features(spark, str(tmp_path / "nodes.parquet"), 9, 27).count() == 36
    assert R.safe_project(left.limit(1), 3).first()["features"] == [0.0] * 3


def test_spectra(spark):
    r = np.random.default_rng(7)
    data = {1: r.normal(size=(13, 5)), 2: r.normal(size=(3, 5)), 3: r.normal(size=(4, 5))}
    df = spark.createDataFrame([(i, k, v.tolist()) for i, m in data.items() for k, v in enumerate(m)], "id long, pos int, vec array<double>").repartition(3)
    out = {x["id"]: x for x in SP.spectral_features(df).collect()}
    assert all(len(x["features"]) == 159 for x in out.values()) and [out[i]["fallback"] for i in (1, 2, 3)] == [False, True, False]
    named = dict(zip(out[1]["names"], out[1]["features"]))
    assert len(named) == 159 and math.isclose(sum(named[f"{b}_coeff_energy"] for b in SP.BANDS), (data[1] ** 2).sum())
    assert math.isclose(named["low_sum_singular_sq"], named["low_fro_norm"] ** 2)
    full = np.zeros((13, 5))
    a, b = SP.band_limits(13)[1]
    full[a:b] = SP.transform(data[1])[a:b]
    band = SP.cosine_basis(13).T @ full
    assert math.isclose(named["mid_max_abs"], np.abs(band).max()) and math.isclose(named["mid_mean_singular"], np.linalg.svd(band, compute_uv=False).mean())
    long = r.normal(size=(2100, 2))
    assert np.allclose(SP.transform(long), SP.cosine_basis(2100) @ long)
    pooled = {x["id"]: x for x in SP.mean_pool(df, 4).collect()}
    assert np.allclose(pooled[1]["features"], data[1][:4].mean(0)) and (pooled[1]["length"], pooled[1]["original_length"], pooled[1]["truncated"]) == (4, 13, True)
    assert not {x["id"]: x for x in SP.mean_pool(df).collect()}[1]["truncated"]


def test_spectra_of_long_wide_and_broken_sequences(spark):
    """Against the definition: runs of one band, slices of places, short and equal rows, positions without a vector."""
    r = np.random.default_rng(11)
    data = {1: r.normal(size=(9000, 20)), 2: np.ones((30, 20)), 3: r.normal(size=(70, 33)) + 100, 4: r.normal(size=(1, 40)), 5: np.zeros((8, 3))}
    given = [(i, 2 * k, v.tolist()) for i, m in data.items() for k, v in enumerate(m)] + [(3, 7, None), (6, 0, None), (5, 9, [])]
    df = spark.createDataFrame(given, "id long, pos int, vec array<double>").repartition(3)
    out = {x["id"]: x for x in SP.spectral_features(df).collect()}
    energies = {x["id"]: x for x in SP.band_energies(df).collect()}
    assert sorted(out) == sorted(energies) == [1, 2, 3, 4, 5] and len(set(out[1]["names"])) == 159
    for i, m in data.items():
        n, width = m.shape
        named = dict(zip(out[i]["names"], out[i]["features"]))
        assert (out[i]["length"], out[i]["dim"], out[i]["fallback"]) == (n, width, n < 4)
        for band, (a, b) in zip(SP.BANDS, SP.band_limits(n)):
            own, back = [], np.zeros((n, width))
            for k in np.array_split(np.arange(a, b), max(1, (b - a) // 500)):
                basis = np.cos(np.pi * np.outer(k, 2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(np.where(k == 0, 1, 2) / n)[:, None]
                own.append(basis @ m)
                back += basis.T @ own[-1]
            own = np.concatenate(own)
            assert math.isclose(energies[i][band], (own**2).sum(), rel_tol=1e-9, abs_tol=1e-9)
            if n >= 4:
                s = np.zeros(min(n, width))
                s[: min(own.shape)] = np.linalg.svd(own, compute_uv=False)
                want = {"std": back.std(), "mean_abs": np.abs(back).mean(), "max_abs": np.abs(back).max(), "sv_1": s[0], "sv_3": s[2], "mean_singular": s.mean(), "std_singular": s.std(), "rank": (s > 1e-9).sum()}
                assert all(math.isclose(named[f"{band}_{k}"], v, rel_tol=1e-8, abs_tol=1e-8) for k, v in want.items() if k != "rank" or i != 2), (i, band)
    assert SP.spectral_features(df.limit(0)).count() == 0


def test_encoders(spark, tmp_path):
    def encode(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "ccc", "dd"])], "id long, text string").coalesce(1)
    good, failed = E.embed_batches(df, encode, 3)
    assert rows(good) == [(0, [1.0]), (2, [3.0]), (3, [2.0])]
    assert E.failure_report(good, failed) == (1, ["RuntimeError: no"])
    ragged, wrong = E.embed_batches(df, lambda ts: [[1.0] * len(t) for t in ts], 4, width=1)
    assert rows(ragged) == [(0, [1.0])] and E.failure_report(ragged, wrong)[0] == 3
    mixed, none = E.embed_batches(df, lambda ts: [[1.0] * (1 + (len(ts) > 1 and t == "bad")) for t in ts], 4)
    assert mixed.count() == 4 and none.count() == 0  # a batch of two widths is tried row by row
    with pytest.raises(ValueError):
        E.failure_report(*E.embed_batches(df.where("id = 1"), encode))
    with pytest.raises(ValueError):
        E.embed_batches(df, encode, 0)
    calls = tmp_path / "calls"

    def counted(texts):
        with open(calls, "a") as f:
            f.write("".join(f"{t} " for t in texts))
        return [[1.0] for _ in texts]

    many = spark.range(300).select("id", F.col("id").cast("string").alias("text")).repartition(3)
    good, failed = E.embed_batches(many, counted, 7)
    assert good.count() == 300 and failed.count() == 0 and good.count() == 300
    assert sorted(map(int, calls.read_text().split())) == list(range(300))  # each row once, whoever reads
    seqs = df.select("id", F.col("text").alias("seq"))
    assert E.embed_sequences(seqs, lambda ts: [[[1.0]] * len(t) for t in ts]).count() == 4
    with pytest.raises(Exception, match="vectors for"):
        E.embed_sequences(seqs, lambda ts: [[[1.0]] for _ in ts]).collect()


# --- tables ---


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["Drug_ID ", "x"])
    assert T.resolve_column(df, T.LEFT_IDS) == "Drug_ID " and T.resolve_column(df, (), "x") == "x"
    for bad in (lambda: T.resolve_column(df, ("y",)), lambda: T.resolve_column(df, (), "y")):
        with pytest.raises(ValueError, match="Drug_ID"):
            bad()


def test_roots(spark, tmp_path):
    root = tmp_path / "sets"
    for name, text in {"a/dti": "DrugID,target_id,label\n1,2,1\n1,3,0\n2,2,x\n", "b/other": "x,y\n1,2\n", "c/dti": "drug_id,protein_id\n5,6\n", "dti_lists/z": "drug_id,protein_id\n5,6\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / f"{name}.csv").write_text(text)
    got = rows(T.read_interaction_root(spark, str(root)))
    assert got == [("a/dti", 1, 2, 1), ("a/dti", 1, 3, 0), ("a/dti", 2, 2, 0), ("c/dti", 5, 6, 1)]
    one = T.read_table(spark, str(root / "a/dti.csv"), {"left": T.LEFT_IDS, "right": T.RIGHT_IDS})
    assert one.columns == ["left", "right"]
    named = T.read_table(spark, str(root / "a/dti.csv"), {"left": T.LEFT_IDS}, {"left": "target_id", "mark": "label"})
    assert named.columns == ["left", "mark"] and named.first()["left"] == "2"
    with pytest.raises(ValueError, match="nothing"):
        T.read_table(spark, str(root / "a/dti.csv"), {}, {"x": "nothing"})
    (root / "DTI_Lists").mkdir()
    (root / "DTI_Lists/z.csv").write_text("drug_id,protein_id\n5,6\n")
    (root / "d").mkdir()
    (root / "d/dti.CSV").write_text("drug_id,protein_id\n7,8\n")
    assert rows(T.read_interaction_root(spark, str(root))) == [*got, ("d/dti", 7, 8, 1)]


def test_writing(spark, tmp_path):
    folds = spark.createDataFrame([("d", 1, "train", 0, 0), ("d", 1, "test", 1, 1)], "dataset string, fold int, split string, left_idx long, right_idx long")
    T.write_folds(folds, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    scores = spark.createDataFrame([(f, o, 0, 1, 0.5) for f in (1, 2) for o in (1, 2)], "fold int, order int, src long, dst long, weight double")
    path = str(tmp_path / "o")
    assert T.write_operators(scores.where("fold = 1 or order = 1"), path, 2).count() == 0
    assert rows(T.write_operators(scores.withColumn("weight", F.lit(0.9)), path, 2)) == [(1, 2)]
    back = spark.read.parquet(path)
    assert back.where("fold = 1 and weight = 0.5").count() == 2 and back.where("fold = 2 and weight = 0.9").count() == 2
    assert T.write_operators(scores, path, 2, overwrite=True).count() == 0
    T.write_metrics(spark.createDataFrame([(1, 0.5), (2, 0.7)], "fold int, auc double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/summary")).first()["mean"] == pytest.approx(0.6)


def test_feature_tables(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "idx long, features array<double>")
    assert rows(T.stack_features(one, one, 2).select("node", "side")) == [(0, "left"), (1, "left"), (2, "right"), (3, "right")]
    with pytest.raises(ValueError):
        T.stack_features(one, spark.createDataFrame([(0, [1.0, 2.0])], "idx long, features array<double>"), 2)
    with pytest.raises(ValueError):
        T.checked_features(one.withColumnRenamed("idx", "node"), 2, 2)
    names = spark.createDataFrame([("Aa",), ("b",)], "dataset string")
    assert rows(T.pair_feature_sets(names, spark.createDataFrame([("aA",)], "dataset string"))) == [("aa", "Aa", "aA")]
    for bad in (spark.createDataFrame([("z",)], "dataset string"), spark.createDataFrame([("AA",), ("aa",)], "dataset string")):
        with pytest.raises(ValueError):
            T.pair_feature_sets(names, bad)
    with pytest.raises(ValueError):
        T.clean_edges(spark.createDataFrame([], "drug_idx int, target_idx int"), required=True)


def test_node_features(spark, tmp_path):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "idx long, features array<double>")
    paths = [str(tmp_path / f"{c}.parquet") for c in "abc"]
    one.write.parquet(paths[0])
    one.limit(1).write.parquet(paths[1])
    one.withColumnRenamed("idx", "node").write.parquet(paths[2])
    both = T.read_node_features(spark, (paths[0], paths[1]), 2, 1)
    assert [r[:2] for r in rows(both)] == [(0, "left"), (1, "left"), (2, "right")]
    assert rows(T.read_node_features(spark, paths[2], 1, 1)) == [(0, "left", [1.0]), (1, "right", [2.0])]
    for bad in (lambda: T.read_node_features(spark, (paths[0], paths[1]), 1, 2), lambda: T.read_node_features(spark, paths[2], 2, 2)):
        with pytest.raises(ValueError):
            bad()


def test_merged_sets(spark, tmp_path):
    make = lambda sets: spark.createDataFrame([(d, i, [float(i)] * w) for d, n, w in sets for i in range(n)], "dataset string, idx long, features array<double>")
    out = str(tmp_path / "sets")
    got = T.merge_feature_sets(make([("A", 2, 3), ("b", 1, 1), ("only", 1, 1)]), make([("a", 1, 3)]), out)
    assert rows(got) == [("a", 2, 1, 3, False)]
    got = T.merge_feature_sets(make([("A", 9, 3), ("b", 1, 1)]), make([("a", 1, 3), ("B", 2, 1)]), out)
    assert rows(got) == [("a", 9, 1, 3, True), ("b", 1, 2, 1, False)]
    have = rows(spark.read.parquet(out).select("dataset", "node", "side"))
    assert have == [("a", 0, "left"), ("a", 1, "left"), ("a", 2, "right"), ("b", 0, "left"), ("b", 1, "right"), ("b", 2, "right")]
    with pytest.raises(ValueError, match="widths"):
        T.merge_feature_sets(make([("a", 1, 2)]), make([("a", 1, 3)]), out)
    T.write_summary(got, str(tmp_path / "summary"), {"k": 10, "seed": 7777})
    assert {(r["dataset"], r["config_seed"]) for r in spark.read.json(str(tmp_path / "summary")).collect()} == {("a", 7777), ("b", 7777)}


def test_encode_against_numpy(spark):
    """Branches of all orders, one behind the other, for each fold."""
    r = np.random.default_rng(12)
    x, ops = r.normal(size=(6, 3)), {(f, o): r.random((6, 6)) * (r.random((6, 6)) < 0.5) for f in (1, 2) for o in (1, 2)}
    entries = [(f, o, i, j, float(m[i, j])) for (f, o), m in ops.items() for i in range(6) for j in range(6) if m[i, j]]
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>")
    got = P.encode(spark.createDataFrame(entries, "fold int, order int, src long, dst long, weight double"), feats, 2, 3, 0.2)
    w = P.polynomial_weights(3, 0.2)
    for row in got.collect():
        want = [sum(c * np.linalg.matrix_power(ops[row["fold"], o], k) @ x for k, c in enumerate(w))[row["node"]] for o in (1, 2)]
        assert np.allclose(row["features"], np.concatenate(want))
    assert got.count() == 12


def test_evaluation_of_folds(spark):
    from pairloom.jobs.link_prediction import evaluate_folds

    r = np.random.default_rng(13)
    data = [(f, int(y), float(p)) for f in (1, 2) for y, p in zip(r.integers(0, 2, 60), r.integers(0, 9, 60) / 8)]
    for row in evaluate_folds(spark.createDataFrame(data, "fold int, label int, prob double")).collect():
        own = [(y, p) for f, y, p in data if f == row["fold"]]
        assert math.isclose(row["roc_auc"], brute_auc(*zip(*own)))
        hit = sum((p >= 0.5) == (y == 1) for y, p in own) / 60
        assert math.isclose(row["accuracy"], hit) and row["tp"] + row["fn"] == sum(y for y, _ in own)


def test_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(P, "SIDE_BY_SIDE", 2)
    op = spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 0, 1.0)], "fold int, src long, dst long, weight double")
    feats = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (1, 1, [4.0, 5.0, 6.0])], "fold int, node long, features array<double>")
    assert rows(P.apply_operator(op, feats, 3, ["fold"])) == [(1, 0, [2.0, 2.5, 3.0]), (1, 1, [1.0, 2.0, 3.0])]


def test_queries_take_all_folds(spark, tmp_path, monkeypatch):
    from pairloom.jobs import queries

    x = np.random.default_rng(8).normal(size=(12, 3))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    lines = [(l, r, "R", 50.0) for l in range(6) for r in range(6) if (l + r) % 3]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = {}
    monkeypatch.setattr(queries, "build_operators", lambda train, *a, **k: seen.update(a=a[3:], k=k) or train)
    monkeypatch.setattr(queries, "fit_score_folds", lambda rows, z, left: rows.join(z.select("fold").distinct(), "fold", "left_semi"))
    for made in (queries._operators, queries.fit_score):
        folds = made(spark, str(tmp_path)).select("fold").distinct().collect()
        assert sorted(r["fold"] for r in folds) == list(range(1, 11))
    assert seen == {"a": (), "k": {}}
