"""Ranked search, against the scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
from pairloom.llm import search
from pairloom.llm.search import ranked_search
from pyspark.sql import functions as F

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    words = [(i, Counter(cut(t))) for i, t in docs]
    N, L = sum(bool(w) for _, w in words), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    weight = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        own, found = cut(text), []
        for at, (i, w) in enumerate(words):
            m = 100 - 75 + (75 * sum(w.values()) * N) // L if L else 0
            score = sum(weight[t] * ((1_000_000_000 * w[t]) // (1000 * w[t] + 8 * m)) for t in own if t in w)
            if score > 0:
                found.append((-score, i is None, i, at))
        out += [(item, r, i, -s) for r, (s, _, i, _) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))[:k], 1)]
    return Counter(out)


def texts(n, seed):
    r = random.Random(seed)
    words = [f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(5000)] + ["the"] * 2500 + ["É", "日本", "X9"]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 3, 20, 60, 200]))) for _ in range(n)]


def tables(spark):
    body = texts(400, 1)
    items = list(enumerate(texts(30, 2)))
    docs = list(enumerate(body)) + [(k, body[5]) for k in range(1000, 1040)] + [(7, body[7]), (None, body[8]), (None, None), (2000, "the " * 20_000), (2001, items[4][1] + " x. " + items[4][1])]
    items += [(3, "The the THE w1"), (3, "w1 w2"), (None, "w3 w399"), (90, None), (91, ""), (92, "nowhere"), (93, "w5 " * 40)]
    return docs, items


def frames(spark, docs, items):
    one = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, rank int, row string")
    return one, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term int")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_ranked_search(spark):
    docs, items = tables(spark)
    want = brute(docs, items)
    a, b = frames(spark, docs, items)
    assert rows(ranked_search(a, b)) == want
    assert rows(ranked_search(a.repartition(6), b, block_terms=100, seed_terms=1)) == want
    assert rows(ranked_search(a, b, k=3)) == brute(docs, items, 3)


def test_small_runs(spark, monkeypatch):
    """Tasks that look at few pairs together and hold few scores give the same."""
    rng = np.random.default_rng(3)
    docs, items = tables(spark)
    a, b = frames(spark, docs, items)
    terms = search.item_terms(b)
    forward = search.forward_index(a, terms)
    N, L = forward.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    bounded = search._bounded(forward, terms, N, L, 10, 8).toArrow()
    own, batches = search._Items(bounded), forward.toArrow().combine_chunks().to_batches()
    pruned = (bounded["rest"].to_numpy() < bounded["bound"].to_numpy()).sum()
    assert pruned > len(bounded) / 4  # bounds do prune

    def scores(runs):
        return sorted(x for batch in runs for d, i, s in own.scored(search._Postings(batch, N, L)) for x in zip(batch["row"].to_numpy()[d].tolist(), i.tolist(), s.tolist(), strict=True))

    want = scores(batches)
    monkeypatch.setattr(search, "PAIRS", 50)
    cuts = sorted(rng.choice(len(batches[0]), 20, replace=False).tolist())
    runs = [batches[0].slice(x, y - x) for x, y in zip([0, *cuts], [*cuts, len(batches[0])], strict=True)]
    assert scores(batches) == want and scores(runs) == want and len(want) == len(set(want)) > 200


def test_stored_impacts(spark):
    docs, items = tables(spark)
    a, b = frames(spark, docs, items)
    forward = search.forward_index(a, search.item_terms(b))
    N, L = forward.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    want = {}
    for r in forward.collect():
        for t, c in zip(r["terms"], r["counts"], strict=True):
            m = 25 + 75 * r["n"] * N // L
            want.setdefault(t, []).append(1_000_000_000 * c // (1000 * c + 8 * m))
    got, count = {}, Counter()
    for r in search.best_impacts(forward.repartition(3), N, L, 4).collect():
        got.setdefault(r["term"], []).extend(r["impacts"])
        count[r["term"]] += r["held"]
    assert count == Counter({t: len(x) for t, x in want.items()})
    assert {t: sorted(x)[::-1][:4] for t, x in got.items()} == {t: sorted(x)[::-1][:4] for t, x in want.items()}


def test_wide_numbers(spark):
    n, tf = [1, 10**6, 3 * 10**9], [1, 5, 10**6]
    N, L = 10**11, 7 * 10**13 + 1
    want = [1_000_000_000 * t // (1000 * t + 8 * (25 + 75 * x * N // L)) for x, t in zip(n, tf, strict=True)]
    assert search._impacts(np.array(n), np.array(tf), N, L).tolist() == want
    df = spark.createDataFrame(list(zip(n, tf, strict=True)), "n long, tf long")
    assert [r[0] for r in df.select(search.impact(F.col("n"), F.col("tf"), N, L)).collect()] == want


def test_empty(spark):
    docs, items = tables(spark)
    a, b = frames(spark, docs, items)
    for x, y in ((a.limit(0), b), (a, b.limit(0)), (a.where("text is null"), b), (a, b.where("item_id >= 90 and item_id < 93"))):
        got = ranked_search(x, y)
        assert got.count() == 0 and dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
