"""Near duplicates and components against brute force."""

import random

import numpy as np
import pytest

from pairloom.llm import near_duplicates as nd
from pairloom.llm.components import components
from pairloom.llm.sketches import fast_sketches


def shingles(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute(rows, least=75):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), component, component is None or d == component))
    return sorted(out, key=str)


def corpus(seed):
    """Copies, near copies in chains and stars, a shared passage, short and odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(r.randint(20, 90))]
        for _ in range(r.randint(1, 25)):
            own = list(base)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
            if r.random() < 0.5:
                base = own  # a chain
    passage = " ".join(word() for _ in range(30))
    texts += [passage + " " + " ".join(word() for _ in range(r.randint(3, 40))) for _ in range(60)]
    texts += ["one", "ONE", "one two", "a b c d e", "A b c d e f", "", None, " \n ", texts[0], texts[0].upper(), "x " * 3000]
    r.shuffle(texts)
    ids = r.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed,small", [(1, 16), (2, 2)])
def test_all_links(spark, monkeypatch, seed, small):
    monkeypatch.setattr(nd, "SMALL", small)
    rows = [*corpus(seed), (None, "lonely text of a row without id"), (None, "one")]
    # texts without doc_id or with a shared one are compared like others, as ends and as bridges
    r = random.Random(seed)
    chain = [["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)]]
    for k in range(4):
        chain.append([*chain[-1][:10 * k], f"new{k}", *chain[-1][10 * k + 1 :]])
    rows += [(i, " ".join(t)) for i, t in zip((2000, None, 2001, None, 2001), chain)] + [(None, " ".join(chain[1]))] * 2 + [(2000, "another text under a number that is taken")] * 2
    docs = spark.createDataFrame([(i, t, 3, "b") for i, t in rows], "doc_id long, text string, n int, band string")
    got = sorted((tuple(r) for r in nd.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = nd.near_duplicates(spark.createDataFrame([(4, None), (3, "")], "doc_id long, text string"))
    assert sorted(tuple(r) for r in only.collect()) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_components(spark):
    r = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(90)]
    edges = [(a, b) for a, b in edges if a != b]
    group = {x: x for e in edges for x in e}
    for _ in range(len(group)):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == group


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        x = np.unique(r.integers(0, 2**63, 2 * n, np.uint64))
        both = np.concatenate([x[: max(1, 3 * n // 2)], x[n // 2 :]])
        counts = np.array([len(x[: max(1, 3 * n // 2)]), len(x[n // 2 :])])
        a, b = fast_sketches(both, counts, 256)
        assert (a < np.iinfo(np.uint64).max).all() and (b < np.iinfo(np.uint64).max).all()
        true = len(np.intersect1d(both[: counts[0]], both[counts[0] :])) / len(np.unique(both))
        assert abs((a == b).mean() - true) < 0.12
