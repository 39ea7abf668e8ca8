"""Mixing of sources, against a loop over the documents."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

from pairloom.llm.mixing import mix_sources, sample_copies, size_class
from pyspark.sql import functions as F


def brute(rows, weights=(5, 2, 1), cap=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = Counter()
    for _, s, t in rows:
        words[s] += size(t)
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), Fraction(sum(words.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] >= cap * words[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: Fraction(cap * words[s]) for s in over}
        left -= sum(cap * words[s] for s in over)
        free -= over
    return words, target, size


def documents():
    r = random.Random(5)
    rows = []
    for k in range(600):
        source = r.choice(["a", "a", "a", "b", "B", "é", "", None, "tiny"])
        rows.append((k, source, " ".join("w" for _ in range(r.choice([0, 1, 3, 40, 100, 300])))))
    rows += [(None, "a", "x y"), (None, "a", "x y"), (7, "a", None), (7, "a", None), (8, "b", "\t \n")]
    rows += [(9, "c", "same words here")] * 300 + [(10, "nothing", "  ")]
    return rows + [(11, "long", "word " * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "z") for i, s, t in rows], "doc_id long, source string, text string, size int, copies string")


def test_sample_copies(spark):
    rows = documents()
    words, target, size = brute(rows)
    got = sample_copies(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["size"]) for r in got) == sorted((i is None, i or 0, s or "", size(t)) for i, s, t in rows)
    taken = Counter()
    for r in got:
        s = r["source"]
        assert r["source_size"] == words[s] and math.isclose(r["target"], target[s], rel_tol=1e-12, abs_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and math.floor(target[s] / max(1, words[s])) <= r["copies"] <= 3
        taken[s] += r["taken"]
    assert math.isclose(sum(target.values()), sum(words.values()))
    for s in words:  # orders by size: no further from the target than the largest document and the width of a class
        largest = max(size(t) for _, x, t in rows if x == s)
        assert abs(taken[s] - target[s]) <= largest + words[s] / 32, s


def test_parts_and_reruns_agree(spark):
    rows = documents()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["size"], r["copies"])
    once = sorted(map(key, sample_copies(frame(spark, rows)).collect()))
    random.Random(1).shuffle(rows)
    assert sorted(map(key, sample_copies(frame(spark, rows).repartition(7), rows_a_part=3).collect())) == once
    assert sorted(map(key, sample_copies(frame(spark, rows), seed=1).collect())) != once


def test_systematic_rule(spark):
    rows = [(k, "a", "w " * (k % 50)) for k in range(200)] + [(k, "b", "w " * (k % 7)) for k in range(200, 400)]
    words, target, size = brute(rows)
    got = {r["doc_id"]: r["copies"] for r in sample_copies(frame(spark, rows)).collect()}
    for s in "ab":
        offset = (int(hashlib.md5(f"0|{s}".encode()).hexdigest()[:4], 16) + 0.5) / 65536
        md5 = lambda i, t: hashlib.md5(f"{i}|{size(t)}".encode()).hexdigest()
        order = sorted((size(t), md5(i, t), i) for i, x, t in rows if x == s)  # sizes below 64 are classes of their own
        ratio = float(target[s]) / words[s]
        assert [got[i] for _, _, i in order] == [math.floor(offset + ratio * (k + 1)) - math.floor(offset + ratio * k) for k in range(len(order))]


def test_mix_has_all_columns_and_the_copies(spark):
    rows = documents()
    df = frame(spark, rows).withColumn("__row", F.lit(1))
    for part in (200_000, 50):
        mixed = mix_sources(df, rows_a_part=part)
        assert mixed.columns == df.columns
        want = Counter()
        for r in sample_copies(df).collect():
            want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
        words = lambda t: len((t or "").split())
        assert Counter((r["doc_id"], r["source"], words(r["text"])) for r in mixed.collect()) == +want


def test_empty_and_classes(spark):
    empty = frame(spark, []).limit(0)
    assert sample_copies(empty).count() == 0 and mix_sources(empty).count() == 0
    assert all(r["target"] == 0 and r["taken"] == 0 for r in sample_copies(frame(spark, [(1, "a", None), (2, None, "")])).collect())
    sizes = spark.range(0, 5000).select("id", size_class(F.col("id")).alias("c")).orderBy("id").collect()
    classes = [r["c"] for r in sizes]
    assert classes == sorted(classes) and classes[:64] == list(range(64))
    for c in set(classes[64:]):
        own = [r["id"] for r in sizes if r["c"] == c]
        assert own[-1] - own[0] < own[0] / 31
