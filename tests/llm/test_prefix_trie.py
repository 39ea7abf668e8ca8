"""The trie of conversations, against one built from whole lists of turns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pairloom.llm.prefix_scan import _Scan, prefix_scan
from pairloom.llm.prefix_trie import conversation_trie, keyed_turns, rebuilt_turns, unforked
from pyspark.sql import functions as F


def conversations():
    r = random.Random(4)
    texts = ["hi there", "a b c", "", None, "x", "ok  then", "é 中文", "long " * 3000]
    rows = []
    for c in range(150):
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, r.choice(["user", "user", "assistant", None]), r.choice(texts[:3] if t < 2 else texts)))
    rows += [(c, t, "user", "hi there") for c in range(200, 260) for t in range(4)]  # copies
    rows += [(300, None, "user", "b"), (300, None, "user", "a"), (300, 0, "user", "c"), (300, 0, "user", "c")]  # no turn, repeated rows
    rows += [(-5, 0, "user", "x"), (-25, 0, "user", "x"), (-25, 1, None, None), (41, 0, "user", "no base"), (9_000_000_000, 2, "user", "x")]
    rows += [(7000, t, "user", str(t % 5)) for t in range(900)]  # a long one
    rows += [(None, 1, "user", "nobody")]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, g int")


def in_order(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(role, text) for _, role, _, text in sorted(x)] for c, x in turns.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += p not in children
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_rebuilt(spark):
    rows = conversations()
    assert rows_of(conversation_trie(rebuilt_turns(frame(spark, rows)))) == brute(rebuilt(in_order(rows)))


@pytest.mark.parametrize("bits", [(64, 64), (3, 64), (64, 4), (2, 2)])
def test_collisions_are_split(spark, bits):
    rows = [r for r in conversations() if r[0] is not None and r[0] != 7000]
    df = unforked(keyed_turns(frame(spark, rows), hash_bits=bits[0]))
    assert rows_of(conversation_trie(df, fingerprint_bits=bits[1])) == brute(in_order(rows))


def test_empty_and_turnless(spark):
    assert conversation_trie(rebuilt_turns(frame(spark, []).limit(0))).count() == 0
    lost = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # its only turn is replaced by none
    rows = [(lost, 0, "user", "x")]
    assert rows_of(conversation_trie(rebuilt_turns(frame(spark, rows)))) == brute({lost: []})


def test_scan_across_parts(spark):
    """A group that spans many partitions has the sums of one that doesn't."""
    df = spark.range(0, 3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).cast("long").alias("c"), "id", F.xxhash64("id").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_scan(df, "c", [F.col("id")], "v", 5).orderBy("c", "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = _Scan(5)(np.array([r["c"] for r in got]), np.array([r["v"] for r in got]))
    assert [(r["at"], r["before"], r["upto"]) for r in got] == list(zip(want[0].tolist(), *(x.view(np.int64).tolist() for x in want[1:])))
    total, last = 0, [r for r in got if r["c"] == 1]
    for k, r in enumerate(last):
        total = (total + r["v"] * pow(5, k, 1 << 64)) % (1 << 64)
    assert last[-1]["upto"] % (1 << 64) == total
