"""Decontamination, sharding, packing and token files against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import decontamination, packing, sharding, token_files, tokens
from pairloom.llm.common import SPACED, Words, grouped_rank, numbered, text_slices

DOCS = "doc_id long, text string, n_words string, shard string, length string"  # with names that operators use


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in texts], schema)


def odd_texts():
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma3", "été", "中文", "x", "the", "a-b", "don't"]
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(30)]
    return [*made, "", None, "  \n\t ", "Üß " * 4000, made[0], made[1], "a\x00b c", "<|endoftext|> x", "a  \n\n  b   c"]


def test_words_of_batches():
    texts = odd_texts()
    got = []
    for _, _, flat, at in text_slices(pa.array(texts), 300):
        w = Words(flat, at, SPACED)
        rows = defaultdict(list)
        for s, e, i in zip(w.start, w.end, w.row, strict=True):
            rows[i].append(w.low[s:e].tobytes())
        got += [rows[i] for i in range(len(at) - 1)]
        names = {w.low[s:e].tobytes(): h for s, e, h in zip(w.start, w.end, w.hash, strict=True)}
        assert len(set(names.values())) == len(names)
    low = bytes(range(256)).lower()
    assert got == [(t or "").encode().translate(low).split() for t in texts]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_decontamination(rows, items, n=10):
    out = []
    for i, text in rows:
        words, hit, names = words_of(text), set(), set()
        for item, t in items:
            w = words_of(t)
            for cut in {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else ():
                for k in range(len(words) - len(cut) + 1):
                    if tuple(words[k : k + len(cut)]) == cut:
                        hit |= set(range(k, k + len(cut)))
                        names |= set() if item is None else {str(item)}
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_decontamination(spark, limit):
    texts = odd_texts()
    rows = list(enumerate(texts))
    items = [(1, " ".join((texts[2] or "").split()[3:20])), (20, texts[4]), (3, "Üß üß"), (4, ""), (5, None), (6, "x X"), (7, "x,x"), (None, "a-b the"), (None, texts[7]), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs(spark, rows), bench, clean=True, broadcast_bytes=limit).collect()
    assert sorted([tuple(r)[:6] for r in got], key=str) == brute_decontamination(rows, items)
    kept = decontamination.decontaminate(docs(spark, rows), bench, keep=["n_words", "doc_id"], broadcast_bytes=limit)
    assert kept.columns == ["n_words", "doc_id", "scan_n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert {r["n_words"] for r in kept.collect()} == {"x"}
    clean = {r["doc_id"]: r["clean_text"] for r in got}
    assert clean[0] is not None and all(clean[r["doc_id"]] == (texts[r["doc_id"]] or "") for r in got if not r["contaminated"])
    assert words_of(clean[4]) == []


def test_empty_tables(spark):
    none, bench = docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.decontaminate(docs(spark, [(1, "a b")]), bench).first()["n_hit"] == 0
    assert sharding.shard_documents(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert token_files.token_file_digests(none).count() == 0


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(1).integers(0, 2**64, 4000, np.uint64)
    for n in (1, 2, 16, 17, 100):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_sharding_by_clashing_keys(spark):
    df = spark.createDataFrame([(i % 7, "a" * i, i) for i in range(40)] + [(None, None, 1), (None, "", 1)], "shard long, text string, slot int")
    want = {tuple(r)[1:] for r in sharding.shard_documents(df.withColumnRenamed("shard", "k"), 4, "k").drop("slot").collect()}
    got = sharding.shard_documents(df, 4, "shard")
    assert got.columns == ["shard", "size", "text_crc32", "law", "shard_shard", "slot", "grown_shard"]
    assert {tuple(r)[1:] for r in got.drop("slot").collect()} == want and got.count() == 42
    for name in ("size", "slot", "__row", "a.b"):
        named = sharding.shard_documents(df.select(F.col("shard").alias(name), "text"), 4, name)
        assert named.columns[0] == name and named.where(F.col(f"`{name}`").isNull()).count() == 2


def test_sharding(spark):
    rows = [*enumerate(odd_texts()), (None, "a"), (None, None), (3, "again")]
    got = sharding.shard_documents(docs(spark, rows), 4).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 4) and r["law"] == "key" for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    ints = spark.range(50).select(sharding.shard_of(F.col("id"), 16).alias("a"), sharding.shard_of(F.col("id").cast("int"), 16).alias("b"))
    assert ints.where("a <> b").count() == 0


def test_shares_are_even(spark):
    got = spark.range(20000).select(sharding.shard_of(F.col("id"), 16).alias("s"), sharding.shard_of(F.col("id"), 17).alias("t"))
    sizes = Counter(r["s"] for r in got.collect())
    assert len(sizes) == 16 and max(sizes.values()) < 1.15 * 1250
    assert got.where("s <> t").count() < 1.15 * 20000 / 17


@pytest.mark.parametrize("parts", [1, 7])
def test_grouped_rank(spark, parts):
    df = numbered(spark.range(500).selectExpr("id % 3 as g", "id % 7 as o"), "rows")
    rows = grouped_rank(df, ["g"], "r", 167 // parts).collect()
    for g in range(3):
        own = sorted(r["r"] for r in rows if r["g"] == g)
        assert own == list(range(len(own)))


def test_encoder_equals_library():
    e = tokens.encoder(tokens.default_path())
    r = random.Random(2)
    bits = ["a", "b1", " ", " ", "\n", "\t", "'s", "'", "!", "　", "é", "\x1c", " x", "×", "１", "中", "ſ", "'ll", "<|endoftext|>", "\xa0", "word"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["", "antidisestablishment" * 30]
    got = []
    for _, _, flat, at in text_slices(pa.array(texts), 20000):
        ids, n = e.encode(flat, at)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def ids_of(text):
    return [*tokens.encoder(tokens.default_path()).direct(text or ""), 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(spark, size, tmp_path):
    rows = [*enumerate(odd_texts()), (None, "b"), (2, "b")]
    packed = packing.pack_documents(docs(spark, rows), size, ids=True)
    got = packed.collect()
    want = Counter()
    for i, t in rows:
        ids = ids_of(t)
        first = len(ids) % size or size
        bounds = [0, *range(first, len(ids) + 1, size)]
        want.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    least = -(-sum(r["length"] for r in got) // size)
    assert len(bins) <= 1.1 * least + 2
    packing.write_sequences(packed, str(tmp_path / "s"))
    out = {r["sequence_id"]: r["ids"] for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert all(zlib.crc32(out[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]) == r["ids_crc32"] for r in got)


def test_fullest_is_the_best_subset():
    r = random.Random(3)
    for _ in range(60):
        counts, room = [0] + [r.choice([0, 0, 1, 2]) for _ in range(12)], r.randint(0, 25)
        chosen = packing.fullest(counts, room)
        sums = {0}
        for length, n in enumerate(counts):
            sums |= {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        assert sum(k * n for k, n in chosen.items()) == max(sums)
        assert all(n <= counts[k] for k, n in chosen.items())


@pytest.mark.parametrize("bits,file_bytes", [(False, 1 << 27), (True, 1 << 27), (False, 500)])
def test_token_files(spark, monkeypatch, bits, file_bytes, tmp_path):
    rows = [*enumerate(odd_texts()), (None, "zz"), (7, "b"), (7, "a"), (-5, "neg"), *[(9, "same")] * 30]
    token_files.write_tokens(docs(spark, rows), str(tmp_path / "t"), bits=bits, file_bytes=file_bytes)
    if file_bytes == 500:  # many files; the rows of one doc_id are in several
        assert spark.read.text(str(tmp_path / "t/kind=parts")).count() > 20
    got = token_files.read_tokens(spark, str(tmp_path / "t"), ids=True).orderBy("start").collect()
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4"))) for r in got) == Counter((i, tuple(ids_of(t))) for i, t in rows)
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    start = 0
    for r in got:
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]


def test_planes_round_trip():
    ids = np.random.default_rng(4).integers(0, 2**32, 70001, np.uint64).astype("<u4")
    for bits in (False, True):
        data = token_files.segment(3, 12, [1, None], [70000, 1], ids, bits) + b"\n"
        ((part, first, doc_ids, counts, back),) = token_files.segments(memoryview(data))
        assert (part, first, doc_ids, counts.tolist()) == (3, 12, [1, None], [70000, 1]) and (back == ids).all()
    with pytest.raises(ValueError):
        list(token_files.segments(b"x" * 100))
