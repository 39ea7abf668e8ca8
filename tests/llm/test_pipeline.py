"""The pipeline against a brute-force version of its stages."""

import math
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_near_duplicates import brute as brute_duplicates  # noqa: E402
from test_scans import brute_decontamination, crc, ids_of  # noqa: E402
from test_supervised import brute_counts, brute_spans  # noqa: E402

from pairloom.llm import weak_supervision  # noqa: E402
from pairloom.llm.quality import PRIOR_BAD  # noqa: E402


def votes(t):
    n, chars, symbols, dup, repeat = brute_counts(t)
    lines = sum(1 for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r"))
    upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    mean = chars / n if n else 0.0
    kinds = len(set(t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - {""})
    return (
        -1 if n >= 100 else 0,
        1 if mean < 2.5 or mean > 15 else -1 if 3.5 < mean < 11 else 0,
        int(5 * symbols > n),
        int(20 * symbols > chars),
        int(3 * dup > lines),
        int(n >= 50 and 5 * kinds < n),
        int(upper > lower),
        int(5 * t.count("!") > n),
    )


def brute_quality(texts):
    """Indexes of the texts that the rules keep; expectation-maximisation row by row."""
    good = [i for i, t in enumerate(texts) if (c := brute_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    rows = [votes(texts[i]) for i in good]
    prior, k = PRIOR_BAD, len(rows[0])
    tables = [(weak_supervision.START_TRUE, weak_supervision.START_FALSE)] * k

    def bad(v):
        odds = math.log(prior / (1 - prior)) + sum(math.log(t[0][x + 1] / t[1][x + 1]) for x, t in zip(v, tables))
        return 1 / (1 + math.exp(-odds))

    for _ in range(weak_supervision.ROUNDS):
        p = [bad(v) for v in rows]
        prior = (sum(p) + 1) / (len(p) + 2)
        tables = [
            tuple(
                [(1 + sum(w for v, w in zip(rows, weight) if v[j] == x)) / (3 + sum(weight)) for x in (-1, 0, 1)]
                for weight in (p, [1 - w for w in p])
            )
            for j in range(k)
        ]
    return [i for i, v in zip(good, rows) if 1 - bad(v) >= 0.5]


def mask(t):
    out, at = "", 0
    for a, b, k in sorted((a, b, k) for k, a, b in brute_spans(t)):
        if a >= at:
            out += t[at:a] + f"[{k.upper()}]"
        at = max(at, b)
    return out + t[at:]


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    prose = [[word() for _ in range(r.randint(60, 160))] for _ in range(70)]
    items = [(k, " ".join(word() for _ in range(15))) for k in range(4)]
    texts = [" ".join(p) for p in prose]
    for p in prose[:10]:
        own = list(p)
        own[r.randrange(len(own))] = word()
        texts += [" ".join(own), " ".join(p)]
    for k in range(6):
        p = list(prose[20 + k])
        p[30:30] = items[k % 4][1].split()
        texts[20 + k] = " ".join(p)
    for k in range(30, 40):
        texts[k] += r.choice([" ann@mail.example.com", " 1.2.3.4 ", " +1 (714) 555-9345", " 4111 1111 1111 1111."])
    texts += [" ".join(w + "$$$" for w in p) for p in prose[50:56]] + ["", None, "short", "Wh. " * 100, ("A!! " * 40 + "\n") * 2]
    texts.append(" ".join(word() for _ in range(3000)))
    r.shuffle(texts)
    return list(enumerate(texts)), items


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(rows[i][0], rows[i][1] or "") for i in brute_quality([t or "" for _, t in rows])]
    assert 70 < len(kept) < len(rows)
    alone = {d for d, _, _, k in brute_duplicates(kept) if k}
    kept = [x for x in kept if x[0] in alone]
    dirty = {d for d, *_, c in brute_decontamination(kept, items) if c}
    assert len(dirty) == 6
    kept = [(d, mask(t)) for d, t in kept if d not in dirty]
    want = Counter()
    for d, t in kept:
        ids = ids_of(t)
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        want.update((d, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 2048 for b in bins.values())


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(1, "w" * 3 + " word" * 3, None, "s", 1), (None, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns, name
            out.collect()


def test_clashing_columns(spark, tmp_path):
    """Every stage gives all columns back as they were, whatever their names."""
    names = ["doc_id", "text", "q", "quality", "kept", "rules_kept", "n_words", "contaminated", "band", "component_id", "k0", "__row", "__text", "spans", "a.b", "x`y"]
    r = random.Random(2)
    prose = [" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(120)) for _ in range(6)]
    rows = [(i, t, *[f"{i} {c}" for c in names[2:]]) for i, t in enumerate(prose)]
    docs = spark.createDataFrame(rows, ", ".join(["`doc_id` long", "`text` string", *[f"`{c.replace('`', '``')}` string" for c in names[2:]]]))
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names and sorted(map(tuple, out.collect())) == rows, name
    assert corpus_pipeline.packing(spark, docs, str(tmp_path)).count() == 6


def test_null_and_repeated_keys(spark, tmp_path):
    r = random.Random(4)
    a, b, c, d, e, leak = (" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(100)) for _ in range(6))
    near = d.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (None, a), (None, b), (5, a), (5, c), (7, e), (7, e), (None, d), (None, near), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, corpus_pipeline.deduplicate(spark, docs, "").collect()))
    alone = [x for x in ((None, d), (None, near)) if got[x]]
    assert len(alone) == 1 and got == Counter([(1, a), (None, b), (5, c), (7, e), *alone, (None, ""), (None, None)])

    spark.createDataFrame([(None, leak[:200]), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, a), (None, leak)], "doc_id long, text string")
    assert corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect() == [(1, a)]


def test_deduplicate_leaves_little_on_disk(spark, tmp_path):
    """Neither a copy of the texts nor the shuffle files of what has run stay until the result is written."""
    blocks = [Path(p.getPath()) for p in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p.name for b in blocks for p in b.rglob("shuffle_*.data")}
    r = random.Random(6)
    prose = [[f"w{r.random()}" for _ in range(300)] for _ in range(60)]
    rows = [(i, " ".join([f"new{i}", *p])) for i, p in enumerate(prose * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    size = lambda p: sum(x.stat().st_size for x in Path(p).rglob("*.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir")
    before, kept = shuffled(), size(shared)
    out = corpus_pipeline.deduplicate(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    assert 10 * (size(shared) - kept) < size(tmp_path / "docs")
    for _ in range(100):  # they are deleted in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert sorted(map(tuple, out.collect())) == rows[:60]


def test_deduplicate_repeated_rows(spark):
    """Of rows repeated often one stays, with all of its own columns; rows without words all stay; doc_ids may be of another type."""
    r = random.Random(3)
    a, b, c = (" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(100)) for _ in range(3))
    rows = [(a, None, k) for k in range(200)] + [(b, "x10", 1), (b, "x9", 2), (b, "x10", 3), (c, "x1", 4), (c + " new", "x0", 5)]
    empty = [("\t \n", None, 6), ("", "x1", 7), ("", "x1", 7), (None, None, 8), (None, None, 8)]
    docs = spark.createDataFrame(rows + empty, "text string, doc_id string, n int").repartition(7)
    got = list(map(tuple, corpus_pipeline.deduplicate(spark, docs, "").collect()))
    assert Counter(x for x in got if x[0] in {y[0] for y in empty}) == Counter(empty)
    got = [x for x in got if x not in empty]
    assert len(got) == 3 and set(got) <= set(rows) and {x[:2] for x in got} == {(a, None), (b, "x10"), (c + " new", "x0")}
