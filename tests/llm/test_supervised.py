"""Quality rules and personal data against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.llm import personal_data, quality, secrets, weak_supervision
from pairloom.llm.spans import find_spans

ODD = ["", None, "   ", "\n\n \t", "x", "é 中文 ü", "a b c a b c a b", "one\none\n\none", "1.2.3.4.5.6.7.8", "a\x00b", "\x0b\x0c w"]


def luhn(d):
    t = 0
    for k, c in enumerate(reversed(d)):
        n = int(c) * (1 + k % 2)
        t += n - 9 * (n > 9)
    return t % 10 == 0


def brute_spans(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def personal_texts():
    r = random.Random(4)
    bits = ["ann.lee@mail.example.com", "a@b.c_d@e.f", "x@@y.z", "a@b@c.d", "é@x.de", "1.2.3.4", "256.1.1.1", "007.0.0.255", "1.2.3", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "1694893019727317", "5500005555555559", "+1 (714) 555-9345", "+49 30 1234567", "+1", "++1 222", "+12345678901234567", "0" * 30,
            "tel 030 1234 5678", "bob [at] site [dot] com", "fe80:0:0:0:1:2:3:4", "word", "中文", "\n", "isbn 9780306406157", ".", "-", "😀"]
    made = ["".join(r.choice(bits) + r.choice([" ", "", " ", ", "]) for _ in range(r.randint(1, 25))) for _ in range(120)]
    return [*made, *ODD, "9" * 5000, "a." * 4000 + "@" + "b." * 3000 + "c", "1 " * 3000, " ".join(["x@y.zz"] * 700), "+1" + " " * 3000]


def test_personal_data(spark):
    rows = list(enumerate(personal_texts())) + [(None, "1.2.3.4"), (3, "1.2.3.4"), (3, "1.2.3.4")]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, kind string, start int")
    got = personal_data.personal_data_report(df).collect()
    want = Counter()
    for i, t in rows:
        s = brute_spans(t)
        c = Counter(k for k, _, _ in s)
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
        want[(i, c["email"], c["ip"], c["card"], c["phone"], sha)] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    texts = dict(rows[: len(rows) - 3])
    for r in got:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        keys = [(personal_data.KINDS.index(k), int(a)) for k, a, _ in spans]
        assert keys == sorted(keys)
        if r["doc_id"] in texts and r["doc_id"] != 3:
            assert {(k, int(a), int(b)) for k, a, b in spans} >= set(brute_spans(texts[r["doc_id"]]))


def test_masking(spark):
    rows = [(1, "mail ann@x.org or 1.2.3.4 now", "z"), (2, None, "z"), (3, "plain", None), (4, "😀 +1 (714) 555-9345é", "z")]
    got = {r["doc_id"]: r for r in personal_data.mask_personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert [got[k]["text"] for k in (1, 2, 3, 4)] == ["mail [EMAIL] or [IP] now", None, "plain", "😀 [PHONE]é"]
    assert got[1]["spans"] == "z"


def test_added_spans(spark):
    """Candidates in the right context are learned from base spans; bare numbers are left alone."""
    good = [(i, f"please write to: user{i} [at] mail{i} [dot] com thanks, phone +1 (714) 555-{1000 + i}") for i in range(60)]
    good += [(100 + i, f"e-mail user{i}@mail{i}.com thanks") for i in range(60)]
    plain = [(1000 + i, f"order {1694893019727317 + 7 * i} of words and 1234 5678 more") for i in range(60)]
    got = personal_data.personal_data_report(spark.createDataFrame(good + plain, "doc_id long, text string")).collect()
    added = {r["doc_id"] for r in got if r["spans"].count("email") > r["n_email"]}
    assert added == set(range(60))
    assert all(r["spans"].count("card") == r["n_card"] for r in got if r["doc_id"] >= 1000)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_places_of_many_matches(spark, n):
    df = spark.createDataFrame([("é " + "ab1 " * n,)], "t string").select(find_spans(F.col("t"), "b1", F.lit(True)).alias("s"))
    assert [(x["start"], x["end"]) for x in df.first()["s"]] == [(3 + 4 * k, 5 + 4 * k) for k in range(n)]


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, covered = Counter(g), set()
    for i, x in enumerate(g):
        if c[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def quality_texts():
    r = random.Random(6)
    prose = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 150))) for _ in range(80)]
    junk = [" ".join(w + r.choice(["$$$", "###"]) for w in p.split()) for p in prose[:8]] + ["Wh. " * 80, ("THE!! " * 30 + "\n") * 3]
    small = ["".join(r.choice(["a ", "b ", "a b c ", "\n", "# "]) for _ in range(r.randint(1, 40))) for _ in range(40)]
    return prose, junk, small


def test_quality(spark):
    prose, junk, small = quality_texts()
    rows = list(enumerate([*prose, *junk, *small, *ODD, "w " * 20000]))
    df = spark.createDataFrame([(i, t, "a", 2) for i, t in rows], "doc_id long, text string, q string, kept int")
    got = {r["doc_id"]: r for r in quality.quality_report(df).collect()}
    for i, t in rows:
        r, want = got[i], brute_counts(t)
        assert tuple(r)[1:6] == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(len(prose)))
    assert not any(got[len(prose) + i]["kept"] for i in range(len(junk)))


def test_quality_of_null_ids_and_repeated_rows(spark):
    prose, junk, _ = quality_texts()
    texts = [*prose, *junk, junk[0], junk[0], prose[0], prose[0], None, ""]
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 9, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = quality.quality_report(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted([(None if i % 5 == 0 else i % 9, *brute_counts(t)) for i, t in enumerate(texts)], key=key)
    assert sorted([tuple(r)[:6] for r in got], key=key) == want
    verdicts = {}
    for r in got:
        verdicts.setdefault(tuple(r)[1:6], set()).add(r["kept"])
    assert all(len(verdicts[brute_counts(t)]) == 1 for t in (prose[0], junk[0], None))


def test_secrets_kept_with_clashing_names(spark):
    text = "password = abcDEF123456xyz and 0123456789abcdef0123"
    names = ["words", "__m", "k1", "base", "a.b"]
    df = spark.createDataFrame([(text, *[f"{c}{i}" for c in names]) for i in range(3)] + [(None, *[None] * 5)], ", ".join(["text string", *[f"`{c}` string" for c in names]]))
    got = secrets.find_secrets(df, names)
    assert got.columns == [*names, "__base", "__spans"]
    found = sorted(tuple(r)[:5] for r in got.where(F.size("__base") == 2).collect())
    assert found == [tuple(f"{c}{i}" for c in names) for i in range(3)] and got.count() == 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_report(none).count() == 0 and personal_data.personal_data_report(none).count() == 0


def test_estimated_reliabilities(spark):
    """Votes drawn from known reliabilities are told apart again."""
    r = random.Random(3)
    rows = []
    for _ in range(4000):
        y = r.random() < 0.3
        rows.append(([(1 if (r.random() < a) == y else -1) if r.random() < 0.8 else 0 for a in (0.9, 0.8, 0.75, 0.6)], y))
    df = spark.createDataFrame(rows, "votes array<int>, y boolean")
    model = weak_supervision.fit(df, 4, rounds=80)
    assert abs(model["prior"] - 0.3) < 0.1
    for t, a in zip(model["tables"], (0.9, 0.8, 0.75, 0.6), strict=True):
        assert abs(t["yes"][2] / (t["yes"][0] + t["yes"][2]) - a) < 0.1
    p = weak_supervision.odds_of([F.get("votes", F.lit(j)) for j in range(4)], model)
    assert df.where((p > 0) == F.col("y")).count() > 0.85 * len(rows)
