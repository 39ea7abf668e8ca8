"""Secrets: base patterns and, around them, strings that look random to Markov models.

Two character models, one of random strings and one of ordinary words and identifiers, give each long
token a log-likelihood ratio; tokens over a threshold are added.  The models are bigram tables, trained
on labelled samples from the texts themselves: the values of base matches are random strings; other
long tokens that are built like identifiers (words or short numbers, tied by signs or capitals), and a word of each text, are ordinary.  Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import let, quoted, written
from pairloom.llm.spans import find_spans, joined

KINDS = ("assign", "access", "hex")
#: Kind of the added spans.
ADDED = "random"
#: Tokens of at least so many characters are scored.
LEAST_CHARS = 20
#: A token is added from this mean log-likelihood ratio for each character (natural logarithm).
ADD_FROM = 0.35
#: At most so many labelled values of each class train the models (a sample by hash); all tokens are scored.
SAMPLE = 200_000
#: Pairs seen after a character weigh as much as this many of characters alone.
BACK_OFF = 8

BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]++",
}
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Long tokens that count as ordinary in training.
_PART = r"(?:(?:[A-Z]?[a-z]{2,14}+|[A-Z]{2,14}+)++[0-9]{0,4}+|[0-9]{1,4}+|[A-Za-z])"
PLAIN = rf"^{_PART}(?:[_/=+-]++{_PART})*+[_/=+-]*+$"
# The symbols that the models tell apart; what is none of them shares the last place.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
N = len(SYMBOLS) + 1


def _passes(kind: str, found: Column) -> Column:
    return {
        "assign": F.length(F.regexp_extract(found, BASE["assign"], 1)) >= 12,
        "access": F.length(found) >= 18,
        "hex": F.length(found) >= 16,
    }[kind]


def _needs(kind: str, text: Column) -> Column:
    return {
        "assign": text.rlike(r"(?i:password|passwd|secret|token|api_?key)[^\n]{0,3}?\x20*+[:=]"),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{16}"),
    }[kind]


def _value(kind: str, found: Column) -> Column:
    return F.regexp_extract(found, BASE["assign"], 1) if kind == "assign" else found


def _spans(text: Column) -> Column:
    """The base spans, by start, then kind."""
    each = []
    for k, kind in enumerate(KINDS):
        # runs of hex digits shorter than 16 are no base spans; leaving them out moves no other match
        pattern = "(?<![0-9a-f])[0-9a-f]{16,}+" if kind == "hex" else BASE[kind]
        found = F.filter(find_spans(text, pattern, _needs(kind, text)), _check(kind))
        each.append(F.transform(found, _named(k, kind)))
    return F.sort_array(F.concat(*each))


def _check(kind: str):
    return lambda s: _passes(kind, s["found"])


def _named(order: int, kind: str):
    def named(s: Column) -> Column:
        value = _value(kind, s["found"]).alias("value")
        return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"), value)

    return named


def _tokens(text: Column, base: Column) -> Column:
    """The long tokens that no base span touches."""
    found = find_spans(text, TOKEN, text.rlike("[A-Za-z0-9+/_=-]{20}"))
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _codes(value: Column) -> Column:
    """The place of each character in SYMBOLS, from 0."""
    return F.transform(F.split(value, ""), lambda c: F.when(F.call_function("locate", c, F.lit(SYMBOLS)) > 0, F.call_function("locate", c, F.lit(SYMBOLS)) - 1).otherwise(N - 1))


def _bigrams(value: Column) -> Column:
    """N * code + next code for each pair of neighbouring characters."""
    return let(_codes(value), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * N + b))


def train(marked: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of characters, random against ordinary; N * N numbers.

    Pairs that are rare in the samples are judged by their second character.  Without samples of either
    class every ratio is 0, so nothing is added.
    """
    secret = marked.select(F.explode("base.value").alias("v"), F.lit(True).alias("random"))
    plain = marked.select(F.explode("tokens.found").alias("v"), F.lit(False).alias("random")).where(F.col("v").rlike(PLAIN))
    words = marked.select(F.explode("words").alias("v"), F.lit(False).alias("random"))
    values = secret.unionByName(plain).unionByName(words).distinct()
    sizes = {r["random"]: r["n"] for r in values.groupBy("random").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return [0.0] * (N * N)
    share = F.when(F.col("random"), SAMPLE / sizes[True]).otherwise(SAMPLE / sizes[False])
    sample = values.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share * (1 << 30))
    counts = sample.select("random", F.explode(_bigrams(F.col("v"))).alias("pair")).groupBy("random", "pair").count().collect()
    tables = {c: [0] * (N * N) for c in (True, False)}
    for r in counts:
        tables[r["random"]][r["pair"]] = r["count"]
    chances = {c: _chances(t) for c, t in tables.items()}
    return [math.log(x / y) for x, y in zip(chances[True], chances[False], strict=True)]


def _chances(pairs: list[int]) -> list[float]:
    """The chance of each next character after each character, drawn towards that of the next one alone."""
    alone = [sum(pairs[b::N]) + 1 / 3 for b in range(N)]
    alone = [n / sum(alone) for n in alone]
    out = []
    for a in range(N):
        row = pairs[a * N : a * N + N]
        out += [(n + BACK_OFF * p) / (sum(row) + BACK_OFF) for n, p in zip(row, alone, strict=True)]
    return out


def find_secrets(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns (default: doc_id), ``__base`` and ``__spans``: array<struct<start, order, kind, end>> by start.

    Places are code points, ends exclusive.  A null or empty text has no spans, a text of any length is
    searched whole; repeated rows are judged each; an empty table gives no rows.  Kept columns may have any
    names but those two.  The marked rows are written once.
    """
    keep = keep or ["doc_id"]
    kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    t = F.coalesce(quoted(text), F.lit(""))
    both = let(_spans(t), lambda b: F.struct(b.alias("base"), _tokens(t, b).alias("tokens")))
    # besides long tokens, each text gives one ordinary word of eight letters or more as a sample
    word = F.regexp_extract(t, "(?<![A-Za-z])[A-Z]?[a-z]{7,18}(?![A-Za-z0-9=_-])", 0)
    words = F.when(word != "", F.array(word)).otherwise(F.array().cast("array<string>"))
    marked = written(docs.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], both.alias("__m"), words.alias("words")), "secrets")
    ratios = train(marked.select("__m.base", "__m.tokens", "words"))
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def random(s: Column) -> Column:
        total = F.aggregate(_bigrams(s["found"]), F.lit(0.0), lambda a, k: a + F.get(table, k))
        return total >= ADD_FROM * F.length(s["found"])

    plain = lambda s: F.struct(s["start"], s["order"], s["kind"], s["end"])
    base = F.transform("__m.base", plain)
    added = F.transform(
        F.filter("__m.tokens", random),
        lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("order"), F.lit(ADDED).alias("kind"), s["end"].alias("end")),
    )
    return marked.select(*kept, base.alias("__base"), F.sort_array(F.concat(base, added)).alias("__spans"))


def secrets_report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of base spans and all spans."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))
