"""Quality rules as weak labelers.

Each rule votes for bad (1), for good (-1) or abstains (0); expectation-maximisation over the vote
patterns of all rows estimates how reliable each rule is, and the posterior probability of quality
decides, instead of "all rules must pass".  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import let, plain_columns, quoted, written
from pairloom.llm.weak_supervision import fit, odds_of, probability

# classes of characters in regular expressions
SPACES = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: A row is kept if its posterior probability of quality is at least this.
KEEP_FROM = 0.5
#: The share of bad rows that estimation begins with.
PRIOR_BAD = 0.15


def _count(text: Column, characters: str) -> Column:
    """How many characters of a regular expression's class the text has."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))).cast("long")


def _repeated(words: Column) -> Column:
    """How many words stand in windows of three words that occur twice or more."""

    def covered(again: Column) -> Column:
        # ``again``: ascending places of such windows; each adds its three words less those that the one before covers
        added = F.transform(again, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(again, k - 1))))
        return F.aggregate(added, F.lit(0), lambda a, x: a + x)

    def places(w: Column, hashes: Column) -> Column:
        # sorted by hash, equal windows are neighbours
        def again(s: Column) -> Column:
            def same(k: Column, d: int) -> Column:
                x, y = F.get(s, k), F.get(s, k + d)
                words = [F.get(w, x["at"] + j) == F.get(w, y["at"] + j) for j in range(3)]
                return F.coalesce((x["h"] == y["h"]) & words[0] & words[1] & words[2], F.lit(False))

            marked = F.filter(s, lambda x, k: same(k, 1) | same(k, -1))
            return F.when(F.size(marked) == 0, 0).otherwise(let(F.sort_array(F.transform(marked, lambda x: x["at"])), covered))

        return let(F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at")))), again)

    def hashes(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, k: F.xxhash64(x, F.get(w, k + 1), F.get(w, k + 2)))

    def some(w: Column, h: Column) -> Column:
        # most texts repeat no window: a hash set tells
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(places(w, h))

    return let(words, lambda w: F.when(F.size(w) < 4, 0).otherwise(let(hashes(w), lambda h: some(w, h))))


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a struct ``q`` of counts: the base counts and those that only rules use."""
    t = F.coalesce(quoted(text), F.lit(""))
    words = F.array_remove(F.split(t, f"[{SPACES}]+", -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    q = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _count(t, SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).cast("long").alias("n_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            _count(t, "A-Z").alias("n_upper"),
            _count(t, "a-z").alias("n_lower"),
            _count(t, "!").alias("n_cries"),
            F.size(F.array_distinct(w)).cast("long").alias("n_kinds"),
        ),
    )
    return docs.withColumn("q", q)


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("q.n_words") < 50) | (100 * F.col("q.n_repeat_words") > 50 * F.col("q.n_words"))


def votes() -> list[Column]:
    """The rules' votes: 1 for bad, -1 for good, 0 to abstain."""
    n = lambda c: F.col(f"q.{c}")
    words, chars = n("n_words"), n("word_chars")

    def rule(bad: Column, good: Column | None = None) -> Column:
        vote = F.when(bad, 1)
        return (vote if good is None else vote.when(good, -1)).otherwise(0)

    # kinds of junk seldom go together, so the lack of one is no vote for good; what the base rules reject is not asked again
    mean = F.when(words > 0, chars / words).otherwise(0.0)
    return [
        rule(F.lit(False), words >= 100),
        rule((mean < 2.5) | (mean > 15), (mean > 3.5) & (mean < 11)),
        rule(5 * n("n_symbols") > words),
        rule(20 * n("n_symbols") > chars),
        rule(3 * n("n_dup_lines") > n("n_lines")),
        rule((words >= 50) & (5 * n("n_kinds") < words)),
        rule(n("n_upper") > n("n_lower")),
        rule(5 * n("n_cries") > words),
    ]


def _scored(counted: DataFrame, keep_from: float) -> DataFrame:
    rules = votes()
    # rows that the base rules reject need no verdict, and would hide rarer kinds of junk
    model = fit(counted.where(~base_failed()).select(F.array(*rules).alias("votes")), len(rules), PRIOR_BAD)
    scored = counted.withColumn("quality", 1 - probability(odds_of(rules, model)))
    return scored.withColumn("kept", ~base_failed() & (F.col("quality") >= keep_from))


def score_quality(docs: DataFrame, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows with ``q`` (counts), ``quality`` (posterior probability) and ``kept``.

    A null or empty text has no words, so it fails the base rules.  Repeated rows count as often as
    they occur; an empty table gives no rows.  If an input column has one of the three names, the new
    one gets the prefix ``rules_``.  The counted rows are written once and read for the estimation
    and for the decisions.
    """
    rows, t = plain_columns(docs, text)
    scored = _scored(written(quality_counts(rows, t), "counted"), keep_from)
    return scored.toDF(*docs.columns, *[f"rules_{c}" if c in docs.columns else c for c in ("q", "quality", "kept")])


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior ``quality`` of each row."""
    scored = _scored(written(quality_counts(docs.select("doc_id", "text")).drop("text"), "counted"), KEEP_FROM)
    counts = [F.col(f"q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return scored.select("doc_id", *counts, base_failed().alias("base_failed"), "kept", F.round("quality", 6).alias("quality"))
