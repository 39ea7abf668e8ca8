"""Votes of weak labelers, their reliabilities and posteriors, in built-in functions only.

Labelers vote 1, -1 or 0 (abstain).  Given the true class votes are taken as independent, so the
counts of the vote patterns are all that expectation-maximisation needs: at most 3**labelers rows,
whatever the size of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import let

ROUNDS = 25
#: What labelers are believed to do at first: chances of votes -1, 0 and 1 in the true and the false class.
START_TRUE, START_FALSE = (0.1, 0.65, 0.25), (0.15, 0.83, 0.02)


def log_odds(votes: Column, model: Column) -> Column:
    """Log-odds of the true class; model: struct<prior double, tables array<struct<yes, no array<double>>>>."""
    told = F.zip_with(votes, model["tables"], lambda v, t: F.log(F.get(t["yes"], v + 1) / F.get(t["no"], v + 1)))
    return F.aggregate(told, F.log(model["prior"] / (1 - model["prior"])), lambda a, x: a + x)


def probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def fit(votes: DataFrame, labelers: int, prior: float = 0.5, rounds: int = ROUNDS) -> dict:
    """Reliabilities by expectation-maximisation from a column ``votes`` (array of ints).

    All rows count: they are summed to vote patterns, and the patterns, at most 3**labelers, are
    gathered in one row, where the rounds run as one expression.  Returns {"prior", "tables"}; an
    empty table leaves the start values.
    """
    patterns = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    patterns = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    row = lambda p: F.array(*map(F.lit, p))
    first = F.struct(
        F.lit(prior).alias("prior"),
        F.array_repeat(F.struct(row(START_TRUE).alias("yes"), row(START_FALSE).alias("no")), labelers).alias("tables"),
    )

    def step(model: Column, seen: Column) -> Column:
        shares = F.transform(seen, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * probability(log_odds(p["votes"], model))).alias("yes")))

        def table(shares: Column) -> Column:
            def chance(j: Column, v: int, side) -> Column:
                # one vote of each kind is added, so no chance is 0
                hit = F.aggregate(shares, F.lit(1.0), lambda a, p: a + F.when(F.get(p["votes"], j) == v, side(p)).otherwise(0.0))
                return hit / (F.aggregate(shares, F.lit(3.0), lambda a, p: a + side(p)))

            yes, no = (lambda p: p["yes"]), (lambda p: p["n"] - p["yes"])
            total = F.aggregate(shares, F.lit(2.0), lambda a, p: a + p["n"])
            true = F.aggregate(shares, F.lit(1.0), lambda a, p: a + p["yes"])
            each = F.transform(
                F.sequence(F.lit(0), F.lit(labelers - 1)),
                lambda j: F.struct(F.array(*[chance(j, v, yes) for v in (-1, 0, 1)]).alias("yes"), F.array(*[chance(j, v, no) for v in (-1, 0, 1)]).alias("no")),
            )
            return F.struct((true / total).alias("prior"), each.alias("tables"))

        return let(shares, table)

    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda m, _: step(m, F.col("patterns")))
    return patterns.select(model.alias("m")).first()["m"].asDict(recursive=True)


def as_column(model: dict) -> Column:
    """The fitted numbers as a constant."""
    each = [F.struct(F.array(*map(F.lit, t["yes"])).alias("yes"), F.array(*map(F.lit, t["no"])).alias("no")) for t in model["tables"]]
    return F.struct(F.lit(model["prior"]).alias("prior"), F.array(*each).alias("tables"))


def odds_of(votes: list[Column], model: dict) -> Column:
    """Log-odds of the true class for votes in columns of their own: a sum of constants chosen by each vote."""
    out = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for vote, t in zip(votes, model["tables"], strict=True):
        w = [math.log(y / n) for y, n in zip(t["yes"], t["no"], strict=True)]
        out = out + F.when(vote == 1, w[2]).when(vote == -1, w[0]).otherwise(w[1])
    return out
