"""Personal data: base patterns and, around them, weakly supervised spans.

Base spans are those of the patterns and their checks; they always stay.  Wider patterns give
candidates.  On every candidate labelers vote: the format check, a gazetteer, the words before it, its
shape and its neighbours.  For each kind expectation-maximisation estimates how reliable they are;
the posteriors are soft labels for the final span classifier (naive Bayes on votes and features of the
span), which adds candidates that no base span touches.  Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import let, plain_columns, quoted, written
from pairloom.llm.spans import find_spans, joined
from pairloom.llm.weak_supervision import fit, odds_of, probability

KINDS = ("email", "ip", "card", "phone")
#: A candidate is added if the classifier gives it at least this probability.
ADD_FROM = 0.95
#: Characters before a candidate in which context words count.
CONTEXT = 48

# Patterns find what those of the contract find, in linear time: a run is tried from its start only.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({]\x20?(?:dot|DOT)\x20?[\])}])\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2,3}(?:[\x20-]?[0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9A-Za-z-])",
}

# Gazetteers and context words of each kind.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot\W{0,3})(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ca|ch|at|nl|be|pt|br|mx|jp|cn|in|au)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:|^[Ff][CDEcde]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-8]|6[0245])",
    "phone": r"^(?:\+\x20?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?0)",
}
NEAR = {
    "email": r"(?i)(?:e-?mail|mailto|contact|correo|courriel|write to|reach)",
    "ip": r"(?i)(?:\bip\b|address|adresse|host|server|login|from)",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta|payment)",
    "phone": r"(?i)(?:phone|\btel\b|\bcall|mobile|\bfax\b|telefon|téléphone|teléfono|contact)",
}
OTHER_NUMBERS = r"(?i)(?:isbn|issn|version|release|build|order|invoice|serial|part no|article|hash|uuid|build)[^\n]{0,12}$"
LABELERS = 5


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _passes(kind: str, found: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    n = F.length(_digits(found))
    return {
        "email": F.lit(True),
        "ip": found.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"),
        "card": n.between(13, 19) & F.call_function("luhn_check", _digits(found)),
        "phone": n.between(9, 15),
    }[kind]


def _base(kind: str, text: Column) -> Column:
    needs = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }[kind]
    return F.filter(find_spans(text, BASE[kind], needs), lambda s: _passes(kind, s["found"]))


def _candidates(kind: str, text: Column) -> Column:
    needs = {
        "email": text.rlike(r"[\[({]\x20?(?:at|AT|@)\x20?[\])}]"),
        "ip": text.rlike(r":[0-9A-Fa-f]{1,4}:"),
        "card": text.rlike(r"[0-9]{4}[\x20-]?[0-9]{4}"),
        "phone": text.rlike(r"[0-9][\x20.-][0-9]{3,4}[\x20.-][0-9]{3}"),
    }[kind]
    return find_spans(text, WIDE[kind], needs)


def _votes(kind: str, text: Column, span: Column, base: bool) -> Column:
    """One vote of each labeler: 1 personal data, -1 not, 0 abstain."""
    found, start = span["found"], span["start"]
    before = F.substring(text, F.greatest(F.lit(1), start - CONTEXT + 1), F.least(F.lit(CONTEXT), start))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    digits = _digits(found)
    form = F.lit(1) if base else {"email": F.lit(0), "ip": F.lit(0), "card": F.when(F.call_function("luhn_check", digits), 1).otherwise(-1), "phone": F.lit(0)}[kind]
    return F.array(
        form,
        F.when(found.rlike(GAZETTEER[kind]), 1).otherwise(-1),
        F.when(before.rlike(OTHER_NUMBERS), -1).when(before.rlike(NEAR[kind]), 1).otherwise(0),
        F.when((digits != "") & digits.rlike(r"^(.)\1*$"), -1).otherwise(0),
        F.when(F.substring(before, -1, 1).rlike("[A-Za-z0-9_/=#]") | after.rlike("[A-Za-z0-9_/=#]"), -1).otherwise(0),
    )


def _features(kind: str, found: Column) -> Column:
    """A few small numbers that describe a span."""
    return F.array(
        F.concat(F.lit(f"{kind} digits "), F.least(F.lit(20), F.length(_digits(found)))),
        F.concat(F.lit(f"{kind} signs "), F.least(F.lit(9), F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")))),
        F.concat(F.lit(f"{kind} first "), F.when(found.rlike("^[0-9]"), "digit").when(found.rlike("^[A-Za-z]"), "letter").otherwise("sign")),
    )


def _marked(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The kept columns and, for each kind, base spans and candidates with votes and features."""
    t = F.coalesce(quoted(text), F.lit(""))
    return docs.select(*map(quoted, keep), *[let(_base(k, t), _both(k, t)).alias(f"__{k}") for k in KINDS])


def _both(kind: str, text: Column):
    """From the base spans to a struct of them and of the candidates that none of them touches."""

    def told(spans: Column, base: bool) -> Column:
        def one(s: Column) -> Column:
            votes, features = _votes(kind, text, s, base), _features(kind, s["found"])
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes.alias("votes"), features.alias("features"))

        return F.transform(spans, one)

    def free(base: Column) -> Column:
        return F.filter(_candidates(kind, text), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    return lambda base: F.struct(told(base, True).alias("base"), told(free(base), False).alias("wide"))


def find_personal_data(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns (default: doc_id), ``__base`` and ``__spans``: array<struct<kind, start, end>> by kind, then start.

    Places are code points, ends exclusive.  A null or empty text has no spans; repeated rows are
    judged each; an empty table gives no rows.  The marked rows are written once.
    """
    keep = keep or ["doc_id"]
    marked = written(_marked(docs, keep, text), "marked")
    candidates = marked.select(F.explode(F.concat(*[F.concat(f"__{k}.base", f"__{k}.wide") for k in KINDS])).alias("c")).select("c.*")
    models = {k: fit(candidates.where(F.col("kind") == k), LABELERS) for k in KINDS}
    weights = _train(candidates, models)
    columns, bases, alls = [*map(quoted, keep)], [], []
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"]))
    for k in KINDS:
        added = F.filter(F.col(f"__{k}.wide"), _added(k, weights))
        bases.append(plain(F.col(f"__{k}.base")))
        alls.append(F.sort_array(F.concat(plain(F.col(f"__{k}.base")), plain(added))))
    return marked.select(*columns, F.concat(*bases).alias("__base"), F.concat(*alls).alias("__spans"))


def _vote_features(kind: str | Column, votes: Column) -> Column:
    return F.transform(votes, lambda v, j: F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(" labeler "), j, F.lit(" says "), v))


def _train(candidates: DataFrame, models: dict[str, dict]) -> dict[str, float]:
    """Log-odds of each feature value and kind from the soft labels; their number is bounded by the features."""
    label = F.lit(0.0)
    for kind, model in models.items():
        odds = odds_of([F.get("votes", F.lit(j)) for j in range(LABELERS)], model)
        label = F.when(F.col("kind") == kind, probability(odds)).otherwise(label)
    soft = candidates.withColumn("p", label)
    values = F.concat("features", _vote_features(F.col("kind"), F.col("votes")), F.array(F.col("kind")))
    sums = soft.select("p", F.explode(values).alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = {r["f"]: (r["yes"], r["no"]) for r in sums if r["f"] in models}
    weights = {kind: math.log((yes + 1) / (no + 1)) for kind, (yes, no) in total.items()}
    for r in sums:
        if r["f"] not in models:
            yes, no = total[r["f"].split(" ")[0]]
            weights[r["f"]] = math.log((r["yes"] + 1) / (yes + 3)) - math.log((r["no"] + 1) / (no + 3))
    return weights


def _added(kind: str, weights: dict[str, float]):
    """Whether the classifier adds a candidate."""
    own = {f: w for f, w in weights.items() if f.startswith(f"{kind} ")}
    if not own:
        return lambda _: F.lit(False)
    table = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])

    def sure(span: Column) -> Column:
        values = F.concat(span["features"], _vote_features(kind, span["votes"]))
        told = F.transform(values, lambda f: F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        return probability(F.aggregate(told, F.lit(weights[kind]), lambda a, x: a + x)) >= ADD_FROM

    return sure


def personal_data_report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of base spans and all spans."""
    found = find_personal_data(docs)
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by its kind in brackets; a null text stays null."""
    rows, text = plain_columns(docs, text)
    found = find_personal_data(rows, keep=rows.columns, text=text)
    ordered = F.sort_array(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def masked(spans: Column) -> Column:
        def pieces(reached: Column) -> Column:
            # the end of all spans before this one
            def piece(s: Column, k: Column) -> Column:
                at = F.get(reached, k)
                gap = F.substring(F.col(text), at + 1, F.greatest(F.lit(0), s["start"] - at))
                return F.when(s["start"] >= at, F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

            rest = F.substring(F.col(text), F.element_at(reached, -1) + 1, F.length(text))
            return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

        ends = F.aggregate(spans, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.greatest(F.element_at(a, -1), s["end"]))))
        return let(ends, pieces)

    clean = F.when(F.size("__spans") == 0, F.col(text)).otherwise(let(ordered, masked))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), clean)).select(rows.columns).toDF(*docs.columns)
