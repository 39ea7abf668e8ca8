"""Matches of patterns with their places, in built-in functions only.

Spark's regular expressions give the matches and the pieces between them, but no places.  Places are
sums of the lengths before; they are summed in blocks, so a text with many matches stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.llm.common import let

_BLOCK = 64


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _ends(lengths: Column) -> Column:
    """Running sums of an array of at least one number."""

    def placed(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(v, b * _BLOCK + 1, _BLOCK)))

        def within(block_sums: Column) -> Column:
            before = F.transform(block_sums, lambda _, b: _total(F.slice(block_sums, F.lit(1), b)))
            return let(before, lambda at: F.transform(v, lambda _, k: _end(v, at, k)))

        return let(blocks, within)

    def _end(v: Column, at: Column, k: Column) -> Column:
        block = F.floor(k / _BLOCK).cast("int")
        return F.get(at, block) + _total(F.slice(v, block * _BLOCK + 1, k % _BLOCK + 1))

    return let(lengths, placed)


def find_spans(text: Column, pattern: str, needs: Column) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches, in code points.

    ``pattern`` must not match the empty string.  It is only tried where ``needs`` holds, which should
    be a cheap test that every text with a match passes.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        both = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.length(m) + F.length(g))
        return let(
            _ends(both),
            lambda ends: F.zip_with(matches, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("found"))),
        )

    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(needs, let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(empty))).otherwise(empty)


def joined(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
